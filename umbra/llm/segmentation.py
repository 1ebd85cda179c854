"""Concatenated names split into words by a unigram Viterbi pass.

The model is how often each word occurs in a corpus.  Names don't meet the whole
vocabulary: their substrings are joined to it, so a name comes with just those counts
that it can use, whatever the vocabulary's size.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import arrow_batches, cut, join_per_key

#: Characters of a word; longer ones are no pieces of names.
LONGEST = 24
#: Names of more characters stand as they are: no label of a host has more.
LONGEST_NAME = 63
#: Costs are whole millionths, so that sums and ties don't depend on rounding.
UNIT = 1_000_000
#: Distinct words that a task holds before it hands on their counts.
FLUSH = 300_000


def word_counts(texts: DataFrame, words_of, flush: int = FLUSH) -> DataFrame:
    """(word, n) of a table with one binary column; ``words_of`` gives a text's words as bytes."""

    (column,) = texts.columns

    def run(iterator):
        import pyarrow as pa

        found: Counter = Counter()

        def handed_on():
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return batch

        for _, (values,) in arrow_batches(iterator, [column], rows=64):
            for value in values:
                found.update(words_of(value))
            if len(found) > flush:
                yield handed_on()
        yield handed_on()

    counted = texts.mapInArrow(run, "word binary, n long").groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))
    return counted.where(F.length("word").between(2, LONGEST))


def unknown_cost(length: int, total: int) -> int:
    """Of a piece that is no word: the rarer the longer it is."""
    return round(UNIT * (math.log(max(total, 1)) + (length - 1) * math.log(10)))


def known_cost(n: int, total: int) -> int:
    return round(UNIT * math.log(total / n))


def viterbi(name: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The cheapest pieces; ties go to fewer pieces, then to the longer last piece.

    known: occurrences of the words that stand in the name, by start and length.
    """
    best: list[tuple[int, int, int]] = [(0, 0, 0)]  # cost, pieces, start of the last
    for end in range(1, len(name) + 1):
        tries = []
        for start in range(max(0, end - LONGEST), end):
            cost, pieces, _ = best[start]
            n = known.get((start, end - start))
            tries.append((cost + (known_cost(n, total) if n else unknown_cost(end - start, total)), pieces + 1, start))
        best.append(min(tries))
    out, end = [], len(name)
    while end:
        start = best[end][2]
        out.append(name[start:end])
        end = start
    return out[::-1]


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words) for a table of distinct names and a checkpointed one of (word, n)."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    short = names.where(F.length("name").between(2, LONGEST_NAME))
    pieces = short.select("name", F.expr("explode(sequence(1, length(name) - 1))").alias("i"))
    pieces = pieces.select("name", "i", F.expr(f"explode(sequence(2, least({LONGEST}, length(name) - i + 1)))").alias("length"))
    pieces = pieces.select("name", (F.col("i") - 1).alias("start"), "length", F.expr("substring(name, i, length)").alias("word"))
    found = join_per_key(pieces, words, "word", "inner").groupBy("name").agg(F.collect_list(F.struct("start", "length", "n")).alias("known"))  # LONGEST x LONGEST_NAME at most
    table = names.join(found, "name", "left")

    @F.pandas_udf("array<string>")
    def split(name, known):
        import pandas as pd

        return pd.Series([[x] if len(x) > LONGEST_NAME else viterbi(x, {(k["start"], k["length"]): k["n"] for k in ([] if ks is None else ks)}, total) for x, ks in zip(name, known)])

    return table.select("name", split("name", "known").alias("words"))
