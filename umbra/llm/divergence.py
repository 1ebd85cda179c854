"""Audit of how the sources of a language differ in their words.

Mergeable radix tries: each task counts the terms of its documents in byte tries, by
language, with a counter for each source in their leaves (``prefix_trie``).  Tries are
cut into subtrees by their first bytes, and the subtrees of a stem meet in one task and
are merged; stems that weigh too much are cut one byte deeper first, over and over, so
a stem's task is bounded whatever the words are.  The merged tries are then walked in
byte order: each walk adds up the divergence of pairs of sources and keeps the best
candidate terms of each, where ties fall to the smaller term by themselves.

All numbers are whole.  p = 1 + floor(10^9 (count + 2) / (N + 2 V)), with N a group's
occurrences of kept terms and V their number in the language; the divergence of two
groups at a term is floor((p - q)^2 / (p + q)).
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.common import arrow_batches, cut, inputs, join_per_key
from umbra.llm.prefix_trie import Trie
from umbra.llm.prefix_trie import common as _common

#: A term is kept in a language with so many documents that have it, or more.
LEAST_DOCS = 10
#: Candidate terms of a group.
TOP = 10
#: Counters that a task holds before it hands on its tries, and that the subtrees of one stem may have together.
FLUSH, HEAVY = 300_000, 400_000
#: Sources of one side of a block of pairs, and cells of a table of terms and sources that a task holds at once.
TILE, CELLS = 512, 1 << 20

_TERMS = bytes.maketrans(
    bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]) + string.ascii_uppercase.encode(), b" " * (0x41 + 6 + 5) + string.ascii_lowercase.encode()
)
_SUBTREES = "lang binary, stem binary, low binary, high binary, n long, sources array<binary>, salted boolean, trie binary"
_KEPT = "lang binary, stem binary, terms array<binary>, sources array<binary>, totals array<long>, at array<long>, source array<long>, count array<long>"
_FOUND = "lang binary, part string, source binary, item binary, value long"


def terms(text: bytes) -> list[bytes]:
    """Runs of letters A-Z, a-z and of bytes beyond ASCII, only A-Z lower-cased."""
    return text.translate(_TERMS).split()


def _rows(lang: bytes, trie: Trie, names: list[bytes], depth: int, salted: bool = False):
    """One _SUBTREES row for each stem of ``depth`` bytes, with the sources that occur in it."""
    for stem, first, end in trie.subtrees(depth):
        data, used = trie.packed(first, end)
        n = int(trie.at[end] - trie.at[first])
        yield {"lang": lang, "stem": stem, "low": trie.keys[first], "high": trie.keys[end - 1], "n": n, "sources": [names[i] for i in used], "salted": salted, "trie": data}


def _batch(rows: list[dict], schema: str):
    import pyarrow as pa

    kinds = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_pylist(rows, pa.schema([(name, kinds[kind]) for name, kind in fields]))


def _batches(rows, schema: str, size: int = 256):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def tries(df: DataFrame, depth: int, flush: int = FLUSH) -> DataFrame:
    """The subtrees of each task's tries; ``df`` has binary columns lang, source and text."""

    def run(iterator):
        docs: dict = defaultdict(Counter)
        found: dict = defaultdict(lambda: defaultdict(Counter))

        def handed_on():
            for lang in docs:
                trie = Trie.counted(docs[lang], list(found[lang].values()))
                yield from _rows(lang, trie, list(found[lang]), depth)
            docs.clear()
            found.clear()

        for _, (langs, sources, texts) in arrow_batches(iterator, ["lang", "source", "text"], rows=64):
            for lang, source, text in zip(langs, sources, texts):
                if words := terms(text):
                    docs[lang].update(set(words))
                    found[lang][source].update(words)
            if sum(len(c) for of in found.values() for c in of.values()) > flush:
                yield from _batches(handed_on(), _SUBTREES)
        yield from _batches(handed_on(), _SUBTREES)

    return df.select("lang", "source", "text").mapInArrow(run, _SUBTREES)


def _unpacked(rows: list[dict]) -> tuple[list[Trie], list[bytes]]:
    """The rows' subtrees with common numbers of sources, and those sources' names."""
    import numpy as np

    names: dict[bytes, int] = {}
    out = []
    for row in rows:
        trie = Trie.unpacked(row["trie"])
        number = np.array([names.setdefault(bytes(s), len(names)) for s in row["sources"]], dtype=np.int64)
        trie.source = number[trie.source] if len(trie.source) else trie.source
        out.append(trie)
    return out, list(names)


def _lighter(rows: DataFrame, heavy: int) -> DataFrame:
    """Until no stem has more than ``heavy`` counters: cut those that do further on; a single term's are summed in parts.

    The next cut lies behind what all terms of a stem start with, a byte in the first
    round, two in the second, then four: chains of terms take few rounds.
    """
    columns, step, done = rows.columns, 1, []

    def deeper(iterator):
        for batch in iterator:
            for row in batch.to_pylist():
                (trie,), names = _unpacked([row])
                yield from _batches(_rows(row["lang"], trie, names, row["depth"]), _SUBTREES)

    def summed(table):
        import pyarrow as pa

        found, names = _unpacked(table.to_pylist())
        lang, stem = table.column("lang")[0].as_py(), table.column("stem")[0].as_py()
        rows = _rows(lang, Trie.merged(found, max(len(names), 1)), names, len(stem), True)
        return pa.Table.from_batches([_batch(list(rows), _SUBTREES)])

    @F.pandas_udf("long")
    def common(low, high):
        import pandas as pd

        return pd.Series([_common(a, b) for a, b in zip(low, high)], dtype="int64")

    while True:
        weights = rows.where("not salted").groupBy("lang", "stem").agg(F.sum("n").alias("weight"), F.min("low").alias("_low"), F.max("high").alias("_high")).where(f"weight > {heavy}")
        weights = cut(weights.select("lang", "stem", "weight", (F.col("_low") == F.col("_high")).alias("single"), (common("_low", "_high") + step).alias("depth")))
        if weights.isEmpty():
            return reduce(DataFrame.union, done, rows)
        told = join_per_key(rows, weights, ["lang", "stem"])
        done.append(told.where("weight is null or salted").select(columns))
        wide = told.where("weight is not null and not salted and not single").select(*columns, "depth").mapInArrow(deeper, _SUBTREES)
        # Counters of one term from very many tasks: parts of them are summed, which leaves one for each source and part.
        part = F.pmod(F.xxhash64("trie", "sources"), F.ceil(F.col("weight") / heavy).cast("long"))
        narrow = told.where("weight is not null and not salted and single").select(*columns, part.alias("_part"))
        narrow = narrow.groupBy("lang", "stem", "_part").applyInArrow(lambda t: summed(t.drop_columns(["_part"])), _SUBTREES)
        rows, step = cut(wide.union(narrow)), 2 * step


def kept_terms(subtrees: DataFrame, least_docs: int) -> DataFrame:
    """_KEPT: the subtrees of each stem merged, with the terms of ``least_docs`` documents or more, and the sources' totals."""

    def merge(table):
        import numpy as np
        import pyarrow as pa

        found, names = _unpacked(table.to_pylist())
        trie = Trie.merged(found, max(len(names), 1), least_docs)
        totals = np.zeros(len(names), dtype=np.int64)
        np.add.at(totals, trie.source, trie.count)
        row = {"lang": table.column("lang")[0].as_py(), "stem": table.column("stem")[0].as_py(), "terms": trie.keys, "sources": names}
        row |= {"totals": totals.tolist(), "at": trie.at.tolist(), "source": trie.source.tolist(), "count": trie.count.tolist()}
        return pa.Table.from_batches([_batch([row] if trie.keys else [], _KEPT)])

    return subtrees.groupBy("lang", "stem").applyInArrow(merge, _KEPT)


def shares(count, total):
    """1 + floor(10^9 (count + 2) / total), exactly: three digits at a time stay within 64 bits."""
    whole, rest = (count + 2) // total, (count + 2) % total
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // total, rest % total
    return whole + 1


def apart(p, q):
    return (p - q) ** 2 // (p + q)


def _walk(iterator, top: int, tile: int, cells: int):
    """Sums for pairs of sources, the smaller named first, and each source's best terms, as far as one task sees."""
    import numpy as np

    sums: dict = {}
    best: dict = defaultdict(list)
    number: dict = {}
    names: dict = {}

    def handed_on():
        for (lang, i, j), s in sums.items():
            a, b = names[lang][i * tile : (i + 1) * tile], names[lang][j * tile : (j + 1) * tile]
            for x, y in zip(*np.nonzero(s)):
                yield {"lang": lang, "part": "pair", "source": min(a[x], b[y]), "item": max(a[x], b[y]), "value": int(s[x, y])}
        sums.clear()

    for batch in iterator:
        for row in batch.to_pylist():
            lang, i, j = row["lang"], row["i"], row["j"]
            if lang not in names:
                names[lang] = row["all_sources"]
                number[lang] = {s: k for k, s in enumerate(names[lang])}
            where = np.array([number[lang][s] for s in row["sources"]], dtype=np.int64)
            at, count, source = np.array(row["at"]), np.array(row["count"], dtype=np.int64), where[np.array(row["source"], dtype=np.int64)]
            total = np.array(row["all_totals"], dtype=np.int64) + 2 * row["v"]
            whole = row["n"] + 2 * row["v"]
            wide = [min(tile, len(total) - k * tile) for k in (i, j)]
            acc = sums.setdefault((lang, i, j), np.zeros(wide, dtype=np.int64))
            step = max(1, cells // max(wide))
            for lo in range(0, len(row["terms"]), step):
                hi = min(lo + step, len(row["terms"]))
                a, b = at[lo], at[hi]
                term = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                counts = []
                for k, w in zip((i, j), wide):
                    mine = (source[a:b] >= k * tile) & (source[a:b] < k * tile + w)
                    c = np.zeros((hi - lo, w), dtype=np.int64)
                    c[term[mine], source[a:b][mine] - k * tile] = count[a:b][mine]
                    counts.append(c)
                p, q = (shares(c, total[k * tile : k * tile + w]) for c, k, w in zip(counts, (i, j), wide))
                for x in range(wide[0]):
                    y = x + 1 if i == j else 0
                    acc[x, y:] += apart(p[:, x : x + 1], q[:, y:]).sum(axis=0)
                if i != j:
                    continue
                of_lang = np.zeros(hi - lo, dtype=np.int64)
                np.add.at(of_lang, term, count[a:b])
                q = shares(of_lang, whole)
                for x in range(wide[0]):
                    found = np.flatnonzero((counts[0][:, x] > 0) & (p[:, x] > q))
                    f = apart(p[found, x], q[found])
                    first = np.argsort(-f, kind="stable")[:top]  # terms stand in byte order: ties are in order already
                    if len(first):
                        mine = best[lang, i * tile + x]
                        best[lang, i * tile + x] = sorted([*mine, *((-int(f[k]), row["terms"][lo + found[k]]) for k in first)])[:top]
            if sum(s.size for s in sums.values()) > 16 * tile * tile:
                yield from _batches(handed_on(), _FOUND, 4096)
    yield from _batches(handed_on(), _FOUND, 4096)
    leaders = ({"lang": lang, "part": "term", "source": names[lang][x], "item": t, "value": -f} for (lang, x), found in best.items() for f, t in found)
    yield from _batches(leaders, _FOUND, 4096)


def audit(
    df: DataFrame,
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    depth: int = 2,
    flush: int = FLUSH,
    heavy: int = HEAVY,
    tile: int = TILE,
    cells: int = CELLS,
) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part "pair": for each source of a language each other source of it, with the
    divergence summed over all kept terms, largest first.  Part "term": the ``top``
    terms that a source has more of than the language as a whole, by divergence from
    it.  Ties go to the smaller item by bytes.

    Null text, language or source is an empty one, which is a group like any other.
    Repeated rows count as often as they stand.  A language without kept terms gives
    pairs of value 0 and no terms; one source alone gives no pairs; an empty table gives
    no rows.  Texts are read as bytes, so none has to be valid.  A language's list of
    sources, with one number each, is held in one row.
    """
    rows = inputs(df, lang=(lang_col, "string"), source=(source_col, "string"), text=(text_col, "string"))
    rows = rows.select(*(F.coalesce(F.col(c), F.lit("")).cast("binary").alias(c) for c in rows.columns))
    groups = cut(rows.select("lang", "source").distinct())
    subtrees = _lighter(cut(tries(rows, depth, flush)), heavy)
    kept = cut(kept_terms(subtrees, least_docs))
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("s")).groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.totals").alias("n"))
    # One row a language: its sources in byte order, with their totals.
    langs = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
    langs = langs.join(kept.groupBy("lang").agg(F.sum(F.size("terms")).alias("v")), "lang", "left")
    langs = cut(langs.select("lang", F.col("s.source").alias("all_sources"), F.col("s.n").alias("all_totals"), F.expr("aggregate(s.n, 0L, (a, b) -> a + b)").alias("n"), F.coalesce("v", F.lit(0)).alias("v")))
    tiles = F.ceil(F.size("all_sources") / tile).cast("long") - 1
    walks = join_per_key(kept, langs, "lang", "inner").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), tiles))).withColumn("j", F.explode(F.sequence("i", tiles)))
    found = cut(walks.mapInArrow(lambda it: _walk(it, top, tile, cells), _FOUND))

    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.union(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = langs.select("lang", F.explode("all_sources").alias("source"), "all_sources").select("lang", "source", F.explode("all_sources").alias("item")).where("source <> item")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    out = pairs.union(found.where("part = 'term'").select(pairs.columns))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = out.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select(F.col("lang").cast("string"), F.col("source").cast("string"), "part", F.col("item").cast("string"), "value", "rank")
