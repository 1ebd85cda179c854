"""Packing by power-of-two decomposition: every sequence is one piece of one document.

A document of n tokens is cut into floor(n / max_len) pieces of max_len and then into
the binary digits of the rest, largest first.  Every piece has a power of two as its
length, stands in a sequence of its own and needs no padding; sequences of one length
form a bucket, so that a batch drawn from a bucket is dense and no sequence crosses
documents.

Sequence numbers run through the buckets from the longest to the shortest.  A task
numbers its pieces by bucket; the counts of (bucket, task), at most 12 rows a task,
give each task's first number.  No text or token is shuffled.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.common import arrow_batches, cut, inputs, join_per_key, release

#: Encodings that a task keeps, by word; then it starts anew.
CACHE_WORDS = 400_000
#: Marks that are parted from letters before them; letters are taken up to this character, before scripts of which Unicode's versions differ.
MARKS, LETTERS_END = ".,", "\u0530"
#: Characters of text that are encoded at a time.
TEXT_RUN = 1 << 18
#: A single space between two characters that are not white space: byte-level BPE of this
#: vocabulary's pattern never joins what stands before it with what follows from it on.
_GAP = re.compile(r"(?<=\S) (?=\S)")


class WordEncoder:
    """A ``tokenizers`` byte-level BPE whose encodings of space-parted words are kept.

    ``ids(texts)`` are the library's ids of each whole text, as little-endian unsigned
    32-bit integers.  The new words of several texts are encoded in one call and told
    apart by the bytes their ids stand for.
    """

    def __init__(self, tokenizer_json: str):
        import numpy as np
        from tokenizers import Tokenizer

        self._one = one = Tokenizer.from_str(tokenizer_json)
        self._firsts: dict[str, bytes] = {}  # of words that begin a text
        self._kept: dict[str, bytes] = {}  # of words after a space, with that space
        special = {i: len(t.content.encode()) for i, t in one.get_added_tokens_decoder().items()}
        self._marks = {m: self._encode(m).tobytes() for m in MARKS}
        # Byte-level pieces spell each byte as one character.
        self._bytes = np.zeros(max([*one.get_vocab().values(), *special]) + 1, dtype=np.int64)
        for piece, i in one.get_vocab().items():
            self._bytes[i] = special.get(i, len(piece))

    def _encode(self, text: str):
        import numpy as np

        return np.array(self._one.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _keep(self, words: list[str]) -> None:
        """The ids of `` word`` for each word; words are neither empty nor begin or end with white space."""
        import numpy as np

        ids = self._encode("".join([f" {w}" for w in words]))
        ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), dtype=np.int64, count=len(words)))
        stops = (4 * (np.searchsorted(np.cumsum(self._bytes[ids]), ends) + 1)).tolist()
        flat, start = ids.tobytes(), 0
        for w, stop in zip(words, stops):
            self._kept[w] = flat[start:stop]
            start = stop

    def forget(self) -> None:
        self._kept.clear()
        self._firsts.clear()

    def _learn(self, words: set[str]) -> None:
        """Keep ``words``, which are not kept so far; of a word of letters and a mark, the letters' ids and the mark's are its own."""
        kept = self._kept
        stems = {w: w[:-1] for w in words if w[-1] in self._marks and w[:-1].isalpha() and max(w) < LETTERS_END}
        self._keep(list(words.difference(stems).union(stems.values()).difference(kept)))
        for w, stem in stems.items():
            kept[w] = kept[stem] + self._marks[w[-1]]

    def ids(self, texts: list[str]) -> list[bytes]:
        kept, firsts = self._kept, self._firsts
        parts = [t.split(" ") for t in texts]
        heads = [p.pop(0) for p in parts]
        new = set().union(*parts).difference(kept)
        # Only heads and words that are not kept can have white space at an end or be empty: most texts are split as they should be.
        odd = {w for w in new if not w or w[0].isspace() or w[-1].isspace()}
        again = [i for i, (h, p) in enumerate(zip(heads, parts)) if p and (not h or h[-1].isspace()) or not odd.isdisjoint(p)]
        for i in again:
            heads[i], *parts[i] = _GAP.split(texts[i])
        ends = [p.pop() if p and p[-1][-1].isspace() else None for p in parts]  # a text's last word may end in white space
        for h in heads:
            if h not in firsts:
                if len(firsts) >= CACHE_WORDS // 10:
                    firsts.clear()
                firsts[h] = self._encode(h).tobytes() if h else b""
        heads = [firsts[h] if h in firsts else self._encode(h).tobytes() for h in heads]
        if again:
            new = set().union(*parts).difference(kept)
        if new:
            if len(kept) + len(new) > CACHE_WORDS:
                kept.clear()
                new = set().union(*parts)
            self._learn(new)
        ends = [b"" if t is None else self._encode(f" {t}").tobytes() for t in ends]
        return [h + b"".join([kept[w] for w in p]) + t for h, p, t in zip(heads, parts, ends)]


@lru_cache(maxsize=1)
def encoder(tokenizer_json: str) -> WordEncoder:
    """One for all tasks of a worker."""
    return WordEncoder(tokenizer_json)


def runs(texts: list[str], size: int = TEXT_RUN):
    """(from, to) of runs of texts of about ``size`` characters each, at least one text."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def pieces(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens, longest first."""
    out = [(i, max_len) for i in range(0, n - max_len + 1, max_len)]
    at = len(out) * max_len
    bit = max_len >> 1
    while bit:
        if (n - at) & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def pack(
    df: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its ids and then ``end_id``; a null or empty text has that
    one token.  start counts its tokens before the piece, offset is 0: a sequence holds
    one piece.  ids_crc32 is the checksum of the piece's ids, little-endian unsigned
    32-bit; ``with_ids`` also returns them.  Sequence ids are gapless from 0.  Rows with
    a null id and repeated rows are packed like any other.  ``tokenizer_path`` is read
    by the driver; executors get its content.  An empty table gives no rows.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, 2 MB

    def run(iterator):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        words, end = encoder(shared.value), np.uint32(end_id).tobytes()
        task, counts = TaskContext.get().partitionId(), [0] * max_len.bit_length()
        for batch, (docs, texts) in arrow_batches(iterator, ["doc_id", "_t"]):
            texts = [t or "" for t in texts]
            out: list[list] = [[] for _ in range(8)]
            for a, b in runs(texts):
                for doc, ids in zip(docs[a:b], words.ids(texts[a:b])):
                    ids += end
                    n = len(ids) // 4
                    for start, length in pieces(n, max_len):
                        own = ids[4 * start : 4 * (start + length)]
                        bucket = length.bit_length() - 1
                        row = (doc, start, length, zlib.crc32(own), n, counts[bucket], task, np.frombuffer(own, "<u4") if with_ids else None)
                        for column, value in zip(out, row):
                            column.append(value)
                        counts[bucket] += 1
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)
        words.forget()
        release()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_n", "_task", "ids"]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _n long, _task int, ids array<long>"
    rows = inputs(df, doc_id=(id_col, "long"), _t=(text_col, "string")).mapInArrow(run, schema)
    rows = cut(rows if with_ids else rows.drop("ids"))
    order = Window.orderBy(F.desc("length"), "_task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("length", "_task").agg(F.count("*").alias("_c"))
    firsts = firsts.select("length", "_task", F.coalesce(F.sum("_c").over(order), F.lit(0)).alias("_first"))
    out = join_per_key(rows, cut(firsts), ["length", "_task"], "inner")  # 12 rows a task at most
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_first") + F.col("_n")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else [])
    )
