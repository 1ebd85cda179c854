"""SentencePiece encoding and decoding, with a parallel scan over giant documents.

The model here is a BPE model.  A sequence of its pieces is the encoding of a text
exactly when the encoding of every two neighbours is those two pieces, so encodings
are paths, and whether a path goes on past a point depends on one piece only.  A giant
document's normalised text is cut every ``chunk`` characters.  The state at a cut is
the piece that covers the character before it.  A chunk's transfer matrix has for each
state at its left cut and each at its right cut the best (here: the only) path's value
in the max-plus semiring, minus the number of ids, or minus infinity where there is no
path.  Matrices multiply associatively: groups of FAN chunks, then of groups, are
combined in a tree and the states handed down again, after which every chunk knows its
states and the place of its first id and is traced back on its own.

Pieces never join what stands before a word start (a space mark after another
character) with what follows, so a chunk's matrix is that of its first and last cut
words, with whole words between; whole words are encoded by the library and kept.
Documents below ``giant`` characters are encoded word by word in one narrow step.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import arrow_batches, cut, inputs, join_per_key

SPACE = "▁"
#: Characters from which a text is scanned in chunks, and of a chunk.
GIANT, CHUNK = 1 << 15, 1 << 13
FAN = 64
CACHE_WORDS = 250_000
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
NONE = float("-inf")


class Pieces:
    """The model: whole texts by kept words, and paths of pieces between two cuts."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.sp = sp = SentencePieceProcessor(model_proto=model)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)
        self.rank = {sp.id_to_piece(i): (-sp.get_score(i), i) for i in range(sp.get_piece_size()) if not special(i)}
        self.limit = max(map(len, self.rank))
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece of this model goes on past a word start")
        self._kept: dict[str, bytes] = {}
        self.merged = lru_cache(1 << 17)(self._merged)
        self.follows = lru_cache(1 << 18)(lambda a, b: self.merged(a + b) == (a, b))

    def words(self, normal: str) -> bytes:
        """The ids of a normalised text from one word start to another, as little-endian uint32."""
        import numpy as np

        kept = self._kept
        units = _WORD.findall(normal)
        new = {u for u in units if u not in kept}
        if new and len(kept) + len(new) > CACHE_WORDS:
            kept.clear()
            new = set(units)
        for u in new:
            ids = self.sp.encode(u[1:].replace(SPACE, " ")) if len(u) > 1 else self.ids(u)
            kept[u] = np.array(ids, dtype="<u4").tobytes()
        return b"".join([kept[u] for u in units])

    def encode(self, text: str | None) -> bytes:
        return self.words(SPACE + text.replace(" ", SPACE)) if text else b""

    def decode(self, ids: bytes) -> str:
        import numpy as np

        return self.sp.decode(np.frombuffer(ids, "<u4").tolist())

    def _merged(self, s: str) -> tuple[str, ...]:
        """The pieces of a short string: the best-ranked neighbours are joined, leftmost first."""
        parts = list(s)
        while len(parts) > 1:
            best = min(((self.rank[a + b][0], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return tuple(parts)

    def ids(self, piece: str) -> list[int]:
        if piece in self.rank:
            return [self.rank[piece][1]]
        return [self.sp.piece_to_id(f"<0x{b:02X}>") for b in piece.encode("utf-8")]

    def _is_piece(self, s: str) -> bool:
        return len(s) == 1 or (s in self.rank and self.merged(s) == (s,))

    def states(self, x: str, at: int, edge: bool) -> list[tuple[int, int]]:
        """The pieces (start, end) that cover the character before ``at``; one free state at a word start or edge."""
        if edge or starts_word(x, at):
            return [(at, at)]
        return [
            (a, b)
            for a in range(max(0, at - self.limit), at)
            for b in range(at, min(len(x), a + self.limit) + 1)
            if self._is_piece(x[a:b])
        ]

    def paths(self, x: str, sources: dict, stop: int, trace: bool = False):
        """Values of the pieces that reach over ``stop`` from ``sources``: {piece: vector}, and their predecessors."""
        import numpy as np

        value, back, ends = dict(sources), {}, {}
        for node in sources:
            ends.setdefault(node[1], []).append(node)
        out = {node: v for node, v in sources.items() if node[1] >= stop}
        at = min(ends, default=stop)
        while at < stop:
            nodes = ends.pop(at, ())
            if nodes:
                free = starts_word(x, at)
                for b in range(at + 1, min(len(x), at + self.limit) + 1):
                    piece = x[at:b]
                    if not self._is_piece(piece):
                        continue
                    for node in nodes:
                        if free or node[0] == node[1] or self.follows(x[node[0] : node[1]], piece):
                            to = (at, b)
                            v = value[node] - len(self.ids(piece))
                            if to not in value:
                                value[to] = v
                                (out if b >= stop else {})[to] = v
                                ends.setdefault(b, []).append(to)
                            else:
                                value[to] = np.maximum(value[to], v)
                                if b >= stop:
                                    out[to] = value[to]
                            if trace:
                                back[to] = node
            at += 1
        return out, back

    def _cuts(self, x: str, a: int, b: int) -> tuple[int, int] | None:
        """The first and last word start between two cuts."""
        first = next((i for i in range(a, b) if starts_word(x, i)), None)
        return None if first is None else (first, next(i for i in range(b - 1, a - 1, -1) if starts_word(x, i)))

    def transfer(self, x: str, a: int, b: int, first: bool, last: bool):
        """The max-plus matrix from the states at ``a`` to those at ``b`` of the context ``x``."""
        import numpy as np

        left, right = self.states(x, a, first), self.states(x, b, last)
        one = np.full((len(left), len(left)), NONE)
        np.fill_diagonal(one, 0.0)
        sources = dict(zip(left, one))
        cuts = self._cuts(x, a, b)
        if cuts is None:
            out, _ = self.paths(x, sources, b)
            return self._columns(out, right, len(left))
        out, _ = self.paths(x, sources, cuts[0])
        to_word = np.max(list(out.values()), axis=0) - len(self.words(x[cuts[0] : cuts[1]])) // 4
        out, _ = self.paths(x, {(cuts[1], cuts[1]): np.zeros(1)}, b)
        return to_word[:, None] + self._columns(out, right, 1)

    @staticmethod
    def _columns(out, right, n):
        import numpy as np

        if len(right) == 1 and right[0][0] == right[0][1]:  # a free state: any piece may end here
            ended = [v for node, v in out.items() if node[1] == right[0][0]]
            return (np.max(ended, axis=0) if ended else np.full(n, NONE))[:, None]
        return np.column_stack([out.get(node, np.full(n, NONE)) for node in right])

    def trace(self, x: str, a: int, b: int, first: bool, last: bool, enter: int, leave: int) -> bytes:
        """The ids after the piece ``enter`` up to and with the piece ``leave``."""
        import numpy as np

        start, end = self.states(x, a, first)[enter], self.states(x, b, last)[leave]
        cuts = self._cuts(x, a, b)
        if cuts is None:
            return self._trace(x, start, end, b)
        whole = self.words(x[cuts[0] : cuts[1]])
        head = self._trace(x, start, (cuts[0], cuts[0]), cuts[0])
        return head + whole + self._trace(x, (cuts[1], cuts[1]), end, b)

    def _trace(self, x, start, end, stop) -> bytes:
        import numpy as np

        out, back = self.paths(x, {start: np.zeros(1)}, stop, trace=True)
        node = end if end[0] < end[1] else next(n for n in out if n[1] == stop)
        pieces = []
        while node != start:
            pieces.append(node)
            node = back[node]
        return np.array([i for s, e in reversed(pieces) for i in self.ids(x[s:e])], dtype="<u4").tobytes()


@lru_cache(maxsize=1)
def loaded(model: bytes) -> Pieces:
    """One for all tasks of a worker."""
    return Pieces(model)


def starts_word(x: str, at: int) -> bool:
    return 0 < at < len(x) and x[at] == SPACE and x[at - 1] != SPACE


def max_plus(a, b):
    """The product of two max-plus matrices."""
    import numpy as np

    return np.max(a[:, :, None] + b[None, :, :], axis=1)


def hand_down(matrices: list, enter: int, leave: int) -> list[tuple[int, int, int]]:
    """(enter, leave, ids before) of each of a row of matrices, the outer states given."""
    import numpy as np

    rows, values = [], matrices[0][enter]
    rows.append(values)
    for m in matrices[1:]:
        values = np.max(values[:, None] + m, axis=0)
        rows.append(values)
    states = [leave]
    for i in range(len(matrices) - 1, 0, -1):
        states.append(int(np.argmax(rows[i - 1] + matrices[i][:, states[-1]])))
    states = [enter, *reversed(states)]
    before = [0, *(-int(rows[i][states[i + 1]]) for i in range(len(matrices) - 1))]
    return [(states[i], states[i + 1], before[i]) for i in range(len(matrices))]


def encode(
    df: DataFrame, model_path: str, giant: int = GIANT, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of ``df``: doc_id, text, ids, n_chunks.

    ids are the library's ids of the whole text, little-endian unsigned 32-bit integers
    in one binary value (empty for an empty text, null for a null one).  n_chunks is 0
    for a text encoded whole.  ``model_path`` is read by the driver; executors get its
    content.  Rows with a null id and repeated rows are encoded like any other.
    """
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, 0.5 MB
    rows = inputs(df, doc_id=(id_col, "long"), text=(text_col, "string"))
    giant = max(giant, 1)  # an empty text has no space mark before it

    def whole(iterator):
        import pyarrow as pa

        pieces = loaded(model.value)
        for batch, (texts,) in arrow_batches(iterator, ["text"]):
            ids = pa.array([None if t is None else pieces.encode(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, pa.array([0] * len(texts), pa.int64())], ["doc_id", "text", "ids", "n_chunks"])

    small = rows.where(f"text is null or length(text) < {giant}").mapInArrow(whole, "doc_id long, text string, ids binary, n_chunks long")
    large = rows.where(f"length(text) >= {giant}").withColumn("row", F.monotonically_increasing_id())
    return small.union(_giants(large, model, chunk))


def _giants(rows: DataFrame, model, chunk: int) -> DataFrame:
    context = 64  # characters kept beside a chunk; no piece is longer

    def split(iterator):
        import pyarrow as pa

        names = ["row", "n", "x", "a", "b", "first", "last"]
        for _, (texts, rows) in arrow_batches(iterator, ["text", "row"], 16):
            out = []
            for text, row in zip(texts, rows):
                normal = SPACE + text.replace(" ", SPACE)
                for i, a in enumerate(range(0, len(normal), chunk)):
                    b, low = min(a + chunk, len(normal)), max(0, a - context)
                    out.append((row, i, normal[low : b + context], a - low, b - low, a == 0, b == len(normal)))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def transfers(iterator):
        import pyarrow as pa

        pieces = loaded(model.value)
        for batch, columns in arrow_batches(iterator, ["x", "a", "b", "first", "last"]):
            ms = [pieces.transfer(*r) for r in zip(*columns)]
            made = [pa.array([m.shape[0] for m in ms], pa.int64()), pa.array([m.tobytes() for m in ms], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "height", "m"])

    texts = cut(rows)
    layout = "row long, n long, x string, a int, b int, first boolean, last boolean"
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = cut(texts.mapInArrow(split, layout).repartition(n, "row", "n").mapInArrow(transfers, layout + ", height long, m binary"))
    matrix = lambda height, m: np_matrix(m, height)

    def combined(pdf):
        import pandas as pd

        pdf = pdf.sort_values("n")
        total = None
        for height, m in zip(pdf["height"], pdf["m"]):
            own = matrix(height, m)
            total = own if total is None else max_plus(total, own)
        return pd.DataFrame({"row": [pdf["row"].iat[0]], "n": [pdf["n"].iat[0] // FAN], "height": [total.shape[0]], "m": [total.tobytes()]})

    def handed(pdf):
        import pandas as pd

        pdf = pdf.sort_values("n")
        ms = [matrix(height, m) for height, m in zip(pdf["height"], pdf["m"])]
        rows = hand_down(ms, int(pdf["up_enter"].iat[0]), int(pdf["up_leave"].iat[0]))
        base = int(pdf["up_before"].iat[0])
        return pd.DataFrame({"row": pdf["row"], "n": pdf["n"], "enter": [r[0] for r in rows], "leave": [r[1] for r in rows], "before": [base + r[2] for r in rows]})

    levels = [chunks.select("row", "n", "height", "m")]
    most = chunks.agg(F.max("n")).first()[0] or 0
    while most > 0:
        most //= FAN
        up = levels[-1].withColumn("g", F.expr(f"n div {FAN}")).groupBy("row", "g")
        levels.append(cut(up.applyInPandas(lambda pdf: combined(pdf), "row long, n long, height long, m binary")))
    zero = F.lit(0).cast("long")
    known = levels[-1].select("row", "n", zero.alias("enter"), zero.alias("leave"), zero.alias("before"))
    for level in reversed(levels[:-1]):
        up = known.select("row", F.col("n").alias("g"), *(F.col(c).alias(f"up_{c}") for c in ("enter", "leave", "before")))
        down = level.withColumn("g", F.expr(f"n div {FAN}")).join(up, ["row", "g"]).groupBy("row", "g")
        known = cut(down.applyInPandas(lambda pdf: handed(pdf), "row long, n long, enter long, leave long, before long"))

    def traced(iterator):
        import pyarrow as pa

        pieces = loaded(model.value)
        for batch, columns in arrow_batches(iterator, ["x", "a", "b", "first", "last", "enter", "leave"]):
            ids = pa.array([pieces.trace(*r) for r in zip(*columns)], pa.binary())
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("row", "n", "before")]
            yield pa.RecordBatch.from_arrays([*kept, ids], ["row", "n", "before", "ids"])

    parts = join_per_key(chunks.drop("height", "m"), known, ["row", "n"], "inner").mapInArrow(traced, "row long, n long, before long, ids binary")
    joined = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("before", "n", "ids"))).alias("p"))  # one document's ids
    joined = joined.select("row", F.col("p.ids").alias("p"), F.size("p").cast("long").alias("n_chunks"))
    whole = F.unhex(F.array_join(F.transform("p", F.hex), ""))
    return texts.join(joined, "row").select("doc_id", "text", whole.alias("ids"), "n_chunks")


def np_matrix(m: bytes, height: int):
    import numpy as np

    return np.frombuffer(m, dtype=np.float64).reshape(int(height), -1)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with a column ``decoded``, in place of one of that name: the text of ``ids_col`` (null for null)."""
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())
    df = df.drop("decoded")
    kinds = df.schema.simpleString()

    def run(iterator):
        import pyarrow as pa

        pieces = loaded(model.value)
        for batch, (ids,) in arrow_batches(iterator, [ids_col]):
            out = pa.array([None if i is None else pieces.decode(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "decoded"])

    return df.mapInArrow(run, kinds[len("struct<") : -1] + ",decoded:string")
