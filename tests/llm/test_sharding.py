import zlib
from collections import defaultdict

import pytest

from umbra.llm.sharding import shard_by_bytes, shard_cuts


def expected(rows, n):
    rows = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    total, at, slots, out = sum(r[1] for r in rows), 0, defaultdict(int), []
    for r in rows:
        shard = min(n - 1, n * (2 * at + r[1]) // (2 * total))
        out.append((*r, at, shard, slots[shard]))
        slots[shard] += 1
        at += r[1]
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 3, 8])
def test_odd_rows(odd, n):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in shard_by_bytes(odd, n).select("doc_id", "size", "text_crc32", "position", "shard", "slot").collect()), key=str) == expected(rows, n)


def test_one_id_for_a_third(spark):
    rows = [(i if i % 3 else 7, f"t{i % 5}" * (i % 11)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = shard_by_bytes(df, 8)
    assert sorted((tuple(r) for r in got.select("doc_id", "size", "text_crc32", "position", "shard", "slot").collect()), key=str) == expected(rows, 8)
    cuts = shard_cuts(got).collect()
    assert sum(c.n_rows for c in cuts) == 900 and max(c.n_bytes for c in cuts) - min(c.n_bytes for c in cuts) < 60


def test_empty(none):
    assert shard_by_bytes(none, 8).count() == 0


def test_needs_a_shard(odd):
    with pytest.raises(ValueError):
        shard_by_bytes(odd, 0)
