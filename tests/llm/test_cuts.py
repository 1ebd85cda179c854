"""What a cut leaves on disk, lists that come in parts, and how many pairs of a group are compared."""

import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from umbra.llm import line_dedup as L
from umbra.llm.common import cut


def test_no_shuffle_file_outlives_its_cut(spark):
    folders = [Path(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f for d in folders for f in d.rglob("shuffle_*")}
    before = files()
    held = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "count"))
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and held.count() == 7


def test_lists_in_parts():
    """Lists over ``most`` come in parts, the others whole, each member once; leads are those of most lists."""
    rng = random.Random(1)
    rows = sorted((k, i, rng.randrange(2)) for k in range(60) for i in rng.sample(range(500), rng.choice((1, 2, 5, 60))) for _ in range(rng.choice((1, 2))))
    want = {}
    for k, i, _ in rows:
        want.setdefault(k, set()).add(i)
    for size in (1, 7, 64, 5000):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("key", "id", "own"), r)) for r in rows[at : at + size]]) for at in range(0, len(rows), size)]
        got = {}
        for (keys, ids, _), crowd in L.whole_lists(batches, ["key", "id", "own"], 16):
            for k in np.unique(keys).tolist():
                assert set(crowd[keys == k].tolist()) == {len(want[k]) > 16}
                if len(want[k]) <= 16:
                    assert k not in got and len(ids[keys == k]) == len(want[k])
                got.setdefault(k, set()).update(ids[keys == k].tolist())
        assert got == want
    keys, ids, often = np.array([1, 1, 1, 4, 4]), np.array([7, 8, 9, 8, 3]), np.array([1, 5, 5, 5, 2])
    assert L.leads_of_lists(keys, ids, often).tolist() == [9, 9, 9, 8, 8]


def test_linked_lines_are_not_compared_again(monkeypatch):
    """Families side by side: their links are found with few comparisons, and all of them."""
    rng, lines, family = random.Random(2), [], []
    for f in range(12):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)]
        for _ in range(40):
            s = list(base)
            for at in rng.sample(range(400), 2):
                s[at] = rng.choice("0123456789")
            lines.append("".join(s))
            family.append(f)
    seen, within = [], L.Lines.within
    monkeypatch.setattr(L.Lines, "within", lambda self, i, j, tau: (seen.append(len(i)), within(self, i, j, tau))[1])
    i, j = L.group_links(lines, np.zeros(len(lines), np.int64), L.PER, np.array(family))
    assert len(i) == 12 * 39 and all(family[a] == family[b] for a, b in zip(i, j))
    assert sum(seen) < 3 * len(lines)  # all pairs: 12 * 780


def test_both_kinds_of_links_take_one_search_for_components(spark, monkeypatch):
    """Each search is many plans that the driver holds."""
    from umbra.llm import near_copies, simhash

    calls, search = [], simhash.connected_components
    for module in (simhash, near_copies):
        monkeypatch.setattr(module, "connected_components", lambda edges: (calls.append(1), search(edges))[1])
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:-1]), "something else here", " ".join(words), None, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, least=0.8).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4, 5: 4} and len(calls) == 1
