import random

import xxhash

from umbra.llm.components import connected_components
from umbra.llm.common import cut
from umbra.llm.simhash import PAIR_LIST, fingerprint, fingerprints, links, near_duplicates

import re


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    v = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return v - (1 << 64) if v >> 63 else v


def classes(values):
    """Brute force: the smallest member each value reaches."""
    root = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for x in root:
            for y in root:
                if bin((x ^ y) & (1 << 64) - 1).count("1") <= 2 and root[y] < root[x]:
                    root[x], changed = root[y], True
    return root


def test_fingerprint_against_the_definition(odd, spark):
    texts = [r.text for r in odd.select("text").collect()] + ["A", "A b", "Éa B  c\x0b d", "a\x1fb c d"]
    assert [fingerprint(t) for t in texts] == [plain(t) for t in texts]
    jvm = spark.sql("select xxhash64('a b c') h").first().h  # Spark's function is the same hash
    assert jvm & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", seed=42)


def test_links_keep_every_connection(spark):
    rng = random.Random(5)
    s = lambda x: x - (1 << 64) if x >> 63 else x
    values = {0, -1}
    for _ in range(6):
        base = rng.getrandbits(64)
        values.add(s(base))
        for _ in range(40):  # chains and crowds
            base ^= 1 << rng.randrange(64)
            base ^= (1 << rng.randrange(64)) if rng.random() < 0.7 else 0b1110000
            values.add(s(base))
    crowd = rng.getrandbits(64)
    values |= {s(crowd ^ (1 << i)) for i in range(0, 16)} | {s(crowd ^ (1 << i) ^ (1 << j)) for i in range(8) for j in range(i)}
    fps = cut(spark.createDataFrame([(v,) for v in values], "fp long"))
    got = {r.node: r.root for r in connected_components(links(fps)).collect()}
    assert {v: got.get(v, v) for v in values} == classes(values)
    assert PAIR_LIST < 44


def test_components_of_chains(spark):
    n = 200
    edges = [(i, i + 1) for i in range(n)] + [(500, 500), (7, 3), (1000, 900), (900, 1000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 900: 900, 1000: 900}


def test_odd_rows(odd):
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(odd).collect()), key=str)
    assert (1, 1) in got and (2, 1) in got and (3, 3) in got and (4, 3) in got and (5, 3) in got
    assert got.count((6, 6)) == 2 and (None, None) in got and len(got) == odd.count()


def test_empty(none):
    assert near_duplicates(none).count() == 0 and fingerprints(none).count() == 0
