"""SimHash: fingerprints and components against brute force, crowded buckets included."""

import random
import re

import xxhash
from pyspark.sql import functions as F

from spanqa.llm import simhash
from spanqa.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, bits=2):
    """ids: [(doc_id, fingerprint)] -> smallest doc_id reachable of each."""
    fps = sorted({f for _, f in ids})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                root[find(b)] = find(a)
    least = {}
    for d, f in ids:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [least.get(find(f)) for _, f in ids]


def test_query_against_brute_force(spark):
    got = QUERIES["op2_simhash"](spark, SF).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(text)
    assert all(int(r.fingerprint, 16) == slow_fingerprint(text[r.doc_id]) and len(r.fingerprint) == 16 for r in got)
    ids = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
    assert slow_components(ids) == [r.component_id for r in got]


def test_links_lose_nothing(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base[:20]:
        for _ in range(30):
            x = b
            for k in rng.sample(range(64), rng.choice((1, 2, 2, 3, 4))):
                x ^= 1 << k
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    m = (1 << 64) - 1
    for bits in (0, 1, 2):
        true = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[i + 1:]
                if ((a ^ b) & m).bit_count() <= bits}
        for bucket in (1, 3, 10_000):  # all crowded, some, none
            edges = {(min(r.u, r.v), max(r.u, r.v)) for r in simhash.links(nodes, bits, bucket=bucket).collect()}
            assert edges <= true
            if bucket == 10_000:
                assert edges == true
            ids = [(i, f & m) for i, f in enumerate(signed)]
            place = {f: i for i, f in enumerate(signed)}
            root = list(range(len(signed)))

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x
            for u, v in edges:
                a, b = sorted((find(place[u]), find(place[v])))
                root[b] = a
            least = {}
            for i in range(len(signed)):
                least[find(i)] = min(i, least.get(find(i), i))
            assert [least[find(i)] for i in range(len(signed))] == slow_components(ids, bits)


def test_keep_one(spark, odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    # 1, 2 and 3 have no words (fingerprint zero); both rows of 5 and the first of 6 are copies
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6] and ids.count(None) == 1
    assert simhash.keep_one(none).collect() == [] and simhash.near_duplicates(none).collect() == []
    rows = simhash.near_duplicates(odd).select("doc_id", "fp", "component_id").collect()
    assert len(rows) == odd.count()
    assert [r.component_id for r in rows] == slow_components([(r.doc_id, r.fp & ((1 << 64) - 1)) for r in rows])


def test_keep_one_by_component(spark):
    """Unlinked texts stay, with null ids or under one id; within a component the smallest id stays."""
    rows = [(None, "alpha beta gamma delta"), (None, "one two three four five"), (None, "one two three four five"),
            (7, "red green blue yellow"), (7, "north south east west"), (8, "north south east west"), (9, "alpha beta gamma delta")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [
        (0, "one two three four five"), (7, "north south east west"), (7, "red green blue yellow"), (9, "alpha beta gamma delta")]


def test_components(spark):
    from spanqa.llm.common import connected_components
    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(149, 200), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in [*range(100, 150), 200]}
    assert connected_components(spark.createDataFrame([], "u long, v long")).select(F.count("*")).first()[0] == 0


def test_rings(spark):
    """Every ring finds all pairs by pigeonring alone, and rings grow with the table, not with its crowded buckets."""
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for b in list(fps)[:30]:
        for _ in range(12):
            x = b
            for k in rng.sample(range(64), rng.choice((1, 2, 2, 3))):
                x ^= 1 << k
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    m = (1 << 64) - 1
    true = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & m).bit_count() <= 2}
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    for segments in (7, 9, 13, 21):
        got = [(min(r.u, r.v), max(r.u, r.v)) for r in simhash.links(nodes, 2, segments, bucket=10_000).collect()]
        assert set(got) == true
    sizes = [10, 10**6, 10**8, 10**9, 3 * 10**9, 10**10]
    rings = [simhash.ring_for(n) for n in sizes]
    assert rings == sorted(rings) and rings[0] == simhash.SEGMENTS and rings[-1] > simhash.SEGMENTS
    for n, r in zip(sizes[:-1], rings):
        assert n / 2 ** simhash.key_bits(r) <= simhash.BUCKET / 8
