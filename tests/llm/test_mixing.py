"""Mixing: targets against a plain water-filling loop, words taken near their targets, defined odd cases."""

import re

from pyspark.sql import functions as F

from spanqa.llm import mixing


def fill(sizes: dict, weights: dict, budget: float, cap: int) -> dict:
    """Share by weight, clamp, share the rest again."""
    target, free, left = {}, set(sizes), budget
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > cap * sizes[s]}
        if not over:
            return target | {s: weights[s] * level for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_taken(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 2500, "hot").when(F.col("id") < 3900, "mid").when(F.col("id") < 3990, "small").alias("source"),
        F.expr("repeat('w ', cast(1 + id % 13 as int))").alias("text"))
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    weights = {s: w for s, w in zip(sorted(s for s in sizes if s) + [None], (1, 2, 3, 1))}
    expect = fill(sizes, weights, sum(sizes.values()), 3)
    assert {r.source: r.target for r in got} == expect
    for s in sizes:
        taken = sum(r.taken for r in got if r.source == s)
        assert abs(taken - expect[s]) <= 13
    assert all(r.taken == r.size * r.repeats and 0 <= r.repeats <= 3 and r.source_size == sizes[r.source] for r in got)
    again = mixing.mix(docs.repartition(7)).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in got}
    assert {r.doc_id: r.repeats for r in mixing.mix(docs, seed=1).collect()} != {r.doc_id: r.repeats for r in got}


def test_weights_and_budget(spark):
    docs = spark.createDataFrame([(i, "a b c d", s) for i, s in enumerate("xxxyyz")], "doc_id long, text string, source string")
    w = spark.createDataFrame([("x", 1), ("y", 0), ("z", -4)], "source string, weight int")
    got = {r.source: (r.target, r.taken) for r in mixing.mix(docs, w, budget=1000.0).collect()}
    assert got == {"x": (36.0, 12), "y": (0.0, 0), "z": (0.0, 0)}


def test_odd(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert mixing.mix(odd).columns.count("size") == 1
    assert mixing.mix(none).collect() == []
