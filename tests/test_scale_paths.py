"""Paths made for scale: the split dimension join and the blocked running sum."""

import json
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from spanqa.operators import curve
from spanqa.operators.joins import join_dimension
from spanqa.plans import queries_prepare as QP
from spanqa.sources import derived, readers

from conftest import SF01


def test_shuffled_join_equals_broadcast_join(spark):
    docs = derived.documents(spark, SF01)
    toks = docs.select("doc_id", F.explode(F.split("text", " ")).alias("token"))
    dim = toks.select("token").distinct().withColumn("n", F.length("token"))
    a = join_dimension(toks, dim, ["token"], name="t-dim-b")                       # broadcast
    b = join_dimension(toks, dim, ["token"], name="t-dim-s", max_broadcast_bytes=0)  # shuffled
    key = ["doc_id", "token", "n"]
    assert a.count() == b.count() == toks.count()
    assert a.select(*key).exceptAll(b.select(*key)).count() == 0


def test_blocked_running_sum(spark):
    pts = spark.createDataFrame([("x", "t", float(i), 1.0, 1, 1) for i in range(1000)],
                                "language string, task string, score double, s_f1 double, s_pred long, s_gold long")
    got = {row.score: row.cum_s_pred for row in
           curve.running_sums_desc(pts, ["language", "task"], "score", ["s_pred"], blocks=16).collect()}
    assert got == {float(i): 1000 - i for i in range(1000)}


def test_curve_with_nulls_and_a_dominant_group(spark):
    """Null scores count as 0.0, a null language is a group, one language holds
    most rows: equal to sums over all rows at or above each threshold."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        lang = "big" if i % 10 else rng.choice(["small", None])
        score = None if i % 37 == 0 else rng.randrange(-40, 400) / 4
        rows.append((lang, "t", rng.random() < 0.7, rng.random() < 0.8, rng.randrange(0, 100) / 64, score))
    df = spark.createDataFrame(rows, "language string, task string, has_gold boolean, has_pred boolean, f1 double, score double")
    got = {(r.language, r.score): (r.precision, r.recall) for r in curve.threshold_points(df).collect()}
    want = {}
    for lang in ("big", "small", None):
        own = [(r[5] or 0.0, r) for r in rows if r[0] == lang]
        gold = sum(r[2] for _, r in own)
        for t in {s for s, _ in own}:
            above = [r for s, r in own if s >= t]
            f1, pred = sum(r[4] for r in above), sum(r[3] for r in above)
            want[lang, t] = (f1 / pred if pred else 0.0, f1 / gold if gold else 0.0)
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k]))
    best = {r.language: r.best_f1 for r in curve.best_threshold(curve.threshold_points(df)).collect()}
    assert best.keys() == {"big", "small", None}


def _goldp_documents(spark, tmp_path, ids):
    rows = [(i, f"first words of {k}\nThe answer of {k} is an éanç, so it is.\nlast one", ("en", "fr", "de", "es")[k % 4])
            for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_goldp_files_grow_with_bytes_not_with_ids(spark, tmp_path, monkeypatch):
    d = _goldp_documents(spark, tmp_path, [k * 1009 for k in range(120)])

    def run(n_bytes):
        monkeypatch.setattr(QP, "_CACHE", {})
        monkeypatch.setattr(QP, "GOLDP_FILE_BYTES", n_bytes)
        paths = QP._goldp_inputs(spark, d)
        files = [[f.read_text() for f in sorted(pathlib.Path(p).rglob("part-*"))] for p in paths]
        per = QP.q_goldp_macro(spark, d)
        assert all("goldp-languages" in f for f in per.inputFiles())  # scored once, not for each part again
        rows = [sorted(map(repr, x.collect())) for x in (
            readers.read_goldp_dataset(spark, paths[0] + "/*"), QP.q_goldp_scan(spark, d), QP.q_goldp_exact_f1(spark, d), per)]
        return files, rows

    (one, rows), (many, same) = run(1 << 20), run(600)
    assert [len(f) for f in one] == [1, 1] and rows == same and len(rows[0]) > 50 and len(rows[1]) > 50
    for files in (one, many):
        assert all(list(json.loads(t)) == ["data", "version"] for t in files[0])
        assert sorted(i for t in files[1] for i in json.loads(t)) == sorted(i for i in json.loads(one[1][0]))
    assert all(1 < len(f) < 60 for f in many)


def test_goldp_ids_that_come_twice_still_fail(spark, tmp_path, monkeypatch):
    d = _goldp_documents(spark, tmp_path, [*range(60), *range(60)])
    monkeypatch.setattr(QP, "GOLDP_FILE_BYTES", 200)
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        QP._goldp_inputs(spark, d)
