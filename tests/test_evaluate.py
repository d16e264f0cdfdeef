"""Evaluator goldens (reference unit-test values and hand-worked curves)."""

import pytest
from pyspark.sql import functions as F

from spanqa.functions.spans import is_null_span, partial_match, span_error
from spanqa.operators import curve, scoring
from spanqa.plans import evaluate as E
from spanqa.session import work_path
from spanqa.sources import derived, readers

from conftest import SF01


def _raw(spark, rows):
    """rows: (example_id, language, [(ci, s, e, yn), ...])"""
    data = [
        (eid, lang, [(None, (ci,), (s, e), yn) for ci, s, e, yn in anns])
        for eid, lang, anns in rows
    ]
    df = spark.createDataFrame(data, "example_id long, language string, annotations array<struct<"
                                     "annotation_id: decimal(20,0), passage_answer: struct<candidate_index: long>, "
                                     "minimal_answer: struct<plaintext_start_byte: long, plaintext_end_byte: long>, "
                                     "yes_no_answer: string>>")
    return derived.with_scan_ordinal(df)


def _pred(spark, rows):
    """rows: (example_id, language, ci, s, e, yn, score)"""
    df = spark.createDataFrame(rows, "example_id long, language string, passage_answer_index long, "
                                     "s long, e long, yes_no_answer string, sc double").selectExpr(
        "example_id", "language", "passage_answer_index", "sc AS passage_answer_score",
        "named_struct('start_byte_offset', s, 'end_byte_offset', e) AS minimal_answer",
        "sc AS minimal_answer_score", "yes_no_answer")
    return readers.normalize_predictions(derived.with_scan_ordinal(df))


def test_span_validity(spark):
    df = spark.createDataFrame([(-1, 1), (1, -1), (-1, -1), (0, 1), (5, 2)], "s long, e long")
    out = df.select(span_error("s", "e").alias("err"), is_null_span("s", "e").alias("null")).collect()
    assert [r.err is not None for r in out] == [True, True, False, False, True]
    assert [r.null for r in out] == [False, False, True, False, False]


@pytest.mark.parametrize("gold,pred,p,r", [
    ((100, 102), (100, 102), 1, 1), ((100, 102), (78, 100), 0, 0), ((1, 42), (78, 100), 0, 0),
    ((100, 102), (100, 104), 0.5, 1), ((90, 104), (100, 112), 4 / 12, 4 / 14),
    ((101, 102), (100, 104), 0.25, 1), ((100, 104), (101, 102), 1, 0.25),
])
def test_partial_match(spark, gold, pred, p, r):
    df = spark.createDataFrame([(*gold, *pred)], "gs long, ge long, ps long, pe long")
    m = df.select(partial_match("gs", "ge", "ps", "pe").alias("m")).first().m
    assert m.precision == pytest.approx(p) and m.recall == pytest.approx(r)


def test_zero_length_inside_gives_zero(spark):
    df = spark.createDataFrame([(3, 8, 5, 5)], "gs long, ge long, ps long, pe long")
    m = df.select(partial_match("gs", "ge", "ps", "pe").alias("m")).first().m
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)


def _stats(spark, gold_rows, pred_rows, thr=1):
    gold = scoring.gold_examples(_raw(spark, gold_rows), thr, thr)
    pred = scoring.prediction_examples(_pred(spark, pred_rows))
    return scoring.joined(gold, pred)


def test_passage_match(spark):
    none = (-1, -1, "NONE")
    j = _stats(spark, [(1, "x", [(0, *none), (0, *none), (-1, *none), (-1, *none)]),
                       (2, "x", [(1, *none), (2, *none), (-1, *none)])],
               [(1, "x", 0, -1, -1, "NONE", 1.0), (2, "x", 4, -1, -1, "NONE", 1.0)])
    got = {r.example_id: (r.has_gold, r.has_pred, r.is_correct) for r in scoring.passage_stats(j).collect()}
    assert got == {1: (True, True, True), 2: (True, True, False)}


@pytest.mark.parametrize("n_ann,pred,p,r", [
    (5, (30, 40), 6 / 10, 6 / 16), (5, (30, 34), 0, 0), (5, (39, 50), 1, 1),
    (3, (30, 40), 1 / 10, 1 / 11), (3, (30, 34), 0, 0), (3, (39, 50), 1, 1),
])
def test_minimal_match(spark, n_ann, pred, p, r):
    spans = [(39, 50), (38, 50), (34, 50)] if n_ann == 5 else [(39, 50)]
    anns = [(0, s, e, "NONE") for s, e in spans] + [(0, -1, -1, "NONE")] * (n_ann - len(spans))
    j = _stats(spark, [(7, "x", anns)], [(7, "x", 0, pred[0], pred[1], "NONE", 1.0)])
    row = scoring.minimal_stats(j).first()
    assert row.precision == pytest.approx(p) and row.recall == pytest.approx(r)


def test_minimal_yes_vs_span(spark):
    anns = [(0, 1, 3, "NONE")] + [(0, -1, -1, "NONE")] * 4
    j = _stats(spark, [(8, "x", anns)], [(8, "x", 0, -1, -1, "YES", 1.0)])
    row = scoring.minimal_stats(j).first()
    assert (row.precision, row.recall) == (0.0, 0.0)


def test_hand_worked_curve(spark):
    stats = spark.createDataFrame(
        [(True, True, 1.0, 9.0), (True, True, 0.0, 5.0), (False, True, 0.0, 5.0), (True, True, 1.0, 5.0),
         (True, False, 0.0, 0.0)], "has_gold boolean, has_pred boolean, f1 double, score double"
    ).withColumn("language", F.lit("x")).withColumn("task", F.lit("passage"))
    pts = curve.threshold_points(stats)
    best = curve.best_threshold(pts).first()
    assert (best.best_f1, best.best_precision, best.best_recall, best.best_threshold) == (0.5, 0.5, 0.5, 5.0)
    rap = {r.target: (r.recall, r.precision, r.threshold) for r in curve.recall_at_precision(pts).collect()}
    assert rap == {0.5: (0.5, 0.5, 5.0), 0.75: (0.25, 1.0, 9.0), 0.9: (0.25, 1.0, 9.0)}


def test_no_scored_match(spark):
    stats = spark.createDataFrame([(True, True, 0.0, 3.0)], "has_gold boolean, has_pred boolean, f1 double, "
                                  "score double").withColumn("language", F.lit("x")).withColumn("task", F.lit("m"))
    pts = curve.threshold_points(stats)
    assert tuple(curve.best_threshold(pts).first())[2:] == (0.0, 0.0, 0.0, 0.0)
    assert {(r.recall, r.precision, r.threshold) for r in curve.recall_at_precision(pts).collect()} == {(0, 0, None)}


def test_minimum_slice_sf001(spark):
    docs = derived.documents(spark, SF01)
    gold = derived.with_scan_ordinal(derived.raw_examples(docs))
    pred = readers.normalize_predictions(derived.with_scan_ordinal(derived.predictions(docs)))
    ev = E.evaluate(gold, pred)
    got = {r.language: (round(r.best_f1, 6), round(r.best_precision, 6), round(r.best_recall, 6), r.best_threshold)
           for r in ev.per_language.where("task = 'passage'").collect()}
    assert got == {
        "swahili": (0.512821, 0.487805, 0.540541, 10.375), "english": (0.507801, 0.501401, 0.514368, 10.125),
        "korean": (0.384615, 0.384615, 0.384615, 11.0), "finnish": (0.588957, 0.578313, 0.6, 10.75)}


@pytest.mark.parametrize("row,rule", [
    ((1, "finnish", 0, 9, 3, "none", 1.0, 1.0), "span"), ((1, "finnish", 0, 1, 5, "yes", 1.0, 1.0), "coexist"),
    ((1, "finnish", 0, -1, -1, "maybe", 1.0, 1.0), "yes_no_answer"), ((1, "finnish", 0, 1, 5, "none", None, None), "missing score")])
def test_validation_modes(spark, row, rule):
    schema = ("example_id long, language string, passage_answer_index long, minimal_start_byte long, minimal_end_byte long, "
              "yes_no_answer string, passage_score double, minimal_score double")
    good = (2, "finnish", 0, 1, 5, "none", 1.0, 1.0)
    df = spark.createDataFrame([row, good], schema)
    with pytest.raises(Exception, match="invalid prediction 1: "):
        scoring.validate_predictions(df).count()
    with pytest.raises(Exception, match="invalid prediction 1: "):
        scoring.validate_predictions(df).groupBy("language").count().collect()
    assert [r.example_id for r in scoring.validate_predictions(df, "drop").collect()] == [2]
    kept = {r.example_id: r.error for r in scoring.validate_predictions(df, "keep").collect()}
    assert kept[2] is None and kept[1]
    assert scoring.validate_predictions(df.where("example_id = 2")).count() == 1


def test_written_reports(spark):
    raw = _raw(spark, [(1, "finnish", [(0, 1, 5, "NONE")] * 3), (2, "finnish", [(-1, -1, -1, "NONE")] * 3)])
    schema = ("example_id long, language string, passage_answer_index long, minimal_start_byte long, minimal_end_byte long, "
              "yes_no_answer string, passage_score double, minimal_score double, _ord long")
    pred = spark.createDataFrame([(1, "finnish", 0, 1, 5, "none", 2.0, 2.0, 1)], schema)
    ev = E.evaluate(raw, pred)
    out = work_path(spark, "t-reports")
    E.write_reports(ev, out)
    rows = spark.read.json(f"{out}/languages").collect()
    assert {(r.language, r.task, r.best_f1) for r in rows} == {("finnish", "passage", 1.0), ("finnish", "minimal", 1.0)}
    total = spark.read.json(f"{out}/metrics").collect()
    assert len(total) == 1 and total[0].avg_passage_f1 == 1.0
