"""E1 - evaluation job: predictions vs. N-way annotated gold, per language.

read gold (S1) -> last-wins + votes (P4-P6) -> read/validate predictions (S2,
P1, P3) -> routed left join (J1, J4, J5) -> per-example stats (A1, A2) ->
threshold curve (W1) -> best threshold and R@P (A5, A6) -> macro average (A8).

Shuffles: gold and predictions are each hash-partitioned once on example_id
(de-duplication) and written, so that their inputs are read once; the curve
pre-aggregates per distinct score before its (blocked) running sum. Document
text never enters a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanqa.constants import (EXCLUDED_LANGUAGE, LANGUAGES, MINIMAL_NON_NULL_THRESHOLD,
                              PASSAGE_NON_NULL_THRESHOLD)
from spanqa.operators import curve, metrics, scoring
from spanqa.operators.joins import landed


@dataclass
class Evaluation:
    gold: DataFrame          # one row per gold example with votes
    pred: DataFrame          # one row per predicted example
    eval_langs: DataFrame    # languages evaluated (predicted and listed)
    stats: DataFrame         # long per-example stats, both tasks
    points: DataFrame        # threshold curve
    per_language: DataFrame  # best-threshold metrics per language and task
    macro: DataFrame         # one-row macro average


def evaluate(gold_raw: DataFrame, pred_norm: DataFrame, languages: list[str] | None = None,
             excluded: str = EXCLUDED_LANGUAGE,
             passage_threshold: int = PASSAGE_NON_NULL_THRESHOLD,
             minimal_threshold: int = MINIMAL_NON_NULL_THRESHOLD,
             validation: str = "fail") -> Evaluation:
    """Language-routed evaluation as the command-line evaluator does it.

    ``gold_raw``: raw examples with ``_ord`` (``readers.read_raw_examples``);
    ``pred_norm``: normalised predictions (``readers.read_predictions``).
    """
    languages = languages or LANGUAGES
    gold = landed(scoring.gold_examples(gold_raw, passage_threshold, minimal_threshold), "gold")[0]
    pred = landed(scoring.prediction_examples(scoring.validate_predictions(pred_norm, validation)), "pred")[0]
    eval_langs = scoring.evaluated_languages(pred, languages)
    # at most len(languages) rows: broadcast semi join keeps gold's partitioning
    gold_eval = gold.join(F.broadcast(eval_langs), "language", "left_semi")
    j = scoring.joined(gold_eval, pred, route_by_language=True)
    stats = scoring.answer_stats(j)
    points = curve.threshold_points(stats)
    per_lang = metrics.per_language(points, eval_langs)
    macro = metrics.macro_average(per_lang, excluded)
    return Evaluation(gold, pred, eval_langs, stats, points, per_lang, macro)


def pooled_stats(gold_raw: DataFrame, pred_norm: DataFrame,
                 passage_threshold: int = PASSAGE_NON_NULL_THRESHOLD,
                 minimal_threshold: int = MINIMAL_NON_NULL_THRESHOLD,
                 validation: str = "fail") -> DataFrame:
    """Stats for the library form of the evaluator: all gold examples, matched
    to predictions by example id alone (no language routing)."""
    gold = scoring.gold_examples(gold_raw, passage_threshold, minimal_threshold)
    pred = scoring.prediction_examples(scoring.validate_predictions(pred_norm, validation))
    j = scoring.joined(gold, pred, route_by_language=False)
    return scoring.answer_stats(j).withColumn("scope", F.lit("all"))


def pooled_metrics(gold_raw: DataFrame, pred_norm: DataFrame, **kw) -> DataFrame:
    """Metric dictionary over all languages pooled: (metric, value)."""
    stats = pooled_stats(gold_raw, pred_norm, **kw)
    points = curve.threshold_points(stats, ["scope", "task"])
    return metrics.metric_table(points, ["scope"]).drop("scope")


def language_report(ev: Evaluation, languages: list[str] | None = None) -> DataFrame:
    """One line per evaluated language and task, in report order."""
    return ev.per_language.select(
        "language", "task", "best_f1", "best_precision", "best_recall", "best_threshold",
        metrics.latex("best_f1", "best_precision", "best_recall").alias("latex"),
        metrics.report_order(languages).alias("report_order"),
    ).orderBy("report_order", F.col("task").desc())


def metrics_json(ev: Evaluation) -> DataFrame:
    """K6: the aggregate metrics as one JSON line."""
    m = ev.macro
    return m.select(F.to_json(F.struct(
        "avg_passage_f1", "avg_passage_recall", "avg_passage_precision",
        "avg_minimal_f1", "avg_minimal_recall", "avg_minimal_precision")).alias("json"))


def write_reports(ev: Evaluation, path: str, languages: list[str] | None = None) -> None:
    """K6: one JSON line per evaluated language and task under ``path``/languages,
    the aggregate metrics as one JSON line under ``path``/metrics."""
    language_report(ev, languages).write.mode("overwrite").json(f"{path}/languages")
    metrics_json(ev).write.mode("overwrite").text(f"{path}/metrics")
