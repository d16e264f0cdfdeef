"""Metric tables: per-language best-threshold metrics, metric dictionaries,
unthresholded F1, macro averages, counts and LaTeX strings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spanqa.constants import EXCLUDED_LANGUAGE, LANGUAGES, PRECISION_TARGETS
from spanqa.functions.bytes import f1_of, safe_divide
from spanqa.operators.curve import best_threshold, recall_at_precision


@F.pandas_udf(StringType())
def _one_decimal(v: pd.Series) -> pd.Series:
    # printf-style '%.1f' rounds the exact binary value half-to-even; the JVM
    # formatter rounds half-up, so this small helper formats in Python.
    return v.map(lambda x: None if x is None or x != x else "%.1f" % x)


def latex(f1, p, r) -> Column:
    """K7: ``\\fpr{f1}{p}{r}`` with values x100 and one decimal."""
    def fmt(c):
        return _one_decimal(F.col(c) * 100)
    return F.concat(F.lit("\\fpr{"), fmt(f1), F.lit("}{"), fmt(p), F.lit("}{"), fmt(r), F.lit("}"))


def report_order(languages: list[str] | None = None) -> Column:
    """Position of the language in the fixed report order."""
    languages = languages or LANGUAGES
    return F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("language"))


def per_language(points: DataFrame, eval_langs: DataFrame) -> DataFrame:
    """Best-threshold f1/p/r for every evaluated language and task; a language
    with predictions but no gold examples gets zeros."""
    best = best_threshold(points)
    tasks = F.array(F.lit("passage"), F.lit("minimal"))
    grid = eval_langs.select("language", F.explode(tasks).alias("task"))
    return grid.join(best, ["language", "task"], "left").select(
        "language", "task",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("best_f1", "best_precision", "best_recall", "best_threshold")],
    )


def macro_average(per_lang: DataFrame, excluded: str = EXCLUDED_LANGUAGE) -> DataFrame:
    """Mean of f1, precision, recall over evaluated languages except the
    excluded one, for both tasks; 0 when no language remains."""
    m = per_lang.where(F.col("language") != excluded)
    aggs = []
    for task in ("passage", "minimal"):
        for name, col in (("f1", "best_f1"), ("precision", "best_precision"), ("recall", "best_recall")):
            aggs.append(F.coalesce(F.avg(F.when(F.col("task") == task, F.col(col))), F.lit(0.0))
                        .alias(f"avg_{task}_{name}"))
    aggs.append(F.countDistinct("language").alias("n_languages"))
    out = m.agg(*aggs)
    return out.select(
        "*",
        latex("avg_passage_f1", "avg_passage_precision", "avg_passage_recall").alias("passage_latex"),
        latex("avg_minimal_f1", "avg_minimal_precision", "avg_minimal_recall").alias("minimal_latex"),
    )


def metric_table(points: DataFrame, keys: list[str], targets: list[float] | None = None) -> DataFrame:
    """The metric dictionary per (keys, task) as long rows (metric, value):
    best-threshold f1/precision/recall/threshold and recall/precision at each
    precision target, names prefixed with the task."""
    targets = targets or PRECISION_TARGETS
    best = best_threshold(points, keys + ["task"])
    rap = recall_at_precision(points, keys + ["task"], targets)
    b = best.select(*keys, "task", F.inline(F.array(
        F.struct(F.lit("best-threshold-f1").alias("name"), F.col("best_f1").alias("value")),
        F.struct(F.lit("best-threshold-precision").alias("name"), F.col("best_precision").alias("value")),
        F.struct(F.lit("best-threshold-recall").alias("name"), F.col("best_recall").alias("value")),
        F.struct(F.lit("best-threshold").alias("name"), F.col("best_threshold").alias("value")),
    )))
    # target label as Python formats '{:.2}' (0.5, 0.75, 0.9)
    label = F.regexp_replace(F.format_string("%.2f", "target"), "0$", "")
    r = rap.select(*keys, "task", F.inline(F.array(
        F.struct(F.concat(F.lit("recall-at-precision>="), label).alias("name"), F.col("recall").alias("value")),
        F.struct(F.concat(F.lit("precision-at-precision>="), label).alias("name"), F.col("precision").alias("value")),
    )))
    return b.unionByName(r).select(*keys, F.concat("task", F.lit("-"), "name").alias("metric"), "value")


def unthresholded(stats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A3/A4: n, precision = sum f1 / sum has_pred, recall = sum f1 / sum
    has_gold and their harmonic mean, ignoring scores."""
    keys = keys or ["language", "task"]
    a = stats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("f1").alias("s_f1"),
        F.sum(F.col("has_pred").cast("long")).alias("s_pred"),
        F.sum(F.col("has_gold").cast("long")).alias("s_gold"))
    f1sum = F.round("s_f1", 9)
    return a.select(*keys, "n", safe_divide(f1sum, "s_pred").alias("precision"),
                    safe_divide(f1sum, "s_gold").alias("recall")).withColumn("f1", f1_of("precision", "recall"))
