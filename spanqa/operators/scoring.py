"""Per-example scoring of predictions against N-way annotations.

Gold rows keep their annotations as an array; votes and the match against the
prediction are computed in-row with higher-order functions after a single
equi-join on ``example_id``. Both inputs are de-duplicated with a group-by on
``example_id`` first, so the join reuses that hash partitioning (no extra
exchange), and no annotation is exploded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanqa.constants import MINIMAL_NON_NULL_THRESHOLD, PASSAGE_NON_NULL_THRESHOLD
from spanqa.functions.spans import is_null_span_sql, partial_match_sql, span_error_sql
from spanqa.sources.readers import last_wins

_ANN = (
    "transform(annotations, a -> named_struct("
    "'ci', coalesce(a.passage_answer.candidate_index, -1L), "
    "'s', coalesce(a.minimal_answer.plaintext_start_byte, -1L), "
    "'e', coalesce(a.minimal_answer.plaintext_end_byte, -1L), "
    "'yn', coalesce(lower(a.yes_no_answer), 'none')))"
)


def gold_examples(raw: DataFrame,
                  passage_threshold: int = PASSAGE_NON_NULL_THRESHOLD,
                  minimal_threshold: int = MINIMAL_NON_NULL_THRESHOLD) -> DataFrame:
    """One row per example (last line wins) with annotator votes.

    A gold passage answer exists when at least ``passage_threshold`` annotators
    gave a candidate index >= 0; a gold minimal answer when at least
    ``minimal_threshold`` gave a non-null span or a yes/no answer. An example
    without annotations has neither.
    """
    g = last_wins(raw.select("example_id", "language", "annotations", "_ord"), ["example_id"])
    g = g.selectExpr("example_id", "language", f"{_ANN} AS ann")
    return g.selectExpr(
        "example_id", "language", "ann",
        "size(ann) AS n_ann",
        "size(filter(ann, a -> a.ci >= 0)) AS passage_votes",
        f"size(filter(ann, a -> NOT {is_null_span_sql('a.s', 'a.e')} OR a.yn <> 'none')) AS minimal_votes",
    ).selectExpr(
        "*",
        f"(n_ann > 0 AND passage_votes >= {int(passage_threshold)}) AS gold_has_passage",
        f"(n_ann > 0 AND minimal_votes >= {int(minimal_threshold)}) AS gold_has_minimal",
    )


def prediction_errors(pred: DataFrame) -> DataFrame:
    """Adds ``error``: the first failed validation rule of a prediction, or null
    (P1 span validity, P3 yes/no value and coexistence, Q2 missing scores)."""
    return pred.withColumn("error", F.expr(
        "CASE WHEN yes_no_answer NOT IN ('yes', 'no', 'none') THEN 'invalid yes_no_answer' "
        f"WHEN {span_error_sql('minimal_start_byte', 'minimal_end_byte')} IS NOT NULL "
        f"THEN {span_error_sql('minimal_start_byte', 'minimal_end_byte')} "
        f"WHEN yes_no_answer <> 'none' AND NOT {is_null_span_sql('minimal_start_byte', 'minimal_end_byte')} "
        "THEN 'yes/no and minimal span coexist' "
        "WHEN passage_score IS NULL OR minimal_score IS NULL THEN 'missing score' END"))


def validate_predictions(pred: DataFrame, mode: str = "fail") -> DataFrame:
    """``fail``: the job stops on the first invalid row (reference behaviour);
    ``drop``: invalid rows are removed; ``keep``: the error column is kept."""
    checked = prediction_errors(pred)
    if mode == "fail":
        # raised in a filter: a column that is dropped again would be pruned
        message = F.concat(F.lit("invalid prediction "), F.coalesce(F.col("example_id").cast("string"), F.lit("null")),
                           F.lit(": "), F.col("error"))
        return checked.where(F.when(F.col("error").isNull(), F.lit(True)).otherwise(
            F.raise_error(message).cast("boolean"))).drop("error")
    if mode == "drop":
        return checked.where("error IS NULL").drop("error")
    return checked


def prediction_examples(pred: DataFrame) -> DataFrame:
    """One prediction per example id (a later line overrides an earlier one)."""
    cols = ["example_id", "language", "passage_answer_index", "minimal_start_byte", "minimal_end_byte",
            "yes_no_answer", "passage_score", "minimal_score", "_ord"]
    return last_wins(pred.select(*cols), ["example_id"])


def evaluated_languages(pred: DataFrame, languages: list[str]) -> DataFrame:
    """Languages with at least one prediction, restricted to ``languages``
    (at most len(languages) rows)."""
    return pred.select("language").where(F.col("language").isin(languages)).distinct()


def joined(gold: DataFrame, pred: DataFrame, route_by_language: bool = True) -> DataFrame:
    """Gold left join prediction on example_id.

    With language routing a prediction only counts for the gold example when
    both carry the same language (a misfiled prediction is a missing one).
    """
    p = pred.select(
        "example_id", F.col("language").alias("p_language"),
        F.col("passage_answer_index").alias("p_ci"), F.col("minimal_start_byte").alias("p_s"),
        F.col("minimal_end_byte").alias("p_e"), F.col("yes_no_answer").alias("p_yn"),
        F.col("passage_score").alias("p_passage_score"), F.col("minimal_score").alias("p_minimal_score"),
        F.lit(True).alias("p_row"),
    )
    j = gold.join(p, "example_id", "left")
    matched = F.col("p_row").isNotNull()
    if route_by_language:
        matched = matched & (F.col("p_language") == F.col("language"))
    return j.withColumn("matched", F.coalesce(matched, F.lit(False)))


def _with_passage(j: DataFrame) -> DataFrame:
    return j.selectExpr(
        "*",
        "gold_has_passage AS pa_has_gold",
        "IF(matched, p_ci >= 0, NOT gold_has_passage) AS pa_has_pred",
        "(matched AND gold_has_passage AND p_ci >= 0 AND exists(ann, a -> a.ci >= 0 AND a.ci = p_ci)) AS pa_correct",
        "IF(matched, p_passage_score, 0.0D) AS pa_score",
    )


def _best_minimal_sql(pm: str, spans: str) -> str:
    # Max over (f1, -annotation position): highest f1, earliest annotation on
    # ties; an f1 of 0 never replaces the (0, 0, 0) start value.
    ranked = f"transform({spans}, x -> named_struct('f1', ({pm}).f1, 'neg_i', -x.i, 'm', {pm}))"
    return f"(array_max(filter({ranked}, r -> r.f1 > 0)).m)"


def _with_minimal(j: DataFrame) -> DataFrame:
    pm = partial_match_sql("x.a.s", "x.a.e", "p_s", "p_e")
    pred_has = f"(NOT {is_null_span_sql('p_s', 'p_e')} OR p_yn <> 'none')"
    spans = (
        "filter(transform(ann, (a, i) -> named_struct('a', a, 'i', i)), "
        f"x -> NOT {is_null_span_sql('x.a.s', 'x.a.e')})"
    )
    zero = "named_struct('precision', 0.0D, 'recall', 0.0D, 'f1', 0.0D)"
    one = "named_struct('precision', 1.0D, 'recall', 1.0D, 'f1', 1.0D)"
    return j.selectExpr(
        "*",
        "gold_has_minimal AS mi_has_gold",
        f"IF(matched, {pred_has}, NOT gold_has_minimal) AS mi_has_pred",
        "IF(matched, p_minimal_score, 0.0D) AS mi_score",
        f"CASE WHEN NOT (matched AND gold_has_minimal AND {pred_has}) THEN {zero} "
        f"WHEN p_yn <> 'none' THEN IF(exists(ann, a -> a.yn = p_yn), {one}, {zero}) "
        f"ELSE coalesce({_best_minimal_sql(pm, spans)}, {zero}) END AS mi_m",
    )


def passage_stats(j: DataFrame) -> DataFrame:
    """A1: (has_gold, has_pred, is_correct, score) per gold example; a missing
    prediction counts as has_pred = not has_gold with score 0."""
    return _with_passage(j).selectExpr(
        "example_id", "language", "pa_has_gold AS has_gold", "pa_has_pred AS has_pred",
        "pa_correct AS is_correct", "pa_score AS score")


def minimal_stats(j: DataFrame) -> DataFrame:
    """A2: (has_gold, has_pred, precision, recall, f1, score) per gold example.

    A yes/no prediction scores 1 when any annotator gave the same answer.
    Otherwise the best f1 over the non-null gold spans is kept; on equal f1
    the earlier annotation wins.
    """
    return _with_minimal(j).selectExpr(
        "example_id", "language", "mi_has_gold AS has_gold", "mi_has_pred AS has_pred",
        "mi_m.precision AS precision", "mi_m.recall AS recall", "mi_m.f1 AS f1", "mi_score AS score")


def answer_stats(j: DataFrame) -> DataFrame:
    """Both tasks from one pass over the join, as a long table
    (language, example_id, task, has_gold, has_pred, precision, recall, f1, score)."""
    both = _with_minimal(_with_passage(j))
    return both.selectExpr(
        "language", "example_id",
        "inline(array("
        "named_struct('task', 'passage', 'has_gold', pa_has_gold, 'has_pred', pa_has_pred, "
        "  'precision', IF(pa_correct, 1.0D, 0.0D), 'recall', IF(pa_correct, 1.0D, 0.0D), "
        "  'f1', IF(pa_correct, 1.0D, 0.0D), 'score', pa_score), "
        "named_struct('task', 'minimal', 'has_gold', mi_has_gold, 'has_pred', mi_has_pred, "
        "  'precision', mi_m.precision, 'recall', mi_m.recall, 'f1', mi_m.f1, 'score', mi_score)))",
    )
