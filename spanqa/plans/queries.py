"""Query registry: one callable (spark, sf_dir) -> DataFrame per operator
family of the survey's query table. Every query reads the driver tables (or
rows Spark derives from them) and runs the library's own operators on them.
Computed doubles are rounded to 9 places so that engines summing in another
order still compare equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanqa.constants import LANGUAGES
from spanqa.functions import bytes as B
from spanqa.functions import lang as L
from spanqa.functions import spans as S
from spanqa.functions.spans import is_null_span, nonnull_span_equal, partial_match
from spanqa.operators import curve, entry, metrics, scoring
from spanqa.plans import evaluate as E
from spanqa.session import work_path
from spanqa.sources import derived, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def r9(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


# --------------------------------------------------------------- inputs ---

def _docs(spark, sf_dir):
    return derived.documents(spark, sf_dir)


def _gold_raw(spark, sf_dir):
    return derived.with_scan_ordinal(derived.raw_examples(_docs(spark, sf_dir)))


def _pred_norm(spark, sf_dir):
    return readers.normalize_predictions(derived.with_scan_ordinal(derived.predictions(_docs(spark, sf_dir))))


def _evaluation(spark, sf_dir) -> E.Evaluation:
    return E.evaluate(_gold_raw(spark, sf_dir), _pred_norm(spark, sf_dir), languages=LANGUAGES)


# -------------------------------------------------------- scans / sinks ---

@query
def q_gold_scan(spark, sf_dir):
    """Derived gold written as gzip JSONL, read back, one row per
    annotation (last line wins per example)."""
    path = work_path(spark, "gold-jsonl")
    derived.raw_examples(_docs(spark, sf_dir)).write.option("compression", "gzip").json(path)
    labels = readers.gold_labels(readers.read_raw_examples(spark, path))
    return labels.select("example_id", "language", "ann_pos",
                         F.col("annotation_id").cast("decimal(20,0)").alias("annotation_id"),
                         "passage_answer_index", "minimal_start_byte", "minimal_end_byte", "yes_no_answer")


@query
def q_prediction_scan(spark, sf_dir):
    """Predictions written by the JSONL sink and read back with the
    reader's defaults; ``error`` holds the validation result."""
    path = work_path(spark, "pred-jsonl")
    derived.predictions(_docs(spark, sf_dir)).write.json(path)
    p = scoring.prediction_errors(readers.read_predictions(spark, path))
    return p.select("example_id", "language", "passage_answer_index", "minimal_start_byte", "minimal_end_byte",
                    "yes_no_answer", "passage_score", "minimal_score", "error")


# ------------------------------------------------------- spans / bytes ---

_BROKEN = [  # literal invalid predictions (mixed signs, reversed, yes/no+span, bad value)
    (-1, "english", 0, -1, 1, "NONE"), (-2, "english", 0, 1, -1, "NONE"), (-3, "english", 0, 5, 2, "NONE"),
    (-4, "english", 0, 0, 3, "YES"), (-5, "english", 0, -1, -1, "MAYBE"), (-6, "english", 0, 4, 4, "none"),
]


@query
def q_span_validation(spark, sf_dir):
    """P1, P2, P3 over all derived predictions plus literal broken rows."""
    p = derived.predictions(_docs(spark, sf_dir))
    lit = spark.createDataFrame(_BROKEN, "example_id long, language string, passage_answer_index long, "
                                         "s long, e long, yes_no_answer string").selectExpr(
        "example_id", "language", "passage_answer_index", "1.0D AS passage_answer_score",
        "named_struct('start_byte_offset', s, 'end_byte_offset', e) AS minimal_answer",
        "1.0D AS minimal_answer_score", "yes_no_answer")
    n = readers.normalize_predictions(derived.with_scan_ordinal(p.unionByName(lit)))
    return scoring.prediction_errors(n).select(
        "example_id", "minimal_start_byte", "minimal_end_byte", "yes_no_answer",
        is_null_span("minimal_start_byte", "minimal_end_byte").alias("is_null_span"), "error")


def _gold_pred_pairs(spark, sf_dir):
    labels = readers.gold_labels(_gold_raw(spark, sf_dir))
    pred = _pred_norm(spark, sf_dir).select(
        "example_id", F.col("minimal_start_byte").alias("p_s"), F.col("minimal_end_byte").alias("p_e"))
    return labels.join(pred, "example_id").where(
        "NOT (minimal_start_byte < 0 AND minimal_end_byte < 0) AND NOT (p_s < 0 AND p_e < 0)")


@query
def q_span_overlap(spark, sf_dir):
    """byte-overlap precision/recall/f1 of every non-null gold span
    against the non-null predicted span of the same example."""
    pairs = _gold_pred_pairs(spark, sf_dir).withColumn(
        "m", partial_match("minimal_start_byte", "minimal_end_byte", "p_s", "p_e"))
    return pairs.select("example_id", "ann_pos", r9("m.precision").alias("precision"),
                        r9("m.recall").alias("recall"), r9("m.f1").alias("f1"))


@query
def q_span_equal(spark, sf_dir):
    """exact equality of non-null gold and predicted spans."""
    pairs = _gold_pred_pairs(spark, sf_dir)
    return pairs.select("example_id", "ann_pos",
                        nonnull_span_equal("minimal_start_byte", "minimal_end_byte", "p_s", "p_e").alias("equal"))


@query
def q_byte_profile(spark, sf_dir):
    """F1, F2, F3 over every document: byte and character lengths, bytes of the
    first paragraph and its text recovered by a byte slice."""
    d = _docs(spark, sf_dir)
    first_len = B.byte_len(F.substring_index("text", "\n", 1))
    return d.select(
        "doc_id", "lang",
        B.byte_len("text").alias("n_bytes"), F.char_length("text").alias("n_chars"),
        F.octet_length(B.utf8("text")).alias("n_encoded"),
        first_len.alias("first_par_bytes"),
        (B.byte_slice("text", F.lit(0), first_len) == F.substring_index("text", "\n", 1)).alias("slice_ok"),
    )


@query
def q_candidate_text(spark, sf_dir):
    """Text of the annotated candidate and of the gold minimal
    answer, both cut from the document by byte offsets."""
    g = _gold_raw(spark, sf_dir)
    a = g.select("example_id", "document_plaintext", "passage_answer_candidates",
                 F.posexplode("annotations").alias("ann_pos", "a")).where("a.passage_answer.candidate_index >= 0")
    c = F.get(F.col("passage_answer_candidates"), F.col("a.passage_answer.candidate_index").cast("int"))
    return a.select(
        "example_id", "ann_pos", F.col("a.passage_answer.candidate_index").alias("candidate_index"),
        c.plaintext_start_byte.alias("cand_start"), c.plaintext_end_byte.alias("cand_end"),
        B.byte_slice("document_plaintext", c.plaintext_start_byte, c.plaintext_end_byte).alias("cand_text"),
        (c.plaintext_end_byte - c.plaintext_start_byte).alias("n_positions"),
        F.when(F.col("a.minimal_answer.plaintext_start_byte") >= 0,
               B.byte_slice("document_plaintext", F.col("a.minimal_answer.plaintext_start_byte"),
                            F.col("a.minimal_answer.plaintext_end_byte"))).alias("answer_text"),
    )


@query
def q_candidate_positions(spark, sf_dir):
    """byte positions of the annotated candidate, the one before it and the gold minimal answer, as merged
    segments and one by one; an annotation of a missing candidate would fail."""
    a = _gold_raw(spark, sf_dir).select("example_id", "document_plaintext", "passage_answer_candidates",
                                        F.posexplode("annotations").alias("ann_pos", "a")).where(
        "a.passage_answer.candidate_index >= 0").withColumn("i", F.col("a.passage_answer.candidate_index"))
    a = entry.candidate_text(a, "i")
    before = F.get("passage_answer_candidates", F.greatest(F.col("i") - 1, F.lit(0)).cast("int"))

    def segment(s, e):
        return F.struct(s.alias("start"), e.alias("end"))

    m = a.withColumn("segments", S.merge_segments(F.array(
        F.col("cand"), segment(before.plaintext_start_byte, before.plaintext_end_byte),
        segment(F.col("a.minimal_answer.plaintext_start_byte"), F.col("a.minimal_answer.plaintext_end_byte")))))
    positions = S.segment_positions(F.col("segments"))
    return m.select("example_id", "ann_pos", F.size("segments").alias("n_segments"), F.size(positions).alias("n_positions"),
                    F.md5(F.array_join(positions.cast("array<string>"), ",")).alias("positions_md5"))


@query
def q_local_offsets(spark, sf_dir):
    """gold minimal spans as offsets inside their candidate passage."""
    g = _gold_raw(spark, sf_dir)
    a = g.select("example_id", "passage_answer_candidates",
                 F.posexplode("annotations").alias("ann_pos", "a")).where(
        "a.passage_answer.candidate_index >= 0 AND a.minimal_answer.plaintext_start_byte >= 0")
    c = F.get(F.col("passage_answer_candidates"), F.col("a.passage_answer.candidate_index").cast("int"))
    return a.select("example_id", "ann_pos",
                    (F.col("a.minimal_answer.plaintext_start_byte") - c.plaintext_start_byte).alias("local_start"),
                    (F.col("a.minimal_answer.plaintext_end_byte") - c.plaintext_start_byte).alias("local_end"))


@query
def q_lang_dim(spark, sf_dir):
    """language name -> id -> name over the derived examples."""
    g = _gold_raw(spark, sf_dir)
    per = g.groupBy("language").agg(F.count(F.lit(1)).alias("n_examples"))
    return per.select("language", L.language_id_strict(F.upper("language")).alias("language_id"),
                      L.language_name(L.language_id("language")).alias("name_back"), "n_examples")


# ------------------------------------------------------------- votes ---

@query
def q_vote_passage(spark, sf_dir):
    """Passage-answer votes per gold example (threshold 2)."""
    g = scoring.gold_examples(_gold_raw(spark, sf_dir))
    return g.select("example_id", "language", "n_ann", "passage_votes", "gold_has_passage")


@query
def q_vote_minimal(spark, sf_dir):
    """Minimal-answer votes per gold example (threshold 2)."""
    g = scoring.gold_examples(_gold_raw(spark, sf_dir))
    return g.select("example_id", "language", "minimal_votes", "gold_has_minimal")


@query
def q_gold_counts(spark, sf_dir):
    """Gold and prediction totals and gold examples with answers."""
    g = scoring.gold_examples(_gold_raw(spark, sf_dir)).select(
        F.lit(True).alias("is_gold"), "gold_has_minimal", "gold_has_passage")
    p = scoring.prediction_examples(_pred_norm(spark, sf_dir)).select(
        F.lit(False).alias("is_gold"), F.lit(False).alias("gold_has_minimal"), F.lit(False).alias("gold_has_passage"))
    return g.unionByName(p).agg(
        F.count_if("is_gold").alias("n_gold"), F.count_if(~F.col("is_gold")).alias("n_pred"),
        F.count_if("gold_has_minimal").alias("n_gold_minimal"), F.count_if("gold_has_passage").alias("n_gold_passage"))


# ----------------------------------------------------------- matching ---

@query
def q_passage_match(spark, sf_dir):
    """Passage stats of every gold example of an evaluated language."""
    ev = _evaluation(spark, sf_dir)
    s = ev.stats.where("task = 'passage'")
    return s.select("example_id", "language", "has_gold", "has_pred", (F.col("f1") > 0).alias("is_correct"),
                    r9("score").alias("score"))


@query
def q_minimal_match(spark, sf_dir):
    """Minimal-answer stats (best annotator match) per gold example."""
    ev = _evaluation(spark, sf_dir)
    s = ev.stats.where("task = 'minimal'")
    return s.select("example_id", "language", "has_gold", "has_pred", r9("precision").alias("precision"),
                    r9("recall").alias("recall"), r9("f1").alias("f1"), r9("score").alias("score"))


def _routed_ids(spark, sf_dir):
    ev = _evaluation(spark, sf_dir)
    g = ev.gold.join(F.broadcast(ev.eval_langs), "language", "left_semi").select("language", "example_id")
    p = ev.pred.join(F.broadcast(ev.eval_langs), "language", "left_semi").select("language", "example_id")
    return g, p


@query
def q_unpredicted_ids(spark, sf_dir):
    """Gold examples without a prediction filed under their language."""
    g, p = _routed_ids(spark, sf_dir)
    return g.join(p, ["language", "example_id"], "left_anti").orderBy("language", "example_id")


@query
def q_unexpected_ids(spark, sf_dir):
    """Predictions without a gold example in their language."""
    g, p = _routed_ids(spark, sf_dir)
    return p.join(g, ["language", "example_id"], "left_anti").orderBy("language", "example_id")


@query
def q_lang_routing(spark, sf_dir):
    """Per language, gold and prediction counts, routed matches and
    whether the language is evaluated, in report order."""
    ev = _evaluation(spark, sf_dir)
    g = ev.gold.groupBy("language").agg(F.count(F.lit(1)).alias("n_gold"))
    p = ev.pred.groupBy("language").agg(F.count(F.lit(1)).alias("n_pred"))
    m = (ev.gold.select("example_id", "language")
         .join(ev.pred.select("example_id", "language"), ["example_id", "language"])
         .groupBy("language").agg(F.count(F.lit(1)).alias("n_matched")))
    out = g.join(p, "language", "full").join(m, "language", "left")
    return out.select(
        "language", F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"),
        F.coalesce("n_matched", F.lit(0)).alias("n_matched"),
        (F.col("n_pred").isNotNull() & F.col("language").isin(LANGUAGES)).alias("evaluated"),
        metrics.report_order().alias("report_order"),
    ).orderBy("report_order")


# -------------------------------------------------------------- curve ---

@query
def q_pr_curve(spark, sf_dir):
    """precision/recall/f1 at every distinct score, both tasks."""
    ev = _evaluation(spark, sf_dir)
    return ev.points.select("language", "task", "score", r9("precision").alias("precision"),
                            r9("recall").alias("recall"), r9("f1").alias("f1"))


@query
def q_best_threshold(spark, sf_dir):
    """A5: best-threshold metrics per evaluated language and task."""
    ev = _evaluation(spark, sf_dir)
    return ev.per_language.select("language", "task", r9("best_f1").alias("best_f1"),
                                  r9("best_precision").alias("best_precision"),
                                  r9("best_recall").alias("best_recall"), "best_threshold")


@query
def q_recall_at_precision(spark, sf_dir):
    """Recall at precision >= 0.5 / 0.75 / 0.9 per language and task."""
    ev = _evaluation(spark, sf_dir)
    rap = curve.recall_at_precision(ev.points)
    return rap.select("language", "task", "target", r9("recall").alias("recall"),
                      r9("precision").alias("precision"), "threshold")


@query
def q_metrics_pooled(spark, sf_dir):
    """Metric dictionary over all languages pooled (no routing)."""
    m = E.pooled_metrics(_gold_raw(spark, sf_dir), _pred_norm(spark, sf_dir))
    return m.select("metric", r9("value").alias("value"))


@query
def q_unthresholded_f1(spark, sf_dir):
    """A3, A4: score-free precision/recall/f1 per language and task."""
    ev = _evaluation(spark, sf_dir)
    u = metrics.unthresholded(ev.stats)
    return u.select("language", "task", "n", r9("precision").alias("precision"), r9("recall").alias("recall"),
                    r9("f1").alias("f1"))


@query
def q_macro_average(spark, sf_dir):
    """Macro average over evaluated non-English languages."""
    ev = _evaluation(spark, sf_dir)
    m = ev.macro
    cols = [c for c in m.columns if c.startswith("avg_")]
    return m.select(*[r9(c).alias(c) for c in cols], "n_languages", "passage_latex", "minimal_latex")


@query
def q_metric_reports(spark, sf_dir):
    """The written reports read back - the line of every language and task, and the one of the averages."""
    path = work_path(spark, "metric-reports")
    E.write_reports(_evaluation(spark, sf_dir), path)
    lines = spark.read.json(f"{path}/languages", schema="language string, task string, best_f1 double, best_precision double, "
                            "best_recall double, latex string")
    names = ["avg_passage_f1", "avg_passage_recall", "avg_passage_precision", "avg_minimal_f1", "avg_minimal_recall",
             "avg_minimal_precision"]
    m = spark.read.text(f"{path}/metrics").select(F.from_json("value", ", ".join(f"{n} double" for n in names)).alias("m"))
    tasks = [m.select(F.lit("average").alias("language"), F.lit(t).alias("task"), *[
        F.col(f"m.avg_{t}_{k}").alias(f"best_{k}") for k in ("f1", "precision", "recall")], F.lit("").alias("latex"))
        for t in ("passage", "minimal")]
    rows = lines.unionByName(tasks[0]).unionByName(tasks[1])
    return rows.select("language", "task", *[r9(c).alias(c) for c in ("best_f1", "best_precision", "best_recall")], "latex")


@query
def q_scored_samples(spark, sf_dir):
    """Verbose samples - predicted examples whose first annotation has
    a minimal span, with both answer texts cut from the document."""
    ev = _evaluation(spark, sf_dir)
    ms = ev.stats.where("task = 'minimal'").select("example_id", "f1", "precision", "recall", "score")
    g = ev.gold.join(F.broadcast(ev.eval_langs), "language", "left_semi").where("ann[0].s >= 0")
    j = scoring.joined(g, ev.pred).where("matched")
    text = _gold_raw(spark, sf_dir).select("example_id", "document_plaintext")
    out = j.select("example_id", "language", F.col("ann")[0]["s"].alias("gold_start"),
                   F.col("ann")[0]["e"].alias("gold_end"), F.col("p_s").alias("pred_start"),
                   F.col("p_e").alias("pred_end")).join(ms, "example_id").join(text, "example_id")
    return out.select(
        "example_id", "language", "gold_start", "gold_end", "pred_start", "pred_end",
        B.byte_slice("document_plaintext", "gold_start", "gold_end").alias("gold_text"),
        F.when(F.col("pred_start") >= 0, B.byte_slice("document_plaintext", "pred_start", "pred_end"))
        .otherwise(F.lit("")).alias("pred_text"),
        r9("score").alias("score"), r9("f1").alias("f1"), r9("precision").alias("precision"),
        r9("recall").alias("recall"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: best-threshold f1 / precision / recall / threshold per evaluated
    language and task (the evaluation job on the derived QA inputs)."""
    return q_best_threshold(spark, sf_dir)
