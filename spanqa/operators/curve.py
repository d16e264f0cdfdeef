"""Precision/recall over score thresholds (W1), best threshold (A5) and
recall at precision targets (A6).

Rows are first pre-aggregated per distinct score (ties collapse, as the
reference's threshold dictionary does), then a running sum in descending score
order gives, at every threshold, the totals over all examples scoring at or
above it. The running sum is distributed: approximate score quantiles cut each
group into blocks, block totals (a table of groups x blocks rows) give every
block its starting offset, and each block is summed on its own. A language
holding most of the rows is thus spread over many tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanqa.constants import PRECISION_TARGETS
from spanqa.functions.bytes import f1_of, safe_divide

# Decimal places kept on running float sums, so that sums taken in any order
# compare equal (precision targets are compared on these values).
SUM_DIGITS = 9
# Decimal places of the values summed exactly.
DECIMAL_DIGITS = 15


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys where null equals null; ``right`` is the bounded block table."""
    r = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return left.join(F.broadcast(r), on).drop(*[f"_k{i}" for i in range(len(keys))])


def running_sums_desc(df: DataFrame, keys: list[str], order: str, cols: list[str],
                      blocks: int = 64) -> DataFrame:
    """For each row: ``cum_<c>`` = sum of c over rows of its group with
    order >= this row's (one row per distinct order value expected, not null),
    and ``tot_<c>`` = the group total. A null key is a group of its own.

    The block table has at most (#groups x (blocks + 1)) rows; callers group by
    a bounded key set (languages x tasks), so it is broadcast.
    """
    pct = ", ".join(str((i + 1) / blocks) for i in range(blocks - 1))
    bounds = df.groupBy(*keys).agg(F.expr(f"percentile_approx({order}, array({pct}), 10000)").alias("_bounds"))
    with_block = (_null_safe(df, bounds, keys)
                  .withColumn("_block", F.expr(f"size(filter(_bounds, b -> b > {order}))"))
                  .drop("_bounds"))
    block_tot = with_block.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"_b_{c}") for c in cols])
    wk = Window.partitionBy(*keys).orderBy("_block")
    offsets = block_tot.select(
        *keys, "_block",
        *[F.coalesce(F.sum(f"_b_{c}").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
          .alias(f"_off_{c}") for c in cols],
        *[F.sum(f"_b_{c}").over(Window.partitionBy(*keys)).alias(f"tot_{c}") for c in cols],
    )
    wb = (Window.partitionBy(*keys, "_block").orderBy(F.col(order).desc())
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = _null_safe(with_block, offsets, [*keys, "_block"])
    return out.select(
        *df.columns,
        *[(F.col(f"_off_{c}") + F.sum(c).over(wb)).alias(f"cum_{c}") for c in cols],
        *[F.col(f"tot_{c}") for c in cols],
    )


def threshold_points(stats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per (keys, distinct score) with precision, recall and f1 of
    predicting every example scoring at or above the threshold.

    A missing score counts as 0.0 (the value a missing prediction has); a null
    key is a group of its own. F1 values are summed as DECIMAL, so the order
    of the rows cannot change a sum. The per-score table is checkpointed
    (lineage cut, read three times by the running sum).
    """
    keys = keys or ["language", "task"]
    exact = F.round("f1", DECIMAL_DIGITS).cast(f"decimal(38,{DECIMAL_DIGITS})")
    pts = stats.groupBy(*keys, F.coalesce(F.col("score"), F.lit(0.0)).alias("score")).agg(
        F.sum(exact).cast(f"decimal(38,{DECIMAL_DIGITS})").alias("s_f1"),
        F.sum(F.col("has_pred").cast("long")).alias("s_pred"),
        F.sum(F.col("has_gold").cast("long")).alias("s_gold"),
    ).checkpoint(eager=True)
    cum = running_sums_desc(pts, keys, "score", ["s_f1", "s_pred", "s_gold"])
    f1sum = F.round(F.col("cum_s_f1").cast("double"), SUM_DIGITS)
    return cum.select(
        *keys, "score",
        safe_divide(f1sum, "cum_s_pred").alias("precision"),
        safe_divide(f1sum, "tot_s_gold").alias("recall"),
    ).withColumn("f1", f1_of("precision", "recall"))


def best_threshold(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A5: highest f1 over thresholds, the highest threshold on ties; all zeros
    when no threshold has f1 > 0."""
    keys = keys or ["language", "task"]
    b = points.groupBy(*keys).agg(
        F.max(F.when(F.col("f1") > 0, F.struct("f1", "score", "precision", "recall"))).alias("b"))
    return b.select(
        *keys,
        F.coalesce("b.f1", F.lit(0.0)).alias("best_f1"),
        F.coalesce("b.precision", F.lit(0.0)).alias("best_precision"),
        F.coalesce("b.recall", F.lit(0.0)).alias("best_recall"),
        F.coalesce("b.score", F.lit(0.0)).alias("best_threshold"),
    )


def recall_at_precision(points: DataFrame, keys: list[str] | None = None,
                        targets: list[float] | None = None) -> DataFrame:
    """Per target, the highest recall among thresholds whose precision is
    at least the target (highest threshold on ties); (0, 0, null) if none.
    One aggregate per target over the same rows - no join with the targets."""
    keys = keys or ["language", "task"]
    targets = targets or PRECISION_TARGETS
    aggs = [
        F.max(F.when((F.col("precision") >= t) & (F.col("recall") > 0),
                     F.struct("recall", "score", "precision"))).alias(f"t{i}")
        for i, t in enumerate(targets)
    ]
    a = points.groupBy(*keys).agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("target"),
                 F.coalesce(F.col(f"t{i}.recall"), F.lit(0.0)).alias("recall"),
                 F.coalesce(F.col(f"t{i}.precision"), F.lit(0.0)).alias("precision"),
                 F.col(f"t{i}.score").alias("threshold"))
        for i, t in enumerate(targets)
    ])
    return a.select(*keys, F.inline(rows))
