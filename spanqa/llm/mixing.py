"""Mixing sources to target weights by capped water-filling (DataFrame operations only).

Targets: every source gets words in proportion to its weight; a source never gets more than
`max_epochs` times its own size, and what it cannot take is shared again by weight among the others
until none is above its cap. The fixed point is one water level L with target = least(cap, weight * L).
Each round is one aggregate over the source table (one row per source, landed); only the round's two
sums reach the driver.

Sampling: a source with target r times its size repeats each document floor(r) times. The fraction
that is left is taken as whole documents in the order of a seeded hash of doc_id, up to the hash value
at which the words taken come nearest to the target. That value is found with two histograms of
4,096 hash ranges each (second one only within the range where the first crosses the target), so no
source is ever sorted or gathered, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanqa.llm.common import WORD, fresh, land, packed

MAX_EPOCHS = 3
SEED = 20240


#: Columns that a mix adds.
ADDED = ("size", "source_size", "target", "repeats", "taken")


def added_names(columns: list[str]) -> dict[str, str]:
    """Names of the added columns beside `columns`."""
    return {c: fresh(c, columns) for c in ADDED}


def words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, weight): sources in code-point order, null last, weighted by `cycle` repeated.

    The rank is a window over one row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cyc = F.array(*[F.lit(c) for c in cycle])
    return (docs.select("source").distinct()
            .select("source", F.element_at(cyc, (rank % len(cycle) + 1).cast("int")).alias("weight")))


def water_level(sources: DataFrame, budget: float, max_epochs: int) -> float:
    """The level L of least(max_epochs * source_size, weight * L); infinite if every source is at its cap."""
    cap = F.col("source_size") * max_epochs
    pos = sources.where("weight > 0")
    level = 0.0
    first = True
    while True:
        clamped = F.lit(False) if first else cap <= F.col("weight") * F.lit(level)
        r = pos.agg(F.sum(F.when(clamped, cap).otherwise(0)), F.sum(F.when(clamped, 0).otherwise(F.col("weight"))),
                    F.count("*")).first()
        if not r[2] or not r[1]:
            return float("inf")
        nxt = max(0.0, budget - r[0]) / r[1]
        if not first and nxt <= level:
            return level
        level, first = nxt, False


def mix(docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None,
        max_epochs: int = MAX_EPOCHS, seed: int = SEED, size: Column | None = None, replace: bool = True) -> DataFrame:
    """`docs` plus size, source_size, target, repeats and taken (= size * repeats).

    docs: needs doc_id and source, and text unless `size` is given; other columns pass through, but for
    columns named like the added ones, which are replaced (`replace`) or stay, the added ones then getting the names
    of `added_names`. weights: (source, weight), one row per source;
    null and negative weights count as 0, sources without a row get 0. budget: words of the whole mix,
    by default 100% of all sizes.
    Null source is a source of its own. Null text has size 0. Rows that repeat a doc_id share its draw.
    An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if not replace or c.lower() not in ADDED]
    names = added_names(kept)
    size = words(F.col("text")) if size is None else size
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = packed(docs, "source", size.alias("_size"), F.substring(draw, 1, 3).alias("_b1"), F.substring(draw, 4, 3).alias("_b2"))
    sized = land(rows.select("source", "_size", "_b1", "_b2"), "mix-sized")
    hist = land(sized.groupBy("source", "_b1").agg(F.sum("_size").alias("s")), "mix-hist")
    totals = hist.groupBy("source").agg(F.sum("s").alias("source_size"))
    weights = cyclic_weights(totals) if weights is None else weights
    w = F.greatest(F.coalesce(F.col("weight"), F.lit(0)), F.lit(0))
    sources = land(totals.alias("t").join(weights.alias("w"), F.expr("t.source <=> w.source"), "left")
                   .select("t.source", "source_size", w.alias("weight")), "mix-sources")
    if budget is None:
        budget = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = water_level(sources, budget, max_epochs)
    cap = (F.col("source_size") * max_epochs).cast("double")
    target = F.when(F.col("weight") > 0, F.least(cap, F.col("weight") * F.lit(level))).otherwise(0.0)
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0)
    plan = sources.select("source", "source_size", target.alias("target"), whole.alias("whole"),
                          (target - whole * F.col("source_size")).alias("rest"))

    # the hash range in which each source's running words cross what is left
    by = Window.partitionBy("source")
    run = Window.partitionBy("source").orderBy("_b1").rowsBetween(Window.unboundedPreceding, 0)
    rest = plan.select(F.col("source").alias("_s"), "rest")
    cum = hist.join(rest, F.expr("source <=> _s")).drop("_s").withColumn("cum", F.sum("s").over(run))
    edge = land(cum.where("cum > rest").withColumn("_first", F.min("_b1").over(by)).where("_b1 = _first")
                .select("source", F.col("_b1").alias("e1"), (F.col("cum") - F.col("s")).alias("base"), "rest"),
                "mix-edge")
    fine = (sized.join(edge.withColumnRenamed("source", "_s"), F.expr("source <=> _s and _b1 = e1"))
            .groupBy("source", "_b2").agg(F.sum("_size").alias("s"), F.first("base").alias("base"),
                                            F.first("rest").alias("rest")))
    run2 = Window.partitionBy("source").orderBy("_b2").rowsBetween(Window.unboundedPreceding, 0)
    cut = (fine.withColumn("cum", F.col("base") + F.sum("s").over(run2))
           .where(F.col("cum") - F.col("s") / 2.0 <= F.col("rest"))
           .groupBy("source").agg(F.max("_b2").alias("e2")))
    full = land(plan.withColumnRenamed("source", "_s")
                .join(edge.select("source", "e1"), F.expr("_s <=> source"), "left").drop("source")
                .join(cut, F.expr("_s <=> source"), "left").drop("source", "rest"), "mix-plan")
    once_more = (F.col("_b1") < F.col("e1")) | ((F.col("_b1") == F.col("e1")) & (F.col("_b2") <= F.col("e2")))
    repeats = F.least(F.lit(max_epochs), F.col("whole") + F.when(once_more, 1).otherwise(0)).cast("long")
    made = {"size": F.col("_size"), "source_size": F.col("source_size"), "target": F.col("target"), "repeats": repeats,
            "taken": F.col("_size") * repeats}
    return rows.join(full, F.expr("source <=> _s"), "left").select(
        *[F.col("row").getField(c).alias(c) for c in kept], *[made[c].alias(names[c]) for c in ADDED])
