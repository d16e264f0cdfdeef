"""Helpers shared by the training-data operators: landed tables, in-row spans, connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanqa.session import work_path

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Matches whose positions are summed one by one before block offsets are added (see `spans`).
SPAN_BLOCK = 128


def land(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, *needed: str | Column) -> DataFrame:
    """`docs` as the one column `row`, beside the columns an operator works on: no name can clash then."""
    every = F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns])
    return docs.select(every.alias("row"), *needed)


def unpacked(rows: DataFrame, columns: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of packed rows, those in `changed` with another value."""
    return rows.select(*[(changed or {}).get(c, F.col("row").getField(c)).alias(c) for c in columns])


def fresh(name: str, columns: list[str]) -> str:
    """`name`, with as many underscores as it takes to be none of `columns`."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df`, landed, with a dense 0-based rank in the order of the columns `order` (nulls first).

    One range partitioning; equal rows are spread by their place in `df`, so that no number of them fills one task.
    Rows are numbered where they are sorted, and the sizes of the tasks before are added (one row a task).
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *order, "_row")
             .sortWithinPartitions(*order, "_row").drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    dealt = land(dealt, "ranked").withColumn("_task", F.shiftright("_at", 33))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_task").agg(F.count("*").alias("_n")).select(
        "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return dealt.join(F.broadcast(sizes), "_task").withColumn(name, at).drop("_task", "_at", "_before")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once a row, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of `pattern`, in code points.

    array<struct<start int, end int, value string, before string, after string>>;
    `before` and `after` are the text between this match and its neighbours.
    The gaps come from `split`, the matches from `regexp_extract_all`; both walk
    the text once. Positions are prefix sums of the lengths, taken in blocks of
    SPAN_BLOCK so that a text with very many matches stays near linear.
    `pattern` must not match the empty string. A null text has no spans.
    """
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda acc, x: acc + x)

    def of_lengths(found: Column) -> Column:
        gaps, values, steps = found["gaps"], found["values"], found["steps"]
        n = F.size(values)
        starts = F.sequence(F.lit(0), n - 1, F.lit(SPAN_BLOCK))
        sums = F.transform(starts, lambda s: total(F.slice(steps, s + 1, F.lit(SPAN_BLOCK))))

        def with_bases(bases: Column) -> Column:
            def one(i: Column) -> Column:
                b = F.floor(i / SPAN_BLOCK).cast("int")
                at = (F.get(bases, b) + total(F.slice(steps, b * SPAN_BLOCK + 1, i - b * SPAN_BLOCK))
                      + F.length(F.get(gaps, i)))
                return F.struct(
                    at.cast("int").alias("start"),
                    (at + F.length(F.get(values, i))).cast("int").alias("end"),
                    F.get(values, i).alias("value"),
                    F.get(gaps, i).alias("before"),
                    F.get(gaps, i + 1).alias("after"))
            return F.transform(F.sequence(F.lit(0), n - 1), one)

        bases = let(sums, lambda s: F.transform(
            F.sequence(F.lit(0), F.size(s) - 1), lambda j: total(F.slice(s, F.lit(1), j))))
        return let(bases, with_bases)

    def of_parts(parts: Column) -> Column:
        steps = F.zip_with(F.slice(parts["gaps"], F.lit(1), F.size(parts["values"])), parts["values"],
                           lambda g, v: F.length(g) + F.length(v))
        return let(F.struct(parts["gaps"].alias("gaps"), parts["values"].alias("values"),
                            steps.alias("steps")), of_lengths)

    p = F.lit(pattern)
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, p, F.lit(0)).alias("values"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    return F.when(text.rlike(pattern), let(parts, of_parts)).otherwise(empty)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: (node, root), root the smallest node of the component.

    Alternating large-star / small-star rounds on the edge table `(u, v)` of longs. Each round groups
    by node (a minimum, combined before the shuffle) and joins it back, which adaptive execution can
    split for a hot node; the rounds are landed in the shared folder. Edges never reach the driver,
    only a count and a checksum do. Nodes without an edge to another node are not listed.
    """
    def checksum(df: DataFrame):
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    def star(pairs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
        mins = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return keep(pairs.join(mins, "u"))

    cur = land(edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = checksum(cur)
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, lambda j: j.where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = large.distinct()
        small = star(large, lambda j: j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            j.select("u", F.col("m").alias("v"))))
        cur = land(small.where("u != v").distinct(), "cc")
        now = checksum(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
