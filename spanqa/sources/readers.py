"""Scans. All readers declare their schema (no inference), keep the file path
and a per-file line ordinal so that "last line wins" rules stay exact, and
leave wide text columns for Catalyst to prune when a job does not use them.
gzip input is read transparently (one task per gzip file: land it as parquet
with ``land_parquet`` before heavy work)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanqa import schemas
from spanqa.session import work_path


def _with_ordinal(df: DataFrame) -> DataFrame:
    # (file path, position in scan order): within one file the scan order is
    # the line order; files compare by path.
    return df.withColumn(
        "_ord",
        F.struct(F.col("_metadata.file_path").alias("file"),
                 F.monotonically_increasing_id().alias("pos")),
    )


def last_wins(df: DataFrame, keys: list[str], ordinal: str = "_ord") -> DataFrame:
    """Keep, per key, the row with the greatest ordinal (later line / file wins)."""
    cols = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(ordinal)).alias("_r"))
    return agg.select(*keys, *[F.col("_r." + c).alias(c) for c in cols])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (the duplicate warning of a union)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def read_raw_examples(spark: SparkSession, path: str) -> DataFrame:
    """Raw annotated articles (JSONL, gzip or not, glob allowed)."""
    return _with_ordinal(spark.read.schema(schemas.RAW_EXAMPLE).json(path))


def gold_labels(raw: DataFrame) -> DataFrame:
    """One row per annotation; duplicated example ids keep the last line."""
    g = last_wins(raw.select("example_id", "language", "annotations", "_ord"), ["example_id"])
    return g.select(
        "example_id", "language",
        F.posexplode("annotations").alias("ann_pos", "a"),
    ).select(
        "example_id", "language", "ann_pos",
        F.col("a.annotation_id").alias("annotation_id"),
        F.col("a.passage_answer.candidate_index").alias("passage_answer_index"),
        F.coalesce(F.col("a.minimal_answer.plaintext_start_byte"), F.lit(-1)).alias("minimal_start_byte"),
        F.coalesce(F.col("a.minimal_answer.plaintext_end_byte"), F.lit(-1)).alias("minimal_end_byte"),
        F.lower("a.yes_no_answer").alias("yes_no_answer"),
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction JSONL with the reader's defaults and normalisation.

    Missing passage index -> -1, missing yes/no -> 'none', yes/no lower-cased,
    missing minimal answer -> null span (-1, -1), scores as double. Validation
    is separate (``spanqa.operators.scoring.prediction_errors``).
    """
    df = _with_ordinal(spark.read.schema(schemas.PREDICTION).json(path))
    return normalize_predictions(df)


def normalize_predictions(df: DataFrame) -> DataFrame:
    return df.select(
        "example_id", "language",
        F.coalesce("passage_answer_index", F.lit(-1).cast("bigint")).alias("passage_answer_index"),
        F.coalesce("minimal_answer.start_byte_offset", F.lit(-1).cast("bigint")).alias("minimal_start_byte"),
        F.coalesce("minimal_answer.end_byte_offset", F.lit(-1).cast("bigint")).alias("minimal_end_byte"),
        F.coalesce(F.lower("yes_no_answer"), F.lit("none")).alias("yes_no_answer"),
        F.col("passage_answer_score").cast("double").alias("passage_score"),
        F.col("minimal_answer_score").cast("double").alias("minimal_score"),
        "_ord",
    )


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """example_id -> candidates, over many files; later file wins."""
    df = _with_ordinal(spark.read.schema(schemas.CANDIDATES_ONLY).json(path))
    return last_wins(df, ["example_id"])


# Python's str.strip(): leading/trailing characters that are isspace().
PY_STRIP = r"^[\s\p{Z}\x{1C}-\x{1F}\x{85}]+|[\s\p{Z}\x{1C}-\x{1F}\x{85}]+$"


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary text file -> (token, id).

    Each line is stripped; a repeated token keeps its first id and does not
    use up an id; a blank line is the token "". Ids are dense in file order.
    Lines are numbered where they are scanned, so that the job scales with the
    file and needs no driver-side loop.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", PY_STRIP, "").alias("token"),
                                         F.monotonically_increasing_id().alias("line_no"))
    first = lines.groupBy("token").agg(F.min("line_no").alias("first_line"))
    return dense_index(first, ["first_line"], "id").select("token", "id")


def dense_index(df: DataFrame, order_cols: list[str], name: str) -> DataFrame:
    """Add a dense 0-based index in the order of ``order_cols``, which should
    tell the rows apart.

    The rows are range-partitioned once and written with the number of their
    range; a row's index is the size of the ranges before its own plus its rank
    there. The broadcast sizes are one row per range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = land_parquet(df.repartitionByRange(n, *order_cols).withColumn("_range", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order_cols))
    return ranged.join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + rank - 1).drop("_range", "_before")


def read_features(spark: SparkSession, path: str, seq_length: int, is_training: bool,
                  on_length: str = "fail") -> DataFrame:
    """Feature table with the declared fixed-length arrays, narrowed to 32-bit ids.

    A row with a missing array or one of another length than ``seq_length`` fails the scan (``fail``), is left out
    (``drop``) or passes (``keep``). The check is a filter over the scan, so it holds whichever columns are used.
    """
    if on_length not in ("fail", "drop", "keep"):
        raise ValueError(f"on_length is fail, drop or keep, not {on_length!r}")
    df = spark.read.parquet(path)
    cols = ["unique_ids", "example_index", "language_id", "input_ids", "input_mask", "segment_ids"]
    cols += (["start_positions", "end_positions", "answer_types"] if is_training
             else ["wp_start_offset", "wp_end_offset"])
    df = df.select(*cols).withColumn("language_id", F.col("language_id").cast("int"))
    if on_length == "keep":
        return df
    whole = F.lit(True)
    for c in ("input_ids", "input_mask", "segment_ids", "wp_start_offset", "wp_end_offset"):
        if c in cols:
            whole = whole & F.coalesce(F.size(c) == int(seq_length), F.lit(False))
    if on_length == "drop":
        return df.where(whole)
    # raised in a filter: a column that is dropped again would be pruned
    message = F.concat(F.lit(f"not {int(seq_length)} values in an array of feature "),
                       F.coalesce(F.col("unique_ids").cast("string"), F.lit("null")))
    return df.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def read_goldp_predictions(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object {id: answer} per file -> (id, answer) rows."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "answer"))


def read_goldp_dataset(spark: SparkSession, path: str) -> DataFrame:
    """SQuAD-1.1-shaped JSON -> one row per answer of each question."""
    d = spark.read.schema(schemas.GOLDP_DATASET).option("multiLine", True).json(path)
    return (
        d.select(F.explode("data").alias("d"))
        .select(F.col("d.title").alias("title"), F.explode("d.paragraphs").alias("p"))
        .select("title", F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
        .select("title", "context", F.col("q.id").alias("id"), F.col("q.question").alias("question"),
                F.posexplode_outer("q.answers").alias("answer_pos", "a"))
        .select("title", "context", "id", "question", "answer_pos",
                F.col("a.text").alias("answer_text"), F.col("a.answer_start").alias("answer_start"))
    )


def land_parquet(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost
    executors, and turns one unsplittable gzip file into splittable parquet."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
