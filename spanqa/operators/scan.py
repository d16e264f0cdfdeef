"""Example scan with file and line of every entry, survivor counts taken by the scan itself, and its failures.

The lines of the files are numbered without a sequential pass: a line carries its file, the start of the split
that it was read from and its place in the scan. The entries are written with these three (a second scan could be
cut into other splits), the written splits are counted, and a line's number is the count of the file's
earlier splits plus its place in its own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from spanqa import schemas
from spanqa.constants import MAX_PASSAGES, MAX_POSITION
from spanqa.operators.entry import build_entries
from spanqa.operators.joins import join_dimension, landed

INVALID_JSON = "invalid_json"


@dataclass
class ExampleScan:
    entries: DataFrame   # one row a line: file, line_no, row_key and the columns of build_entries
    survivors: int
    pruned: int


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files (gzip or not, globs allowed), blank ones too: value, file, block, row_key.

    Only a line feed ends a line. Raises if no file matches.
    """
    try:
        lines = spark.read.option("lineSep", "\n").text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise ValueError(f"No paths matching glob '{path}'") from e
        raise
    return lines.select("value", F.col("_metadata.file_path").alias("file"),
                        F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("row_key"))


def number_lines(rows: DataFrame) -> DataFrame:
    """Written rows of `read_lines` (one a line, none left out) with ``line_no`` from 1 instead of ``block``."""
    splits = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("row_key").alias("_first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1)
                           .alias("_shift"))
    return join_dimension(rows, splits, ["file", "block"], name="line-index").withColumn(
        "line_no", F.col("row_key") + F.col("_shift")).drop("block", "_shift")


def scan_examples(spark: SparkSession, path: str, max_passages: int = MAX_PASSAGES, max_position: int = MAX_POSITION,
                  fail_on_invalid: bool = False) -> ExampleScan:
    """The entries of all lines under ``path``, landed, with ``reject_reason`` and lineage.

    A line that is no JSON object of the raw schema is rejected as ``invalid_json``. Raises if no file
    matches, if no example survives, and with ``fail_on_invalid`` at the first rejected line, which it names.
    """
    raw = read_lines(spark, path)
    parsed = raw.withColumn("_j", F.from_json("value", f"{schemas.RAW_EXAMPLE}, _corrupt STRING",
                                              {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_j").isNull() | F.col("_j._corrupt").isNotNull()
    parsed = parsed.select("file", "block", "row_key", bad.alias("_bad"), "_j.*").drop("_corrupt")
    entries = build_entries(parsed, max_passages, max_position, carry=["file", "block", "row_key", "_bad"])
    entries = entries.withColumn("reject_reason", F.when(F.col("_bad"), F.lit(INVALID_JSON)).otherwise(
        F.col("reject_reason"))).drop("_bad")
    counts = Observation(f"example-scan-{uuid.uuid4().hex[:8]}")
    seen = entries.observe(counts, F.count_if(F.col("reject_reason").isNull()).alias("survivors"),
                           F.count_if(F.col("reject_reason").isNotNull()).alias("pruned"))
    numbered = number_lines(landed(seen, "example-scan", "zstd")[0])
    survivors, pruned = counts.get["survivors"], counts.get["pruned"]
    if fail_on_invalid and pruned:
        first = numbered.where("reject_reason IS NOT NULL").orderBy("file", "line_no").first()
        raise ValueError(f"Invalid example at {first.file}:{first.line_no} ({first.reject_reason})")
    if not survivors:
        raise ValueError(f"No surviving examples from '{path}'")
    return ExampleScan(numbered, survivors, pruned)


def preparation_report(entries: DataFrame, errors: DataFrame, first: int = 25) -> DataFrame:
    """The examples that preparation reports - the first ones in file and line order, and all with errors.

    entries: as in `ExampleScan`; errors: row_key, doc_span_index, error (`Prepared.errors`). Rejected
    lines are no examples. Returns file, line_no, example_id, language, has_correct_context, errors (in window order,
    joined by "; ", empty if none) and is_first.
    """
    kept = entries.where("reject_reason IS NULL").select("row_key", "file", "line_no", "example_id", "language",
                                                         "has_correct_context")
    heads = kept.orderBy("file", "line_no").limit(int(first)).select("row_key", F.lit(True).alias("is_first"))
    found = errors.groupBy("row_key").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("doc_span_index", "error"))), lambda x: x["error"]), "; ").alias("errors"))
    return (kept.join(found.join(heads, "row_key", "full"), "row_key")
            .select("file", "line_no", "example_id", "language", "has_correct_context",
                    F.coalesce("errors", F.lit("")).alias("errors"), F.coalesce("is_first", F.lit(False)).alias("is_first")))


def error_sample(entries: DataFrame, errors: DataFrame, per_reason: int = 25) -> DataFrame:
    """The first examples of every error in file and line order: error, rank (from 1), file, line_no, example_id.

    The rank limit is applied within the tasks before the shuffle, so a frequent error fills no task.
    """
    one = errors.select("row_key", "error").distinct().join(
        entries.select("row_key", "file", "line_no", "example_id"), "row_key")
    rank = F.row_number().over(Window.partitionBy("error").orderBy("file", "line_no"))
    return one.withColumn("rank", rank).where(F.col("rank") <= int(per_reason)).select(
        "error", "rank", "file", "line_no", "example_id")
