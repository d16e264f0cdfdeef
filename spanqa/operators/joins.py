"""Joins against derived dimension tables whose size is not known up front.

``join_dimension`` lands the dimension side in the shared folder (cutting its
lineage), reads its size from the written files and broadcasts it only below
``max_broadcast_bytes``; above it, both sides are shuffled by key and adaptive
execution splits the partitions that a hot key fills, repeating only the
matching part of the dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanqa.session import work_path

DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def path_bytes(spark, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


def landed(df: DataFrame, name: str, codec: str | None = None) -> tuple[DataFrame, int]:
    """Write to the shared folder, read back; returns (table, bytes on disk). A table this function returned
    is not written again. ``codec``: another compression than the session's, for large tables."""
    known = getattr(df, "_landed_bytes", None)
    if known is not None:
        return df, known
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.mode("overwrite").parquet(path, compression=codec)
    table = spark.read.parquet(path)
    table._landed_bytes = path_bytes(spark, path)
    return table, table._landed_bytes


def join_dimension(fact: DataFrame, dim: DataFrame, keys: list[str], name: str = "dim", how: str = "inner",
                   max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Equi-join ``fact`` with a dimension unique on ``keys`` (inner or left)."""
    dim_t, nbytes = landed(dim, name)
    # parquet is compressed: allow for expansion in memory
    if nbytes * 4 <= max_broadcast_bytes:
        return fact.join(F.broadcast(dim_t), keys, how)
    return fact.join(dim_t.hint("merge"), keys, how)
