"""Training-corpus pipeline over `documents`: toxicity, near-duplicates, benchmark leaks, personal data, mixture.

Each stage gets all rows its predecessor kept, reads them back from Parquet in the shared folder, and returns the
columns of `documents` (the last one adds its own). Models and corpus statistics come from the tables in sf_dir
and the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanqa.llm import decontam, mixing, pii, simhash, toxicity
from spanqa.llm.common import fresh, land, packed, table, unpacked


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches the threshold go; null and empty texts stay."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(packed(docs, "text"), model)
    return unpacked(scored.where(F.col("toxicity") < toxicity.THRESHOLD), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash near-duplicate group stays, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts is replaced by its kind in brackets."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for every repetition the mix takes of a document, numbered by `epoch` from 1; documents the
    mix doesn't take go. Columns of the documents stay as they are; an added one of the same name gets underscores."""
    mixed = mixing.mix(docs, replace=False)
    times = F.col(mixing.added_names(docs.columns)["repeats"]).cast("int")
    return mixed.where(times > 0).withColumn(fresh("epoch", mixed.columns), F.explode(F.sequence(F.lit(1), times)))


STAGES = [("toxicity", drop_toxic), ("simhash_dedup", near_dedup), ("decontamination", decontaminate),
          ("pii", mask_personal_data), ("mixing", mix)]
#: Trained and iterative stages can't be written in SQL; the tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
