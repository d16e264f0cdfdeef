"""The opN queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanqa.llm import (ann, conversations, decontam, html_crf, langid, licenses, merkle, mixing, pieces, pii, secrets,
                        simhash, toxicity)
from spanqa.llm.common import table

#: Folder of the public tokenizers' vocabulary files on the driver.
TOKENIZERS = "/opt/tokenizers"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: sources weighted 1, 2, 3 in turn, 100% of all words, three epochs at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "repeats")


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate components of all documents: 3-word shingles, 2 bits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, test item) whose passage aligns, over whole texts: score, matched words, spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return (found.select("doc_id", F.explode("contaminated_by").alias("h"))
            .select("doc_id", "h.item_id", "h.score", "h.matched", "h.start", "h.end", "h.item_start", "h.item_end"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labels of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
        F.size("offending").alias("n_offending"))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: base spans, and those that learnt contexts add."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in pii.KINDS],
                        F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"),
                        pii.digest(F.col("spans")).alias("spans"))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: base spans, and tokens that pass as random."""
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(k: int):
        return F.size(F.filter("base", lambda s: s["k"] == k)).cast("long").alias(f"n_{secrets.KINDS[k]}")

    return found.select("doc_id", *[count(k) for k in range(len(secrets.KINDS))],
                        F.sha2(secrets.digest(F.col("base")), 256).alias("base_sha256"),
                        secrets.digest(F.col("spans")).alias("spans"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the byte network, learnt from documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = langid.train(docs)
    return langid.predict(docs.select("doc_id", "text"), net).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, by inner product, from the inverted multi-index."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, F.col("vec_id") % 20 == 0)


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every whole text: template, coverage, matched words, span."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (licenses.scan(docs).select("doc_id", F.explode("licenses").alias("l"))
            .select("doc_id", "l.license", "l.coverage", "l.matched", "l.start", "l.end"))


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the block chain, trained on pages that mark their text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_crf.extract(pages, html_crf.train(pages)).select("page_id", "url", "text", "n_chars")


@query
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired turns of every conversation, damaged by a hash before."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversations.audits(conversations.damage(turns)).withColumnRenamed("conv_id", "_id")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (turns.select("conv_id").distinct().join(found, F.expr("conv_id <=> _id"), "left")
            .select("conv_id", *[F.when(F.col("audit").isNull(), 0).otherwise(F.col(c)).cast("long").alias(c) for c in counts],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents, and the root recomputed from each leaf after tampering with one in five."""
    found = merkle.manifest(table(spark, sf_dir, "documents").select(*merkle.FIELDS))
    folded = merkle.fold(F.coalesce("tampered_leaf", "leaf"), F.col("path"))
    return (found.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")).alias("proof_sha256"),
                         folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


@query
def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, and the text decoded from them."""
    model = pieces.Model.read(f"{TOKENIZERS}/piece_bpe_32k.model")
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
