"""Stand-in QA inputs derived from the driver's ``documents`` table.

The driver tables hold no question-answering data, so raw annotated examples
and predictions are built from ``documents`` by integer arithmetic only
(FIXTURES.md section 4). These builders only produce rows in the schemas the
jobs expect; they do none of the jobs' work. The same rows are re-derived in
DuckDB SQL by ``spanqa.plans.oracle`` for the correctness gate.

Everything is computed in-row with higher-order functions: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanqa.constants import CONTINUATION_PREFIX, MAX_POSITION, SPECIAL_TOKENS

# --- fixed values: document language code -> example language name -------
LANGUAGE_OF_CODE = {"en": "english", "fr": "finnish", "de": "swahili", "es": "korean"}


def _lang_expr(col: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGE_OF_CODE.items())
    return f"CASE {col} {cases} END"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")


def _paragraphs(docs: DataFrame) -> DataFrame:
    """Paragraphs (split on newline) with their byte starts, in-row."""
    return docs.selectExpr(
        "doc_id", "lang", "text", f"{_lang_expr('lang')} AS language",
        "split(text, '\\n', -1) AS paras",
    ).selectExpr(
        "*", "size(paras) AS n",
        "aggregate(paras, named_struct('nx', 0L, 'arr', CAST(array() AS ARRAY<BIGINT>)), "
        "(acc, p) -> named_struct('nx', acc.nx + octet_length(p) + 1, 'arr', concat(acc.arr, array(acc.nx))), "
        "acc -> acc.arr) AS starts",
    )


def qa_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, cand_pos, n, txt, start_b, len_b)."""
    p = _paragraphs(docs)
    return p.select(
        "doc_id", "lang", "n", "starts", F.posexplode("paras").alias("cand_pos", "txt")
    ).selectExpr("doc_id", "lang", "cand_pos", "n", "txt",
                 "starts[cand_pos] AS start_b", "octet_length(txt) AS len_b")


def _word_span(start: str, words: str, w0: str, dw: str) -> str:
    """Byte span of words [w0, w0+dw] (clamped) of a paragraph split on one space."""
    w1 = f"least(size({words}) - 1, {w0} + {dw})"
    s = f"{start} + octet_length(array_join(slice({words}, 1, {w0}), ' ')) + IF({w0} > 0, 1, 0)"
    e = f"{start} + octet_length(array_join(slice({words}, 1, {w1} + 1), ' '))"
    return f"named_struct('s', {s}, 'e', {e})"


def raw_examples(docs: DataFrame) -> DataFrame:
    """Raw annotated examples (one per document, three annotators each)."""
    p = _paragraphs(docs)
    ci = ("IF((doc_id + a * a) % 5 >= 2 AND doc_id % 13 <> 0, "
          "(doc_id + IF(a = 2, doc_id % 3, 0)) % n, -1)")
    step1 = f"transform(sequence(0, 2), a -> named_struct('a', a, 'ci', CAST({ci} AS BIGINT)))"
    # the words of a paragraph are split once an annotator
    step1 = (f"transform({step1}, x -> named_struct('a', x.a, 'ci', x.ci, 'words', "
             "IF(x.ci >= 0, split(paras[x.ci], ' ', -1), NULL)))")
    span = _word_span("starts[x.ci]", "x.words", "(doc_id * 5 + x.a) % size(x.words)", "doc_id % 4")
    ann = (
        f"transform({step1}, x -> named_struct("
        "'annotation_id', CAST(CAST('18000000000000000000' AS DECIMAL(20,0)) + doc_id * 3 + x.a AS DECIMAL(20,0)), "
        "'passage_answer', named_struct('candidate_index', x.ci), "
        "'minimal_answer', IF(x.ci >= 0 AND doc_id % 11 <> 0 AND (doc_id + x.a) % 4 <> 0, "
        f"  named_struct('plaintext_start_byte', {span}.s, 'plaintext_end_byte', {span}.e), "
        "  named_struct('plaintext_start_byte', -1L, 'plaintext_end_byte', -1L)), "
        "'yes_no_answer', IF(x.ci >= 0 AND doc_id % 11 = 0, IF((doc_id + x.a) % 2 = 0, 'YES', 'NO'), 'NONE')))"
    )
    cands = ("transform(sequence(0, n - 1), i -> named_struct("
             "'plaintext_start_byte', starts[i], 'plaintext_end_byte', starts[i] + octet_length(paras[i]), "
             "'html_start_byte', starts[i], 'html_end_byte', starts[i] + octet_length(paras[i])))")
    return p.selectExpr(
        "doc_id AS example_id", "language",
        "concat('document ', doc_id) AS document_title",
        "concat('doc://', doc_id) AS document_url",
        "text AS document_plaintext",
        "paras[0] AS question_text",
        f"{cands} AS passage_answer_candidates",
        f"{ann} AS annotations",
    )


def predictions(docs: DataFrame) -> DataFrame:
    """Prediction records (D6): one per kept document plus unexpected ids."""
    p = _paragraphs(docs)
    base = p.where("doc_id % 17 <> 3").selectExpr(
        "*",
        "CAST(CASE WHEN doc_id % 6 = 1 THEN -1 WHEN doc_id % 5 = 2 THEN (doc_id + 1) % n "
        "ELSE doc_id % n END AS BIGINT) AS ci",
    )
    base = base.selectExpr("*", "IF(ci >= 0, split(paras[ci], ' ', -1), NULL) AS words")
    span = _word_span("starts[ci]", "words", "(doc_id * 5 + 1) % size(words)", "(doc_id + 1) % 4")
    main = base.selectExpr(
        "doc_id AS example_id",
        f"IF(doc_id % 43 = 5, IF(lang = 'en', '{LANGUAGE_OF_CODE['de']}', '{LANGUAGE_OF_CODE['en']}'), language) AS language",
        "ci AS passage_answer_index",
        "((doc_id * 37) % 200 + IF(doc_id % 5 >= 3, 80, 0)) / 8.0D AS passage_answer_score",
        f"IF(ci >= 0 AND doc_id % 11 <> 0, named_struct('start_byte_offset', {span}.s, 'end_byte_offset', {span}.e), "
        "named_struct('start_byte_offset', -1L, 'end_byte_offset', -1L)) AS minimal_answer",
        "((doc_id * 53) % 160 + IF(doc_id % 5 >= 3, 64, 0)) / 8.0D AS minimal_answer_score",
        "IF(ci >= 0 AND doc_id % 11 = 0, IF(doc_id % 2 = 0, 'YES', 'NO'), 'NONE') AS yes_no_answer",
    )
    extra = p.where("doc_id % 50 = 0").selectExpr(
        "doc_id + 10000000 AS example_id", "language",
        "0L AS passage_answer_index", "1.0D AS passage_answer_score",
        "named_struct('start_byte_offset', 0L, 'end_byte_offset', 5L) AS minimal_answer",
        "1.0D AS minimal_answer_score", "'NONE' AS yes_no_answer",
    )
    return main.unionByName(extra)


def with_scan_ordinal(df: DataFrame) -> DataFrame:
    """Ordinal column for in-memory derived rows (no duplicates by design)."""
    return df.withColumn("_ord", F.struct(F.lit("derived").alias("file"), F.col("example_id").alias("pos")))


def derive_vocab_lines(docs: DataFrame, n_words: int = 2000, max_position: int = MAX_POSITION) -> DataFrame:
    """Stand-in vocabulary (lines, in order): special tokens, context markers,
    every character of the corpus and its continuation form, then the most
    frequent whitespace-separated words (count desc, word asc)."""
    spark = docs.sparkSession
    specials = spark.createDataFrame([(0, i, t) for i, t in enumerate(SPECIAL_TOKENS)], "sec int, k long, line string")
    markers = spark.range(max_position).select(F.lit(1).alias("sec"), F.col("id").alias("k"),
                                               F.concat(F.lit("[ContextId="), F.col("id").cast("string"), F.lit("]")))
    chars = (docs.select(F.explode(F.split("text", "")).alias("c"))
             .where((F.col("c") != "") & ~F.col("c").rlike(r"[\s\p{Z}\p{Cc}]"))
             .distinct())
    c1 = chars.select(F.lit(2).alias("sec"), F.lit(0).cast("long").alias("k"), F.col("c").alias("line"))
    c2 = chars.select(F.lit(3).alias("sec"), F.lit(0).cast("long").alias("k"),
                      F.concat(F.lit(CONTINUATION_PREFIX), "c").alias("line"))
    words = (docs.select(F.explode(F.split("text", r"[\s\p{Z}]+")).alias("w")).where("w <> ''")
             .groupBy("w").count()
             .orderBy(F.col("count").desc(), F.col("w")).limit(n_words)  # top-k is the feature here
             .select(F.lit(4).alias("sec"), (-F.col("count")).alias("k"), F.col("w").alias("line")))
    return specials.unionByName(markers.toDF("sec", "k", "line")).unionByName(c1).unionByName(c2).unionByName(words)
