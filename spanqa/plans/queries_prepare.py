"""Queries of the preparation, assembly and gold-passage jobs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanqa.constants import GOLDP_LANGUAGES
from spanqa.functions import bytes as B
from spanqa.functions import chars as C
from spanqa.functions.lists import digests, sums, values
from spanqa.functions.narrow import made_before
from spanqa.operators import alignment, assemble, entry, features, goldp, model, scan, tokenize, training
from spanqa.operators.joins import landed
from spanqa.plans import predict as PR
from spanqa.plans import prepare as P
from spanqa.plans.queries import query, r9
from spanqa.session import work_path
from spanqa.sources import derived, readers

_CACHE: dict[tuple, DataFrame] = {}


def _cached(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    k = (spark.sparkContext.applicationId, sf_dir, name)
    if k not in _CACHE:
        _CACHE[k] = build()
    return _CACHE[k]


def _docs(spark, sf_dir):
    return derived.documents(spark, sf_dir)


def raw_examples(spark, sf_dir) -> DataFrame:
    return _cached(spark, sf_dir, "raw", lambda: landed(derived.raw_examples(_docs(spark, sf_dir)), "raw", "zstd")[0])


def vocab(spark, sf_dir) -> DataFrame:
    def build():
        path = tokenize.write_vocab_file(derived.derive_vocab_lines(_docs(spark, sf_dir)), work_path(spark, "vocab"))
        return landed(readers.read_vocab(spark, path), "vocab-table")[0]
    return _cached(spark, sf_dir, "vocab", build)


def entries(spark, sf_dir) -> DataFrame:
    return _cached(spark, sf_dir, "entries",
                   lambda: landed(entry.build_entries(raw_examples(spark, sf_dir)), "entries", "zstd")[0])


def eval_prepared(spark, sf_dir) -> DataFrame:
    return _cached(spark, sf_dir, "eval-features", lambda: P.prepare(
        raw_examples(spark, sf_dir), vocab(spark, sf_dir), is_training=False).features)


def train_prepared(spark, sf_dir) -> DataFrame:
    def build():
        return P.prepare(raw_examples(spark, sf_dir), vocab(spark, sf_dir), is_training=True,
                         include_unknowns=0.1).features
    return _cached(spark, sf_dir, "train-features", build)


def results(spark, sf_dir) -> DataFrame:
    return _cached(spark, sf_dir, "results", lambda: model.score_batches(
        eval_prepared(spark, sf_dir), model.arithmetic_scorer))


# -------------------------------------------------------------- scans ---

_BROKEN_RAW = [
    # (id, candidates, annotations) -> expected reason
    (-1, [(0, 5), (-1, -1)], []),                                  # invalid_candidate_offsets
    (-2, [(0, 5)], [(3, -1, -1, "NONE")]),                          # bad_candidate_index
    (-3, [(0, 5), (6, 11)], [(0, 3, 8, "NONE")]),                   # answer_mismatch
    (-4, [], []),                                                   # no_candidates
    (-5, [(0, 5), (5, 5)], [(0, 1, 3, "NONE")]),                    # empty_context
]


#: Valid examples whose answer (empty, reversed, a space) holds no wordpiece.
_FAULTY_RAW = [
    (-6, [(0, 5), (6, 11)], [(0, 3, 3, "NONE")]),
    (-7, [(0, 5), (6, 11)], [(0, 4, 2, "NONE")]),
    (-8, [(0, 11)], [(0, 5, 6, "NONE")]),
]


def _broken_raw(spark, examples=_BROKEN_RAW) -> DataFrame:
    rows = [(i, "english", f"broken {i}", "", "abcde fghij", "q?",
             [(s, e, s, e) for s, e in c], [(None, (ci,), (s, e), yn) for ci, s, e, yn in a])
            for i, c, a in examples]
    from spanqa import schemas
    return spark.createDataFrame(rows, schemas.RAW_EXAMPLE)


#: Lines that are no example, at the end of the literal file of the scan query.
_BROKEN_LINES = ["", "{no json", "[]"]


def _example_files(spark, sf_dir) -> str:
    """Raw examples as JSON lines: a file of 512 consecutive ids each, gzip for every other one, and one with
    literal examples (invalid, or with an answer of no wordpiece) and lines that are no example. The minimal answers of
    ids that end in 7 are empty. Returns a glob."""
    def build():
        path = work_path(spark, "examples-jsonl")
        empty = F.transform("annotations", lambda a: a.withField("minimal_answer.plaintext_end_byte", a[
            "minimal_answer"]["plaintext_start_byte"]))
        rows = derived.raw_examples(_docs(spark, sf_dir)).withColumn("annotations", F.when(
            F.col("example_id") % 10 == 7, empty).otherwise(F.col("annotations"))).select(
            F.expr("example_id div 512").alias("shard"), "example_id", F.to_json(F.struct("*")).alias("value"))
        rows = rows.repartition("shard").sortWithinPartitions("shard", "example_id")
        for k, codec in enumerate(("gzip", "none")):
            rows.where(F.col("shard") % 2 == k).select("shard", "value").write.option("compression", codec).partitionBy(
                "shard").text(f"{path}/{codec}")
        broken = [r.v for r in _broken_raw(spark, _BROKEN_RAW + _FAULTY_RAW).select(F.to_json(F.struct("*")).alias("v")).collect()]
        spark.createDataFrame([(x,) for x in broken + _BROKEN_LINES], "value string").coalesce(1).write.text(
            f"{path}/none/shard=-1")
        return spark.createDataFrame([(f"{path}/*/*",)], "p string")
    return _cached(spark, sf_dir, "example-files", build).first().p


def _shard_of_file():
    return F.regexp_extract("file", "shard=(-?[0-9]+)", 1).cast("bigint").alias("shard")


@query
def q_example_scan(spark, sf_dir):
    """Raw examples scanned from JSONL files (plain and gzip, with literal invalid lines): file,
    line number, id and outcome of every line."""
    e = scan.scan_examples(spark, _example_files(spark, sf_dir)).entries
    return e.select(_shard_of_file(), "line_no", "example_id", F.coalesce("reject_reason", F.lit("ok")).alias("outcome"))


def _scanned_training(spark, sf_dir):
    e = scan.scan_examples(spark, _example_files(spark, sf_dir)).entries
    e = e.withColumn("file", _shard_of_file())  # shard numbers order the files like names
    pr = P.prepare_entries(e, vocab(spark, sf_dir), is_training=True, include_unknowns=1.0)
    return e, pr


@query
def q_preparation_report(spark, sf_dir):
    """What training preparation reports of the scanned files - the first 25 examples and all with errors."""
    e, pr = _scanned_training(spark, sf_dir)
    return scan.preparation_report(e, pr.errors).withColumnRenamed("file", "shard")


@query
def q_error_sample(spark, sf_dir):
    """The first 25 examples of every preparation error, with file and line."""
    e, pr = _scanned_training(spark, sf_dir)
    return scan.error_sample(e, pr.errors).withColumnRenamed("file", "shard")


@query
def q_candidate_scan(spark, sf_dir):
    """Candidates from two files with overlapping ids; the later file
    wins, and ids present in both are reported."""
    base = derived.raw_examples(_docs(spark, sf_dir)).select("example_id", "passage_answer_candidates")
    p1, p2 = work_path(spark, "cands-a"), work_path(spark, "cands-b")
    base.write.json(p1 + "/part-a")
    base.where("example_id % 3 = 0").select(
        "example_id", F.slice("passage_answer_candidates", 1, 1).alias("passage_answer_candidates")).write.json(
        p1 + "/part-b")
    c = readers.read_candidates(spark, p1 + "/part-*")
    allrows = spark.read.schema("example_id BIGINT").json(p1 + "/part-*")
    dups = readers.duplicate_keys(allrows, ["example_id"]).select("example_id", F.lit(True).alias("duplicated"))
    return c.join(dups, "example_id", "left").select(
        "example_id", F.size("passage_answer_candidates").alias("n_candidates"),
        F.coalesce("duplicated", F.lit(False)).alias("duplicated"))


@query
def q_vocab_ids(spark, sf_dir):
    """Vocabulary file (special tokens, markers, characters, frequent
    words, with repeats) -> dense ids in first-occurrence order."""
    return vocab(spark, sf_dir).select("token", "id")


# ------------------------------------------------------ entries/contexts ---

@query
def q_entry_rejects(spark, sf_dir):
    """Entries of all derived articles plus literal invalid ones,
    counted per reject reason."""
    e = entry.build_entries(raw_examples(spark, sf_dir).unionByName(_broken_raw(spark)))
    return e.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n_examples"))


@query
def q_max_examples(spark, sf_dir):
    """T4: the first 100 articles in id order (the preparation limit),
    turned into entries."""
    e = entry.build_entries(P.limit_examples(raw_examples(spark, sf_dir), 100))
    return e.agg(F.count(F.lit(1)).alias("n_entries"), F.min("example_id").alias("first_id"),
                 F.max("example_id").alias("last_id"))


@query
def q_first_annotation(spark, sf_dir):
    """The annotation chosen for training and its local span."""
    raw = raw_examples(spark, sf_dir)
    fa = entry.first_annotation(raw)
    c = F.expr("try_element_at(passage_answer_candidates, CAST(annotated_idx + 1 AS INT))")
    return fa.select("example_id", "annotated_idx", F.col("chosen.i").alias("ann_pos"),
                     F.coalesce("chosen.has_min", F.lit(False)).alias("has_minimal"),
                     F.when(F.col("chosen.has_min"), F.col("chosen.s") - c.plaintext_start_byte)
                     .otherwise(F.lit(-1)).alias("local_start"),
                     F.when(F.col("chosen.has_min"), F.col("chosen.e") - c.plaintext_start_byte)
                     .otherwise(F.lit(-1)).alias("local_end"))


@query
def q_contexts(spark, sf_dir):
    """Contexts string and shifted answer per entry."""
    e = entries(spark, sf_dir)
    return e.select("example_id", F.octet_length("contexts").alias("contexts_bytes"),
                    F.size("segments").alias("n_kept"), "has_correct_context",
                    F.col("answer.span_start").alias("span_start"), F.col("answer.span_end").alias("span_end"),
                    F.col("answer.input_text").alias("input_text"), F.col("answer.span_text").alias("span_text"),
                    entry.candidate_type_and_position(F.col("answer.candidate_id")).alias("type_and_position"))


@query
def q_context_segments(spark, sf_dir):
    """Byte map of the contexts string as segments, with a
    check that every segment's bytes equal the plaintext bytes it maps to."""
    e = entries(spark, sf_dir)
    s = e.select("example_id", "contexts", "plaintext", F.posexplode("segments").alias("i", "g"))
    n = F.col("g.ctx_end") - F.col("g.ctx_start")
    same = (F.substring(F.encode("contexts", "UTF-8"), F.col("g.ctx_start") + 1, n)
            == F.substring(F.encode("plaintext", "UTF-8"), F.col("g.plain_start") + 1, n))
    return s.select("example_id", "i", F.col("g.ctx_start").alias("ctx_start"), F.col("g.ctx_end").alias("ctx_end"),
                    F.col("g.plain_start").alias("plain_start"), same.alias("bytes_equal"))


@query
def q_answer_typing(spark, sf_dir):
    """answer type and byte offsets in the contexts, language id."""
    t = entry.answer_typing(entries(spark, sf_dir).where("reject_reason IS NULL"))
    return t.select("example_id", "answer_type", "start_byte_offset", "end_byte_offset", "language_id")


# ------------------------------------------------------------ characters ---

@query
def q_char_classes(spark, sf_dir):
    """Characters per class in every document, and in literal texts with ideographs and controls."""
    lit = spark.createDataFrame([(-1, "中文abc 字!", "zz"), (-2, "\U00020001\U0002A700\uF900 x", "zz"), (-3, "a\x01\u200b\tb\u3002", "zz")],
                                "doc_id bigint, text string, lang string")
    d = _docs(spark, sf_dir).unionByName(lit)

    def count(cls):
        return F.char_length("text") - F.char_length(F.regexp_replace("text", cls, ""))
    return d.select("doc_id", "lang",
                    count(C.WHITESPACE).alias("n_whitespace"), count(C.CONTROL).alias("n_control"),
                    count(C.PUNCTUATION).alias("n_punctuation"), count(C.CJK).alias("n_cjk"))


@query
def q_text_repair(spark, sf_dir):
    """For every document, the slice from byte 1 to its length - 2
    (which may cut characters, and is empty in texts of under 4 bytes):
    validity check and replacement decoding."""
    d = _docs(spark, sf_dir)
    raw = alignment.cut_bytes("text", F.lit(1), F.greatest(F.octet_length("text") - 3, F.lit(0)))
    return d.select("doc_id", F.is_valid_utf8(raw).alias("valid"),
                    F.octet_length(F.make_valid_utf8(raw)).alias("repaired_bytes"),
                    F.char_length(F.regexp_replace(F.make_valid_utf8(raw), "[^�]", "")).alias("n_replaced"))


@query
def q_bytes_ignored(spark, sf_dir):
    """every document's bytes with the first, the middle two and the last two cut out and a stray byte put in,
    decoded with the broken parts left out."""
    b = F.encode("text", "UTF-8")
    half, n = F.expr("octet_length(text) div 2"), F.octet_length("text")
    raw = F.concat(F.substring(b, F.lit(2), half), F.unhex(F.lit("FF")),
                   F.substring(b, half + 3, F.greatest(n - half - 4, F.lit(0))))
    kept = _docs(spark, sf_dir).select("doc_id", F.octet_length(raw).alias("n"), B.decode_ignoring_errors(raw).alias("kept"))
    return kept.select("doc_id", F.octet_length("kept").alias("n_kept"),
                       (F.col("n") - F.octet_length("kept")).alias("n_dropped"), F.md5(F.hex("kept")).alias("kept_md5"))


@query
def q_accent_free_words(spark, sf_dir):
    """distinct words of all documents without accents (NFD, drop Mn)."""
    words = _docs(spark, sf_dir).select(F.explode(F.split("text", r"[\s\p{Z}]+")).alias("word")).where(
        "word <> ''").distinct()
    return words.select("word", C.strip_accents("word").alias("stripped"))


# ------------------------------------------------------------ tokenizing ---

@query
def q_space_tokens(spark, sf_dir):
    """Single-space tokens (empty ones kept) and whitespace tokens."""
    d = _docs(spark, sf_dir)
    toks = tokenize.text_tokens(d.select(F.col("doc_id"), F.col("text")), ["doc_id"])
    per = toks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_space_tokens"),
                                     F.count_if(F.col("token") == "").alias("n_empty"),
                                     F.sum("tok_bytes").alias("token_bytes"))
    ws = d.select("doc_id", F.size(F.filter(F.split(F.trim("text"), r"[\s\p{Z}]+"),
                                            lambda x: x != "")).alias("n_whitespace_tokens"))
    return per.join(ws, "doc_id")


@query
def q_basic_tokens(spark, sf_dir):
    """Offset-preserving basic split of every distinct space token of
    the documents plus literal control/CJK/zero-width tokens."""
    d = _docs(spark, sf_dir)
    lit = spark.createDataFrame([("a\x00b",), ("x中y",), ("ab,c\td​e!",), ("\x01\x02",), ("",)],
                                "token string")
    toks = tokenize.text_tokens(d.select("doc_id", "text"), ["doc_id"]).select("token").unionByName(lit).distinct()
    sp = toks.select("token", F.expr(tokenize.basic_split_expr("token")).alias("p"))
    return sp.select("token", F.array_join(F.transform("p", lambda x: x["piece"]), "|").alias("pieces"),
                     F.size(F.filter("p", lambda x: ~x["good"])).alias("n_bad"))


@query
def q_basic_tokens_cjk(spark, sf_dir):
    """The same split with every ideograph a piece of its own, with byte offsets, over the documents' tokens and
    literal ones."""
    lit = spark.createDataFrame([("x中y文",), ("中文,字",), ("é日\x00本",), ("\U00020001a",), ("",)], "token string")
    toks = tokenize.text_tokens(_docs(spark, sf_dir), ["doc_id"]).select("token").unionByName(lit).distinct()
    sp = toks.select("token", F.expr(tokenize.basic_split_expr("token", isolate_cjk=True)).alias("p"))
    ends = F.expr("aggregate(p, named_struct('at', 0, 'out', CAST(array() AS ARRAY<INT>)), (a, x) -> named_struct('at', "
                  "a.at + octet_length(x.piece), 'out', concat(a.out, array(a.at + octet_length(x.piece))))).out")
    return sp.select("token", F.array_join(F.transform("p", lambda x: x["piece"]), "|").alias("pieces"),
                     F.array_join(ends.cast("array<string>"), ",").alias("ends"))


@query
def q_wordpieces(spark, sf_dir):
    """Greedy longest-match wordpieces of every distinct word
    (good run) of the documents against the derived vocabulary."""
    v = vocab(spark, sf_dir)
    d = _docs(spark, sf_dir)
    toks = tokenize.text_tokens(d.select("doc_id", "text"), ["doc_id"]).select("token").distinct()
    words = toks.select(F.explode(F.expr(tokenize.basic_split_expr("token"))).alias("p")).where("p.good").select(
        F.col("p.piece").alias("word")).distinct()
    wp = tokenize.wordpiece_words(words, v)
    inv = v.select(F.col("id").alias("pid"), F.col("token").alias("piece"))
    ex = wp.select("word", F.posexplode("wps").alias("k", "w")).select("word", "k", F.col("w.id").alias("pid"))
    named = tokenize.join_dimension(ex, inv, ["pid"], name="inv-vocab")
    return named.groupBy("word").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "piece"))),
                                                              lambda x: x["piece"]), " ").alias("pieces"))


@query
def q_basic_tokens_destructive(spark, sf_dir):
    """Destructive basic tokenizer (clean, CJK padding,
    whitespace split, lower case, accents stripped, punctuation split) over
    every distinct whitespace token of the documents."""
    d = _docs(spark, sf_dir)
    words = d.select(F.explode(tokenize.destructive_clean_split("text")).alias("word")).distinct()
    dw = tokenize.destructive_word_tokens(words, lower=True, vocab=vocab(spark, sf_dir), preserve_unused=True)
    return dw.select("word", F.array_join("tokens", " ").alias("tokens"))


@query
def q_full_tokenizer(spark, sf_dir):
    """Destructive tokenizer + wordpieces for every document: count and digest of the ids in order, and
    of the tokens they stand for (both directions of the vocabulary)."""
    d = _docs(spark, sf_dir)
    v = vocab(spark, sf_dir)
    ft = tokenize.full_tokenize(d.select("doc_id", "text"), v, ["doc_id"])
    named = tokenize.tokens_of_ids(ft.where("doc_id IS NOT NULL"), v, ["doc_id"])
    return named.select("doc_id", F.size("ids").alias("n_pieces"), _digest("ids").alias("ids_md5"),
                        F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def _digest(array: str) -> Column:
    @F.arrow_udf("string")
    def digest(lists: pa.Array, _: pa.Array) -> pa.Array:
        return digests(lists)
    return digest(*made_before(array))


def _count(array: str, of) -> Column:
    """For every list of ``array`` the sum of what the function ``of`` makes of its values."""
    @F.arrow_udf("bigint")
    def count(lists: pa.Array, _: pa.Array) -> pa.Array:
        return sums(lists, of(values(lists)))
    return count(*made_before(array))


@query
def q_tokens_with_offsets(spark, sf_dir):
    """Wordpieces of every entry's contexts with byte
    offsets; per example the count and digests of the ids, starts and ends in order."""
    e = entries(spark, sf_dir).where("reject_reason IS NULL")
    tt = tokenize.tokenize_texts(e.select("example_id", F.col("contexts").alias("text")), vocab(spark, sf_dir),
                                 ["example_id"])
    return tt.select("example_id", F.size("wp_ids").alias("n_wordpieces"),
                     _digest("wp_ids").alias("ids_md5"), _digest("wp_starts").alias("starts_md5"),
                     _digest("wp_ends").alias("ends_md5"))


@query
def q_offset_mismatch(spark, sf_dir):
    """Bytes of each token not covered by its wordpieces, per document."""
    d = _docs(spark, sf_dir)
    toks = tokenize.text_tokens(d.select("doc_id", "text"), ["doc_id"])
    pieces = tokenize.token_pieces(toks, vocab(spark, sf_dir))
    # few tokens differ, if any: only they are joined
    mm = tokenize.token_mismatch(pieces).where("mismatch_bytes <> 0")
    j = tokenize.join_dimension(toks.select("doc_id", "token").where("token IS NOT NULL"), mm, ["token"], name="mismatch",
                                how="left").fillna(0, ["mismatch_bytes"])
    return j.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"),
                                   F.count_if(F.col("mismatch_bytes") != 0).alias("n_mismatched"),
                                   F.sum(F.abs("mismatch_bytes")).alias("mismatch_bytes"))


# ------------------------------------------------------- windows/features ---

@query
def q_doc_windows(spark, sf_dir):
    """Sliding windows over the space tokens of every document
    (width 384 - 3 - question tokens of the first line, stride 128)."""
    d = _docs(spark, sf_dir).select(
        "doc_id", F.size(F.split("text", " ", -1)).alias("n"),
        (F.lit(381) - F.least(F.lit(64), F.size(F.split(F.substring_index("text", "\n", 1), " ", -1)))).alias("width"))
    w = d.select("doc_id", "n", "width", F.posexplode(F.expr(features.windows_expr("n", "width", 128))).alias("k", "w"))
    return w.select("doc_id", "k", F.col("w.start").alias("start"), F.col("w.length").alias("length"))


@query
def q_nearest_wordpiece(spark, sf_dir):
    """Nearest wordpieces of every training answer span."""
    e = entry.answer_typing(entries(spark, sf_dir).where("reject_reason IS NULL"))
    e = e.where("example_id IS NOT NULL")
    span = ["start_byte_offset", "end_byte_offset"]
    j = tokenize.tokenize_texts(e.select("example_id", F.col("contexts").alias("text"), *span), vocab(spark, sf_dir),
                                ["example_id"], carry=span)
    return j.select("example_id",
                    F.expr(features.has_wordpiece("wp_starts", "wp_ends", "start_byte_offset", "end_byte_offset"))
                    .alias("has_wordpiece"),
                    F.expr(features.nearest_right("wp_starts", "wp_ends", "start_byte_offset")).alias("wp_start"),
                    F.expr(features.nearest_left("wp_starts", "wp_ends", "end_byte_offset - 1")).alias("wp_end"))


@query
def q_features(spark, sf_dir):
    """Evaluation features (all windows) - one row per window, arrays as digests of their values."""
    f = eval_prepared(spark, sf_dir)
    return f.select("unique_ids", "example_index", "doc_span_index", "language_id",
                    _digest("input_ids").alias("ids_md5"), _digest("wp_start_offset").alias("starts_md5"),
                    _digest("wp_end_offset").alias("ends_md5"),
                    _count("input_mask", lambda x: x).alias("n_real"), _count("segment_ids", lambda x: x).alias("n_doc"),
                    _count("wp_start_offset", lambda x: x >= 0).cast("int").alias("n_mapped"))


@query
def q_window_labels(spark, sf_dir):
    """Training features (negatives sampled at 0.1)."""
    f = train_prepared(spark, sf_dir)
    return f.select("unique_ids", "example_index", "doc_span_index", "start_positions", "end_positions",
                    "answer_types")


@query
def q_window_labels_all(spark, sf_dir):
    """Labels of all training windows (no negative left out)."""
    f = _cached(spark, sf_dir, "train-all", lambda: P.prepare(
        raw_examples(spark, sf_dir), vocab(spark, sf_dir), is_training=True, include_unknowns=1.0).features)
    return f.select("unique_ids", "example_index", "doc_span_index", "start_positions", "end_positions", "answer_types")


@query
def q_window_labels_positive(spark, sf_dir):
    """Labels of the training windows when every negative one is left out (rate below 0)."""
    f = P.prepare(raw_examples(spark, sf_dir), vocab(spark, sf_dir), is_training=True, include_unknowns=-1.0).features
    return f.select("unique_ids", "example_index", "doc_span_index", "start_positions", "end_positions", "answer_types")


@query
def q_feature_histogram(spark, sf_dir):
    """Number of evaluation features per example, as a histogram."""
    return features.features_per_example(eval_prepared(spark, sf_dir),
                                         entries(spark, sf_dir).where("reject_reason IS NULL"))


@query
def q_feature_roundtrip(spark, sf_dir):
    """Features read back with the declared fixed-length columns;
    record count and rows of another length."""
    f = eval_prepared(spark, sf_dir)
    path = work_path(spark, "features-rt")
    f.write.parquet(path, compression="zstd")
    back = readers.read_features(spark, path, 512, is_training=False)
    return back.agg(F.count(F.lit(1)).alias("n_records"),
                    F.count_if(F.size("input_ids") != 512).alias("n_bad_length"),
                    F.countDistinct("example_index").alias("n_examples"))


# ------------------------------------------------------ sampling / shards ---

@query
def q_lang_counts(spark, sf_dir):
    """A10: examples per language."""
    return training.language_ratios(raw_examples(spark, sf_dir)).select("language", "n_examples")


@query
def q_oversample_ratio(spark, sf_dir):
    """Oversampling ratio per language int(min(10, max count / count))."""
    return training.language_ratios(raw_examples(spark, sf_dir))


@query
def q_oversampled(spark, sf_dir):
    """T5: every feature repeated by its language's ratio; rows and copies per language."""
    o = training.oversample(eval_prepared(spark, sf_dir), training.language_ratios(raw_examples(spark, sf_dir)))
    return o.groupBy("language_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("copy").alias("n_copies"))


@query
def q_shuffled(spark, sf_dir):
    """Features in a repeatable pseudo-random order (hash of ids and seed)."""
    f = eval_prepared(spark, sf_dir).select("unique_ids", "example_index", "doc_span_index")
    return training.shuffled(f, ["example_index", "doc_span_index"], 12345).orderBy("position").drop("position")


@query
def q_shards(spark, sf_dir):
    """Features written in shards of 64 examples and read back; per shard the counts of the sink, the
    files, and the features that batches of 16 keep (features in id order, a short last batch dropped)."""
    path = work_path(spark, "shards")
    counts = training.write_shards(eval_prepared(spark, sf_dir), path, 64)
    back = spark.read.parquet(path).select(F.col("shard").cast("long").alias("shard"), "example_index",
                                           "doc_span_index", F.input_file_name().alias("file"))
    files = back.groupBy("shard").agg(F.countDistinct("file").alias("n_files"))
    kept = training.batches(readers.dense_index(back, ["example_index", "doc_span_index"], "position"), 16)
    return counts.join(files, "shard", "left").join(
        kept.groupBy("shard").agg(F.count(F.lit(1)).alias("n_batched")), "shard", "left").fillna(0, ["n_batched"])


@query
def q_buffer_shuffled(spark, sf_dir):
    """Evaluation features in id order, two epochs, drawn through a buffer of 100, in whole batches of 32."""
    f = readers.dense_index(eval_prepared(spark, sf_dir).select("example_index", "doc_span_index"),
                            ["example_index", "doc_span_index"], "position")
    s = training.buffer_shuffled(training.repeated(f, 2), 100, 7)
    return training.batches(s, 32).select("position", "position_before", "epoch", "example_index", "doc_span_index", "batch")


# ------------------------------------------------------------- assembly ---

def _stand_in_windows(spark, sf_dir) -> DataFrame:
    """Windows over the space tokens of each document used as stand-in
    features for the merge operators: (example_index, doc_span_index, unique_ids)."""
    w = q_doc_windows(spark, sf_dir)
    return w.select(F.col("doc_id").alias("example_index"), F.col("k").alias("doc_span_index"),
                    (F.col("doc_id") + F.col("k")).alias("unique_ids"))


@query
def q_asof_merge(spark, sf_dir):
    """As-of merge of examples, features and results on ids
    (features keyed unique_id + 1); result/feature counts per example."""
    ex = _docs(spark, sf_dir).select(F.col("doc_id").alias("example_id"))
    fw = _stand_in_windows(spark, sf_dir)
    res = fw.where("(example_index + doc_span_index) % 7 <> 0").select(F.col("unique_ids").alias("unique_id"))
    m = assemble.asof_merge(ex, fw, res)
    return m.groupBy("example_id").agg(F.count_if(F.col("source") == "feature").alias("n_features"),
                                       F.count_if(F.col("source") == "result").alias("n_results"))


@query
def q_complete_examples(spark, sf_dir):
    """Examples whose windows all have exactly one result."""
    fw = _stand_in_windows(spark, sf_dir)
    res = fw.where("(example_index + doc_span_index) % 7 <> 0")
    return assemble.complete_examples(fw, res).select("example_index", "n_features", "n_results", "complete")


@query
def q_score_batches(spark, sf_dir):
    """The batch scorer over every evaluation feature."""
    r = results(spark, sf_dir)
    return r.select("example_index", "doc_span_index", F.col("start_logits")[1].alias("start_1"),
                    F.col("end_logits")[1].alias("end_1"), F.col("answer_type_logits")[4].alias("type_4"))


@query
def q_nbest(spark, sf_dir):
    """The 30 best start and end indexes of every result window."""
    r = results(spark, sf_dir)
    nb = assemble.nbest(assemble.nbest(r, "start_logits", 30, "sb"), "end_logits", 30, "eb")
    return nb.select("example_index", "doc_span_index",
                     F.array_join(assemble.nbest_indexes("sb"), ",").alias("start_indexes"),
                     F.array_join(assemble.nbest_indexes("eb"), ",").alias("end_indexes"))


@query
def q_span_candidates(spark, sf_dir):
    """Valid span pairs and the best pair of every window."""
    wb = assemble.window_best_spans(eval_prepared(spark, sf_dir), results(spark, sf_dir))
    return wb.select("example_index", "doc_span_index", "n_valid", r9("best.score").alias("score"),
                     F.col("best.start_byte").alias("start_byte"), F.col("best.end_byte").alias("end_byte"))


@query
def q_best_span(spark, sf_dir):
    """Best span of every complete example."""
    f, r = eval_prepared(spark, sf_dir), results(spark, sf_dir)
    best = assemble.complete_best_spans(f, r)
    return best.select("example_index", r9("score").alias("score"), "doc_span_index", "start_byte", "end_byte")


@query
def q_predictions(spark, sf_dir):
    """Prediction records written as JSONL and read back."""
    f, r = eval_prepared(spark, sf_dir), results(spark, sf_dir)
    cands = readers.read_candidates(spark, _candidates_file(spark, sf_dir))
    rec = PR.assemble_predictions(f, r, cands)
    path = work_path(spark, "predictions")
    PR.write_predictions(rec, path)
    back = readers.read_predictions(spark, path)
    return back.select("example_id", "language", "passage_answer_index", "minimal_start_byte", "minimal_end_byte",
                       "yes_no_answer", r9("passage_score").alias("score"))


def _candidates_file(spark, sf_dir) -> str:
    def build():
        path = work_path(spark, "candidates")
        raw_examples(spark, sf_dir).select("example_id", "passage_answer_candidates").write.json(path)
        return spark.createDataFrame([(path,)], "p string")
    return _cached(spark, sf_dir, "cands-file", build).first().p


@query
def q_passage_of_span(spark, sf_dir):
    """For a 3-byte span at the start of each document's second paragraph
    (the first when there is only one), the first candidate containing it;
    0 when none does."""
    raw = raw_examples(spark, sf_dir)
    s = raw.select("example_id", "passage_answer_candidates",
                   F.coalesce(F.col("passage_answer_candidates")[F.least(F.size("passage_answer_candidates") - 1,
                                                                        F.lit(1))].plaintext_start_byte,
                              F.lit(0)).alias("s"))
    s = s.withColumn("e", F.col("s") + 3)
    return s.select("example_id", "s", "e", F.expr(assemble.passage_of_span_expr(
        "passage_answer_candidates", "s", "e")).alias("passage_index"))


# ----------------------------------------------------------- gold passage ---

# --- fixed value: gold-passage text in one JSON file, about -----------------
GOLDP_FILE_BYTES = 1 << 20


def _one_file_a_group(rows: DataFrame, n_bytes: Column, deal_by: Column, document: Column, name: str) -> str:
    """Rows dealt by the hash of ``deal_by`` into groups of about ``GOLDP_FILE_BYTES`` and written, one file a group, so
    that files grow with the bytes and not with the ids; returns the folder above them. ``document``: the text of a group."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(n_bytes).alias("n")).first().n or 0
    n = max(1, -(-total // GOLDP_FILE_BYTES))
    path = work_path(spark, name)
    rows.withColumn("bucket", F.pmod(F.xxhash64(deal_by), F.lit(n))).groupBy("bucket").agg(document.alias("value")).select(
        "value").write.option("maxRecordsPerFile", 1).text(path + "/files")
    return path


def _goldp_inputs(spark, sf_dir):
    """Stand-in gold-passage data: for each article whose chosen annotation
    has a minimal answer, one question over the annotated paragraph with the
    minimal-answer texts of all annotators on it; predictions = the derived
    predicted span text. Both written as JSON in the SQuAD / id-map shapes,
    one document a file, in files of bounded size."""
    def build():
        raw = raw_examples(spark, sf_dir)
        fa = entry.first_annotation(raw).where("chosen.has_min").withColumn("pt", F.encode("document_plaintext", "UTF-8"))
        c = F.expr("passage_answer_candidates[CAST(annotated_idx AS INT)]")
        q = fa.select(
            "example_id", "language", "document_title", "question_text", "annotations", "annotated_idx", "pt",
            F.make_valid_utf8(F.substring("pt", c.plaintext_start_byte + 1,
                                          c.plaintext_end_byte - c.plaintext_start_byte).cast("string")).alias("context"),
            c.plaintext_start_byte.alias("cs"))
        ans = F.transform(F.filter("annotations", lambda a: (a["passage_answer"]["candidate_index"] == F.col(
            "annotated_idx")) & (a["minimal_answer"]["plaintext_start_byte"] >= 0)), lambda a: F.struct(
            F.make_valid_utf8(F.substring("pt", a["minimal_answer"]["plaintext_start_byte"] + 1,
                                          a["minimal_answer"]["plaintext_end_byte"]
                                          - a["minimal_answer"]["plaintext_start_byte"]).cast("string")).alias("text"),
            F.char_length(F.make_valid_utf8(F.substring("pt", F.col("cs") + 1,
                                                        a["minimal_answer"]["plaintext_start_byte"] - F.col("cs"))
                                            .cast("string"))).cast("bigint").alias("answer_start")))
        qa = F.struct(F.concat("language", F.lit("-"), F.col("example_id").cast("string")).alias("id"),
                      F.col("question_text").alias("question"), ans.alias("answers"))
        articles = landed(q.select(F.to_json(F.struct(
            F.col("document_title").alias("title"),
            F.array(F.struct("context", F.array(qa).alias("qas"))).alias("paragraphs"))).alias("article")),
            "goldp-articles", "zstd")[0]
        # an article may lie in any file: dealt by its place, so that copies don't meet in one
        dpath = _one_file_a_group(
            articles, F.octet_length("article"), F.monotonically_increasing_id(),
            F.concat(F.lit('{"data":['), F.array_join(F.collect_list("article"), ","), F.lit('],"version":"1.1"}')),
            "goldp-dataset")
        preds = readers.normalize_predictions(derived.with_scan_ordinal(derived.predictions(_docs(spark, sf_dir))))
        # written before they are filtered: a filter on the spans would go below the steps that cut them, and repeat those
        preds = landed(preds.select("example_id", "language", "minimal_start_byte", "minimal_end_byte"), "goldp-spans")[0]
        texts = raw.select("example_id", "document_plaintext")
        # the narrow side is hashed, so that no text is sorted
        pj = texts.join(preds.where("minimal_start_byte >= 0").hint("shuffle_hash"), "example_id").select(
            F.concat("language", F.lit("-"), F.col("example_id").cast("string")).alias("id"),
            F.make_valid_utf8(F.substring(F.encode("document_plaintext", "UTF-8"), F.col("minimal_start_byte") + 1,
                                          F.col("minimal_end_byte") - F.col("minimal_start_byte"))
                              .cast("string")).alias("answer"))
        answers = landed(pj, "goldp-answers", "zstd")[0]
        # a map's ids differ: dealt by id, so that an id that comes twice is still found
        ppath = _one_file_a_group(
            answers, F.octet_length("id") + F.octet_length("answer"), F.col("id"),
            F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "answer")))), "goldp-preds")
        return spark.createDataFrame([(dpath, ppath)], "d string, p string")
    r = _cached(spark, sf_dir, "goldp", build).first()
    return r.d, r.p


@query
def q_goldp_scan(spark, sf_dir):
    """Gold-passage prediction maps read and validated."""
    _, ppath = _goldp_inputs(spark, sf_dir)
    p = goldp.with_language(readers.read_goldp_predictions(spark, ppath + "/*"))
    return p.select("id", "answer", "language", "error")


@query
def q_goldp_split(spark, sf_dir):
    """Predictions split into one folder per language label; rows
    per label read back from the written folders."""
    _, ppath = _goldp_inputs(spark, sf_dir)
    p = readers.read_goldp_predictions(spark, ppath + "/*")
    out = work_path(spark, "goldp-split")
    goldp.write_split(p.where(F.split("id", "-")[0].isin(GOLDP_LANGUAGES)), out)
    back = spark.read.json(out)
    return back.groupBy("lang_label").agg(F.count(F.lit(1)).alias("n_answers"))


@query
def q_goldp_exact_f1(spark, sf_dir):
    """SQuAD exact match / F1 of every gold-passage question."""
    dpath, ppath = _goldp_inputs(spark, sf_dir)
    ds = readers.read_goldp_dataset(spark, dpath + "/*")
    s = goldp.squad_scores(ds, readers.read_goldp_predictions(spark, ppath + "/*"))
    return s.select("id", r9("exact_match").alias("exact_match"), r9("f1").alias("f1"))


@query
def q_goldp_macro(spark, sf_dir):
    """Per-language means and the non-English macro average."""
    dpath, ppath = _goldp_inputs(spark, sf_dir)
    ds = readers.read_goldp_dataset(spark, dpath + "/*")
    per = goldp.language_scores(goldp.squad_scores(ds, readers.read_goldp_predictions(spark, ppath + "/*")))
    per = landed(per, "goldp-languages")[0]  # scored once for both parts
    m = goldp.macro(per)
    return per.select("language", "n", r9("exact_match").alias("exact_match"), r9("f1").alias("f1")).unionByName(
        m.select(F.lit("macro").alias("language"), F.col("n_languages").cast("bigint").alias("n"),
                 r9("avg_exact_match").alias("exact_match"), r9("avg_f1").alias("f1")))


@query
def q_alignment_report(spark, sf_dir):
    """20-byte slices of every valid entry's contexts with the
    plaintext they map to and the wordpieces starting in them."""
    e = entries(spark, sf_dir).where("reject_reason IS NULL")
    return alignment.slice_report(e, None, vocab(spark, sf_dir)).select(
        "example_id", "at", "whole_chars", "plain_at", "n_wordpieces", "wordpieces",
        (F.col("plain_at") < 0).alias("unmapped"))


@query
def q_answer_context(spark, sf_dir):
    """Gold answer of every valid entry with 100 bytes on each side."""
    return alignment.answer_context(entries(spark, sf_dir).where("reject_reason IS NULL"))
