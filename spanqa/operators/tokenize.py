"""Offset-preserving wordpiece tokenization as a Spark job.

texts --split on ' '--> tokens (X3) --basic split (X4-X9)--> words --greedy
  longest match against the vocabulary's trie (J11, X10)--> pieces (X11)
  --> running byte offsets per text (W5) --> wordpieces with inclusive byte
  ranges (X12, J10, P17).

With a vocabulary that fits a task (``MAX_VOCAB_BYTES``) all of it happens in the text's row: an Arrow function
matches the distinct tokens of a batch and puts the texts together by array operations, so nothing is shuffled.
With a larger one, and for texts that share their key, the same steps are joins: distinct tokens and words are
tokenized, and tokens meet their pieces in a size-checked broadcast or a shuffle join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanqa.constants import (CONTINUATION_PREFIX, MAX_INPUT_CHARS_PER_WORD, SPECIAL_TOKEN_PREFIXES, SPECIAL_TOKENS,
                              UNK_TOKEN, UNUSED_TOKEN_PATTERN)
from spanqa.functions.chars import (BAD, CJK, NEITHER, NOT_PUNCTUATION, NOT_SPLIT_SPACE, PUNCTUATION, SPLIT_SPACE,
                                   WHITESPACE, strip_accents)
from spanqa.functions.longest_match import LongestMatch
from spanqa.functions.piece_table import PieceTable, char_classes
from spanqa.operators.joins import join_dimension, landed

#: A vocabulary up to this size on disk is collected for the trie (a model's vocabulary is a few megabytes).
MAX_VOCAB_BYTES = 16 * 1024 * 1024


# ------------------------------------------------------------ vocabulary ---

def write_vocab_file(lines: DataFrame, path: str) -> str:
    """One token per line, in (section, key, token) order, as a single text file."""
    lines.orderBy("sec", "k", "line").select("line").coalesce(1).write.mode("overwrite").text(path)
    return path


def special_token_errors(vocab: DataFrame) -> DataFrame:
    """Special tokens of the fixed list missing from the vocabulary."""
    spark = vocab.sparkSession
    need = spark.createDataFrame([(t,) for t in dict.fromkeys(SPECIAL_TOKENS)], "token string")
    return need.join(vocab, "token", "left_anti")


# ---------------------------------------------------------------- texts ---

def text_tokens(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Split on single spaces keeping empty tokens, with position and bytes."""
    return texts.select(*keys, F.posexplode(F.split("text", " ", -1)).alias("tok_pos", "token")).withColumn(
        "tok_bytes", F.octet_length("token"))


def is_special_token(col="token"):
    """Listed special token or a paragraph / context marker."""
    c = F.col(col) if isinstance(col, str) else col
    cond = c.isin(SPECIAL_TOKENS)
    for p in SPECIAL_TOKEN_PREFIXES:
        cond = cond | c.startswith(p)
    return cond


def basic_split_expr(col: str = "token", isolate_cjk: bool = False) -> str:
    """X4-X9 (offset-preserving basic tokenizer) on one whitespace-free token.

    Per run between split-space characters: its bad characters first (they are
    emitted before the pending run, which keeps merging across them), then the
    remaining run split around punctuation. CJK characters are not split (the
    isolation step is undone by the run merging) unless ``isolate_cjk`` is set (X7): then each is a piece of its own.
    Returns array<struct<piece: string, good: boolean>> covering every character.
    """
    seg = f"r'({SPLIT_SPACE}|{NOT_SPLIT_SPACE}+)'"
    parts = f"{PUNCTUATION}|{CJK}|{NEITHER}+" if isolate_cjk else f"{PUNCTUATION}|{NOT_PUNCTUATION}+"
    return (
        f"flatten(transform(regexp_extract_all({col}, {seg}, 1), s -> concat("
        f"transform(regexp_extract_all(s, r'({BAD})', 1), b -> named_struct('piece', b, 'good', false)), "
        f"transform(regexp_extract_all(regexp_replace(s, r'{BAD}', ''), r'({parts})', 1), "
        "x -> named_struct('piece', x, 'good', true)))))"
    )


def wordpiece_words(words: DataFrame, vocab: DataFrame, max_chars: int = MAX_INPUT_CHARS_PER_WORD,
                    max_vocab_bytes: int = MAX_VOCAB_BYTES) -> DataFrame:
    """J11 + X10: greedy longest-match-first wordpieces of distinct words.

    words: (word). Returns (word, wps array<struct<id: bigint, nbytes: int>>). Continuations are looked up with the
    ``##`` prefix. Words longer than ``max_chars`` characters, or with a position no piece matches, become
    one [UNK] piece. The vocabulary's trie goes to the tasks; a vocabulary of over ``max_vocab_bytes`` on disk
    is joined instead.
    """
    vocab, nbytes = landed(vocab.select("token", "id"), "vocab")
    if nbytes > max_vocab_bytes:
        return _wordpieces_joined(words, vocab, max_chars)
    unk = vocab_id_of(vocab, UNK_TOKEN)
    match = LongestMatch([(r.token, r.id) for r in vocab.collect()], CONTINUATION_PREFIX)
    shared = words.sparkSession.sparkContext.broadcast(match)
    return words.select("word").mapInArrow(lambda batches: shared.value.batches(batches, unk, max_chars),
                                           "word string, wps array<struct<id: bigint, nbytes: int>>")


def _wordpieces_joined(words: DataFrame, vocab: DataFrame, max_chars: int) -> DataFrame:
    """`wordpiece_words` for a vocabulary of any size: the substrings of a word up to the longest piece are joined
    with it, and the longest match of every start becomes an entry of the word's map that a walk follows."""
    text = F.when(F.col("token").startswith(CONTINUATION_PREFIX), F.greatest(
        F.char_length("token") - len(CONTINUATION_PREFIX), F.lit(1))).otherwise(F.char_length("token"))
    longest_piece = int(vocab.agg(F.max(text)).first()[0] or 1)
    unk_id = vocab_id_of(vocab, UNK_TOKEN)
    w = words.select("word", F.char_length("word").alias("m"))
    subs = (w.where((F.col("m") > 0) & (F.col("m") <= max_chars))
            .select("word", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("s"), "m")
            .select("word", "s", F.explode(F.sequence(F.col("s") + 1, F.least("m", F.col("s") + longest_piece
                                                                              + len(CONTINUATION_PREFIX)))).alias("e"))
            .withColumn("piece", F.concat(F.when(F.col("s") > 0, F.lit(CONTINUATION_PREFIX)).otherwise(F.lit("")),
                                          F.expr("substring(word, s + 1, e - s)"))))
    hits = join_dimension(subs, vocab.select(F.col("token").alias("piece"), "id"), ["piece"], name="vocab")
    longest = hits.groupBy("word", "s").agg(F.max(F.struct("e", "id")).alias("b"))
    nxt = longest.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("s", "b"))).alias("nxt"))
    walk = (
        "aggregate(sequence(1, m), named_struct('pos', 0, 'fail', false, "
        "'out', CAST(array() AS ARRAY<STRUCT<s: INT, e: INT, id: BIGINT>>)), "
        "(acc, step) -> IF(acc.fail OR acc.pos >= m, acc, "
        "  aggregate(array(try_element_at(nxt, acc.pos)), acc, (a2, b) -> IF(b IS NULL, "
        "    named_struct('pos', a2.pos, 'fail', true, 'out', a2.out), "
        "    named_struct('pos', b.e, 'fail', false, 'out', concat(a2.out, "
        "      array(named_struct('s', a2.pos, 'e', b.e, 'id', b.id))))))))"
    )
    walked = w.join(nxt, "word", "left").withColumn("_w", F.expr(
        f"IF(nxt IS NULL OR m > {int(max_chars)} OR m = 0, NULL, {walk})"))
    out = walked.withColumn("wps", F.expr(
        f"IF(_w IS NULL OR _w.fail, array(named_struct('id', {unk_id}L, 'nbytes', octet_length(word))), "
        "transform(_w.out, b -> named_struct('id', b.id, 'nbytes', octet_length(substring(word, b.s + 1, b.e - b.s)))))"))
    return out.select("word", "wps")


def vocab_id_of(vocab: DataFrame, token: str) -> int:
    """Id of one required token (a single value); fails when it is missing."""
    row = vocab.where(F.col("token") == token).select("id").first()
    if row is None:
        raise ValueError(f"Unrecognized special token: '{token}'")
    return int(row.id)


def piece_table(vocab: DataFrame, max_chars: int = MAX_INPUT_CHARS_PER_WORD, isolate_cjk: bool = False,
                max_vocab_bytes: int = MAX_VOCAB_BYTES):
    """Broadcast of the table that tokenizes texts inside the tasks; None if the vocabulary is too large for it."""
    vocab, nbytes = landed(vocab.select("token", "id"), "vocab") if getattr(vocab, "_landed_bytes", None) is None else (
        vocab, vocab._landed_bytes)
    if nbytes > max_vocab_bytes:
        return None
    unk, rows = vocab_id_of(vocab, UNK_TOKEN), [(r.token, r.id) for r in vocab.select("token", "id").collect()]
    spark = vocab.sparkSession
    return spark.sparkContext.broadcast(PieceTable(
        rows, LongestMatch(rows, CONTINUATION_PREFIX), char_classes(spark), unk, max_chars, SPECIAL_TOKENS,
        SPECIAL_TOKEN_PREFIXES, isolate_cjk))


def text_pieces(table, marker_prefix: str | None = None) -> Callable[[str], Column]:
    """Column function: the wordpieces of a text as a struct of arrays (ids, starts, ends, segs). They leave the task's
    function a few texts at a time, so that a batch of long texts isn't held in pieces."""
    @F.arrow_udf("struct<ids: array<bigint>, starts: array<bigint>, ends: array<bigint>, segs: array<int>>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from table.value.texts(texts, marker_prefix)
    return pieces


def repeated_texts(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame] | None:
    """Rows whose key occurs once and the others (a null is a key); None if no key repeats. Only keys are shuffled
    to find out."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    twice = landed(counts.select(*[F.col(k).alias(f"_again_{i}") for i, k in enumerate(keys)]), "repeated-keys")[0]
    if twice.isEmpty():
        return None
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_again_{i}")) for i, k in enumerate(keys)])
    return rows.join(twice, same, "left_anti"), rows.join(twice, same, "left_semi")


def token_pieces(tokens: DataFrame, vocab: DataFrame, max_chars: int = MAX_INPUT_CHARS_PER_WORD,
                 preserve_unused: bool = False, isolate_cjk: bool = False) -> DataFrame:
    """Wordpieces of every distinct whitespace token.

    Returns (token, pieces array<struct<id: bigint, rel_start: int, nbytes: int>>)
    where rel_start is the byte offset of the piece inside the token (pieces
    cover the token's bytes in emission order). Special tokens map to their
    own vocabulary id as one piece (a missing one fails the job); bad
    characters and unmatched words map to [UNK] unless the vocabulary has them.
    """
    table = None if preserve_unused else piece_table(vocab, max_chars, isolate_cjk)
    if table is None:
        return _token_pieces_joined(tokens, vocab, max_chars, preserve_unused, isolate_cjk)

    @F.arrow_udf("array<struct<id: bigint, rel_start: int, nbytes: int>>")
    def pieces(distinct: pa.Array) -> pa.Array:
        return table.value.tokens(distinct)
    return tokens.select("token").where("token IS NOT NULL").distinct().withColumn("pieces", pieces("token"))


def _token_pieces_joined(tokens: DataFrame, vocab: DataFrame, max_chars: int, preserve_unused: bool = False,
                         isolate_cjk: bool = False) -> DataFrame:
    """`token_pieces` by joins, for a vocabulary of any size."""
    unk_id = vocab_id_of(vocab, UNK_TOKEN)
    # combined before the shuffle, landed once, read by every branch below
    distinct = landed(tokens.select("token").distinct(), "tokens")[0]
    whole = is_special_token()
    if preserve_unused:  # a token like [unused7] that the vocabulary has stays whole
        unused = vocab.where(F.col("token").rlike(UNUSED_TOKEN_PATTERN)).select("token", F.lit(True).alias("_in"))
        distinct = join_dimension(distinct, unused, ["token"], name="unused", how="left")
        whole = whole | F.col("_in").isNotNull()
    special = distinct.where(whole).select("token")
    plain = distinct.where(~whole).select("token")
    sub = plain.select("token", F.posexplode(F.expr(basic_split_expr("token", isolate_cjk))).alias("sub_pos", "p")).select(
        "token", "sub_pos", F.col("p.piece").alias("piece"), F.col("p.good").alias("good"))
    # single characters (commas and the like, in a large share of all tokens) need no join by key: the
    # single-character vocabulary has at most one row per Unicode character and is broadcast
    single = F.char_length("piece") == 1
    chars = vocab.where(F.char_length("token") == 1).select(F.col("token").alias("piece"), F.col("id").alias("cid"))
    one = sub.where(F.col("good") & single).join(F.broadcast(chars), "piece", "left").select(
        "token", "sub_pos", F.array(F.struct(F.coalesce("cid", F.lit(unk_id)).alias("id"),
                                             F.octet_length("piece").alias("nbytes"))).alias("wps"))
    longer = sub.where(F.col("good") & ~single)
    wp = wordpiece_words(longer.select(F.col("piece").alias("word")).distinct(), vocab, max_chars)
    good = longer.join(wp.withColumnRenamed("word", "piece"), "piece", "left")
    vocab_piece = vocab.select(F.col("token").alias("piece"), F.col("id").alias("vid"))
    bad = join_dimension(sub.where(~F.col("good")), vocab_piece, ["piece"], name="vocab", how="left")
    bad = bad.select("token", "sub_pos", F.array(F.struct(F.coalesce("vid", F.lit(unk_id)).alias("id"),
                                                          F.octet_length("piece").alias("nbytes"))).alias("wps"))
    parts = good.select("token", "sub_pos", "wps").unionByName(one).unionByName(bad)
    grouped = parts.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("sub_pos", "wps"))).alias("parts"))
    # offsets in two levels: bytes before a part, then bytes before a piece of it (a word has at most max_chars)
    size = "aggregate(x.wps, 0, (a, q) -> a + q.nbytes)"
    before = (f"aggregate(parts, named_struct('t', 0, 'b', CAST(array() AS ARRAY<INT>)), (acc, x) -> "
              f"named_struct('t', acc.t + {size}, 'b', concat(acc.b, array(acc.t)))).b")
    flat = grouped.withColumn("_b", F.expr(before)).select("token", F.expr(
        "flatten(transform(parts, (x, k) -> transform(x.wps, (p, i) -> named_struct('id', p.id, 'rel_start', "
        "CAST(_b[k] + aggregate(slice(x.wps, 1, i), 0, (a, q) -> a + q.nbytes) AS INT), 'nbytes', p.nbytes))))"
    ).alias("pieces"))
    sp = join_dimension(special, vocab.select(F.col("token"), F.col("id").alias("vid")), ["token"],
                        name="vocab", how="left").select(
        "token", F.array(F.struct(
            F.when(F.col("vid").isNull(), F.raise_error(F.concat(F.lit("Unrecognized special token: "),
                                                                 F.col("token")))).otherwise(F.col("vid")).alias("id"),
            F.lit(0).alias("rel_start"), F.octet_length("token").alias("nbytes"))).alias("pieces"))
    empty = plain.where("token = ''").select("token", F.expr(
        "CAST(array() AS ARRAY<STRUCT<id: BIGINT, rel_start: INT, nbytes: INT>>)").alias("pieces"))
    return flat.unionByName(sp).unionByName(empty)


def token_mismatch(pieces: DataFrame) -> DataFrame:
    """A16 input: per distinct token, bytes of the token minus bytes covered."""
    return pieces.select("token", (F.octet_length("token") - F.aggregate(
        "pieces", F.lit(0), lambda a, p: a + p["nbytes"])).alias("mismatch_bytes"))


def tokenize_texts(texts: DataFrame, vocab: DataFrame, keys: list[str],
                   max_chars: int = MAX_INPUT_CHARS_PER_WORD, partition_keys: list[str] | None = None,
                   marker_prefix: str | None = None, isolate_cjk: bool = False,
                   carry: list[str] | None = None) -> DataFrame:
    """Wordpieces of every text with byte offsets into that text.

    texts: (*keys, text, *carry). Returns one row per text:
    (*keys, wp_ids array<bigint>, wp_starts array<bigint>, wp_ends array<bigint>)
    with inclusive end offsets. Token start offsets come from a running sum
    of (bytes + 1) over the tokens of the text (W5). With ``marker_prefix``
    marker tokens are counted too, and ``wp_segs`` gives every wordpiece
    the number of markers up to its token minus one (a segment guess).
    ``isolate_cjk``: every CJK character is a word of its own; offsets stay exact.

    Texts that share their key are one text: their tokens in order of position, one row a key. ``carry``
    columns come along; with any, such texts have a row each, which holds the pieces of all of them.
    A vocabulary that is joined takes ``partition_keys`` (default ``keys``) for its shuffle.
    """
    vocab, carry = landed(vocab, "vocab")[0], list(carry or [])
    table = piece_table(vocab, max_chars, isolate_cjk)
    parts = (None, texts) if table is None else repeated_texts(texts, keys) or (texts, None)
    out = []
    if parts[0] is not None:
        w = parts[0].where("text IS NOT NULL").select(*keys, *carry, text_pieces(table, marker_prefix)("text").alias("_w"))
        names = ["starts", "ends"] + (["segs"] if marker_prefix else [])
        out.append(w.select(*keys, F.col("_w.ids").alias("wp_ids"), *[F.col(f"_w.{n}").alias(
            f"wp_{n}") for n in names], *carry))
    if parts[1] is not None:
        joined = _tokenize_joined(parts[1], vocab, keys, max_chars, partition_keys, marker_prefix, isolate_cjk)
        if carry:
            rows = parts[1].select(*[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)], *carry)
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(keys)])
            joined = joined.join(rows, same).drop(*[f"_of_{i}" for i in range(len(keys))])
        out.append(joined)
    return reduce(DataFrame.unionByName, out)


def _tokenize_joined(texts: DataFrame, vocab: DataFrame, keys: list[str], max_chars: int, partition_keys: list[str] | None,
                     marker_prefix: str | None, isolate_cjk: bool) -> DataFrame:
    """`tokenize_texts` by joins: for a vocabulary of any size, and for texts that share their key. The window and the
    per-text collection share one hash partitioning."""
    pieces = token_pieces(text_tokens(texts, keys), vocab, max_chars, isolate_cjk=isolate_cjk)
    toks = text_tokens(texts, keys).repartition(*(partition_keys or keys))
    w = Window.partitionBy(*keys).orderBy("tok_pos").rowsBetween(Window.unboundedPreceding, -1)
    toks = toks.withColumn("tok_start", F.coalesce(F.sum(F.col("tok_bytes") + 1).over(w), F.lit(0)))
    if marker_prefix:
        wc = Window.partitionBy(*keys).orderBy("tok_pos").rowsBetween(Window.unboundedPreceding, 0)
        toks = toks.withColumn("seg", F.sum(F.col("token").startswith(marker_prefix).cast("int")).over(wc) - 1)
    else:
        toks = toks.withColumn("seg", F.lit(-1))
    j = join_dimension(toks.select(*keys, "tok_pos", "tok_start", "seg", "token"), pieces, ["token"],
                       name="token-pieces")
    per = j.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tok_pos", "tok_start", "seg", "pieces")))
                               .alias("t"))
    wps = F.flatten(F.transform("t", lambda t: F.transform(t["pieces"], lambda p: F.struct(
        p["id"].alias("id"), (t["tok_start"] + p["rel_start"]).alias("s"),
        (t["tok_start"] + p["rel_start"] + p["nbytes"] - 1).alias("e"), t["seg"].alias("g")))))
    per = per.select(*keys, wps.alias("w"))
    out = per.select(*keys, F.col("w.id").alias("wp_ids"), F.col("w.s").cast("array<bigint>").alias("wp_starts"),
                     F.col("w.e").cast("array<bigint>").alias("wp_ends"), F.col("w.g").alias("wp_segs"))
    return out if marker_prefix else out.drop("wp_segs")


# ------------------------------------------------- destructive tokenizer ---

def destructive_clean_split(col: str = "text"):
    """X14 steps 1-3 as one Column: drop NUL, U+FFFD and control characters,
    turn whitespace into spaces, pad CJK ideographs with spaces, split on
    whitespace (no empty tokens)."""
    t = F.regexp_replace(F.col(col), BAD, "")
    t = F.regexp_replace(t, WHITESPACE, " ")
    t = F.regexp_replace(t, f"({CJK})", " $1 ")
    return F.filter(F.split(t, r"[ \x{2028}\x{2029}]+"), lambda x: x != "")


def destructive_word_tokens(words: DataFrame, lower: bool = True, vocab: DataFrame | None = None,
                            preserve_unused: bool = False) -> DataFrame:
    """X14 per distinct whitespace token (``word``): optional lower-casing and
    accent stripping, then punctuation split. With ``preserve_unused`` a token
    like ``[unused7]`` that is in the vocabulary is kept whole (P18).
    Returns (word, tokens array<string>)."""
    w = words.select("word")
    t = F.col("word")
    if lower:
        t = strip_accents(F.lower(t))
    out = w.withColumn("norm", t).withColumn(
        "tokens", F.filter(F.expr(f"regexp_extract_all(norm, r'({PUNCTUATION}|{NOT_PUNCTUATION}+)', 1)"),
                           lambda x: x != ""))
    if preserve_unused and vocab is not None:
        keep = vocab.select(F.col("token").alias("word"), F.lit(True).alias("_in"))
        out = join_dimension(out, keep, ["word"], name="vocab-words", how="left")
        out = out.withColumn("tokens", F.when(F.col("_in").isNotNull() & F.col("word").rlike(UNUSED_TOKEN_PATTERN),
                                              F.array("word")).otherwise(F.col("tokens"))).drop("_in")
    return out.select("word", "tokens")


def full_tokenize(texts: DataFrame, vocab: DataFrame, keys: list[str], lower: bool = True,
                  preserve_unused: bool = False) -> DataFrame:
    """Destructive basic tokenizer then wordpieces, as vocabulary ids
    per text (*keys, ids array<bigint>). Texts that share their key are one text, as in ``tokenize_texts``;
    a text without pieces has no row."""
    vocab = landed(vocab, "vocab")[0]
    table = None if preserve_unused else piece_table(vocab)
    if table is None:
        return _full_tokenize_joined(texts, vocab, keys, lower, preserve_unused)
    kind = "stripped_word" if lower else "plain_word"

    @F.arrow_udf("array<bigint>")
    def ids(words: pa.Array) -> pa.Array:
        return table.value.word_ids(words, kind)

    once, twice = repeated_texts(texts, keys) or (texts, None)
    words = destructive_clean_split("text")
    out = once.where("text IS NOT NULL").select(*keys, ids(F.transform(words, F.lower) if lower else words).alias("ids"))
    out = out.where(F.size("ids") > 0)
    return out if twice is None else out.unionByName(_full_tokenize_joined(twice, vocab, keys, lower, preserve_unused))


def tokens_of_ids(rows: DataFrame, vocab: DataFrame, keys: list[str], ids: str = "ids") -> DataFrame:
    """``rows``, unique on ``keys``, with ``tokens``: what their ids stand for in order (null for an unknown id)."""
    vocab, nbytes = landed(vocab, "vocab")
    if nbytes > MAX_VOCAB_BYTES:
        each = join_dimension(rows.select(*keys, F.posexplode(ids).alias("_k", "id")), vocab.select("id", "token"), ["id"],
                              name="inv-vocab", how="left")
        tokens = F.sort_array(F.collect_list(F.struct("_k", "token")))
        return rows.join(each.groupBy(*keys).agg(tokens["token"].alias("tokens")), keys)
    names = rows.sparkSession.sparkContext.broadcast({r.id: r.token for r in vocab.select("id", "token").collect()})

    @F.arrow_udf("array<string>")
    def tokens(lists: pa.Array) -> pa.Array:
        return names_of(lists, names.value)
    return rows.withColumn("tokens", tokens(ids))


def names_of(lists: pa.Array, names: dict[int, str]) -> pa.Array:
    """Lists of ids as lists of their tokens."""
    code = lists.flatten().dictionary_encode()
    known = pa.array([names.get(i) for i in code.dictionary.to_pylist()], pa.string())
    ends = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).cumsum()
    return pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), known.take(code.indices),
                                    mask=lists.is_null() if lists.null_count else None)


def _full_tokenize_joined(texts: DataFrame, vocab: DataFrame, keys: list[str], lower: bool, preserve_unused: bool) -> DataFrame:
    """`full_tokenize` by joins, on distinct words only."""
    toks = texts.select(*keys, F.posexplode(destructive_clean_split("text")).alias("w_pos", "word"))
    dw = destructive_word_tokens(toks.select("word").distinct(), lower, vocab, preserve_unused)
    sub = dw.select("word", F.posexplode("tokens").alias("t_pos", "piece"))
    kept = F.col("piece").rlike(UNUSED_TOKEN_PATTERN) if preserve_unused else F.lit(False)
    words = sub.select(F.col("piece").alias("word"), kept.alias("kept")).distinct()
    whole = words.where("kept").join(vocab.withColumnRenamed("token", "word"), "word").select(
        "word", F.array(F.struct("id", F.octet_length("word").alias("nbytes"))).alias("wps"))
    wp = wordpiece_words(words.where("not kept").select("word"), vocab).unionByName(whole)
    per_word = (sub.join(wp.withColumnRenamed("word", "piece"), "piece", "left")
                .groupBy("word").agg(F.sort_array(F.collect_list(F.struct("t_pos", "wps"))).alias("p"))
                .select("word", F.flatten(F.transform("p", lambda x: F.transform(x["wps"], lambda y: y["id"])))
                        .alias("ids")))
    j = join_dimension(toks, per_word, ["word"], name="word-ids")
    per = j.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("w_pos", "ids"))).alias("p"))
    return per.select(*keys, F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
