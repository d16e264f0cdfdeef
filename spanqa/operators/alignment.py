"""Alignment report between the contexts string, the plaintext and
the wordpieces - one row per 20-byte slice of every article's contexts, plus
the gold answer with up to 100 bytes around it (start clamped at 0)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanqa.functions.lists import as_lists, lengths, steps
from spanqa.operators.entry import _bslice
from spanqa.operators.features import to_plaintext_expr
from spanqa.operators.joins import join_dimension, landed
from spanqa.operators import tokenize
from spanqa.operators.tokenize import MAX_VOCAB_BYTES, names_of

#: Pieces whose slices are put together at a time.
STEP_PIECES = 1 << 18


def cut_bytes(text: str, start: Column, length: Column) -> Column:
    """``length`` bytes of ``text`` from byte ``start`` on, as a string that may hold cut characters."""
    return F.substring(F.encode(text, "UTF-8"), start + 1, length).cast("string")


def slice_pieces(ids: pa.Array, starts: pa.Array, slices: pa.Array, width: int, names: dict[int, str]) -> pa.Array:
    """Per text, for its slices of ``width`` bytes in order, the number and the space-joined text of the pieces that
    start in it; null without pieces' ids."""
    n = pc.fill_null(slices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    per = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(ids)), per)
    at = starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64) // width
    inside = at < n[row]
    place = (before[row] + at)[inside]
    order = np.argsort(place, kind="stable")
    counts = np.bincount(place, minlength=before[-1]).astype(np.int64)
    tokens = names_of(ids, names).flatten().filter(pa.array(inside)).take(pa.array(order))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
                                     pc.fill_null(tokens, ""))
    found = pa.StructArray.from_arrays([pa.array(counts.astype(np.int32)), pc.binary_join(lists, " ")], ["n", "text"])
    return pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), found)


def slice_report(entries: DataFrame | None, tokens: DataFrame | None, vocab: DataFrame, width: int = 20) -> DataFrame:
    """entries: example_id, contexts, plaintext, segments; tokens: example_id,
    wp_ids, wp_starts; vocab: id, token. Per slice: its text, whether the bytes
    are whole characters, the plaintext offset of its first byte (-1 for markers
    / spaces), the plaintext recovered from that offset, and the number and
    space-joined text of the wordpieces starting in it.

    ``entries`` is None if ``tokens`` carries the entries' columns. ``tokens`` is None if the contexts are still to be
    tokenized: then they are in the function that cuts the slices, a few articles at a time, and no pieces go to and fro
    (entries that share their id are one text, as in ``tokenize_texts``). Slices and their pieces are cut inside the
    article's row, so nothing else is shuffled; a vocabulary too large for a task is joined instead."""
    w = int(width)
    vocab, nbytes = landed(vocab, "vocab")
    if tokens is None:
        kept = ["contexts", "plaintext", "segments"]
        texts = entries.select("example_id", F.col("contexts").alias("text"), *kept)
        table = tokenize.piece_table(vocab)
        once, again = (None, texts) if table is None else tokenize.repeated_texts(texts, ["example_id"]) or (texts, None)
        parts = [] if again is None else [slice_report(None, tokenize.tokenize_texts(
            again, vocab, ["example_id"], carry=kept), vocab, w)]
        if once is not None:
            parts.append(_slices(once.where("text IS NOT NULL"), _sliced_texts(table, _names(vocab), w), w))
        return reduce(DataFrame.unionByName, parts)
    if nbytes > MAX_VOCAB_BYTES:
        e = tokens if entries is None else entries
        return _slice_report_joined(e, tokens.select("example_id", "wp_ids", "wp_starts"), vocab, w)
    rows = tokens if entries is None else entries.join(tokens.select("example_id", "wp_ids", "wp_starts"), "example_id", "left")
    names = _names(vocab)

    @F.arrow_udf("array<struct<n: int, text: string>>")
    def found(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:  # a few articles at a time: the tokens' texts are many times their ids
            for a, b in steps(lengths(batch[0]) + 1, STEP_PIECES):
                yield slice_pieces(*[x.slice(a, b - a) for x in batch], w, names.value)
    known = F.col("example_id").isNotNull()
    return _slices(rows, found(F.when(known, F.col("wp_ids")), F.when(known, F.col("wp_starts")), F.size(_cuts(w))), w)


def _names(vocab: DataFrame):
    return vocab.sparkSession.sparkContext.broadcast({r.id: r.token for r in vocab.select("id", "token").collect()})


def _cuts(w: int) -> Column:
    return F.expr(f"sequence(0, greatest(octet_length(contexts) - 1, 0), {w})")


def _sliced_texts(table, names, w: int) -> Column:
    """`slice_pieces` of the contexts' own pieces; none where an entry has no id."""
    @F.arrow_udf("array<struct<n: int, text: string>>")
    def found(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, slices, known in batches:
            at = 0
            for part in table.value.texts(texts, None):
                known_part = known.slice(at, len(part)).to_numpy(zero_copy_only=False)
                null = ~known_part | part.is_null().to_numpy(zero_copy_only=False)
                n = np.where(null, 0, lengths(part.field(0)))
                keep = pa.array(np.repeat(known_part, lengths(part.field(0))))
                ids, starts = (as_lists(n, part.field(k).flatten().filter(keep), null) for k in range(2))
                yield slice_pieces(ids, starts, slices.slice(at, len(part)), w, names.value)
                at += len(part)
    return found("text", F.size(_cuts(w)), F.col("example_id").isNotNull())


def _slices(rows: DataFrame, found: Column, w: int) -> DataFrame:
    e = rows.select("example_id", F.encode("contexts", "UTF-8").alias("cb"), "segments",
                    F.encode("plaintext", "UTF-8").alias("pb"), _cuts(w).alias("cuts"), found.alias("found"))
    e = e.withColumn("plain", F.expr(to_plaintext_expr("cuts", "segments")))
    s = e.select("example_id", F.expr(
        f"inline(transform(arrays_zip(cuts, plain, found), z -> named_struct('at', z.cuts, 'plain_at', z.plain, "
        f"'raw', substring(cb, z.cuts + 1, {w}), 'plain_text', IF(z.plain >= 0, "
        f"{_bslice('pb', 'CAST(z.plain AS INT)', f'CAST(z.plain AS INT) + {w}')}, NULL), "
        "'n_wordpieces', coalesce(z.found.n, 0), 'wordpieces', coalesce(z.found.text, ''))))"))
    raw = F.col("raw").cast("string")
    return s.select("example_id", "at", F.make_valid_utf8(raw).alias("ctx_text"), F.is_valid_utf8(raw).alias("whole_chars"),
                    "plain_at", "plain_text", "n_wordpieces", "wordpieces")


def _slice_report_joined(entries: DataFrame, tokens: DataFrame, vocab: DataFrame, w: int) -> DataFrame:
    """`slice_report` with a vocabulary of any size: pieces meet their slice by an equi-join on its start."""
    e = entries.select("example_id", F.encode("contexts", "UTF-8").alias("cb"), "segments",
                       F.encode("plaintext", "UTF-8").alias("pb"),
                       F.expr(f"sequence(0, greatest(octet_length(contexts) - 1, 0), {w})").alias("cuts"))
    e = e.withColumn("plain", F.expr(to_plaintext_expr("cuts", "segments")))
    s = e.select("example_id", F.expr(
        f"inline(zip_with(cuts, plain, (a, p) -> named_struct('at', a, 'plain_at', p, 'raw', substring(cb, a + 1, {w}), "
        f"'plain_text', IF(p >= 0, {_bslice('pb', 'CAST(p AS INT)', f'CAST(p AS INT) + {w}')}, NULL))))"))
    p = tokens.select("example_id", F.posexplode(F.arrays_zip("wp_ids", "wp_starts")).alias("i", "p")).select(
        "example_id", "i", F.col("p.wp_ids").alias("id"),
        F.expr(f"CAST(p.wp_starts - p.wp_starts % {w} AS INT)").alias("at"))
    p = join_dimension(p, vocab.select("id", "token"), ["id"], name="report-vocab", how="left")
    p = p.groupBy("example_id", "at").agg(
        F.count(F.lit(1)).cast("int").alias("n_wordpieces"),
        F.array_sort(F.collect_list(F.struct("i", F.coalesce("token", F.lit("")).alias("token")))).alias("pieces"))
    raw = F.col("raw").cast("string")
    return s.join(p, ["example_id", "at"], "left").select(
        "example_id", "at", F.make_valid_utf8(raw).alias("ctx_text"), F.is_valid_utf8(raw).alias("whole_chars"),
        "plain_at", "plain_text", F.coalesce("n_wordpieces", F.lit(0)).alias("n_wordpieces"),
        F.coalesce(F.array_join("pieces.token", " "), F.lit("")).alias("wordpieces"))


def answer_context(entries: DataFrame, around: int = 100) -> DataFrame:
    """The gold answer of every entry with ``around`` bytes on each side."""
    e = entries.where("answer.span_start >= 0").withColumn("_cb", F.encode("contexts", "UTF-8"))
    return e.select(
        "example_id", F.col("answer.span_text").alias("answer"),
        F.expr(_bslice("_cb", f"greatest(answer.span_start - {around}, 0)", "answer.span_start")).alias("before"),
        F.expr(_bslice("_cb", "answer.span_end", f"answer.span_end + {around}")).alias("after"),
    )
