"""Windows over the document wordpieces and fixed-length model features.

All per-example work is in-row: the pieces' plaintext offsets and the pieces of
the answer are found by array operations over all examples of a batch, windows
come from a closed form (no loop), features are slices and concatenations of
32-bit arrays. One row per window is produced by a single explode.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanqa.constants import ANSWER_TYPES, DOC_STRIDE, INCLUDE_UNKNOWNS, MAX_QUESTION_LENGTH, MAX_SEQ_LENGTH
from spanqa.functions.lists import as_lists, ends_of, lengths, values


def windows_expr(n: str, width: str, stride: int) -> str:
    """array<struct<start, length>> of the sliding windows over n pieces:
    start 0, length min(n - start, width), advance min(width, stride), stop once
    a window reaches the end. Needs width >= 1."""
    step = f"least({width}, {int(stride)})"
    k = f"IF({n} = 0, 0, 1 + greatest(0, CAST(ceil(({n} - {width}) / {step}) AS INT)))"
    return (f"IF({k} = 0, CAST(array() AS ARRAY<STRUCT<start: INT, length: INT>>), "
            f"transform(sequence(0, {k} - 1), j -> named_struct('start', j * {step}, "
            f"'length', least({n} - j * {step}, {width}))))")


def to_plaintext_expr(offsets: str, segments: str) -> str:
    """contexts offsets -> plaintext offsets through the segments; -1 for
    negative offsets and for bytes of markers or joining spaces."""
    return (f"transform({offsets}, o -> IF(o < 0, -1L, coalesce(try_element_at(transform(filter({segments}, "
            f"g -> o >= g.ctx_start AND o < g.ctx_end), g -> g.plain_start + (o - g.ctx_start)), 1), -1L)))")


def plain_offsets(at: np.ndarray, n: np.ndarray, segments: pa.Array) -> np.ndarray:
    """`to_plaintext_expr` for the offsets of all rows of a batch (``n`` each): every offset meets the segment that
    begins at or before it by one search over the segments of all rows."""
    of = np.repeat(np.arange(len(segments)), lengths(segments))
    g = segments.flatten()
    whole = np.ones(len(g), dtype=bool)
    begin, end, plain = (pc.fill_null(f, 0).to_numpy(zero_copy_only=False) for f in (g.field(k) for k in range(3)))
    for k in range(3):
        whole &= g.field(k).is_valid().to_numpy(zero_copy_only=False)
    whole &= end > begin
    of, begin, end, plain = of[whole], begin[whole], end[whole], plain[whole]
    row = np.repeat(np.arange(len(n)), n)
    place = (of << 32) + begin  # a text is smaller than 2 GB
    if len(place) and (np.diff(place) < 0).any():
        order = np.argsort(place, kind="stable")
        of, begin, end, plain, place = of[order], begin[order], end[order], plain[order], place[order]
    k = np.searchsorted(place, (row << 32) + at, side="right") - 1
    if not len(place):
        return np.full(len(at), -1, dtype=np.int64)
    found = (k >= 0) & (at >= 0) & (of[k] == row) & (at < end[k])
    return np.where(found, plain[k] + at - begin[k], -1)


def answer_pieces(starts: np.ndarray, ends: np.ndarray, n: np.ndarray, s: pa.Array, e: pa.Array) -> list[pa.Array]:
    """`has_wordpiece` (but for s < e), `nearest_right` of s and `nearest_left` of e - 1 for every row of a batch."""
    row, index = np.repeat(np.arange(len(n)), n), np.arange(len(starts)) - np.repeat(ends_of(n)[:-1], n)
    null = s.is_null().to_numpy(zero_copy_only=False), e.is_null().to_numpy(zero_copy_only=False)
    s, e = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False)[row] for x in (s, e))
    right, left = (ends >= s) & ~null[0][row], (starts <= e - 1) & ~null[1][row]
    any_piece = np.zeros(len(n), dtype=bool)
    any_piece[row[(right | null[0][row]) & (left | null[1][row])]] = True
    first, last = np.full(len(n), -1, dtype=np.int32), np.full(len(n), -1, dtype=np.int32)
    hits = np.flatnonzero(right)[::-1]
    first[row[hits]] = index[hits]  # of a row's hits the one that is set last stays
    hits = np.flatnonzero(left & (e - 1 >= 0))
    last[row[hits]] = index[hits]
    return [pa.array(any_piece, mask=any_piece & (null[0] | null[1])), pa.array(first), pa.array(last)]


#: What a task makes of an example's pieces: ids and plaintext offsets, and for training the answer's pieces.
LOCATED = "ids: array<int>, plain_s: array<int>, plain_e: array<int>"
ANSWER = "any_piece: boolean, first: int, last: int"


def located(ids: pa.Array, starts: pa.Array, ends: pa.Array, segments: pa.Array, answer: list[pa.Array]) -> list[pa.Array]:
    """The columns of ``LOCATED`` and, with the answers' offsets, of ``ANSWER`` for lists of pieces."""
    n, null = lengths(ids), ids.is_null().to_numpy(zero_copy_only=False)
    s, e = values(starts).astype(np.int64), values(ends).astype(np.int64)
    plain = [as_lists(n, pa.array(plain_offsets(x, n, segments)).cast(pa.int32()), null) for x in (s, e)]
    return [as_lists(n, ids.flatten().cast(pa.int32()), null), *plain, *(answer_pieces(s, e, n, *answer) if answer else [])]


def nearest_right(starts: str, ends: str, offset: str) -> str:
    """J9 (scan right): first wordpiece whose byte range reaches ``offset``."""
    return (f"coalesce(array_min(filter(transform({ends}, (e, i) -> IF(e >= {offset}, i, NULL)), "
            "i -> i IS NOT NULL)), -1)")


def nearest_left(starts: str, ends: str, offset: str) -> str:
    """J9 (scan left): last wordpiece starting at or before ``offset``."""
    return (f"coalesce(array_max(filter(transform({starts}, (s, i) -> IF(s <= {offset} AND {offset} >= 0, i, NULL)), "
            "i -> i IS NOT NULL)), -1)")


def has_wordpiece(starts: str, ends: str, s: str, e: str) -> str:
    """Some wordpiece covers a byte of [s, e)."""
    return f"({s} < {e} AND exists(zip_with({starts}, {ends}, (a, b) -> a <= {e} - 1 AND b >= {s}), x -> x))"


def keep_sample(example_id: Column, window: Column, rate: float, seed: int) -> Column:
    """Repeatable sampling of negative windows (keep with probability rate)."""
    if rate < 0:
        return F.lit(False)
    u = F.pmod(F.xxhash64(example_id, window, F.lit(seed)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    return u <= F.lit(float(rate))


def build_features(ex: DataFrame, cls_id: int, sep_id: int, is_training: bool,
                   max_seq_length: int = MAX_SEQ_LENGTH, doc_stride: int = DOC_STRIDE,
                   max_question_length: int = MAX_QUESTION_LENGTH, include_unknowns: float = INCLUDE_UNKNOWNS,
                   seed: int = 0, keep_errors: bool = False) -> DataFrame:
    """One feature row per kept window.

    ex: example_id, language_id, q_ids, wp_ids, plain_s, plain_e (plaintext offsets of the pieces, inclusive ends), all
    32-bit; training adds answer_type, start_byte_offset, end_byte_offset, any_piece, first, last (``ANSWER``).

    With ``keep_errors`` (training) the errors come out of the same pass: an example that has none of its
    features for an error is one row, a window left out for one is a row too; ``error`` names it and is null for
    features, and ``row_key`` is kept.
    """
    if max_seq_length <= max_question_length + 3:
        raise ValueError("max_seq_length must exceed max_question_length + 3")
    L = int(max_seq_length)
    df = ex.withColumn("q", F.expr(f"IF(size(q_ids) > {int(max_question_length)}, "
                                   f"slice(q_ids, -{int(max_question_length)}, {int(max_question_length)}), q_ids)"))
    df = df.withColumn("nq", F.size("q")).withColumn("width", F.lit(L) - F.col("nq") - 3)
    if is_training:
        df = df.withColumn("wp_start_pos", F.coalesce("first", F.lit(-1))).withColumn(
            "wp_end_pos", F.coalesce("last", F.lit(-1)))
        df = df.withColumn("ex_error", F.expr(
            "CASE WHEN NOT (start_byte_offset < end_byte_offset AND any_piece) THEN 'no wordpiece in answer span' "
            "WHEN wp_start_pos = -1 THEN 'no starting wordpiece' WHEN wp_end_pos = -1 THEN 'no ending wordpiece' END"))
        # the offsets at the answer's ends, as every window that holds them has them
        df = df.withColumn("mapped", F.expr("get(plain_s, wp_start_pos) > -1 AND get(plain_e, wp_end_pos) > -1"))
        # an example with an error is carried on as one empty window
        df = df.withColumn("win", F.expr(
            f"IF(ex_error IS NULL, {windows_expr('size(wp_ids)', 'width', doc_stride)}, "
            "array(named_struct('start', 0, 'length', 0)))"))
    else:
        df = df.withColumn("win", F.expr(windows_expr("size(wp_ids)", "width", doc_stride)))
    f = df.select("*", F.posexplode("win").alias("doc_span_index", "win_s")).drop("win")
    f = f.withColumn("ws", F.col("win_s.start")).withColumn("wl", F.col("win_s.length"))
    f = f.withColumn("pad", F.lit(L) - F.col("nq") - 3 - F.col("wl"))
    f = f.withColumn("input_ids", F.expr(
        f"concat(array({int(cls_id)}), q, array({int(sep_id)}), slice(wp_ids, ws + 1, wl), "
        f"array({int(sep_id)}), array_repeat(0, pad))"))
    f = f.withColumn("input_mask", F.expr("concat(array_repeat(1, nq + 3 + wl), array_repeat(0, pad))"))
    f = f.withColumn("segment_ids", F.expr(
        "concat(array_repeat(0, nq + 2), array_repeat(1, wl + 1), array_repeat(0, pad))"))
    # byte offsets fit in 32 bits: a Spark string is smaller than 2 GB
    for name, plain in (("wp_start_offset", "plain_s"), ("wp_end_offset", "plain_e")):
        f = f.withColumn(name, F.expr(
            f"concat(array_repeat(-1, nq + 2), slice({plain}, ws + 1, wl), array_repeat(-1, pad + 1))"))
    f = f.withColumn("unique_ids", F.try_add(F.col("example_id"), F.col("doc_span_index").cast("bigint")))
    f = f.withColumn("example_index", F.col("example_id"))
    if not is_training:
        return f.select("unique_ids", "example_index", "doc_span_index", "language_id", "input_ids", "input_mask",
                        "segment_ids", "wp_start_offset", "wp_end_offset")
    unknown = ANSWER_TYPES["UNKNOWN"]
    failed = F.col("ex_error").isNotNull()
    f = f.withColumn("contains", F.expr("wp_start_pos >= ws AND wp_end_pos <= ws + wl - 1"))
    negative = (~F.col("contains")) | (F.col("answer_type") == unknown)
    f = f.where(failed | ~negative
                | keep_sample(F.col("example_id"), F.col("doc_span_index"), include_unknowns, seed))
    f = f.withColumn("start_positions", F.when(negative, F.lit(0)).otherwise(
        F.col("wp_start_pos") - F.col("ws") + F.col("nq") + 2).cast("bigint"))
    f = f.withColumn("end_positions", F.when(negative, F.lit(0)).otherwise(
        F.col("wp_end_pos") - F.col("ws") + F.col("nq") + 2).cast("bigint"))
    f = f.withColumn("answer_types", F.when(negative, F.lit(unknown)).otherwise(F.col("answer_type")).cast("bigint"))
    wp_error = F.expr("NOT (mapped AND end_positions >= start_positions)") & ~negative
    f = f.withColumn("error", F.coalesce("ex_error", F.when(wp_error, F.lit("wp_error"))))
    cols = ["unique_ids", "example_index", "doc_span_index", "language_id", "input_ids", "input_mask",
            "segment_ids", "start_positions", "end_positions", "answer_types"]
    return f.select(*cols, "error", "row_key") if keep_errors else f.where("error IS NULL").select(*cols)


def features_per_example(features: DataFrame, examples: DataFrame) -> DataFrame:
    """Histogram (number of features -> number of examples), examples
    with no feature counted under 0."""
    n = features.groupBy("example_index").agg(F.count(F.lit(1)).alias("n_features"))
    e = examples.select(F.col("example_id").alias("example_index")).join(n, "example_index", "left")
    return e.groupBy(F.coalesce("n_features", F.lit(0)).alias("n_features")).agg(
        F.count(F.lit(1)).alias("n_examples"))
