"""Article -> entry: candidate contexts with markers, the byte map back to the
plaintext, the chosen annotation and its span in the contexts string.

Everything is computed in-row with higher-order functions over at most
``max_passages`` candidates, so the step has no shuffle and the document text
never moves. The byte map of the contexts string is kept as segments
``(ctx_start, ctx_end, plain_start)`` - one per kept candidate - instead of
one integer per byte; markers and joining spaces map to -1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanqa.constants import ANSWER_TYPES, MAX_PASSAGES, MAX_POSITION
from spanqa.functions.bytes import byte_slice
from spanqa.functions.lang import language_id

# Reasons an article is rejected, in the order the rules are checked.
REJECT_REASONS = ["invalid_candidate_offsets", "bad_candidate_index", "answer_mismatch",
                  "no_candidates", "empty_context", "span_mismatch"]


def _bslice(bin_col: str, s: str, e: str) -> str:
    """Byte slice [s, e) of a binary column as text (U+FFFD for cut characters)."""
    return (f"make_valid_utf8(CAST(substring({bin_col}, greatest({s}, 0) + 1, "
            f"greatest({e} - greatest({s}, 0), 0)) AS STRING))")


def first_annotation(raw: DataFrame, max_passages: int = MAX_PASSAGES) -> DataFrame:
    """Adds ``chosen`` - the first annotation in (candidate index, input
    order) with a minimal span inside the first ``max_passages`` candidates,
    else the first one with a passage answer there - with its candidate index
    ``annotated_idx`` (-1 if none) and its span local to the candidate
    (-1, -1 when it has no minimal span)."""
    ann = ("transform(coalesce(annotations, array()), (a, i) -> named_struct("
           "'ci', coalesce(a.passage_answer.candidate_index, -1L), 'i', i, "
           "'s', coalesce(a.minimal_answer.plaintext_start_byte, -1L), "
           "'e', coalesce(a.minimal_answer.plaintext_end_byte, -1L), 'yn', a.yes_no_answer))")
    mp = int(max_passages)
    return raw.withColumn("_ann", F.expr(ann)).withColumn("chosen", F.expr(
        f"coalesce(array_min(transform(filter(_ann, a -> a.ci >= 0 AND a.s >= 0 AND a.ci < {mp}), "
        "a -> named_struct('ci', a.ci, 'i', a.i, 'has_min', true, 's', a.s, 'e', a.e, 'yn', a.yn))), "
        f"array_min(transform(filter(_ann, a -> a.ci >= 0 AND a.ci < {mp}), "
        "a -> named_struct('ci', a.ci, 'i', a.i, 'has_min', false, 's', -1L, 'e', -1L, 'yn', a.yn))))"
    )).drop("_ann").withColumn("annotated_idx", F.coalesce(F.col("chosen.ci"), F.lit(-1).cast("bigint")))


def build_entries(raw: DataFrame, max_passages: int = MAX_PASSAGES, max_position: int = MAX_POSITION,
                  keep_yes_no: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One entry per raw article with
    ``reject_reason`` (null when the entry is valid).

    Output columns: example_id, id (string), name, language, question_text,
    plaintext, contexts, segments, answer (candidate_id, span_text,
    span_start, span_end, input_text), has_correct_context, n_candidates,
    reject_reason, and the columns of ``raw`` listed in ``carry``.
    """
    mp = int(max_passages)
    df = first_annotation(raw, max_passages).withColumn("_pt", F.encode("document_plaintext", "UTF-8"))
    cands = "coalesce(passage_answer_candidates, array())"
    df = df.withColumn("_cands", F.expr(cands)).withColumn("_n", F.size("_cands"))
    # kept candidates: the first max_passages, with their text, marker and layout
    kept = (f"transform(slice(_cands, 1, {mp}), (c, i) -> named_struct("
            "'i', i, 's', c.plaintext_start_byte, 'e', c.plaintext_end_byte, "
            f"'text', {_bslice('_pt', 'c.plaintext_start_byte', 'c.plaintext_end_byte')}, "
            "'marker', concat('[ContextId=', CAST(i AS STRING), ']')))")
    df = df.withColumn("_kept", F.expr(kept))
    # marker and text each followed by one joining space
    df = df.withColumn("_lay", F.expr(
        "aggregate(_kept, named_struct('at', 0L, 'arr', CAST(array() AS ARRAY<STRUCT<i: INT, "
        "ctx_start: BIGINT, ctx_end: BIGINT, plain_start: BIGINT, text_len: BIGINT>>)), "
        "(acc, k) -> named_struct('at', acc.at + octet_length(k.marker) + octet_length(k.text) + 2, "
        "'arr', concat(acc.arr, array(named_struct('i', k.i, "
        "'ctx_start', acc.at + octet_length(k.marker) + 1, "
        "'ctx_end', acc.at + octet_length(k.marker) + 1 + octet_length(k.text), "
        "'plain_start', k.s, 'text_len', CAST(octet_length(k.text) AS BIGINT))))), acc -> acc.arr)"))
    df = df.withColumn("contexts", F.expr(
        "array_join(flatten(transform(_kept, k -> array(k.marker, k.text))), ' ')"))
    df = df.withColumn("segments", F.expr(
        "transform(_lay, l -> named_struct('ctx_start', l.ctx_start, 'ctx_end', l.ctx_end, "
        "'plain_start', l.plain_start))"))
    # chosen candidate and answer (in candidate-local bytes first)
    df = df.withColumn("_cc", F.expr("IF(annotated_idx >= 0, try_element_at(_cands, CAST(annotated_idx + 1 AS INT)), NULL)"))
    df = df.withColumn("_cand_text", F.expr(_bslice("_pt", "_cc.plaintext_start_byte", "_cc.plaintext_end_byte")))
    loc_s = "(chosen.s - _cc.plaintext_start_byte)"
    loc_e = "(chosen.e - _cc.plaintext_start_byte)"
    yn = "upper(chosen.yn)"
    input_text = (
        "CASE WHEN chosen IS NULL THEN 'passage' "
        "WHEN chosen.has_min THEN 'minimal' "
        + (f"WHEN {yn} IN ('YES', 'NO') THEN lower({yn}) " if keep_yes_no else "")
        + "ELSE 'passage' END"
    )
    span_text = (f"CASE WHEN chosen IS NULL THEN '' WHEN chosen.has_min THEN "
                 f"make_valid_utf8(CAST(substring(encode(_cand_text, 'UTF-8'), greatest({loc_s}, 0) + 1, "
                 f"greatest({loc_e} - greatest({loc_s}, 0), 0)) AS STRING)) ELSE _cand_text END")
    local_start = f"CASE WHEN chosen IS NULL THEN -1L WHEN chosen.has_min THEN {loc_s} ELSE 0L END"
    local_end = (f"CASE WHEN chosen IS NULL THEN -1L WHEN chosen.has_min THEN {loc_e} "
                 "ELSE CAST(octet_length(_cand_text) AS BIGINT) END")
    df = df.withColumn("_ans", F.expr(
        f"named_struct('candidate_id', annotated_idx, 'span_text', {span_text}, "
        f"'local_start', {local_start}, 'local_end', {local_end}, 'input_text', {input_text})"))
    # shift into contexts when the annotated candidate is kept
    df = df.withColumn("has_correct_context", F.expr(f"annotated_idx >= 0 AND annotated_idx < least(_n, {mp})"))
    shift = "(_lay[CAST(annotated_idx AS INT)].ctx_start)"
    df = df.withColumn("answer", F.expr(
        "named_struct('candidate_id', _ans.candidate_id, 'span_text', _ans.span_text, "
        f"'span_start', IF(has_correct_context, _ans.local_start + {shift}, _ans.local_start), "
        f"'span_end', IF(has_correct_context, _ans.local_end + {shift}, _ans.local_end), "
        "'input_text', _ans.input_text)"))
    expected_min = _bslice("_pt", "chosen.s", "chosen.e")
    reason = (
        "CASE WHEN exists(_cands, c -> c.plaintext_start_byte = -1 OR c.plaintext_end_byte = -1) "
        "  THEN 'invalid_candidate_offsets' "
        "WHEN annotated_idx >= _n THEN 'bad_candidate_index' "
        f"WHEN chosen.has_min AND {expected_min} <> answer.span_text THEN 'answer_mismatch' "
        "WHEN _n = 0 THEN 'no_candidates' "
        "WHEN exists(_kept, k -> k.text = '') THEN 'empty_context' "
        f"WHEN has_correct_context AND {_bslice('encode(contexts, \"UTF-8\")', 'answer.span_start', 'answer.span_end')}"
        "  <> answer.span_text THEN 'span_mismatch' END"
    )
    df = df.withColumn("reject_reason", F.expr(reason))
    return df.select(
        "example_id", F.col("example_id").cast("string").alias("id"), F.col("document_title").alias("name"),
        "language", "question_text", F.col("document_plaintext").alias("plaintext"), "contexts", "segments",
        "answer", "has_correct_context", F.col("_n").alias("n_candidates"), "reject_reason", *(carry or []),
    )


def candidate_text(rows: DataFrame, index: str, on_range: str = "fail", text: str = "document_plaintext",
                   candidates: str = "passage_answer_candidates") -> DataFrame:
    """``rows`` plus ``cand`` (start, end: its bytes as one segment) and ``cand_text`` of the candidate at
    ``index``. An index out of range, or null, fails the job (``fail``) or gives nulls (``null``)."""
    if on_range not in ("fail", "null"):
        raise ValueError(f"on_range is fail or null, not {on_range!r}")
    i = F.col(index)
    if on_range == "fail":
        # raised in a filter: a column that is dropped again would be pruned
        inside = F.coalesce((i >= 0) & (i < F.size(candidates)), F.lit(False))
        rows = rows.where(F.when(inside, F.lit(True)).otherwise(F.raise_error(F.concat(
            F.lit("Invalid index for passage candidate: "), F.coalesce(i.cast("string"), F.lit("null")))).cast("boolean")))
    c = F.get(F.col(candidates), F.when((i >= 0) & (i < F.size(candidates)), i).cast("int"))
    return rows.withColumn("cand", F.when(c.isNotNull(), F.struct(
        c["plaintext_start_byte"].alias("start"), c["plaintext_end_byte"].alias("end")))).withColumn(
        "cand_text", F.when(F.col("cand").isNotNull(), byte_slice(text, F.col("cand.start"), F.col("cand.end"))))


def candidate_type_and_position(idx, max_position: int = MAX_POSITION):
    """``[NoLongAnswer]`` for -1, else ``[Paragraph=k]`` with
    k = min(idx + 1, max_position)."""
    c = F.col(idx) if isinstance(idx, str) else idx
    return F.when(c == -1, F.lit("[NoLongAnswer]")).otherwise(
        F.concat(F.lit("[Paragraph="), F.least(c + 1, F.lit(max_position)).cast("string"), F.lit("]")))


def answer_typing(entries: DataFrame) -> DataFrame:
    """answer type, text and byte offsets in the contexts (training).

    UNKNOWN when there is no annotated candidate or the span falls outside the
    contexts; then the span becomes (0, 1). The end offset is start + the
    byte length of the (replacement-decoded) answer text.
    """
    n = "octet_length(contexts)"
    a = "answer"
    unknown = f"({a}.candidate_id = -1 OR {a}.span_start >= {n} OR {a}.span_end > {n})"
    t = ANSWER_TYPES
    df = entries.withColumn("_unk", F.expr(unknown)).withColumn(
        "_s", F.expr(f"IF(_unk, 0L, {a}.span_start)")).withColumn("_e", F.expr(f"IF(_unk, 1L, {a}.span_end)"))
    df = df.withColumn("answer_type", F.expr(
        f"CASE WHEN _unk THEN {t['UNKNOWN']} WHEN lower({a}.input_text) = 'yes' THEN {t['YES']} "
        f"WHEN lower({a}.input_text) = 'no' THEN {t['NO']} WHEN lower({a}.input_text) = 'passage' "
        f"THEN {t['PASSAGE']} ELSE {t['MINIMAL']} END"))
    df = df.withColumn("answer_text", F.expr(_bslice("encode(contexts, 'UTF-8')", "_s", "_e")))
    return df.withColumn("start_byte_offset", F.col("_s")).withColumn(
        "end_byte_offset", F.col("_s") + F.octet_length("answer_text")).withColumn(
        "language_id", language_id("language")).drop("_unk", "_s", "_e")
