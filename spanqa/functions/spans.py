"""Byte spans: validity, null test, partial-match scores (SQL expression text
so the same rule can be used inside higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span_error_sql(s: str, e: str) -> str:
    """Error text for an invalid span, null when valid."""
    return (
        f"CASE WHEN ({s} < 0 AND {e} >= 0) OR ({s} >= 0 AND {e} < 0) "
        f"THEN 'inconsistent null span' "
        f"WHEN {s} >= 0 AND {e} >= 0 AND {s} > {e} THEN 'start after end' END"
    )


def is_null_span_sql(s: str, e: str) -> str:
    return f"({s} < 0 AND {e} < 0)"


def span_error(s: str, e: str) -> Column:
    return F.expr(span_error_sql(s, e))


def is_null_span(s: str, e: str) -> Column:
    return F.expr(is_null_span_sql(s, e))


def partial_match_sql(gs: str, ge: str, ps: str, pe: str) -> str:
    """struct<precision, recall, f1> of byte overlap between gold and predicted
    spans (both non-null). No overlap gives 0; a zero-length span strictly
    inside the other one also gives 0."""
    inb = f"(least({ge}, {pe}) - greatest({gs}, {ps}))"
    ok = f"(NOT ({ge} <= {ps} OR {pe} <= {gs}) AND {inb} > 0)"
    p = f"IF({ok}, try_divide(CAST({inb} AS DOUBLE), CAST({pe} - {ps} AS DOUBLE)), 0.0D)"
    r = f"IF({ok}, try_divide(CAST({inb} AS DOUBLE), CAST({ge} - {gs} AS DOUBLE)), 0.0D)"
    return (
        f"named_struct('precision', {p}, 'recall', {r}, "
        f"'f1', IF({p} + {r} = 0, 0.0D, 2.0D * {p} * {r} / ({p} + {r})))"
    )


def partial_match(gs: str, ge: str, ps: str, pe: str) -> Column:
    return F.expr(partial_match_sql(gs, ge, ps, pe))


def merge_segments(segments: Column) -> Column:
    """Sorted, disjoint array<struct<start: bigint, end: bigint>> of the bytes that any of the segments [start, end)
    covers; segments that touch are one. Empty and null segments cover nothing."""
    clean = F.array_sort(F.filter(F.transform(segments, lambda s: F.struct(
        s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end"))), lambda s: s["start"] < s["end"]))

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(s["start"] <= last["end"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))
                      ).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(clean, F.array().cast("array<struct<start:bigint,end:bigint>>"), step)


def segment_positions(segments: Column) -> Column:
    """The positions that sorted, disjoint, nonempty segments cover, in order."""
    return F.flatten(F.transform(segments, lambda s: F.sequence(s["start"], s["end"] - 1)))


def nonnull_span_equal(as_: str, ae: str, bs: str, be: str) -> Column:
    """Both spans non-negative and equal."""
    return F.expr(
        f"({as_} >= 0 AND {ae} >= 0 AND {bs} >= 0 AND {be} >= 0 "
        f"AND {as_} = {bs} AND {ae} = {be})"
    )
