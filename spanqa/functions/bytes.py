"""UTF-8 byte helpers as Column expressions (all offsets are byte offsets)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utf8(text) -> Column:
    """Text as its UTF-8 bytes."""
    return F.encode(_c(text), "UTF-8")


def byte_len(text) -> Column:
    """Length of the text in UTF-8 bytes."""
    return F.octet_length(_c(text))


def byte_slice(text, start, end) -> Column:
    """Bytes [start, end) of the text decoded with U+FFFD for broken sequences.

    Starts and ends are clamped like a slice of a byte string: an empty or
    inverted range gives the empty string.
    """
    t = _c(text)
    s = F.greatest(_c(start), F.lit(0))
    n = F.greatest(_c(end) - s, F.lit(0))
    raw = F.substring(F.encode(t, "UTF-8"), s + 1, n)
    return F.make_valid_utf8(raw.cast("string"))


# One UTF-8 encoded character (or a run of ASCII) over bytes that are read as Latin-1 characters: the states
# of the decoder, which also keep out overlong forms, surrogates and what is beyond U+10FFFF.
_CONT = r"[\x80-\xBF]"
WELL_FORMED = (rf"[\x00-\x7F]+|[\xC2-\xDF]{_CONT}|\xE0[\xA0-\xBF]{_CONT}|[\xE1-\xEC\xEE\xEF]{_CONT}{{2}}|"
               rf"\xED[\x80-\x9F]{_CONT}|\xF0[\x90-\xBF]{_CONT}{{2}}|[\xF1-\xF3]{_CONT}{{3}}|"
               rf"\xF4[\x80-\x8F]{_CONT}{{2}}")


def decode_ignoring_errors(binary) -> Column:
    """bytes as text; what is no well-formed UTF-8 is left out."""
    kept = F.regexp_extract_all(F.decode(_c(binary), "ISO-8859-1"), F.lit(WELL_FORMED), F.lit(0))
    return F.encode(F.array_join(kept, ""), "ISO-8859-1").cast("string")


def safe_divide(x, y) -> Column:
    """x / y as double, 0.0 when y is 0 (null stays null)."""
    x, y = _c(x), _c(y)
    return F.when(y == 0, F.lit(0.0)).otherwise(F.try_divide(x.cast("double"), y.cast("double")))


def safe_average(x) -> Column:
    """Aggregate: mean of x, 0.0 when there is no row."""
    return F.coalesce(F.avg(_c(x)), F.lit(0.0))


def f1_of(p, r) -> Column:
    """Harmonic mean 2pr/(p+r), 0 when p+r is 0."""
    p, r = _c(p), _c(r)
    return safe_divide(F.lit(2.0) * p * r, p + r)
