"""Character classes of the tokenizer as Java regular-expression classes
(F17-F20), and accent stripping (F22)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values: character classes ------------------------------------
# whitespace: space, tab, newline, carriage return, category Zs
WHITESPACE = r"[ \t\n\r\p{Zs}]"
# control: categories Cc and Cf except tab, newline, carriage return
CONTROL = r"[[\p{Cc}\p{Cf}]&&[^\t\n\r]]"
# punctuation: ASCII 33-47, 58-64, 91-96, 123-126, or any category P
PUNCTUATION = r"[!-/:-@\[-`{-~\p{P}]"
NOT_PUNCTUATION = r"[^!-/:-@\[-`{-~\p{P}]"
# CJK ideographs (eight code point ranges)
CJK = (r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
       r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]")
# neither punctuation nor CJK
NEITHER = f"[{NOT_PUNCTUATION}&&[^{CJK[1:-1]}]]"
# characters isolated as "bad" by the offset-preserving cleaner: NUL, U+FFFD, control
BAD = r"[[\x{0}\x{FFFD}\p{Cc}\p{Cf}]&&[^\t\n\r]]"
# whitespace seen by the offset-preserving splitter once bad characters are out
SPLIT_SPACE = r"[\t\n\r\p{Z}]"
NOT_SPLIT_SPACE = r"[^\t\n\r\p{Z}]"


@F.pandas_udf(StringType())
def strip_accents(words: pd.Series) -> pd.Series:
    """NFD then drop combining marks (category Mn). Spark has no Unicode
    normalisation function; apply this to distinct words only."""
    def one(w):
        if w is None:
            return None
        return "".join(ch for ch in unicodedata.normalize("NFD", w) if unicodedata.category(ch) != "Mn")
    return words.map(one)
