"""Wordpieces of whole texts inside a task: every distinct token of a batch is split and matched once, and the pieces
of the texts are put together from those of their tokens by array operations, so no token leaves its row."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from spanqa.functions.chars import BAD, CJK, PUNCTUATION, SPLIT_SPACE
from spanqa.functions.lists import steps
from spanqa.functions.longest_match import LongestMatch, Piece

_SPACE, _BAD, _PUNCTUATION, _CJK = 1, 2, 4, 8
#: Texts of a batch are taken this many bytes at a time.
STEP_BYTES = 1 << 20
#: Tokens a task remembers between batches.
MAX_KEPT = 200_000
_CLASSES: list[bytes] = []


def char_classes(spark: SparkSession) -> bytes:
    """The tokenizer's classes of every Unicode character, by its regular expressions (one byte a character)."""
    if not _CLASSES:
        flags = " + ".join(f"IF(c RLIKE r'{p}', {f}, 0)" for p, f in (
            (SPLIT_SPACE, _SPACE), (BAD, _BAD), (PUNCTUATION, _PUNCTUATION), (CJK, _CJK)))
        known = np.zeros(0x110000, dtype=np.uint8)
        chars = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").selectExpr(
            "id", "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c").selectExpr("id", f"{flags} AS f").where("f > 0")
        for r in chars.collect():
            known[r.id] = r.f
        _CLASSES.append(known.tobytes())
    return _CLASSES[0]


def strip_marks(word: str) -> str:
    """NFD without combining marks (category Mn)."""
    return word if word.isascii() else "".join(
        c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")


class PieceTable:
    """``special``: tokens that are one piece; ``prefixes``: beginnings of such tokens. A special token that the
    vocabulary lacks raises."""

    def __init__(self, vocab: list[tuple[str, int]], match: LongestMatch, classes: bytes, unk: int, max_chars: int,
                 special: list[str], prefixes: list[str], isolate_cjk: bool = False):
        self.ids, self.match, self.classes, self.unk, self.max_chars = dict(vocab), match, classes, unk, max_chars
        self.special, self.prefixes = set(special), tuple(prefixes)
        self.alone = _PUNCTUATION | (_CJK if isolate_cjk else 0)
        self.kept: dict[tuple[str, str], list[Piece]] = {}

    def __getstate__(self):
        return self.__dict__ | {"kept": {}}

    def _word(self, word: str) -> list[Piece]:
        got = self.match(word) if len(word) <= self.max_chars else None
        return got or [(self.unk, len(word.encode()))]

    def _split(self, run: list[tuple[str, int]]) -> list[str]:
        """Characters without those that are no text, cut around the ones that stand alone."""
        out, word = [], ""
        for c, f in run:
            if f & self.alone:
                out += [word, c] if word else [c]
                word = ""
            elif not f & _BAD:
                word += c
        return out + [word] if word else out

    def token(self, token: str) -> list[Piece]:
        """Pieces of a token between single spaces, in the order that ``basic_split_expr`` gives its parts in."""
        if token in self.special or token.startswith(self.prefixes):
            if token not in self.ids:
                raise ValueError(f"Unrecognized special token: {token}")
            return [(self.ids[token], len(token.encode()))]
        flags = [self.classes[ord(c)] for c in token]
        if not any(flags):
            return self._word(token) if token else []
        out: list[Piece] = []
        run: list[tuple[str, int]] = []
        for c, f in [*zip(token, flags), ("", _SPACE)]:
            if not f & _SPACE:
                run.append((c, f))
                continue
            out += [(self.ids.get(b, self.unk), len(b.encode())) for b, g in run if g & _BAD]
            for part in self._split([(b, g) for b, g in run if not g & _BAD]):
                out += self._word(part)
            if c:
                out += self._word(c)
            run = []
        return out

    def plain_word(self, word: str) -> list[Piece]:
        """Pieces of a word of the destructive tokenizer."""
        return [p for part in self._split([(c, self.classes[ord(c)] & ~_BAD) for c in word]) for p in self._word(part)]

    def stripped_word(self, word: str) -> list[Piece]:
        """Pieces of a lower-case word of the destructive tokenizer, accents stripped."""
        return self.plain_word(strip_marks(word))

    def _distinct(self, tokens: list[str], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and bytes of the pieces of all tokens, one after another, and every token's number of pieces."""
        of: Callable[[str], list[Piece]] = getattr(self, kind)
        ids, sizes, counts = [], [], np.zeros(len(tokens), dtype=np.int64)
        if len(self.kept) > MAX_KEPT:
            self.kept.clear()
        for k, t in enumerate(tokens):
            got = self.kept.get((kind, t))
            if got is None:
                got = of(t)
                if len(self.kept) <= MAX_KEPT:
                    self.kept[kind, t] = got
            counts[k] = len(got)
            for i, n in got:
                ids.append(i)
                sizes.append(n)
        return np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64), counts

    def _placed(self, lists: pa.Array, kind: str):
        """For texts as lists of tokens: the distinct tokens, their numbers in order, token numbers at which texts end,
        and per piece its place among the distinct tokens' pieces, with those and the tokens' numbers of pieces."""
        tokens = lists.flatten()
        code = tokens.dictionary_encode()
        at = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = code.dictionary.to_pylist()
        ids, sizes, counts = self._distinct(distinct, kind)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        n = counts[at]
        before = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
        place = np.repeat(first[at] - before[:-1], n) + np.arange(before[-1])
        return tokens, distinct, at, ends.astype(np.int64), ids, sizes, counts, n, before, place

    def word_ids(self, words: pa.Array, kind: str) -> pa.Array:
        """Ids of lists of words."""
        _, _, _, ends, ids, _, _, _, before, place = self._placed(words, kind)
        return pa.ListArray.from_arrays(pa.array(before[ends].astype(np.int32)), pa.array(ids[place]))

    def texts(self, texts: pa.Array, marker: str | None) -> Iterator[pa.Array]:
        """Struct of ids, starts, ends (inclusive bytes) and segs (marker tokens up to a piece's token, less one) of
        every text, a few texts at a time; null for a null."""
        for a, b in steps(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64), STEP_BYTES):
            yield self._texts(texts.slice(a, b - a), marker)

    def _texts(self, texts: pa.Array, marker: str | None) -> pa.Array:
        lists = pc.split_pattern(texts.cast(pa.string()), " ")
        tokens, distinct, at, ends, ids, sizes, counts, n, before, place = self._placed(lists, "token")
        long = pc.binary_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        gone = np.concatenate([[0], np.cumsum(long)])
        per = np.diff(ends)
        start = gone[:-1] - np.repeat(gone[ends[:-1]], per)
        inside = np.cumsum(sizes) - sizes
        first = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
        inside = inside - np.repeat(inside[np.minimum(first, max(len(sizes) - 1, 0))] if len(sizes) else first, counts)
        starts = np.repeat(start, n) + inside[place]
        if marker:
            marks = np.concatenate([[0], np.cumsum(np.array([t.startswith(marker) for t in distinct], dtype=np.int64)[at])])
            segs = np.repeat(marks[1:] - 1 - np.repeat(marks[ends[:-1]], per), n)
        else:
            segs = np.full(len(place), -1)
        offsets = pa.array(before[ends].astype(np.int32))
        arrays = [pa.ListArray.from_arrays(offsets, v) for v in (
            pa.array(ids[place]), pa.array(starts), pa.array(starts + sizes[place] - 1), pa.array(segs.astype(np.int32)))]
        return pa.StructArray.from_arrays(arrays, ["ids", "starts", "ends", "segs"], mask=texts.is_null())

    def tokens(self, tokens: pa.Array) -> pa.Array:
        """Lists of pieces (id, rel_start, nbytes) of distinct tokens."""
        ids, sizes, counts = self._distinct(tokens.to_pylist(), "token")
        before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        gone = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        rel = gone[:-1] - np.repeat(gone[before[:-1]], counts)
        pieces = pa.StructArray.from_arrays([pa.array(ids), pa.array(rel.astype(np.int32)), pa.array(sizes.astype(np.int32))],
                                            ["id", "rel_start", "nbytes"])
        return pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pieces)
