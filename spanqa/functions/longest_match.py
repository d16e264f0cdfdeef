"""Greedy longest match of words against a vocabulary, in time linear in the word.

The vocabulary is a trie with failure links (the published single-pass WordPiece matching): where a node has
no child for the next character, the pieces that the longest match would take so far are given out and the walk goes on
from the node that the rest of the read characters spells as a continuation. No character is read twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

Piece = tuple[int, int]  # id, bytes of the word that it covers
_CHAR_BITS = 21  # a Unicode character


class LongestMatch:
    """Nodes 0 (start of a word) and 1 (after a piece) are the roots; `fail` is -1 where no piece fits."""

    def __init__(self, vocab: list[tuple[str, int]], prefix: str):
        self.child: dict[int, int] = {}
        self.fail, self.pops = [-1, -1], [(), ()]
        piece: dict[int, Piece] = {}
        parent = [(0, 0, 0), (0, 0, 0)]  # depth, parent, character
        for token, i in vocab:
            roots = [(0, token)] + ([(1, token[len(prefix):])] if token.startswith(prefix) else [])
            for node, text in roots:
                for depth, c in enumerate(text, 1):
                    key = node << _CHAR_BITS | ord(c)
                    if key not in self.child:
                        self.child[key] = len(parent)
                        parent.append((depth, node, ord(c)))
                    node = self.child[key]
                if text:
                    piece[node] = (i, len(text.encode()))
        self.fail += [-1] * (len(parent) - 2)
        self.pops += [()] * (len(parent) - 2)
        for node in sorted(range(2, len(parent)), key=lambda v: parent[v][0]):
            _, up, c = parent[node]
            if node in piece:
                self.fail[node], self.pops[node] = 1, (piece[node],)
                continue
            z, given = self.fail[up], self.pops[up]
            while z >= 0 and (z << _CHAR_BITS | c) not in self.child:
                given, z = given + self.pops[z], self.fail[z]
            if z >= 0:
                self.fail[node], self.pops[node] = self.child[z << _CHAR_BITS | c], given

    def __call__(self, word: str) -> list[Piece] | None:
        """The pieces of a word; None if some position has none."""
        child, fail, pops = self.child, self.fail, self.pops
        at, out = 0, []
        for c in word:
            o = ord(c)
            while (to := child.get(at << _CHAR_BITS | o)) is None:
                if fail[at] < 0:
                    return None
                out += pops[at]
                at = fail[at]
            at = to
        while at > 1:
            if fail[at] < 0:
                return None
            out += pops[at]
            at = fail[at]
        return out if word else None

    def batches(self, batches: Iterator[pa.RecordBatch], unk: int, max_chars: int) -> Iterator[pa.RecordBatch]:
        """Record batches of words with their pieces; a word too long or without pieces is one unknown piece."""
        for b in batches:
            ends, ids, sizes = [0], [], []
            for word in b.column(0).to_pylist():
                got = self(word) if len(word) <= max_chars else None
                for i, n in got or [(unk, len(word.encode()))]:
                    ids.append(i)
                    sizes.append(n)
                ends.append(len(ids))
            pieces = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32())], ["id", "nbytes"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pieces)], ["word", "wps"])
