"""License scans: winnowed fingerprints pick templates, banded alignment reports coverage and spans.

Texts are reduced to lower-case letters and digits with single spaces. Every `GRAM`-byte gram is hashed and
of each `WINNOW` neighbouring hashes the smallest is kept (winnowing), so any shared run of GRAM + WINNOW - 1
bytes shares a fingerprint. The templates' fingerprints form the inverted index (fingerprint to template and
place); a document's fingerprints that are in it name the candidates and their diagonals. Around each diagonal
the words of text and template are aligned within a band; matched template words over all template words is
the coverage. The words that name a license or its version (`NAMES`, numbers) must be among the matched ones, and
where notices of different licenses overlap the one with most matched words stays, so that a notice is not taken for that of a
license that differs in its name or version alone. What is left of a text before and after a reported notice is aligned again where the template's
fingerprints hit it, so notices that follow each other closely are reported one by one. The templates are a parameter (a list of notices, not a corpus table); texts are never shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 12
WINNOW = 6
BAND = 8
MIN_COVERAGE = 0.8
_WORD = re.compile(r"[a-z0-9]+")
#: Words that tell licenses apart, beside numbers.
NAMES = set("mit isc mpl mozilla apache gnu gpl lgpl agpl lesser library affero cc cc0 by nc nd sa creative commons zero "
            "attribution noncommercial noderivatives sharealike bsd unlicense epl eclipse bsl boost zlib artistic".split())
#: Short license notices (fixed public wordings). A part after the license's id names the wording.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "MIT": "Released under the MIT License",
    "MIT-notice": "This project is licensed under the MIT License",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version"),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version"),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version"),
    "LGPL-3.0-header": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version"),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version"),
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    "EPL-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at http://www.eclipse.org/legal/epl-2.0"),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "BSD": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "BSD-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"),
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    "Zlib-grant": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software"),
    "Unlicense-grant": "This is free and unencumbered software released into the public domain",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "CC0-1.0-notice": "Released under the CC0 1.0 Universal Public Domain Dedication",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0",
    "CC-BY-ND-4.0-short": "Licensed under CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0-short": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0-short": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-NC-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
TEMPLATES |= {f"{i}-spdx": f"SPDX-License-Identifier: {i}" for i in (
    "MIT ISC Apache-2.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 MPL-2.0 EPL-2.0 BSL-1.0 CC0-1.0 BSD-2-Clause BSD-3-Clause "
    "Unlicense CC-BY-4.0 CC-BY-SA-4.0").split()}
_WORDING = re.compile(r"-(header|grant|notice|short|spdx)$")
FOUND = "array<struct<license:string,coverage:double,matched:int,start:int,end:int>>"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() and b < 128 else 32 for b in range(256))
_POWERS = np.array([pow(1_000_003, i, 1 << 64) for i in range(GRAM)], np.uint64)


def words(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of the ASCII words, in code points."""
    return [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text.translate(_ASCII_LOWER))]


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprints(text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(hashes, places, normal form): winnowed gram hashes and their places in the normal form."""
    normal = b" ".join(text.encode("utf-8", "replace").translate(_LOWER).split())
    x = np.frombuffer(normal, np.uint8)
    if len(x) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), normal
    n = len(x) - GRAM + 1
    h = np.zeros(n, np.uint64)
    wide = x.astype(np.uint64)
    for i in range(GRAM):
        h += wide[i:i + n] * _POWERS[i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    w = min(WINNOW, n)
    least = h[:n - w + 1].copy()
    for i in range(1, w):
        np.minimum(least, h[i:i + n - w + 1], out=least)
    chosen = np.zeros(n, bool)
    for i in range(w):
        chosen[i:i + n - w + 1] |= h[i:i + n - w + 1] == least
    at = np.flatnonzero(chosen)
    return h[at], at, normal


def banded(a: list[str], b: list[str], diagonal: int, band: int, lo: int = 0, hi: int | None = None,
           weights: list[int] | None = None) -> tuple[int, int, int]:
    """Most words of `a` matched in order in `b[lo:hi]` near a diagonal: (matches, first, last place in b); -1 without any.

    A word of `a` counts by its weight, 1 by default. Of equal counts, the alignment that ends first and starts last.
    """
    none = (0, -1, -1)
    better = lambda c, d: c if (c[0], c[1]) >= (d[0], d[1]) else d
    row: dict[int, tuple[int, int, int]] = {}
    best = none
    hi = len(b) if hi is None else hi
    for i, word in enumerate(a):
        now: dict[int, tuple[int, int, int]] = {}
        first = max(lo, i + diagonal - band)
        run = none
        # what the row above reached left of the band's first place
        left = none
        for j in range(first - 2, first):
            left = better(left, row.get(j, none))
        weight = weights[i] if weights else 1
        for j in range(first, min(hi, i + diagonal + band + 1)):
            left = better(left, row.get(j - 1, none))
            cand = better(run, row.get(j, none))
            if b[j] == word:
                cand = better(cand, (left[0] + weight, left[1] if left[0] else j, j))
            now[j] = run = cand
            if (cand[0], -cand[2], cand[1]) > (best[0], -best[2], best[1]):
                best = cand
        row = now
    return best


def one_license(found: list[dict]) -> list[dict]:
    """Without the notices that share half of their span or more with one of another license with more matched words."""
    family = {r["license"]: _WORDING.sub("", r["license"]) for r in found}
    found = sorted(found, key=lambda r: (r["start"], r["end"], r["license"]))
    out = []
    longest = 0
    for i, r in enumerate(found):
        longest = max(longest, r["end"] - r["start"])
        beaten = False
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(found) and not beaten and (found[j]["start"] < r["end"] if step > 0
                                                          else found[j]["start"] > r["start"] - longest):
                o = found[j]
                shared = min(o["end"], r["end"]) - max(o["start"], r["start"])
                if family[o["license"]] != family[r["license"]] and 2 * shared >= min(
                        r["end"] - r["start"], o["end"] - o["start"]):
                    beaten = (o["matched"], o["coverage"], r["license"]) > (r["matched"], r["coverage"], o["license"])
                j += step
        if not beaten:
            out.append(r)
    return out


class Scanner:
    """The inverted index of the templates."""

    def __init__(self, templates: dict[str, str]):
        self.templates = templates
        self.words = {k: [w for w, _, _ in words(t)] for k, t in templates.items()}
        # naming words weigh more than all others: the first of each must be matched
        self.weights = {}
        for k, ws in self.words.items():
            names = {w for w in ws if w in NAMES or w.isdigit()}
            heavy = {ws.index(w) for w in names}
            self.weights[k] = [len(ws) + 1 if i in heavy else 1 for i in range(len(ws))]
        self.index: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for k, t in templates.items():
            h, at, normal = fingerprints(t)
            for x, p in zip(h.tolist(), at.tolist()):
                self.index[x].append((k, normal[:p].count(b" ")))
        self.hashes = np.array(sorted(self.index), np.uint64)

    def scan(self, text: str | None, min_coverage: float = MIN_COVERAGE) -> list[dict]:
        if not text or not len(self.hashes):
            return []
        h, at, normal = fingerprints(text)
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[place] == h)
        if not len(hit):
            return []
        found = words(text)
        plain = [w for w, _, _ in found]
        near: dict[str, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        spaces = np.concatenate([[0], np.cumsum(np.frombuffer(normal, np.uint8) == 32)])
        for i in hit.tolist():
            for k, word in self.index[int(h[i])]:
                at_word = int(spaces[at[i]])
                near[k][at_word - word].add(at_word)
        out = []
        for k, diagonals in near.items():
            a, weights = self.words[k], self.weights[k]
            heavy = sum(w > 1 for w in weights)
            cuts = [0, len(plain)]  # ends of the free stretches, in pairs
            tried: dict[tuple[int, int], int] = {}  # last diagonal without a notice, by free stretch
            for d in sorted(diagonals):
                places = sorted(diagonals[d])
                while places:
                    x = bisect_right(cuts, places[0])
                    if x % 2 == 0:  # inside a reported notice
                        places.pop(0)
                        continue
                    lo, hi = cuts[x - 1], cuts[x]
                    if d - tried.get((lo, hi), -len(plain) - len(a) - BAND) > BAND:
                        weight, first, end = banded(a, plain, d, 2 * BAND, lo, hi, weights)
                        named, rest = divmod(weight, len(a) + 1)
                        matched = named + rest
                        if matched and named == heavy and matched >= min_coverage * len(a):
                            out.append({"license": k, "coverage": matched / len(a), "matched": matched,
                                        "start": found[first][1], "end": found[end][2]})
                            cuts[x:x] = [first, end + 1]
                            continue
                        tried[lo, hi] = d
                    places = [p for p in places if p >= hi]
        return one_license(out)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """`docs` plus `licenses`: template, coverage, matched words and span (code points) of every notice found.

    Null and empty texts give empty arrays. A column of that name is replaced, others pass through.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates)

    @F.pandas_udf(FOUND)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([scanner.scan(x, min_coverage) for x in t], dtype=object)

    return docs.withColumn("licenses", run(F.col("text").cast("string")))
