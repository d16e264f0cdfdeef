"""Merkle manifest against a plain recursive tree; proofs of several tree heights; odd inputs."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from spanqa.llm import merkle

COLS = "doc_id long, source string, lang string, n_chars long, text string, lo long, digest string, part string, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, fan):
    """(root, [siblings left and right of each leaf, level by level])."""
    level, at, paths = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i:i + fan] for i in range(0, len(level), fan)]
        for i, a in enumerate(at):
            run, k = runs[a // fan], a % fan
            paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
        at = [a // fan for a in at]
        level = [h(*r) for r in runs]
    return level[0], paths


def model(rows, fan=16):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, h(*map(field, r[:5])), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in names:
        by[s].sort(key=lambda x: x[:3])
        subs[s] = tree([x[2] for x in by[s]], fan)
    root, tops = tree([subs[s][0] for s in names], fan)
    out = []
    for s, top in zip(names, tops):
        for (_, _, leaf, r), path in zip(by[s], subs[s][1]):
            bad = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                bad = h(*map(field, (*r[:4], low)))
            for a, b in path + top:
                bad = h(a, bad, b)
            out.append((r[0], leaf, subs[s][0], root, h(*[a + b for a, b in path + top]), bad, bad == root))
    return out


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_against_plain_trees(spark, fan):
    rows = [(i, "hot" if i % 2 else f"s{i % 37}" if i % 14 else None, "en" if i % 3 else None, i if i % 5 else None,
             f"Text {i} ÀÉ" if i % 11 else ("" if i % 2 else None)) for i in range(700)]
    rows += [(None, "hot", None, None, None), (None, "hot", "x", None, None), (7, "hot", "a", 1, "Z")] + [(9, "hot", "en", 1, "Same")] * 40
    rows += [(1000, "one", "en", 5, "Lone"), (1001, "-", None, None, "W" * 200_000), (1002, "𝒳", "1:-", 0, "\n"), (1003, "", "", 0, "")]
    df = spark.createDataFrame([(*r, 1, "d", "p", "q") for r in rows], COLS).repartition(7)
    m = merkle.manifest(df, fan)
    got = m.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")).alias("p"),
                   merkle.fold(F.coalesce("tampered_leaf", "leaf"), F.col("path")).alias("f")).collect()
    expect = model(rows, fan)
    assert sorted(map(repr, (tuple(r) + (r.f == r.root,) for r in got))) == sorted(map(repr, expect))
    assert not all(e[-1] for e in expect) and any(e[-1] for e in expect)


def test_none_and_one(spark):
    assert merkle.manifest(spark.createDataFrame([], COLS)).collect() == []
    one = merkle.manifest(spark.createDataFrame([(3, None, None, None, None, 0, "", "", "")], COLS)).collect()
    leaf = h("1:3", "-", "-", "-", "-")
    assert [(r.leaf, r.subroot, r.root, r.path) for r in one] == [(leaf, leaf, leaf, [])]
