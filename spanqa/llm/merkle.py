"""Merkle dataset manifest: every row a leaf, a tree of digests a source, one root, and a proof for each leaf.

Rows are ranked once by (source, doc_id, digest); a node is labelled with the interval [lo, hi) of the leaf
ranks that it covers, and a tree with the interval [start, stop) of its source. Levels are built upwards by
grouping runs of FAN nodes, so every group is bounded and every level has a sixteenth of the rows below it.
Ancestors are attached downwards: a level is bucketed by the width of its parents' intervals, nodes join the
parents of their bucket whose interval contains theirs, and take over the parent's path. A node's siblings are
what is left of the parent's run when the node's own interval is taken out. The source roots are the leaves of
one more tree of the same kind, whose paths are handed to the roots of the source trees first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanqa.llm.common import land, ranked
from spanqa.operators.joins import join_dimension

FAN = 16
#: The documents of which one in so many is tampered with in the self-check of the manifest.
TAMPER_EVERY = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as its UTF-8 length, a colon and itself; null as a dash."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """Digest of one documents row; `text` stands in for the column text."""
    return digest(*[field(text if c == "text" and text is not None else F.col(c)) for c in FIELDS])


def tampered(text: Column) -> Column:
    """The text with A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def is_tampered(doc_id: Column) -> Column:
    """Rows the self-check tampers with, by the CRC-32 of the id's decimal digits; never a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % TAMPER_EVERY == 0, F.lit(False))


def build(leaves: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """The levels of all trees, leaves first.

    leaves: digest, lo (a rank that is dense over all trees), start and stop (the ranks of its tree), and columns
    that only the leaves keep. Level k holds the nodes of trees with more than fan^(k-1) leaves; a node has
    start, stop, lo, hi, digest and, above the leaves, the run of its children.
    """
    levels = [leaves.withColumn("hi", F.col("lo") + 1)]
    widest = leaves.agg(F.max(F.col("stop") - F.col("start"))).first()[0] or 0
    width = 1
    while width < widest:
        below = levels[-1].where(F.col("stop") - F.col("start") > width)
        runs = below.groupBy("start", "stop", F.floor((F.col("lo") - F.col("start")) / (width * fan)).alias("_nth")).agg(
            F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("run"))
        levels.append(land(runs.select(
            "start", "stop", F.col("run")[0]["lo"].alias("lo"), F.element_at("run", -1)["hi"].alias("hi"),
            F.sha2(F.array_join(F.col("run")["digest"], ""), 256).alias("digest"), "run"), "merkle-level"))
        width *= fan
    return levels


def attach(levels: list[DataFrame], tops: DataFrame, fan: int = FAN) -> DataFrame:
    """The leaves with the columns of `tops` (one row a tree: start, path, others) and a path from leaf to root.

    The path has an entry a level: the digests left and right of the ancestor in its run, joined.
    """
    others = [c for c in tops.columns if c not in ("start", "path")]
    out = None
    for k in range(len(levels) - 1, -1, -1):
        nodes, size = levels[k], F.col("stop") - F.col("start")
        own = [c for c in nodes.columns if c != "run"]
        rows = nodes.where(size <= fan ** k).select(*own, *(["run"] if k else [])).join(tops, "start")
        if out is not None:
            bucket = fan ** (k + 1)
            parents = out.select(
                F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("run").alias("_run"), F.col("path").alias("_path"),
                *others, F.explode(F.sequence(F.floor(F.col("lo") / bucket),
                                              F.floor((F.col("hi") - 1) / bucket))).alias("_bucket"))
            inside = (nodes.where(size > fan ** k).withColumn("_bucket", F.floor(F.col("lo") / bucket))
                      .join(parents, "_bucket").where("_lo <= lo AND hi <= _hi"))

            def rest(outside: str) -> Column:
                return F.array_join(F.expr(f"transform(filter(_run, c -> {outside}), c -> c.digest)"), "")

            step = F.array(F.struct(rest("c.hi <= lo").alias("left"), rest("c.lo >= hi").alias("right")))
            rows = rows.unionByName(inside.select(*own, *(["run"] if k else []), *others,
                                                  F.concat(step, F.col("_path")).alias("path")))
        out = land(rows, "merkle-paths") if k else rows
    return out


def manifest(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """A row for each row of `docs`: doc_id, leaf, tampered_leaf, subroot, root, path.

    docs: doc_id, source, lang, n_chars, text; other columns don't matter. tampered_leaf is the leaf after
    tampering, null for rows that aren't tampered with. path: siblings left and right, from the leaf to the root.
    Null source is a source of its own, the first one; null doc_ids come first in their source; rows with the
    same doc_id are ordered by their digest, so that equal rows are interchangeable. An empty table gives no rows.
    """
    part = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    bad = F.when(is_tampered(F.col("doc_id")), leaf(tampered(F.col("text"))))
    rows = land(docs.select("doc_id", part.alias("part"), leaf().alias("digest"), bad.alias("tampered_leaf")), "merkle-rows")
    rows = ranked(rows, ["part", "doc_id", "digest"], "lo")
    trees = rows.groupBy("part").agg(F.min("lo").alias("start"), (F.max("lo") + 1).alias("stop"))
    levels = build(land(join_dimension(rows, trees, ["part"], name="merkle-trees").drop("part"), "merkle-leaves"), fan)

    size = F.col("stop") - F.col("start")
    roots = None
    for k, nodes in enumerate(levels):
        top = nodes.where(size <= fan ** k).select("start", "digest")
        roots = top if roots is None else roots.union(top)
    roots = ranked(roots.withColumnRenamed("start", "tree"), ["tree"], "lo")
    n = roots.count()
    upper = build(roots.withColumns({"start": F.lit(0).cast("long"), "stop": F.lit(n).cast("long")}), fan)
    root = upper[-1].where(size <= fan ** (len(upper) - 1)).select(
        "start", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    tops = land(attach(upper, root, fan).select(
        F.col("tree").alias("start"), F.col("digest").alias("subroot"), "root", "path"), "merkle-tops")
    return attach(levels, tops, fan).select("doc_id", F.col("digest").alias("leaf"), "tampered_leaf", "subroot", "root", "path")


def siblings_digest(path: Column) -> Column:
    """Digest of all siblings on the way to the root, left to right within each level."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf digest and its path."""
    return F.aggregate(path, start, lambda acc, p: digest(p["left"], acc, p["right"]))
