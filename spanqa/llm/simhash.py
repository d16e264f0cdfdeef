"""SimHash near-duplicates with pigeonring candidate filtering.

Fingerprints are computed per Arrow batch (XXH64 of each word shingle, bit counts in numpy), one row per
document. Linking works on distinct fingerprints only, so copies never multiply.

Pigeonring: the 64 bits are cut into `segments` consecutive segments on a ring. If two fingerprints
differ in at most t bits there is a start segment from which every chain of l segments differs in at
most l * t / segments bits. Chains whose budget is below one must be equal, which gives an equi-join
key per start; the longer chains and then the whole distance are checked on the joined pair. No pair
within t bits is lost.

The ring has more segments, and the keys of its equal chains more bits, the more distinct fingerprints there are
(`ring_for`), so that unrelated fingerprints share few buckets in a table of any size. What fills a bucket beyond
`bucket` fingerprints then is a cluster: very many fingerprints that agree in a whole chain. Clusters are not paired. Their fingerprints are linked exactly
through keys at distance t // 2: every fingerprint emits itself and, for t >= 2, its 64 one-bit
neighbours; fingerprints that share such a key are within 2 bits, and any two within 2 bits share one.
A key holds at most 65 distinct fingerprints by construction, so the work stays linear in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spanqa.llm.common import connected_components, land, packed, unpacked

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SEGMENTS = 5
BUCKET = 64
_CHUNK = 65280
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_NO_ID = (1 << 63) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint: bit set where over half the shingle hashes have it; no word: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(size)
    starts = (ends - size)[: n - shingle + 1].tolist()
    ends = (ends[shingle - 1:] - 1).tolist()
    total = len(starts)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for lo in range(0, total, _CHUNK):
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[lo:lo + _CHUNK], ends[lo:lo + _CHUNK])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        for at in range(0, len(bits), 255):
            ones += bits[at:at + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp): one row per input row; th hashes the text, fp is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "th", "fp"])

    schema = StructType([StructField("doc_id", LongType()), StructField("th", LongType()),
                         StructField("fp", LongType())])
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"),
                       F.col("text").cast("string")).mapInArrow(run, schema)


def _segments(segments: int) -> list[tuple[int, int]]:
    """(offset, width) of the ring's segments."""
    width, more = divmod(64, segments)
    out, at = [], 0
    for i in range(segments):
        w = width + (i < more)
        out.append((at, w))
        at += w
    return out


def key_bits(segments: int, max_bits: int = MAX_BITS) -> int:
    """Bits of the narrowest chain that must be equal."""
    ring = _segments(segments)
    free = max(n for n in range(1, segments + 1) if n * max_bits < segments)
    return min(sum(ring[(i + k) % segments][1] for k in range(free)) for i in range(segments))


def ring_for(n: int, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> int:
    """Segments for n distinct fingerprints: the fewest, SEGMENTS at least, whose keys hold an eighth of a bucket of unrelated
    fingerprints on average, or those with the widest keys."""
    rings = [m for m in (SEGMENTS, 7, 9, 13, 21) if m > max_bits]
    enough = [m for m in rings if n <= bucket / 8 * 2.0 ** key_bits(m, max_bits)]
    return enough[0] if enough else max(rings, key=lambda m: key_bits(m, max_bits))


def _mask(parts: list[tuple[int, int]]) -> int:
    m = 0
    for at, w in parts:
        m |= ((1 << w) - 1) << at
    return m - (1 << 64) if m >> 63 else m


def links(nodes: DataFrame, max_bits: int = MAX_BITS, segments: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints `nodes(fp)` within `max_bits` bits.

    segments: of the ring, by default as many as the number of fingerprints asks for.

    Fingerprints of ordinary buckets get an edge for every linked pair. Those of crowded buckets get
    edges to the smallest fingerprint of each shared key, which connects the same components.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("crowded buckets are linked exactly for max_bits 0 to 2")
    if segments is None:
        segments = ring_for(nodes.count(), max_bits, bucket)
    if segments <= max_bits:
        raise ValueError("segments must exceed max_bits")
    ring = _segments(segments)
    chain = [[ring[(i + k) % segments] for k in range(segments)] for i in range(segments)]
    free = max(n for n in range(1, segments + 1) if n * max_bits < segments)  # chains that must be equal

    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("r"),
                              F.col("fp").bitwiseAND(F.lit(_mask(c[:free]))).alias("key"))
                     for i, c in enumerate(chain)])
    rows = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.r", "k.key")
    sizes = rows.groupBy("r", "key").count().where("count > 1")
    full = land(rows.join(sizes, ["r", "key"]), "simhash-buckets")

    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))

    def within(i: int) -> Column:
        ok = F.lit(True)
        for n in range(free + 1, segments + 1):
            ok = ok & (F.bit_count(x.bitwiseAND(F.lit(_mask(chain[i][:n])))) <= n * max_bits // segments)
        return ok

    ring_ok = F.lit(False)
    for i in range(segments):
        ring_ok = ring_ok | ((F.col("a.r") == i) & within(i))
    small = full.where(F.col("count") <= bucket).select("r", "key", "fp")
    pairs = (small.alias("a").join(small.alias("b"), (F.col("a.r") == F.col("b.r")) & (F.col("a.key") == F.col("b.key"))
                                   & (F.col("a.fp") < F.col("b.fp")) & ring_ok & (F.bit_count(x) <= max_bits))
             .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")))

    crowded = full.where(F.col("count") > bucket).select("fp").distinct()
    near = [F.col("fp")]
    if max_bits == 2:
        near += [F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k)) for k in range(64)]
    if max_bits == 1:  # the two ends of each possible edge, named by the end with the bit cleared, and the bit
        near = [F.concat_ws(":", F.col("fp").bitwiseAND(F.lit(~(1 << k) if k < 63 else (1 << 63) - 1)), F.lit(k))
                for k in range(64)]
    shared = (crowded.select("fp", F.explode(F.array(*near)).alias("key"))
              .groupBy("key").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
              .select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")))
    return pairs.union(shared.where("u != v").select("u", "v"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, segments: int | None = None,
                    bucket: int = BUCKET) -> DataFrame:
    """(doc_id, th, fp, root, component_id) for every row of `docs(doc_id, text)`.

    doc_id is a long. root is the smallest fingerprint of the component and names it. component_id is the smallest doc_id that links reach, the row's own included. Null and blank texts
    have fingerprint zero and link like any other. Null doc_ids are never a component_id unless no other
    is reached (then it is null). Extra columns are ignored; an empty table gives an empty result.
    """
    fps = land(fingerprints(docs, shingle), "simhash-fps")
    nodes = land(fps.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("least")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"), max_bits, segments, bucket))
    of = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.where("fp != root").groupBy("root").agg(F.min("least").alias("other"))
    named = (of.join(least, "root", "left").where("fp = root")
             .select("root", F.least("least", F.coalesce("other", F.lit(_NO_ID))).alias("component_id")))
    named = of.select("fp", "root").join(named, "root").select(
        "fp", "root", F.expr(f"nullif(component_id, {_NO_ID})").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """One row of each near-duplicate component: the one with the smallest doc_id, nulls last, then the smallest th.

    Texts that no link joins are never one group, whether their doc_ids are null, repeated or neither. Rows that agree in doc_id and text are one document; any one of them stands for it. Only those
    (usually none) are shuffled for it; all other rows need the one join with the kept ids.
    """
    cols = docs.columns
    found = land(near_duplicates(docs, **params), "simhash-found")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "th"))
    keep = land(found.groupBy("root").agg(first.alias("f"))
                .select(F.col("f.id").alias("_id"), F.col("f.th").alias("_th"))
                .join(found.groupBy(F.coalesce("doc_id", F.lit(_NO_ID)).alias("_id"), F.col("th").alias("_th"))
                      .count(), ["_id", "_th"]), "simhash-keep")
    keyed = packed(docs, F.coalesce("doc_id", F.lit(_NO_ID)).alias("_i"), F.xxhash64("text").alias("_t"))
    on = F.expr("_i = _id and _t = _th")
    once = unpacked(keyed.join(keep.where("count = 1"), on, "left_semi"), cols)
    repeated = keep.where("count > 1")
    if repeated.isEmpty():
        return once
    return once.union(unpacked(keyed.join(repeated, on, "left_semi").dropDuplicates(["_i", "_t"]), cols))
