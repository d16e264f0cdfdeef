"""Approximate nearest neighbours by inner product with an inverted multi-index.

The two halves of the vectors have codebooks of their own (k-means in numpy on a bounded sample of `SAMPLE`
vectors in expectation); a cell is a pair of centroids. A query takes the cells in the order of their summed
distance from its halves, with a heap over the centroid pairs, until they hold enough vectors. Those are reranked
by the exact inner product of the original vectors.

How many vectors are enough is measured, not guessed: for `TRIALS` queries in expectation the exact neighbours are
found by a scan of all vectors, and the number of candidates is the smallest that reaches `RECALL` of them. Vectors
that form clusters need few; vectors without any structure need a share of the table.

Every vector is indexed. Cells are packed into blocks of about `BLOCK` vectors (a larger cell is split) that meet
chunks of about `BLOCK` queries, so neither a crowded cell nor a popular one lands in one task. A block that holds a
cell the query takes is reranked whole, by one matrix product and an exact sum for what that leaves; it passes on only
what can still be among the nearest found: scores not below those of the nearest in the codebook sample, as far as
the probe reaches it, which is a part of the candidates and so gives a lower bound. The cell table
(at most MAX_CENTROIDS squared counts) is all that passes through the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanqa.llm.common import land

SAMPLE = 20_000
MAX_CENTROIDS = 512
PER_CELL = 48
TRIALS = 64
RECALL = 0.95
BLOCK = 4_096
#: Queries that are multiplied with a block at once.
SLICE = 256
TOP = 20


def usable(v: Column) -> Column:
    """Whether a vector is neither null nor zero and all its components are finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        s = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def _matrix(col) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


class Index:
    """Codebooks of the halves, how many vectors each cell holds, and in which blocks it lies."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray]):
        self.books = books
        self.half = books[0].shape[1]
        self.count(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def count(self, cells: np.ndarray, counts: np.ndarray) -> None:
        self.counts = np.zeros(len(self.books[0]) * len(self.books[1]), np.int64)
        self.counts[cells] = counts
        upto = self.counts.cumsum()
        self.first = (upto - self.counts) // BLOCK
        self.last = np.maximum(upto - 1, 0) // BLOCK

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (((c * c).sum(1) - 2 * part @ c.T).argmin(axis=1)
                for part, c in ((x[:, :self.half], self.books[0]), (x[:, self.half:], self.books[1])))
        return a * len(self.books[1]) + b

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance of the query's halves from their centroids, without the query's own norm."""
        return tuple((c * c).sum(1) / 2 - c @ part for part, c in zip((q[:self.half], q[self.half:]), self.books))

    def probe(self, q: np.ndarray, candidates: int) -> list[int]:
        """Cells in the order of summed distance until they hold enough vectors."""
        d1, d2 = self.distances(q)
        o1, o2 = d1.argsort(kind="stable").tolist(), d2.argsort(kind="stable").tolist()
        d1, d2, m, counts = d1[o1].tolist(), d2[o2].tolist(), len(o2), self.counts
        heap, out, held = [(d1[0] + d2[0], 0, 0)], [], 0
        while heap and held < candidates:
            _, i, j = heapq.heappop(heap)
            n = counts[o1[i] * m + o2[j]]
            if n:
                out.append(o1[i] * m + o2[j])
                held += n
            if j + 1 < m:
                heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(o1):
                heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
        return out

    def needed(self, q: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many vectors a probe holds once it has reached each of `cells`."""
        d1, d2 = self.distances(q)
        order = (d1[:, None] + d2[None]).ravel().argsort(kind="stable")
        held = np.empty_like(self.counts)
        held[order] = self.counts[order].cumsum()
        return held[cells]


def inner_products_of(q: np.ndarray, i: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows i of q with the rows j of x, each summed in the order of the components, so that
    equal vectors tie exactly."""
    out = np.zeros(len(i))
    for c in range(q.shape[1]):
        out += q[i, c] * x[j, c]
    return out


def best_of(found: DataFrame, top: int) -> DataFrame:
    """The `top` rows of each query by score, ties to the smaller vec_id."""
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= top)


def top_rows(qid: np.ndarray, q: np.ndarray, bound: np.ndarray, ids: np.ndarray, x: np.ndarray, cells: np.ndarray,
             top: int) -> pa.Table:
    """Each query's best rows among those that reach its bound; never rows with its own id. `ids` ascend.

    One matrix product finds what can be among them, give or take its rounding; only that is summed exactly.
    """
    out: list[tuple[np.ndarray, ...]] = []
    if len(ids):
        largest = np.sqrt((x * x).sum(axis=1).max())
        for lo in range(0, len(qid), SLICE):
            part, own = q[lo:lo + SLICE], qid[lo:lo + SLICE]
            slack = 1e-12 * (1 + np.sqrt((part * part).sum(axis=1)) * largest)
            near = part @ x.T
            near[own[:, None] == ids[None]] = -np.inf
            least = bound[lo:lo + SLICE]
            if len(ids) > top:
                least = np.maximum(least, np.partition(near, -top, axis=1)[:, -top])
            i, j = np.nonzero((near >= (least - slack)[:, None]) & (near > -np.inf))
            score = inner_products_of(part, i, x, j)
            order = np.lexsort((j, -score, i))
            i, j, score = i[order], j[order], score[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            keep = place < top
            out.append((own[i[keep]], ids[j[keep]], score[keep], cells[j[keep]]))
    got = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 4
    return pa.table([pa.array(c.astype(t)) for c, t in zip(got, (np.int64, np.int64, np.float64, np.int32))],
                    names=["query_id", "vec_id", "score", "cell"])


FOUND = "query_id long, vec_id long, score double, cell int"


def exact(rows: DataFrame, qid: np.ndarray, q: np.ndarray, top: int) -> DataFrame:
    """The exact nearest of a bounded set of queries, by a scan of all vectors."""
    bound = np.full(len(qid), -np.inf)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                order = b.column(0).to_numpy().argsort(kind="stable")
                yield from top_rows(qid, q, bound, b.column(0).to_numpy()[order], _matrix(b.column(1))[order],
                                    b.column(2).to_numpy()[order], top).to_batches()

    return best_of(rows.select("vec_id", "v", "cell").mapInArrow(scan, FOUND), top)


def search(embeddings: DataFrame, is_query: Column, top: int = TOP, candidates: int | None = None,
           recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's `top` nearest found by inner product, ties to the smaller vec_id.

    embeddings: (vec_id, embedding), other columns are ignored. Queries are the rows where `is_query` holds;
    rows with the query's own vec_id are not its neighbours, and of several rows with one query vec_id the least vector is
    the query; a vec_id that is repeated among the candidates counts once a row. candidates: vectors to
    rerank at least, by default as many as `recall` was measured to need. Rows with a null vec_id or an unusable vector take no part, nor do vectors
    whose dimension is not the table's most frequent one. An empty table gives none.
    """
    spark = embeddings.sparkSession
    narrow = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "array<float>" if narrow else "array<double>"  # as stored; all arithmetic is in doubles
    valid = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"))
    sizes = sorted(((r["count"], r.d) for r in valid.groupBy(F.size("v").alias("d")).count().collect()), reverse=True)
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, dim = sizes[0]
    valid = valid.where(F.size("v") == dim)

    def some(df: DataFrame, want: int, have: int) -> pa.Table:
        share = int(min(1.0, want / max(have, 1)) * (1 << 20)) + 1
        return df.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).orderBy("vec_id").select("vec_id", "v").toArrow()

    drawn = some(valid, sample, n)
    if not len(drawn):
        drawn = valid.limit(1).select("vec_id", "v").toArrow()
    x, drawn_ids = _matrix(drawn.column("v")), drawn.column("vec_id").to_numpy()
    k = int(np.clip(round((n / PER_CELL) ** 0.5), 2, MAX_CENTROIDS))
    half = max(1, dim // 2)
    index = Index((kmeans(x[:, :half], k), kmeans(x[:, half:], k, seed=1) if dim > 1 else np.zeros((1, 0))))

    drawn_cells = index.cells(x)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                cells = pa.array(index.cells(_matrix(b.column(1))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns, cells], [*b.schema.names, "cell"])

    rows = land(valid.mapInArrow(assign, f"vec_id long, v {kind}, q boolean, cell int"), "ann-index")
    held = rows.groupBy("cell").count().toArrow()
    index.count(held.column("cell").to_numpy(), held.column("count").to_numpy())
    queries = rows.where("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    if candidates is None:
        trial = some(queries, TRIALS, queries.count())
        need = [n]
        if len(trial):
            qid, q = trial.column("vec_id").to_numpy(), _matrix(trial.column("v"))
            true = exact(rows, qid, q, top).select("query_id", "cell").toArrow()
            of, cells = true.column("query_id").to_numpy(), true.column("cell").to_numpy()
            need = np.concatenate([index.needed(q[i], cells[of == v]) for i, v in enumerate(qid)]) if len(of) else [n]
        candidates = int(np.quantile(need, recall, method="higher"))
    candidates = max(candidates, top + 1)
    row_block = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    splits = land(spark.createDataFrame(pa.table({
        "cell": np.flatnonzero(index.counts).astype(np.int32), "start": index.first[index.counts > 0],
        "parts": (index.last - index.first + 1)[index.counts > 0]})), "ann-cells")
    blocks = rows.join(splits, "cell").select(
        "vec_id", "v", "cell", (F.col("start") + row_block).cast("int").alias("block"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), SLICE):
                part = b.slice(lo, SLICE)
                ids, queries_ = part.column(0).to_numpy(), _matrix(part.column(1))
                near, wanted = queries_ @ x.T, []
                near[ids[:, None] == drawn_ids[None]] = -np.inf
                for i, q in enumerate(queries_):
                    cells = np.array(index.probe(q, candidates))
                    spans = [np.arange(f, l + 1) for f, l in zip(index.first[cells], index.last[cells])]
                    wanted.append(np.unique(np.concatenate(spans)).astype(np.int32))
                    reached = np.zeros(len(index.counts), bool)
                    reached[cells] = True
                    near[i, ~reached[drawn_cells]] = -np.inf
                bound = np.partition(near, -top, axis=1)[:, -top] if len(x) >= top else np.full(len(part), -np.inf)
                bound = bound - 1e-9 * (1 + np.abs(bound)) if len(x) >= top else bound
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(bound), pa.array(wanted, pa.list_(pa.int32()))],
                    ["query_id", "v", "bound", "wanted"])

    probes = land(queries.mapInArrow(probe, f"query_id long, v {kind}, bound double, wanted array<int>"), "ann-probes")
    asked = probes.select("query_id", "v", "bound", F.explode("wanted").alias("block"))
    chunks = land(asked.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks")), "ann-chunks")
    left = (blocks.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .drop("chunks"))
    right = (asked.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
             .drop("chunks"))

    def rerank(vectors: pa.Table, wanted: pa.Table) -> pa.Table:
        vectors = vectors.sort_by("vec_id")
        return top_rows(wanted.column("query_id").to_numpy(), _matrix(wanted.column("v")), wanted.column("bound").to_numpy(),
                        vectors.column("vec_id").to_numpy(), _matrix(vectors.column("v")),
                        vectors.column("cell").to_numpy(), top)

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(rerank, FOUND)
    return best_of(found, top).select("query_id", "rank", "vec_id", "score")
