"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are cut into pieces of at most `PIECE` words that overlap by half or more, so that any run of
`PIECE // 2` words lies within a piece. All n-grams of a piece are seeds,
however common, so that an edited copy of a passage that very many documents hold is found by whatever part it keeps.
One scan of the documents emits the n-grams that a bitmap of all seeds lets through (of at most 2^`BITMAP_BITS` bits,
whatever the size of the benchmark); joined with the seeds they give, per seed, the number of documents that hold it,
and, per document, the pieces on which a rare seed (found in at most `RARE_SHARE` of all documents, or `RARE_DOCS`
documents) or two others hit. In a second scan the words of these documents around the hits' diagonals are aligned with the
pieces by Smith-Waterman; a document is contaminated by an item if a
local alignment reaches `MIN_SCORE` of the piece's perfect score, or if a stretch of it holds `RUN_WORDS` matched
words more than `RUN_EDIT` for each of its edits (so any verbatim run of `RUN_WORDS` words does, however long the piece).

Test items under `MIN_WORDS` words are looked up as they are: a document that holds the whole item as a sequence of
words is contaminated. In scripts written without spaces every character is a word.

The benchmark never passes through the driver. Documents are shuffled only if the table of candidates is too
large to be broadcast.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanqa.llm.common import land, packed, unpacked
from spanqa.operators.joins import join_dimension

N = 3
PIECE = 64
MIN_WORDS = 8
BITMAP_BITS = 27
#: Words whose hashes a task remembers before it forgets them all.
REMEMBERED = 500_000
RARE_SHARE = 1e-4
RARE_DOCS = 5
MIN_SCORE = 0.5
RUN_WORDS = 13
RUN_EDIT = 3
MATCH, MISMATCH, GAP = 2, 1, 1
#: Matched words from which on a contaminated document is dropped.
DROP_WORDS = 5
#: Scripts without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, Tai, kana, Bopomofo, Han. Vowel signs and tone marks are characters too.
_UNSPACED = ("\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ebd\u0ec0-\u0ecd\u0edc-\u0edf\u0f40-\u0fbc\u1000-\u103f\u1050-\u108f"
             "\u1780-\u17d3\u1950-\u19c9\u1a20-\u1a7c\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3041-\u3096\u309d-\u309f"
             "\u30a1-\u30fa\u30fc-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ef\uaa60-\uaadf"
             "\uf900-\ufaff\uff66-\uff9d\U0001b000-\U0001b16f\U00020000-\U0003ffff")
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")
HIT = "array<struct<item_id:long,score:double,matched:int,start:int,end:int,item_start:int,item_end:int>>"


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def pieces(text: str | None) -> list[list[str]]:
    """The whole text up to PIECE words, else pieces of PIECE words at most half a piece apart; none without a word."""
    w = tokens(text)
    if not w:
        return []
    more = max(0, len(w) - PIECE)
    k = -(-more // (PIECE // 2))
    return [w[a:a + PIECE] for a in (more * i // max(1, k) for i in range(k + 1))]


def ngrams(words: list[str]):
    return zip(*(words[i:] for i in range(N)))


def align(item: list[str], window: list[str], match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[int, int, int, int, int, int]:
    """Best local alignment: (score, matches, window start, window end, item start, item end)."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(item))}
    x = np.array([ids[w] for w in item])
    y = np.array([ids.get(w, -1) for w in window])
    n = len(y)
    step = gap * np.arange(n + 1)
    h = np.zeros((len(x) + 1, n + 1), np.int32)
    for i, v in enumerate(x, 1):
        row = np.maximum(h[i - 1] - gap, 0)
        np.maximum(row[1:], h[i - 1, :-1] + np.where(y == v, match, -mismatch), out=row[1:])
        h[i] = np.maximum.accumulate(row + step) - step
    i, j = divmod(int(h.argmax()), n + 1)
    best, end, item_end, matches = int(h[i, j]), j, i, 0
    while i and j and h[i, j]:
        same = x[i - 1] == y[j - 1]
        if h[i, j] == h[i - 1, j - 1] + (match if same else -mismatch):
            matches += int(same)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - gap:
            i -= 1
        else:
            j -= 1
    return best, matches, j, end, i, item_end


class Block:
    """Seeds of some pieces: n-gram -> [(piece, position, rare)]; short items: first word -> {words: [item_id]}."""

    def __init__(self, items: list[tuple[int, list[str]]], df: Counter, n_docs: int, min_score: float):
        self.items, self.min_score = items, min_score
        self.seeds: dict[tuple, list[tuple[int, int, bool]]] = defaultdict(list)
        rare = max(RARE_DOCS, RARE_SHARE * n_docs)
        self.short: dict[str, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, (item_id, words) in enumerate(items):
            if len(words) < MIN_WORDS:
                self.short[words[0]][tuple(words)].append(item_id)
                continue
            for i, g in enumerate(ngrams(words)):
                self.seeds[g].append((k, i, df[g] <= rare))
        self.seeds = dict(self.seeds)
        self.short = {w: dict(of) for w, of in self.short.items()}
        self.lengths = {w: sorted(set(map(len, of))) for w, of in self.short.items()}

    def hits(self, text: str | None) -> list[dict]:
        """Contaminating items of a text, one entry an item, in the order of item_id."""
        found = list(_WORD.finditer((text or "").lower())) if text else []
        words = [m.group() for m in found]
        seeds = self.seeds
        by: dict[int, list[tuple[int, int, bool]]] = defaultdict(list)
        for j in [j for j, g in enumerate(ngrams(words)) if g in seeds]:
            for k, i, rare in seeds[tuple(words[j:j + N])]:
                by[k].append((j - i, i, rare))
        best: dict[int, dict] = {}
        for k, places in by.items():
            item_id, item = self.items[k]
            pad = 8 + len(item) // 4
            places.sort()
            at = 0
            while at < len(places):
                upto = at + 1
                while upto < len(places) and places[upto][0] - places[upto - 1][0] <= pad and \
                        places[upto][0] - places[at][0] <= 2 * len(item):
                    upto += 1
                group, at = places[at:upto], upto
                if len({i for _, i, _ in group}) < 2 and not any(r for _, _, r in group):
                    continue
                lo, hi = max(0, group[0][0] - pad), min(len(words), group[-1][0] + len(item) + pad)
                score, matched, s, e, i0, i1 = align(item, words[lo:hi])
                share = score / (MATCH * len(item))
                enough = share >= self.min_score and matched >= min(MIN_WORDS, len(item))
                if not enough and score >= MATCH * RUN_WORDS:
                    run, matched, s, e, i0, i1 = align(item, words[lo:hi], 1, RUN_EDIT, RUN_EDIT)
                    enough = run >= RUN_WORDS
                    share = (MATCH * matched - (matched - run) // RUN_EDIT) / (MATCH * len(item))
                if enough and share > best.get(item_id, {"score": 0})["score"]:
                    best[item_id] = {"item_id": item_id, "score": share, "matched": matched,
                                     "start": found[lo + s].start(), "end": found[lo + e - 1].end(),
                                     "item_start": i0, "item_end": i1}
        for j in [j for j, w in enumerate(words) if w in self.short] if self.short else []:
            for n in self.lengths[words[j]]:
                for item_id in self.short[words[j]].get(tuple(words[j:j + n]), ()):
                    if best.get(item_id, {"score": 0})["score"] < 1:
                        best[item_id] = {"item_id": item_id, "score": 1.0, "matched": n, "start": found[j].start(),
                                         "end": found[j + n - 1].end(), "item_start": 0, "item_end": n}
        return [best[i] for i in sorted(best)]


_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(MIN_WORDS)], np.uint64)


class Grams:
    """Hashes of the word sequences of a length; words are hashed once while they are remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def words(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def of(hashes: np.ndarray, length: int) -> np.ndarray:
        """Signed hashes of all sequences of `length` words."""
        n = len(hashes) - length + 1
        if n < 1:
            return np.zeros(0, np.int64)
        h = np.full(n, length, np.uint64)
        for k in range(length):
            h += hashes[k:k + n] * _POWERS[k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h.view(np.int64)


def cut_items(benchmark: DataFrame) -> DataFrame:
    """(piece, item_id, words, grams), landed: the pieces of all test items and the hashes of their n-grams in order, or of
    the whole of a short item. Items with null id or text, or without a word, have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Grams()
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for words in pieces(text):
                    grams = hashes.of(hashes.words(words), N if len(words) >= MIN_WORDS else len(words))
                    out.append((item, words, grams))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)] if out else
                                             [pa.array([], t) for t in types], ["item_id", "words", "grams"])

    types = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
    items = (benchmark.where("item_id is not null and text is not null")
             .select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct())
    cut = items.mapInArrow(run, "item_id long, words array<string>, grams array<long>")
    return land(cut.select(F.monotonically_increasing_id().alias("piece"), "*"), "decontam-pieces")


def seed_bitmap(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """(bits packed in bytes, number of bits as a power of two) of the hashes `seeds(gram)`; at least 256 bits a hash
    up to the limit of `BITMAP_BITS`."""
    bits = int(np.clip(np.ceil(np.log2(max(1, seeds.count()))) + 8, 16, BITMAP_BITS))
    slot = F.col("gram").bitwiseAND((1 << bits) - 1)
    parts = (seeds.select(F.floor(slot / 32768).alias("part"), (slot % 32768).alias("bit"))
             .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    out = np.zeros(max((1 << bits) // 8, 4096), np.uint8)
    for r in parts:
        out[r.part * 4096:(r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out, bits


def seed_hits(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(key, gram, n), landed: the seeds in the texts of `docs(key, text)`, each once a key; n: rows of the key.

    What the bitmap lets through by chance goes with the join that follows.
    """
    bitmap, bits = seed_bitmap(seeds.select("gram").distinct())
    lengths = sorted(r.length for r in seeds.select("length").distinct().collect())  # 1 to MIN_WORDS - 1
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    mask = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hashes = shared.value, Grams()
        for b in batches:
            keys, found = [], []
            for key, text in zip(b.column(0), b.column(1)):
                if text.is_valid:
                    words = hashes.words(tokens(text.as_py()))
                    grams = np.concatenate([hashes.of(words, n) for n in lengths])
                    slots = grams & mask
                    hit = np.unique(grams[(bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0])
                    keys += [key.as_py()] * len(hit)
                    found.append(hit)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(
                np.concatenate(found) if found else np.zeros(0, np.int64))], ["key", "gram"])

    hits = docs.select("key", F.col("text").cast("string")).mapInArrow(run, "key long, gram long")
    return land(hits.groupBy("key", "gram").agg(F.count("*").alias("n")), "decontam-hits")


def candidates(docs: DataFrame, benchmark: DataFrame, n_docs: int) -> DataFrame:
    """(key, pieces array<struct<item_id, words, df>>): the pieces to align the texts of `docs(key, text)` with; df: how many
    documents hold each of the piece's n-grams."""
    cut = cut_items(benchmark)
    short = F.size("words") < MIN_WORDS
    seeds = land(cut.select("piece", short.alias("short"), F.when(short, F.size("words")).otherwise(N).alias("length"),
                            F.posexplode("grams").alias("i", "gram")), "decontam-seeds")
    if seeds.isEmpty():
        return docs.sparkSession.createDataFrame([], "key long, pieces array<struct<item_id:long,words:array<string>,df:array<long>>>")
    hits = seed_hits(docs, seeds)
    rare = max(RARE_DOCS, RARE_SHARE * n_docs)
    counts = land(hits.join(seeds.select("gram").distinct(), "gram").groupBy("gram").agg(F.sum("n").alias("df")), "decontam-df")
    known = land(seeds.join(counts, "gram", "left").select("piece", "short", "i", "gram", F.coalesce("df", F.lit(0)).alias("df")),
                 "decontam-known")
    per_piece = known.groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("i", "df"))).alias("f")).select(
        "piece", F.col("f.df").alias("df"))
    enough = (hits.join(known, "gram").groupBy("key", "piece")
              .agg(F.count("*").alias("seeds"), F.max(F.col("short") | (F.col("df") <= rare)).alias("sure"))
              .where("seeds >= 2 or sure").select("key", "piece"))
    whole = cut.select("piece", "item_id", "words").join(per_piece, "piece")
    return enough.join(whole, "piece").groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("item_id", "words", "df"))).alias("pieces"))


def contamination(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """`docs` plus `contaminated_by`: for each test item found, its id, score (share of the perfect alignment; below
    `min_score` where a run of words alone is the finding), matched words, span in the text (code points of the lower-cased text) and in the piece (words).

    Null and empty texts and empty tables give empty arrays. A column of that name is replaced, all others pass through.
    """
    columns = [c for c in docs.columns if c.lower() != "contaminated_by"]
    rows = packed(docs.select(*["`" + c.replace("`", "``") + "`" for c in columns]), F.xxhash64("text").alias("key"),
                  F.col("text").cast("string").alias("text"))
    n_docs = docs.count()
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("matched", pa.int32()), ("start", pa.int32()),
                               ("end", pa.int32()), ("item_start", pa.int32()), ("item_end", pa.int32())]))
    with_pieces = join_dimension(rows, candidates(rows, benchmark, n_docs), ["key"], name="decontam-candidates", how="left")

    @F.arrow_udf(HIT)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        @lru_cache(maxsize=16)
        def block(key: tuple) -> Block:
            df = Counter({g: c for _, words, counts in key for g, c in zip(ngrams(words), counts)})
            return Block([(i, list(words)) for i, words, _ in key], df, n_docs, min_score)

        for texts, found in batches:  # row by row: a batch's pieces as Python values would be many times its size
            out = []
            for t, ps in zip(texts, found):
                key = tuple((p["item_id"], tuple(p["words"]), tuple(p["df"])) for p in ps.as_py()) if ps.is_valid else ()
                out.append(block(key).hits(t.as_py()) if key else [])
            yield pa.array(out, kind)

    return unpacked(with_pieces.withColumn("hits", run("text", "pieces")), [*columns, "contaminated_by"],
                    {"contaminated_by": F.col("hits")})


def clean(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, drop_words: int = DROP_WORDS) -> DataFrame:
    """The documents without a contamination of `drop_words` matched words or more: the name of a city may be a test item,
    but doesn't make every text about the city a leak. Same columns."""
    found = contamination(packed(docs, "text"), benchmark, min_score)
    leaked = F.exists("contaminated_by", lambda h: h["matched"] >= drop_words)
    return unpacked(found.where(~leaked), docs.columns)
