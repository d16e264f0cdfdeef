"""Preparation job: tokenizer rules, windows, contexts and features, checked
against literal cases and a brute-force Python model of the same rules."""

import re
import unicodedata
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spanqa import schemas
from spanqa.functions.lang import language_id_strict
from spanqa.operators import alignment, entry, features, tokenize, training
from spanqa.operators.joins import landed
from spanqa.plans import prepare as P
from spanqa.session import work_path
from spanqa.sources import derived, readers

from conftest import SF001


@pytest.fixture(scope="module")
def vocab(spark):
    docs = derived.documents(spark, SF001)
    path = tokenize.write_vocab_file(derived.derive_vocab_lines(docs), work_path(spark, "t-vocab"))
    return landed(readers.read_vocab(spark, path), "t-vocab-table")[0]


@pytest.fixture(scope="module")
def vocab_dict(vocab):
    return {r.token: r.id for r in vocab.collect()}


# ---------------------------------------------------------------- brute force

SPECIAL = {"[CLS]", "[SEP]", "[PAD]", "[Q]", "[YES]", "[NO]", "[NoLongAnswer]", "[NoShortAnswer]", "[SA]", "[/SA]",
           "[UNK]", "[MASK]"}


def _bad(ch):
    return ord(ch) in (0, 0xFFFD) or (ch not in "\t\n\r" and unicodedata.category(ch) in ("Cc", "Cf"))


def _punct(ch):
    cp = ord(ch)
    return 33 <= cp <= 47 or 58 <= cp <= 64 or 91 <= cp <= 96 or 123 <= cp <= 126 or \
        unicodedata.category(ch).startswith("P")


def _basic(token):
    """Bad characters are emitted as met; good characters accumulate in a run
    that only whitespace (or the end) closes; a closed run is split around
    punctuation."""
    out, run = [], []

    def close():
        cur = []
        for ch in run:
            if _punct(ch):
                if cur:
                    out.append(("".join(cur), True))
                    cur = []
                out.append((ch, True))
            else:
                cur.append(ch)
        if cur:
            out.append(("".join(cur), True))
        run.clear()

    for ch in token:
        if _bad(ch):
            out.append((ch, False))
        elif ch.isspace():
            close()
            out.append((ch, True))
        else:
            run.append(ch)
    close()
    return out


def _longest_first(pieces):
    return "|".join(re.escape(p) for p in sorted(pieces, key=len, reverse=True)) or r"(?!)"


class _Pieces:
    """Longest match first as one regular expression: an atomic head and atomic
    continuations that never give a character back."""

    def __init__(self, vocab):
        self.vocab = vocab
        self.head = _longest_first([t for t in vocab if t and not t.startswith("##")] + [t for t in vocab if t.startswith("##")])
        self.tail = _longest_first([t[2:] for t in vocab if len(t) > 2 and t.startswith("##")])
        self.whole = re.compile(f"(?>{self.head})(?>{self.tail})*+", re.S)
        self.first, self.next = re.compile(self.head, re.S), re.compile(self.tail, re.S)

    def of(self, word):
        if len(word) > 200 or not self.whole.fullmatch(word):
            return [(self.vocab["[UNK]"], len(word.encode()))]
        head = self.first.match(word).group()
        rest = [m.group() for m in self.next.finditer(word, len(head))]
        return [(self.vocab[head], len(head.encode()))] + [(self.vocab["##" + p], len(p.encode())) for p in rest]


def _tokenize(text, pieces_of):
    vocab = pieces_of.vocab
    ids, starts, ends, at = [], [], [], 0
    for tok in text.split(" "):
        if tok in SPECIAL or tok.startswith("[Paragraph=") or tok.startswith("[ContextId="):
            pieces = [(vocab[tok], len(tok.encode()))]
        else:
            pieces = []
            for sub, good in _basic(tok):
                pieces += pieces_of.of(sub) if good else [(vocab.get(sub, vocab["[UNK]"]), len(sub.encode()))]
        rel = 0
        for pid, nb in pieces:
            ids.append(pid)
            starts.append(at + rel)
            ends.append(at + rel + nb - 1)
            rel += nb
        at += len(tok.encode()) + 1
    return ids, starts, ends


# ---------------------------------------------------------------- tests

def test_basic_split_cases(spark):
    df = spark.createDataFrame([("a\x00b",), ("x中y",), ("ab,c\td​e!",), ("",)], "token string")
    got = {r.token: [(p.piece, p.good) for p in r.p]
           for r in df.select("token", F.expr(tokenize.basic_split_expr("token")).alias("p")).collect()}
    for tok, pieces in got.items():
        assert pieces == _basic(tok), tok
    assert got["a\x00b"] == [("\x00", False), ("ab", True)]
    assert got["x中y"] == [("x中y", True)]


def test_tokenizer_matches_brute_force(spark, vocab, vocab_dict):
    raw = derived.raw_examples(derived.documents(spark, SF001))
    e = landed(entry.build_entries(raw).where("reject_reason IS NULL"), "t-entries")[0]
    lit = spark.createDataFrame([(-1, "[CLS] [ContextId=0] This is a test."), (-2, "a\x00b  x中y\tz, [Q] q")],
                                "example_id long, text string")
    texts = e.select("example_id", F.col("contexts").alias("text")).unionByName(lit)
    got = {r.example_id: (list(r.wp_ids), list(r.wp_starts), list(r.wp_ends))
           for r in tokenize.tokenize_texts(texts, vocab, ["example_id"]).collect()}
    pieces_of = _Pieces(vocab_dict)
    want = {r.example_id: _tokenize(r.text, pieces_of) for r in texts.collect()}
    assert set(got) == set(want)
    bad = [k for k in want if got[k] != tuple(map(list, want[k])) and got[k] != want[k]]
    assert not bad, bad[:5]


@pytest.mark.parametrize("n,w,stride,expected", [
    (0, 5, 2, []), (3, 5, 2, [(0, 3)]), (10, 5, 2, [(0, 5), (2, 5), (4, 5), (6, 4)]),
    (10, 3, 8, [(0, 3), (3, 3), (6, 3), (9, 1)]),
])
def test_windows_cases(spark, n, w, stride, expected):
    df = spark.createDataFrame([(n, w)], "n int, w int")
    got = df.select(F.expr(features.windows_expr("n", "w", stride)).alias("x")).first().x
    assert [(x.start, x.length) for x in got] == expected


def test_windows_property(spark):
    """First start 0, constant steps of min(window, stride), last end n, no
    earlier window reaching n, every position covered."""
    cases = [(n, w, s) for n in range(0, 40) for w in range(1, 12) for s in (1, 2, 3, 5, 8, 13)]
    df = spark.createDataFrame(cases, "n int, w int, s int")
    for s in (1, 2, 3, 5, 8, 13):
        rows = df.where(F.col("s") == s).select("n", "w", F.expr(features.windows_expr("n", "w", s)).alias("x"))
        for r in rows.collect():
            starts, ends = [x.start for x in r.x], [x.start + x.length for x in r.x]
            if r.n == 0:
                assert starts == []
                continue
            assert starts == list(range(0, len(starts) * min(r.w, s), min(r.w, s)))
            assert ends[-1] == r.n and all(e < r.n for e in ends[:-1])
            assert all(e - b == min(r.w, r.n - b) for b, e in zip(starts, ends))
            assert set().union(*(range(b, e) for b, e in zip(starts, ends))) == set(range(r.n))


def test_contexts_layout(spark):
    row = ("1", "english", "t", "", "ab c", "q", [(0, 2, 0, 2), (3, 4, 3, 4)], [])
    raw = spark.createDataFrame([(1, *row[1:])], schemas.RAW_EXAMPLE)
    e = entry.build_entries(raw).first()
    assert e.contexts == "[ContextId=0] ab [ContextId=1] c"
    assert [(s.ctx_start, s.ctx_end, s.plain_start) for s in e.segments] == [(14, 16, 0), (31, 32, 3)]
    assert e.reject_reason is None and e.answer.candidate_id == -1


def test_reversed_span_is_legal_for_preparation(spark):
    text = "In motion [CLS] [Q] picture terminology,"
    rows = [(1472936222771770808 + i, "english", "Feature length", "", text,
             "What is the average length of a feature-length motion picture?", [(0, 30, 0, 30)],
             [(Decimal(11725509819744756779), (0,), (7, 2), "NONE")]) for i in range(10)]
    raw = spark.createDataFrame(rows, schemas.RAW_EXAMPLE)
    e = entry.build_entries(raw)
    assert e.where("reject_reason IS NULL").count() == 10
    r = e.first()
    assert r.name == "Feature length" and r.id == str(r.example_id)


def test_features_shape_and_offsets(spark, vocab, vocab_dict):
    raw = landed(derived.raw_examples(derived.documents(spark, SF001)), "t-raw")[0]
    pr = P.prepare(raw, vocab, is_training=False)
    f = pr.features.collect()
    assert f and all(len(r.input_ids) == 512 and len(r.wp_start_offset) == 512 for r in f)
    assert all(r.input_ids[0] == vocab_dict["[CLS]"] for r in f)
    for r in f:
        n_real = sum(r.input_mask)
        nq = sum(1 for x in r.segment_ids[:n_real] if x == 0) - 2
        # a question longer than 64 pieces keeps its last 64, losing the [Q] marker
        assert nq <= 64 and (nq == 64 or r.input_ids[1] == vocab_dict["[Q]"])
        assert r.input_ids[n_real - 1] == vocab_dict["[SEP]"] and all(x == 0 for x in r.input_ids[n_real:])
        assert all(s <= e for s, e in zip(r.wp_start_offset, r.wp_end_offset) if s >= 0 and e >= 0)
    # every document wordpiece is in some window
    ex = {r.example_id: len(r.wp_ids) for r in pr.examples.select("example_id", "wp_ids").collect()}
    covered = {}
    for r in f:
        covered[r.example_index] = covered.get(r.example_index, 0) + sum(r.segment_ids) - 1
    assert all(covered.get(k, 0) >= n for k, n in ex.items())


def test_training_labels_point_at_mapped_pieces(spark, vocab):
    raw = landed(derived.raw_examples(derived.documents(spark, SF001)), "t-raw2")[0]
    pr = P.prepare(raw, vocab, is_training=True, include_unknowns=1.0)
    rows = pr.features.collect()
    pos = [r for r in rows if r.answer_types != 0]
    assert pos and any(r.answer_types == 0 for r in rows)
    for r in pos:
        assert 0 < r.start_positions <= r.end_positions < 512
        assert r.segment_ids[r.start_positions] == 1 and r.segment_ids[r.end_positions] == 1


WORDS = "[UNK] [CLS] [SEP] want ##want ##ed wa un runn ##ing , [unused0]".split()


@pytest.fixture(scope="module")
def small_vocab(spark):
    return spark.createDataFrame(list(enumerate(WORDS)), "id long, token string")


@pytest.mark.parametrize("preserve,ids", [(False, [7, 4, 5, 10, 8, 9] + [0] * 9), (True, [7, 4, 5, 10, 8, 9, 11] + [0] * 6)])
def test_destructive_tokenizer_published_values(spark, small_vocab, preserve, ids):
    df = spark.createDataFrame([(1, "UNwantéd,running [unused0] [CLS] [unused55]")], "k long, text string")
    assert list(tokenize.full_tokenize(df, small_vocab, ["k"], True, preserve).first().ids) == ids


@pytest.mark.parametrize("text,lower,tokens", [
    ("ah博推zz", True, ["ah", "博", "推", "zz"]), (" \tHeLLo!how  \n Are yoU?  ", True, ["hello", "!", "how", "are", "you", "?"]),
    (" \tHeLLo!how  \n Are yoU?  ", False, ["HeLLo", "!", "how", "Are", "yoU", "?"]), ("Héllo", True, ["hello"])])
def test_destructive_split_published_values(spark, text, lower, tokens):
    df = spark.createDataFrame([(text,)], "text string")
    words = df.select(F.posexplode(tokenize.destructive_clean_split("text")).alias("i", "word"))
    by = {r.word: list(r.tokens) for r in tokenize.destructive_word_tokens(words.select("word").distinct(), lower).collect()}
    assert [t for r in words.orderBy("i").collect() for t in by[r.word]] == tokens


def test_wordpieces_published_values(spark, small_vocab):
    df = spark.createDataFrame([("unwanted",), ("unwantedX",), ("running",)], "word string")
    got = {r.word: [WORDS[p.id] for p in r.wps] for r in tokenize.wordpiece_words(df, small_vocab).collect()}
    assert got == {"unwanted": ["un", "##want", "##ed"], "unwantedX": ["[UNK]"], "running": ["runn", "##ing"]}


def test_offset_tokenizer_keeps_unused_tokens(spark, small_vocab):
    toks = spark.createDataFrame([("[unused0]",), ("[unused55]",), ("un,want",)], "token string")
    got = {r.token: [(p.id, p.rel_start, p.nbytes) for p in r.pieces]
           for r in tokenize.token_pieces(toks, small_vocab, preserve_unused=True).collect()}
    assert got["[unused0]"] == [(11, 0, 9)] and got["un,want"] == [(7, 0, 2), (10, 2, 1), (3, 3, 4)]
    assert [p[1:] for p in got["[unused55]"]] == [(0, 1), (1, 8), (9, 1)]


def test_repeated_example_ids_stay_apart(spark, vocab):
    rows = [(7, "english", "t", "", t, "q", [(0, len(t), 0, len(t))], []) for t in ("ab cd", "xy z", "ab cd")]
    pr = P.prepare(spark.createDataFrame(rows, schemas.RAW_EXAMPLE), vocab, is_training=False)
    ex = pr.examples.select("example_id", "row_key", "wp_ids").collect()
    assert len(ex) == 3 and len({r.row_key for r in ex}) == 3 and {r.example_id for r in ex} == {7}
    one = P.prepare(spark.createDataFrame(rows[:1], schemas.RAW_EXAMPLE), vocab, is_training=False).examples.first().wp_ids
    assert sorted(map(list, (r.wp_ids for r in ex))).count(list(one)) == 2
    assert pr.features.count() == 3


def test_oversampled_shuffled_batches(spark):
    ex = spark.createDataFrame([("english",)] * 25 + [("finnish",)] * 2 + [("thai",)] * 10, "language string")
    ratios = training.language_ratios(ex)
    assert {r.language: (r.n_examples, r.ratio) for r in ratios.collect()} == {
        "english": (25, 1), "finnish": (2, 10), "thai": (10, 2)}
    f = spark.createDataFrame([(1, 10), (1, 2), (2, 2), (3, 9), (4, 0)], "example_index long, language_id int")
    many = training.oversample(f, ratios)
    assert {(r.example_index, r.language_id): r["count"] for r in many.groupBy("example_index", "language_id").count().collect()} == {
        (1, 10): 1, (1, 2): 10, (2, 2): 10, (3, 9): 2, (4, 0): 1}
    keys = ["example_index", "language_id", "copy"]

    def order(seed, parts):
        rows = training.shuffled(many.repartition(parts), keys, seed).orderBy("position").collect()
        assert [r.position for r in rows] == list(range(24))
        return [tuple(r[k] for k in keys) for r in rows]

    assert order(1, 3) == order(1, 7) != order(2, 3)
    b = training.batches(training.shuffled(many, keys), 5).groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in b} == {0: 5, 1: 5, 2: 5, 3: 5}


def test_shards_are_whole_files(spark):
    rows = [(e, k) for e in range(0, 70, 3) for k in range(1 + e % 4)]
    f = spark.createDataFrame(rows, "example_index long, doc_span_index int").repartition(5)
    path = work_path(spark, "t-shards")
    counts = {r.shard: (r.n_examples, r.n_features) for r in training.write_shards(f, path, 7).collect()}
    ids = sorted({e for e, _ in rows})
    want = {k: ids[7 * k:7 * k + 7] for k in range(4)}
    assert counts == {k: (len(v), sum(1 + e % 4 for e in v)) for k, v in want.items()}
    back = spark.read.parquet(path).select("*", F.input_file_name().alias("file")).collect()
    assert sorted((r.example_index, r.doc_span_index) for r in back) == sorted(rows)
    assert {r.example_index for r in back if r.shard == 2} == set(want[2])
    assert len({r.file for r in back}) == 4
    empty = training.write_shards(f.limit(0), work_path(spark, "t-shards"), 7)
    assert empty.count() == 0


def test_training_rows(spark, vocab):
    raw = landed(derived.raw_examples(derived.documents(spark, SF001)), "t-raw3")[0]
    plain = P.prepare(raw, vocab, is_training=True).features.groupBy("language_id").count()
    rows = landed(P.training_rows(raw, vocab, oversample=True, seed=3), "t-rows")[0]
    ratio = {r.id: r.ratio for r in training.language_ratios(raw).select(
        language_id_strict("language").cast("int").alias("id"), "ratio").collect()}
    assert {r.language_id: r["count"] for r in rows.groupBy("language_id").count().collect()} == {
        r.language_id: r["count"] * ratio[r.language_id] for r in plain.collect()}
    assert sorted(r.position for r in rows.select("position").collect()) == list(range(rows.count()))


def test_cut_bytes_repair(spark):
    texts = ["", "a", "é", "aé中😀z", "😀😀", "中a中", "plain words"]
    df = spark.createDataFrame([(t, s, n) for t in texts for s in range(4) for n in range(7)], "t string, s int, n int")
    raw = alignment.cut_bytes("t", F.col("s"), F.col("n"))
    for r in df.select("*", F.is_valid_utf8(raw).alias("ok"), F.make_valid_utf8(raw).alias("fixed")).collect():
        b = r.t.encode()[r.s:r.s + r.n]
        assert r.fixed == b.decode("utf-8", "replace") and r.ok == ("�" not in r.fixed)


def test_alignment_report_matches_brute_force(spark, vocab, vocab_dict):
    raw = derived.raw_examples(derived.documents(spark, SF001).where("doc_id < 12"))
    e = landed(entry.build_entries(raw).where("reject_reason IS NULL"), "t-entries2")[0]
    tt = landed(tokenize.tokenize_texts(e.select("example_id", F.col("contexts").alias("text")), vocab, ["example_id"]), "t-tok")[0]
    names = {i: t for t, i in vocab_dict.items()}
    toks = {r.example_id: r for r in tt.collect()}
    want = {}
    for r in e.collect():
        ctx, plain = r.contexts.encode(), r.plaintext.encode()
        for at in range(0, len(ctx), 20):
            p = next((g.plain_start + at - g.ctx_start for g in r.segments if g.ctx_start <= at < g.ctx_end), -1)
            t = toks[r.example_id]
            inside = [names[i] for i, s in zip(t.wp_ids, t.wp_starts) if at <= s < at + 20]
            want[r.example_id, at] = (ctx[at:at + 20].decode("utf-8", "replace"), p, len(inside), " ".join(inside),
                                      plain[p:p + 20].decode("utf-8", "replace") if p >= 0 else None)
    got = {(r.example_id, r.at): (r.ctx_text, r.plain_at, r.n_wordpieces, r.wordpieces, r.plain_text)
           for r in alignment.slice_report(e, tt, vocab).collect()}
    assert got == want
    for r in alignment.answer_context(e).join(e.select("example_id", F.col("contexts").alias("c"), F.col("answer").alias("a")),
                                              "example_id").collect():
        c, s, t = r.c.encode(), r.a.span_start, r.a.span_end
        assert (r.answer, r.before, r.after) == (c[s:t].decode("utf-8", "replace"), c[max(0, s - 100):s].decode("utf-8", "replace"),
                                                 c[t:t + 100].decode("utf-8", "replace"))
