"""Longest match, invalid bytes, segments, ideographs, fixed-length reads, repeat and buffer shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from spanqa.constants import SPECIAL_TOKENS
from spanqa.functions.bytes import decode_ignoring_errors
from spanqa.functions.longest_match import LongestMatch
from spanqa.functions.spans import merge_segments, segment_positions
from spanqa.operators import entry, tokenize, training
from spanqa.sources import readers


def greedy(word, vocab):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            token = ("##" if at else "") + word[at:end]
            if token in vocab:
                out.append((vocab[token], len(word[at:end].encode())))
                at = end
                break
        else:
            return None
    return out or None


def vocabularies(n):
    rnd = random.Random(4)
    for k in range(n):
        signs = "ab#é" if k % 3 == 0 else "abc"
        vocab = {}
        for _ in range(rnd.randint(1, 12)):
            token = rnd.choice(["", "##"]) + "".join(rnd.choices(signs, k=rnd.randint(1, 5)))
            vocab.setdefault(token, len(vocab))
        yield vocab, ["".join(rnd.choices(signs, k=rnd.randint(0, 9))) for _ in range(25)]


def test_longest_match():
    for vocab, words in vocabularies(1500):
        match = LongestMatch(list(vocab.items()), "##")
        for w in words:
            assert match(w) == greedy(w, vocab), (w, vocab)


def test_long_words_are_linear():
    match = LongestMatch([(p + "a" * k, k) for k in range(1, 200) for p in ("", "##")], "##")
    n = 400_000
    assert sum(size for _, size in match("a" * n)) == n
    assert match("a" * n + "b") is None


def test_both_forms_agree(spark):
    vocab, words = {t: i for i, t in enumerate([*SPECIAL_TOKENS, "un", "##aff", "##able", "able", "##a", "##", "日", "##本"])}, []
    rnd = random.Random(1)
    words = ["unaffable", "ableaff", "x", "", "日本", "un" + "aff" * 80] + ["".join(rnd.choices(["un", "aff", "able", "a", "日本"], k=3)) for _ in range(50)]
    v = spark.createDataFrame(list(vocab.items()), "token string, id long")
    w = spark.createDataFrame([(x,) for x in dict.fromkeys(words)], "word string")
    a = {r.word: [tuple(x) for x in r.wps] for r in tokenize.wordpiece_words(w, v).collect()}
    b = {r.word: [tuple(x) for x in r.wps] for r in tokenize.wordpiece_words(w, v, max_vocab_bytes=0).collect()}
    assert a == b and a["unaffable"] == [(vocab["un"], 2), (vocab["##aff"], 3), (vocab["##able"], 4)]
    assert a["un" + "aff" * 80] == [(vocab["[UNK]"], 242)]


def test_bytes_ignored(spark):
    rnd = random.Random(8)
    parts = [b"a", "é".encode(), "中".encode(), "𝒳".encode(), b"\x80", b"\xc3", b"\xe4\xb8", b"\xf0\x9d\x92", b"\xff", b"\xc0\xaf",
             b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xe0\x80\x80", b"\x00", b"\n"]
    rows = [(i, bytearray(b"".join(rnd.choices(parts, k=rnd.randint(0, 12))) if i % 2 else rnd.randbytes(rnd.randint(0, 20))))
            for i in range(2000)] + [(2000, bytearray(b"ab\xff" * 100_000)), (2001, None)]
    df = spark.createDataFrame(rows, "i int, b binary").select("i", decode_ignoring_errors("b").alias("t"))
    raw = dict(rows)
    for r in df.collect():
        assert r.t == (None if raw[r.i] is None else bytes(raw[r.i]).decode("utf-8", "ignore"))


def test_segments(spark):
    rnd = random.Random(3)
    rows = [(i, [(s, s + rnd.randint(-2, 6)) for s in (rnd.randint(0, 30) for _ in range(rnd.randint(0, 6)))]) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, s array<struct<start:int,end:int>>")
    got = df.select("i", merge_segments(F.col("s")).alias("m")).select("i", "m", segment_positions(F.col("m")).alias("p"))
    given = dict(rows)
    for r in got.collect():
        assert r.p == sorted({x for s, e in given[r.i] for x in range(s, e)})
        assert all(a.end < b.start for a, b in zip(r.m, r.m[1:]))


def test_candidate_text(spark):
    df = spark.createDataFrame([(0, "héllo wörld", [(0, 6), (7, 13)]), (1, "héllo wörld", [(0, 6), (7, 13)])],
                               "i long, document_plaintext string, passage_answer_candidates "
                               "array<struct<plaintext_start_byte:long,plaintext_end_byte:long>>")
    assert [(r.cand.start, r.cand_text) for r in entry.candidate_text(df, "i").orderBy("i").collect()] == [(0, "héllo"), (7, "wörld")]
    for bad in (-1, 2, None):
        off = df.withColumn("i", F.lit(bad).cast("long"))
        with pytest.raises(Exception, match="Invalid index for passage candidate"):
            entry.candidate_text(off, "i").count()
        assert {r.cand_text for r in entry.candidate_text(off, "i", on_range="null").collect()} == {None}


def test_isolated_ideographs(spark):
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate([*SPECIAL_TOKENS, "ab", "中", "文", "##文", "中文", "é"])],
                                  "token string, id long")
    texts = spark.createDataFrame([(1, "ab中文é 中")], "k long, text string")
    ids = {r.token: r.id for r in vocab.collect()}
    r = tokenize.tokenize_texts(texts, vocab, ["k"], isolate_cjk=True).first()
    assert (r.wp_ids, r.wp_starts, r.wp_ends) == ([ids["ab"], ids["中"], ids["文"], ids["é"], ids["中"]], [0, 2, 5, 8, 11], [1, 4, 7, 9, 13])
    r = tokenize.tokenize_texts(texts, vocab, ["k"]).first()
    assert r.wp_ids == [ids["[UNK]"], ids["中"]]


def test_fixed_lengths(spark, tmp_path):
    rows = [(i, i, 3, [1] * (4 if i != 5 else 3), [1] * 4, [0] * 4, [0] * 4, [0] * 4 if i != 6 else None) for i in range(8)]
    path = str(tmp_path / "f")
    spark.createDataFrame(rows, "unique_ids long, example_index long, language_id long, input_ids array<long>, input_mask array<long>, "
                          "segment_ids array<long>, wp_start_offset array<long>, wp_end_offset array<long>").write.parquet(path)
    with pytest.raises(Exception, match="not 4 values in an array of feature"):
        readers.read_features(spark, path, 4, is_training=False).select("example_index").collect()
    assert readers.read_features(spark, path, 4, False, on_length="drop").count() == 6
    kept = readers.read_features(spark, path, 4, False, on_length="keep")
    assert kept.count() == 8 and dict(kept.dtypes)["language_id"] == "int"


@pytest.mark.parametrize("size", [1, 7, 100, 5000])
def test_buffer_shuffle(spark, size):
    n = 1300
    rows = spark.range(n).select(F.col("id").alias("position"), (F.col("id") * 3).alias("payload")).repartition(9)
    got = training.buffer_shuffled(training.repeated(rows, 3), size, seed=5).collect()
    assert sorted(r.position for r in got) == list(range(3 * n))
    assert sorted((r.epoch, r.payload) for r in got) == [(e, 3 * i) for e in range(3) for i in range(n)]
    assert all(abs(r.position - r.position_before) < size and r.position_before == r.epoch * n + r.payload // 3 for r in got)
    moved = sum(r.position != r.position_before for r in got)
    assert moved == 0 if size == 1 else moved > n
    again = training.buffer_shuffled(training.repeated(rows.repartition(3), 3), size, seed=5).collect()
    assert {(r.position, r.payload) for r in again} == {(r.position, r.payload) for r in got}
    assert training.repeated(rows, 0).count() == 0
