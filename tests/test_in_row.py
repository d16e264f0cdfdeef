"""Steps that stay in their row or write little: same rows as the joins, without shuffles of text or written windows."""

import pytest
from pyspark.sql import functions as F

from spanqa import schemas
from spanqa.functions.narrow import narrowed, widened
from spanqa.operators import alignment, assemble, tokenize, training
from spanqa.plans import evaluate as E
from spanqa.plans import prepare as P
from spanqa.session import work_path
from spanqa.sources import readers

VOCAB = "[UNK] [CLS] [SEP] [Q] [ContextId=0] [ContextId=1] ab ##c d ##e , 中 é a ##b ​".split()
TEXTS = ["ab abc, d中e", "", " ", "é  ​abc\x00\td,", "[ContextId=0] abc [Q] zz [ContextId=1] d", "x" * 201 + " ab", None, "a b,,c"]


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame(list(enumerate(VOCAB)), "id long, token string")


def _rows(df):
    return sorted(map(repr, df.collect()))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("cjk", [False, True])
def test_texts_are_tokenized_in_their_row(spark, vocab, monkeypatch, cjk):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k long, text string")
    got = tokenize.tokenize_texts(df, vocab, ["k"], marker_prefix="[ContextId=", isolate_cjk=cjk)
    full = [tokenize.full_tokenize(df, vocab, ["k"], lower) for lower in (True, False)]
    words = tokenize.text_tokens(df, ["k"])
    pieces = tokenize.token_pieces(words, vocab, isolate_cjk=cjk)
    for d in (got, *full):
        assert not any(x in _plan(d) for x in ("Join", "Generate", "Aggregate", "Window"))
    now = [_rows(d) for d in (got, pieces, *full)]
    monkeypatch.setattr(tokenize, "piece_table", lambda *a, **k: None)
    then = [tokenize.tokenize_texts(df, vocab, ["k"], marker_prefix="[ContextId=", isolate_cjk=cjk),
            tokenize.token_pieces(words, vocab, isolate_cjk=cjk), *[tokenize.full_tokenize(df, vocab, ["k"], x) for x in (True, False)]]
    assert now == [_rows(d) for d in then] and len(now[0]) == len(TEXTS) - 1


def test_texts_that_share_a_key_are_one_text(spark, vocab, monkeypatch):
    df = spark.createDataFrame([(1, "ab d", 5), (1, "ab d", 6), (None, "abc", 7), (None, "abc", 8), (2, "d ab", 9)],
                               "k long, text string, c int")

    def run():
        return [_rows(tokenize.tokenize_texts(df, vocab, ["k"])), _rows(tokenize.tokenize_texts(df, vocab, ["k"], carry=["c"])),
                _rows(tokenize.full_tokenize(df, vocab, ["k"]))]
    now = run()
    monkeypatch.setattr(tokenize, "piece_table", lambda *a, **k: None)
    assert now == run() and list(map(len, now)) == [3, 5, 3]


def test_missing_special_token_fails(spark, vocab):
    df = spark.createDataFrame([(1, "ab [MASK]")], "k long, text string")
    with pytest.raises(Exception, match="Unrecognized special token: "):
        tokenize.tokenize_texts(df, vocab, ["k"]).collect()


def test_tokens_of_ids(spark, vocab, monkeypatch):
    df = spark.createDataFrame([(1, [6, 7, 99]), (2, [8])], "k long, ids array<long>")
    want = {1: ["ab", "##c", None], 2: ["d"]}
    assert {r.k: r.tokens for r in tokenize.tokens_of_ids(df, vocab, ["k"]).collect()} == want
    monkeypatch.setattr(tokenize, "MAX_VOCAB_BYTES", 0)
    assert {r.k: r.tokens for r in tokenize.tokens_of_ids(df, vocab, ["k"]).collect()} == want


def test_slices_as_joined(spark, vocab, monkeypatch):
    text = "[ContextId=0] ab abc, d中e [ContextId=1] é abc d ab"
    e = spark.createDataFrame([(1, text, text, [(14, 24, 14)]), (2, "", "", []), (3, "d", "d", [])],
                              "example_id long, contexts string, plaintext string, segments array<struct<ctx_start: long, ctx_end: long, plain_start: long>>")
    kept = ["contexts", "plaintext", "segments"]
    tt = tokenize.tokenize_texts(e.where("example_id < 3").select("example_id", F.col("contexts").alias("text"), *kept), vocab,
                                 ["example_id"], carry=kept)
    inside = alignment.slice_report(None, tt, vocab, 7)
    assert "Join" not in _plan(inside) and "Aggregate" not in _plan(inside)
    now, apart = _rows(inside), _rows(alignment.slice_report(e, tt.drop(*kept), vocab, 7))
    monkeypatch.setattr(alignment, "MAX_VOCAB_BYTES", 0)
    assert apart == _rows(alignment.slice_report(e, tt.drop(*kept), vocab, 7))
    assert now == _rows(alignment.slice_report(None, tt, vocab, 7)) and len(now) > 8


def test_features_are_not_written(spark, vocab):
    text = "ab abc, d " * 400
    raw = spark.createDataFrame([(i, "english", "t", "", text, "q", [(0, len(text), 0, len(text))], []) for i in range(20)],
                                schemas.RAW_EXAMPLE)
    f = P.prepare(raw, vocab, is_training=False).features
    train = P.prepare(raw, vocab, is_training=True, include_unknowns=1.0).features
    assert f.count() == train.count() > 100
    assert not any("features" in p or "training-windows" in p for d in (f, train) for p in d.inputFiles())


def test_narrow_arrays_come_back(spark):
    rows = [(1, [5, -1, 32771, 7]), (2, [-1, -1]), (3, []), (4, None), (5, [0, 40000]), (6, [-2, 3]), (7, [3, None])]
    for kind in ("int", "long"):
        df = spark.createDataFrame(rows, f"k int, a array<{kind}>")
        n = narrowed(df, ["a"])
        assert {r.k for r in n.where("a_wide IS NULL AND a_short IS NOT NULL").collect()} >= {2, 3, 6}
        back = widened(n, ["a"])
        assert back.schema["a"].dataType == df.schema["a"].dataType
        assert {r.k: r.a for r in back.collect()} == dict(rows)


def test_windows_of_one_join(spark):
    f = spark.createDataFrame([(1, 0, 2, [-1, 3, 8], [-1, 5, 9]), (1, 1, 2, [-1, -1, -1], [-1, -1, -1]), (2, 0, 3, [-1, 4, 9], [-1, 6, 11])] * 2,
                              "example_index long, doc_span_index int, language_id int, wp_start_offset array<int>, wp_end_offset array<int>")
    r = spark.createDataFrame([(1, 0, [0.0, 2.0, 1.0], [0.5, 1.0, 3.0]), (1, 1, [0.0, 1.0, 1.0], [0.0, 1.0, 1.0])],
                              "example_index long, doc_span_index int, start_logits array<double>, end_logits array<double>")
    w = assemble.window_best_spans(f, r)
    assert _plan(w).count("Join") == 1
    got = sorted((x.doc_span_index, x.n_valid, x.best and (x.best.score, x.best.start_byte, x.best.end_byte)) for x in w.collect())
    assert got == [(0, 6, (4.5, 3, 10))] * 2 + [(1, 0, None)] * 2


def test_shards_keep_their_arrays(spark):
    rows = [(e, 0, [e, 70000 * e], [-1, e], [-1, 40000]) for e in range(9)]
    f = spark.createDataFrame(rows, "example_index long, doc_span_index int, input_ids array<int>, wp_start_offset array<int>, wp_end_offset array<int>")
    path = work_path(spark, "t-shards-arrays")
    training.write_shards(f, path, 4).collect()
    back = spark.read.parquet(path)
    assert sorted(tuple(r) for r in back.select(*f.columns).collect()) == rows
    assert back.select("shard", F.input_file_name()).distinct().count() == 3


def test_evaluation_reads_its_inputs_once(spark):
    path = work_path(spark, "t-gold")
    spark.createDataFrame([(1, "finnish", "t", "", "abc", "q", [(0, 3, 0, 3)], [(None, (0,), (0, 2), "NONE")] * 3)], schemas.RAW_EXAMPLE).write.parquet(path)
    raw = spark.read.parquet(path).withColumn("_ord", F.struct(F.lit("f").alias("file"), F.col("example_id").alias("pos")))
    pred = spark.createDataFrame([(1, "finnish", 0, 1.0, (0, 2), 1.0, "NONE")], "example_id long, language string, passage_answer_index long, "
                                 "passage_answer_score double, minimal_answer struct<start_byte_offset: long, end_byte_offset: long>, "
                                 "minimal_answer_score double, yes_no_answer string").withColumn(
        "_ord", F.struct(F.lit("f").alias("file"), F.col("example_id").alias("pos")))
    ev = E.evaluate(raw, readers.normalize_predictions(pred), languages=["finnish"])
    assert not any("t-gold" in p for p in ev.stats.inputFiles() + ev.gold.inputFiles())
    assert {(r.task, r.f1) for r in ev.stats.collect()} == {("passage", 1.0), ("minimal", 1.0)}


def test_slices_tokenized_a_few_articles_at_a_time(spark, vocab, monkeypatch):
    text = "[ContextId=0] ab abc, d中e [ContextId=1] é abc d ab"
    rows = [(k, text[: 9 * k], text, [(14, 24, 14)]) for k in range(1, 5)] + [(None, text, text, []), (7, None, "", []), (8, "", "", []),
                                                                              (1, "abc d", "abc d", [(0, 5, 0)])]
    e = spark.createDataFrame(rows, "example_id long, contexts string, plaintext string, segments array<struct<ctx_start: long, "
                                    "ctx_end: long, plain_start: long>>").where("contexts IS NOT NULL OR example_id = 7")
    kept = ["contexts", "plaintext", "segments"]
    tt = tokenize.tokenize_texts(e.select("example_id", F.col("contexts").alias("text"), *kept), vocab, ["example_id"], carry=kept)
    want = _rows(alignment.slice_report(None, tt, vocab, 7))
    alone = alignment.slice_report(e.where("example_id > 1"), None, vocab, 7)
    assert alone._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert _rows(alignment.slice_report(e, None, vocab, 7)) == want
    monkeypatch.setattr(tokenize, "piece_table", lambda *a, **k: None)
    assert _rows(alignment.slice_report(e, None, vocab, 7)) == want and len(want) > 20


def test_texts_leave_the_function_a_few_at_a_time(spark, vocab, monkeypatch):
    import pyarrow as pa
    from spanqa.functions import piece_table
    table = tokenize.piece_table(vocab).value
    texts = pa.array(["ab abc " * 50, None, "d", "abc " * 50] * 5)
    whole = [x.as_py() for part in table.texts(texts, None) for x in part]
    monkeypatch.setattr(piece_table, "STEP_BYTES", 300)
    parts = list(table.texts(texts, None))
    assert len(parts) > 5 and [x.as_py() for part in parts for x in part] == whole
