"""Pieces placed in the plaintext and answers found over all examples of a batch, as by expressions row by row."""

import pytest
from pyspark.sql import functions as F

from spanqa import schemas
from spanqa.functions import lists
from spanqa.operators import features
from spanqa.plans import prepare as P

VOCAB = "[UNK] [CLS] [SEP] [Q] [ContextId=0] [ContextId=1] ab ##c d ##e , ##b a".split()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame(list(enumerate(VOCAB)), "id long, token string")


def _prepared(spark, vocab, is_training):
    text = "ab abc, d " * 400
    raw = spark.createDataFrame([(i, "english", "t", "", text, "q", [(0, len(text), 0, len(text))], [(None, (0,), (3, 6), "NONE")])
                                 for i in range(3)], schemas.RAW_EXAMPLE)
    return P.prepare(raw, vocab, is_training=is_training, include_unknowns=1.0)


def test_labels_and_errors_make_no_window_arrays(spark, vocab):
    p = _prepared(spark, vocab, True)
    for d in (p.features.select("doc_span_index", "start_positions", "end_positions", "answer_types"), p.errors):
        assert "array_repeat" not in _plan(d) and "zip_with" not in _plan(d)
    assert p.errors.count() == 0 and p.features.where("start_positions > 0").count() >= 3


def test_pieces_are_placed_as_by_expressions(spark):
    segments = [[(3, 8, 100), (10, 14, 50)], [], [(0, 4, -3), (4, 4, 9), (6, 9, 20)], [(2, None, 7), (None, None, 8)], None]
    starts = [[0, 3, 7, 8, 10, 13, 14, -1], [0, 5], [0, 3, 4, 6, 8, 9], [1, 2, 5], []]
    spans = [(3, 9), (0, 2), (5, 4), (None, 3), (1, None)]
    rows = [(k, s, [x + 1 for x in s], g, *span) for k, (s, g, span) in enumerate(zip(starts, segments, spans))]
    kind = "array<struct<ctx_start: long, ctx_end: long, plain_start: long>>"
    df = spark.createDataFrame(rows, f"k int, s array<long>, e array<long>, g {kind}, a long, b long")
    want = df.orderBy("k").select(*[F.expr(features.to_plaintext_expr(c, "g")) for c in ("s", "e")], F.expr(
        "coalesce(" + features.has_wordpiece("s", "e", "a", "b") + ", a < b AND null)"), F.expr(
        features.nearest_right("s", "e", "a")), F.expr(features.nearest_left("s", "e", "b - 1"))).collect()
    cols = df.orderBy("k").toArrow().combine_chunks()
    s, e, g, a, b = (c.combine_chunks() for c in cols.columns[1:])
    _, plain_s, plain_e, any_piece, first, last = (x.to_pylist() for x in features.located(s, s, e, g, []) + features.answer_pieces(
        lists.values(s), lists.values(e), lists.lengths(s), a, b))
    for k, (x, y) in enumerate(spans):
        has = None if x is None or y is None else x < y
        has = False if has is False or any_piece[k] is False else None if has is None or any_piece[k] is None else True
        assert (plain_s[k], plain_e[k], first[k], last[k]) == (want[k][0], want[k][1], want[k][3], want[k][4])
        assert has == want[k][2]
