"""Assembly job: n-best, span search and per-example argmax against a
brute-force Python model; containment, completeness, as-of merge; gold
passage normalisation and scores."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanqa.operators import assemble, goldp, model, tokenize
from spanqa.operators.joins import landed
from spanqa.plans import predict
from spanqa.plans import prepare as P
from spanqa.session import work_path
from spanqa.sources import derived, readers

from conftest import SF001


def _best(windows, beam=30, max_len=100):
    """Highest value of the whole start x end score matrix with everything
    invalid at -inf; ties by window, then rank of the start, then of the end."""
    tables = []
    for _, so, eo, sl, el in windows:
        s, e = np.array(sl), np.array(el)
        rank = [1 + np.argsort(-x[1:], kind="stable")[:beam] for x in (s, e)]
        i, j = rank[0][:, None], rank[1][None, :]
        ok = (j >= i) & (j < i + max_len) & (np.array(so)[i] >= 0) & (np.array(eo)[j] >= 0)
        tables.append(np.where(ok, s[i] + e[j] - (s[0] + e[0]), -np.inf))
        tables[-1] = (tables[-1], rank)
    top = [t.max() for t, _ in tables]
    k = int(np.argmax(top))
    if top[k] == -np.inf:
        return None
    t, (ri, rj) = tables[k]
    a, b = np.unravel_index(t.argmax(), t.shape)
    return float(top[k]), windows[k][1][ri[a]], windows[k][2][rj[b]] + 1


@pytest.fixture(scope="module")
def eval_features(spark):
    docs = derived.documents(spark, SF001)
    path = tokenize.write_vocab_file(derived.derive_vocab_lines(docs), work_path(spark, "p-vocab"))
    vocab = landed(readers.read_vocab(spark, path), "p-vocab-t")[0]
    raw = landed(derived.raw_examples(docs), "p-raw")[0]
    return landed(P.prepare(raw, vocab, is_training=False).features, "p-feat")[0]


def test_nbest_ties_lower_index_first(spark):
    df = spark.createDataFrame([([9.0, 1.0, 3.0, 3.0, 2.0, 3.0],)], "l array<double>")
    r = assemble.nbest(df, "l", 3, "nb").select(assemble.nbest_indexes("nb").alias("i")).first()
    assert list(r.i) == [2, 3, 5]


def test_best_span_matches_brute_force(spark, eval_features):
    res = landed(model.score_batches(eval_features, model.arithmetic_scorer), "p-res")[0]
    wb = assemble.window_best_spans(eval_features, res)
    best = assemble.best_spans(wb, assemble.complete_examples(eval_features, res))
    got = {r.example_index: (r.score, r.start_byte, r.end_byte) for r in best.collect()}
    f = {(r.example_index, r.doc_span_index): r for r in eval_features.collect()}
    rs = {(r.example_index, r.doc_span_index): r for r in res.collect()}
    per = {}
    for k in sorted(f):
        per.setdefault(k[0], []).append((k[1], f[k].wp_start_offset, f[k].wp_end_offset,
                                         rs[k].start_logits, rs[k].end_logits))
    want = {ex: b for ex, ws in per.items() if (b := _best(ws)) is not None}
    assert got == want
    seen = spark.sparkContext.accumulator(0)

    def counted(batch):
        seen.add(len(batch))
        return model.arithmetic_scorer(batch)

    docs = derived.documents(spark, SF001)
    cands = derived.raw_examples(docs).select("example_id", "passage_answer_candidates")
    records = predict.predict(eval_features, cands, counted).collect()
    assert seen.value == len(f)  # every window is scored once
    assert {r.example_id: (r.minimal_answer_score, r.minimal_answer.start_byte_offset, r.minimal_answer.end_byte_offset)
            for r in records} == want


def test_containment_and_completeness(spark):
    cands = spark.createDataFrame([(1, [(0, 10, 0, 10), (11, 20, 11, 20), (0, 30, 0, 30)])],
                                  "example_id long, passage_answer_candidates array<struct<plaintext_start_byte: long, "
                                  "plaintext_end_byte: long, html_start_byte: long, html_end_byte: long>>")
    spans = cands.select("passage_answer_candidates", F.inline(F.array(
            F.struct(F.lit(12).alias("s"), F.lit(15).alias("e")), F.struct(F.lit(8).alias("s"), F.lit(14).alias("e")),
            F.struct(F.lit(40).alias("s"), F.lit(45).alias("e")))))
    got = [r.p for r in spans.select(F.expr(assemble.passage_of_span_expr("passage_answer_candidates", "s", "e"))
                                     .alias("p")).collect()]
    assert got == [1, 2, 0]
    f = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "example_index long, doc_span_index int")
    r = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 5)], "example_index long, doc_span_index int")
    c = {x.example_index: x.complete for x in assemble.complete_examples(f, r).collect()}
    assert c == {1: True, 2: False}


def test_asof_merge_small(spark):
    ex = spark.createDataFrame([(10,), (20,), (30,)], "example_id long")
    ft = spark.createDataFrame([(10,), (11,), (19,), (20,), (35,)], "unique_ids long")
    rs = spark.createDataFrame([(9,), (29,)], "unique_id long")
    got = sorted((r.source, r.datum_id, r.example_id) for r in assemble.asof_merge(ex, ft, rs).collect())
    assert got == [("feature", 10, 10), ("feature", 11, 10), ("feature", 19, 20), ("feature", 20, 20),
                   ("feature", 35, 30), ("result", 9, 10), ("result", 29, 30)]


def test_asof_merge_many_blocks(spark):
    """Equal to a sequential merge however the rows are dealt out."""
    ex = [(i * 40,) for i in range(1, 60)]
    ft = [(i * 40 + k,) for i in range(60) for k in range(0, 40, 2)]
    rs = [(i * 40 + k,) for i in range(60) for k in range(0, 40, 3)]
    every = sorted([(k, 0, k) for (k,) in ex] + [(u + 1, 1, u) for (u,) in rs] + [(u + 1, 2, u) for (u,) in ft])
    want, last = [], None
    for key, src, datum in every:
        if src == 0:
            last = datum
        else:
            want.append((("result", "feature")[src - 1], datum, last))
    frames = [spark.createDataFrame(x, t) for x, t in ((ex, "example_id long"), (ft, "unique_ids long"), (rs, "unique_id long"))]
    size, parts = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"
    before = spark.conf.get(size), spark.conf.get(parts)
    try:
        for advisory, n in (("64m", "8"), ("1k", "8"), ("100b", "40")):
            spark.conf.set(size, advisory)
            spark.conf.set(parts, n)
            got = [(r.source, r.datum_id, r.example_id) for r in assemble.asof_merge(*frames).collect()]
            assert sorted(got, key=str) == sorted(want, key=str)
            f = {r.source: (r.n_matched, r.n_failed) for r in assemble.failed_matches(assemble.asof_merge(*frames)).collect()}
            assert f == {s: (sum(w[0] == s and w[2] is not None for w in want), sum(w[0] == s and w[2] is None for w in want))
                         for s in ("result", "feature")}
    finally:
        spark.conf.set(size, before[0])
        spark.conf.set(parts, before[1])


def test_split_fails_on_invalid_ids(spark):
    for bad in ("nodash", "klingon-3", None):
        preds = spark.createDataFrame([("english-1", "a"), (bad, "b")], "id string, answer string")
        with pytest.raises(Exception, match="invalid id"):
            goldp.write_split(preds, work_path(spark, "t-split"))
    out = work_path(spark, "t-split")
    goldp.write_split(spark.createDataFrame([("english-1", "a"), ("korean-2", "b")], "id string, answer string"), out)
    assert spark.read.json(out).count() == 2


def test_squad_tokens(spark):
    df = spark.createDataFrame([("x\u00a0y",), ("The d\u00eda, a\u2003 an!",), ("",), ("\u00e9an\u00e7",)], "t string")
    got = [list(r.x) for r in df.select(goldp.normalized_tokens("t").alias("x")).collect()]
    assert got == [["x", "y"], ["d\u00eda"], [], ["\u00e9an\u00e7"]]


def test_squad_normalisation_and_scores(spark):
    ds = spark.createDataFrame([("english-1", 0, "The Cat sat!"), ("english-1", 1, "a dog"), ("swahili-2", 0, "x y z"),
                                ("korean-3", 0, "q")], "id string, answer_pos int, answer_text string")
    pr = spark.createDataFrame([("english-1", "cat  sat"), ("swahili-2", "x y y")], "id string, answer string")
    got = {r.id: (r.exact_match, round(r.f1, 6)) for r in goldp.squad_scores(ds, pr).collect()}
    assert got == {"english-1": (1.0, 1.0), "swahili-2": (0.0, round(2 * (2 / 3) * (2 / 3) / (4 / 3), 6)),
                   "korean-3": (0.0, 0.0)}
    v = {r.id: r.error for r in goldp.with_language(spark.createDataFrame(
        [("english-1", "a"), ("thai-2", "b"), ("nodash", "c")], "id string, answer string")).collect()}
    assert v["english-1"] is None and v["thai-2"] and v["nodash"]


def test_arithmetic_scorer_values():
    b = pd.DataFrame({"unique_ids": [5], "example_index": [5], "doc_span_index": [0], "input_ids": [[0] * 4],
                      "input_mask": [[1] * 4], "segment_ids": [[0] * 4]})
    out = model.arithmetic_scorer(b)
    assert list(out.start_logits[0]) == [((5000 * 31 + i * 7) % 97) / 8.0 for i in range(4)]
