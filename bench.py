"""Bench: the four jobs end to end at $BENCH_SF_DIR on local[$BENCH_CPUS].

Setup (untimed) writes the derived inputs the way the reference's jobs receive
them: gold articles as gzip JSONL (one shard per core pair, as a sharded corpus
would be - a single gzip file cannot be split), predictions as JSONL, the
vocabulary as a text file, gold-passage data as JSON. A short untimed pass of
the evaluation on the smallest table set warms the JVM (code generation, JIT).
Each timed query starts from the files and ends in an action (write or
collect). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanqa.constants import LANGUAGES  # noqa: E402
from spanqa.operators import goldp, model, tokenize  # noqa: E402
from spanqa.plans import evaluate as E  # noqa: E402
from spanqa.plans import predict as PR  # noqa: E402
from spanqa.plans import prepare as P  # noqa: E402
from spanqa.plans import queries_prepare as QP  # noqa: E402
from spanqa.session import local_session, work_path  # noqa: E402
from spanqa.sources import derived, readers  # noqa: E402


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="spanqa-bench")

    # ---- setup: inputs as files (untimed)
    docs = derived.documents(spark, sf_dir)
    n_shards = max(int(cpus) if cpus.isdigit() else 8, 1) * 2
    gold_path = work_path(spark, "bench-gold")
    derived.raw_examples(docs).repartition(n_shards).write.option("compression", "gzip").json(gold_path)
    pred_path = work_path(spark, "bench-pred")
    derived.predictions(docs).write.json(pred_path)
    vocab_path = tokenize.write_vocab_file(derived.derive_vocab_lines(docs), work_path(spark, "bench-vocab"))
    dpath, ppath = QP._goldp_inputs(spark, sf_dir)
    in_bytes = sum(os.path.getsize(os.path.join(r, f)) for r, _, fs in os.walk(gold_path) for f in fs)
    n_docs = docs.count()

    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir):
        wdocs = derived.documents(spark, warm_dir)
        wg, wp = work_path(spark, "warm-gold"), work_path(spark, "warm-pred")
        derived.raw_examples(wdocs).write.json(wg)
        derived.predictions(wdocs).write.json(wp)
        wev = E.evaluate(readers.read_raw_examples(spark, wg), readers.read_predictions(spark, wp))
        wev.per_language.collect()

    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)

    # Evaluation from files
    def q_evaluate():
        ev = E.evaluate(readers.read_raw_examples(spark, gold_path), readers.read_predictions(spark, pred_path),
                        languages=LANGUAGES)
        ev.per_language.collect()
        ev.macro.collect()
    timed("evaluate", q_evaluate)

    feat_path = work_path(spark, "bench-features")

    # Evaluation features from gzip JSONL
    def q_prepare_eval():
        vocab = readers.read_vocab(spark, vocab_path)
        pr = P.prepare(readers.read_raw_examples(spark, gold_path).drop("_ord"), vocab, is_training=False)
        pr.features.write.mode("overwrite").parquet(feat_path)
    timed("prepare_eval", q_prepare_eval)

    # Training features (negatives sampled at 0.1)
    def q_prepare_train():
        vocab = readers.read_vocab(spark, vocab_path)
        pr = P.prepare(readers.read_raw_examples(spark, gold_path).drop("_ord"), vocab, is_training=True,
                       include_unknowns=0.1)
        pr.features.write.mode("overwrite").parquet(work_path(spark, "bench-train-features"))
    timed("prepare_train", q_prepare_train)

    # Scoring hook + assembly -> prediction JSONL
    def q_predict():
        feats = spark.read.parquet(feat_path)
        cands = readers.read_candidates(spark, gold_path)
        rec = PR.predict(feats, cands, model.arithmetic_scorer)
        PR.write_predictions(rec, work_path(spark, "bench-out-pred"))
    timed("predict", q_predict)

    # Gold-passage split + SQuAD scores
    def q_goldp():
        preds = readers.read_goldp_predictions(spark, ppath + "/*/*")
        goldp.write_split(preds, work_path(spark, "bench-goldp-split"))
        ds = readers.read_goldp_dataset(spark, dpath + "/*/*")
        goldp.macro(goldp.language_scores(goldp.squad_scores(ds, preds))).collect()
    timed("goldp", q_goldp)

    total = round(sum(times.values()), 3)
    out = {
        "metric": "total_sec_four_jobs", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "n_articles": n_docs,
        "prepare_eval_mb_per_s_gz_input": round(in_bytes / 1e6 / max(times["prepare_eval"], 1e-9), 3),
        "evaluate_examples_per_s": round(n_docs / max(times["evaluate"], 1e-9), 1),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
