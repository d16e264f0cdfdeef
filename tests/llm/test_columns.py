"""Columns of the documents with the names that operators use or add: no crash, and unchanged values."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanqa.llm import decontam, mixing, pii, simhash, toxicity

#: Names used within the operators, and names they add.
NAMES = ("whole e1 e2 base rest target weight source_size size repeats taken epoch _s _b1 _b2 _size s cum _first row _i _t _id "
         "_th th count fp root component_id least other node u v m _d _x _h _b extra base_ spans found kind value pattern conf "
         "toxicity offending _r _y y f c a contaminated_by item_id words k g n score held_out doc path digest lo hi start stop "
         "Row_ `odd` a.b").split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"some words of text number {i % 7} mail a{i}@example.org end", "en", f"s{i % 3}", 40, *[f"{n}-{i}" for n in NAMES])
            for i in range(40)] + [(None, None, None, None, None, *[None] * len(NAMES))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES))


def names(row):
    return tuple(row[5:5 + len(NAMES)])


def check(df, docs, all_rows=True):
    rows = df.collect()
    given = {r.doc_id: r for r in docs.collect()}
    assert df.columns[:len(docs.columns)] == docs.columns
    assert all(names(r) == names(given[r.doc_id]) for r in rows)
    if all_rows:
        assert {r.doc_id for r in rows} == given.keys()


def test_operators(spark, docs):
    bench = spark.createDataFrame([(1, "some quite different test item with enough words in it")], "item_id long, text string")
    check(pii.redact(docs), docs)
    check(simhash.keep_one(docs), docs, False)
    check(decontam.clean(docs, bench), docs)
    check(mixing.mix(docs, replace=False), docs)
    assert mixing.mix(docs).columns.count("size") == 1
    plain = toxicity.Model({}, __import__("numpy").zeros(0), -20.0)
    assert toxicity.score(docs, plain).count() == docs.count()


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, stage, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(i, 0, i % 2) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "a test item of more than eight words that no document holds")], "item_id long, text string"
                          ).write.parquet(f"{sf}/benchmark.parquet")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, sf)
    check(out, docs, False)
    if stage != "mixing":
        assert out.columns == docs.columns
    else:
        added = out.columns[len(docs.columns):]
        assert len({c.lower() for c in out.columns}) == len(out.columns) and "epoch_" in added and "repeats_" in added
    assert out.where(F.col("doc_id").isNull()).count() == (0 if stage == "mixing" else 1)
