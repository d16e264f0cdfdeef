"""Digests, sums and narrow arrays of the lists of a batch."""

import hashlib

import pyarrow as pa

from spanqa.functions import lists
from spanqa.functions.narrow import narrowed


def test_digests(monkeypatch):
    rows = [[1, -1, 30], [], None, [5, None, 6], [7] * 9]
    want = [None if r is None else hashlib.md5(",".join(str(x) for x in r if x is not None).encode()).hexdigest() for r in rows]
    for size in (1 << 20, 3):
        monkeypatch.setattr(lists, "STEP_VALUES", size)
        assert lists.digests(pa.array(rows, pa.list_(pa.int32()))).to_pylist() == want
    got = lists.sums(a := pa.array([[1, 2], [], None], pa.list_(pa.int32())), lists.values(a))
    assert got.to_pylist() == [3, 0, None]


def test_narrow_arrays_without_lambdas(spark):
    df = spark.createDataFrame([(1, [5, -1, 7])], "k int, a array<int>")
    assert "lambda" not in narrowed(df, ["a"])._jdf.queryExecution().executedPlan().toString()
