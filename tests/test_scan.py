"""Line lineage against sequential numbering, counts of the scan itself, failures, reports of preparation."""

import gzip
import json

import pytest
from spanqa.operators import scan
from spanqa.plans import prepare as P
from spanqa.sources import readers


def line(i, cands=((0, 5), (6, 11)), ann=(), text="abcde fghij"):
    return json.dumps({
        "example_id": i, "language": "english", "document_title": f"t{i}", "document_url": "", "document_plaintext": text,
        "question_text": "what?", "passage_answer_candidates": [
            {"plaintext_start_byte": s, "plaintext_end_byte": e, "html_start_byte": s, "html_end_byte": e} for s, e in cands],
        "annotations": [{"annotation_id": 18446744073709551615, "passage_answer": {"candidate_index": c},
                         "minimal_answer": {"plaintext_start_byte": s, "plaintext_end_byte": e}, "yes_no_answer": "NONE"}
                        for c, s, e in ann]})


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Files with blank and broken lines, carriage returns, no last line end, gzip; path -> lines in order."""
    d = tmp_path_factory.mktemp("examples")
    out = {}
    for f in range(4):
        lines = []
        for k in range(0 if f == 3 else 301):
            i = f * 1000 + k
            lines.append("" if k % 17 == 3 else "{broken" if k % 29 == 4 else line(i, cands=()) if k % 23 == 5
                         else line(i, text="abcde fghij " + "x" * (k % 7 * 90)) + ("\r" if k % 11 == 1 else ""))
        body = "\n".join(lines) + ("" if f == 1 else "\n" if lines else "")
        path = d / (f"part-{f}.jsonl" + (".gz" if f == 2 else ""))
        path.write_bytes(gzip.compress(body.encode()) if f == 2 else body.encode())
        out[path.name] = lines
    return d, out


@pytest.mark.parametrize("split", [700, 5000, 10_000_000])
def test_line_numbers(spark, files, split):
    d, lines = files
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = scan.scan_examples(spark, f"{d}/*.jsonl*")
        rows = got.entries.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    found = {(r.file.rsplit("/", 1)[1], r.line_no): (r.example_id, r.reject_reason) for r in rows}
    expect = {}
    for name, ls in lines.items():
        for no, x in enumerate(ls, 1):
            try:
                e = json.loads(x)
                expect[name, no] = (e["example_id"], None if e["passage_answer_candidates"] else "no_candidates")
            except ValueError:
                expect[name, no] = (None, "invalid_json")
    assert len(rows) == len(expect) and found == expect
    ok = sum(v[1] is None for v in expect.values())
    assert (got.survivors, got.pruned) == (ok, len(expect) - ok)


def test_failures(spark, tmp_path):
    with pytest.raises(ValueError, match="No paths"):
        scan.scan_examples(spark, f"{tmp_path}/none-*.jsonl")
    (tmp_path / "bad.jsonl").write_text(line(1, cands=()) + "\n")
    with pytest.raises(ValueError, match="No surviving"):
        scan.scan_examples(spark, f"{tmp_path}/bad.jsonl")
    (tmp_path / "mixed.jsonl").write_text(line(1) + "\n\n" + line(2, cands=()) + "\n")
    with pytest.raises(ValueError, match=r"mixed.jsonl:2 \(invalid_json\)"):
        scan.scan_examples(spark, f"{tmp_path}/mixed.jsonl", fail_on_invalid=True)
    assert scan.scan_examples(spark, f"{tmp_path}/mixed.jsonl").survivors == 1


@pytest.fixture(scope="module")
def vocab(spark, tmp_path_factory):
    from spanqa.constants import SPECIAL_TOKENS
    p = tmp_path_factory.mktemp("vocab") / "vocab.txt"
    words = [*SPECIAL_TOKENS, *[f"[ContextId={i}]" for i in range(4)], "abcde", "fgh", "##ij", "what", "?"]
    p.write_text("\n".join(words) + "\n")
    return readers.read_vocab(spark, str(p))


def test_reports(spark, vocab, tmp_path):
    empty, right = [(0, 2, 2)], [(1, 6, 11)]
    ls = [line(i, ann=empty if i % 3 == 0 else right) for i in range(60)] + ["", line(60, cands=())]
    (tmp_path / "a.jsonl").write_text("\n".join(ls[:40]))
    (tmp_path / "b.jsonl").write_text("\n".join(ls[40:]))
    entries = scan.scan_examples(spark, f"{tmp_path}/*.jsonl").entries
    pr = P.prepare_entries(entries, vocab, is_training=True, include_unknowns=1.0, max_seq_length=70)
    got = {(r.file.rsplit("/", 1)[1], r.line_no): r for r in scan.preparation_report(entries, pr.errors, 25).collect()}
    place = {i: ("a.jsonl", i + 1) if i < 40 else ("b.jsonl", i - 39) for i in range(60)}
    wanted = {place[i]: ("no wordpiece in answer span" if i % 3 == 0 else "", i < 25)
              for i in range(60) if i % 3 == 0 or i < 25}
    assert {k: (r.errors, r.is_first) for k, r in got.items()} == wanted
    assert {r.example_index for r in pr.features.collect()} == {i for i in range(60) if i % 3}
    s = scan.error_sample(entries, pr.errors, 7).orderBy("rank").collect()
    assert [(r["rank"], r.example_id) for r in s] == [(k + 1, 3 * k) for k in range(7)]
    with pytest.raises(ValueError, match="creating example 0: no wordpiece"):
        P.prepare_entries(entries, vocab, is_training=True, max_seq_length=70, fail_on_error=True)
