"""Decontamination, licenses, nearest neighbours and the pipeline against brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from spanqa.llm import ann, decontam, licenses, mixing, pii, simhash, toxicity
from spanqa.llm.queries import QUERIES
from .test_simhash import slow_components
from .test_spans import slow_pii

SF = "/root/testdata/sf0.01"


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment():
    rng = random.Random(1)
    for _ in range(60):
        a, b = rng.choices("abcde", k=rng.randint(1, 14)), rng.choices("abcdef", k=rng.randint(1, 25))
        score, matched, s, e, i0, i1 = decontam.align(a, b)
        assert score == smith_waterman(a, b)
        assert smith_waterman(a[i0:i1], b[s:e]) == score and matched <= min(i1 - i0, e - s)


def test_decontamination(spark, odd, none):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(20, 50)))) for i in range(30)]
    items += [(90, "too short"), (91, None), (92, " ".join(rng.choices(vocab, k=400)))]
    docs, planted = [], set()
    for d in range(300):
        w = rng.choices(vocab, k=rng.randint(50, 300))
        if d % 3 == 0:
            i, t = items[d % 30]
            p = [x if rng.random() > 0.12 else rng.choice(vocab) for x in t.split()]
            w[20:20] = p
            planted.add((d, i))
        if d % 50 == 1:
            w[10:10] = items[-1][1].split()[100:260]  # a part of a long item
            planted.add((d, 92))
        docs.append((d, " ".join(w)))
    shared = items[7][1]
    docs += [(1000 + d, f"x{d} y{d} {shared.upper()} z{d}") for d in range(200)]  # a passage that many documents share
    planted |= {(1000 + d, 7) for d in range(200)}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contamination(df, bench).select("doc_id", "text", F.explode("contaminated_by").alias("h")).collect()
    got = {(r.doc_id, r.h.item_id) for r in rows}
    assert got <= planted and len(got) >= 0.97 * len(planted)
    assert {p for p in planted if p[0] >= 1000} <= got
    for r in rows:
        assert 0.5 <= r.h.score <= 1 and 0 <= r.h.start < r.h.end <= len(r.text)
    flagged = {d for d, _ in got}
    assert {r.doc_id for r in decontam.clean(df, bench).collect()} == {d for d, _ in docs} - flagged
    assert decontam.clean(odd, bench).count() == odd.count() and decontam.clean(odd, bench).columns == odd.columns
    assert decontam.clean(none, bench).collect() == [] and decontam.clean(odd, bench.limit(0)).count() == odd.count()


def found_in(items, texts, text):
    """Hits in `text` by the items' pieces, with frequencies from `texts` and it."""
    parts = [(i, p) for i, t in items for p in decontam.pieces(t)]
    df = Counter(g for t in [*texts, text] for g in set(decontam.ngrams(decontam.tokens(t))))
    return decontam.Block(parts, df, len(texts) + 1, decontam.MIN_SCORE).hits(text)


def test_part_copies_of_any_place():
    """A verbatim run is found wherever it lies in an item, across cuts too, and by a run of 13 words; 6 are too few."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(50_000)]
    for n, run in ((63, 31), (63, 13), (400, 56), (400, 28), (400, 13), (65, 13), (1000, 32)):
        item = rng.sample(vocab, n)
        for at in {0, 10, n // 2 - run // 2, n * 3 // 7 - run // 2, n - run}:
            text = " ".join(rng.choices(vocab, k=80) + item[at:at + run] + rng.choices(vocab, k=80))
            hit, = found_in([(1, " ".join(item))], [], text)
            assert hit["matched"] >= min(run, decontam.PIECE // 2)
            assert text[hit["start"]:hit["end"]] in " ".join(item[at:at + run])
        assert found_in([(1, " ".join(item))], [], " ".join(rng.choices(vocab, k=80) + item[20:26])) == []
    item = rng.sample(vocab, 400)
    edited = [w for i, w in enumerate(item[150:170]) if i != 11]  # 19 words, one left out
    assert found_in([(1, " ".join(item))], [], " ".join(rng.choices(vocab, k=80) + edited + rng.choices(vocab, k=80)))
    for n in (8, 64, 65, 96, 97, 1000):
        cut = decontam.pieces(" ".join(vocab[:n]))
        assert max(map(len, cut)) <= decontam.PIECE and {w for p in cut for w in p} == set(vocab[:n])
        assert all(int(b[0][1:]) - int(a[0][1:]) <= decontam.PIECE // 2 for a, b in zip(cut, cut[1:]))


def test_edited_copy_of_a_popular_item():
    """What an edited copy keeps is a seed even where very many documents hold the whole item."""
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(50_000)]
    item = rng.sample(vocab, 40)
    for kept in (range(20, 40), range(20), range(10, 30)):
        text = " ".join(w if i in kept or i % 2 else f"new{i}" for i, w in enumerate(item))
        for copies in (0, 3, 200):
            hit, = found_in([(1, " ".join(item))], [" ".join(item)] * copies, f"some words before {text} some words after")
            assert hit["score"] >= decontam.MIN_SCORE and hit["matched"] >= 29


def test_short_items_and_scripts_without_spaces():
    """Short items count as whole word sequences; Han, kana and Thai texts are taken by characters."""
    items = [(1, "Paris, France"), (2, "Paris"), (3, "?!"), (4, "東京は日本の首都であり世界最大の都市圏です"), (5, "首都"),
             (6, "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย"), (7, "two of four words"), (8, "q=42")]
    for text, ids in (("He lived in PARIS - France.", [1, 2]), ("paris of france, comparison", [2]), ("Parisian, France", []),
                      ("two of the four words; two of four word", []), ("so q 42?", [8]), ("", []), (None, []), ("?!", []),
                      ("昔、東京は日本の首都であり世界最大の都市圏ですと書いた", [4, 5]), ("首 都", [5]), ("首相の都", []),
                      ("xกรุงเทพมหานครเป็นเมืองหลวงของประเทศไทยy", [6])):
        hits = found_in(items, [], text or "") if text else decontam.Block([], Counter(), 0, 0.5).hits(text)
        assert [h["item_id"] for h in hits] == ids, text
    hit, = found_in(items[:1], [], "He lived in PARIS - France.")
    assert (hit["score"], hit["matched"], hit["start"], hit["end"]) == (1.0, 2, 12, 26)


def test_a_large_benchmark(spark):
    """20,000 items in one pass, against blocks of all pieces; the bitmap may be too small for them."""
    rng = random.Random(14)
    vocab = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice((1, 3, 7, 12, 20, 40, 90) if i < 300 else (12, 20))))) for i in range(20_000)]
    docs = []
    for d in range(400):
        w = rng.choices(vocab, k=rng.randint(0, 120))
        for _ in range(d % 4):
            part = rng.choice(items)[1].split()
            w[len(w) // 2:len(w) // 2] = [x if rng.random() > .1 else "edited" for x in part]
        docs.append((d % 390, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = [(i, p) for i, t in items for p in decontam.pieces(t)]
    counts = Counter(g for _, t in docs for g in set(decontam.ngrams(decontam.tokens(t))))
    block = decontam.Block(cut, counts, len(docs), decontam.MIN_SCORE)
    want = Counter((d, str(h["item_id"]), round(h["score"], 9), h["matched"], h["start"], h["end"]) for d, t in docs for h in block.hits(t))
    for bits in (decontam.BITMAP_BITS, 16):
        old, decontam.BITMAP_BITS = decontam.BITMAP_BITS, bits
        rows = decontam.contamination(df, bench).select("doc_id", F.explode("contaminated_by").alias("h")).collect()
        decontam.BITMAP_BITS = old
        assert Counter((r.doc_id, str(r.h.item_id), round(r.h.score, 9), r.h.matched, r.h.start, r.h.end) for r in rows) == want
    assert len(want) > 600


def test_short_items_do_not_drop(spark):
    docs = spark.createDataFrame([(1, "he lived in paris then"), (2, "one two three four five six"), (3, "other")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Paris"), (2, "two three four five six")], "item_id long, text string")
    assert {r.doc_id for r in decontam.contamination(docs, bench).where("size(contaminated_by) > 0").collect()} == {1, 2}
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {1, 3}
    assert {r.doc_id for r in decontam.clean(docs, bench, drop_words=1).collect()} == {3}


def test_decontamination_query(spark):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_decontamination"](spark, SF).collect()}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    true = {(d.doc_id, i.item_id) for d in spark.read.parquet(f"{SF}/documents.parquet").collect() for i in items if i.text in (d.text or "")}
    assert true <= got and len(true) > 10 and len(got - true) <= 0.02 * len(true)


def test_licenses(spark, odd, none):
    body = " ".join(f"word{i}" for i in range(50))
    mit = licenses.TEMPLATES["MIT-grant"]
    edited = mit.replace("free of charge", "gratis").replace("Permission", "Permissions")
    texts = [f"é {body} {mit.upper()}. {body}", f"{body}\n# {edited}", body, "Licensed under the moon, with love", "# " + mit.replace(" ", "\n # ")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(docs).collect()}
    full = got[0][0]
    assert (full.license, full.coverage) == ("MIT-grant", 1.0) and texts[0][full.start:full.end] == mit.upper()
    assert [x.license for x in got[1]] == ["MIT-grant"] and 0.8 <= got[1][0].coverage < 1
    assert got[2] == [] and got[3] == [] and got[4][0].coverage == 1.0
    assert licenses.scan(odd).where("size(licenses) > 0").count() == 0 and licenses.scan(odd).count() == odd.count()
    assert licenses.scan(none).collect() == [] and licenses.scan(docs, {}).where("size(licenses) > 0").count() == 0
    rows = {(r.doc_id, r.license, r.start) for r in QUERIES["op6_licenses"](spark, SF).collect()}
    true = {(d.doc_id, k, d.text.index(t)) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()
            for k, t in licenses.TEMPLATES.items() if t in (d.text or "")}
    assert true <= rows


def test_license_notices_that_follow_each_other():
    """Every notice of one template is reported, however close the next one is and whichever is edited."""
    scanner = licenses.Scanner({k: licenses.TEMPLATES[k] for k in ("MIT", "MIT-grant")})
    mit = "Released under the MIT License."
    for between in ("", " and", " x" * 3, " x" * 8, " x" * 30):
        text = f"{mit}{between} {mit}{between} {mit}"
        got = [(r["start"], r["end"]) for r in scanner.scan(text)]
        step = len(mit) + len(between) + 1
        assert got == [(i * step, i * step + len(mit) - 1) for i in range(3)]
    got = scanner.scan(f"Released under the MIT terms. {mit} Published under the MIT License. {mit}")
    assert [(r["license"], r["matched"]) for r in got] == [("MIT", 4), ("MIT", 5), ("MIT", 4), ("MIT", 5)]
    grant = licenses.TEMPLATES["MIT-grant"]
    got = scanner.scan(f"{mit} {grant}. {mit} {grant}")
    assert [r["license"] for r in got] == ["MIT", "MIT-grant"] * 2 and all(r["coverage"] == 1 for r in got)
    assert len(scanner.scan(f"{mit} " * 500)) == 500


def brute(ids, x, top=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = ann.inner_products_of(x[i:i + 1], np.zeros(len(x), int), x, np.arange(len(x)))
        keep = ids != ids[i]
        order = np.lexsort((ids[keep], -s[keep]))[:top]
        out[int(ids[i])] = [(int(a), float(b)) for a, b in zip(ids[keep][order], s[keep][order])]
    return out


def test_nearest_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    true, got = brute(ids, x), {}
    for r in QUERIES["op8_ann"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == true.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & set(true[q])) for q in true) >= 0.9 * sum(map(len, true.values()))


def test_nearest_ties_and_odd_vectors(spark):
    same = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(3000)]
    odd = [(5000, None), (5020, [0.0] * 4), (5040, [1.0, None, 1.0, 1.0]), (5060, [float("nan"), 1.0, 1.0, 1.0]),
           (5080, [float("inf"), 1.0, 1.0, 1.0]), (5100, [1.0, 1.0]), (None, [1.0, 2.0, 3.0, 4.0]), (5120, []), (5140, [0.1, 0.2, 0.3, 0.4])]
    df = spark.createDataFrame(same + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == {*range(0, 3000, 20), 5140}
    assert all(v == [i for i in range(22) if i != q][:20] for q, v in got.items())
    twice = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.5, 0.1]), (1, [0.4, 0.1]), (2, [0.1, 0.9])],
                                  "vec_id long, embedding array<double>")
    rows = ann.search(twice, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in rows] == [(20, 1, 2), (20, 2, 1), (20, 3, 1)]
    few = ann.search(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, i, i) for i in range(1, 5)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.search(df.where("vec_id = 5120"), F.lit(True)).collect() == []


def test_pipeline(spark, odd):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_dedup", "decontamination", "pii", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    left = {i: r.text for i, r in before.items() if model.score(r.text)[0] < toxicity.THRESHOLD}
    fps = {i: simhash.fingerprint(t) for i, t in left.items()}
    order = sorted(fps)
    least = dict(zip(order, slow_components([(i, fps[i]) for i in order])))
    left = {i: t for i, t in left.items() if least[i] == i}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(x in t for x in items)}
    ids = {r.doc_id for r in out}
    assert ids <= set(left) and len(left) > 500
    for r in out:
        changed = pii_free(left[r.doc_id])
        assert r.text == changed and 1 <= r.epoch <= r.repeats <= 3 and r.n_chars == len(r.text)
    taken = {}
    for r in out:
        taken.setdefault(r.source, [r.target, 0])[1] += r["size"]
    assert all(abs(t - k) <= max(0.25 * t, 400) for t, k in taken.values())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs.limit(0), SF)
        assert got.columns == docs.columns and got.collect() == []
    clash = docs.limit(50).withColumns({"size": F.lit("x"), "toxicity": F.lit("y"), "th": F.lit(1), "fp": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES[1:3]:
        assert stage(spark, clash, SF).columns == clash.columns
    assert mixing.mix(pii.redact(odd)).count() == odd.count()


def pii_free(text):
    found = sorted(slow_pii(text), key=lambda s: (s[1], -s[2]))
    out, at = "", 0
    merged = []
    for k, s, e in found:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([k, s, e])
    for k, s, e in merged:
        out += text[at:s] + f"[{k.upper()}]"
        at = e
    return out + text[at:]


def test_banded_against_full_alignment():
    """Matches, end and start of the best common subsequence that stays within the band, by a table of all cells."""
    rng = random.Random(6)
    for _ in range(400):
        a, b = rng.choices("abcd", k=rng.randint(1, 9)), rng.choices("abcde", k=rng.randint(0, 16))
        d, band, lo = rng.randint(-3, 6), rng.choice([1, 2, 4, 30]), rng.randint(0, 3)
        weights = rng.choices([1, 1, 10], k=len(a))
        table, best = {}, (0, -1, -1)
        for i, x in enumerate(a):
            for j in range(lo, len(b)):
                if x == b[j] and abs(j - i - d) <= band:
                    got = (weights[i], j)
                    for (p, q), (n, first) in table.items():
                        if p < i and q < j and (n + weights[i], first) > got:
                            got = (n + weights[i], first)
                    table[i, j] = got
                    if (got[0], -j, got[1]) > (best[0], -best[2], best[1]):
                        best = (*got, j)
        if band == 30:
            assert licenses.banded(a, b, d, band, lo, None, weights) == best
        else:  # the band also bounds where the rows between two matches may wait
            assert licenses.banded(a, b, d, band, lo, None, weights)[0] <= best[0]


def test_license_names_and_versions():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for text, names in [
            ("Released under the MPL License", []), ("Released under the MIT License", ["MIT"]),
            ("This work is licensed under the GNU General Public License, version 2", ["GPL-2.0"]),
            ("This work is licensed under the GNU General Public License, version 3", ["GPL-3.0"]),
            ("This work is licensed under the GNU General Public License, version 5", []),
            ("This work is licensed under the GNU Lesser General Public License, version 3", ["LGPL-3.0"]),
            ("Work licensed under the GNU Affero General Public License version 3", ["AGPL-3.0"]),
            ("Licensed under CC BY-NC 4.0", ["CC-BY-NC-4.0"]), ("Licensed under CC BY 4.0", ["CC-BY-4.0-short"]),
            ("Licensed under CC BY 3.0", []), ("Licensed under the Apache License, Version 1.1", []),
            ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-BY-SA-4.0"]),
            ("// SPDX-License-Identifier: GPL-2.0", ["GPL-2.0-spdx"]), ("// SPDX-License-Identifier: WTFPL", [])]:
        assert [r["license"] for r in scanner.scan(text)] == names, text
    for name, text in licenses.TEMPLATES.items():
        got = {r["license"] for r in scanner.scan(f"Some words before. {text}. And some after.")}
        assert name in got and len({licenses._WORDING.sub("", g) for g in got}) == 1, (name, got)
