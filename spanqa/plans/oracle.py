"""DuckDB SQL for the correctness gate: for each query key, an independent
formulation over the same parquet tables (views ``documents`` etc.).

The derived QA inputs are re-derived here in SQL (windowed running sums and
joins instead of Spark's in-row arrays), and the evaluation uses exploded
annotation rows with EXISTS / ROW_NUMBER instead of higher-order functions.
"""

from __future__ import annotations

LANG_LIST = ("'english', 'arabic', 'bengali', 'finnish', 'indonesian', 'japanese', "
             "'swahili', 'korean', 'russian', 'telugu', 'thai'")

BASE = r"""
d AS (
  SELECT doc_id, lang, text,
         CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'finnish' WHEN 'de' THEN 'swahili'
                   WHEN 'es' THEN 'korean' END AS language,
         string_split(text, chr(10)) AS paras, len(string_split(text, chr(10))) AS n
  FROM documents),
c0 AS (SELECT doc_id, lang, language, n, paras, unnest(range(n)) AS cand_pos FROM d),
qa_candidates AS (
  SELECT doc_id, lang, language, cand_pos, n, paras[cand_pos + 1] AS txt,
         strlen(paras[cand_pos + 1]) AS len_b,
         CAST(coalesce(sum(strlen(paras[cand_pos + 1]) + 1) OVER (PARTITION BY doc_id ORDER BY cand_pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_b
  FROM c0),
g0 AS (SELECT doc_id, language, n, unnest([0, 1, 2]) AS a FROM d),
g1 AS (SELECT doc_id, language, a,
         CASE WHEN (doc_id + a * a) % 5 >= 2 AND doc_id % 13 <> 0
              THEN (doc_id + CASE WHEN a = 2 THEN doc_id % 3 ELSE 0 END) % n ELSE -1 END AS ci
       FROM g0),
g2 AS (SELECT g1.*, c.start_b, string_split(c.txt, ' ') AS w,
         (g1.ci >= 0 AND g1.doc_id % 11 <> 0 AND (g1.doc_id + g1.a) % 4 <> 0) AS has_span
       FROM g1 LEFT JOIN qa_candidates c ON c.doc_id = g1.doc_id AND c.cand_pos = g1.ci),
g3 AS (SELECT *, (doc_id * 5 + a) % len(w) AS w0 FROM g2),
qa_gold AS (
  SELECT doc_id AS example_id, language, a AS ann_pos, CAST(ci AS BIGINT) AS ci,
    CASE WHEN ci >= 0 AND doc_id % 11 = 0 THEN CASE WHEN (doc_id + a) % 2 = 0 THEN 'yes' ELSE 'no' END
         ELSE 'none' END AS yn,
    CAST(CASE WHEN has_span THEN start_b + strlen(array_to_string(list_slice(w, 1, w0), ' '))
         + CASE WHEN w0 > 0 THEN 1 ELSE 0 END ELSE -1 END AS BIGINT) AS s,
    CAST(CASE WHEN has_span THEN start_b + strlen(array_to_string(
         list_slice(w, 1, least(len(w) - 1, w0 + doc_id % 4) + 1), ' ')) ELSE -1 END AS BIGINT) AS e
  FROM g3),
p0 AS (SELECT doc_id, lang, language, n,
         CASE WHEN doc_id % 6 = 1 THEN -1 WHEN doc_id % 5 = 2 THEN (doc_id + 1) % n ELSE doc_id % n END AS ci
       FROM d WHERE doc_id % 17 <> 3),
p1 AS (SELECT p0.*, c.start_b, string_split(c.txt, ' ') AS w
       FROM p0 LEFT JOIN qa_candidates c ON c.doc_id = p0.doc_id AND c.cand_pos = p0.ci),
p2 AS (SELECT *, (doc_id * 5 + 1) % len(w) AS w0 FROM p1),
qa_pred AS (
  SELECT doc_id AS example_id,
    CASE WHEN doc_id % 43 = 5 THEN CASE WHEN lang = 'en' THEN 'swahili' ELSE 'english' END ELSE language END
      AS language,
    CAST(ci AS BIGINT) AS ci,
    ((doc_id * 37) % 200 + CASE WHEN doc_id % 5 >= 3 THEN 80 ELSE 0 END) / 8.0::DOUBLE AS ps,
    ((doc_id * 53) % 160 + CASE WHEN doc_id % 5 >= 3 THEN 64 ELSE 0 END) / 8.0::DOUBLE AS ms,
    CASE WHEN ci >= 0 AND doc_id % 11 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END
         ELSE 'none' END AS yn,
    CAST(CASE WHEN ci >= 0 AND doc_id % 11 <> 0 THEN start_b + strlen(array_to_string(list_slice(w, 1, w0), ' '))
         + CASE WHEN w0 > 0 THEN 1 ELSE 0 END ELSE -1 END AS BIGINT) AS s,
    CAST(CASE WHEN ci >= 0 AND doc_id % 11 <> 0 THEN start_b + strlen(array_to_string(
         list_slice(w, 1, least(len(w) - 1, w0 + (doc_id + 1) % 4) + 1), ' ')) ELSE -1 END AS BIGINT) AS e
  FROM p2
  UNION ALL
  SELECT doc_id + 10000000, language, 0, 1.0::DOUBLE, 1.0::DOUBLE, 'none', 0, 5 FROM d WHERE doc_id % 50 = 0)
"""

EVAL = rf"""
el AS (SELECT DISTINCT language FROM qa_pred WHERE language IN ({LANG_LIST})),
gv AS (SELECT example_id, language, count(*) AS n_ann,
         count(*) FILTER (WHERE ci >= 0) AS passage_votes,
         count(*) FILTER (WHERE NOT (s < 0 AND e < 0) OR yn <> 'none') AS minimal_votes
       FROM qa_gold GROUP BY example_id, language),
gj AS (SELECT g.example_id, g.language, g.passage_votes >= 2 AS gp, g.minimal_votes >= 2 AS gm,
          p.example_id IS NOT NULL AS matched, p.ci AS p_ci, p.ps, p.ms, p.yn AS p_yn, p.s AS p_s, p.e AS p_e
       FROM gv g LEFT JOIN qa_pred p ON p.example_id = g.example_id AND p.language = g.language
       WHERE g.language IN (SELECT language FROM el)),
pm0 AS (SELECT gj.example_id, a.ann_pos,
          least(a.e, gj.p_e) - greatest(a.s, gj.p_s) AS inb,
          NOT (a.e <= gj.p_s OR gj.p_e <= a.s) AS ov, a.s, a.e, gj.p_s, gj.p_e
        FROM gj JOIN qa_gold a ON a.example_id = gj.example_id
        WHERE gj.matched AND gj.p_yn = 'none' AND NOT (gj.p_s < 0 AND gj.p_e < 0) AND NOT (a.s < 0 AND a.e < 0)),
pm1 AS (SELECT example_id, ann_pos,
          CASE WHEN ov AND inb > 0 THEN inb / (p_e - p_s) ELSE 0.0 END AS precision,
          CASE WHEN ov AND inb > 0 THEN inb / (e - s) ELSE 0.0 END AS recall
        FROM pm0),
pm2 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                       ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pm1),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY f1 DESC, ann_pos) AS rn
                      FROM pm2 WHERE f1 > 0) WHERE rn = 1),
st AS (
  SELECT gj.example_id, gj.language, 'passage' AS task, gj.gp AS has_gold,
    CASE WHEN matched THEN p_ci >= 0 ELSE NOT gp END AS has_pred,
    CASE WHEN matched AND gp AND p_ci >= 0 AND EXISTS (SELECT 1 FROM qa_gold x
         WHERE x.example_id = gj.example_id AND x.ci = gj.p_ci) THEN 1.0 ELSE 0.0 END AS f1,
    CASE WHEN matched AND gp AND p_ci >= 0 AND EXISTS (SELECT 1 FROM qa_gold x
         WHERE x.example_id = gj.example_id AND x.ci = gj.p_ci) THEN 1.0 ELSE 0.0 END AS precision,
    CASE WHEN matched AND gp AND p_ci >= 0 AND EXISTS (SELECT 1 FROM qa_gold x
         WHERE x.example_id = gj.example_id AND x.ci = gj.p_ci) THEN 1.0 ELSE 0.0 END AS recall,
    CASE WHEN matched THEN ps ELSE 0.0 END AS score
  FROM gj
  UNION ALL
  SELECT gj.example_id, gj.language, 'minimal', gj.gm,
    CASE WHEN matched THEN (NOT (p_s < 0 AND p_e < 0) OR p_yn <> 'none') ELSE NOT gm END,
    CASE WHEN NOT (matched AND gm AND (NOT (p_s < 0 AND p_e < 0) OR p_yn <> 'none')) THEN 0.0
         WHEN p_yn <> 'none' THEN CASE WHEN EXISTS (SELECT 1 FROM qa_gold x
              WHERE x.example_id = gj.example_id AND x.yn = gj.p_yn) THEN 1.0 ELSE 0.0 END
         ELSE coalesce(bm.f1, 0.0) END,
    CASE WHEN NOT (matched AND gm AND (NOT (p_s < 0 AND p_e < 0) OR p_yn <> 'none')) THEN 0.0
         WHEN p_yn <> 'none' THEN CASE WHEN EXISTS (SELECT 1 FROM qa_gold x
              WHERE x.example_id = gj.example_id AND x.yn = gj.p_yn) THEN 1.0 ELSE 0.0 END
         ELSE coalesce(bm.precision, 0.0) END,
    CASE WHEN NOT (matched AND gm AND (NOT (p_s < 0 AND p_e < 0) OR p_yn <> 'none')) THEN 0.0
         WHEN p_yn <> 'none' THEN CASE WHEN EXISTS (SELECT 1 FROM qa_gold x
              WHERE x.example_id = gj.example_id AND x.yn = gj.p_yn) THEN 1.0 ELSE 0.0 END
         ELSE coalesce(bm.recall, 0.0) END,
    CASE WHEN matched THEN ms ELSE 0.0 END
  FROM gj LEFT JOIN bm ON bm.example_id = gj.example_id),
pt AS (SELECT language, task, score, sum(f1) AS sf, sum(has_pred::INT) AS sp, sum(has_gold::INT) AS sg
       FROM st GROUP BY language, task, score),
cu AS (SELECT language, task, score, round(sum(sf) OVER w, 9) AS cf, sum(sp) OVER w AS cp,
              sum(sg) OVER (PARTITION BY language, task) AS tg
       FROM pt WINDOW w AS (PARTITION BY language, task ORDER BY score DESC
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cv0 AS (SELECT language, task, score, CASE WHEN cp = 0 THEN 0.0 ELSE cf / cp END AS precision,
               CASE WHEN tg = 0 THEN 0.0 ELSE cf / tg END AS recall FROM cu),
cv AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                      ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM cv0),
bt0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY language, task ORDER BY f1 DESC, score DESC) AS rn
                       FROM cv WHERE f1 > 0) WHERE rn = 1),
tasks AS (SELECT unnest(['passage', 'minimal']) AS task),
bt AS (SELECT el.language, tasks.task, coalesce(bt0.f1, 0.0) AS best_f1,
              coalesce(bt0.precision, 0.0) AS best_precision, coalesce(bt0.recall, 0.0) AS best_recall,
              coalesce(bt0.score, 0.0) AS best_threshold
       FROM el CROSS JOIN tasks LEFT JOIN bt0 ON bt0.language = el.language AND bt0.task = tasks.task)
"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


def _latex(f1: str, p: str, r: str) -> str:
    return (f"'\\fpr{{' || printf('%.1f', {f1} * 100) || '}}{{' || printf('%.1f', {p} * 100) || '}}{{' || "
            f"printf('%.1f', {r} * 100) || '}}'")


SQL: dict[str, str] = {}

SQL["gold_scan"] = _with(BASE) + """
SELECT example_id, language, CAST(ann_pos AS INTEGER) AS ann_pos,
       CAST(CAST('18000000000000000000' AS DECIMAL(20,0)) + example_id * 3 + ann_pos AS DECIMAL(20,0)) AS annotation_id,
       ci AS passage_answer_index, s AS minimal_start_byte, e AS minimal_end_byte, yn AS yes_no_answer
FROM qa_gold"""

SQL["prediction_scan"] = _with(BASE) + """
SELECT example_id, language, ci AS passage_answer_index, s AS minimal_start_byte, e AS minimal_end_byte,
       yn AS yes_no_answer, ps AS passage_score, ms AS minimal_score, CAST(NULL AS VARCHAR) AS error
FROM qa_pred"""

SQL["span_validation"] = _with(BASE, """
lit(example_id, s, e, yn) AS (VALUES (-1, -1, 1, 'none'), (-2, 1, -1, 'none'), (-3, 5, 2, 'none'),
                                     (-4, 0, 3, 'yes'), (-5, -1, -1, 'maybe'), (-6, 4, 4, 'none')),
allp AS (SELECT example_id, s, e, yn FROM qa_pred
         UNION ALL SELECT CAST(example_id AS BIGINT), CAST(s AS BIGINT), CAST(e AS BIGINT), yn FROM lit)""") + """
SELECT example_id, s AS minimal_start_byte, e AS minimal_end_byte, yn AS yes_no_answer,
       (s < 0 AND e < 0) AS is_null_span,
       CASE WHEN yn NOT IN ('yes', 'no', 'none') THEN 'invalid yes_no_answer'
            WHEN (s < 0 AND e >= 0) OR (s >= 0 AND e < 0) THEN 'inconsistent null span'
            WHEN s >= 0 AND e >= 0 AND s > e THEN 'start after end'
            WHEN yn <> 'none' AND NOT (s < 0 AND e < 0) THEN 'yes/no and minimal span coexist' END AS error
FROM allp"""

_PAIRS = """
pairs AS (SELECT g.example_id, g.ann_pos, g.s, g.e, p.s AS p_s, p.e AS p_e
          FROM qa_gold g JOIN qa_pred p ON p.example_id = g.example_id
          WHERE NOT (g.s < 0 AND g.e < 0) AND NOT (p.s < 0 AND p.e < 0))"""

SQL["span_overlap"] = _with(BASE, _PAIRS, """
o1 AS (SELECT example_id, ann_pos, least(e, p_e) - greatest(s, p_s) AS inb,
              NOT (e <= p_s OR p_e <= s) AS ov, s, e, p_s, p_e FROM pairs),
o2 AS (SELECT example_id, ann_pos,
              CASE WHEN ov AND inb > 0 THEN inb / (p_e - p_s) ELSE 0.0 END AS precision,
              CASE WHEN ov AND inb > 0 THEN inb / (e - s) ELSE 0.0 END AS recall FROM o1)""") + """
SELECT example_id, CAST(ann_pos AS INTEGER) AS ann_pos, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 9) AS f1
FROM o2"""

SQL["span_equal"] = _with(BASE, _PAIRS) + """
SELECT example_id, CAST(ann_pos AS INTEGER) AS ann_pos, (s = p_s AND e = p_e) AS equal FROM pairs"""

SQL["byte_profile"] = """
SELECT doc_id, lang, strlen(text) AS n_bytes, length(text) AS n_chars, octet_length(encode(text)) AS n_encoded,
       strlen(string_split(text, chr(10))[1]) AS first_par_bytes, true AS slice_ok
FROM documents"""

SQL["candidate_text"] = _with(BASE) + """
SELECT g.example_id, CAST(g.ann_pos AS INTEGER) AS ann_pos, g.ci AS candidate_index, c.start_b AS cand_start,
       c.start_b + c.len_b AS cand_end, c.txt AS cand_text, c.len_b AS n_positions,
       CASE WHEN g.s >= 0 THEN array_to_string(list_slice(string_split(c.txt, ' '),
            (g.example_id * 5 + g.ann_pos) % len(string_split(c.txt, ' ')) + 1,
            least(len(string_split(c.txt, ' ')) - 1,
                  (g.example_id * 5 + g.ann_pos) % len(string_split(c.txt, ' ')) + g.example_id % 4) + 1), ' ')
       END AS answer_text
FROM qa_gold g JOIN qa_candidates c ON c.doc_id = g.example_id AND c.cand_pos = g.ci
WHERE g.ci >= 0"""

SQL["candidate_positions"] = _with(BASE, """
sp AS (SELECT g.example_id, g.ann_pos, c.start_b AS s1, c.start_b + c.len_b AS e1, b.start_b AS s2, b.start_b + b.len_b AS e2,
              g.s AS s3, g.e AS e3
       FROM qa_gold g JOIN qa_candidates c ON c.doc_id = g.example_id AND c.cand_pos = g.ci
       JOIN qa_candidates b ON b.doc_id = g.example_id AND b.cand_pos = greatest(g.ci - 1, 0) WHERE g.ci >= 0),
ps AS (SELECT example_id, ann_pos, list_sort(list_distinct(list_concat(range(s1, e1), range(s2, e2),
              CASE WHEN s3 >= 0 THEN range(s3, e3) ELSE [] END))) AS p FROM sp)""") + """
SELECT example_id, CAST(ann_pos AS INTEGER) AS ann_pos,
       CAST(len(list_filter(p, lambda x, i: i = 1 OR x <> p[i - 1] + 1)) AS INTEGER) AS n_segments,
       CAST(len(p) AS INTEGER) AS n_positions, md5(coalesce(array_to_string(p, ','), '')) AS positions_md5 FROM ps"""

SQL["local_offsets"] = _with(BASE) + """
SELECT g.example_id, CAST(g.ann_pos AS INTEGER) AS ann_pos, g.s - c.start_b AS local_start, g.e - c.start_b AS local_end
FROM qa_gold g JOIN qa_candidates c ON c.doc_id = g.example_id AND c.cand_pos = g.ci
WHERE g.ci >= 0 AND g.s >= 0"""

SQL["lang_dim"] = _with(BASE, """
ids(language, language_id) AS (VALUES ('arabic', 0), ('bengali', 1), ('finnish', 2), ('indonesian', 3),
   ('japanese', 4), ('swahili', 5), ('korean', 6), ('russian', 7), ('telugu', 8), ('thai', 9), ('english', 10))""") + """
SELECT d.language, CAST(ids.language_id AS INTEGER) AS language_id, ids.language AS name_back, count(*) AS n_examples
FROM d JOIN ids ON ids.language = d.language GROUP BY d.language, ids.language_id, ids.language"""

SQL["vote_passage"] = _with(BASE, EVAL) + """
SELECT example_id, language, CAST(n_ann AS INTEGER) AS n_ann, CAST(passage_votes AS INTEGER) AS passage_votes,
       passage_votes >= 2 AS gold_has_passage FROM gv"""

SQL["vote_minimal"] = _with(BASE, EVAL) + """
SELECT example_id, language, CAST(minimal_votes AS INTEGER) AS minimal_votes, minimal_votes >= 2 AS gold_has_minimal
FROM gv"""

SQL["gold_counts"] = _with(BASE, EVAL) + """
SELECT (SELECT count(*) FROM gv) AS n_gold, (SELECT count(DISTINCT example_id) FROM qa_pred) AS n_pred,
       (SELECT count(*) FROM gv WHERE minimal_votes >= 2) AS n_gold_minimal,
       (SELECT count(*) FROM gv WHERE passage_votes >= 2) AS n_gold_passage"""

SQL["passage_match"] = _with(BASE, EVAL) + """
SELECT example_id, language, has_gold, has_pred, f1 > 0 AS is_correct, round(score, 9) AS score
FROM st WHERE task = 'passage'"""

SQL["minimal_match"] = _with(BASE, EVAL) + """
SELECT example_id, language, has_gold, has_pred, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(f1, 9) AS f1, round(score, 9) AS score
FROM st WHERE task = 'minimal'"""

SQL["unpredicted_ids"] = _with(BASE, EVAL) + """
SELECT g.language, g.example_id FROM gv g
WHERE g.language IN (SELECT language FROM el)
  AND NOT EXISTS (SELECT 1 FROM qa_pred p WHERE p.example_id = g.example_id AND p.language = g.language)
ORDER BY 1, 2"""

SQL["unexpected_ids"] = _with(BASE, EVAL) + """
SELECT p.language, p.example_id FROM qa_pred p
WHERE p.language IN (SELECT language FROM el)
  AND NOT EXISTS (SELECT 1 FROM gv g WHERE g.example_id = p.example_id AND g.language = p.language)
ORDER BY 1, 2"""

SQL["lang_routing"] = _with(BASE, EVAL, """
gl AS (SELECT language, count(*) AS n_gold FROM gv GROUP BY language),
pl AS (SELECT language, count(*) AS n_pred FROM qa_pred GROUP BY language),
ml AS (SELECT g.language, count(*) AS n_matched FROM gv g JOIN qa_pred p
         ON p.example_id = g.example_id AND p.language = g.language GROUP BY g.language)""") + f"""
SELECT coalesce(gl.language, pl.language) AS language, coalesce(gl.n_gold, 0) AS n_gold,
       coalesce(pl.n_pred, 0) AS n_pred, coalesce(ml.n_matched, 0) AS n_matched,
       (pl.n_pred IS NOT NULL AND coalesce(gl.language, pl.language) IN ({LANG_LIST})) AS evaluated,
       CAST(list_position([{LANG_LIST}], coalesce(gl.language, pl.language)) AS INTEGER) AS report_order
FROM gl FULL JOIN pl ON pl.language = gl.language LEFT JOIN ml ON ml.language = coalesce(gl.language, pl.language)
ORDER BY report_order"""

SQL["pr_curve"] = _with(BASE, EVAL) + """
SELECT language, task, score, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1
FROM cv"""

SQL["best_threshold"] = _with(BASE, EVAL) + """
SELECT language, task, round(best_f1, 9) AS best_f1, round(best_precision, 9) AS best_precision,
       round(best_recall, 9) AS best_recall, best_threshold FROM bt"""

_RAP = """
tg AS (SELECT unnest([0.5, 0.75, 0.9]::DOUBLE[]) AS target),
rp AS (SELECT k.*, tg.target, row_number() OVER (PARTITION BY k.grp, k.task, tg.target
                                                 ORDER BY k.recall DESC, k.score DESC) AS rn
       FROM curve_k k JOIN tg ON k.precision >= tg.target AND k.recall > 0),
rk AS (SELECT DISTINCT grp, task FROM curve_k),
rap AS (SELECT rk.grp, rk.task, tg.target, coalesce(rp.recall, 0.0) AS recall,
               coalesce(rp.precision, 0.0) AS precision, rp.score AS threshold
        FROM rk CROSS JOIN tg LEFT JOIN rp ON rp.grp = rk.grp AND rp.task = rk.task AND rp.target = tg.target
                                           AND rp.rn = 1)"""

SQL["recall_at_precision"] = _with(BASE, EVAL, "curve_k AS (SELECT language AS grp, * FROM cv)", _RAP) + """
SELECT grp AS language, task, target, round(recall, 9) AS recall, round(precision, 9) AS precision, threshold
FROM rap"""

# pooled: no language routing, all gold examples
_POOLED = EVAL.replace(
    "LEFT JOIN qa_pred p ON p.example_id = g.example_id AND p.language = g.language\n"
    "       WHERE g.language IN (SELECT language FROM el)",
    "LEFT JOIN qa_pred p ON p.example_id = g.example_id").replace(
    "gj AS (SELECT g.example_id, g.language,", "gj AS (SELECT g.example_id, 'all' AS language,")
assert _POOLED.count("'all' AS language") == 1 and "p.language = g.language\n       WHERE" not in _POOLED

SQL["metrics_pooled"] = _with(BASE, _POOLED, "curve_k AS (SELECT 'all' AS grp, * FROM cv)", _RAP, """
bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY f1 DESC, score DESC) AS rn
                      FROM cv WHERE f1 > 0) WHERE rn = 1),
bz AS (SELECT tasks.task, coalesce(bp.f1, 0.0) AS f1, coalesce(bp.precision, 0.0) AS precision,
              coalesce(bp.recall, 0.0) AS recall, coalesce(bp.score, 0.0) AS score
       FROM tasks LEFT JOIN bp ON bp.task = tasks.task)""") + """
SELECT task || '-best-threshold-f1' AS metric, round(f1, 9) AS value FROM bz
UNION ALL SELECT task || '-best-threshold-precision', round(precision, 9) FROM bz
UNION ALL SELECT task || '-best-threshold-recall', round(recall, 9) FROM bz
UNION ALL SELECT task || '-best-threshold', round(score, 9) FROM bz
UNION ALL SELECT task || '-recall-at-precision>=' || CAST(target AS VARCHAR), round(recall, 9) FROM rap
UNION ALL SELECT task || '-precision-at-precision>=' || CAST(target AS VARCHAR), round(precision, 9) FROM rap"""

SQL["unthresholded_f1"] = _with(BASE, EVAL, """
u AS (SELECT language, task, count(*) AS n, round(sum(f1), 9) AS sf, sum(has_pred::INT) AS sp,
             sum(has_gold::INT) AS sg FROM st GROUP BY language, task),
u2 AS (SELECT language, task, n, CASE WHEN sp = 0 THEN 0.0 ELSE sf / sp END AS precision,
              CASE WHEN sg = 0 THEN 0.0 ELSE sf / sg END AS recall FROM u)""") + """
SELECT language, task, n, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 9) AS f1
FROM u2"""

SQL["metric_reports"] = None  # below, from the averages
SQL["macro_average"] = _with(BASE, EVAL, """
ma AS (SELECT
   coalesce(avg(best_f1) FILTER (WHERE task = 'passage'), 0.0) AS avg_passage_f1,
   coalesce(avg(best_precision) FILTER (WHERE task = 'passage'), 0.0) AS avg_passage_precision,
   coalesce(avg(best_recall) FILTER (WHERE task = 'passage'), 0.0) AS avg_passage_recall,
   coalesce(avg(best_f1) FILTER (WHERE task = 'minimal'), 0.0) AS avg_minimal_f1,
   coalesce(avg(best_precision) FILTER (WHERE task = 'minimal'), 0.0) AS avg_minimal_precision,
   coalesce(avg(best_recall) FILTER (WHERE task = 'minimal'), 0.0) AS avg_minimal_recall,
   count(DISTINCT language) AS n_languages
 FROM bt WHERE language <> 'english')""") + f"""
SELECT round(avg_passage_f1, 9) AS avg_passage_f1, round(avg_passage_precision, 9) AS avg_passage_precision,
       round(avg_passage_recall, 9) AS avg_passage_recall, round(avg_minimal_f1, 9) AS avg_minimal_f1,
       round(avg_minimal_precision, 9) AS avg_minimal_precision, round(avg_minimal_recall, 9) AS avg_minimal_recall,
       n_languages,
       {_latex('avg_passage_f1', 'avg_passage_precision', 'avg_passage_recall')} AS passage_latex,
       {_latex('avg_minimal_f1', 'avg_minimal_precision', 'avg_minimal_recall')} AS minimal_latex
FROM ma"""

SQL["scored_samples"] = _with(BASE, EVAL, """
g0a AS (SELECT * FROM qa_gold WHERE ann_pos = 0 AND s >= 0)""") + """
SELECT gj.example_id, gj.language, g0a.s AS gold_start, g0a.e AS gold_end, gj.p_s AS pred_start, gj.p_e AS pred_end,
       array_to_string(list_slice(string_split(c.txt, ' '),
            (g0a.example_id * 5) % len(string_split(c.txt, ' ')) + 1,
            least(len(string_split(c.txt, ' ')) - 1,
                  (g0a.example_id * 5) % len(string_split(c.txt, ' ')) + g0a.example_id % 4) + 1), ' ') AS gold_text,
       CASE WHEN gj.p_s >= 0 THEN array_to_string(list_slice(string_split(pc.txt, ' '),
            (gj.example_id * 5 + 1) % len(string_split(pc.txt, ' ')) + 1,
            least(len(string_split(pc.txt, ' ')) - 1,
                  (gj.example_id * 5 + 1) % len(string_split(pc.txt, ' ')) + (gj.example_id + 1) % 4) + 1), ' ')
            ELSE '' END AS pred_text,
       round(st.score, 9) AS score, round(st.f1, 9) AS f1, round(st.precision, 9) AS precision,
       round(st.recall, 9) AS recall
FROM gj JOIN g0a ON g0a.example_id = gj.example_id
JOIN qa_candidates c ON c.doc_id = g0a.example_id AND c.cand_pos = g0a.ci
LEFT JOIN qa_candidates pc ON pc.doc_id = gj.example_id AND pc.cand_pos = gj.p_ci
JOIN st ON st.example_id = gj.example_id AND st.task = 'minimal'
WHERE gj.matched"""


_MA = SQL["macro_average"].split("\nSELECT round(avg_passage_f1", 1)[0]
SQL["metric_reports"] = _MA + f"""
SELECT language, task, round(best_f1, 9) AS best_f1, round(best_precision, 9) AS best_precision,
       round(best_recall, 9) AS best_recall, {_latex("best_f1", "best_precision", "best_recall")} AS latex FROM bt
UNION ALL SELECT 'average', 'passage', round(avg_passage_f1, 9), round(avg_passage_precision, 9),
                 round(avg_passage_recall, 9), '' FROM ma
UNION ALL SELECT 'average', 'minimal', round(avg_minimal_f1, 9), round(avg_minimal_precision, 9),
                 round(avg_minimal_recall, 9), '' FROM ma"""

# ---------------------------------------------------------------- entries ---

_CTX = r"""
kc AS (SELECT c.*, '[ContextId=' || CAST(cand_pos AS VARCHAR) || ']' AS marker FROM qa_candidates c WHERE cand_pos < 45),
kl AS (SELECT *, CAST(coalesce(sum(strlen(marker) + len_b + 2) OVER (PARTITION BY doc_id ORDER BY cand_pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off0 FROM kc),
seg AS (SELECT doc_id, cand_pos, off0 + strlen(marker) + 1 AS ctx_start, off0 + strlen(marker) + 1 + len_b AS ctx_end,
               start_b AS plain_start, len_b, txt FROM kl),
ctxlen AS (SELECT doc_id, count(*) AS n_kept, CAST(sum(strlen(marker) + len_b + 2) - 1 AS BIGINT) AS contexts_bytes
           FROM kc GROUP BY doc_id),
fa_min AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY ci, ann_pos) AS rn
           FROM qa_gold WHERE ci >= 0 AND ci < 45 AND s >= 0) WHERE rn = 1),
fa_any AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY ci, ann_pos) AS rn
           FROM qa_gold WHERE ci >= 0 AND ci < 45) WHERE rn = 1),
fa AS (SELECT d.doc_id AS example_id, d.n, d.language,
              coalesce(m.ci, a.ci, -1) AS annotated_idx, coalesce(m.ann_pos, a.ann_pos) AS ann_pos,
              m.example_id IS NOT NULL AS has_min, m.s AS gs, m.e AS ge
       FROM d LEFT JOIN fa_min m ON m.example_id = d.doc_id LEFT JOIN fa_any a ON a.example_id = d.doc_id),
ans AS (SELECT fa.*, seg.ctx_start AS ts, seg.plain_start AS cs, seg.len_b AS cl, seg.txt AS ctxt
        FROM fa LEFT JOIN seg ON seg.doc_id = fa.example_id AND seg.cand_pos = fa.annotated_idx)
"""

SQL["first_annotation"] = _with(BASE, _CTX) + """
SELECT example_id, annotated_idx, CAST(ann_pos AS INTEGER) AS ann_pos, has_min AS has_minimal,
       CASE WHEN has_min THEN gs - c.start_b ELSE -1 END AS local_start,
       CASE WHEN has_min THEN ge - c.start_b ELSE -1 END AS local_end
FROM fa LEFT JOIN qa_candidates c ON c.doc_id = fa.example_id AND c.cand_pos = fa.annotated_idx"""

SQL["contexts"] = _with(BASE, _CTX) + """
SELECT a.example_id, l.contexts_bytes, CAST(l.n_kept AS INTEGER) AS n_kept,
       (a.annotated_idx >= 0 AND a.annotated_idx < least(a.n, 45)) AS has_correct_context,
       CASE WHEN a.annotated_idx < 0 THEN -1 WHEN a.has_min THEN a.gs - a.cs + a.ts ELSE a.ts END AS span_start,
       CASE WHEN a.annotated_idx < 0 THEN -1 WHEN a.has_min THEN a.ge - a.cs + a.ts ELSE a.ts + a.cl END AS span_end,
       CASE WHEN a.has_min THEN 'minimal' ELSE 'passage' END AS input_text,
       CASE WHEN a.annotated_idx < 0 THEN '' WHEN NOT a.has_min THEN a.ctxt
            ELSE array_to_string(list_slice(string_split(a.ctxt, ' '),
                 (a.example_id * 5 + a.ann_pos) % len(string_split(a.ctxt, ' ')) + 1,
                 least(len(string_split(a.ctxt, ' ')) - 1,
                       (a.example_id * 5 + a.ann_pos) % len(string_split(a.ctxt, ' ')) + a.example_id % 4) + 1), ' ')
       END AS span_text,
       CASE WHEN a.annotated_idx = -1 THEN '[NoLongAnswer]'
            ELSE '[Paragraph=' || CAST(least(a.annotated_idx + 1, 45) AS VARCHAR) || ']' END AS type_and_position
FROM ans a JOIN ctxlen l ON l.doc_id = a.example_id"""

SQL["context_segments"] = _with(BASE, _CTX) + """
SELECT doc_id AS example_id, CAST(cand_pos AS INTEGER) AS i, ctx_start, ctx_end, plain_start, true AS bytes_equal
FROM seg"""

SQL["answer_typing"] = _with(BASE, _CTX, """
ids(language, language_id) AS (VALUES ('arabic', 0), ('bengali', 1), ('finnish', 2), ('indonesian', 3),
   ('japanese', 4), ('swahili', 5), ('korean', 6), ('russian', 7), ('telugu', 8), ('thai', 9), ('english', 10))""") + """
SELECT a.example_id, CASE WHEN a.annotated_idx < 0 THEN 0 WHEN a.has_min THEN 3 ELSE 4 END AS answer_type,
       CASE WHEN a.annotated_idx < 0 THEN 0 WHEN a.has_min THEN a.gs - a.cs + a.ts ELSE a.ts END AS start_byte_offset,
       CASE WHEN a.annotated_idx < 0 THEN 1 WHEN a.has_min THEN a.ge - a.cs + a.ts ELSE a.ts + a.cl END
         AS end_byte_offset,
       CAST(ids.language_id AS INTEGER) AS language_id
FROM ans a JOIN ids ON ids.language = a.language"""

_REJECT_LIT = """
lit(outcome, n) AS (VALUES ('invalid_candidate_offsets', 1), ('bad_candidate_index', 1), ('answer_mismatch', 1),
                           ('no_candidates', 1), ('empty_context', 1)),
der AS (SELECT CASE WHEN len(list_filter(list_slice(paras, 1, 45), lambda x: x = '')) > 0 THEN 'empty_context'
                    ELSE 'ok' END AS outcome FROM d),
allr AS (SELECT outcome, count(*) AS n FROM der GROUP BY outcome UNION ALL SELECT outcome, n FROM lit)"""

SQL["entry_rejects"] = _with(BASE, _REJECT_LIT) + """
SELECT outcome, CAST(sum(n) AS BIGINT) AS n_examples FROM allr GROUP BY outcome"""

_SCAN_LIT = """
lit(line_no, example_id, outcome) AS (VALUES
  (1, -1, 'invalid_candidate_offsets'), (2, -2, 'bad_candidate_index'), (3, -3, 'answer_mismatch'),
  (4, -4, 'no_candidates'), (5, -5, 'empty_context'), (6, -6, 'ok'), (7, -7, 'ok'), (8, -8, 'ok'),
  (9, NULL, 'invalid_json'), (10, NULL, 'invalid_json'), (11, NULL, 'invalid_json')),
scanned AS (
  SELECT doc_id // 512 AS shard, row_number() OVER (PARTITION BY doc_id // 512 ORDER BY doc_id) AS line_no,
         doc_id AS example_id, language,
         CASE WHEN len(list_filter(list_slice(paras, 1, 45), lambda x: x = '')) > 0 THEN 'empty_context'
              ELSE 'ok' END AS outcome
  FROM d
  UNION ALL SELECT -1, line_no, example_id, 'english', outcome FROM lit)"""

SQL["example_scan"] = _with(BASE, _SCAN_LIT) + """
SELECT CAST(shard AS BIGINT) AS shard, CAST(line_no AS BIGINT) AS line_no, CAST(example_id AS BIGINT) AS example_id, outcome
FROM scanned"""

SQL["candidate_scan"] = _with(BASE) + """
SELECT doc_id AS example_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE n END AS INTEGER) AS n_candidates,
       (doc_id % 3 = 0) AS duplicated
FROM d"""

# ------------------------------------------------------ sampling / shards ---

SQL["lang_counts"] = _with(BASE) + "\nSELECT language, count(*) AS n_examples FROM d GROUP BY language"

SQL["oversample_ratio"] = _with(BASE, """
lc AS (SELECT language, count(*) AS n_examples FROM d GROUP BY language)""") + """
SELECT language, n_examples, CAST(floor(least(10.0, max(n_examples) OVER () / n_examples)) AS INTEGER) AS ratio
FROM lc"""

# ---------------------------------------------------------------- windows ---

_WIN = r"""
wp AS (SELECT doc_id, len(string_split(text, ' ')) AS n,
              381 - least(64, len(string_split(string_split(text, chr(10))[1], ' '))) AS width FROM documents),
w(doc_id, n, width, k, start, length) AS (
  SELECT doc_id, n, width, 0, 0, least(n, width) FROM wp WHERE n > 0
  UNION ALL
  SELECT doc_id, n, width, k + 1, start + least(length, 128), least(n - (start + least(length, 128)), width)
  FROM w WHERE start + length < n)"""

SQL["doc_windows"] = "WITH RECURSIVE " + _WIN.strip() + """
SELECT doc_id, CAST(k AS INTEGER) AS k, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length FROM w"""

SQL["complete_examples"] = "WITH RECURSIVE " + _WIN.strip() + """,
r AS (SELECT doc_id, k FROM w WHERE (doc_id + k) % 7 <> 0)
SELECT w.doc_id AS example_index, count(*) AS n_features, count(r.k) AS n_results,
       (count(r.k) > 0 AND count(*) = count(r.k)) AS complete
FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.k = w.k GROUP BY w.doc_id"""

SQL["asof_merge"] = "WITH RECURSIVE " + _WIN.strip() + """,
ex AS (SELECT doc_id AS example_id, doc_id AS key FROM documents),
items AS (SELECT 'feature' AS source, doc_id + k + 1 AS key FROM w
          UNION ALL SELECT 'result', doc_id + k + 1 FROM w WHERE (doc_id + k) % 7 <> 0),
m AS (SELECT items.source, ex.example_id FROM items ASOF JOIN ex ON items.key >= ex.key)
SELECT example_id, count(*) FILTER (WHERE source = 'feature') AS n_features,
       count(*) FILTER (WHERE source = 'result') AS n_results
FROM m GROUP BY example_id"""

# ------------------------------------------------------------- characters ---

SQL["char_classes"] = r"""
SELECT doc_id, lang,
  length(text) - length(regexp_replace(text, '[ \t\n\r\p{Zs}]', '', 'g')) AS n_whitespace,
  (length(text) - length(regexp_replace(text, '[\p{Cc}\p{Cf}]', '', 'g')))
    - (length(text) - length(regexp_replace(text, '[\t\n\r]', '', 'g'))) AS n_control,
  length(text) - length(regexp_replace(text, '[!-/:-@\[-`{-~\p{P}]', '', 'g')) AS n_punctuation,
  length(text) - length(regexp_replace(text,
    '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]',
    '', 'g')) AS n_cjk
FROM (SELECT doc_id, text, lang FROM documents
      UNION ALL SELECT -1, '中文abc 字!', 'zz'
      UNION ALL SELECT -2, chr(131073) || chr(173824) || chr(63744) || ' x', 'zz'
      UNION ALL SELECT -3, 'a' || chr(1) || chr(8203) || chr(9) || 'b' || chr(12290), 'zz')"""

SQL["space_tokens"] = r"""
SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_space_tokens,
       CAST(len(list_filter(string_split(text, ' '), lambda x: x = '')) AS BIGINT) AS n_empty,
       CAST(strlen(text) - (len(string_split(text, ' ')) - 1) AS BIGINT) AS token_bytes,
       CAST(len(list_filter(regexp_split_to_array(trim(text), '[\s\p{Z}]+'), lambda x: x <> '')) AS INTEGER)
         AS n_whitespace_tokens
FROM documents"""

_BAD_RE2 = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\p{Cf}\x{FFFD}]"
_PU_RE2 = r"[!-/:-@\[-`{-~\p{P}]"
_NPU_RE2 = r"[^!-/:-@\[-`{-~\p{P}]"

SQL["basic_tokens"] = rf"""
WITH toks AS (
  SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents
  UNION SELECT 'a' || chr(0) || 'b' UNION SELECT 'x' || chr(20013) || 'y'
  UNION SELECT 'ab,c' || chr(9) || 'd' || chr(8203) || 'e!' UNION SELECT chr(1) || chr(2) UNION SELECT ''),
segs AS (SELECT token, regexp_extract_all(token, '([\t\n\r\p{{Z}}]|[^\t\n\r\p{{Z}}]+)', 1) AS sg FROM toks),
pcs AS (SELECT token,
   flatten(list_transform(sg, lambda s: list_concat(regexp_extract_all(s, '({_BAD_RE2})', 1),
       regexp_extract_all(regexp_replace(s, '{_BAD_RE2}', '', 'g'), '({_PU_RE2}|{_NPU_RE2}+)', 1)))) AS p,
   list_sum(list_transform(sg, lambda s: len(regexp_extract_all(s, '({_BAD_RE2})', 1)))) AS nb
  FROM segs)
SELECT token, array_to_string(p, '|') AS pieces, CAST(coalesce(nb, 0) AS INTEGER) AS n_bad FROM pcs"""

_CJK_RE2 = (r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}"
            r"\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}")
SQL["basic_tokens_cjk"] = rf"""
WITH toks AS (
  SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents
  UNION SELECT 'x中y文' UNION SELECT '中文,字' UNION SELECT 'é日' || chr(0) || '本' UNION SELECT chr(131073) || 'a' UNION SELECT ''),
segs AS (SELECT token, regexp_extract_all(token, '([\t\n\r\p{{Z}}]|[^\t\n\r\p{{Z}}]+)', 1) AS sg FROM toks),
pcs AS (SELECT token, flatten(list_transform(sg, lambda s: list_concat(regexp_extract_all(s, '({_BAD_RE2})', 1),
          regexp_extract_all(regexp_replace(s, '{_BAD_RE2}', '', 'g'),
                             '({_PU_RE2}|[{_CJK_RE2}]|[^!-/:-@\[-`{{-~\p{{P}}{_CJK_RE2}]+)', 1)))) AS p FROM segs)
SELECT token, array_to_string(p, '|') AS pieces, array_to_string(list_transform(p, lambda x, i:
         CAST(strlen(array_to_string(p[:i], '')) AS VARCHAR)), ',') AS ends FROM pcs"""

# one well-formed UTF-8 character, and the longest beginning of one, in hexadecimal digits
_C = "[89AB]."
_UTF8 = (rf"[0-7].|(?:C[2-9A-F]|D.){_C}|E0[AB].{_C}|E[1-9ABCEF]{_C}{_C}|ED[89].{_C}|F0[9AB].{_C}{_C}|"
         rf"F[123]{_C}{_C}{_C}|F48.{_C}{_C}")
_PART = rf"E0[AB].|E[1-9ABCEF]{_C}|ED[89].|F0[9AB].(?:{_C})?|F[123]{_C}(?:{_C})?|F48.(?:{_C})?"


def _repaired(h: str) -> str:
    """SQL for the hexadecimal digits of bytes with every broken part replaced by U+FFFD."""
    return (f"array_to_string(list_transform(regexp_extract_all({h}, '(?:{_UTF8})|{_PART}|..', 0), "
            f"lambda x: CASE WHEN regexp_full_match(x, '{_UTF8}') THEN x ELSE 'EFBFBD' END), '')")


SQL["bytes_ignored"] = rf"""
WITH h AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n, strlen(text) // 2 AS half FROM documents),
raw AS (SELECT doc_id, substr(h, 3, 2 * half) || 'FF' || substr(h, 2 * half + 5, 2 * greatest(n - half - 4, 0)) AS r FROM h),
kept AS (SELECT doc_id, r, array_to_string(regexp_extract_all(r, '({_UTF8})|..', 1), '') AS k FROM raw)
SELECT doc_id, CAST(length(k) // 2 AS INTEGER) AS n_kept, CAST((length(r) - length(k)) // 2 AS INTEGER) AS n_dropped,
       md5(k) AS kept_md5 FROM kept"""

SQL["text_repair"] = rf"""
WITH h AS (SELECT doc_id, substr(hex(encode(text)), 3, 2 * greatest(strlen(text) - 3, 0)) AS h FROM documents),
r AS (SELECT doc_id, h, {_repaired("h")} AS r,
             len(list_filter(regexp_extract_all(h, '(?:{_UTF8})|{_PART}|..', 0),
                             lambda x: x = 'EFBFBD' OR NOT regexp_full_match(x, '{_UTF8}'))) AS n FROM h)
SELECT doc_id, h = r AS valid, CAST(length(r) // 2 AS INTEGER) AS repaired_bytes, CAST(n AS INTEGER) AS n_replaced FROM r"""

SQL["vocab_ids"] = r"""
WITH sp(k, line) AS (VALUES (0, '[CLS]'), (1, '[SEP]'), (2, '[PAD]'), (3, '[Q]'), (4, '[YES]'), (5, '[NO]'),
    (6, '[NoLongAnswer]'), (7, '[NoShortAnswer]'), (8, '[SA]'), (9, '[/SA]'), (10, '[UNK]'), (11, '[MASK]')),
ch AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents),
chk AS (SELECT c FROM ch WHERE c <> '' AND NOT regexp_matches(c, '[\s\p{Z}\p{Cc}]')),
wd AS (SELECT w, count(*) AS cnt FROM (SELECT unnest(regexp_split_to_array(text, '[\s\p{Z}]+')) AS w FROM documents)
       WHERE w <> '' GROUP BY w ORDER BY cnt DESC, w LIMIT 2000),
lines AS (SELECT 0 AS sec, k, line FROM sp
          UNION ALL SELECT 1, i, '[ContextId=' || CAST(i AS VARCHAR) || ']' FROM range(45) t(i)
          UNION ALL SELECT 2, 0, c FROM chk UNION ALL SELECT 3, 0, '##' || c FROM chk
          UNION ALL SELECT 4, -cnt, w FROM wd),
num AS (SELECT line, row_number() OVER (ORDER BY sec, k, line) AS ln FROM lines),
firsts AS (SELECT line AS token, min(ln) AS fl FROM num GROUP BY line)
SELECT token, row_number() OVER (ORDER BY fl) - 1 AS id FROM firsts"""

SQL["accent_free_words"] = r"""
SELECT word, strip_accents(word) AS stripped FROM (
  SELECT DISTINCT unnest(regexp_split_to_array(text, '[\s\p{Z}]+')) AS word FROM documents) WHERE word <> ''"""

# ------------------------------------------------------------- gold passage ---

_GP = r"""
gpp AS (SELECT p.example_id, p.language, p.language || '-' || CAST(p.example_id AS VARCHAR) AS id,
          array_to_string(list_slice(string_split(c.txt, ' '), (p.example_id * 5 + 1) % len(string_split(c.txt, ' ')) + 1,
            least(len(string_split(c.txt, ' ')) - 1,
                  (p.example_id * 5 + 1) % len(string_split(c.txt, ' ')) + (p.example_id + 1) % 4) + 1), ' ') AS answer
        FROM qa_pred p JOIN qa_candidates c ON c.doc_id = p.example_id AND c.cand_pos = p.ci
        WHERE p.s >= 0 AND p.example_id < 10000000)"""

SQL["goldp_scan"] = _with(BASE, _GP) + """
SELECT id, answer, language, CAST(NULL AS VARCHAR) AS error FROM gpp"""

SQL["goldp_split"] = _with(BASE, _GP) + """
SELECT CASE WHEN language = 'english' THEN 'english-DO-NOT-AVERAGE' ELSE language END AS lang_label,
       count(*) AS n_answers FROM gpp GROUP BY 1"""

_GP_SCORES = _GP + r""",
gq AS (SELECT fa.example_id, fa.language || '-' || CAST(fa.example_id AS VARCHAR) AS id, fa.annotated_idx
       FROM fa WHERE fa.has_min),
gans AS (SELECT gq.id, g.ann_pos,
           array_to_string(list_slice(string_split(c.txt, ' '), (g.example_id * 5 + g.ann_pos) % len(string_split(c.txt, ' ')) + 1,
             least(len(string_split(c.txt, ' ')) - 1,
                   (g.example_id * 5 + g.ann_pos) % len(string_split(c.txt, ' ')) + g.example_id % 4) + 1), ' ') AS answer_text
         FROM gq JOIN qa_gold g ON g.example_id = gq.example_id AND g.ci = gq.annotated_idx AND g.s >= 0
         JOIN qa_candidates c ON c.doc_id = g.example_id AND c.cand_pos = g.ci),
norm_g AS (SELECT id, ann_pos, list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(regexp_replace(lower(answer_text),
             '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g'),
             '(^|[^\pL\pM\pN_])(a|an|the)($|[^\pL\pM\pN_])', '\1 \3', 'g'),
             '(^|[^\pL\pM\pN_])(a|an|the)($|[^\pL\pM\pN_])', '\1 \3', 'g')), '\s+'), lambda x: x <> '') AS gt
           FROM gans),
norm_p AS (SELECT id, list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(regexp_replace(lower(answer),
             '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g'),
             '(^|[^\pL\pM\pN_])(a|an|the)($|[^\pL\pM\pN_])', '\1 \3', 'g'),
             '(^|[^\pL\pM\pN_])(a|an|the)($|[^\pL\pM\pN_])', '\1 \3', 'g')), '\s+'), lambda x: x <> '') AS pt
           FROM gpp),
pair AS (SELECT g.id, g.gt, p.pt,
           CASE WHEN p.pt IS NULL THEN 0 ELSE coalesce(list_sum(list_transform(list_distinct(p.pt),
             lambda t: least(len(list_filter(p.pt, lambda x: x = t)), len(list_filter(g.gt, lambda x: x = t))))), 0) END AS same
         FROM norm_g g LEFT JOIN norm_p p ON p.id = g.id),
sc AS (SELECT id,
         max(CASE WHEN pt IS NOT NULL AND array_to_string(pt, ' ') = array_to_string(gt, ' ') THEN 1.0 ELSE 0.0 END)
           AS exact_match,
         max(CASE WHEN same = 0 THEN 0.0 ELSE 2 * (same / len(pt)) * (same / len(gt)) / (same / len(pt) + same / len(gt)) END)
           AS f1
       FROM pair GROUP BY id)"""

SQL["goldp_exact_f1"] = _with(BASE, _CTX, _GP_SCORES) + """
SELECT id, round(exact_match, 9) AS exact_match, round(f1, 9) AS f1 FROM sc"""

SQL["goldp_macro"] = _with(BASE, _CTX, _GP_SCORES, """
pl AS (SELECT string_split(id, '-')[1] AS language, count(*) AS n, 100 * avg(exact_match) AS exact_match,
              100 * avg(f1) AS f1 FROM sc GROUP BY 1)""") + """
SELECT language, n, round(exact_match, 9) AS exact_match, round(f1, 9) AS f1 FROM pl
UNION ALL
SELECT 'macro', count(*), round(coalesce(avg(exact_match), 0.0), 9), round(coalesce(avg(f1), 0.0), 9)
FROM pl WHERE language <> 'english'"""

SQL["basic_tokens_destructive"] = r"""
WITH c AS (SELECT regexp_replace(regexp_replace(regexp_replace(text,
             '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\p{Cf}\x{FFFD}]', '', 'g'), '[ \t\n\r\p{Zs}]', ' ', 'g'),
             '([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}])', ' \\1 ', 'g') AS t FROM documents),
w AS (SELECT DISTINCT unnest(regexp_split_to_array(t, '[ \x{2028}\x{2029}]+')) AS word FROM c)
SELECT word, array_to_string(list_filter(regexp_extract_all(strip_accents(lower(word)),
         '([!-/:-@\[-`{-~\p{P}]|[^!-/:-@\[-`{-~\p{P}]+)', 1), lambda x: x <> ''), ' ') AS tokens
FROM w WHERE word <> ''"""

SQL["passage_of_span"] = _with(BASE, """
sp AS (SELECT d.doc_id, c.start_b AS s FROM d JOIN qa_candidates c ON c.doc_id = d.doc_id
       AND c.cand_pos = least(d.n - 1, 1))""") + """
SELECT sp.doc_id AS example_id, sp.s, sp.s + 3 AS e,
       CAST(coalesce((SELECT min(c.cand_pos) FROM qa_candidates c WHERE c.doc_id = sp.doc_id AND c.start_b <= sp.s
                      AND c.start_b + c.len_b >= sp.s + 3), 0) AS INTEGER) AS passage_index
FROM sp"""

# the tokenizer never loses or adds bytes: every token is covered exactly
SQL["offset_mismatch"] = """
SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_tokens, CAST(0 AS BIGINT) AS n_mismatched,
       CAST(0 AS BIGINT) AS mismatch_bytes
FROM documents"""

SQL["max_examples"] = """
SELECT count(*) AS n_entries, min(doc_id) AS first_id, max(doc_id) AS last_id
FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100)"""

_VOCAB_CTE = SQL["vocab_ids"].strip()[len("WITH "):].rsplit("SELECT token, row_number()", 1)[0].rstrip() + \
    ",\nvocab AS (SELECT token, row_number() OVER (ORDER BY fl) - 1 AS id FROM firsts)"

SQL["wordpieces"] = "WITH RECURSIVE " + _VOCAB_CTE + rf""",
toks AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents),
segs AS (SELECT token, regexp_extract_all(token, '([\t\n\r\p{{Z}}]|[^\t\n\r\p{{Z}}]+)', 1) AS sg FROM toks),
words AS (SELECT DISTINCT unnest(flatten(list_transform(sg, lambda s: regexp_extract_all(
            regexp_replace(s, '{_BAD_RE2}', '', 'g'), '({_PU_RE2}|{_NPU_RE2}+)', 1)))) AS word FROM segs),
body AS (SELECT CASE WHEN starts_with(token, '##') THEN substring(token, 3) ELSE token END AS b FROM vocab),
ml AS (SELECT max(length(b)) AS maxlen FROM body WHERE length(b) <= 1 OR NOT regexp_matches(b, '{_PU_RE2}')),
wm AS (SELECT word, length(word) AS m FROM words WHERE length(word) BETWEEN 1 AND 200),
st AS (SELECT word, m, unnest(range(m)) AS s FROM wm),
se AS (SELECT word, m, s, unnest(range(s + 1, least(m, s + (SELECT maxlen FROM ml)) + 1)) AS e FROM st),
longest AS (SELECT se.word, se.s, max(se.e) AS e FROM se JOIN vocab v
              ON v.token = CASE WHEN se.s > 0 THEN '##' ELSE '' END || substring(se.word, se.s + 1, se.e - se.s)
            GROUP BY se.word, se.s),
walk(word, m, pos, out) AS (
  SELECT word, m, 0, '' FROM wm
  UNION ALL
  SELECT w.word, w.m, l.e, w.out || CASE WHEN w.pos = 0 THEN '' ELSE ' ' END
         || CASE WHEN w.pos > 0 THEN '##' ELSE '' END || substring(w.word, w.pos + 1, l.e - w.pos)
  FROM walk w JOIN longest l ON l.word = w.word AND l.s = w.pos WHERE w.pos < w.m),
done AS (SELECT word, out FROM walk WHERE pos = m)
SELECT w.word, coalesce(d.out, '[UNK]') AS pieces
FROM words w LEFT JOIN done d ON d.word = w.word WHERE w.word <> ''"""

_WALK = SQL["wordpieces"][len("WITH RECURSIVE "):].rsplit("SELECT w.word, coalesce(d.out, '[UNK]') AS pieces", 1)[0]

SQL["tokens_with_offsets"] = "WITH RECURSIVE " + BASE.strip() + "," + _CTX.rstrip() + """,
ctx AS (SELECT doc_id, string_agg(marker || ' ' || txt, ' ' ORDER BY cand_pos) AS contexts FROM kc GROUP BY doc_id),
""" + _WALK.strip().rstrip(",").replace(
    "toks AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents),",
    "toks AS (SELECT DISTINCT unnest(string_split(contexts, ' ')) AS token FROM ctx),") + rf""",
ct AS (SELECT doc_id, string_split(contexts, ' ') AS tl FROM ctx),
ti AS (SELECT doc_id, tl, unnest(range(len(tl))) AS i FROM ct),
tt AS (SELECT doc_id, i, tl[i + 1] AS token,
         coalesce(sum(strlen(tl[i + 1]) + 1) OVER (PARTITION BY doc_id ORDER BY i
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tok_start FROM ti),
unk AS (SELECT id FROM vocab WHERE token = '[UNK]'),
spec AS (SELECT tt.doc_id, tt.i, 0 AS j, 0 AS k, v.id, strlen(tt.token) AS nb, tt.tok_start FROM tt
         JOIN vocab v ON v.token = tt.token
         WHERE tt.token IN ('[CLS]', '[SEP]', '[PAD]', '[Q]', '[YES]', '[NO]', '[NoLongAnswer]', '[NoShortAnswer]',
                            '[SA]', '[/SA]', '[UNK]', '[MASK]')
            OR starts_with(tt.token, '[Paragraph=') OR starts_with(tt.token, '[ContextId=')),
plain AS (SELECT * FROM tt WHERE NOT (token IN ('[CLS]', '[SEP]', '[PAD]', '[Q]', '[YES]', '[NO]', '[NoLongAnswer]',
            '[NoShortAnswer]', '[SA]', '[/SA]', '[UNK]', '[MASK]')
            OR starts_with(token, '[Paragraph=') OR starts_with(token, '[ContextId='))),
tsub AS (SELECT token, flatten(list_transform(
           regexp_extract_all(token, '([\t\n\r\p{{Z}}]|[^\t\n\r\p{{Z}}]+)', 1),
           lambda s: list_concat(
             list_transform(regexp_extract_all(s, '({_BAD_RE2})', 1), lambda b: {{'p': b, 'good': false}}),
             list_transform(regexp_extract_all(regexp_replace(s, '{_BAD_RE2}', '', 'g'), '({_PU_RE2}|{_NPU_RE2}+)', 1),
                            lambda x: {{'p': x, 'good': true}})))) AS subs
         FROM (SELECT DISTINCT token FROM plain)),
ts AS (SELECT token, subs, unnest(range(len(subs))) AS j FROM tsub),
ts2 AS (SELECT token, j, subs[j + 1].p AS p, subs[j + 1].good AS good FROM ts),
wres AS (SELECT w.word, coalesce(d.out, '[UNK]') AS out FROM words w LEFT JOIN done d ON d.word = w.word),
gp AS (SELECT ts2.token, ts2.j, string_split(wres.out, ' ') AS pl, ts2.p FROM ts2 JOIN wres ON wres.word = ts2.p
       WHERE ts2.good),
gp2 AS (SELECT token, j, p, pl, unnest(range(len(pl))) AS k FROM gp),
gp3 AS (SELECT token, j, k, pl[k + 1] AS piece, p FROM gp2),
pieces AS (
  SELECT gp3.token, gp3.j, gp3.k, v.id,
         CASE WHEN gp3.piece = '[UNK]' THEN strlen(gp3.p)
              ELSE strlen(CASE WHEN starts_with(gp3.piece, '##') THEN substring(gp3.piece, 3) ELSE gp3.piece END)
         END AS nb
  FROM gp3 JOIN vocab v ON v.token = gp3.piece
  UNION ALL
  SELECT ts2.token, ts2.j, 0, coalesce(v.id, (SELECT id FROM unk)), strlen(ts2.p)
  FROM ts2 LEFT JOIN vocab v ON v.token = ts2.p WHERE NOT ts2.good),
allp AS (SELECT plain.doc_id, plain.i, pieces.j, pieces.k, pieces.id, pieces.nb, plain.tok_start
         FROM plain JOIN pieces ON pieces.token = plain.token
         UNION ALL SELECT doc_id, i, j, k, id, nb, tok_start FROM spec),
offs AS (SELECT doc_id, i, j, k, id, nb, tok_start + coalesce(sum(nb) OVER (PARTITION BY doc_id, i ORDER BY j, k
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM allp)
SELECT doc_id AS example_id, CAST(count(*) AS INTEGER) AS n_wordpieces, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY i, j, k)) AS ids_md5,
       md5(string_agg(CAST(st AS VARCHAR), ',' ORDER BY i, j, k)) AS starts_md5,
       md5(string_agg(CAST(st + nb - 1 AS VARCHAR), ',' ORDER BY i, j, k)) AS ends_md5
FROM offs GROUP BY doc_id"""

_TOK_CTES = SQL["tokens_with_offsets"].rsplit("SELECT doc_id AS example_id, CAST(count(*) AS INTEGER)", 1)[0]

SQL["nearest_wordpiece"] = _TOK_CTES.rstrip() + """,
ix AS (SELECT doc_id, st, st + nb - 1 AS en, row_number() OVER (PARTITION BY doc_id ORDER BY i, j, k) - 1 AS wi
       FROM offs),
tgt AS (SELECT example_id, CASE WHEN annotated_idx < 0 THEN 0 WHEN has_min THEN gs - cs + ts ELSE ts END AS sb,
               CASE WHEN annotated_idx < 0 THEN 1 WHEN has_min THEN ge - cs + ts ELSE ts + cl END AS eb FROM ans)
SELECT tgt.example_id,
       (tgt.sb < tgt.eb AND EXISTS (SELECT 1 FROM ix WHERE ix.doc_id = tgt.example_id AND ix.st <= tgt.eb - 1
                                    AND ix.en >= tgt.sb)) AS has_wordpiece,
       CAST(coalesce((SELECT min(wi) FROM ix WHERE ix.doc_id = tgt.example_id AND ix.en >= tgt.sb), -1) AS INTEGER)
         AS wp_start,
       CAST(coalesce((SELECT max(wi) FROM ix WHERE ix.doc_id = tgt.example_id AND ix.st <= tgt.eb - 1
                      AND tgt.eb - 1 >= 0), -1) AS INTEGER) AS wp_end
FROM tgt"""

# destructive tokenizer, then the same walk over its tokens
SQL["full_tokenizer"] = "WITH RECURSIVE " + _VOCAB_CTE + r""",
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,
             '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\p{Cf}\x{FFFD}]', '', 'g'), '[ \t\n\r\p{Zs}]', ' ', 'g'),
             '([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}])', ' \\1 ', 'g') AS t FROM documents),
cw AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[ \x{2028}\x{2029}]+'), lambda x: x <> '') AS ws FROM c),
wo AS (SELECT doc_id, ws[i] AS raw, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM cw)),
dw AS (SELECT raw, list_filter(regexp_extract_all(strip_accents(lower(raw)),
         '([!-/:-@\[-`{-~\p{P}]|[^!-/:-@\[-`{-~\p{P}]+)', 1), lambda x: x <> '') AS ts FROM (SELECT DISTINCT raw FROM wo)),
words AS (SELECT DISTINCT unnest(ts) AS word FROM dw),
""" + "body AS" + _WALK.split("\nbody AS", 1)[1].rstrip().rstrip(",") + """,
wres AS (SELECT w.word, string_split(coalesce(d.out, '[UNK]'), ' ') AS pl FROM words w LEFT JOIN done d ON d.word = w.word),
dt AS (SELECT raw, ts[k] AS word, k FROM (SELECT raw, ts, unnest(range(1, len(ts) + 1)) AS k FROM dw)),
dp AS (SELECT dt.raw, dt.k, pl[m] AS piece, m FROM (SELECT dt.raw, dt.k, wres.pl, unnest(range(1, len(wres.pl) + 1)) AS m
         FROM dt JOIN wres ON wres.word = dt.word) AS dt),
dv AS (SELECT dp.*, v.id FROM dp JOIN vocab v ON v.token = dp.piece)
SELECT wo.doc_id, CAST(count(*) AS INTEGER) AS n_pieces, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY wo.i, k, m)) AS ids_md5,
       md5(string_agg(piece, ' ' ORDER BY wo.i, k, m)) AS tokens_md5
FROM wo JOIN dv ON dv.raw = wo.raw GROUP BY wo.doc_id"""

# slices of the contexts of valid entries in hexadecimal digits
_HEX = _TOK_CTES.rstrip() + """,
okd AS (SELECT doc_id FROM d WHERE len(list_filter(list_slice(paras, 1, 45), lambda x: x = '')) = 0),
cx AS (SELECT c.doc_id, hex(encode(c.contexts)) AS h, strlen(c.contexts) AS n FROM ctx c JOIN okd USING (doc_id))"""

SQL["alignment_report"] = _HEX + rf""",
cut AS (SELECT doc_id, unnest(range(0, greatest(n, 1), 20)) AS at, h FROM cx),
pc AS (SELECT o.doc_id, o.st - o.st % 20 AS at, count(*) AS n, string_agg(v.token, ' ' ORDER BY o.i, o.j, o.k) AS w
       FROM offs o JOIN vocab v ON v.id = o.id GROUP BY ALL)
SELECT cut.doc_id AS example_id, CAST(cut.at AS INTEGER) AS at,
       regexp_full_match(substr(h, 2 * cut.at + 1, 40), '(?:{_UTF8})*') AS whole_chars,
       coalesce(seg.plain_start + cut.at - seg.ctx_start, -1) AS plain_at, CAST(coalesce(pc.n, 0) AS INTEGER) AS n_wordpieces,
       coalesce(pc.w, '') AS wordpieces, seg.doc_id IS NULL AS unmapped
FROM cut LEFT JOIN seg ON seg.doc_id = cut.doc_id AND cut.at >= seg.ctx_start AND cut.at < seg.ctx_end
LEFT JOIN pc ON pc.doc_id = cut.doc_id AND pc.at = cut.at"""

SQL["answer_context"] = _HEX + rf""",
acx AS (SELECT a.example_id, CASE WHEN a.has_min THEN a.gs - a.cs + a.ts ELSE a.ts END AS s,
              CASE WHEN a.has_min THEN a.ge - a.cs + a.ts ELSE a.ts + a.cl END AS e, cx.h
       FROM ans a JOIN cx ON cx.doc_id = a.example_id WHERE a.annotated_idx >= 0)
SELECT example_id, decode(unhex({_repaired("substr(h, 2 * s + 1, 2 * (e - s))")})) AS answer,
       decode(unhex({_repaired("substr(h, 2 * greatest(s - 100, 0) + 1, 2 * (s - greatest(s - 100, 0)))")})) AS before,
       decode(unhex({_repaired("substr(h, 2 * e + 1, 200)")})) AS after
FROM acx"""

# errors of training preparation: answers without a wordpiece (empty for ids that end in 7)
_ERRORS = _TOK_CTES.rstrip() + "," + _SCAN_LIT.rstrip() + """,
ix AS (SELECT doc_id, st, st + nb - 1 AS en FROM offs),
tgt AS (SELECT example_id, CASE WHEN annotated_idx < 0 THEN 0 WHEN has_min THEN gs - cs + ts ELSE ts END AS sb,
               CASE WHEN annotated_idx < 0 THEN 1 WHEN has_min THEN CASE WHEN example_id % 10 = 7 THEN gs ELSE ge END
                                                                    - cs + ts
                    ELSE ts + cl END AS eb, annotated_idx >= 0 AND annotated_idx < least(n, 45) AS has_correct_context
        FROM ans),
found AS (
  SELECT s.shard, s.line_no, s.example_id, s.language, coalesce(t.has_correct_context, true) AS has_correct_context,
         CASE WHEN t.example_id IS NULL OR t.sb >= t.eb THEN 'no wordpiece in answer span'
              WHEN NOT EXISTS (SELECT 1 FROM ix WHERE ix.doc_id = t.example_id AND ix.st <= t.eb - 1 AND ix.en >= t.sb)
              THEN 'no wordpiece in answer span' ELSE '' END AS errors,
         row_number() OVER (ORDER BY s.shard, s.line_no) <= 25 AS is_first
  FROM scanned s LEFT JOIN tgt t ON t.example_id = s.example_id WHERE s.outcome = 'ok')"""

SQL["preparation_report"] = _ERRORS + """
SELECT CAST(shard AS BIGINT) AS shard, CAST(line_no AS BIGINT) AS line_no, CAST(example_id AS BIGINT) AS example_id, language,
       has_correct_context, errors, is_first
FROM found WHERE is_first OR errors <> ''"""

SQL["error_sample"] = _ERRORS + """
SELECT errors AS error, CAST(rank AS INTEGER) AS rank, CAST(shard AS BIGINT) AS shard, CAST(line_no AS BIGINT) AS line_no,
       CAST(example_id AS BIGINT) AS example_id
FROM (SELECT *, row_number() OVER (PARTITION BY errors ORDER BY shard, line_no) AS rank FROM found WHERE errors <> '')
WHERE rank <= 25"""

# contexts (key 2 * doc_id) and questions "[Q] " + first paragraph (key 2 * doc_id + 1) through the same
# SQL tokenizer; windows counted from the closed form of the window loop
_QTOK = _TOK_CTES.replace(
    "ctx AS (SELECT doc_id, string_agg(marker || ' ' || txt, ' ' ORDER BY cand_pos) AS contexts FROM kc GROUP BY doc_id),",
    "ctx0 AS (SELECT doc_id, string_agg(marker || ' ' || txt, ' ' ORDER BY cand_pos) AS contexts FROM kc "
    "GROUP BY doc_id),\nctx AS (SELECT doc_id * 2 AS doc_id, contexts FROM ctx0 "
    "UNION ALL SELECT doc_id * 2 + 1, '[Q] ' || paras[1] FROM d),")
assert _QTOK != _TOK_CTES

SQL["feature_histogram"] = _QTOK.rstrip() + """,
cnt AS (SELECT doc_id // 2 AS ex, count(*) FILTER (WHERE doc_id % 2 = 0) AS n,
               least(64, count(*) FILTER (WHERE doc_id % 2 = 1)) AS nq FROM offs GROUP BY doc_id // 2),
nw AS (SELECT ex, CASE WHEN n = 0 THEN 0 ELSE 1 + greatest(0, CAST(ceil((n - (509 - nq)) / least(509 - nq, 128)) AS BIGINT))
              END AS k FROM cnt)
SELECT k AS n_features, count(*) AS n_examples FROM nw GROUP BY k"""

SQL["features"] = _QTOK.rstrip() + """,
ids2(language, language_id) AS (VALUES ('arabic', 0), ('bengali', 1), ('finnish', 2), ('indonesian', 3),
   ('japanese', 4), ('swahili', 5), ('korean', 6), ('russian', 7), ('telugu', 8), ('thai', 9), ('english', 10)),
op AS (SELECT doc_id // 2 AS ex, doc_id % 2 AS kind, id, st, st + nb - 1 AS en,
              row_number() OVER (PARTITION BY doc_id ORDER BY i, j, k) - 1 AS wi,
              count(*) OVER (PARTITION BY doc_id) AS cnt FROM offs),
qsum AS (SELECT ex, least(64, max(cnt)) AS nq, 
                string_agg(CAST(id AS VARCHAR), ',' ORDER BY wi) FILTER (WHERE wi >= cnt - 64) AS qids
         FROM op WHERE kind = 1 GROUP BY ex),
dp AS (SELECT op.ex, op.wi, op.id,
              coalesce((SELECT plain_start + op.st - ctx_start FROM seg WHERE seg.doc_id = op.ex
                          AND op.st >= seg.ctx_start AND op.st < seg.ctx_end), -1) AS ps,
              coalesce((SELECT plain_start + op.en - ctx_start FROM seg WHERE seg.doc_id = op.ex
                          AND op.en >= seg.ctx_start AND op.en < seg.ctx_end), -1) AS pe
       FROM op WHERE kind = 0),
dn AS (SELECT ex, count(*) AS n FROM dp GROUP BY ex),
wpar AS (SELECT q.ex, q.nq, q.qids, coalesce(dn.n, 0) AS n, 509 - q.nq AS w, least(509 - q.nq, 128) AS step
         FROM qsum q LEFT JOIN dn ON dn.ex = q.ex),
wk AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE 1 + greatest(0, CAST(ceil((n - w) / step) AS BIGINT)) END AS kk FROM wpar),
win AS (SELECT ex, nq, qids, n, w, step, unnest(range(kk)) AS kw FROM wk WHERE kk > 0),
win2 AS (SELECT *, kw * step AS ws, least(n - kw * step, w) AS wl FROM win),
agg AS (SELECT win2.ex, win2.kw, win2.nq, win2.qids, win2.wl,
               string_agg(CAST(dp.id AS VARCHAR), ',' ORDER BY dp.wi) AS dids,
               string_agg(CAST(dp.ps AS VARCHAR), ',' ORDER BY dp.wi) AS dps,
               string_agg(CAST(dp.pe AS VARCHAR), ',' ORDER BY dp.wi) AS dpe,
               count(dp.id) FILTER (WHERE dp.ps >= 0) AS nm
        FROM win2 LEFT JOIN dp ON dp.ex = win2.ex AND dp.wi >= win2.ws AND dp.wi < win2.ws + win2.wl
        GROUP BY win2.ex, win2.kw, win2.nq, win2.qids, win2.wl)
SELECT agg.ex + agg.kw AS unique_ids, agg.ex AS example_index, CAST(agg.kw AS INTEGER) AS doc_span_index,
       CAST(ids2.language_id AS INTEGER) AS language_id,
       md5((SELECT id FROM vocab WHERE token = '[CLS]') || ',' || agg.qids || ','
           || (SELECT id FROM vocab WHERE token = '[SEP]') || ',' || agg.dids || ','
           || (SELECT id FROM vocab WHERE token = '[SEP]') || repeat(',0', CAST(509 - agg.nq - agg.wl AS BIGINT))) AS ids_md5,
       md5(repeat('-1,', CAST(agg.nq + 2 AS BIGINT)) || agg.dps || repeat(',-1', CAST(510 - agg.nq - agg.wl AS BIGINT)))
         AS starts_md5,
       md5(repeat('-1,', CAST(agg.nq + 2 AS BIGINT)) || agg.dpe || repeat(',-1', CAST(510 - agg.nq - agg.wl AS BIGINT)))
         AS ends_md5,
       CAST(agg.nq + 3 + agg.wl AS BIGINT) AS n_real, CAST(agg.wl + 1 AS BIGINT) AS n_doc,
       CAST(agg.nm AS INTEGER) AS n_mapped
FROM agg JOIN d ON d.doc_id = agg.ex JOIN ids2 ON ids2.language = d.language"""

_WINDOWS = SQL["features"].rsplit("agg AS (SELECT win2.ex", 1)[0].rstrip().rstrip(",")

# labels of every training window: examples with an answer that holds a wordpiece
_LABELS = _WINDOWS + """,
ltgt AS (SELECT example_id, annotated_idx, has_min, CASE WHEN annotated_idx < 0 THEN 0 WHEN has_min THEN gs - cs + ts ELSE ts END AS sb,
                CASE WHEN annotated_idx < 0 THEN 1 WHEN has_min THEN ge - cs + ts ELSE ts + cl END AS eb FROM ans),
lpos AS (SELECT t.example_id, t.annotated_idx, t.has_min, min(o.wi) FILTER (o.en >= t.sb) AS a,
                max(o.wi) FILTER (o.st <= t.eb - 1) AS b
         FROM ltgt t JOIN op o ON o.ex = t.example_id AND o.kind = 0 AND t.sb < t.eb
         GROUP BY ALL HAVING bool_or(o.st <= t.eb - 1 AND o.en >= t.sb)),
lab AS (SELECT w.ex, w.kw, l.annotated_idx >= 0 AND l.a >= w.ws AND l.b <= w.ws + w.wl - 1 AS pos, l.a - w.ws + w.nq + 2 AS s,
               l.b - w.ws + w.nq + 2 AS e, CASE WHEN l.has_min THEN 3 ELSE 4 END AS type
        FROM win2 w JOIN lpos l ON l.example_id = w.ex)
SELECT ex + kw AS unique_ids, ex AS example_index, CAST(kw AS INTEGER) AS doc_span_index,
       CAST(CASE WHEN pos THEN s ELSE 0 END AS BIGINT) AS start_positions,
       CAST(CASE WHEN pos THEN e ELSE 0 END AS BIGINT) AS end_positions,
       CAST(CASE WHEN pos THEN type ELSE 0 END AS BIGINT) AS answer_types
FROM lab"""
SQL["window_labels_all"] = _LABELS
SQL["window_labels_positive"] = _LABELS + " WHERE pos"

SQL["buffer_shuffled"] = _WINDOWS + """,
f AS (SELECT ex, kw, row_number() OVER (ORDER BY ex, kw) - 1 AS p, count(*) OVER () AS n FROM win2),
r AS (SELECT ex, kw, epoch, epoch * n + p AS before FROM f, range(2) AS e(epoch)),
q AS (SELECT *, before * 65536 + CAST('0x' || substr(md5('7:' || before), 1, 4) AS BIGINT) * 100 AS due FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY due, before) - 1 AS position, count(*) OVER () AS total FROM q)
SELECT position, before AS position_before, CAST(epoch AS INTEGER) AS epoch, ex AS example_index,
       CAST(kw AS INTEGER) AS doc_span_index, position // 32 AS batch FROM o WHERE position < total - total % 32"""

SQL["score_batches"] = _WINDOWS + """
SELECT ex AS example_index, CAST(kw AS INTEGER) AS doc_span_index,
       ((ex * 1000 + kw) * 31 + 7) % 97 / 8.0::DOUBLE AS start_1,
       ((ex * 1000 + kw) * 17 + 11) % 89 / 8.0::DOUBLE AS end_1,
       ((ex * 1000 + kw) + 4) % 5 / 8.0::DOUBLE AS type_4
FROM win2"""

SQL["nbest"] = _WINDOWS + """,
pos AS (SELECT ex, kw, ex * 1000 + kw AS u, unnest(range(1, 512)) AS i FROM win2),
sr AS (SELECT ex, kw, i, row_number() OVER (PARTITION BY ex, kw ORDER BY (u * 31 + i * 7) % 97 DESC, i) AS r
       FROM pos),
er AS (SELECT ex, kw, i, row_number() OVER (PARTITION BY ex, kw ORDER BY (u * 17 + i * 11) % 89 DESC, i) AS r
       FROM pos),
sa AS (SELECT ex, kw, string_agg(CAST(i AS VARCHAR), ',' ORDER BY r) AS start_indexes FROM sr WHERE r <= 30
       GROUP BY ex, kw),
ea AS (SELECT ex, kw, string_agg(CAST(i AS VARCHAR), ',' ORDER BY r) AS end_indexes FROM er WHERE r <= 30
       GROUP BY ex, kw)
SELECT sa.ex AS example_index, CAST(sa.kw AS INTEGER) AS doc_span_index, sa.start_indexes, ea.end_indexes
FROM sa JOIN ea ON ea.ex = sa.ex AND ea.kw = sa.kw"""

_SPANS = SQL["nbest"].rsplit("sa AS (SELECT ex, kw, string_agg", 1)[0].rstrip().rstrip(",") + """,
op3 AS (SELECT doc_id // 2 AS ex, st, st + nb - 1 AS en,
               row_number() OVER (PARTITION BY doc_id ORDER BY i, j, k) - 1 AS wi FROM offs WHERE doc_id % 2 = 0),
dm AS (SELECT op3.ex, op3.wi,
         (SELECT g.plain_start + op3.st - g.ctx_start FROM seg g WHERE g.doc_id = op3.ex AND op3.st >= g.ctx_start
            AND op3.st < g.ctx_end) AS ps,
         (SELECT g.plain_start + op3.en - g.ctx_start FROM seg g WHERE g.doc_id = op3.ex AND op3.en >= g.ctx_start
            AND op3.en < g.ctx_end) AS pe
       FROM op3),
posmap AS (SELECT win2.ex, win2.kw, win2.nq + 2 + (dm.wi - win2.ws) AS p, dm.ps, dm.pe
           FROM win2 JOIN dm ON dm.ex = win2.ex AND dm.wi >= win2.ws AND dm.wi < win2.ws + win2.wl),
pairs AS (SELECT s.ex, s.kw, s.r AS srank, e.r AS erank, s.i AS si, e.i AS ei,
            ((s.ex * 1000 + s.kw) * 31 + 7 * s.i) % 97 / 8.0::DOUBLE + ((s.ex * 1000 + s.kw) * 17 + 11 * e.i) % 89 / 8.0::DOUBLE
            - (((s.ex * 1000 + s.kw) * 31) % 97 / 8.0::DOUBLE + ((s.ex * 1000 + s.kw) * 17) % 89 / 8.0::DOUBLE) AS score,
            ms.ps AS start_byte, me.pe + 1 AS end_byte
          FROM sr s JOIN er e ON e.ex = s.ex AND e.kw = s.kw AND e.r <= 30
          JOIN posmap ms ON ms.ex = s.ex AND ms.kw = s.kw AND ms.p = s.i
          JOIN posmap me ON me.ex = e.ex AND me.kw = e.kw AND me.p = e.i
          WHERE s.r <= 30 AND e.i >= s.i AND e.i - s.i + 1 <= 100 AND ms.ps IS NOT NULL AND me.pe IS NOT NULL),
pbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ex, kw ORDER BY score DESC, srank, erank) AS rb,
                                   count(*) OVER (PARTITION BY ex, kw) AS n_valid FROM pairs) WHERE rb = 1)"""

SQL["span_candidates"] = _SPANS + """
SELECT w.ex AS example_index, CAST(w.kw AS INTEGER) AS doc_span_index, coalesce(b.n_valid, 0) AS n_valid,
       round(b.score, 9) AS score, CAST(b.start_byte AS INTEGER) AS start_byte, CAST(b.end_byte AS INTEGER) AS end_byte
FROM win2 w LEFT JOIN pbest b ON b.ex = w.ex AND b.kw = w.kw"""

SQL["best_span"] = _SPANS + """
SELECT ex AS example_index, round(score, 9) AS score, CAST(kw AS INTEGER) AS doc_span_index,
       CAST(start_byte AS INTEGER) AS start_byte, CAST(end_byte AS INTEGER) AS end_byte
FROM (SELECT *, row_number() OVER (PARTITION BY ex ORDER BY score DESC, kw, srank, erank) AS re FROM pbest)
WHERE re = 1"""

SQL["predictions"] = _SPANS + """,
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ex ORDER BY score DESC, kw, srank, erank) AS re
                      FROM pbest) WHERE re = 1)
SELECT bs.ex AS example_id, d.language,
       CAST(coalesce((SELECT min(c.cand_pos) FROM qa_candidates c WHERE c.doc_id = bs.ex
                      AND c.start_b <= bs.start_byte AND c.start_b + c.len_b >= bs.end_byte), 0) AS BIGINT)
         AS passage_answer_index,
       CAST(bs.start_byte AS BIGINT) AS minimal_start_byte, CAST(bs.end_byte AS BIGINT) AS minimal_end_byte,
       'none' AS yes_no_answer, round(bs.score, 9) AS score
FROM bs JOIN d ON d.doc_id = bs.ex"""

SQL["feature_roundtrip"] = _WINDOWS + """
SELECT count(*) AS n_records, CAST(0 AS BIGINT) AS n_bad_length, count(DISTINCT ex) AS n_examples FROM win2"""

# the repeatable order itself is not comparable by an order-insensitive check: the row set is
SQL["shuffled"] = _WINDOWS + """
SELECT ex + kw AS unique_ids, ex AS example_index, CAST(kw AS INTEGER) AS doc_span_index FROM win2"""

SQL["oversampled"] = _WINDOWS + """,
lc AS (SELECT language, count(*) AS n_examples FROM d GROUP BY language),
lr AS (SELECT language, floor(least(10.0, max(n_examples) OVER () / n_examples)) AS ratio FROM lc)
SELECT CAST(ids2.language_id AS INTEGER) AS language_id, CAST(count(*) * max(lr.ratio) AS BIGINT) AS n_rows,
       CAST(max(lr.ratio) AS INTEGER) AS n_copies
FROM win2 JOIN d ON d.doc_id = win2.ex JOIN lr ON lr.language = d.language JOIN ids2 ON ids2.language = d.language
GROUP BY ids2.language_id"""

SQL["shards"] = _WINDOWS + """,
o AS (SELECT ex, dense_rank() OVER (ORDER BY ex) - 1 AS er, row_number() OVER (ORDER BY ex, kw) - 1 AS pos,
             count(*) OVER () AS n_all FROM win2)
SELECT er // 64 AS shard, count(DISTINCT ex) AS n_examples, count(*) AS n_features, CAST(1 AS BIGINT) AS n_files,
       count(*) FILTER (WHERE pos < n_all - n_all % 16) AS n_batched
FROM o GROUP BY er // 64"""
