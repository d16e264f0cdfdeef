"""Gold-passage task: split predictions by language and score them with the
SQuAD 1.1 exact-match / token-F1 definition (lower case, drop ASCII
punctuation and the articles a/an/the, collapse whitespace; F1 over the
bag of tokens, best gold answer per question)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanqa.constants import EXCLUDED_LANGUAGE, GOLDP_ENGLISH_LABEL, GOLDP_LANGUAGES

# --- fixed values: ASCII punctuation removed by the SQuAD normaliser -----
_PUNCT = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def with_language(preds: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """language = id prefix before the first '-'; ``error`` when the id
    has no '-' or the prefix is not a listed language."""
    languages = languages or GOLDP_LANGUAGES
    parts = F.split("id", "-")
    lang = parts[0]
    err = (F.when(F.size(parts) < 2, F.lit("id does not start with a valid language"))
           .when(~lang.isin(languages), F.lit("id does not start with a valid language")))
    return preds.withColumn("language", lang).withColumn("error", err).withColumn(
        "lang_label", F.when(lang == EXCLUDED_LANGUAGE, F.lit(GOLDP_ENGLISH_LABEL)).otherwise(lang))


def write_split(preds: DataFrame, out_dir: str) -> None:
    """K5: one folder per language label (english as its do-not-average
    label), JSON lines {id, answer}; fails on an invalid id."""
    message = F.concat(F.lit("invalid id "), F.coalesce(F.col("id"), F.lit("null")))
    checked = with_language(preds).where(F.when(F.col("error").isNull() & F.col("id").isNotNull(), F.lit(True)).otherwise(
        F.raise_error(message).cast("boolean")))
    checked.select("id", "answer", "lang_label").write.mode("overwrite").partitionBy("lang_label").json(out_dir)


def normalized_tokens(col) -> Column:
    """lower -> drop punctuation -> drop articles -> split on white space
    (Unicode separators such as the no-break space included)."""
    c = F.col(col) if isinstance(col, str) else col
    t = F.regexp_replace(F.lower(c), _PUNCT, "")
    t = F.regexp_replace(t, r"(?U)\b(a|an|the)\b", " ")
    return F.filter(F.split(t, r"[\s\p{Z}]+"), lambda x: x != "")


def squad_scores(dataset: DataFrame, preds: DataFrame) -> DataFrame:
    """J14 + A17: per question, exact match and F1 against the best gold
    answer (0 for an unanswered question). dataset: one row per gold answer
    (id, answer_text); preds: (id, answer)."""
    p = preds.select("id", normalized_tokens("answer").alias("pt"))
    g = dataset.select("id", "answer_pos", normalized_tokens("answer_text").alias("gt"))
    j = g.join(p, "id", "left")
    common = F.aggregate(F.array_distinct("pt"), F.lit(0), lambda acc, t: acc + F.least(
        F.size(F.filter("pt", lambda x: x == t)), F.size(F.filter("gt", lambda x: x == t))))
    j = j.withColumn("same", F.when(F.col("pt").isNull(), F.lit(0)).otherwise(common))
    prec = F.col("same") / F.size("pt")
    rec = F.col("same") / F.size("gt")
    j = j.withColumn("em", F.when(F.col("pt").isNotNull() & (F.array_join("pt", " ") == F.array_join("gt", " ")),
                                  1.0).otherwise(0.0))
    j = j.withColumn("f1", F.when(F.col("same") == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec)))
    return j.groupBy("id").agg(F.max("em").alias("exact_match"), F.max("f1").alias("f1"))


def language_scores(scores: DataFrame) -> DataFrame:
    """Mean exact match and F1 (x100) per language of the question id."""
    s = scores.withColumn("language", F.split("id", "-")[0])
    return s.groupBy("language").agg(F.count(F.lit(1)).alias("n"), (100 * F.avg("exact_match")).alias("exact_match"),
                                     (100 * F.avg("f1")).alias("f1"))


def macro(per_lang: DataFrame, excluded: str = EXCLUDED_LANGUAGE) -> DataFrame:
    """Average over languages other than the excluded one."""
    m = per_lang.where(F.col("language") != excluded)
    return m.agg(F.coalesce(F.avg("exact_match"), F.lit(0.0)).alias("avg_exact_match"),
                 F.coalesce(F.avg("f1"), F.lit(0.0)).alias("avg_f1"), F.count(F.lit(1)).alias("n_languages"))
