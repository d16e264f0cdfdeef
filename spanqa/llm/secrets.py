"""Secret scanning with a battery of randomness tests (DataFrame operations only).

Base rules give exact spans of three kinds. Beside them every run of `TOKEN` characters that mixes letters and
digits is a candidate. A candidate's encoding is inferred from its characters (hex, base32, letters of one case with
digits, base58, base62 or base64), its characters become the values of that alphabet, and three tests ask whether
the values look uniformly random:

* chi-squared of the alphabet's characters,
* the Wald-Wolfowitz runs test above and below the middle of the alphabet,
* lag-one serial correlation.

Fisher's method joins them into one p-value for "random"; a candidate that it refutes at `REFUTED` is not reported. Not
being refuted is no proof, least of all for a short candidate. So the chi-squared statistic is also held against
what text gives: letters as frequent as in prose and `TEXT_DIGITS` digits (`TEXT_HEX_DIGITS` in hex) make it noncentral,
with a noncentrality that grows with the length. The p-value of "text" is the chance that text looks as uniform as the
candidate. Discoveries are the candidates for which that is refuted: Benjamini-Hochberg at `FDR` within each
class of encoding and length bounds the expected share of text among what is reported as a span of kind
`random`. Candidates too short to tell the two apart are not reported.

The tests run once per distinct candidate. Benjamini-Hochberg works on counts of p-values in
logarithmic bins of a twentieth of a decade (an upper bound of the bin stands for its p-values), so no
class is sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanqa.llm.common import land, let, spans

KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
              r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"(?:(?<![0-9a-f])|\G)[0-9a-f]{16,}+",
}
_VALUE = r"^[A-Za-z_]+[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)$"
_GUARDS = {"assign": r"[:=]", "access": "AKIA", "hex": r"[0-9a-f]{16}"}
#: Candidates: runs of at least 20 characters, with a letter and a digit.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+"
_AZ = "abcdefghijklmnopqrstuvwxyz"
#: Characters in value order (fixed by the encodings).
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789" + _AZ,
    "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz",
    "base62": _AZ.upper() + _AZ + "0123456789",
    "base64": _AZ.upper() + _AZ + "0123456789+/",
}
#: Letters of English text in hundredths of a per cent, a to z (published values).
PROSE = (817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7)
TEXT_DIGITS = 0.15
TEXT_HEX_DIGITS = 0.5
TEXT_CAPITALS = 0.1
FDR = 0.05
REFUTED = 0.001
BINS = 400


def text_effect(enc: str) -> float:
    """Noncentrality for each character that text gives the chi-squared statistic of an encoding."""
    alphabet = ALPHABETS[enc]
    digits = TEXT_HEX_DIGITS if enc == "hex" else TEXT_DIGITS
    both = alphabet.lower() != alphabet and alphabet.upper() != alphabet
    weight = []
    for c in alphabet:
        if c.isalpha():
            case = (TEXT_CAPITALS if c.isupper() else 1 - TEXT_CAPITALS) if both else 1.0
            weight.append(PROSE[_AZ.index(c.lower())] * case)
        else:
            weight.append(None if c.isdigit() else 0.0)
    letters = sum(w for w in weight if w)
    figures = weight.count(None)
    share = [digits / figures if w is None else w * (1 - digits) / letters for w in weight]
    return len(alphabet) * sum(q * q for q in share) - 1


def _found(text: Column, kind: str) -> Column:
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    got = F.when(text.rlike(_GUARDS[kind]), spans(text, PATTERNS[kind])).otherwise(none)
    if kind == "assign":
        got = F.filter(got, lambda s: F.length(F.regexp_extract(s["value"], _VALUE, 1)) >= 12)
    return F.transform(got, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"),
                                               s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<start, k (place in KINDS), end>> by start, then kind."""
    return F.array_sort(F.concat(*[_found(text, k) for k in KINDS]))


def candidates(text: Column, base: Column) -> Column:
    """Candidate tokens that no base span overlaps."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    got = F.when(text.rlike("[0-9]"), spans(text, TOKEN)).otherwise(none)
    free = F.filter(got, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    return F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                s["value"].alias("value")))


def encoding(token: Column) -> Column:
    return (F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(token.rlike("^([A-Z2-7]+|[a-z2-7]+)$"), "base32")
            .when(token.rlike("^([A-Z0-9]+|[a-z0-9]+)$"), "base36").when(token.rlike("^[1-9A-HJ-NP-Za-km-z]+$"), "base58")
            .when(token.rlike("^[A-Za-z0-9]+$"), "base62").otherwise("base64"))


def _by_encoding(enc: Column, value) -> Column:
    """A literal for each encoding."""
    names = list(ALPHABETS)
    out = F.when(enc == names[0], F.lit(value(names[0])))
    for n in names[1:]:
        out = out.when(enc == n, F.lit(value(n)))
    return out


def upper_normal(z: Column) -> Column:
    """P(N > z) for z >= 0, by the rational approximation of Abramowitz and Stegun 26.2.17 (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.lit(0.0), F.least(F.lit(0.5), F.exp(-z * z / 2) / 2.5066282746310002 * poly))


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * upper_normal(F.abs(z)))


def upper_normal_of(z: Column) -> Column:
    """P(N > z) for any z."""
    return F.when(z >= 0, upper_normal(z)).otherwise(1 - upper_normal(-z))


def chi_squared_tail(x: Column, df: Column) -> Column:
    """P(X > x): by Wilson and Hilferty, the cube root of chi-squared over df is nearly normal."""
    return upper_normal_of((F.pow(x / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))


def noncentral_head(x: Column, df: Column, away: Column) -> Column:
    """P(X <= x) of noncentral chi-squared, by Sankaran's approximation."""
    h = 1 - 2 * (df + away) * (df + 3 * away) / (3 * (df + 2 * away) * (df + 2 * away))
    p = (df + 2 * away) / ((df + away) * (df + away))
    m = (h - 1) * (1 - 3 * h)
    z = (F.pow(x / (df + away), h) - (1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p))) / (h * F.sqrt(2 * p) * (1 + 0.5 * m * p))
    return upper_normal_of(-z)


def values_of(token: Column, enc: Column) -> Column:
    """Places of the characters in the encoding's alphabet."""
    alphabet = _by_encoding(enc, ALPHABETS.get)
    clean = F.when(enc.isin("hex", "base36"), F.lower(token)).when(enc == "base32", F.upper(token)).otherwise(
        F.translate(token, "-_", "+/"))
    return F.transform(F.split(clean, ""), lambda c: F.call_function("instr", alphabet, c) - 1)


def tests(tokens: DataFrame) -> DataFrame:
    """`tokens(value)` plus enc, n, and p-values: of the three tests, of all together (`p`), and of text (`p_text`)."""
    t = tokens.withColumn("enc", encoding(F.col("value")))
    t = t.withColumns({"size": _by_encoding(F.col("enc"), lambda e: len(ALPHABETS[e])),
                       "effect": _by_encoding(F.col("enc"), text_effect), "v": values_of(F.col("value"), F.col("enc"))})
    t = t.withColumn("n", F.size("v").cast("double"))
    squares = F.transform(F.array_distinct("v"), lambda d: F.pow(F.size(F.filter("v", lambda x: x == d)).cast("double"), F.lit(2.0)))
    t = t.withColumn("chi", F.aggregate(squares, F.lit(0.0), lambda a, x: a + x) * F.col("size") / F.col("n") - F.col("n"))
    df = (F.col("size") - 1).cast("double")
    t = t.withColumns({"p_chi": chi_squared_tail(F.greatest(F.col("chi"), F.lit(0.0)), df),
                       "p_text": noncentral_head(F.greatest(F.col("chi"), F.lit(0.0)), df, F.col("n") * F.col("effect"))})
    nxt = F.slice("v", F.lit(2), F.size("v") - 1)
    pairs = F.zip_with(F.slice("v", F.lit(1), F.size("v") - 1), nxt, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    t = t.withColumn("pairs", pairs)
    high = F.size(F.filter("v", lambda x: x * 2 >= F.col("size"))).cast("double")
    runs = 1 + F.size(F.filter("pairs", lambda p: (p["a"] * 2 >= F.col("size")) != (p["b"] * 2 >= F.col("size"))))
    low = F.col("n") - high
    mean = 1 + 2 * high * low / F.col("n")
    var = (mean - 1) * (mean - 2) / (F.col("n") - 1)
    t = t.withColumn("p_runs", F.when(var > 0, two_sided((runs - mean) / F.sqrt(var))).otherwise(0.0))
    avg = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    t = t.withColumn("avg", avg)
    t = t.withColumn("var", F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("avg")) * (x - F.col("avg"))))
    cov = F.aggregate("pairs", F.lit(0.0), lambda a, p: a + (p["a"] - F.col("avg")) * (p["b"] - F.col("avg")))
    t = t.withColumn("p_serial", F.when(F.col("var") > 0, two_sided(
        (cov / F.col("var") + 1 / F.col("n")) * F.sqrt("n"))).otherwise(0.0))
    x = -2 * sum((F.log(F.greatest(F.col(c), F.lit(1e-30))) for c in ("p_chi", "p_runs", "p_serial")), F.lit(0.0))
    half = x / 2  # chi-squared with six degrees of freedom, exactly
    return t.withColumn("p", F.exp(-half) * (1 + half + half * half / 2)).select(
        "value", "enc", "n", "p_chi", "p_runs", "p_serial", "p", "p_text")


def not_text(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """(enc, len_class, max_bin): Benjamini-Hochberg per class on the p-values of text; bins up to max_bin are refuted."""
    binned = tested.groupBy("enc", "len_class", "bin").agg(F.count("*").alias("m"))
    cls = Window.partitionBy("enc", "len_class")
    run = cls.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    upper = F.pow(F.lit(10.0), (F.col("bin") + 1 - BINS) / 20)
    return (binned.withColumns({"rank": F.sum("m").over(run), "all": F.sum("m").over(cls)})
            .where(upper <= F.lit(fdr) * F.col("rank") / F.col("all"))
            .groupBy("enc", "len_class").agg(F.max("bin").alias("max_bin")))


def random_tokens(tokens: DataFrame, fdr: float = FDR) -> DataFrame:
    """(value): the distinct tokens that pass as random and not as text."""
    tested = land(tests(tokens).withColumns({
        "len_class": F.least(F.floor(F.log2("n") * 2), F.lit(24)).cast("int"),
        "bin": F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(
            F.log10(F.greatest("p_text", F.lit(1e-30))) * 20 + BINS))).cast("int")}), "secrets-tests")
    sure = not_text(tested, fdr)
    # a token that repeats few characters can look balanced: ask for the distinct values a random one nearly always has
    varied = F.size(F.array_distinct(F.split("value", ""))) >= F.least(F.lit(8.0), F.col("n") / 3)
    return (tested.join(sure, ["enc", "len_class"])
            .where((F.col("bin") <= F.col("max_bin")) & (F.col("p") >= REFUTED) & varied).select("value"))


def find(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """(doc_id, base, spans) for every row of `docs(doc_id, text)`.

    base: spans of the base rules; spans: those and the random tokens, each a struct (start, k, end) by start, then
    kind (k = place in KINDS, 3 for random). Null and empty texts have none. Repeated rows get the same spans. Extra
    columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), text.alias("text")).withColumn(
        "base", base_spans(F.col("text")))
    scanned = land(rows.select("doc_id", "th", "base", candidates(F.col("text"), F.col("base")).alias("c")), "secrets-scan")
    found = scanned.select("doc_id", "th", F.explode("c").alias("c")).select("doc_id", "th", "c.*")
    good = random_tokens(found.select("value").distinct(), fdr)
    extra = (found.join(good, "value", "left_semi").groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t"))
             .agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("k"), "end")).alias("extra")))
    none = F.array().cast("array<struct<start:int,k:int,end:int>>")
    return (scanned.join(extra, F.expr("doc_id <=> _d and th = _t"), "left")
            .select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("extra", none))).alias("spans")))


def digest(all_spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "random")])
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")
