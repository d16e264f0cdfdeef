"""Personal data by bootstrapped contextual extraction (DataFrame operations only).

Base rules give exact spans of four kinds. They are the seeds: identifier-shaped strings (`SHAPES`) that
overlap a base span are known instances of its kind. Every instance occurs in lexical patterns (the word
before it, the word after it, the pair of both). The bipartite graph of patterns and instances is scored
in `ROUNDS` rounds: a pattern's confidence for a kind is the smoothed share of its occurrences that known
instances of the kind fill, an instance's confidence the noisy-or over its patterns, each counted by how
many distinct instances support it. Unseen identifiers whose confidence reaches `ACCEPT` are added as spans
wherever a confident pattern holds them.

Edges are aggregated per (pattern, instance) before they are shuffled; a pattern or instance with very many
occurrences is one row. Scores are landed each round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanqa.llm.common import land, let, packed, spans, unpacked

KINDS = ("email", "ip", "card", "phone")
#: Base rules. A match may start at the beginning of a run or where the last match ended, which finds the same
#: matches as a plain scan but doesn't try every start inside a long run; possessive loops never backtrack.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What an unseen identifier of a kind may look like: looser than the base rule.
SHAPES = {
    "email": (r"(?:(?<![^\s<>\"'(),;])|\G)[^\s<>\"'(),;@]++@[^\s<>\"'(),;@]++|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(][aA][tT][\])]"
              r"\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(][dD][oO][tT][\])])\x20?[A-Za-z0-9-]++)++"),
    "ip": r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9+])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9A-Za-z])",
}
ROUNDS = 3
ACCEPT = 0.8
PATTERN_ACCEPT = 0.8
SMOOTH = 1.0
SUPPORT = 3
SPAN = "array<struct<kind:string,start:int,end:int>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    def total(s: Column) -> Column:
        d = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: let(
            F.substr(s, i, F.lit(1)).cast("int"),
            lambda x: F.when((F.length(s) - i) % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))))
        return F.aggregate(d, F.lit(0), lambda a, x: a + x)
    return total(digits) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$")
    if kind == "card":
        return let(_digits(v), lambda d: F.length(d).between(13, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


#: Cheap tests that hold wherever a match can be.
_GUARDS = {"email": "@", "phone": "+"}


def _found(text: Column, kind: str) -> Column:
    all_ = spans(text, PATTERNS[kind])
    if kind in _GUARDS:
        all_ = F.when(F.instr(text, _GUARDS[kind]) > 0, all_).otherwise(all_empty())
    else:  # ip needs 7 characters of digits and dots, card 13 digits
        all_ = F.when(text.rlike("[0-9][0-9. -]{5}"), all_).otherwise(all_empty())
    return F.transform(F.filter(all_, lambda s: _valid(kind, s["value"])),
                       lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def all_empty() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")


def base_spans(text: Column) -> Column:
    """Spans of the base rules by kind as listed, then start."""
    return F.concat(*[_found(text, k) for k in KINDS])


def instances(text: Column, base: Column) -> Column:
    """Identifier-shaped strings of a text: kind, span, value, the words around, and whether a base span overlaps."""
    def of_kind(kind: str) -> Column:
        guard = r"@|[\[(][aA][tT][\])]" if kind == "email" else "[0-9]"
        got = F.when(text.rlike(guard), spans(text, f"(?:{PATTERNS[kind]}|{SHAPES[kind]})")).otherwise(all_empty())

        # what a base rule's pattern finds and its check drops is no identifier, unless it has the looser shape
        got = F.filter(got, lambda s: s["value"].rlike(f"^(?:{SHAPES[kind]})$") | F.exists(
            base, lambda b: (b["kind"] == kind) & (b["start"] < s["end"]) & (b["end"] > s["start"])))

        def one(s: Column) -> Column:
            mine = F.filter(base, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
            return F.struct(
                F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                F.lower(s["value"]).alias("value"),
                # anchored at the near end, so that long gaps are never searched
                F.lower(F.reverse(F.regexp_extract(F.reverse(s["before"]), r"^\s*([^\s]+)", 1))).alias("left"),
                F.lower(F.regexp_extract(s["after"], r"^[^\s]{0,2}\s*([^\s]+)", 1)).alias("right"),
                F.exists(mine, lambda b: b["kind"] == kind).alias("seed"), (F.size(mine) > 0).alias("taken"))

        return F.transform(got, one)

    return F.concat(*[of_kind(k) for k in KINDS])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, th, base, found): one row per document, landed; texts are read once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("th"), text.alias("text")).withColumn(
        "base", base_spans(F.col("text")))
    return land(rows.select("doc_id", "th", "base", instances(F.col("text"), F.col("base")).alias("found")), "pii-scan")


def _patterns(i: str) -> Column:
    left, right = F.col(f"{i}.left"), F.col(f"{i}.right")
    return F.filter(F.array(
        F.when(left != "", F.concat(F.lit("L "), left)),
        F.when(right != "", F.concat(F.lit("R "), right)),
        F.when((left != "") & (right != ""), F.concat_ws(" ", F.lit("B"), left, right))), lambda p: p.isNotNull())


def learn(found: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns, values): confidence of each (kind, pattern) and each unseen (kind, value).

    found: one column `i` of instances. The graph's edges are (kind, value, pattern) with their counts. Parts of a known
    identifier of another kind are no instances.
    """
    edges = land(found.where("i.seed or not i.taken").select("i", F.explode(_patterns("i")).alias("pattern"))
                 .groupBy(F.col("i.kind").alias("kind"), F.col("i.value").alias("value"), "pattern")
                 .agg(F.count("*").alias("n"), F.max(F.col("i.seed").cast("double")).alias("known"),
                      F.max(F.col("i.taken")).alias("taken")), "pii-edges")
    conf = edges.select("kind", "value", "pattern", "n", "taken", F.col("known").alias("c"))
    patterns = values = None
    for r in range(rounds):
        # how often a kind's context holds any identifier-shaped string, whatever its kind
        held = conf.groupBy("pattern").agg(F.sum("n").alias("all"))
        patterns = land(conf.groupBy("kind", "pattern").agg(F.sum(F.col("n") * F.col("c")).alias("good"),
                                                            F.sum(F.when(F.col("c") >= ACCEPT, 1).otherwise(0)).alias("support"))
                        .join(held, "pattern")
                        .select("kind", "pattern", (F.col("good") / (F.col("all") + SMOOTH)).alias("conf"), "support")
                        .where((F.col("conf") > 0) & (F.col("support") >= SUPPORT)), f"pii-patterns-{r}")
        new = (edges.where("known = 0 and not taken").join(patterns.select("kind", "pattern", "conf"), ["kind", "pattern"])
               .groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.least("conf", F.lit(0.999)))))).alias("conf")))
        values = land(new, f"pii-values-{r}")
        conf = edges.join(values, ["kind", "value"], "left").select(
            "kind", "value", "pattern", "n", "taken", F.greatest("known", F.coalesce("conf", F.lit(0.0))).alias("c"))
    return patterns, values


def discovered(scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, th, extra): spans of unseen identifiers, for the documents that have any."""
    found = scanned.select(F.explode("found").alias("i"))
    patterns, values = learn(found, rounds)
    sure = patterns.where(F.col("conf") >= PATTERN_ACCEPT).select("kind", "pattern")
    good = values.where(F.col("conf") >= ACCEPT).select("kind", "value")
    unseen = (scanned.select("doc_id", "th", F.explode("found").alias("i")).where("not i.taken")
              .select("doc_id", "th", "i.kind", "i.value", "i.start", "i.end", F.explode(_patterns("i")).alias("pattern")))
    hit = unseen.join(sure, ["kind", "pattern"], "left_semi").join(good, ["kind", "value"], "left_semi")
    span = F.struct("kind", "start", "end")
    return hit.groupBy("doc_id", "th").agg(F.collect_set(span).alias("extra"))


def in_order(all_spans: Column) -> Column:
    """Spans by kind as listed, then start."""
    def of(kind: str) -> Column:
        return F.array_sort(F.filter(all_spans, lambda s: s["kind"] == kind))

    return F.concat(*[of(k) for k in KINDS])


def digest(all_spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, th, base, spans) for every row of `docs(doc_id, text)`; th is xxhash64 of the text.

    base: spans of the base rules; spans: those and the ones the contexts add, by kind as listed, then start.
    Null and empty texts have none. Repeated rows get the same spans. Extra columns are ignored.
    """
    scanned = scan(docs)
    extra = discovered(scanned, rounds).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "extra")
    none = F.array().cast(SPAN)
    return (scanned.join(extra, F.expr("doc_id <=> _d and th = _t"), "left")
            .select("doc_id", "th", "base", in_order(F.concat("base", F.coalesce("extra", none))).alias("spans")))


def _merged(all_spans: Column) -> Column:
    """Spans by start, those that overlap joined under the first one's kind."""
    ordered = F.array_sort(F.transform(all_spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    plain = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("end"),
                                                    s["kind"].alias("kind")))

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
                          last["kind"].alias("kind"))
        return F.when((F.size(acc) > 0) & (s["start"] < last["end"]),
                      F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(plain, F.array().cast("array<struct<start:int,end:int,kind:string>>"), add)


def masked(text: Column, all_spans: Column) -> Column:
    """`text` with every span replaced by its kind in brackets; overlapping spans become one."""
    def of(x: Column) -> Column:
        merged, chars = x["merged"], x["chars"]

        def piece(s: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(merged, i - 1)["end"]).otherwise(0)
            return F.concat(F.array_join(F.slice(chars, before + 1, s["start"] - before), ""),
                            F.lit("["), F.upper(s["kind"]), F.lit("]"))

        end = F.get(merged, F.size(merged) - 1)["end"]
        return F.concat(F.array_join(F.transform(merged, piece), ""),
                        F.array_join(F.slice(chars, end + 1, F.size(chars)), ""))

    return F.when(F.size(all_spans) > 0, let(
        F.struct(_merged(all_spans).alias("merged"), F.split(text, "").alias("chars")), of)).otherwise(text)


def redact(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """`docs` with personal data in `text` masked, and n_chars, if there, the new length of changed texts.

    Same columns and rows; null texts stay null.
    """
    extra = land(discovered(scan(docs), rounds), "pii-extra").select(
        F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("extra").alias("_x"))
    cols = docs.columns
    rows = (packed(docs, "doc_id", "text").withColumns({"_h": F.xxhash64("text"), "_b": base_spans(F.col("text"))})
            .join(extra, F.expr("doc_id <=> _d and _h = _t"), "left"))
    every = F.when(F.col("text").isNotNull(), F.concat("_b", F.coalesce("_x", F.array().cast(SPAN))))
    changed = {"text": masked(F.col("text"), every)}
    if "n_chars" in cols:
        changed["n_chars"] = F.when(F.size(every) > 0, F.length(masked(F.col("text"), every)).cast("long")).otherwise(
            F.col("row.n_chars"))
    return unpacked(rows, cols, changed)
