"""Conversation structure repair: the cheapest edits that make the turns of a conversation fit `(s?(ua)+)?`.

Every length of the alternating grammar has its string (user, assistant, user, ...; with a system turn first for the
odd lengths). The turns are aligned to the string of each feasible length by a Wagner-Fischer matrix. The incumbent,
at first a greedy repair, then the best alignment so far, sets the Ukkonen band of the next matrix and ends the list of
lengths, whose order is that of a lower bound that looks at numbers alone. Cheapest alignments are traced back
to their least audit, and the audits of equal cost are compared.

Turns get a rank by one range partitioning and are cut into blocks of at most BLOCK turns, so that a conversation of
any length is aligned in parallel: a block that doesn't open its conversation is aligned from every state of the
grammar, one that doesn't close it to every state. Then one task a conversation chains the blocks (no audit of a
block is the beginning of another one with the same ends and cost, so least audits chain to the least audit) and streams
the texts past the edits in order, holding the audit but never the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanqa.llm.common import land, ranked

BLOCK = 64
SPACE = " \t\n\x0b\x0c\r"
#: Costs of the edits; an undeleted truncated turn adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the grammar: nothing yet, or the initial of the last turn; the end of the conversation.
START, END = "", "$"
STATES = (START, "s", "u", "a")
ROLES = {"u": "user", "a": "assistant"}
FAULTS = ("sound", "blank", "duplicate", "truncated")
_INF = 1 << 60


# ------------------------------------------------------------- alignment ---

def target(state: str, length: int, system: bool = False) -> str:
    """The grammar's string of a length after `state`, opened by a system turn or not."""
    if system:
        return "s" + target("s", length - 1)
    pair = "au" if state == "u" else "ua"
    return (pair * (length // 2 + 1))[:length]


def reaches(state: str, goal: str, exit_state: str) -> bool:
    """Whether a string that leads to `exit_state` serves the goal: that state, or an end of the grammar."""
    return exit_state in (START, "a") if goal == END else exit_state == goal


def greedy(syms: str, faults: str, state: str, goal: str) -> int:
    """Cost of a plain repair: faulty turns go, others get the role that is next, turns are added to reach the goal."""
    cost, at = 0, state
    for s, f in zip(syms, faults):
        if f in "12":
            cost += DELETE
            continue
        nxt = "a" if at == "u" else "u"
        if at == START and s == "s":
            nxt = "s"
        cost += (s != nxt) * REROLE + (f == "3") * TRUNCATED
        at = nxt
    for _ in range(3):
        if reaches(state, goal, at):
            return cost
        at = "a" if at == "u" else "u"
        cost += INSERT
    return _INF


def relaxed(n: int, required: int, truncated: int, length: int) -> tuple[int, int]:
    """(least cost by numbers alone, least insertions) of an alignment to `length` turns.

    One more pair of a deletion and an insertion costs 7 and saves at most the 5 of a truncated turn.
    """
    inserts = max(0, required - (n - length))
    deletes = n - length + inserts
    return DELETE * deletes + INSERT * inserts + TRUNCATED * max(0, truncated - (deletes - required)), inserts


def wagner_fischer(syms: str, faults: str, goal: str, most_inserts: int) -> list[tuple[int, list[int]]]:
    """Rows (first column, costs) of the matrix: cost of turns i.. against goal[j..], within the band.

    The band holds the cells of paths with at most `most_inserts` insertions.
    """
    n, m = len(syms), len(goal)
    most_deletes = most_inserts + n - m
    rows: list[tuple[int, list[int]]] = [(0, [])] * (n + 1)
    for i in range(n, -1, -1):
        lo, hi = max(0, i - most_deletes), min(m, i + most_inserts)
        row = [_INF] * (hi - lo + 1)
        if i < n:
            below_lo, below = rows[i + 1]
            sym, fault = syms[i], faults[i]
            extra = TRUNCATED if fault == "3" else 0
            free = fault not in "12"
        for j in range(hi, lo - 1, -1):
            best = _INF if i < n or j < m else 0
            if i < n:
                k = j - below_lo
                if 0 <= k < len(below):
                    best = below[k] + DELETE
                if free and j < m and 0 <= k + 1 < len(below):
                    g = goal[j]
                    step = 0 if sym == g else REROLE if g != "s" else _INF
                    best = min(best, below[k + 1] + step + extra)
            if j < hi and goal[j] != "s":
                best = min(best, row[j + 1 - lo] + INSERT)
            row[j - lo] = best
        rows[i] = (lo, row)
    return rows


def backtrace(syms: str, faults: str, goal: str, rows: list[tuple[int, list[int]]]) -> str:
    """The least audit of the cheapest alignments: D, I, K, R in this order where all are cheapest."""
    def cost(i: int, j: int) -> int:
        lo, row = rows[i]
        return row[j - lo] if 0 <= j - lo < len(row) else _INF

    i = j = 0
    out = []
    n, m = len(syms), len(goal)
    while i < n or j < m:
        c = cost(i, j)
        if i < n and cost(i + 1, j) + DELETE == c:
            out.append("D")
            i += 1
        elif j < m and goal[j] != "s" and cost(i, j + 1) + INSERT == c:
            out.append("I")
            j += 1
        else:
            out.append("K" if syms[i] == goal[j] else "R")
            i, j = i + 1, j + 1
    return "".join(out)


def align(syms: str, faults: str, state: str, goal: str) -> tuple[int, str] | None:
    """(cost, least audit) of the cheapest edits that lead from a state to a state or END; None if none do."""
    n = len(syms)
    required = sum(f in "12" for f in faults)
    truncated = faults.count("3")
    best, audit = greedy(syms, faults, state, goal), None
    lengths = []
    for system in ((False, True) if state == START and "s" in syms else (False,)):
        for length in range(int(system), n + 2 + (best < _INF) * (best // INSERT)):
            leads = "s" if system and length == 1 else state if not length else target(state, length, system)[-1]
            if reaches(state, goal, leads):
                bound, inserts = relaxed(n, required, truncated, length)
                lengths.append((bound, length, system, inserts))
    for bound, length, system, inserts in sorted(lengths):
        if bound > best:
            break
        slack = min(best - bound, 7 * (n + length))
        string = target(state, length, system)
        rows = wagner_fischer(syms, faults, string, inserts + slack // 2)
        lo, row = rows[0]
        cost = row[-lo] if lo <= 0 < lo + len(row) else _INF
        if cost >= _INF or cost > best:
            continue
        found = backtrace(syms, faults, string, rows)
        if audit is None or cost < best or found < audit:
            best, audit = cost, found
    return None if audit is None else (best, audit)


@lru_cache(maxsize=50_000)
def align_block(syms: str, faults: str, first: bool, last: bool) -> tuple[tuple[str, str, int, str], ...]:
    """(state before, state after or END, cost, audit) of a block of turns, for all states it can lie between."""
    out = []
    for state in (START,) if first else STATES:
        for goal in (END,) if last else STATES:
            hit = align(syms, faults, state, goal)
            if hit:
                out.append((state, goal, *hit))
    return tuple(out)


def chain(blocks: list[dict[str, dict[str, tuple[int, str]]]]) -> tuple[int, list[str]]:
    """(cost, audits) of the cheapest way through the blocks of a conversation, the least audit among them."""
    rest = [{END: 0}]
    for b in reversed(blocks):
        after = rest[-1]
        rest.append({s: min((c + after[x] for x, (c, _) in way.items() if x in after), default=_INF)
                     for s, way in b.items()})
    rest.reverse()
    state, audits = START, []
    for k, b in enumerate(blocks):
        total = rest[k][state]
        audit, state = min((a, x) for x, (c, a) in b[state].items() if x in rest[k + 1] and c + rest[k + 1][x] == total)
        audits.append(audit)
    return rest[0][START], audits


# ------------------------------------------------------------ conversations ---

def marked(turns: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, sym, fault, pos) for each turn, landed; pos is its rank in the order of all turns."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    last = F.substring(F.rtrim(text, F.lit(SPACE)), -1, 1)
    initial = F.substring(role, 1, 1)
    light = land(turns.select(
        conv_key(F.col("conv_id")).alias("conv"), "conv_id", F.col("turn").alias("turn"), role.alias("role"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("sym"),
        F.when(last == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3).alias("seen"),
        turn_key(F.col("conv_id"), role, text).alias("key")), "turns")
    rows = ranked(light, ["conv", "turn", "role", "key"], "pos")
    firsts = rows.groupBy("key").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    fault = F.when(F.col("seen") == 1, 1).when(F.col("pos") > F.col("first"), 2).otherwise(F.col("seen"))
    return land(rows.join(firsts, "key", "left").select("conv", "conv_id", "turn", "sym", fault.alias("fault"), "pos"),
                "turns-marked")


def conv_key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def turn_key(conv_id: Column, role: Column, text: Column) -> Column:
    """Digest that tells the turns of a conversation apart by role and text; orders turns of one number and role."""
    return F.sha2(F.concat_ws(":", conv_key(conv_id), F.octet_length(role).cast("string"), role, text), 256)


def blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv, block, syms, faults, first, last, illegal): stretches of at most `size` turns of one conversation."""
    b = rows.groupBy("conv", F.floor(F.col("pos") / size).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "sym", F.col("fault").cast("string").alias("fault")))).alias("t"))
    by = Window.partitionBy("conv").orderBy("block")
    b = b.select("conv", "block", F.array_join("t.sym", "").alias("syms"), F.array_join("t.fault", "").alias("faults"))
    b = b.withColumns({"before": F.lag(F.right("syms", F.lit(1))).over(by), "last": F.lead("block").over(by).isNull()})
    pairs = F.concat(F.coalesce("before", F.lit("")), "syms")
    legal = F.regexp_count(pairs, F.lit("(?=su|ua|au)"))
    return b.select("conv", "block", "syms", "faults", F.col("before").isNull().alias("first"), "last",
                    (F.length(pairs) - 1 - legal).cast("long").alias("illegal"))


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = b.to_pydict()
        ways = [[dict(zip(("state", "goal", "cost", "audit"), w)) for w in align_block(*x)]
                for x in zip(d["syms"], d["faults"], d["first"], d["last"])]
        yield pa.RecordBatch.from_arrays(
            [b.column("conv"), b.column("block"), b.column("illegal"), pa.array(ways, _WAYS_ARROW)],
            ["conv", "block", "illegal", "ways"])


_WAYS = "array<struct<state:string,goal:string,cost:long,audit:string>>"
_WAYS_ARROW = pa.list_(pa.struct([("state", pa.string()), ("goal", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))


def aligned(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv, block, illegal, ways): the alignments of every block, landed."""
    out = blocks(rows, size).mapInArrow(_aligned, f"conv string, block long, illegal long, ways {_WAYS}")
    return land(out, "turns-aligned")


class Conversation:
    """The edits of one conversation, applied to its turns as they come."""

    def __init__(self, conv: str):
        self.conv, self.ways, self.script = conv, [], None
        self.at, self.state, self.kept, self.digest = 0, START, 0, hashlib.sha256()

    def block(self, ways: list[dict]) -> None:
        table: dict[str, dict[str, tuple[int, str]]] = {}
        for w in ways:
            table.setdefault(w["state"], {})[w["goal"]] = (w["cost"], w["audit"])
        self.ways.append(table)

    def start(self) -> None:
        if self.script is None:
            self.cost, audits = chain(self.ways)
            self.script, self.ways = "".join(audits), []

    def put(self, role: str, text: str, edit: str) -> tuple:
        self.digest.update((("\n" if self.kept else "") + role + ":" + text).encode())
        self.kept += 1
        return self.conv, self.kept, role, text, edit

    def inserts(self) -> Iterator[tuple]:
        while self.at < len(self.script) and self.script[self.at] == "I":
            yield self.next_role("", "I")

    def next_role(self, text: str, edit: str) -> tuple:
        self.state = "a" if self.state == "u" else "u"
        self.at += 1
        return self.put(ROLES[self.state], text, edit)

    def turn(self, role: str, text: str) -> Iterator[tuple]:
        """The repaired turns up to this one."""
        self.start()
        yield from self.inserts()
        edit = self.script[self.at]
        if edit == "R":
            yield self.next_role(text, edit)
        else:
            self.at += 1
            if edit == "K":
                self.state = role[:1]
                yield self.put(role, text, edit)

    def end(self) -> Iterator[tuple]:
        self.start()
        yield from self.inserts()


def _stream(batches: Iterator[pa.RecordBatch], by_turn: bool) -> Iterator[list[tuple]]:
    """Lists of repaired turns, or of (conv, cost, audit, digest), from headers and turns sorted by conversation."""
    cur: Conversation | None = None

    def close() -> list[tuple]:
        if cur is None:
            return []
        rest = list(cur.end())
        return rest if by_turn else [(cur.conv, cur.cost, cur.script, cur.digest.hexdigest())]

    for b in batches:
        out: list[tuple] = []
        for conv, ways, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "ways", "role", "text"))):
            if cur is None or conv != cur.conv:
                out += close()
                cur = Conversation(conv)
            if ways is not None:
                cur.block(ways)
                continue
            for t in cur.turn(role, text):
                if by_turn:
                    out.append(t)
        yield out
    yield close()


def _edited(turns: DataFrame, ways: DataFrame, by_turn: bool) -> DataFrame:
    texts = turns.select(
        conv_key(F.col("conv_id")).alias("conv"), F.lit(None).cast("long").alias("block"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.lit(None).cast(_WAYS).alias("ways"), F.lit(1).alias("kind"))
    texts = texts.withColumn("key", F.sha2(F.concat_ws(
        ":", "conv", F.octet_length("role").cast("string"), "role", "text"), 256))
    heads = ways.select(
        "conv", "block", F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), "ways", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("key"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (heads.unionByName(texts).repartition(n, "conv")
            .sortWithinPartitions("conv", "kind", "block", "turn", "role", "key"))
    if by_turn:
        fields = [("conv", pa.string()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]
        schema = "conv string, position long, role string, text string, edit string"
    else:
        fields = [("conv", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
        schema = "conv string, cost long, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _stream(batches, by_turn):
            columns = list(zip(*out)) if out else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)],
                                             [name for name, _ in fields])

    return rows.select("conv", "ways", "role", "text").mapInArrow(run, schema)


def audits(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.

    turns: conv_id, turn, role, text; other columns don't matter. A null role or text counts as one space; null
    conv_ids are one conversation; turns are ordered by number (null first), then role, then a digest of the text, so
    equal rows are interchangeable. Repeated rows are duplicates. Initials are compared as they are: an empty or
    unknown role fits nowhere and gets another one or goes. gaps is null where it is no long. No rows: no result.
    """
    rows = marked(turns)
    ways = aligned(rows, block)
    wide = "decimal(38,0)"
    span = F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.countDistinct("turn")

    def count(fault: int) -> Column:
        return F.count(F.when(F.col("fault") == fault, 1)).alias(FAULTS[fault])

    facts = rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), count(1), count(2), count(3),
                                     F.coalesce(span, F.lit(0).cast(wide)).try_cast("long").alias("gaps"))
    pairs = ways.groupBy("conv").agg(F.sum("illegal").alias("illegal"))
    return (facts.join(pairs, "conv").join(_edited(turns, ways, False), "conv")
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired conversations: conv_id, position (from 1), role, text, edit (K, R or I); turns as in `audits`."""
    rows = marked(turns)
    out = _edited(turns, aligned(rows, block), True)
    ids = rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    return out.join(ids, "conv").select("conv_id", "position", "role", "text", "edit")


def damage(turns: DataFrame) -> DataFrame:
    """Conversations damaged by a hash of conversation and turn: turns dropped, emptied, without stops, repeated, reroled."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    h = F.col("_h")
    return (turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("_h"))
            .where("_h != 0")
            .select("conv_id", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(h == 1, "").when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
            .drop("_copy"))
