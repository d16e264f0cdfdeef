"""Encoding and decoding with a SentencePiece BPE model through a table of distinct chunks.

With spaces written as markers, a chunk is a run of markers and the characters up to the next marker or line end. No
piece of the model holds a marker or a line end after another character, so no merge crosses the border of a chunk and
the ids of a text are those of its chunks in order.

Spark counts the chunks of all texts and segments the most common ones (FREQUENT at most), each once; that table has a fixed
bound and goes to all tasks. A task walks its texts chunk by chunk and joins the ids back by position; a chunk that is
not in the table is segmented when the task first meets it. (Sending the ids of the rare ones back as a join would move
every text once and every rare pair of text and chunk twice.) Texts are never shuffled and are worked through in
blocks of BLOCK_CHARS characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from spanqa.llm.common import land

MARK = "▁"
CHUNK = f"{MARK}*[^{MARK}\n]+|{MARK}+|\n"
FREQUENT = 200_000
#: Rare chunks that a task remembers before it forgets them all.
REMEMBERED = 200_000
BLOCK_CHARS = 2_000_000


@dataclass(frozen=True)
class Model:
    """A model file's content, which travels with the tasks."""

    proto: bytes

    @staticmethod
    def read(path: str) -> Model:
        with open(path, "rb") as f:
            model = Model(f.read())
        model.check()
        return model

    def load(self):
        import sentencepiece
        return sentencepiece.SentencePieceProcessor(model_proto=self.proto)

    def check(self) -> None:
        """Raises if texts can't be cut into chunks: see the module's text."""
        m = self.load()
        held = [p for i in range(m.get_piece_size())
                if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)) for p in [m.id_to_piece(i)]]
        if any(MARK in p.lstrip(MARK) or ("\n" in p and p != "\n") for p in held):
            raise ValueError("a piece crosses a marker or a line end")
        if m.normalize(" ﬁ  Ａ ") != f"{MARK}{MARK}ﬁ{MARK}{MARK}Ａ{MARK}":
            raise ValueError("the model changes texts before it cuts them into pieces")


class Segments(dict):
    """chunk -> ids as 32-bit integers, segmented on first use."""

    def __init__(self, m, known: dict[str, bytes]):
        super().__init__(known)
        self.m, self.known = m, known

    def __missing__(self, chunk: str) -> bytes:
        # the line ends keep the chunk apart from what the library would add or drop at the ends
        if chunk[0] == MARK:
            ids = self.m.encode(chunk[1:] + "\n")[:-1]
        else:
            ids = self.m.encode("\n" + chunk + "\n")[2:-1]
        self[chunk] = out = np.array(ids, dtype=np.int32).tobytes()
        return out

    def forget(self) -> None:
        if len(self) > len(self.known) + REMEMBERED:
            self.clear()
            self.update(self.known)


def surfaces(m) -> list[bytes]:
    """The bytes that each id stands for."""
    out = []
    for i in range(m.get_piece_size()):
        if m.is_byte(i):
            out.append(bytes([int(m.id_to_piece(i)[3:5], 16)]))
        else:
            out.append(m.decode([m.encode("\n")[1], i])[1:].encode())
    return out


def decode_ids(ids: list[int], surface: list[bytes], marked: set[int]) -> str:
    """Text of ids; the first piece loses the marker that encoding put in front of the text."""
    text = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if ids and ids[0] in marked else text


def chunks(text: Column) -> Column:
    """The chunks of a text in order; none for an empty or null text."""
    marked = F.concat(F.lit(MARK), F.translate(text, " ", MARK))
    return F.when(F.length(text) > 0, F.regexp_extract_all(marked, F.lit(CHUNK), F.lit(0))).otherwise(
        F.array().cast("array<string>"))


def chunk_table(docs: DataFrame, model: Model, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(chunk, ids) of the most common chunks, each segmented once; ids as 32-bit integers, packed.

    At most `frequent` chunks that occur more than once; those of one count are in it together or not at all.
    """
    counts = land(docs.select(F.explode(chunks(F.col(text))).alias("chunk")).groupBy("chunk").agg(
        F.count("*").alias("n")).where("n > 1"), "chunk-counts")
    # the least count such that no more than `frequent` chunks reach it; one row a count, not one a chunk
    above = Window.orderBy(F.desc("n"))
    least = (counts.groupBy("n").agg(F.count("*").alias("m")).withColumn("reached", F.sum("m").over(above))
             .where(F.col("reached") <= frequent).agg(F.min("n")).first()[0])
    top = counts.where(F.col("n") >= least if least else F.lit(False)).select("chunk")

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.load()
        for b in batches:
            seg = Segments(m, {})
            cs = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([seg[c] for c in cs], pa.binary())], ["chunk", "ids"])

    return top.mapInArrow(segment, "chunk string, ids binary")


def encode(docs: DataFrame, model: Model, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """`docs` plus ids (array<int>, the end id last) and decoded (the text that the ids stand for).

    Every row and every character counts. A null text counts as empty; an empty text has the end id alone and decodes
    to the empty text. Equal texts get equal ids. Other columns pass through, but for columns named ids or decoded,
    which are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    table = {r.chunk: bytes(r.ids) for r in chunk_table(docs, model, text, frequent).collect()}
    known = spark.sparkContext.broadcast(table)
    rows = docs.drop(*[c for c in docs.columns if c.lower() in ("ids", "decoded") and c != text])
    added = [StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]
    kept = [f for f in rows.schema.fields if f.name.lower() not in ("ids", "decoded")]
    schema = StructType(kept + added)
    at = rows.columns.index(text)
    keep = [rows.columns.index(f.name) for f in kept]
    find = re.compile(CHUNK).findall

    def block(seg: Segments, surface, marked, eos: int, texts: list[str]):
        ids, ends, decoded = [], [0], []
        for t in texts:
            one = b"".join(map(seg.__getitem__, find(MARK + t.replace(" ", MARK)))) if t else b""
            one = np.append(np.frombuffer(one, dtype=np.int32), np.int32(eos))
            ids.append(one)
            ends.append(ends[-1] + len(one))
            decoded.append(decode_ids(one.tolist(), surface, marked))
        return (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids))),
                pa.array(decoded, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.load()
        surface, seg = surfaces(m), Segments(m, known.value)
        marked = {i for i in range(m.get_piece_size()) if m.id_to_piece(i).startswith(MARK)}
        for b in batches:
            if not b.num_rows:
                continue
            lengths = np.array([len(t or "") for t in b.column(at).to_pylist()])
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(lengths) // BLOCK_CHARS)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                part = b.slice(lo, hi - lo)
                cols = block(seg, surface, marked, m.eos_id(), [t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + list(cols),
                                                 [b.schema.names[c] for c in keep] + ["ids", "decoded"])
                seg.forget()

    return rows.mapInArrow(run, schema)
