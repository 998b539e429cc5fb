"""Best-fit packing planned over a length histogram."""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from threadloom.llm.common import case_safe, grouped_index, materialize, sliced, table

#: Tokens a sequence holds, and the id that ends each document.
CAPACITY, END = 4096, 1
#: Chunks whose ids a worker keeps at most; the length up to which they outlast a clean-up.
MEMO, FREQUENT = 300_000, 6

#: str.split() takes these for white space; tokenizers do not.
SEPARATORS, CONTROL = re.compile("[\x1c-\x1f]"), re.compile("[ \t\n\r\x0b\x0c]+")

#: Marks that often end a chunk, all of them of one kind to the default tokenizer.
MARKS = ".,;:!?#$%&*|()\"-"
#: The default tokenizer's words, and the letters in which its model writes bytes that do not print.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
#: Texts that normalization leaves alone, but for their case (of one letter, case is two letters).
LATIN = re.compile("[\x00-\u012f\u0131-\u024f]*").fullmatch
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class LatinChunks(dict):
    """Ids of chunks of lower-case Latin text, and of the words in them, straight from the tokenizer's model.

    Such text passes the normalizer unchanged. A word is a chunk of its own, so one memo serves both. A full memo
    forgets long keys; short ones, the frequent ones, stay if they leave half of it free."""

    def __init__(self, model):
        super().__init__()
        self.tokenize = model.tokenize

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.rstrip(MARKS)
        if core is chunk and chunk.isalpha():
            return self.word(chunk)
        if core.isalpha():  # a run of marks is one word
            tail = chunk[len(core) :]
            ids = (self.get(core) or self.word(core)) + (self.get(tail) or self.word(tail))
        else:
            words = WORDS(chunk)
            if words == [chunk]:
                return self.word(chunk)
            ids = b"".join([self.get(w) or self.word(w) for w in words])
        self[chunk] = ids
        return ids

    def word(self, word: str) -> bytes:
        seen = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(BYTES)
        if len(self) >= MEMO:
            short = {k: v for k, v in self.items() if len(k) <= FREQUENT}
            self.clear()
            if 2 * len(short) <= MEMO:
                self.update(short)
        ids = self[word] = array("I", [t.id for t in self.tokenize(seen)]).tobytes()
        return ids


class ChunkEncoder:
    """Encodes texts chunk by chunk (runs without white space), remembering chunks.

    Exact for tokenizers that drop white space and never join across it, as the default one does. Texts of Latin
    letters take a short way past the normalizer, which only lowers them; any others go through the tokenizer."""

    def __init__(self, path: str | None):
        self.tokenizer = Tokenizer.from_file(path or default_tokenizer())
        self.latin = LatinChunks(self.tokenizer.model) if path is None or self._same_steps(path) else None

    @staticmethod
    def _same_steps(path: str) -> bool:
        """Whether a tokenizer's steps are those of the default one."""
        steps = []
        for p in (path, default_tokenizer()):
            with open(p, encoding="utf-8") as f:
                spec = json.load(f)
            steps.append((spec["normalizer"], spec["pre_tokenizer"], spec["model"]["end_of_word_suffix"]))
        return steps[0] == steps[1]

    def encode(self, text: str) -> bytes:
        """The little-endian unsigned 32-bit ids of a text."""
        if self.latin is None or "<|" in text:
            return self.whole(text)
        odd = SEPARATORS.search(text)
        if text.isascii() or LATIN(text):
            low = text.lower()
            return b"".join(map(self.latin.__getitem__, CONTROL.split(low) if odd else low.split()))
        chunks = CONTROL.split(text) if odd else text.split()
        return b"".join([self.latin[c.lower()] if c.isascii() or LATIN(c) else self.whole(c) for c in chunks])

    def whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Cut the token ids of `docs` (doc_id, text) into pieces of at most `capacity`: doc_id, piece, start, length, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = ChunkEncoder(tokenizer).encode, np.array([END], "<u4").tobytes()
        for b in sliced(batches):
            out: list[list] = [[], [], [], [], []]
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for doc_id, text in zip(ids, texts, strict=True):
                data = encode(text) + end
                for piece, start in enumerate(range(0, len(data) // 4, capacity)):
                    part = data[4 * start : 4 * (start + capacity)]
                    for column, value in zip(out, (doc_id, piece, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram {length: pieces}; rows (length, first rank, slots, per bin, first bin, offset).

    Bins of one content form a group. The pieces of a length, longest first, go to the groups with the least room
    that still holds them; as many as fill a group's bins split it, and new bins take as many pieces as fit. Slots of
    a row are those of consecutive ranks: `per bin` in each of the bins from `first bin`, from `offset`. The work
    depends on the number of lengths, not of pieces."""
    rooms: list[int] = []  # sorted rooms that have groups
    groups: dict[int, list[list]] = {}  # room -> groups [bins, content]; content: [(length, copies), ...]
    done: list[list] = []

    def put(room: int, bins: int, content: list) -> None:
        if room == 0:
            done.append([bins, content])
            return
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append([bins, content])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                break
            room = rooms[i]
            copies = room // length  # a piece leaves a smaller room, into which the next of its length goes first
            group = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[i]
            bins, content = group
            full = min(bins, left // copies)
            if full:
                put(room - copies * length, full, [*content, (length, copies)])
                left -= full * copies
            rest = bins - full
            if rest and left and left < copies:
                put(room - left * length, 1, [*content, (length, left)])
                left, rest = 0, rest - 1
            if rest:
                put(room, rest, content)
        if left:
            copies = capacity // length
            if left // copies:
                put(capacity - copies * length, left // copies, [(length, copies)])
            if left % copies:
                put(capacity - left % copies * length, 1, [(length, left % copies)])
    rows, first_bin, rank = [], 0, dict.fromkeys(counts, 0)
    for bins, content in [*done, *(g for room in rooms for g in groups[room])]:
        offset = 0
        for length, copies in content:
            rows.append((length, rank[length], bins * copies, copies, first_bin, offset))
            rank[length] += bins * copies
            offset += copies * length
        first_bin += bins
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to `pieces` (doc_id, piece, start, length, ids_crc32; cheap to read again).

    Only the histogram (at most `capacity` numbers) reaches the driver; pieces take planned slots by joining on their
    rank within their length."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, capacity) or [], "length long, first long, slots long, copies long, bin long, base long")
    # one row a length: its slots' first ranks in order, to be searched
    lookup = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "copies", "bin", "base"))).alias("runs"))
    spread = pieces.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(256)).cast("int"))
    ranked = grouped_index(spread, ["length"], "b", ["doc_id", "piece", "ids_crc32"], "rank")
    found = ranked.join(F.broadcast(lookup), "length").withColumn("run", F.element_at(F.filter("runs", lambda x: x["first"] <= F.col("rank")), -1))  # bounded: the plan of at most `capacity` lengths
    nth = F.col("rank") - F.col("run.first")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.bin") + F.floor(nth / F.col("run.copies"))).cast("long").alias("sequence_id"),
        (F.col("run.base") + F.pmod(nth, F.col("run.copies")) * F.col("length")).cast("long").alias("offset"),
    )


@case_safe()
def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pack `docs` (doc_id, text) into sequences of at most `capacity` tokens: one row a piece.

    A null text is empty and yields its end token; longer documents than `capacity` are cut, others stay whole;
    repeated rows are packed each; an empty table gives no rows; other columns are ignored."""
    return pack(materialize(tokenized_pieces(docs, capacity, tokenizer), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
