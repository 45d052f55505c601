"""Best-fit packing of token pieces into sequences: minimum bin slack over a histogram of lengths.

A document is its ids and then one end id. Only documents longer than a sequence are cut, into pieces of a whole sequence
and a rest. What matters of a piece is its length, so the packing problem is a histogram of at most ``size`` lengths,
however many pieces there are. Bins are filled one after the other: the longest piece that is left opens a bin, a bitset
subset-sum over the available lengths and their counts finds the fullest combination that fits beside it, and the combination
is removed. As long as the lengths last, the same search would give the same bin, so a bin is repeated at once until one of
its lengths runs out: the plan has a few thousand kinds of bins and is made on the driver from the histogram alone.

Pieces are numbered within their lengths where they are made, by counters of the task and by counts of tasks before it; a
number then tells the bin and the place in it. No piece is shuffled with its text, and no length is gathered anywhere.

Texts are encoded by the tokenizers library. Its normalizer and pre-tokenizer never join across a space, so texts are cut
there, in chunks, and a worker keeps what it has encoded of words and of their parts, up to ``CACHE`` of each. Null and empty texts are the end id
alone. Null and repeated ids are rows like others; equal texts are packed each. An empty table has no piece. Other columns are
not read.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_characters
from tidemark.llm.common import Scratch, lots, vocabulary

SIZE = 2048
CACHE, KEPT = 250_000, 40  #: words, and parts of words, that a worker keeps, of at most so many characters
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  #: of the pre-tokenizer (fixed value)
#: Texts of Latin characters that no normal form changes, and the same pattern for them in lower case.
LATIN = re.compile(r"[\x09-\x0D\x20-\x7E\xA1-\u017F]*")
LETTERS, NUMBERS = r"a-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\u017F", r"0-9\xB2\xB3\xB9\xBC-\xBE"
PARTS = re.compile(rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
BYTES = {b: c for b, c in enumerate(byte_characters())}
CHUNK = 1 << 20  #: characters that are cut into words at a time
RANKS = 1 << 44  #: more than there are pieces of one length


def known(spec: dict) -> bool:
    """Whether a tokenizer file normalizes and cuts words in the way that is followed here."""
    steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get("pattern") == {"Regex": PATTERN} and not any(t["normalized"] for t in spec["added_tokens"])


class Kept(dict):
    """A dictionary that makes what it lacks, and starts anew when it holds ``CACHE`` entries."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        made = self.make(key)
        if len(key) <= KEPT:
            self[key] = made
        return made


def packed_ids(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class Words:
    """Ids of texts as little-endian 32-bit numbers, word by word.

    Latin texts are in normal form as they are: they are lower-cased and cut by the pre-tokenizer's pattern, and only the parts
    go to the library's model. Texts with other characters are cut at spaces, and so are their Latin words; other words go
    through the library's whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.words, self.parts = Kept(self.word), Kept(self.part)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        with open(path, encoding="utf-8") as f:
            self.plain = known(json.load(f))

    def part(self, part: str) -> bytes:
        """A pre-token in lower case; the model knows bytes by printable characters."""
        named = part if part.isascii() else part.encode().decode("latin-1").translate(BYTES)
        return packed_ids([t.id for t in self.model.tokenize(named)])

    def latin(self, text: str) -> bool:
        return self.plain and LATIN.fullmatch(text) is not None and not self.special.search(text)

    def word(self, word: str) -> bytes:
        if self.latin(word):
            return b"".join(map(self.parts.__getitem__, PARTS.findall(word.lower())))
        return packed_ids(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def text(self, text: str | None) -> Iterator[bytes]:
        """The ids of a text, chunk by chunk; a chunk ends before a space."""
        start, text = 0, text or ""
        while start < len(text):
            end = text.find(" ", start + CHUNK)
            end = len(text) if end < 0 else end
            chunk = text[start:end]
            if self.latin(chunk):
                yield b"".join(map(self.parts.__getitem__, PARTS.findall(chunk.lower())))
            else:
                yield b"".join(map(self.words.__getitem__, chunk.replace("\n", " ").split(" ")))
            start = end


@lru_cache(maxsize=2)
def load(path: str) -> Words:
    return Words(vocabulary(path))


def cut(chunks: Iterator[bytes], size: int, end: int) -> Iterator[bytes]:
    """The ids with the end id, in pieces of ``size`` ids; the last may be shorter."""
    rest = b""
    for chunk in chunks:
        rest += chunk
        if len(rest) > 4 * size:
            whole = (len(rest) - 1) // (4 * size) * 4 * size  # at least one id stays
            for i in range(0, whole, 4 * size):
                yield rest[i : i + 4 * size]
            rest = rest[whole:]
    rest += end.to_bytes(4, "little")
    for i in range(0, len(rest), 4 * size):
        yield rest[i : i + 4 * size]


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, nth, part), with ``with_ids`` also ids: every piece of every document.

    ``nth`` numbers the pieces of one length within ``part``, the task that made them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32", "nth", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = load(path), [0] * (size + 1)
        for batch in lots(batches):
            out: list[list] = [[] for _ in range(6)]
            rows, ids = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                start = 0
                for k, piece in enumerate(cut(words.text(text), size, end)):
                    n = len(piece) // 4
                    rows.append(row)
                    for column, value in zip(out, (k, start, n, zlib.crc32(piece), seen[n]), strict=False):
                        column.append(value)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                    seen[n] += 1
                    start += n
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *[pa.array(c, pa.int64()) for c in out[1:5]]]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=names)

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, nth long{', ids array<int>' * with_ids}"
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, schema).withColumn("part", F.spark_partition_id())


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """Of the available pieces (``lengths``, falling) a combination that fills ``room`` best, longer ones first."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        left, unit = min(counts[length], room // length), 1
        while left:  # one bit shift for 1, 2, 4, ... pieces of a length
            unit = min(unit, left)
            steps.append((length, unit, reach))
            reach |= (reach << unit * length) & mask
            left, unit = left - unit, unit * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, unit, before in reversed(steps):
        if not before >> at & 1:
            at -= unit * length
            used[length] = used.get(length, 0) + unit
    return used


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, pieces of it)]): kinds of bins that use up all pieces."""
    counts = {k: n for k, n in counts.items() if n}
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        bin_ = fullest(counts, lengths, size - top)
        counts[top] += 1
        bin_[top] = bin_.get(top, 0) + 1
        times = min(counts[k] // n for k, n in bin_.items())
        for k, n in bin_.items():
            counts[k] -= times * n
        lengths = [k for k in lengths if counts[k]]
        out.append((times, sorted(bin_.items(), reverse=True)))
    return out


class Places:
    """Where a plan puts the pieces of each length by their numbers."""

    def __init__(self, bins: list[tuple[int, list[tuple[int, int]]]]):
        rows, used, first = [], {}, 0
        for times, lengths in bins:
            offset = 0
            for length, n in lengths:
                rows.append((length * RANKS + used.get(length, 0), n, first, offset))
                used[length] = used.get(length, 0) + times * n
                offset += n * length
            first += times
        self.key, self.n, self.first, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 4).T
        self.bins = first

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        key = length * RANKS + rank
        at = np.searchsorted(self.key, key, "right") - 1
        copy, slot = np.divmod(key - self.key[at], self.n[at])
        return self.first[at] + copy, self.offset[at] + slot * length


def placed(scratch: Scratch, made: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces (length, nth, part and others) with sequence_id and offset in place of nth and part."""
    made = scratch.table(made, "pieces")
    counts = scratch.table(made.groupBy("length", "part").agg(F.count("*").alias("k")), "counts")
    histogram = {r.length: r.k for r in counts.groupBy("length").agg(F.sum("k").alias("k")).collect()}  # at most ``size`` rows
    places = Places(plan(histogram, size))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("before"))
    # as many rows before as tasks have lengths, so they are not broadcast
    ranked = made.join(before.hint("merge"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "part")
    kept = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(ranked_names.index(c)) for c in kept]
            found = places.of(batch.column(ranked_names.index("length")).to_numpy(), batch.column(ranked_names.index("rank")).to_numpy())
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, found)], names=[*kept, "sequence_id", "offset"])

    ranked_names, schema = list(ranked.columns), ranked.select(*kept).schema
    return ranked.mapInArrow(run, schema.add("sequence_id", "long").add("offset", "long"))


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset; with ``with_ids`` also ids."""
    made = pieces(docs, path, size, end, id_col, text_col, with_ids)
    out = placed(Scratch(docs.sparkSession, "packing"), made, size)
    names = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return out.select(F.col("id").alias(id_col), *names)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, spans): the packed sequences of ``pack(..., with_ids=True)``, each of at most one bin's ids."""
    spans = F.sort_array(F.collect_list(F.struct("offset", "length", F.col(id_col).alias("id"), "piece", "ids")))
    rows = packed.groupBy("sequence_id").agg(spans.alias("spans"))
    return rows.select("sequence_id", F.flatten(F.col("spans.ids")).alias("ids"), F.transform("spans", lambda s: F.struct(s["id"].alias(id_col), s["piece"].alias("piece"), s["offset"].alias("offset"), s["length"].alias("length"))).alias("spans"))
