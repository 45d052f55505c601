"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A document of any length contains an item when it holds at least ``threshold`` of the item's distinct word shingles.
Every shingle has one hash; an item's sketch is its k smallest hashes (bottom-k MinHash). Items are partitioned by size,
powers of two of their shingle counts, and k follows from the size: with n shingles, k = n - ceil(threshold * n) + 1.
A document that contains the item lacks fewer than k of its shingles, so at least one of the k smallest occurs in the
document: the search loses nothing, however long the document is. Size classes above a document's own size are skipped.
Candidates are verified on the words themselves, not on hashes.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. Items with fewer words than the shingle
width are one shingle, sought as a run of words. Null or wordless items or texts match nothing; a null id is passed on;
repeated rows give repeated results on the document side and one on the item side (items are distinct by id and text).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lots, shingle_hashes, word_hashes

MOST_ITEM_BYTES = 32_000_000  #: items beyond this size are searched in several passes over the documents

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c if c >= 128 or c in _WORD else (c + 32 if 65 <= c <= 90 else 32) for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def shingles(words: list[bytes], width: int) -> set[bytes]:
    """Distinct runs of ``width`` words, or the whole of a shorter sequence."""
    n = min(width, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Sketches:
    """Bottom-k sketches of items by width of their shingles and by size class."""

    def __init__(self, items: list[tuple], width: int, threshold: float):
        self.items, by = [], defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            own = shingles(words, width)
            if own:
                used = min(width, len(words))
                need = math.ceil(threshold * len(own) - 1e-9)
                low = np.sort(np.unique(shingle_hashes(word_hashes(words), used)))[: len(own) - need + 1]
                by[used, int(math.log2(len(own)))] += [(int(h), len(self.items)) for h in low]
                self.items.append((item_id, own, used, need))
        # of each width and size class: sorted hashes, the items of each, and a filter of the hashes' top bits
        self.classes = []
        for (used, size), found in sorted(by.items()):
            owner = defaultdict(list)
            for h, k in found:
                owner[h].append(k)
            keys = np.array(sorted(owner), np.uint64)
            mask = np.zeros(1 << 18, bool)
            mask[keys >> np.uint64(46)] = True
            least = min(need for _, own, w, need in self.items if w == used and int(math.log2(len(own))) == size)
            self.classes.append((used, least, keys, [owner[int(h)] for h in keys], mask))

    def candidates(self, words: list[bytes]) -> set[int]:
        found: set[int] = set()
        of, made = word_hashes(words), {}
        for used, least, keys, owner, mask in self.classes:
            if len(words) - used + 1 >= least:
                if used not in made:
                    made[used] = shingle_hashes(of, used)
                h = made[used]
                h = np.unique(h[mask[h >> np.uint64(46)]])
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                for k in at[keys[at] == h]:
                    found.update(owner[k])
        return found

    def contained(self, words: list[bytes]) -> list[tuple]:
        """(item id, shared shingles, item's shingles) of the items that the words contain."""
        out, made = [], {}
        for k in sorted(self.candidates(words)):
            item_id, own, used, need = self.items[k]
            if used not in made:
                made[used] = shingles(words, used)
            if (common := len(own & made[used])) >= need:
                out.append((item_id, common, len(own)))
        return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs (id, item id, n_common, n_item) with n_common >= threshold * n_item, over whole texts.

    Items are sent to every task, in passes of at most ``MOST_ITEM_BYTES``: that many bytes of text and no more are
    held at once; a larger set of items takes more passes over the documents and no more memory.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {item_col} {items.schema[item_col].dataType.simpleString()}, n_common long, n_item long"
    source, out = docs.select(id_col, text_col), None
    for shared in _passes(items, item_col, item_text):
        found = source.mapInArrow(_search(shared, width, threshold, schema, id_col, item_col), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _passes(items: DataFrame, item_col: str, item_text: str) -> Iterator:
    """The distinct items, broadcast in passes."""
    # passes are doubled until none holds more, but for a single item of that size
    items = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).distinct().withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    deal = lambda n: F.pmod(F.xxhash64("item", "text"), F.lit(n))
    total = items.agg(F.sum("size")).first()[0] or 0
    passes = 1
    while passes * MOST_ITEM_BYTES < total or passes > 1 and items.groupBy(deal(passes)).agg(F.sum("size").alias("size"), F.count("*").alias("n")).where(f"size > {MOST_ITEM_BYTES} and n > 1").limit(1).count():
        passes *= 2
    for k in range(passes):
        part = [(r.item, r.text) for r in items.where(deal(passes) == k).collect()]
        yield items.sparkSession.sparkContext.broadcast(part)


def _search(shared, width: int, threshold: float, schema: str, id_col: str, item_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = Sketches(shared.value, width, threshold)
        for batch in lots(batches):
            rows = [(i, *x) for i, text in enumerate(batch.column(1).to_pylist()) for x in (sketches.contained(words_of(text)) if sketches.items else ())]
            if rows:
                at, item, common, size = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(item), pa.array(common, pa.int64()), pa.array(size, pa.int64())], names=[id_col, item_col, "n_common", "n_item"])

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without those that contain a benchmark item. All columns stay. Each row is decided by its own text, whatever its id."""
    for shared in _passes(items, "item_id", "text"):
        docs = docs.mapInArrow(_rest(shared, width, threshold, docs.columns.index(text_col)), docs.schema)
    return docs


def _rest(shared, width: int, threshold: float, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = Sketches(shared.value, width, threshold)
        for batch in lots(batches):
            clean = [not (sketches.items and sketches.contained(words_of(text))) for text in batch.column(column).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run
