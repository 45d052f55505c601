"""Byte-level BPE encoding and decoding; merges are found by a segment tree over the ranks of adjacent pairs.

Each pre-token is a row of symbols, one a byte at first. The leaves of the tree hold the rank of each symbol's pair with
its right neighbour, joined with its position, and each inner node the smaller of its two children; so the root yields
the leftmost pair of the lowest rank. A merge changes three leaves, and each of them takes a logarithmic walk to the
root. It ends when no pair can be merged. A pre-token of n bytes takes O(n log n), however long it is. Short pre-tokens
are merged side by side, each with a tree of its own in the lines of shared arrays.

Texts are first cut before each space: no pre-token crosses such a place, unless the space stands between white space;
texts with that are cut by the pattern alone. A task keeps what it has encoded of short pieces, up to ``CACHE`` of them, starts
anew then, and keeps nothing when it ends.

Null texts count as empty. Special tokens in a text become their own ids, as in the library. Equal rows are encoded each.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tidemark.llm.common import lots, vocabulary

CACHE = 100_000  #: pieces that a task keeps at most, of at most ``KEPT`` characters each
KEPT = 64
SHORT = 64  #: bytes of pre-tokens that are merged side by side
#: The split pattern of the byte-level pre-tokenizer (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = 1 << 62


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairTree:
    """Least value over a row of leaves, with updates of single leaves."""

    def __init__(self, leaves: list[int]):
        size = 1
        while size < len(leaves):
            size *= 2
        self.size = size
        self.least = least = [_NONE] * size + leaves + [_NONE] * (size - len(leaves))
        for k in range(size - 1, 0, -1):
            a, b = least[2 * k], least[2 * k + 1]
            least[k] = a if a < b else b

    def root(self) -> int:
        return self.least[1]

    def put(self, i: int, value: int) -> None:
        least, k = self.least, i + self.size
        least[k] = value
        while k > 1:
            other = least[k ^ 1]
            value = value if value < other else other
            k >>= 1
            if least[k] == value:
                return
            least[k] = value


class PairTrees:
    """The same tree for many short rows at once: level by level one array, a line for each row."""

    def __init__(self, leaves: np.ndarray):
        self.levels = [leaves]
        while self.levels[-1].shape[1] > 1:
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:, ::2], low[:, 1::2]))

    def root(self, rows: np.ndarray) -> np.ndarray:
        return self.levels[-1][rows, 0]

    def put(self, rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        """New leaves, at most one for each row."""
        self.levels[0][rows, at] = values
        for low, high in zip(self.levels, self.levels[1:], strict=False):
            at = at >> 1
            high[rows, at] = np.minimum(low[rows, 2 * at], low[rows, 2 * at + 1])


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, of = spec["model"]["vocab"], {c: b for b, c in enumerate(byte_characters())}
        self.bytes_of = {i: bytes(of[c] for c in token) for token, i in vocab.items()}
        self.byte_ids = [vocab[c] for c in byte_characters()]
        self.pairs = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a] << 32 | vocab[b]] = rank, vocab[a + b]
        # the same as arrays: sorted pairs with their ranks, and the merged id of each rank
        keys = np.array(list(self.pairs), np.int64)
        ranks = np.array([r for r, _ in self.pairs.values()], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]
        self.made = np.zeros(len(keys), np.int64)
        self.made[ranks] = [i for _, i in self.pairs.values()]
        self.first = np.array(self.byte_ids, np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.name = {i: str(i) for i in self.bytes_of}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.open = regex.compile(r"\s \s")  # where a space is inside a run of white space, pieces are no safe cut
        self.cache: dict[str, tuple[int, str, bytes]] = {}

    def _leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        k = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[k] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[k] * SHORT + at, _NONE)

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of many pre-tokens; those of up to ``SHORT`` bytes are merged side by side."""
        out: list = [None] * len(pieces)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            n = len(p)
            if n > SHORT:
                out[i] = self.merge(p)
            elif n == 1:
                out[i] = [self.byte_ids[p[0]]]
            else:
                by.setdefault((n - 2).bit_length(), []).append(i)
        for bits, every in by.items():
            width = (1 << bits) + 1
            for k in range(0, len(every), 8192):
                some = every[k : k + 8192]
                for i, ids in zip(some, self._merged([pieces[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def _merged(self, pieces: list[bytes], width: int) -> list[list[int]]:
        n, size = len(pieces), np.array([len(p) for p in pieces])
        ids = np.full((n, width + 1), -1, np.int64)
        inside = np.arange(width + 1) < size[:, None]
        ids[inside] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, width + 2), ids.shape).copy()
        before = np.broadcast_to(np.arange(-1, width), ids.shape).copy()
        at = np.broadcast_to(np.arange(width - 1), (n, width - 1))
        tree = PairTrees(self._leaves(ids[:, : width - 1], ids[:, 1:width], at))
        rows = np.arange(n)
        while True:
            root = tree.root(rows)
            going = root != _NONE
            rows, root = rows[going], root[going]
            if not len(rows):
                break
            i, new = root % SHORT, self.made[root // SHORT]
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i], ids[rows, j], after[rows, i], before[rows, k] = new, -1, k, i
            gone = j < width - 1
            tree.put(rows[gone], j[gone], np.full(gone.sum(), _NONE))
            tree.put(rows, i, np.where(k < size[rows], self._leaves(new, ids[rows, k], i), _NONE))
            h = before[rows, i]
            left = h >= 0
            tree.put(rows[left], h[left], self._leaves(ids[rows[left], h[left]], new[left], h[left]))
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        if n == 1:
            return ids
        pairs, after, before = self.pairs, list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(i: int, j: int) -> int:
            found = pairs.get(ids[i] << 32 | ids[j])
            return found[0] << 32 | i if found else _NONE

        tree = PairTree([leaf(i, i + 1) for i in range(n - 1)])
        while (best := tree.root()) != _NONE:
            i = best & 0xFFFFFFFF
            j = after[i]
            ids[i] = pairs[ids[i] << 32 | ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, _NONE)
            if k < n:
                before[k] = i
                tree.put(i, leaf(i, k))
            else:
                tree.put(i, _NONE)
            if (h := before[i]) >= 0:
                tree.put(h, leaf(h, i))
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def cut(self, text: str) -> list[str]:
        """A text as pieces that are encoded apart; special tokens are pieces."""
        out = []
        for k, part in enumerate(self.splitter.split(text) if self.splitter else [text]):
            if k % 2:
                out.append(part)
            elif self.open.search(part):
                out += self.pattern.findall(part)
            elif part:
                first, *rest = part.split(" ")
                if first:
                    out.append(first)
                out += [" " + r for r in rest]
        return out

    def learn(self, pieces: set[str]) -> dict[str, tuple[int, str, bytes]]:
        """Encode pieces that are not in the cache, all at once; the long ones among them are not kept there."""
        for s in pieces & self.special.keys():
            self.cache[s] = 1, str(self.special[s]), s.encode()
        new = list(pieces - self.cache.keys())
        tokens = list(map(self.pattern.findall, new))
        parts = list({t for ts in tokens for t in ts})
        ids = dict(zip(parts, self.merge_many([t.encode() for t in parts]), strict=True))
        name, cache, large = self.name, self.cache, {}
        for s, ts in zip(new, tokens, strict=True):
            own = ids[ts[0]] if len(ts) == 1 else [i for t in ts for i in ids[t]]
            (cache if len(s) <= KEPT else large)[s] = len(own), ",".join([name[i] for i in own]), self.decode(own)
        return large

    def texts(self, texts: list[str | None]) -> Iterator[list[tuple[int, str, bytes]]]:
        """Of each text its pieces: number of ids, the ids joined by commas, and the bytes that they decode to."""
        for i in range(0, len(texts), 256):
            cut = [self.cut(t or "") for t in texts[i : i + 256]]
            if len(self.cache) > CACHE:
                self.cache.clear()
            large, cache = self.learn(set().union(*cut)), self.cache
            for pieces in cut:
                yield [large[p] if p in large else cache[p] for p in pieces] if large else list(map(cache.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in next(self.texts([text])) for i in ids.split(",")]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The vocabulary, once for each worker."""
    return Bpe(vocabulary(path))


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        try:
            for batch in lots(batches):
                counts, ids, decoded = [], [], []
                for done in bpe.texts(batch.column(1).to_pylist()):
                    counts.append(sum([x[0] for x in done]))
                    ids.append(hashlib.sha256(",".join([x[1] for x in done]).encode()).hexdigest())
                    whole = b"".join([x[2] for x in done]).decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(whole.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            bpe.cache.clear()

    return run


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_tokens, SHA-256 of its ids joined by commas, and of the text decoded from them."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(_digests(path), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def encode_ids(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each text as one more column; a column of that name is replaced."""
    kept = [c for c in docs.columns if c != out_col]
    schema = docs.select(*kept).schema.add(out_col, ArrayType(IntegerType()))
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in lots(batches):
            ids = pa.array([bpe.encode(t or "") for t in batch.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*kept, out_col])

    return docs.select(*kept).mapInArrow(run, schema)


def decode_ids(docs: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "text") -> DataFrame:
    """``docs`` with the text that the ids of each row decode to; null ids give a null text."""
    kept = [c for c in docs.columns if c != out_col]
    schema = docs.select(*kept).schema.add(out_col, "string")
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in lots(batches):
            texts = [None if ids is None else bpe.decode(ids).decode("utf-8", "replace") for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, out_col])

    return docs.select(*kept).mapInArrow(run, schema)
