"""Vector code compression: product quantization by dual-tree Lloyd rounds, in integers throughout.

A vector's components become integers, and the vector is cut into equal consecutive parts. Vectors are dealt to blocks, and
for each block and part position a tree is built once and written: halves by the median of the widest component, a box and
the sum of its parts for each node. A round builds a tree over each position's codebook and walks pairs of nodes, one of
either tree, level by level. Each part node has a pivot, an entry near its middle. An entry node is dropped where, for every
point of the part node's box and every point of its own, the pivot is nearer: the bound on the difference of both squared
distances is a sum over components, each at an end of the box. Where one entry is left, the whole part node is assigned and
adds its cached sum; leaves that stay uncertain are compared part by part, in integers, among their last candidates. Ties go to
the lower entry. So results equal those of plain Lloyd rounds, whatever the blocks.

Each task sends sums by position and entry, and only codebooks pass the driver; their size is set by the parameters.

Vectors that are null or empty, or hold null or non-finite components, are dropped; so are vectors whose length is not that of
the smallest id among those whose length the number of parts divides. Integers are bounded by ``BOUND`` so that all sums are
exact. Null ids come last in the order of ids; equal ids are ordered by their vectors. Rows that repeat are rows of their own.
With fewer vectors than entries a codebook has fewer entries. An empty table gives no codes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidemark.llm.common import Scratch

BLOCK, LEAF = 4096, 8  #: vectors in a tree, and parts in one of its leaves
BOUND = 1 << 24  #: of the integers: their squared distances stay below 2**52, for a component


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end: the halves of the nodes above."""
    return (np.arange((1 << level) + 1) * n) >> level


class Tree:
    """Points in the order of the tree's leaves; of each level the boxes and sums of its nodes."""

    def __init__(self, points: np.ndarray, order: np.ndarray, levels: int):
        self.points, self.order, self.n, self.levels = points, order, len(points), levels
        self.low, self.high, self.sums = [], [], []

    def box(self, level: int) -> None:
        starts = bounds(self.n, level)[:-1]
        self.low.append(np.minimum.reduceat(self.points, starts))
        self.high.append(np.maximum.reduceat(self.points, starts))
        self.sums.append(np.add.reduceat(self.points, starts))

    @classmethod
    def build(cls, points: np.ndarray, leaf: int) -> Tree:
        n = len(points)
        levels = max(0, (n // leaf).bit_length() - 1)  # no node is empty
        tree = cls(points, np.arange(n), levels)
        tree.box(0)
        for level in range(levels):
            width = (tree.high[level] - tree.low[level]).argmax(axis=1)
            node = np.repeat(np.arange(1 << level), np.diff(bounds(n, level)))
            by = np.lexsort((tree.points[np.arange(n), width[node]], node))
            tree.points, tree.order = tree.points[by], tree.order[by]
            tree.box(level + 1)
        return tree

    def pack(self) -> tuple[bytes, bytes, bytes]:
        """Points, order, and all nodes, level by level."""
        nodes = [np.concatenate(x).astype("<i8") for x in (self.low, self.high, self.sums)]
        return self.points.astype("<i4").tobytes(), self.order.astype("<i4").tobytes(), np.stack(nodes).tobytes()

    @classmethod
    def unpack(cls, n: int, points: np.ndarray, order: np.ndarray, nodes: np.ndarray) -> Tree:
        levels = (nodes.shape[1] + 1).bit_length() - 2
        tree = cls(points, order, levels)
        cuts = [(1 << k) - 1 for k in range(1, levels + 1)]
        tree.low, tree.high, tree.sums = (np.split(x, cuts) for x in nodes)
        return tree


def assign(parts: Tree, entries: Tree) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Nearest entries of all parts: (level, nodes, entries) of nodes assigned whole, then places and entries of single parts."""
    whole, p, e = [], np.zeros(1, np.int64), np.zeros(1, np.int64)
    level = entry_level = 0
    while True:
        bottom = entry_level == entries.levels
        ends = bounds(entries.n, entry_level)
        low, high = parts.low[level][p], parts.high[level][p]
        some = entries.points[ends[e]]  # an entry of each node
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        count = np.diff(np.r_[first, len(p)])
        off = low + high - 2 * some
        off = (off * off).sum(axis=1)
        nearest = np.lexsort((off, p))[first]
        pivot = np.repeat(some[nearest], count, axis=0)
        most = np.maximum(*[(x - pivot) ** 2 - (x - np.clip(x, entries.low[entry_level][e], entries.high[entry_level][e])) ** 2 for x in (low, high)]).sum(axis=1)
        p, e = p[most >= 0], e[most >= 0]
        if bottom:
            first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            count = np.diff(np.r_[first, len(p)])
            single = (count == 1) & (ends[e[first] + 1] - ends[e[first]] == 1)
            if single.any():
                whole.append((level, p[first[single]], entries.order[ends[e[first[single]]]]))
                left = ~np.repeat(single, count)
                p, e = p[left], e[left]
                if not len(p):
                    return whole, np.zeros(0, np.int64), np.zeros(0, np.int64)
            if level == parts.levels:
                break
        # the next level: children of both, of either one where the other has none
        if not bottom:
            p, e = np.repeat(p, 2), np.stack([2 * e, 2 * e + 1], axis=1).ravel()
            entry_level += 1
        if level < parts.levels:
            order = np.argsort(np.concatenate([2 * p, 2 * p + 1]), kind="stable")
            p, e = np.concatenate([2 * p, 2 * p + 1])[order], np.concatenate([e, e])[order]
            level += 1
    # leaves: every part against the entries of its leaf's candidates, lower entries first
    size = ends[e + 1] - ends[e]
    leaf, at = np.repeat(p, size), np.repeat(ends[e], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    own = entries.order[at]
    order = np.lexsort((own, leaf))
    leaf, at, own = leaf[order], at[order], own[order]
    first = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
    count = np.diff(np.r_[first, len(leaf)])
    starts = bounds(parts.n, parts.levels)
    begin, n = starts[leaf[first]], np.diff(starts)[leaf[first]]
    slot, turn = np.arange(n.max()), np.arange(count.max())
    place = np.minimum(begin[:, None] + slot, parts.n - 1)
    candidate = first[:, None] + np.minimum(turn, count[:, None] - 1)
    gap = parts.points[place][:, :, None] - entries.points[at[candidate]][:, None]
    far = np.where((turn < count[:, None])[:, None], (gap * gap).sum(axis=3), np.iinfo(np.int64).max)
    best = own[np.take_along_axis(candidate, far.argmin(axis=2), 1)]
    inside = slot < n[:, None]
    return whole, place[inside], best[inside]


def codebook_trees(codebooks: np.ndarray) -> list[Tree]:
    return [Tree.build(c, 1) for c in codebooks if len(c)]


def totals(tree: Tree, entries: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry the number of its parts and their sum."""
    count, sums = np.zeros(entries.n, np.int64), np.zeros((entries.n, tree.points.shape[1]), np.int64)
    whole, places, own = assign(tree, entries)
    for level, nodes, of in whole:
        np.add.at(count, of, np.diff(bounds(tree.n, level))[nodes])
        np.add.at(sums, of, tree.sums[level][nodes])
    np.add.at(count, own, 1)
    np.add.at(sums, own, tree.points[places])
    return count, sums


def codes(tree: Tree, entries: Tree) -> np.ndarray:
    """The entry of each part, in the order in which the parts were given."""
    out = np.zeros(tree.n, np.int64)
    whole, places, own = assign(tree, entries)
    for level, nodes, of in whole:
        starts = bounds(tree.n, level)
        n = np.diff(starts)[nodes]
        out[np.repeat(starts[nodes], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.repeat(of, n)
    out[places] = own
    given = np.empty(tree.n, np.int64)
    given[tree.order] = out
    return given


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -BOUND, BOUND).astype(np.int64)


@dataclass
class Compressed:
    """codes: id, label, code, error for each vector; codebooks: positions x entries x components."""

    codes: DataFrame
    codebooks: np.ndarray
    scale: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()

    def decoded(self) -> DataFrame:
        """``codes`` with the vectors that they stand for: the middles of their entries' integers."""
        books, scale = self.codebooks, self.scale
        schema = StructType([*self.codes.schema, StructField("decoded", ArrayType(DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                told = batch.column(batch.schema.get_field_index("code")).to_pylist()
                at = np.frombuffer(bytes.fromhex("".join(told)), np.uint8).reshape(len(told), len(books))
                found = (books[np.arange(len(books)), at] + 0.5) / scale
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found.reshape(len(told), -1)), pa.list_(pa.float64()))], names=[*batch.schema.names, "decoded"])

        return self.codes.mapInArrow(run, schema)


def blocks(kept: DataFrame, parts: int, width: int, scale: int) -> DataFrame:
    """Rows of up to ``BLOCK`` vectors: ids, labels, and of all positions the trees."""
    kind, label = (kept.schema[c].dataType.simpleString() for c in ("id", "label"))

    def block(ids: pa.Array, labels: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
        whole = integers(vectors, scale).reshape(len(vectors), parts, width // parts)
        points, orders, nodes = zip(*[Tree.build(whole[:, k], LEAF).pack() for k in range(parts)], strict=True)
        arrays = [pa.array([x]) for x in (b"".join(points), b"".join(orders), b"".join(nodes))]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, labels)]
        return pa.RecordBatch.from_arrays([*lists, pa.array([len(vectors)], pa.int32()), *arrays], names=["ids", "labels", "n", "points", "orders", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                table = pa.Table.from_batches(held).combine_chunks()
                for i in range(0, table.num_rows - BLOCK + 1, BLOCK):
                    yield made(table.slice(i, BLOCK))
                rest = table.slice(table.num_rows // BLOCK * BLOCK).to_batches()
                held = [b for b in rest if b.num_rows]
        if held:
            yield made(pa.Table.from_batches(held))

    def made(rows: pa.Table) -> pa.RecordBatch:
        one = rows.combine_chunks().to_batches()[0]
        return block(one.column(0), one.column(1), one.column(2).flatten().to_numpy(zero_copy_only=False).reshape(one.num_rows, width))

    return kept.mapInArrow(run, f"ids array<{kind}>, labels array<{label}>, n int, points binary, orders binary, nodes binary")


def trees(n: int, points: bytes, orders: bytes | None, nodes: bytes, parts: int) -> Iterator[Tree]:
    p = np.frombuffer(points, "<i4").reshape(parts, n, -1).astype(np.int64)
    o = np.frombuffer(orders, "<i4").reshape(parts, n) if orders is not None else [None] * parts
    b = np.frombuffer(nodes, "<i8").reshape(parts, 3, -1, p.shape[2])
    return (Tree.unpack(n, p[k], o[k], b[k]) for k in range(parts))


def moved(dealt: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after a round: every entry the mean of its parts, rounded down; unused entries stay."""
    parts = len(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = codebook_trees(codebooks)
        count, sums = np.zeros(codebooks.shape[:2], np.int64), np.zeros(codebooks.shape, np.int64)
        for batch in batches:
            for n, points, nodes in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for k, tree in enumerate(trees(n, points, None, nodes, parts)):
                    c, s = totals(tree, books[k])
                    count[k] += c
                    sums[k] += s
        used = np.argwhere(count)
        k, e = used.T
        rows = [np.repeat(k, sums.shape[2] + 1), np.repeat(e, sums.shape[2] + 1), np.tile(np.arange(-1, sums.shape[2]), len(used)), np.hstack([count[k, e][:, None], sums[k, e]]).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in rows], names=["part", "entry", "component", "value"])

    sent = dealt.select("n", "points", "nodes").mapInArrow(run, "part long, entry long, component long, value long")
    count, sums = np.zeros(codebooks.shape[:2], object), np.zeros(codebooks.shape, object)
    for r in sent.groupBy("part", "entry", "component").agg(F.sum("value").alias("value")).collect():  # as many rows as codebooks have numbers
        if r.component < 0:
            count[r.part, r.entry] = r.value
        else:
            sums[r.part, r.entry, r.component] = r.value
    out = codebooks.copy()
    for k, e in np.argwhere(count):
        out[k, e] = [s // count[k, e] for s in sums[k, e]]
    return out


def coded(dealt: DataFrame, codebooks: np.ndarray, kind: str, label: str) -> DataFrame:
    """(id, label, code, error) of every vector."""
    parts = len(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = codebook_trees(codebooks)
        for batch in batches:
            for i in range(batch.num_rows):
                n, points, orders, nodes = (batch.column(c)[i].as_py() for c in ("n", "points", "orders", "nodes"))
                out, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                for k, tree in enumerate(trees(n, points, orders, nodes, parts)):
                    own = codes(tree, books[k])
                    out[:, k] = own
                    gap = tree.points - codebooks[k][own[tree.order]]
                    error[tree.order] += (gap * gap).sum(axis=1)
                text = out.tobytes().hex()
                told = pa.array([text[j : j + 2 * parts] for j in range(0, len(text), 2 * parts)])
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, told, pa.array(error)], names=["id", "label", "code", "error"])

    return dealt.mapInArrow(run, f"id {kind}, label {label}, code string, error long")


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> Compressed:
    """Codes of all vectors by codebooks that start from the ``entries`` smallest ids; at most 256 entries."""
    assert 0 < entries <= 256
    scratch = Scratch(vectors.sparkSession, "codes")
    finite = F.forall("vector", lambda x: F.coalesce((x < float("inf")) & (x > float("-inf")), F.lit(False)))
    given = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    kept = given.where("vector is not null").where((F.size("vector") > 0) & (F.size("vector") % parts == 0) & finite)
    order = [F.col("id").asc_nulls_last(), F.col("vector").asc()]
    first = kept.orderBy(*order).select(F.size("vector").alias("n")).limit(1).collect()
    width = first[0].n if first else parts
    kept = kept.where(F.size("vector") == width)
    start = [r.vector for r in kept.orderBy(*order).select("vector").limit(entries).collect()]
    codebooks = integers(np.array(start, np.float64).reshape(-1, width), scale).reshape(-1, parts, width // parts).transpose(1, 0, 2)
    kind, label = (kept.schema[c].dataType.simpleString() for c in ("id", "label"))
    dealt = scratch.table(blocks(kept, parts, width, scale), "blocks")
    for _ in range(rounds if start else 0):
        codebooks = moved(dealt, codebooks)
    out = scratch.table(coded(dealt, codebooks, kind, label), "codes")
    return Compressed(out, codebooks, scale)


def with_label_errors(found: Compressed, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector: id, code, error, label_error (summed over equal labels, nulls together), codebooks_sha256."""
    sums = found.codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    rows = found.codes.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return rows.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """SQL for one assignment to codebook ``k`` and the codebook after it."""
    return f"""
a{k} AS (SELECT r, c.p, part, min(struct_pack(d := list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS best
  FROM cells c JOIN c{k} b ON b.p = c.p GROUP BY r, c.p, part),
s{k} AS (SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT p, best.e AS e, unnest(part) AS x, generate_subscripts(part, 1) AS i FROM a{k}) GROUP BY ALL),
m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS entry FROM s{k} GROUP BY p, e),
c{k + 1} AS (SELECT b.p, b.e, coalesce(m.entry, b.entry) AS entry FROM c{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e)"""


ORACLE_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))
), cells AS (
  SELECT r, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS part FROM kept, range(16) t(p)
), c0 AS (SELECT p, r AS e, part AS entry FROM cells WHERE r < 64), {_round(0)}, {_round(1)}, {_round(2)},
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(entry) AS x, generate_subscripts(entry, 1) AS i FROM c2)),
found AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM found JOIN kept USING (r), digest"""
