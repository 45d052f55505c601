"""Embedding near-dedup by hierarchical navigable small-world graphs, one for each shard.

Vectors are made unit vectors in double precision; equal vectors become one node with their number. Nodes are dealt to
shards by hash, and each shard is a task of its own. It reads its nodes, builds the graph, and then streams all nodes past
it as queries, in blocks: a greedy descent through the upper layers, then a beam search in the lowest. A query whose beam is
full of links has more of them than that: it is compared with the whole shard. Before any query, nodes of the shard that are
known to have links there, from a comparison of some nodes with the whole shard, are searched with ever wider beams until
none of their links is missing: that width serves the whole shard. Some queries of each block are audited in the same way;
where one misses a link, its block and all later ones are searched with a wider beam. What the search finds is verified by cosine in double precision. Links are counted and, within a block, joined to a spanning forest, so a group of
n near-copies gives n edges and not n squared. The forests are united by distributed components.

Null, zero, empty and non-finite vectors and vectors with null components link with nothing, nor do vectors of other
lengths with each other. A null id keeps its row, without component, as kept; rows that repeat an id are one member each of
their vectors' nodes and share a component. Labels are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, components

SHARD_ROWS, SHARD_BYTES, LEAST_SHARDS = 32_768, 64 << 20, 8
NEIGHBOURS = 16  #: of a node when it is inserted; twice as many at most
BUILD_BEAM, BEAM, DESCENT = 48, 24, 4
BLOCK, AUDITS, RECALL = 512, 8, 1.0
TOLD, LOOKED = 64, 1024  #: nodes with links that tell a shard's beam, and nodes looked at for them
FAN = 16  #: nodes of a layer for each node of the layer above


def diverse(sims: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
    """Which candidates (in falling order of ``sims``) become neighbours: those closer to the node than to any chosen before."""
    n, c = sims.shape
    chosen, nearest, count = np.zeros((n, c), bool), np.full((n, c), -np.inf), np.zeros(n, np.int64)
    for j in range(c):
        take = (sims[:, j] > nearest[:, j]) & (count < most) & np.isfinite(sims[:, j])
        chosen[:, j] = take
        count += take
        nearest = np.where(take[:, None], np.maximum(nearest, among[:, j]), nearest)
    return chosen


class Layer:
    """One layer of the hierarchy: the first ``n`` of all nodes, with links among them."""

    def __init__(self, x: np.ndarray, n: int):
        self.x, self.n = x, n
        self.links = np.full((n, 2 * NEIGHBOURS), -1, np.int64)
        self.degree = np.zeros(n, np.int64)

    def join(self, batch: np.ndarray, found: np.ndarray | None, near: np.ndarray | None) -> None:
        """Link new nodes to what a search found for them and to each other."""
        x = self.x[batch]
        sims = x @ x.T
        np.fill_diagonal(sims, -np.inf)
        width = min(32, len(batch))
        top = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        ids, sims = batch[top], np.take_along_axis(sims, top, 1)
        if found is not None:
            ids, sims = np.hstack([ids, found]), np.hstack([sims, near])
        order = np.argsort(-sims, axis=1, kind="stable")[:, :64]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        for i in range(0, len(batch), 128):
            some = ids[i : i + 128]
            v = self.x[np.maximum(some, 0)]
            chosen = diverse(sims[i : i + 128], v @ v.transpose(0, 2, 1), NEIGHBOURS) & (some >= 0)
            for k, node in enumerate(batch[i : i + 128]):
                mine = some[k][chosen[k]]
                self._add(node, mine)
                for other in mine:
                    self._add(other, batch[i + k : i + k + 1])

    def _add(self, node: int, new: np.ndarray) -> None:
        k, links = self.degree[node], self.links[node]
        new = new[~(new[:, None] == links[:k]).any(axis=1)]
        if k + len(new) > len(links):
            every = np.concatenate([links[:k], new])
            sims = self.x[every] @ self.x[node]
            order = np.argsort(-sims, kind="stable")
            every, sims = every[order], sims[order]
            v = self.x[every]
            keep = diverse(sims[None], (v @ v.T)[None], NEIGHBOURS)[0]
            # places that are left go to the nearest of the others
            keep[np.flatnonzero(~keep)[: max(0, NEIGHBOURS + 8 - int(keep.sum()))]] = True
            new, k = every[keep], 0
            links[:] = -1
        links[k : k + len(new)] = new
        self.degree[node] = k + len(new)

    def search(self, q: np.ndarray, entry: np.ndarray, beam: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the ``beam`` best nodes found for each query, best first; -1 where there are fewer."""
        known = min(known, self.n)
        beam, n = min(beam, known), len(q)
        seen = np.zeros((n, known), bool)
        ids, sims = np.full((n, beam), -1, np.int64), np.full((n, beam), -np.inf, np.float32)
        open_ = np.zeros((n, beam), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = entry, np.einsum("ij,ij->i", q, self.x[entry]), True
        live = np.arange(n)
        seen[live, entry] = True
        while len(live):
            best = np.where(open_[live], sims[live], -np.inf)
            at = best.argmax(axis=1)
            going = np.isfinite(best[np.arange(len(live)), at])
            live, at = live[going], at[going]
            node = ids[live, at]
            open_[live, at] = False
            nb = self.links[node]
            ok = (nb >= 0) & (nb < known)
            ok &= ~seen[live[:, None], np.where(ok, nb, 0)]
            r, c = np.nonzero(ok)
            seen[live[r], nb[r, c]] = True
            near = np.full(nb.shape, -np.inf, np.float32)
            near[r, c] = np.einsum("ij,ij->i", q[live[r]], self.x[nb[r, c]])
            some = ok.any(axis=1)
            m = live[some]
            if len(m):
                every = np.hstack([sims[m], near[some]])
                keep = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
                sims[m] = np.take_along_axis(every, keep, 1)
                ids[m] = np.take_along_axis(np.hstack([ids[m], np.where(ok[some], nb[some], -1)]), keep, 1)
                open_[m] = np.take_along_axis(np.hstack([open_[m], ok[some]]), keep, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


class Graph:
    """A hierarchy of navigable small-world layers over unit vectors; built and searched in batches.

    Nodes come in the order of a hash, so the first of them are a sample: each layer holds the first ``FAN``-th of the
    nodes of the layer below.
    """

    def __init__(self, vectors: np.ndarray):
        self.x = vectors.astype(np.float32)
        self.n, self.beam = len(vectors), None
        sizes = [self.n]
        while sizes[-1] // FAN >= FAN:
            sizes.append(sizes[-1] // FAN)
        self.layers = [Layer(self.x, k) for k in reversed(sizes)]
        done = 0
        while done < self.n:
            batch = np.arange(done, min(self.n, done + max(256, min(done, 1024))))
            entry = np.zeros(len(batch), np.int64)
            for layer in self.layers:
                own = batch[batch < layer.n]
                if not done:
                    layer.join(own, None, None)
                    continue
                found, near = layer.search(self.x[batch], entry, BUILD_BEAM if len(own) else DESCENT, done)
                entry = found[:, 0]
                if len(own):
                    layer.join(own, found[: len(own)], near[: len(own)])
            done = int(batch[-1]) + 1

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Down the layers with a narrow beam, then with ``beam`` in the lowest."""
        entry = np.zeros(len(q), np.int64)
        for layer in self.layers[:-1]:
            entry = layer.search(q, entry, DESCENT, layer.n)[0][:, 0]
        return self.layers[-1].search(q, entry, beam, self.n)

    def settle(self, least: float) -> float:
        """Widen the shard's beam until nodes that have links find all of them; the share that the first width found."""
        look = np.unique(np.linspace(0, self.n - 1, min(LOOKED, self.n)).astype(int))
        truth = np.concatenate([self.x[look[i : i + 128]] @ self.x.T >= least for i in range(0, len(look), 128)])
        have = np.flatnonzero(truth.sum(axis=1) > 1)[:TOLD]  # each finds itself
        look, truth, first = look[have], truth[have].sum(axis=1), 1.0
        while len(look) and self.beam < self.n:
            _, sims = self.search(self.x[look], self.beam)
            hit = (sims >= least).sum(axis=1)
            full = hit == self.beam  # such queries are widened anyway
            share = float(hit[~full].sum() / max(1, truth[~full].sum()))
            first = min(first, share) if self.beam == BEAM else first
            if share >= RECALL:
                break
            self.beam *= 2
        self.beam = min(self.beam, self.n)
        return first

    def linked(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all that the widened and audited search finds at similarity ``least`` or more, with a margin for rounding."""
        least = least - 1e-5
        if self.beam is None:
            self.beam = min(BEAM, self.n)
            self.settle(least)
        q32 = q.astype(np.float32)
        beam, todo, out_q, out_n = self.beam, np.arange(len(q)), [], []
        audit = np.linspace(0, len(q) - 1, min(AUDITS, len(q))).astype(int)
        truth = q32[audit] @ self.x.T >= least
        while True:
            if beam > BEAM and 2 * NEIGHBOURS * beam >= self.n or beam >= self.n:  # so wide a beam meets as many nodes as the shard has: it is the shard
                for i in range(0, len(todo), 64):
                    a, b = np.nonzero(q32[todo[i : i + 64]] @ self.x.T >= least)
                    out_q.append(todo[i : i + 64][a])
                    out_n.append(b)
                break
            ids, sims = self.search(q32[todo], beam)
            hit = (sims >= least) & (ids >= 0)
            audited = np.isin(todo, audit)
            missed = 0
            for k in np.flatnonzero(audited & ~hit[:, -1]):
                missed += truth[np.searchsorted(audit, todo[k])].sum() > hit[k].sum()
            if missed > (1 - RECALL) * max(1, audited.sum()):
                beam *= 2
                if len(todo) == len(q):  # for the blocks to come as well
                    self.beam = beam
                continue
            full = hit[:, -1]
            a, b = np.nonzero(hit & ~full[:, None])
            out_q.append(todo[a])
            out_n.append(ids[a, b])
            todo = todo[full]
            if not len(todo):
                break
            beam = self.n  # of a group larger than the beam only the whole shard has all links
        return np.concatenate(out_q), np.concatenate(out_n)


def _unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, units = [], []
        for v in batch.column(1).to_pylist():
            unit = None
            if v and not any(c is None for c in v):
                x = np.array(v, np.float64)
                norm = math.sqrt(float(x @ x)) if np.isfinite(x).all() else 0.0
                if norm and not np.isfinite(norm):
                    x = x / np.abs(x).max()
                    norm = math.sqrt(float(x @ x))
                unit = (x / norm).tobytes() if norm else None
            units.append(unit)
            keys.append(xxhash.xxh3_128_digest(unit) if unit else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names=["id", "key", "unit"])


def _searched(threshold: float):
    """Partitions of (shard, query, id, copies, unit), a shard's nodes before its queries, to counts and forests of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, nodes, graph, queries = None, [], None, []

        def answer():
            q_id, q_unit = np.array([x[0] for x in queries]), np.stack([x[1] for x in queries])
            q, n = graph.linked(q_unit, threshold)
            cosine = np.einsum("ij,ij->i", q_unit[q], units[n])
            ok = (cosine >= threshold) & (q_id[q] != ids[n])
            q, n = q[ok], n[ok]
            counts = np.bincount(q, copies[n], len(queries)).astype(np.int64)
            parent: dict[int, int] = {}

            def find(i):
                while parent.setdefault(i, i) != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            edges = []
            for a, b in zip(q_id[q].tolist(), ids[n].tolist(), strict=True):
                ra, rb = find(a), find(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    edges.append((a, b, 0))
            edges += [(int(i), int(i), int(c)) for i, c in zip(q_id, counts, strict=True) if c]
            return edges

        def emit(edges):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], names=["a", "b", "n"])

        for batch in batches:
            for s, is_query, i, k, u in zip(*(batch.column(c).to_pylist() for c in ("shard", "query", "id", "copies", "unit")), strict=True):
                if s != shard:
                    if queries and (edges := answer()):
                        yield emit(edges)
                    shard, nodes, graph, queries = s, [], None, []
                if not is_query:
                    nodes.append((i, k, np.frombuffer(u)))
                    continue
                if graph is None and not nodes:
                    continue  # a shard without nodes
                if graph is None:
                    ids, copies, units = np.array([x[0] for x in nodes]), np.array([x[1] for x in nodes]), np.stack([x[2] for x in nodes])
                    nodes, graph = [], Graph(units)
                queries.append((i, np.frombuffer(u)))
                if len(queries) >= BLOCK:
                    if edges := answer():
                        yield emit(edges)
                    queries = []
        if queries and (edges := answer()):
            yield emit(edges)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """A row for each row of ``vectors``: id, n_links, component_id, kept."""
    scratch = Scratch(vectors.sparkSession, "embedding-dedup")
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    made = scratch.table(source.mapInArrow(_unit_vectors, "id long, key binary, unit binary"), "units")
    good = made.where("key is not null and id is not null")
    # the number of nodes of each length decides on that length's shards
    nodes = good.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    nodes = scratch.table(nodes.withColumn("bytes", F.length("unit")), "nodes")
    sizes = nodes.groupBy("bytes").agg(F.count("*").alias("rows"))
    sizes = sizes.select("bytes", F.greatest(F.lit(LEAST_SHARDS), F.ceil(F.col("rows") / F.least(F.lit(SHARD_ROWS), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / F.col("bytes"))))).cast("int")).alias("shards"))
    # shards of all lengths are numbered through: a row for each length
    sizes = scratch.table(sizes.withColumn("first", (F.sum("shards").over(Window.orderBy("bytes")) - F.col("shards")).cast("int")), "shards")
    dealt = nodes.join(sizes, "bytes").withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
    shard = lambda n: (F.col("first") + F.col(n)).cast("int")
    stored = dealt.select(shard("shard").alias("shard"), F.lit(False).alias("query"), "id", "copies", "unit", F.xxhash64("id").alias("tie"))
    asked = dealt.select("bytes", "id", "copies", "unit", "first", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("s"))
    asked = asked.select(shard("s").alias("shard"), F.lit(True).alias("query"), "id", "copies", "unit", F.xxhash64("id").alias("tie"))
    n = sizes.agg(F.sum("shards")).first()[0] or 1
    placed = stored.unionByName(asked).repartitionById(int(n), "shard").sortWithinPartitions("shard", "query", "tie")
    found = scratch.table(placed.drop("tie").mapInArrow(_searched(threshold), "a long, b long, n long"), "links")
    counts = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    edges = found.where("a <> b").select("a", "b").distinct()
    member = made.join(nodes.select("key", F.col("id").alias("rep"), "copies"), "key", "left").select("id", "rep", "copies")
    same = member.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comp = components(scratch, edges.unionByName(same))
    out = member.join(counts, "rep", "left").join(comp.select(F.col("node").alias("id"), "component"), "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    links = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return out.select(F.col("id").alias(id_col), links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
