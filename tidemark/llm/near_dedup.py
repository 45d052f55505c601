"""Near-duplicate documents by SetSketch registers: banding, a joint likelihood estimate, then verification on full sets.

A document's set holds its distinct word shingles. A register keeps the smallest of the set's exponentially distributed
hash values on a logarithmic scale, cut off at both ends, so registers of a union are the larger of two registers and
equal registers grow likelier with similarity. Documents that agree in all registers of some band are candidates, the
likelihood of all their registers estimates their similarity, and what remains is compared on the full sets of words.

With 32 bands of 4 registers a pair at similarity 0.8 shares no band with a probability below 1e-7. The registers' base is
so near 1 that sets without a common shingle hardly ever agree in one.

Equal texts are one node from the start. Buckets can be of any size. Each first sends every member to the bucket's
smallest node only; that joins groups of near copies. Buckets whose members are then still in different components have
all such pairs compared, in blocks that keep one member of each pair outside the bucket's largest component. There the
likelihood of a second sketch, of 768 coarser registers, tells which pairs are worth the full sets.

Defined results: null or wordless texts have an empty set and link with nothing; fewer words than the shingle width make
one shingle; a null id keeps its row, with a null component, as kept; rows that repeat an id count as one document linked
by each of its texts. Ids can be of any type with an order. No other column of the input is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, components, distinct_texts, lots, shingle_hashes, text_key, word_hashes

REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
BASE, LIMIT = 1.001, 65_534  #: of the registers' logarithm; the largest register
BLOCK = 1000  #: members of a bucket that are compared at a time
SLACK = 0.2  #: the estimate may lie so far under the threshold; five standard deviations of it and more
FINE, FINE_BASE, FINE_LIMIT = 768, 1.1, 254  #: registers of the second sketch, of eight bits each
FINE_SLACK = 0.08  #: five standard deviations of its estimate

_rng = np.random.default_rng(20240229)
_A, _B, _C = (_rng.integers(1, 2**32, (REGISTERS + FINE, 1), dtype=np.uint64).astype(np.uint32) | np.uint32(1) for _ in range(3))
_BAND = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)


def words_of(text: str) -> list[bytes]:
    """Words are runs of other than ASCII space characters, with A-Z lower-cased."""
    return text.encode().lower().split()


def shingle_set(text: str, width: int) -> set:
    """The distinct shingles of a text, as tuples of words."""
    words = words_of(text)
    n = min(width, len(words))
    return set(zip(*[words[i : len(words) - n + 1 + i] for i in range(n)], strict=True))


def hashed_set(text: str, width: int) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text, for sketches."""
    return np.unique(shingle_hashes(word_hashes(words_of(text)), width))


def _least(sets: list[np.ndarray], which: slice) -> np.ndarray:
    """The smallest exponential value of each set, a row for each of the non-empty sets."""
    a, b, c = _A[which], _B[which], _C[which]
    low = np.full((len(a), len(sets)), np.uint32(0xFFFFFFFF))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets)
    chunk = 524288 // len(a)
    for i in range(0, len(every), chunk):
        h, of = every[i : i + chunk], owner[i : i + chunk]
        x = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32) * a
        x += (h >> np.uint64(32)).astype(np.uint32) * b
        x += c
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        least = np.minimum.reduceat(x, starts, axis=1)
        low[:, of[starts]] = np.minimum(low[:, of[starts]], least)
    return -np.log1p(-(low.astype(np.float64) + 0.5) / 2**32).T


def _register(least: np.ndarray, base: float, limit: int, zero: int) -> np.ndarray:
    return np.clip(np.floor(zero - np.log(least) / np.log(base)), 0, limit)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of 16 bits, a row for each of the non-empty sets."""
    return _register(_least(sets, slice(0, REGISTERS)), BASE, LIMIT, 4000).astype(np.uint16)


def fine_registers(sets: list[np.ndarray]) -> np.ndarray:
    """The second sketch: registers of 8 bits with a coarser base."""
    return _register(_least(sets, slice(REGISTERS, None)), FINE_BASE, FINE_LIMIT, 40).astype(np.uint8)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of registers; its lowest bits are the band's number."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    keys = (parts * _BAND).sum(axis=2, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return ((keys ^ (keys >> np.uint64(29))) // np.uint64(BANDS) * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, base: float = BASE) -> np.ndarray:
    """The similarity, on a grid, that makes the pairs' registers likeliest, given the sizes of both sets."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.minimum(np.linspace(0, 1, 101)[None, :], np.minimum(u / v, v / u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)
    up, down = np.maximum(p(u - v * grid), 1e-12), np.maximum(p(v - u * grid), 1e-12)
    fit = more * np.log(up) + less * np.log(down) + (a.shape[1] - more - less) * np.log(np.maximum(1 - up - down, 1e-12))
    return np.take_along_axis(grid, fit.argmax(axis=1)[:, None], axis=1)[:, 0]


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches, 64):
            sets = [hashed_set(t, width) for t in batch.column(1).to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in registers(sets)], pa.binary())], names=["node", "n", "sketch"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in lots(batches, 1024):
        if batch.num_rows:
            keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["bucket", "node"])


def _estimated(least: float):
    """Pairs with both sketches to the pairs whose estimated similarity is ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches, 1024):
            if batch.num_rows:
                n_a, n_b = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ("n_a", "n_b"))
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in ("s_a", "s_b"))
                keep = pa.array(estimate(a, b, n_a, n_b) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in ("a", "b")], names=["a", "b"])

    return run


def _verified(width: int, threshold: float):
    """Pairs with both texts to the pairs whose full sets are similar enough: 100 times the intersection against the union."""
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, set()
        for batch in lots(batches, 64):
            keep = []
            for b, t_a, t_b in zip(*(batch.column(k).to_pylist() for k in ("b", "t_a", "t_b")), strict=True):
                if b != last:
                    last, known = b, shingle_set(t_b, width)
                mine = shingle_set(t_a, width)
                common = len(mine & known)
                keep.append(common > 0 and 100 * common >= percent * (len(mine) + len(known) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in ("a", "b")], names=["a", "b"])

    return run


def _fine(width: int):
    """The second sketch, followed by 32 bits of each band's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches, 16):
            sets = [hashed_set(t, width) for t in batch.column(1).to_pylist()]
            if sets:
                tags = (band_keys(registers(sets)).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() + t.tobytes() for r, t in zip(fine_registers(sets), tags, strict=True)], pa.binary())], names=["node", "fine"])

    return run


def _block_pairs(threshold: float):
    """In a block of a bucket: its asking members against all its members, other components only.

    A pair is looked at in the bucket of the first band that it shares, and passes if its registers' likelihood tells so.
    """
    # no pair of that estimate has fewer equal registers: a cheap test before the estimate
    least = FINE * (threshold - 2 * FINE_SLACK)

    def run(table: pa.Table) -> pa.Table:
        ask, band = table.column("ask").to_numpy(), table.column("band")[0].as_py()
        ids, n, comp = (table.column(k).to_numpy() for k in ("node", "n", "comp"))
        both = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint8).reshape(-1, FINE + 4 * BANDS)
        fine, tags = both[:, :FINE], np.ascontiguousarray(both[:, FINE:]).view(np.uint32)
        low, high, every = [], [], np.flatnonzero(~ask)
        for i in np.flatnonzero(ask):
            j = every[(comp[every] != comp[i]) & (n[every] >= threshold * n[i]) & (n[i] >= threshold * n[every])]
            j = j[(tags[j] == tags[i]).argmax(axis=1) == band]
            j = j[(fine[j] == fine[i]).sum(axis=1) >= least]
            if len(j):
                j = j[estimate(np.broadcast_to(fine[i], (len(j), FINE)), fine[j], np.full(len(j), float(n[i])), n[j].astype(float), FINE_BASE) >= threshold - FINE_SLACK]
                low.append(np.minimum(ids[i], ids[j]))
                high.append(np.maximum(ids[i], ids[j]))
        ends = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (high, low)]
        return pa.table({"a": ends[0], "b": ends[1]})

    return run


def _likely(pairs: DataFrame, made: DataFrame, threshold: float) -> DataFrame:
    """The pairs that pass the joint estimate."""
    s = lambda x: made.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")).hint("merge")
    near = pairs.join(s("a"), "a").join(s("b"), "b").where("n_a >= {0} * n_b and n_b >= {0} * n_a".format(threshold))
    return near.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_estimated(threshold - SLACK), "a long, b long")


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs whose full sets are similar."""
    # texts are always shuffled, also where few pairs would allow a broadcast: the plan is the same at every size
    t = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t_{x}")).hint("merge")
    both = pairs.join(t("a"), "a").join(t("b"), "b").select("a", "b", "t_a", "t_b")
    return both.mapInArrow(_verified(width, threshold), "a long, b long")


def _rest(buckets: DataFrame, made: DataFrame, texts: DataFrame, comp: DataFrame, width: int, threshold: float, scratch: Scratch) -> DataFrame:
    """Candidate pairs (a > b) of different components from the buckets that hold several."""
    here = buckets.join(comp, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp"))
    sizes = here.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    split = sizes.groupBy("bucket").agg(F.sum("k").alias("size"), F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    split = scratch.table(split.select("bucket", F.col("top.comp").alias("main"), F.col("size"), (F.col("size") - F.col("top.k")).alias("others")), "split")
    open_ = scratch.table(here.join(split, "bucket"), "open")
    needed = open_.select("node").distinct()
    fine = texts.hint("merge").join(needed, "node", "left_semi").select("node", "text").mapInArrow(_fine(width), "node long, fine binary")
    fine = scratch.table(fine.join(made.select("node", "n").hint("merge"), "node"), "fine")
    small = open_.withColumns({"blocks": F.ceil(F.col("size") / BLOCK).cast("int"), "asks": F.ceil(F.col("others") / BLOCK).cast("int")})
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = small.select("bucket", "node", "comp", F.lit(False).alias("ask"), at("blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("part"))
    asking = small.where("comp <> main").select("bucket", "node", "comp", F.lit(True).alias("ask"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), at("asks").alias("part"))
    rows = every.unionByName(asking).withColumn("band", F.pmod("bucket", F.lit(BANDS)).cast("int")).join(fine.hint("merge"), "node")
    found = scratch.table(rows.groupBy("bucket", "block", "part").applyInArrow(_block_pairs(threshold), "a long, b long").distinct(), "candidates")
    scratch.drop(split, open_, fine)
    return found


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float, scratch: Scratch, by_row: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, texts, sizes, components): the distinct texts, the sizes of their sets, and the smallest node that each linked one reaches.

    With ``by_row``, texts come with a whole row each, and an id does not join its texts.
    """
    nodes, texts = distinct_texts(scratch, docs, id_col, text_col, rows=by_row)
    made = scratch.table(texts.select("node", "text").mapInArrow(_sketches(width), "node long, n long, sketch binary"), "sketches")
    named = nodes.where("id is not null").select("node")
    banded = made.select("node", "sketch").join(named, "node", "left_semi") if docs.schema[id_col].nullable else made.select("node", "sketch")
    banded = banded.mapInArrow(_bands, "bucket long, node long")
    leaders = scratch.table(banded.groupBy("bucket").agg(F.min("node").alias("b"), F.count("*").alias("k")).where("k > 1").select("bucket", "b"), "leaders")
    buckets = scratch.table(banded.join(leaders.hint("merge"), "bucket"), "buckets")
    scratch.drop(leaders)
    near = scratch.table(texts.select("node", "text").hint("merge").join(buckets.select("node").distinct(), "node", "left_semi"), "near")
    pairs = buckets.where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    likely = scratch.table(_likely(pairs, made, threshold), "likely")
    links = scratch.table(_confirm(likely, near, width, threshold), "links")
    # an id with several texts joins their nodes
    own = docs.where(F.lit(not by_row)).select(F.col(id_col).alias("id"), text_key(text_col).alias("key")).where("id is not null and key is not null").distinct().join(nodes.select("key", "node").hint("merge"), "key")
    several = scratch.table(own.groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("id", "low"), "several")
    same = own.join(several, "id").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    first = scratch.table(components(scratch, links.unionByName(same)), "components")
    scratch.drop(likely, links, several)
    found = _rest(buckets.select("bucket", "node"), made, near, first, width, threshold, scratch)
    more = scratch.table(_confirm(found, near, width, threshold), "more")
    scratch.drop(buckets, near, found)
    # the components so far are a forest of stars: join the new links between them
    name = lambda x: first.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    lifted = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    last = scratch.table(components(scratch, lifted).select("node", F.col("component").alias("best")), "last")
    # a component of the first round can grow, and nodes that had none can have one now
    grown = first.join(last.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("best", "component").alias("component"))
    new = last.join(first.select("node"), "node", "left_anti").select("node", F.col("best").alias("component"))
    return nodes, texts, made.select("node", "n"), scratch.table(grown.unionByName(new), "reached")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """A row for each row of ``docs``: id, n_shingles, component_id (smallest id linked, itself included), kept."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    nodes, texts, sizes, reached = _components(docs, id_col, text_col, width, threshold, scratch)
    scratch.drop(texts)
    best = nodes.join(reached, "node", "left").join(sizes, "node").select("key", "id", "n", F.coalesce("component", "node").alias("component"))
    top = nodes.select(F.col("node").alias("component"), F.col("id").alias("found"))
    known = scratch.table(best.join(top, "component").select("key", "n", "found"), "known")
    # without words an id is its own component, unless another of its rows has words
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"))
    out = rows.join(known.hint("merge"), "key", "left")
    bare = rows.where("key is null and id is not null").select("id").distinct()
    worded = scratch.table(rows.where("key is not null").join(bare, "id", "left_semi").join(known, "key").groupBy("id").agg(F.min("found").alias("also")), "worded")
    out = out.join(worded, "id", "left")
    found = F.when(F.col("id").isNotNull(), F.coalesce("found", "also", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("id") == found, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: one that has the smallest id, nulls last. All columns stay.

    Each row is decided by its own text, also where its id is null or repeated. Rows without words all stay.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    # a null id links like any other here: texts have names of their own
    ids = F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"))
    named = docs.select(ids.alias("_name"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(docs.columns)])
    text = f"_{docs.columns.index(text_col)}"
    _, texts, _, reached = _components(named, "_name", text, width, threshold, scratch, by_row=True)
    gone = reached.where("node <> component").select("node")
    kept = texts.select("node", "row").hint("merge").join(gone, "node", "left_anti").select("row.*")
    kept = kept.unionByName(named.where(text_key(text).isNull()))
    return kept.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])
