"""Conversation prefix trie: every distinct sequence of first turns is a node, with totals over its subtree.

A node is known by its depth and by sums, over its turns, of digests of (place, role, text): the first d turns of a
conversation have the running sum of its rows, so a conversation of any length is summed in ranges and in no single task.
Totals over subtrees roll up by bands of ``height`` depths. A node explodes to its ancestors within its own band only; the
totals of the bands' top nodes then are the nodes of a tree that is ``height`` times lower, where the same is done; what is
complete there goes once more to the nodes within the band above. So a node makes at most 2 * ``height`` rows at each of
log(depth) levels, and no round waits for a single depth.

Order of turns: by turn, nulls first; ties by the digest of role and text. Null roles and texts are empty. Rows without a
conv_id belong to no conversation and make no node. Rows that repeat are turns of their own. Other columns are not read. An
empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, ordered_parts

HEIGHT = 16  #: depths of a band
CHUNK = 512  #: ids in a row of a list of members
PIECES = ("p1", "p2", "p3", "p4")  #: 32 bits each, so that their running sums stay far from the end of a long


def digested(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, said, size): a digest of role and text, and the text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.where("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", said.alias("said"), F.octet_length(text).cast("long").alias("size"))


def running(parts: DataFrame, group: str, order: list[str], sums: dict[str, Column], more: DataFrame | None = None) -> DataFrame:
    """``parts`` (from ``ordered_parts``) with sums over the group's rows up to each row: within a part, and before the part.

    ``more`` has further columns for each group; they come with the sums of whole parts, as many rows as a group has parts.
    """
    totals = parts.groupBy(group, "part").agg(*[F.sum(v).alias(f"{k}_part") for k, v in sums.items()])
    ahead = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(group, "part", *[F.coalesce(F.sum(f"{k}_part").over(ahead), F.lit(0)).alias(f"{k}_before") for k in sums])
    before = before.join(more, group) if more is not None else before
    here = Window.partitionBy(group, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.select("*", *[F.sum(v).over(here).alias(f"{k}_here") for k, v in sums.items()]).join(before, [group, "part"])
    return rows.withColumns({k: F.col(f"{k}_before") + F.col(f"{k}_here") for k in sums}).drop("part", *[f"{k}{x}" for k in sums for x in ("_before", "_here")])


def rebuild(scratch: Scratch, turns: DataFrame, group: int = 5, leads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): each conversation c starts with the first h turns of c - c % ``group``, then has its own after h.

    h is the CRC-32 of c in decimal, modulo ``leads``. conversations: (conv_id); turns: (conv_id, place from 0, said, size).
    """
    parts = ordered_parts(scratch, digested(turns), "conv_id", "turn", "said")
    sizes = parts.groupBy("conv_id").agg(F.count("*").alias("n"))
    lead = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % leads).alias("lead")
    ids = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), lead)
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = scratch.table(ids.join(bases, "base", "left").select("conv_id", "base", "lead", F.least("lead", F.coalesce("base_n", F.lit(0))).alias("led")), "conversations")
    numbered = running(parts, "conv_id", ["turn", "said"], {"place": F.lit(1)}, convs.select("conv_id", "lead", "led"))
    numbered = scratch.table(numbered.withColumn("place", F.col("place") - 1), "numbered")
    own = numbered.where("place >= lead").select("conv_id", (F.col("place") - F.col("lead") + F.col("led")).alias("place"), "said", "size")
    first = numbered.where(F.col("place") < leads - 1).select(F.col("conv_id").alias("base"), "place", "said", "size")
    led = first.join(convs.select("conv_id", "base", "lead"), "base").where("place < lead").select("conv_id", "place", "said", "size")
    return convs.select("conv_id"), own.unionByName(led)


def node_key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))


def paths(scratch: Scratch, convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, size): the node that each conversation has at each depth; the root at depth 0."""
    digest = F.md5(F.concat_ws(":", F.col("place").cast("string"), "said").cast("binary"))
    cut = {p: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k, p in enumerate(PIECES)}
    parts = ordered_parts(scratch, turns.select("conv_id", "place", "size", *[c.alias(p) for p, c in cut.items()]), "conv_id", "place")
    rows = running(parts, "conv_id", ["place"], {f"{p}_sum": F.col(p) for p in PIECES})
    depth = (F.col("place") + 1).cast("long")
    own = node_key(depth, [F.col(f"{p}_sum") for p in PIECES])
    parent = node_key(depth - 1, [F.col(f"{p}_sum") - F.col(p) for p in PIECES])
    root = node_key(F.lit(0), [F.lit(0)] * len(PIECES))
    below = rows.select("conv_id", depth.alias("depth"), own.alias("key"), parent.alias("parent"), "size")
    top = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("size"))
    return scratch.table(below.unionByName(top), "paths")


def band_totals(scratch: Scratch, rows: DataFrame, nodes: DataFrame, values: list[str], height: int = HEIGHT) -> DataFrame:
    """(key, values): sums of the values over each node's subtree, the node included.

    rows (conv_id, depth, key): the path of each conversation. nodes (key, conv_id, depth, values): each with a conversation
    whose path reaches it.
    """
    deepest = nodes.agg(F.max("depth")).first()[0]
    band = F.floor(F.col("depth") / height)
    own = rows.select("conv_id", band.alias("band"), F.struct("depth", "key").alias("step"))
    # a group is a part of one path, of at most ``height`` nodes
    bands = own.groupBy("conv_id", "band").agg(F.collect_list("step").alias("path"))
    bands = scratch.table(bands.join(nodes.select("conv_id").distinct(), "conv_id", "left_semi"), "bands") if deepest is not None and deepest >= height else bands

    def spread(given: DataFrame, kept: Column) -> DataFrame:
        """The given nodes' values, summed over the ancestors of one band of their paths."""
        pairs = given.join(bands, ["conv_id", "band"]).select("depth", F.explode("path").alias("step"), *values).where(kept)
        return pairs.groupBy(F.col("step.key").alias("key")).agg(*[F.sum(v).alias(v) for v in values])

    within = spread(nodes.withColumn("band", band), F.col("step.depth") <= F.col("depth"))
    if deepest is None or deepest < height:
        return within
    within = scratch.table(within, "within")
    top = F.col("depth") % height == 0
    lower = (F.col("depth") / height).cast("long").alias("depth")
    tops = scratch.table(nodes.where(top).select("key", "conv_id", lower).join(within, "key"), "tops")
    complete = scratch.table(band_totals(scratch, rows.where(top).select("conv_id", lower, "key"), tops, values, height), "complete")
    # a complete top node counts for the nodes of the band above, but for that band's own top, which is complete too
    given = tops.drop(*values).join(complete, "key").where("depth > 0").withColumn("band", F.col("depth") - 1)
    passed = spread(given, F.col("step.depth") % height != 0)
    inner = within.join(tops.select("key"), "key", "left_anti").unionByName(passed)
    return inner.groupBy("key").agg(*[F.sum(v).alias(v) for v in values]).unionByName(complete)


def member_digests(scratch: Scratch, members: DataFrame, group: str = "key", id_col: str = "conv_id") -> DataFrame:
    """(group, sha256): the digest of the group's ids in decimal, in numerical order, joined by commas.

    Ids are sorted in ranges and joined to rows of up to ``CHUNK``. A group's digest is one stream by its nature; it reads
    these rows one after the other and holds none of them.
    """
    kind = members.schema[group].dataType.simpleString()
    parts = ordered_parts(scratch, members.select(group, id_col), group, id_col)
    at = Window.partitionBy(group, "part").orderBy(id_col)
    chunk = F.floor((F.row_number().over(at) - 1) / CHUNK)
    rows = parts.withColumn("chunk", chunk).groupBy(group, "part", "chunk").agg(F.sort_array(F.collect_list(id_col)).alias("ids"))
    rows = rows.select(group, "part", "chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, started = None, None, False
        for batch in batches:
            keys, done = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if started and key == last:
                    digest.update(b"," + ids.encode())
                    continue
                if started:
                    keys.append(last)
                    done.append(digest.hexdigest())
                last, digest, started = key, hashlib.sha256(ids.encode()), True
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(done, pa.string())], names=[group, "sha256"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([last], batch.schema.field(0).type), pa.array([digest.hexdigest()], pa.string())], names=[group, "sha256"])

    ordered = rows.repartition(group).sortWithinPartitions(group, "part", "chunk").select(group, "ids")
    return ordered.mapInArrow(run, f"{group} {kind}, sha256 string")


def trie(scratch: Scratch, convs: DataFrame, turns: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of conversations (conv_id) and their turns (conv_id, place, said, size).

    nodes: key, parent, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens.
    ends: (key, conv_id), the node where each conversation ends.
    """
    rows = paths(scratch, convs, turns)
    merged = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("depth", "parent", "size")])
    nodes = scratch.table(merged, "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    valued = counted.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("size")})
    valued = scratch.table(valued, "valued")
    values = ["n_leaves", "saved_tokens"]
    totals = band_totals(scratch, rows.select("conv_id", "depth", "key"), valued.select("key", "conv_id", "depth", *values), values, height)
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = valued.drop(*values).join(totals, "key").join(above, "parent", "left")
    ends = rows.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key"))
    return whole, ends.select("key", "conv_id")


def rebuilt_trie(turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row for each node of the rebuilt conversations, with the digest of the members that end there."""
    scratch = Scratch(turns.sparkSession, "trie")
    nodes, ends = trie(scratch, *rebuild(scratch, turns), height)
    none = hashlib.sha256(b"").hexdigest()
    rows = nodes.join(member_digests(scratch, ends), "key", "left")
    counts = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return rows.select(*counts, F.coalesce("sha256", F.lit(none)).alias("ends_sha256"))


ORACLE_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS tab
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(conv_id::VARCHAR), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS lead
  FROM (SELECT DISTINCT conv_id FROM turns), crc
), rebuilt AS (
  SELECT i.conv_id, place, role, text FROM ids i JOIN turns t ON t.conv_id = i.base AND place < lead
  UNION ALL SELECT i.conv_id, place, role, text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND place >= lead
), paths AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS size, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER w) AS key
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY place)
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM ids
), linked AS (
  SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(key) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM paths
), nodes AS (
  SELECT key, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM linked GROUP BY key
), counted AS (
  SELECT n.*, coalesce(k, 0) AS n_children FROM nodes n LEFT JOIN (SELECT parent AS key, count(*) AS k FROM nodes GROUP BY parent) USING (key)
), totals AS (
  SELECT p.key, sum((c.n_children = 0)::BIGINT) AS n_leaves, sum((c.n_convs - 1) * c.size) AS saved_tokens
  FROM counted c JOIN paths p ON p.conv_id = c.conv_id AND p.depth <= c.depth GROUP BY p.key
)
SELECT c.conv_id, c.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, c.n_convs::BIGINT AS n_convs, c.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN totals USING (key) LEFT JOIN nodes u ON u.key = c.parent"""
