"""Parts with key ranges, hashed files, compacted streams, a state operator and quantiles on small cases."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import part_pages, ranges, runs
from tidemark.sources import storage
from tidemark.streaming import bars as streaming
from tidemark.streaming import states

START = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def numbered(spark, tmp_path_factory):
    """Twenty parts of a hundred keys each, and one more part of second versions from the middle of two of them."""
    root = f"{tmp_path_factory.mktemp('parts')}/data"
    rows = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("j"), F.lit(1).alias("v"), F.floor(F.col("id") / 100).alias("p"))
    again = spark.range(450, 550).select(F.col("id").alias("k"), (F.col("id") % 7).alias("j"), F.lit(2).alias("v"), F.lit(20).cast("long").alias("p"))
    rows.unionByName(again).repartition("p").write.partitionBy("p").parquet(root)
    schema = spark.read.parquet(root).schema
    parts = part_pages.part_ranges(storage.scan(spark, root, schema), ["k", "j"]).cache()
    return root, schema, parts


def test_ranges_of_parts(numbered):
    _, _, parts = numbered
    got = {(r.low.k, r.high.k, r.row_count, r.n_keys) for r in parts.collect()}
    assert got == {(100 * p, 100 * p + 99, 100, 100) for p in range(20)} | {(450, 549, 100, 100)}


@pytest.mark.parametrize(("last", "size", "most"), [(None, 50, 1), (None, 100, 2), (420, 60, 3), (1950, 100, 1), (1999, 10, 0), (-1, 2500, 21)])
def test_a_page_opens_the_parts_that_it_needs(spark, numbered, last, size, most):
    root, schema, parts = numbered
    after = None if last is None else [last, last % 7]
    got = part_pages.page_of_parts(spark, root, schema, parts, ["k", "j"], size, after, [F.desc("v")]).orderBy("k").collect()
    first = 0 if last is None else last + 1
    assert [(r.k, r.v) for r in got] == [(k, 2 if 450 <= k < 550 else 1) for k in range(first, min(2000, first + size))]
    assert all(r.has_more == (first + size < 2000) and r.parts_read <= most for r in got)


def test_pages_by_few_looks(spark, numbered, monkeypatch):
    monkeypatch.setattr(part_pages, "FIRST_LOOK", 2)
    root, schema, parts = numbered
    got = part_pages.page_of_parts(spark, root, schema, parts, ["k", "j"], 900, [10, 3], [F.desc("v")])
    assert [r.k for r in got.orderBy("k").collect()] == list(range(11, 911))


def test_a_page_of_too_many_parts_to_name(spark, numbered, monkeypatch):
    monkeypatch.setattr(part_pages, "FIRST_LOOK", 5)
    root, schema, parts = numbered
    got = part_pages.page_of_parts(spark, root, schema, parts, ["k", "j"], 1900, [40, 5], [F.desc("v")], most=1).orderBy("k").collect()
    assert [r.k for r in got] == list(range(41, 1941))
    assert got[0].parts_read == 21


def test_parts_that_all_overlap(spark, tmp_path):
    root = f"{tmp_path}/data"
    spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 5).alias("p")).repartition("p").write.partitionBy("p").parquet(root)
    schema = spark.read.parquet(root).schema
    parts = part_pages.part_ranges(storage.scan(spark, root, schema), ["k"])
    seen, last = [], None
    while True:
        rows = part_pages.page_of_parts(spark, root, schema, parts, ["k"], 110, last).orderBy("k").collect()
        seen += [r.k for r in rows]
        if not rows[-1].has_more:
            break
        last = [rows[-1].k]
    assert seen == list(range(300))


def test_many_parts_are_joined(spark, numbered):
    root, schema, parts = numbered
    some = parts.where(F.col("low.k") < 300).select("path")
    assert storage.read_parts(spark, root, schema, some, most=2).count() == storage.read_parts(spark, root, schema, some).count() == 300


def test_files_are_hashed_in_chunks(spark, tmp_path):
    root = f"{tmp_path}/with space+plus"
    spark.range(50).coalesce(1).write.parquet(root)
    (tmp_path / "with space+plus" / "broken.parquet").write_bytes(b"x" * (storage.CHUNK + 5))
    found = {r.path: r for r in storage.files(spark, root, content=True).collect()}
    assert len(found) == 2
    for path, r in found.items():
        with open(path, "rb") as f:
            assert r.sha256 == hashlib.sha256(f.read()).hexdigest()
        assert r.row_count == (None if path.endswith("broken.parquet") else 50)
    whole = [p for p in found if not p.endswith("broken.parquet")]
    assert [r.path for r in spark.read.parquet(whole[0]).select(storage.file_path().alias("path")).distinct().collect()] == whole


def test_a_snapshot_is_its_parts_in_any_order(spark):
    def of(rows):
        return storage.snapshot_of(spark.createDataFrame(rows, "path string, sha256 string")).first()

    rows = [(f"p{n}", f"h{n}") for n in range(50)]
    assert of(rows) == of(rows[::-1])
    assert of(rows).parts == 50
    assert of(rows).snapshot_id != of([*rows[:-1], ("p49", "other")]).snapshot_id
    assert of([]).parts == 0


TICKS = "event_type string, ts timestamp, event_id long, value double, user_id long"


def test_days_are_folded_and_no_tick_is_lost(spark, tmp_path):
    """Ten deliveries to two days, three folders a day at most: the bars are those of all ticks at once, in whatever batch they came."""
    rng = random.Random(5)
    every = [("a", START + timedelta(minutes=rng.randrange(2 * 1440)), n, float(rng.randrange(100)), 1) for n in range(200)]
    raw, checkpoint = f"{tmp_path}/raw", f"{tmp_path}/checkpoint"
    schema = spark.createDataFrame([], TICKS).schema
    for b in range(10):
        spark.createDataFrame(every[b::10], TICKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streaming.repair(streaming.tick_stream(spark, f"{tmp_path}/in", schema), raw, f"{tmp_path}/bars", checkpoint, fold=3)
        held = streaming.heads(spark, raw, b).collect()
        assert all(len(r.batches) <= 3 for r in held)
    assert held[0].batches != [0]
    got = {r.bar_ts: (r.open, r.high, r.low, r.close, r.volume) for r in streaming.repaired(spark, f"{tmp_path}/bars").collect()}
    want = {}
    for _, ts, n, value, _ in sorted(every, key=lambda e: (e[1], e[2])):
        want.setdefault(ts.replace(minute=0), []).append(value)
    assert got == {h: (v[0], max(v), min(v), v[-1], float(len(v))) for h, v in want.items()}


def test_states_go_on_after_a_restart(spark, tmp_path):
    """Samples out of order inside the delay, a run of one state over the end of a span and over a restart, one sample too late."""
    at = lambda h, m=0: START + timedelta(hours=h, minutes=m)
    first = [("x", at(0, 50), 2, "up"), ("x", at(0, 10), 1, "down"), ("y", at(0, 5), 1, "up"), ("x", at(1, 5), 3, "up")]
    second = [("x", at(1, 30), 4, "up"), ("x", at(2, 10), 5, "down"), ("x", at(0, 20), 9, "late"), ("y", at(9), 2, "up")]
    for rows in (first, second):
        spark.createDataFrame(rows, "name string, ts timestamp, seq long, state string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("name string, ts timestamp, seq long, state string").parquet(f"{tmp_path}/in")
        changes = states.span_changes(stream, "1 hour", "5 minutes", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = sorted((r.name, r.seq, r.state, r.generation) for r in states.generations(changes).collect())
    assert got == [("x", 1, "down", 1), ("x", 2, "up", 2), ("x", 5, "down", 3), ("y", 1, "up", 1)]


def test_samples_reach_the_state_in_packs(spark, tmp_path):
    """The state operator takes a row for each name and span of a lot, not one for each sample; odd values come back as they were."""
    rows = [("x", 0, 3600, 5, None, "up"), (None, 0, 3600, 1, 1, "é"), ("x", 0, 3600, 7, 2**62 + 1, None), ("x", 3600, 7200, 3600, 3, ""), ("x", 0, 3600, 5, -1, "up"), ("x", 0, 3600, 6, 9, None)]
    columns = ["name", "span", "ends_ms", "at", "seq", "state"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    lot = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=columns)
    packed = [r for batch in states._packs(iter([lot.slice(0, 2), lot.slice(2)])) for r in batch.to_pylist()]
    got = {(r["name"], r["span"], r["ends_ms"]): list(states._changed(r["samples"], r["states"])) for r in packed}
    assert len(packed) == 3
    assert got == {("x", 0, 3600): [(5, None, "up"), (6, 9, None)], (None, 0, 3600): [(1, 1, "é")], ("x", 3600, 7200): [(3600, 3, "")]}


def test_open_spans_take_samples_behind_the_watermark(spark, tmp_path):
    """Only a span that the watermark has passed is closed: neither it nor a span never seen takes later samples."""
    at = lambda h, m=0: START + timedelta(hours=h, minutes=m)
    first = [("x", at(0, 10), 1, "up"), ("x", at(1, 10), 2, "up"), ("x", at(1, 50), 4, "up")]
    second = [("x", at(1, 20), 3, "down"), ("x", at(0, 30), 9, "late"), ("y", at(0, 30), 9, "late"), ("y", at(9), 1, "up")]
    for rows in (first, second):
        spark.createDataFrame(rows, "name string, ts timestamp, seq long, state string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("name string, ts timestamp, seq long, state string").parquet(f"{tmp_path}/in")
        changes = states.span_changes(stream, "1 hour", "5 minutes", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert sorted((r.name, r.seq, r.state) for r in changes.collect()) == [("x", 1, "up"), ("x", 2, "up"), ("x", 3, "down"), ("x", 4, "up")]


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    rows = [(k, None if n % 11 == 0 else rng.choice([1.0, 2.5, rng.random() * 50])) for k in ("a", "b", None) for n in range(300)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for share in (0.0, 0.5, 0.95, 1.0):
        want = {r.k: r.q for r in df.where("v is not null").groupBy("k").agg(F.percentile("v", F.lit(share)).alias("q")).collect()}
        got = {r.k: r.quantile for r in ranges.quantiles(df, ["k"], "v", share).collect()}
        assert got == pytest.approx(want)


def test_no_values_of_quantiles_are_broadcast(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), (F.col("id") % 7).alias("v"))
    plan = ranges.quantiles(df, ["k"], "v", 0.95)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert all("LeftSemi, BuildRight" in line for line in joins), joins


def test_retries_stand_breadth_first(spark, tmp_path):
    """Random trees with tied times, a long chain, a cycle of two with a run behind it, and a run whose predecessor is unknown, against a queue."""
    rng = random.Random(11)
    log = {n: (START + timedelta(minutes=rng.randrange(30)), rng.randrange(n) if n % 20 else None) for n in range(120)}
    log |= {200 + n: (START, 199 + n if n else None) for n in range(40)}
    log |= {300: (START, 301), 301: (START, 300), 302: (START, 301), 303: (START, 999)}
    df = spark.createDataFrame([(k, at, up) for k, (at, up) in log.items()], "run_id long, created_at timestamp, retry_of long")
    want = {}
    for root in (k for k, (_, up) in log.items() if up not in log):
        queue, depth = [root], {root: 0}
        for n, run in enumerate(queue):
            want[run] = (root, depth[run], n, "retry" if depth[run] else "origin")
            for child in sorted((k for k, (_, up) in log.items() if up == run), key=lambda k: (log[k][0], k)):
                queue.append(child)
                depth[child] = depth[run] + 1
    got = {r.run_id: r for r in runs.retry_order(df, f"{tmp_path}/work").collect()}
    assert len(got) == len(log)
    assert {k: (r.root, r.depth, r.place, r.relation) for k, r in got.items() if not r.cycle} == want
    assert all(r.place is None for r in got.values() if r.cycle)
    assert {k for k, r in got.items() if r.cycle} == {300, 301, 302}


def test_runs_without_one_above_lie_in_many_tasks(spark, tmp_path, monkeypatch):
    """Most runs have none above them: a join on that alone would put all of these in one task."""
    held, places = [], runs._places

    def kept(df, keys, order, name):
        if "above" in df.columns:
            held.append(max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()))
        return places(df, keys, order, name)

    monkeypatch.setattr(runs, "_places", kept)
    df = spark.createDataFrame([(n, START, n - 1 if n in (1, 2, 3) else None) for n in range(400)], "run_id long, created_at timestamp, retry_of long")
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        assert runs.retry_order(df, f"{tmp_path}/work").count() == 400
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert held and max(held) < 200
