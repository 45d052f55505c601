"""A state operator: samples of named things to the changes of their state, across batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemark.operators.runs import transitions

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOT = 1 << 18  #: samples that a task packs at once
SAMPLE = np.dtype([("at", "<i8"), ("seq", "<i8"), ("numbered", "?"), ("size", "<i4")])  #: a sample in a pack; its state's bytes, -1 for none, stand in a row of their own


class Spans(StatefulProcessor):
    """Samples of one name and span of time, kept until the watermark has passed the span; then its changes go out.

    A name that has most of all samples is spread over its spans, so a task holds those of one span at a time. Samples come
    and are kept in packs, and a span is ordered as columns: no sample is an object by itself.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.packs = handle.getListState("packs", "samples binary, states binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        while some := list(islice(rows, 64)):
            if some[0].ends_ms <= timerValues.getCurrentWatermarkInMs() and not self.packs.exists():
                break  # the span has gone out
            self.packs.appendList([(r.samples, r.states) for r in some])
            self.handle.registerTimer(some[0].ends_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        samples, states = zip(*self.packs.get(), strict=True)
        self.packs.clear()
        for at, seq, state in _changed(b"".join(samples), b"".join(states)):
            yield Row(name=key[0], span=key[1], at=at, seq=seq, state=state)

    def close(self) -> None:
        pass


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples as a row for each name and span of a lot."""
    lot = []
    for batch in batches:
        lot += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in lot) >= LOT:
            yield _packed(pa.Table.from_batches(lot))
            lot = []
    if lot:
        yield _packed(pa.Table.from_batches(lot))


def _packed(rows: pa.Table) -> pa.RecordBatch:
    name, span = rows["name"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(), rows["span"].to_numpy()
    order = np.lexsort((span, name))
    name, span, rows = name[order], span[order], rows.take(pa.array(order))
    new = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (span[1:] != span[:-1])])
    state = rows["state"].combine_chunks()
    texts = pa.array(state.fill_null(""), pa.binary())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    samples = np.empty(len(order), SAMPLE)
    samples["at"], samples["seq"], samples["numbered"] = rows["at"], rows["seq"].fill_null(0), rows["seq"].is_valid()
    samples["size"] = np.where(state.is_valid(), np.diff(ends), -1)
    cuts = np.r_[new, len(order)]
    lists = [pa.BinaryArray.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(at.astype(np.int32)), data]) for at, data in ((cuts * SAMPLE.itemsize, pa.py_buffer(samples.tobytes())), (ends[cuts], texts.buffers()[2] or pa.py_buffer(b"")))]
    first = rows.take(pa.array(new))
    return pa.RecordBatch.from_arrays([*(first[c].combine_chunks() for c in ("name", "span", "ends_ms")), *lists], names=["name", "span", "ends_ms", "samples", "states"])


def _changed(samples: bytes, states: bytes) -> Iterator[tuple]:
    """(at, seq, state) of the first of a span's samples, and of those whose state differs from the one before; a sample without a number comes first."""
    rows = np.frombuffer(samples, SAMPLE)
    ends = np.r_[0, np.maximum(rows["size"], 0).cumsum(dtype=np.int64)]
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(states)])
    code = np.where(rows["size"] < 0, -1, texts.dictionary_encode().indices.to_numpy())
    order = np.lexsort((rows["seq"], rows["numbered"], rows["at"]))
    code = code[order]
    for i in order[np.r_[True, code[1:] != code[:-1]]].tolist():
        r = rows[i]
        yield int(r["at"]), int(r["seq"]) if r["numbered"] else None, states[ends[i] : ends[i + 1]].decode() if r["size"] >= 0 else None


def span_changes(samples: DataFrame, span: str, lag: str, target: str, checkpoint: str) -> DataFrame:
    """A stream of samples (name, ts, seq, state) to the changes inside each span of time (name, span, ts, seq, state), the first sample of a span among them.

    Spans go out once the watermark, ``lag`` behind the latest stamp, has passed their ends; samples that come later than
    that are left out, and those of a span that is open still are not. A later call goes on where this ended, with the samples of the spans that are open still.
    """
    spark = samples.sparkSession
    spans = F.window("ts", span)
    # times as numbers: the processor's clock has milliseconds
    rows = samples.withWatermark("ts", lag).withColumn("w", spans)
    rows = rows.select("name", F.unix_micros("w.start").alias("span"), F.unix_millis("w.end").alias("ends_ms"), F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), "state")
    rows = rows.mapInArrow(_packs, "name string, span long, ends_ms long, samples binary, states binary")
    out = rows.groupBy("name", "span").transformWithState(Spans(), outputStructType="name string, span long, at long, seq long, state string", outputMode="Append", timeMode="eventTime")
    out = out.select("name", F.timestamp_micros("span").alias("span"), F.timestamp_micros("at").alias("ts"), "seq", "state")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # the only store with lists and timers; read when the query starts
    try:
        query = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema("name string, span timestamp, ts timestamp, seq long, state string").parquet(target)


def generations(changes: DataFrame) -> DataFrame:
    """Changes of whole names out of those inside spans: (name, ts, seq, state, generation); one row for each name and span tells the state it ends with."""
    rows = changes.withColumn("at", F.struct("ts", "seq"))
    return transitions(rows, ["name"], "at", "state", "span").select("name", "ts", "seq", "state", "generation")
