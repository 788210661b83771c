"""Frame slots: load shedding by a ring of slots, as a batch over ranges of ticks and as a keyed stream; file name streams."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from tessera.session import ship, written

TICKS = "tick long, service_ms double"


def with_slot(ticks: DataFrame, slots: int) -> DataFrame:
    """Slots go round whether a tick is kept, dropped or fails."""
    return ticks.withColumn("slot", (F.col("tick") % slots).cast("int"))


def spread(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows in the order of keys and `order`, in ranges that may cut a key: with __key, __p (the range) and __id (ascending)."""
    at = rows.withColumn("__key", F.struct(*keys))
    at = at.repartitionByRange("__key", *order).sortWithinPartitions("__key", *order)
    return written(at.withColumns({"__p": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}), "ranges")


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their number within a key, from 0: counted by range, so that no task needs a key whole."""
    at = spread(rows, keys, order)
    heads = at.groupBy("__key", "__p").agg(F.min("__id").alias("lo"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__key").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select("__key", "__p", (F.coalesce(before, F.lit(0)) - F.col("lo")).alias("shift"))
    return at.join(heads, ["__key", "__p"]).withColumn(name, F.col("__id") + F.col("shift")).select(*rows.columns, name)


def successors(rows: DataFrame) -> DataFrame:
    """(id, next): for rows with `ask`, the first later one of those without that is at `busy` or after; null if none.

    rows: __key, id, at, busy, ask.
    """
    # a row that takes no time is followed by the next one, also one of the same tick; else busy comes before all rows of its time
    asks = rows.where("ask AND busy IS NOT NULL").select("__key", F.greatest("busy", "at").alias("pos"), F.when(F.col("busy") <= F.col("at"), F.col("id")).otherwise(-1).alias("tie"), F.lit(1).alias("ask"), F.col("id").alias("asker"), F.lit(None).cast("long").alias("row"))
    both = asks.unionByName(rows.where("NOT ask").select("__key", F.col("at").alias("pos"), F.col("id").alias("tie"), F.lit(0).alias("ask"), F.lit(None).cast("long").alias("asker"), F.col("id").alias("row")))
    at = spread(both.withColumnRenamed("__key", "key"), ["key"], ["pos", "tie", "ask"])
    later = Window.partitionBy("__key", "__p").orderBy(F.desc("__id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = Window.partitionBy("__key").orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, -1)
    heads = at.groupBy("__key", "__p").agg(F.min("row").alias("head"))
    heads = heads.select("__key", "__p", F.last("head", True).over(beyond).alias("beyond"))
    found = at.withColumn("near", F.last("row", True).over(later)).where("ask = 1")
    return found.join(heads, ["__key", "__p"]).select(F.col("asker").alias("id"), F.coalesce("near", "beyond").alias("next"))


def taken_after(f: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """For each slot's ticks in a range, sorted: where they start, and of each the next that the slot takes after it, or their number."""
    slot, at, busy = f["slot_id"].to_numpy(), f["at"].fillna(-np.inf).to_numpy(), f["busy"].fillna(np.inf).to_numpy()
    edges = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1], [True]]))
    for s, e in zip(edges, edges[1:]):  # noqa: B905
        yield int(s), np.maximum(np.searchsorted(at[s:e], busy[s:e]), np.arange(e - s) + 1)


def shed(ticks: DataFrame, slots: int, period_ms: int = 250, run: str | None = None, hops: int = 50) -> DataFrame:
    """ticks (tick, service_ms, and a run's key) with kept: a tick is dropped while its slot works on an earlier one.

    The tick that a slot takes after a kept one is fixed by that one alone. A range of ticks is gone through in its task
    from the tick at which the slot enters it. Where ranges cut a slot, these entries are found first: every tick of such
    a slot leads to a last kept one in its range, of which few differ, and pointer doubling goes from range to range over
    these (2^hops ranges at most). No task needs a slot whole.
    """
    keys = ([run] if run else []) + ["slot"]
    at = spread(with_slot(ticks, slots).select(*keys, "tick", "service_ms"), keys, ["tick", "service_ms"])
    at = at.withColumn("at", (F.col("tick") * period_ms).cast("double")).withColumn("busy", F.col("at") + F.col("service_ms")).withColumnRenamed("__id", "id")
    heads = written(at.where("at >= -1").groupBy("__key", "__p").agg(F.min("id").alias("id")), "heads")
    cut = written(heads.groupBy("__key").agg(F.count("*").alias("n"), F.min("__p").alias("__p")).where("n > 1"), "cut")
    entries = heads.join(cut.select("__key"), "__key", "left_anti").unionByName(heads.join(cut.select("__key", "__p"), ["__key", "__p"], "left_semi"))
    if not cut.isEmpty():
        entries = entries.unionByName(_entries(at, heads, cut, hops)).groupBy("__key", "__p").agg(F.min("id").alias("id"))
    placed = at.join(entries.withColumnRenamed("id", "entry"), ["__key", "__p"], "left")
    names = [*keys, "tick", "service_ms"]
    kinds = T.StructType([*placed.select(*names).schema.fields, T.StructField("kept", T.BooleanType())])
    ship(at.sparkSession)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come range by range and slot by slot; of a slot only its key and when it is free again are known
        key, free = None, None
        for batch in batches:
            kept = []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            own = list(zip(columns[len(names)], *columns[: len(keys)], strict=True))
            for k, (row, entry, at_, busy) in zip(own, zip(*columns[len(names) + 1 :], strict=True), strict=True):
                if k != key:
                    key, free = k, None
                kept.append(row == entry or free is not None and at_ is not None and at_ >= free)
                if kept[-1]:
                    free = math.inf if busy is None else busy
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(kept, pa.bool_())], names=[*names, "kept"])

    return placed.repartition("__p").sortWithinPartitions("__p", "id").select(*names, "__p", "id", "entry", "at", "busy").mapInArrow(mark, kinds)


def _with_slot_id(at: DataFrame) -> DataFrame:
    """at with slot_id, equal for neighbours of one key: its first id in the range."""
    ship(at.sparkSession)
    return at.withColumn("slot_id", F.min("id").over(Window.partitionBy("__key", "__p")))


def _entries(at: DataFrame, heads: DataFrame, cut: DataFrame, hops: int) -> DataFrame:
    """(__key, __p, id): the tick at which a slot enters each of its ranges that it works in, for slots cut by ranges."""
    own = at.join(cut.select("__key"), "__key", "left_semi")

    def ends(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        last = np.arange(len(f))
        for s, after in taken_after(f):
            for i in range(len(after) - 1, -1, -1):
                if after[i] < len(after):
                    last[s + i] = last[s + after[i]]
        return f[["id"]].assign(last=f["id"].to_numpy()[last])

    found = _with_slot_id(own).groupBy("__p").applyInPandas(ends, "id long, last long")
    ended = written(own.select("__key", "__p", "id").join(found, "id"), "ends")
    lasts = own.join(ended.select(F.col("last").alias("id")).distinct(), "id", "left_semi").select("__key", "id", "at", "busy")
    # from a last tick to the last one of the range in which the slot goes on
    goes = successors(lasts.withColumn("ask", F.lit(True)).unionByName(own.select("__key", "id", "at", "busy").withColumn("ask", F.lit(False)))).where("next IS NOT NULL")
    step = written(goes.join(ended.select(F.col("id").alias("next"), "last"), "next").select("id", F.col("last").alias("to"), "next"), "steps")
    starts = heads.join(cut.select("__key", "__p"), ["__key", "__p"], "left_semi").join(ended.select("id", "last"), "id")
    reached, links = written(starts.select(F.col("last").alias("id")), "reached"), step.select("id", "to")
    for _ in range(hops):
        if links.isEmpty():
            break
        reached = written(reached.unionByName(reached.join(links, "id").select(F.col("to").alias("id"))).distinct(), "reached")
        links = written(links.join(links.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")), "jumps")
    else:
        raise RuntimeError("a slot is cut by more than 2^hops ranges")
    return step.join(reached, "id", "left_semi").select(F.col("next").alias("id")).join(ended.select("__key", "__p", "id"), "id").select("__key", "__p", "id")


def shed_stream(ticks: DataFrame, slots: int, period_ms: int = 250, run: str | None = None) -> DataFrame:
    """The same on a stream: the state of a slot, of each run where runs have a key, is when it is free again."""
    keys = ([run] if run else []) + ["slot"]
    schema = with_slot(ticks, slots).select(*keys, "tick", "service_ms").schema.add("kept", "boolean")

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        busy = state.get[0] if state.exists else -1.0
        rows = pd.concat(list(frames)).sort_values("tick")
        kept = []
        for tick, ms in zip(rows["tick"], rows["service_ms"], strict=True):
            at = float(tick * period_ms)
            kept.append(at >= busy)
            if kept[-1]:
                busy = at + ms
        state.update((busy,))
        yield rows.assign(kept=kept)[schema.names]

    ship(ticks.sparkSession)
    return with_slot(ticks, slots).select(*keys, "tick", "service_ms").groupBy(*keys).applyInPandasWithState(update, schema, "busy double", "append", "NoTimeout")


class SlotProcessor(StatefulProcessor):
    """Keeps, of each slot, when it is free again; forgets it where no tick comes for idle_ms, as the slot is free then."""

    def __init__(self, names: list[str], period_ms: int, idle_ms: int | None):
        self.names, self.period_ms, self.idle_ms = names, period_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.free = handle, handle.getValueState("free", "at double, seen long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._keep(float(initialState["free"].max()), timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        free, seen = self.free.get() if self.free.exists() else (-1.0, -1)
        if self.idle_ms is not None and timerValues.getCurrentProcessingTimeInMs() - seen > self.idle_ms:
            free = -1.0  # rows may come in the batch in which the timer expires
        found = pd.concat(list(rows)).sort_values(["tick", "service_ms"], na_position="first")
        kept = []
        for tick, ms in zip(found["tick"], found["service_ms"], strict=True):
            at = math.nan if pd.isna(tick) else float(tick) * self.period_ms
            kept.append(at >= free)  # a missing tick is never kept
            if kept[-1]:
                free = math.inf if pd.isna(ms) else at + ms
        self._keep(free, timerValues)
        yield found.assign(kept=kept)[self.names]

    def _keep(self, free: float, timerValues) -> None:
        self.free.update((free, timerValues.getCurrentProcessingTimeInMs()))
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.free.clear()
        return iter([])

    def close(self) -> None:
        pass


def free_again(kept: DataFrame, period_ms: int = 250, run: str | None = None) -> DataFrame:
    """(run, slot, free): when each slot of shed ticks is free again; it seeds a stream that goes on where a batch ended."""
    at = F.col("tick") * period_ms + F.coalesce("service_ms", F.lit(math.inf))
    return kept.where("kept").groupBy(*([run] if run else []), "slot").agg(F.max(at.cast("double")).alias("free"))


def shed_keyed(ticks: DataFrame, slots: int, period_ms: int = 250, run: str | None = None, initial: DataFrame | None = None, idle_ms: int | None = None) -> DataFrame:
    """shed on a stream, with keyed state that a batch may seed (free_again) and that goes idle_ms after a slot's last tick.

    Ticks of a batch are taken in their order; a batch's ticks come after those of earlier ones. The session's state store
    has to be RocksDB (spark.sql.streaming.stateStore.providerClass). With idle_ms, Spark goes on making batches as time
    passes, so the trigger availableNow doesn't end.
    """
    keys = ([run] if run else []) + ["slot"]
    rows = with_slot(ticks, slots).select(*keys, "tick", "service_ms")
    schema = T.StructType([*rows.schema.fields, T.StructField("kept", T.BooleanType())])
    ship(ticks.sparkSession)
    seed = initial.select(*keys, "free").groupBy(*keys) if initial is not None else None
    return rows.groupBy(*keys).transformWithStateInPandas(SlotProcessor(schema.names, period_ms, idle_ms), schema, "Append", "None" if idle_ms is None else "ProcessingTime", seed)


def latency(frames: DataFrame) -> DataFrame:
    """Nanoseconds from start to end, and by frame rate."""
    return frames.withColumn("elapsed_ns", F.col("end_ns") - F.col("start_ns"))


def name_stream(spark: SparkSession, folder: str, since: datetime | None = None) -> DataFrame:
    """File names that producers announce: a line each, trimmed, blank ones left out.

    A subscriber who joins at `since` misses what was announced before.
    """
    lines = spark.readStream.text(folder)
    if since is not None:
        lines = lines.where(F.col("_metadata.file_modification_time") >= F.lit(since))
    return lines.select(F.trim(F.regexp_replace("value", r"[\r\n]+$", "")).alias("name")).where("length(name) > 0")


def announce(names: DataFrame, folder: str) -> None:
    names.select(F.col("name").alias("value")).write.mode("append").text(folder)


def run_available(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Work off what is there, into an in-memory table."""
    stream.writeStream.format("memory").queryName(table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def tick_stream(spark: SparkSession, start: datetime, period_ms: int = 250) -> DataFrame:
    """Ticks (tick, at) of a fixed cadence from `start` on: after a stall the missed ones come late, and none is left out.

    The rate source only wakes the query up; what a batch holds follows from the clock.
    """
    woken = spark.readStream.format("rate").option("rowsPerSecond", 1000 // period_ms or 1).load()
    first = F.lit(start)
    return woken.where(F.col("timestamp") >= first).select(F.col("value").alias("tick"), (first + F.make_interval(secs=F.col("value") * period_ms / 1000)).alias("at"))


def run_cadence(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, period_ms: int = 250) -> StreamingQuery:
    """Start a query that hands a batch to `write` every period."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{period_ms} milliseconds").start()


class Progress(StreamingQueryListener):
    """A sink of metrics: (query, batch, rows, rows a second) of each batch, handed to `report`."""

    def __init__(self, report: Callable[[str, int, int, float], None] = print):
        self.report = report

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.report(p.name or str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def ticks_until(spark: SparkSession, seconds: int = 10, period_ms: int = 250) -> DataFrame:
    """Ticks of a bounded capture: whole seconds are compared, so the last one still counts."""
    return spark.range(0, seconds * 1000 // period_ms + 1).withColumnRenamed("id", "tick")


#: The states that a slot goes through.
STATES = ("FREE", "RAW_READY", "IN_PROGRESS", "QUANT_DONE", "SERIALIZING")


def transitions(kept: DataFrame) -> DataFrame:
    """(…, step, from_state, to_state) for every kept tick: its slot goes once round the states."""
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(a).alias("from_state"), F.lit(b).alias("to_state")) for i, (a, b) in enumerate(zip(STATES, (*STATES[1:], STATES[0]), strict=True))])
    return kept.where("kept").withColumn("s", F.explode(steps)).select("*", "s.*").drop("s")


def serve_next(ready: DataFrame, state: str, by: list[str] | None = None) -> DataFrame:
    """The slot that a worker takes next: the lowest one in the wanted state, whatever the order of arrival."""
    own = ready.where(F.col("state") == state)
    return own.groupBy(*(by or [])).agg(F.min("slot").alias("slot"))
