"""Connected components of runs.

Vertices are runs, edges overlaps of runs in adjacent rows, so there are far fewer of both than pixels. Frames of any
height are cut into strips of rows; a strip is labelled in one task, and labels of strips that touch are united by joins
over the runs of the border rows alone. relational_components does all of it by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ship, written

SPAN, STRIP = 64, 4096


def numbered(runs: DataFrame) -> DataFrame:
    """A run_id from the place: runs of a frame never share a first pixel."""
    return runs.withColumn("run_id", F.col("y").cast("long") * 1_048_576 + F.col("x1"))


def overlaps(runs: DataFrame, eight: bool = False) -> DataFrame:
    """(frame_id, a, b): pairs of runs of equal value in adjacent rows that touch; eight: also at corners.

    A range join on buckets of SPAN pixels, so no row of very many runs meets another whole.
    """
    d = 1 if eight else 0
    upper = runs.select("frame_id", "value", F.col("y").alias("y"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("run_id").alias("a"))
    upper = upper.withColumn("bucket", F.explode(F.sequence(F.expr(f"greatest(p1 - {d}, 0) div {SPAN}"), F.expr(f"(p2 + {d}) div {SPAN}"))))
    lower = runs.select("frame_id", "value", (F.col("y") - 1).alias("y"), F.col("x1").alias("c1"), F.col("x2").alias("c2"), F.col("run_id").alias("b"))
    lower = lower.withColumn("bucket", F.explode(F.sequence(F.expr(f"c1 div {SPAN}"), F.expr(f"c2 div {SPAN}"))))
    met = upper.join(lower, ["frame_id", "value", "y", "bucket"]).where((F.col("p1") <= F.col("c2") + d) & (F.col("p2") + d >= F.col("c1")))
    # a pair meets in the bucket of its overlap's first pixel, once
    start = F.greatest(F.col("p1") - d, F.col("c1"), F.lit(0))
    return met.where(F.floor(start / SPAN) == F.col("bucket")).select("frame_id", "a", "b")


def least_reachable(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest of n items that each reaches by the pairs: roots hook on to lower ones, then paths are halved."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def frame_pairs(y: np.ndarray, x1: np.ndarray, x2: np.ndarray, value: np.ndarray, eight: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs that touch, as overlaps() has them, by binary search in the next row; value: of one frame and colour."""
    d = 1 if eight else 0
    wide, high = int(x2.max()) + 4, int(y.max()) + 2
    row = (np.unique(value, return_inverse=True)[1] * high + y) * wide
    order = np.argsort(row + x1, kind="stable")
    first, last = (row + x1 + 1)[order], (row + x2 + 1)[order]
    low = np.searchsorted(last, row + wide + x1 + 1 - d)
    n = np.maximum(np.searchsorted(first, row + wide + x2 + 1 + d, side="right") - low, 0)
    n[(y + 1 >= high)] = 0
    ends = np.cumsum(n)
    return np.repeat(np.arange(len(y)), n), order[np.repeat(low - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def _new_parts(frame: np.ndarray, y: np.ndarray, strip: int | None) -> np.ndarray:
    """For each row but the first, of rows sorted by frame and y: whether it begins another frame or strip."""
    new = frame[1:] != frame[:-1]
    return new | (y[1:] // strip != y[:-1] // strip) if strip else new


def _whole_parts(batches: Iterator[pa.RecordBatch], frame: int, y: int, strip: int | None) -> Iterator[pa.Table]:
    """Tables of sorted batches, of whole frames or strips: many small ones are labelled at once, a large one alone."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            ends = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for b in (last, batch)]) for k in (frame, y)]
        else:
            ends = [np.concatenate([c[:1], c]) for c in (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (frame, y))]
        cuts = np.flatnonzero(_new_parts(*ends, strip))
        if len(cuts):
            # the last part may go on in the next batch
            cut = int(cuts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
            batch = batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def components(runs: DataFrame, eight: bool = False, strip: int | None = None) -> DataFrame:
    """runs with component, the smallest run_id of each component.

    A frame is labelled in one task, as pictures are of bounded height; where frames aren't, `strip` rows of one are.
    """

    ship(runs.sparkSession)
    names = runs.columns
    at = {c: names.index(c) for c in ("frame_id", "y", "x1", "x2", "value", "run_id")}

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_parts(batches, at["frame_id"], at["y"], strip):
            frame, y, x1, x2, value, run_id = (table.column(at[c]).to_numpy().astype(np.int64) for c in at)
            part = np.cumsum(np.concatenate([[0], _new_parts(frame, y, strip)]))
            # rows are counted from each part's first one, so that numbers stay small
            low = y[np.searchsorted(part, np.arange(part[-1] + 1))]
            of = part * (int(value.max()) - int(value.min()) + 1) + value - value.min()
            i, j = frame_pairs(y - low[part], x1, x2, of, eight)
            yield from table.append_column("component", pa.array(run_id[least_reachable(i, j, len(y))])).combine_chunks().to_batches()

    keys = ["frame_id", *([F.expr(f"y div {strip}")] if strip else [])]
    schema = T.StructType([*runs.schema.fields, T.StructField("component", T.LongType())])
    found = runs.repartition(*keys).sortWithinPartitions("frame_id", "run_id").mapInArrow(label, schema)
    if strip is None:
        return found
    labelled = written(found, "strips")
    edge = labelled.where(f"y % {strip} = 0 or y % {strip} = {strip - 1}")
    names = edge.select("frame_id", "run_id", "component")
    met = overlaps(edge.where(f"y % {strip} = {strip - 1}").unionByName(edge.where(f"y % {strip} = 0")), eight)
    pairs = met.join(names.withColumnsRenamed({"run_id": "a", "component": "ca"}), ["frame_id", "a"]).join(names.withColumnsRenamed({"run_id": "b", "component": "cb"}), ["frame_id", "b"])
    pairs = pairs.where("ca <> cb").select("frame_id", F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    nodes = pairs.select("frame_id", F.col("a").alias("run_id")).unionByName(pairs.select("frame_id", F.col("b").alias("run_id"))).distinct()
    roots = united(nodes, pairs).select("frame_id", F.col("run_id").alias("component"), F.col("component").alias("root"))
    out = labelled.join(roots, ["frame_id", "component"], "left")
    return out.withColumn("component", F.coalesce("root", "component")).select(*runs.columns, "component")


def relational_components(runs: DataFrame, eight: bool = False, rounds: int = 50) -> DataFrame:
    """The same by joins alone."""
    return runs.join(united(runs.select("frame_id", "run_id"), overlaps(runs, eight), rounds), ["frame_id", "run_id"])


def united(nodes: DataFrame, pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """nodes (frame_id, run_id) with the least run_id that pairs (a, b) lead to, as component.

    Labels fall to the least neighbour's, then jump to their label's label, until none changes.
    """
    both = written(pairs.unionByName(pairs.select("frame_id", F.col("b").alias("a"), F.col("a").alias("b"))), "pairs")
    labels = nodes.withColumn("component", F.col("run_id"))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("run_id", "b"), ["frame_id", "b"]).groupBy("frame_id", "a").agg(F.min("component").alias("low"))
        low = labels.join(near.withColumnRenamed("a", "run_id"), ["frame_id", "run_id"], "left").select("frame_id", "run_id", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        jump = low.select("frame_id", F.col("run_id").alias("component"), F.col("component").alias("further"))
        new = low.join(jump, ["frame_id", "component"], "left").select("frame_id", "run_id", "old", F.least("component", "further").alias("component"))
        new = written(new, "labels")
        labels = new.drop("old")
        if new.where("old <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def boxes(labelled: DataFrame, *more: Column) -> DataFrame:
    """Bounding box and area of each component, and more aggregates of its runs."""
    return labelled.groupBy("frame_id", "component", "value").agg(
        F.min("x1").alias("minx"), F.min("y").alias("miny"), F.max("x2").alias("maxx"), F.max("y").alias("maxy"), F.sum(F.col("x2") - F.col("x1") + 1).cast("long").alias("cnt"), F.count("*").alias("runs"), *more
    )
