"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a DataFrame join over the edges; each round is written to the shared folder, so lineage stays short
and nothing but a flag comes to the driver. The number of rounds is logarithmic in practice. The minimum of a node with
very many edges is combined map-side, and the join that brings it to these edges has one row a node on its other side, so
adaptive execution can split it.

Before the steps, and between them, tasks contract the edges: each joins what up to EDGES of its edges connect and keeps a
star of each part. This loses no connection and saves most steps, of which each is a plan of several shuffles on the driver.
Where EDGES or fewer are left, one such star is all that there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare, tidy, written

#: Edges that a task joins at once.
EDGES = 1 << 18


def star_edges(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part that the edges connect, an edge from every other node to its smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        # a root with a smaller one beside it goes below that, so at most half of a part's roots stay
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u > v) that connect the same nodes: stars of what up to EDGES of a task's edges connect."""
    most = EDGES

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in held]) for k in (0, 1))
        u, v = star_edges(u, v)
        return pa.RecordBatch.from_arrays([pa.array(u, held[0].schema.types[0]), pa.array(v, held[0].schema.types[0])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy():
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= most:
                    yield joined(held)
                    held, n = [], 0
            if n:
                yield joined(held)

    prepare(edges.sparkSession)
    return edges.select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """One step on edges (u > v). both: large-star, over all neighbours; else small-star, over the smaller ones."""
    sides = edges.select("u", "v")
    if both:
        sides = sides.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("m", "u").alias("m"))
    out = sides.join(least, "u")
    out = out.where("v > u") if both else out
    out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not both:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every component is one star: no node has two edges up to a root, and no root has one itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, root) for every node with an edge, where root is the smallest node of its component.

    Null ends and loops are left out; repeated edges don't matter; no edges give an empty result.
    Raises if `rounds` steps don't converge.
    """
    cur = edges.where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    cur = written(_contracted(cur), "edges")  # finding the edges may be dear; the steps read them more than once
    for _ in range(rounds):
        n = cur.count()
        # a batch of Arrow may overshoot, so n edges fit a task where n is below EDGES
        cur = written(_contracted(cur.coalesce(max(1, -(-n // EDGES)))), "contracted")
        if n < EDGES or _settled(cur):
            leaf = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return leaf.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        cur = written(_stars(_stars(cur, True), False), "components")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
