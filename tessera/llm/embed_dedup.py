"""Embedding near-duplicates by sorted projection passes, as many as one bound on misses asks for.

A pass has random hyperplanes of its own; a vector's hashes are the signs of its products with them. Of the order by these
signs, concatenated, only the first `bits` are made: a vector's window is the run that shares them, and no order is kept
within a run, so windows never end at a partition's border. `bits` follows the count of distinct vectors, which bounds the
window where vectors are spread: a run holds about BUCKET. A longer run, at a dense place, isn't cut off but compared in
blocks that meet in separate tasks, with the square of its size; a window of fixed length there would lose links.

The number of passes follows `bits`: a pair exactly at the threshold agrees in a sign with probability 1 - angle / pi,
whatever lies around it, so that no pass brings it together with probability MISS at most, at every size and density.
Closer pairs are missed far less, and a chain of found links also brings ends together. Up to BUCKET vectors there is one
run and nothing is missed. A link joins only vectors of one component, so an exact check then counts every vector's links
within its component without emitting pairs, in blocks: of about BLOCK vectors up to SPREAD blocks, then of ever more, up
to BLOCK_BYTES, so that rows of a component of b bytes are copied b / BLOCK_BYTES times at most.

Vectors that are null, zero, or have null or non-finite components link with nothing, nor do vectors of different
lengths, nor rows with a null id. Equal vectors are one class with a count, so copies don't multiply. A repeated id counts
as another vector, whether its vectors are equal or not. An empty table gives an empty one; columns beside vec_id and
embedding are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import prepare, slices, tidy, written
from tessera.llm.components import connected_components

MISS, BUCKET, BLOCK, SPREAD = 0.001, 512, 128, 32
#: Rows of a long run's blocks: many small ones up to SPREAD blocks, then larger ones, so that copies of rows stay few.
HALL, HALLS = 1024, 8192
#: Bytes of a component's largest blocks, in double precision.
BLOCK_BYTES = 32 << 20


def valid_vectors(column: pa.Array, kind: str) -> list[bytes | None]:
    """Each vector as the bytes of its floats or doubles, or null if it can't link."""
    out: list[bytes | None] = []
    values = column.values.cast(pa.float64()) if len(column) else None
    offsets = column.offsets.to_numpy() if len(column) else []
    flat = values.to_numpy(zero_copy_only=False) if values is not None else np.zeros(0)
    missing = column.is_null().to_numpy(zero_copy_only=False)
    for i, null in enumerate(missing):
        x = flat[offsets[i] : offsets[i + 1]]
        ok = not null and len(x) and np.isfinite(x).all() and 0 < float(x @ x) < np.inf
        out.append(x.astype(kind).tobytes() if ok else None)
    return out


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def float_kind(vectors: DataFrame) -> str:
    """How vectors travel: as they came, in four bytes or eight a component; all arithmetic is in double precision."""
    return "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


def planes(seed: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, 64))


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, d1, d2; null digests if the vector can't link), and classes (cid, least, n, d1, d2, vec).

    A class is told by its digests and has a number of its own, as one id may stand for two vectors; least is its smallest id.
    """
    prepare(vectors.sparkSession)
    floats = float_kind(vectors)

    def run(batches):
        with tidy():
            for batch in slices(batches, 4096):
                column = batch.column(1)
                column = pa.concat_arrays([column])  # offsets from zero
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(valid_vectors(column, floats), pa.binary())], names=["vec_id", "vec"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    made = vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, vec binary")
    usable = F.col("vec").isNotNull() & F.col("vec_id").isNotNull()
    made = made.select("vec_id", F.when(usable, F.col("vec")).alias("vec")).select("vec_id", "vec", F.when(usable, F.xxhash64("vec")).alias("d1"), F.when(usable, F.crc32("vec")).alias("d2"))
    rows = written(made, "vectors")
    classes = rows.where("vec IS NOT NULL").groupBy("d1", "d2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    return rows.select("vec_id", "d1", "d2"), written(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")


def block_links(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    return x @ y.T >= least


def _unite(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest member that each of n items reaches by the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tables_for(n: int, least: float = 0.9, miss: float = MISS) -> tuple[int, int]:
    """(bits, passes): a pair at the cosine `least` among n vectors meets in no pass with probability `miss` at most."""
    bits = min(64, max(0, math.ceil(math.log2(max(n, 1) / BUCKET))))
    meets = (1 - math.acos(least) / math.pi) ** bits
    return bits, 1 if meets == 1 else math.ceil(math.log(miss) / math.log1p(-meets))


def in_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], list[tuple[int, int]]]]:
    """Columns of sorted rows, and where whole groups of equal first `keys` columns start and end in them."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy() for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
        new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)])
        at = np.flatnonzero(new)
        rest = [c[at[-1] :] for c in cols]
        if len(at) > 1:
            yield cols, list(zip(at, at[1:]))  # noqa: B905
    if rest is not None:
        yield rest, [(0, len(rest[0]))]


def projection_edges(classes: DataFrame, floats: str, least: float = 0.9, miss: float = MISS) -> DataFrame:
    """(a, b): verified edges between class numbers, found in the windows of each pass."""
    bits, tables = tables_for(classes.count(), least, miss)

    def keys(batches):
        with tidy():
            for batch in slices(batches, 2048):
                raw = batch.column(1).to_pylist()
                n = len(raw)
                out = np.zeros((n, tables), np.int64)
                size = np.array([len(r) for r in raw], np.int32)
                for dim in set(size.tolist()) if bits else ():
                    at = np.flatnonzero(size == dim)
                    x = unit_rows([raw[i] for i in at], floats)
                    for t in range(tables):
                        signs = np.packbits(x @ planes(t, x.shape[1]) > 0, axis=1).view(">u8").astype(np.uint64)[:, 0]
                        out[at, t] = (signs >> np.uint64(64 - bits)).view(np.int64)
                each = pa.array(np.repeat(np.arange(n), tables))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(np.repeat(size, tables)), pa.array(out.reshape(-1)), batch.column(0).take(each), batch.column(1).take(each)],
                    names=["p", "dim", "key", "cid", "vec"],
                )

    place = ["p", "dim", "key"]
    keyed = classes.select("cid", "vec").mapInArrow(keys, "p int, dim int, key long, cid long, vec binary")
    # only runs of more than one block are looked up again: few, and none where vectors are spread
    large = written(keyed.groupBy(*place).agg(F.count("*").alias("m")).where(F.col("m") > HALL), "long-runs")
    blocks = F.least(F.ceil(F.col("m") / HALL), F.greatest(F.lit(SPREAD), F.ceil(F.col("m") / HALLS))).cast("int")
    placed = keyed.join(large, place, "left").withColumn("nb", F.when(F.col("m").isNull(), 1).otherwise(blocks))
    dealt = meetings(placed, [*place, "cid", "vec"])
    ordered = dealt.repartition(*place, "bi", "bj").sortWithinPartitions(*place, "bi", "bj", "cid")

    def compare(batches):
        with tidy():
            for cols, groups in in_groups(batches, 5):
                cid, found = cols[6], []
                for s, e in groups:
                    bi, bj, k = cols[3][s], cols[4][s], cols[5][s:e]
                    x = unit_rows(list(cols[7][s:e]), floats)
                    first, second = np.flatnonzero(k == bi), np.flatnonzero(k == bj)
                    i, j = [], []
                    for at in range(0, len(first) if len(second) else 0, 512):
                        some = first[at : at + 512]
                        u, v = np.nonzero(block_links(x[some], x[second], least))
                        i.append(some[u])
                        j.append(second[v])
                    if not i:
                        continue
                    i, j = np.concatenate(i), np.concatenate(j)
                    label = _unite(i, j, e - s)
                    m = np.flatnonzero(label != np.arange(len(label)))
                    found.append((cid[s + m], cid[s + label[m]]))
                a, b = (np.concatenate(f) for f in zip(*found, strict=True)) if found else (cid[:0], cid[:0])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return ordered.select(*place, "bi", "bj", "k", "cid", "vec").mapInArrow(compare, "a long, b long")


def meetings(placed: DataFrame, names: list[str]) -> DataFrame:
    """Rows of groups of nb blocks, with their block k and each meeting (bi, bj) of two blocks of the group, or of one with itself.

    A member meets each block of its group once: as row where its block comes first, as column else.
    """
    at = placed.withColumn("k", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    dealt = at.select(*names, "k", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    return dealt.select(*names, "k", F.least("k", "o").alias("bi"), F.greatest("k", "o").alias("bj"))


def component_links(members: DataFrame, floats: str, least: float = 0.9) -> DataFrame:
    """(cid, links): for each class of (cid, root, vec, n), how many vectors of other classes of its component it links."""
    width = 8 // np.dtype(floats).itemsize
    sizes = members.groupBy("root").agg(F.count("*").alias("m"), F.sum(F.octet_length("vec").cast("long") * width).alias("bytes"))
    # small blocks spread a component over tasks; in a very large one larger blocks keep the copies of its rows few
    blocks = F.least(F.ceil(F.col("m") / BLOCK), F.greatest(F.lit(SPREAD), F.ceil(F.col("bytes") / BLOCK_BYTES))).cast("int")
    dealt = meetings(members.join(sizes, "root").withColumn("nb", blocks), ["cid", "root", "vec", "n"])
    dealt = dealt.repartition("root", "bi", "bj").sortWithinPartitions("root", "bi", "bj", "cid")

    def count(cid, raw, n, k, bi):
        links = np.zeros(len(cid), np.int64)
        dims = np.array([len(r) for r in raw])
        for dim in set(dims.tolist()):
            at = np.flatnonzero(dims == dim)
            x = unit_rows([raw[i] for i in at], floats)
            same = k[at].min() == k[at].max() if len(at) else True
            rows, cols = (np.arange(len(at)),) * 2 if same else (np.flatnonzero(k[at] == bi), np.flatnonzero(k[at] != bi))
            if same and len(set(k.tolist())) > 1:
                continue  # all of one block, in a meeting of two: counted where the block meets itself
            for s in range(0, len(rows), 512):  # a few rows at a time, so that the table of hits stays small
                some = rows[s : s + 512]
                hit = block_links(x[some], x[cols], least)
                if same:
                    hit[np.arange(len(some)), some] = False
                    links[at[some]] += hit @ n[at]
                else:
                    links[at[some]] += hit @ n[at[cols]]
                    links[at[cols]] += hit.T @ n[at[some]]
        return links

    def run(batches):
        with tidy():
            for cols, done in in_groups(batches, 3):
                yield out(cols, done)

    def out(cols, done):
        ids, links = [], []
        for s, e in done:
            if cols[1][s] != cols[2][s] and len(set(cols[6][s:e].tolist())) < 2:
                continue
            ids.append(cols[3][s:e])
            links.append(count(cols[3][s:e], cols[4][s:e], cols[5][s:e].astype(np.int64), cols[6][s:e], cols[1][s]))
        ids = np.concatenate(ids) if ids else cols[3][:0]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(links) if links else np.zeros(0, np.int64))], names=["cid", "links"])

    counted = dealt.select("root", "bi", "bj", "cid", "vec", "n", "k").mapInArrow(run, "cid long, links long")
    return counted.groupBy("cid").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, least: float = 0.9, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    floats = float_kind(vectors)
    rows, classes = vector_classes(vectors)
    labels = written(connected_components(projection_edges(classes, floats, least, miss)), "vector-components")
    members = classes.join(labels.withColumnRenamed("node", "cid"), "cid")
    links = component_links(members, floats, least)
    named = members.groupBy("root").agg(F.min("least").alias("component_id"))
    known = classes.select("cid", "least", "n", "d1", "d2").join(labels.withColumnRenamed("node", "cid").join(named, "root"), "cid", "left").join(links, "cid", "left")
    known = known.select("d1", "d2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.join(written(known, "vector-links"), ["d1", "d2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
