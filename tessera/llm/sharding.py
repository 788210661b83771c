"""Shards as runs of a Hilbert curve through several metadata dimensions.

Each dimension is quantised into 2^bits ranges of about equal weight, so neighbouring rows of a shard are alike in every
dimension and a file's minima and maxima prune well. Cut points of numbers come from an approximate percentile over all
rows; those of texts from the counts of all distinct values, whole and in their order, added up over ranges of values. The
curve index orders the rows, cell by cell; a row's global place is its cell's first place (from counts), then that of its
sub-bucket, then its rank there, so no sort ever needs one task and texts don't move. Shards are equal runs of places:
their counts differ by one at most (the law `rows`).

Null metadata count as the lowest values, null texts have size 1; ties, repeated rows and null ids get distinct places; an
empty table gives an empty one. shard_rows ignores columns beside those used; write_shards keeps all, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import prepare, shared_name, written

SUBBUCKETS = 1024


def hilbert_index(point: list[int], bits: int) -> int:
    """Place on the Hilbert curve of a point with `bits` bits in each dimension (Skilling, 2004)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> b & 1)
    return out


def text_cuts(rows: DataFrame, name: str, n: int) -> list[str]:
    """The n - 1 values of a text column at which the next of n ranges of about equal weight begins; whole values, nulls first."""
    counts = rows.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("m"))
    ranges = written(counts.repartitionByRange("value").withColumn("p", F.spark_partition_id()), "values")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of values
    sums = ranges.groupBy("p").agg(F.sum("m").alias("of")).select("p", F.coalesce(F.sum("of").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("p").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ranges.withColumn("upto", F.sum("m").over(within)).join(F.broadcast(sums), "p").select("value", (F.col("first") + F.col("upto")).alias("upto"))
    total = ranges.agg(F.sum("m")).first()[0] or 0
    found = run.agg(*[F.min(F.when(F.col("upto") * n >= total * k, F.col("value"))).alias(f"c{k}") for k in range(1, n)]).first()
    return [c for c in found if c is not None]


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def _levels(df: DataFrame, dims: list[str], n: int) -> list[Column]:
    """Each dimension's range, from 0 to n - 1."""
    numbers = [d for d in dims if not _is_text(df, d)]
    cuts = {}
    if numbers:
        value = {d: F.coalesce(F.col(f"`{d}`").cast("double"), F.lit(-1.0)) for d in numbers}
        cuts = df.agg(*[F.percentile_approx(value[d], [i / n for i in range(1, n)], 10_000).alias(f"c{i}") for i, d in enumerate(numbers)]).first()
        cuts = {d: (value[d], [float(c) for c in cuts[i] or []]) for i, d in enumerate(numbers)}
    for d in dims:
        if d not in cuts:
            cuts[d] = F.col(f"`{d}`"), text_cuts(df, f"`{d}`", n)
    return [sum((F.when(cuts[d][0] > F.lit(c), 1).otherwise(0) for c in cuts[d][1]), F.lit(0)) for d in dims]


def hilbert_cells(df: DataFrame, dims: list[str], bits: int) -> Column:
    """The curve index of a row's quantised dimensions, as a column (2^(bits * dims) cells, 4096 at most)."""
    if bits * len(dims) > 12:
        raise ValueError("more than 4096 cells")
    n = 1 << bits
    code = F.lit(0)
    for level in _levels(df, dims, n):
        code = code * n + level
    cells = [hilbert_index([c // n ** (len(dims) - 1 - i) % n for i in range(len(dims))], bits) for c in range(n ** len(dims))]
    return F.element_at(F.array(*[F.lit(c) for c in cells]), code + 1)


def place_rows(docs: DataFrame, shards: int, dims: tuple[str, ...], bits: int, *more: Column) -> DataFrame:
    """doc_id, size, crc, place, shard and slot of every row, and more columns of it. Ties are ordered by id and text."""
    prepare(docs.sparkSession)
    dims = [d for d in dims if d in docs.columns]
    cell = hilbert_cells(docs, dims, bits) if dims else F.lit(0)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # copies of a row and rows of one id differ in their number, so a hot one spreads; written, as its rows are read twice
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), cell.alias("cell"), F.monotonically_increasing_id().alias("uid"), *more)
    rows = written(rows.withColumn("sub", F.pmod(F.xxhash64("doc_id", "uid"), F.lit(SUBBUCKETS)).cast("int")), "placed")
    # at most 4096 x SUBBUCKETS counts
    counts = rows.groupBy("cell", "sub").agg(F.count("*").alias("n"))
    per_cell = counts.groupBy("cell").agg(F.sum("n").alias("m"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # over 4096 rows at most
    per_cell = per_cell.select("cell", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"), F.sum("m").over(Window.partitionBy()).alias("all"))
    within = Window.partitionBy("cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("into", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(per_cell), "cell").select("cell", "sub", (F.col("first") + F.col("into")).alias("base"), "all")
    rank = Window.partitionBy("cell", "sub").orderBy("doc_id", "crc", "uid")
    placed = rows.join(base, ["cell", "sub"]).withColumn("place", (F.col("base") + F.row_number().over(rank) - 1).cast("long"))
    placed = placed.withColumn("shard", F.expr(f"place * {shards} div all").cast("int"))
    return placed.withColumn("slot", (F.col("place") - F.expr(f"(shard * all + {shards - 1}) div {shards}")).cast("long")).drop("base", "all", "sub", "uid")


def shard_rows(docs: DataFrame, shards: int = 8, dims: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, place and cell of every document."""
    placed = place_rows(docs, shards, dims, bits)
    return placed.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "place", "cell")


def write_shards(docs: DataFrame, path: str, shards: int = 8, files: int = 1, dims: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = 4) -> str:
    """Write whole documents as Parquet, a folder for each shard, about `files` files in each, in curve order.

    Returns the name of the column of shards: `shard`, with underscores before it where docs has such a column. Whole rows
    are written to the shared folder once on the way.
    """
    name = shared_name(docs, "shard")
    placed = place_rows(docs, shards, dims, bits, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    spread = placed.repartitionByRange(shards * files, "shard", "place").sortWithinPartitions("shard", "place")
    spread.select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return name
