"""Helpers that the corpus operators share: Arrow text access, samples of labelled rows, names."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship, written

__all__ = ["crc_part", "flat", "labelled_sample", "long_parts", "prepare", "shared_name", "slices", "texts", "tidy", "written"]


def prepare(spark: SparkSession) -> SparkSession:
    """Send the package to the workers. Spark bounds its Arrow batches by bytes, and `slices` cuts them further."""
    return ship(spark)


def shared_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it as long as df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@contextlib.contextmanager
def tidy(collect: bool = True):
    """For a Python worker's task: afterwards it gives freed memory back, as it idles while later stages run.

    Unless `collect`, the cycle collector rests meanwhile: it is dear where many small objects live, none in cycles.
    """
    if not collect:
        gc.disable()
    try:
        yield
    finally:
        gc.enable()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches, of at most `rows` rows and about `most` bytes, so that a worker's memory stays bounded."""
    for batch in batches:
        at, n = 0, batch.num_rows
        step = max(1, min(rows, int(most * n / max(1, batch.nbytes)))) if n else 1
        while at < n:
            yield batch.slice(at, step)
            at += step


def texts(column: pa.Array) -> list[str]:
    """The strings of a column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def long_parts(text: str, safe, most: int = 1 << 20) -> Iterator[str]:
    """A text in parts of about `most` characters, cut where the pattern `safe` matches; a text without such a place stays whole."""
    at = 0
    while len(text) - at > most and (m := safe.search(text, at + most)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and n + 1 offsets; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets and offsets.size else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def crc_part(modulus: int, doc_id: str = "doc_id"):
    """crc32 of the document id as text, modulo `modulus`; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, most: int) -> DataFrame:
    """(doc_id, text, n_chars, __y) of at most `most` labelled rows: the same ones in every run, at random by a hash of the id.

    The ids (a bounded set) are broadcast, so the texts don't move. An id labelled twice takes the larger label, an id of
    several rows one of them; null ids and labels are left out. Half of the places go to each class, as far as it has rows.
    """
    y = F.col(label).cast("int")
    ids = labels.where(F.col("doc_id").isNotNull() & y.isNotNull() & keep).groupBy("doc_id").agg(F.max(y).alias("__y"))
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    halves = [ids.where(F.col("__y") == v).orderBy(order, "doc_id").limit(most // 2) for v in (0, 1)]
    chosen = F.broadcast(halves[0].unionByName(halves[1]))
    n_chars = F.col("n_chars") if "n_chars" in docs.columns else F.char_length("text")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), n_chars.cast("long").alias("n_chars")).join(chosen, "doc_id")
    one = F.min_by(F.struct("text", "n_chars", "__y"), F.xxhash64("text", "n_chars")).alias("one")
    return rows.groupBy("doc_id").agg(one).select("doc_id", "one.*")
