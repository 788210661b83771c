"""A store of glyphs that any number of writers may add to at once: each glyph is in it once.

A store is a folder of parts, each written by one call, and of numbered versions. Version n is a small file that names the
part it adds. A writer adds the glyphs that no version has yet as a new part, and commits it as the version after the last
one it has seen. Only one writer can make a version's file; the others find it taken, leave out what it has brought, and try
the next number. A part without a version, left by a writer that lost or died, is never read.

Glyphs are told apart by (w, h, name), where nulls are equal to each other; of several bitmaps under one key the smallest is
taken. A path that doesn't exist, or is an empty folder, is an empty store; anything else that can't be read is an error. An
empty table adds nothing and makes no version. Columns beside w, h, name and bits are left out.

The commit is a rename to a name that must be free. HDFS makes that one step; so is a hard link, which a local path takes. On
an object store without such a step two writers at the same instant may both believe that they have won.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["w", "h", "name"]
SCHEMA = "w int, h int, name string, bits string"


class _Folder:
    """The store's folder by Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(self.path(path)).toString()

    def names(self) -> list[str]:
        """The parts of all versions, in their order; a gap in the numbers is an error."""
        at = self.path(f"{self.root}/versions")
        if not self.fs.exists(at):
            return []
        found = sorted(x.getPath().getName() for x in self.fs.listStatus(at) if x.getPath().getName().isdigit())
        if found != [f"{n:010d}" for n in range(len(found))]:
            raise ValueError(f"{self.root}: a version is missing")
        return [self._text(f"{self.root}/versions/{x}") for x in found]

    def _text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readNBytes(64)).decode()
        finally:
            stream.close()

    def commit(self, n: int, part: str) -> bool:
        """Make version n, unless there is one."""
        draft, final = f"{self.root}/versions/.draft-{part}-{n}", f"{self.root}/versions/{n:010d}"
        stream = self.fs.create(self.path(draft))
        stream.write(bytearray(part.encode()))
        stream.close()
        if urlparse(self.root).scheme == "file":
            try:
                os.link(unquote(urlparse(draft).path), unquote(urlparse(final).path))
                won = True
            except FileExistsError:
                won = False
        else:
            won = not self.fs.exists(self.path(final)) and self.fs.rename(self.path(draft), self.path(final))
        self.fs.delete(self.path(draft), False)
        return won

    def drop(self, part: str) -> None:
        self.fs.delete(self.path(f"{self.root}/parts/{part}"), True)


def _parts(spark: SparkSession, folder: _Folder, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*[f"{folder.root}/parts/{x}" for x in names])


def read_glyphs(spark: SparkSession, path: str) -> DataFrame:
    """(w, h, name, bits) of the store, as of its last version."""
    folder = _Folder(spark, path)
    return _parts(spark, folder, folder.names())


def _unknown(found: DataFrame, known: DataFrame) -> DataFrame:
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"k.{c}")) for c in KEY]
    return found.alias("f").join(known.select(*KEY).alias("k"), same, "left_anti")


def store_glyphs(found: DataFrame, path: str) -> int:
    """Add the glyphs (w, h, name, bits) that the store doesn't have; returns how many this call has added."""
    spark = found.sparkSession
    folder = _Folder(spark, path)
    seen = folder.names()
    typed = found.select(*[F.col(c).cast("int" if c in "wh" else "string").alias(c) for c in (*KEY, "bits")])
    new = _unknown(typed.groupBy(*KEY).agg(F.min("bits").alias("bits")), _parts(spark, folder, seen))
    lost = None
    while True:
        part = uuid.uuid4().hex
        new.write.parquet(f"{folder.root}/parts/{part}")
        if lost:
            folder.drop(lost)
        new, lost = _parts(spark, folder, [part]), part
        n = new.count()
        if n and folder.commit(len(seen), part):
            return n
        if not n:
            folder.drop(part)
            return 0
        # another writer was first: what it has brought goes, and the rest is tried as the version after it
        now = folder.names()
        new, seen = _unknown(new, _parts(spark, folder, now[len(seen) :])), now
