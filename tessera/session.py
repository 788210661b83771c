"""What a session needs before the library's Python code runs on it: the package on the workers, a shared folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
ONE_MACHINE = re.compile(r"local(\[.*\])?")


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers, once for each application; on one machine they import it from here."""
    if getattr(spark.sparkContext, "_tessera_shipped", False):
        return spark
    if ONE_MACHINE.fullmatch(spark.sparkContext.master):
        env, above = spark.sparkContext.environment, os.path.dirname(ROOT)
        env["PYTHONPATH"] = os.pathsep.join(x for x in (above, env.get("PYTHONPATH", "")) if x)
    else:
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, "tessera.zip")
        with zipfile.ZipFile(path, "w") as z:
            for d, _, files in os.walk(ROOT):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(d, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(ROOT)))
        spark.sparkContext.addPyFile(path)
    spark.sparkContext._tessera_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine, where it is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark.sparkContext, "_tessera_shared", None)
        if not found:
            if not ONE_MACHINE.fullmatch(spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = spark.sparkContext._tessera_shared = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, found, True)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: df as a table in the shared folder, read again, so that lost executors cost nothing.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
