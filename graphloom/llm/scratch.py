"""Intermediate tables in the folder that driver and executors share.

A table written there cuts the lineage: losing an executor afterwards costs no
recomputation, since every task can read the files again.  Tables that no later step
reads are dropped on the way; those that a result is still read from go when the
Python process ends, with the folder.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.sources.store import children, delete, exists, filesystem, read_text, rename, shared_dir

__all__ = ["Scratch", "children", "delete", "exists", "filesystem", "lean", "read_text", "rename", "shared_dir", "unused"]

BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000


def lean(spark: SparkSession) -> None:
    """Send rows to Python workers in small batches: texts are long, and two workers share an executor's memory.

    The session's own settings stay where they are smaller.
    """
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{key}"
        now = _number(str(spark.conf.get(name)))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def unused(columns: list[str], name: str) -> str:
    """The name, or the name with underscores, that no column has in either case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _number(text: str) -> int:
    """A setting such as 2000, 64m or 67108864b."""
    m = re.fullmatch(r"(-?[0-9]+)([kmgt]?)b?", text.strip().lower())
    return int(m[1]) * 1024 ** " kmgt".index(m[2] or " ") if m else 0


def _remove(fs, path) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        fs.delete(path, True)


class Scratch:
    """A folder of Parquet tables for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        lean(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        atexit.register(_remove, path.getFileSystem(spark._jsc.hadoopConfiguration()), path)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        delete(self.spark, self.path(name))
