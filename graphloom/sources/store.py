"""Files in the folder that driver and executors share, through Spark's file systems.

``spark.checkpoint.dir`` names that folder on a cluster.  Where it is unset, a folder
of this machine is made and set only if all executors are on it (local mode).
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from the session; made and set only where unset, in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        found = spark.sparkContext.getCheckpointDir()
        if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = found or tempfile.mkdtemp(prefix="graphloom-")
        if not found:
            spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by files in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _gone(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        delete(spark, path)


class Rounds:
    """Tables of a loop as Parquet files in the shared folder.

    Spark takes a checkpoint to be as large as what it was made of, and a join as the product of its sides: a table that is
    joined with itself round after round gets a size whose digits double, until the driver has no room for the number. Files have
    the size they have. Tables go when they are replaced, the rest when Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.made = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}", 0
        atexit.register(_gone, spark, self.base)

    def save(self, df: DataFrame, *instead: DataFrame) -> DataFrame:
        """Write a table; those it replaces, which nothing reads from then on, are deleted."""
        self.made += 1
        path = f"{self.base}/{self.made}"
        df.write.parquet(path)
        for old in instead:
            for f in {x.rpartition("/")[0] for x in old.inputFiles() if f"/{self.base.rpartition('/')[2]}/" in x}:
                delete(self.spark, f)
        return self.spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def filesystem(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> bool:
    return filesystem(spark, path).delete(_path(spark, path), True)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    return filesystem(spark, source).rename(_path(spark, source), _path(spark, target))


def exists(spark: SparkSession, path: str) -> bool:
    return filesystem(spark, path).exists(_path(spark, path))


def children(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of a folder's entries; empty if the folder is missing."""
    if not exists(spark, path):
        return []
    found = filesystem(spark, path).listStatus(_path(spark, path))
    return sorted((s.getPath().getName(), s.getLen()) for s in found)


def sizes(spark: SparkSession, path: str, before: str) -> dict[str, int]:
    """Bytes of the files in each folder ``<before><name>`` below a path, by name."""
    found, out = filesystem(spark, path).listFiles(_path(spark, path), True), {}
    while found.hasNext():
        f = found.next()
        folder = f.getPath().getParent().getName()
        if folder.startswith(before) and not f.getPath().getName().startswith(("_", ".")):
            out[folder[len(before) :]] = out.get(folder[len(before) :], 0) + f.getLen()
    return out


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside, then move into place in one step: a reader sees the old text or the new one."""
    part = f"{path}.{uuid.uuid4().hex}"
    stream = filesystem(spark, part).create(_path(spark, part), True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(filesystem(spark, path).getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    options[0] = jvm.Options.Rename.OVERWRITE
    context.rename(_path(spark, part), _path(spark, path), options)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
