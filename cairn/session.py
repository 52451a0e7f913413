"""Session defaults, table loading and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_cairn_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="cairn-code-"), "cairn.zip")  # on the driver, which serves it
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("cairn", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._cairn_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below spark.checkpoint.dir, which every executor can reach.

    Only on one machine (a local master) may the setting be missing: then a local folder is chosen and remembered in the
    session. On a cluster that raises ValueError, as executors wouldn't see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here and the loss of executors costs nothing."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path and the path as its object (metadata calls only)."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


__all__ = ["session", "ship", "table", "shared_folder", "cut", "file_system", "parallelism"]
