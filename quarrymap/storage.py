"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset and all runs in one
    process, since other machines would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="quarrymap-"))
    return _OWN_FOLDER[0]


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one; it goes when the driver's Python ends."""
    folder = f"{shared_folder(spark)}/quarrymap-{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            delete_folder(spark, folder)
        except Exception:  # noqa: BLE001  the session has ended already
            pass

    atexit.register(drop)
    return folder


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and outlives the executors that wrote it."""
    folder = new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
