"""Incremental refresh: files that arrive are merged into a table in the shared folder, as one run over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.storage import new_folder


def merged(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, batch) after reading all of the files at path as a stream: each batch is appended under its number, so
    that a batch that runs again writes the same folder, and the newest row of a path counts."""
    schema = spark.read.parquet(path).schema
    out, marks = new_folder(spark, "refresh"), new_folder(spark, "refresh-marks")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream watches a folder
        folder, name = path.rsplit("/", 1)
        stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    else:
        stream = spark.readStream.schema(schema).parquet(path)

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = stream.writeStream.foreachBatch(take).option("checkpointLocation", marks).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.option("basePath", out).schema("path string, sha256 string, batch int").parquet(out)
    return rows.groupBy("path").agg(F.max_by("sha256", "batch").alias("sha256"), F.max("batch").alias("batch"))
