"""Tables that are brought up to date: chunks, key/value pairs, cached embeddings, vectors, snapshots.

Each gives the new state as rows; `record_snapshot` writes it, one folder for each snapshot, so that a run that is repeated
replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_chunks(existing: DataFrame, fresh: DataFrame, replaced: DataFrame) -> DataFrame:
    """Chunks (chunk_id, path, ord, ...) after those of the replaced paths went and fresh ones came; of equal chunk ids the first
    stays, those that were there before fresh ones."""
    kept = existing.join(replaced.select("path").distinct(), "path", "left_anti").select(*fresh.columns, F.lit(0).alias("age"))
    rows = kept.unionByName(fresh.withColumn("age", F.lit(1)))
    value = F.struct(*[c for c in fresh.columns if c != "chunk_id"])
    return rows.groupBy("chunk_id").agg(F.min_by(value, F.struct("age", "ord")).alias("v"), (F.count("*") - 1).alias("skipped")).select("chunk_id", "v.*", "skipped")


def upsert(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key, the fresh one if there is one."""
    rows = existing.withColumn("age", F.lit(0)).unionByName(fresh.withColumn("age", F.lit(1)))
    value = F.struct(*[c for c in existing.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(value, "age").alias("v")).select(*keys, "v.*")


def store_vectors(vectors: DataFrame, fresh: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors (chunk_id, vector) with fresh ones in place of old ones; those of unknown chunks are passed over."""
    return upsert(vectors, fresh.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi"), ["chunk_id"])


def vector_space(vectors: DataFrame, fingerprint: str) -> DataFrame:
    """The vectors of one model; those of others go."""
    return vectors.where(F.col("model_fingerprint") == fingerprint)


def recorded(snapshots: DataFrame, observations: DataFrame, new: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshots (snapshot_id, revision, digest) and observations (snapshot_id, entity_id, ...) after new ones: a snapshot that is
    there stays as it is, the observations of a snapshot that is recorded again are replaced."""
    added = new.join(snapshots.select("revision", "digest"), ["revision", "digest"], "left_anti").select(snapshots.columns)
    kept = observations.join(seen.select("snapshot_id").distinct(), "snapshot_id", "left_anti").select(observations.columns)
    return snapshots.unionByName(added), kept.unionByName(seen)


def record_snapshot(observations: DataFrame, folder: str) -> None:
    """Write observations, one folder for each snapshot_id; the folders of these snapshots are replaced, others stay."""
    writer = observations.repartition("snapshot_id").write.partitionBy("snapshot_id")
    writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(folder)


def snapshots_at(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)
