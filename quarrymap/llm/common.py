"""What the operators of this package share: reading, stored intermediate tables, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.storage import delete_folder, new_folder, stored  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, so that long texts don't pile up in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def spare(name: str, columns: list[str]) -> str:
    """name, with underscores before it until no column is called so (whatever the case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def dropped(*tables: DataFrame | None) -> None:
    """Delete the files of stored tables that nothing reads any more. Only folders of `new_folder` are touched."""
    for df in tables:
        for file in df.inputFiles()[:1] if df is not None else ():
            folder = file.rsplit("/", 1)[0]
            if folder.rsplit("/", 1)[1].startswith("quarrymap-"):
                delete_folder(df.sparkSession, folder)


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Labels of connected components: edges (a, b) of any one orderable type -> (node, label), label the least node.

    Alternates the large-star and small-star steps until the edges no longer change; every step is a grouped minimum
    (combined before its shuffle) and an equi-join, so a node of very many edges is neither collected nor windowed.
    Rows with a null end or a = b are left out. Nodes without edges are not returned.
    """
    edges = stored(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges"
    )
    last = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select("m", F.explode(F.array("a", "b")).alias("b")).select(F.col("m").alias("a"), "b")
        before, edges = edges, stored(small.where("a < b").distinct(), "edges")
        dropped(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
