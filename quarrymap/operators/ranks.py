"""Exact places of rows in a global order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.storage import stored


def with_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """df with the place of each row (from 0) in the order of these columns, which should tell rows apart: of equal ones any comes first. Rows are
    dealt by ranges; a range numbers its rows by itself, and the counts of the ranges before it, a number a range, are added."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(tasks, *order).withColumn("_range", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    counts = {r["_range"]: r.n for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, [(-1, 0)]
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    starts = df.sparkSession.createDataFrame(offsets, "_range int, _before long")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(out, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def balanced_parts(df: DataFrame, order: list[str], parts: int, out: str = "part") -> DataFrame:
    """df with the number of a contiguous part (from 0) of each row in order: at most `parts` of them, none empty, whose sizes differ by one
    at most, the larger ones first."""
    ranked = stored(with_rank(df, order, "_rank"), "ranked")
    n = ranked.count()
    parts = max(1, min(parts, n))
    size, more = divmod(n, parts)
    rank, large = F.col("_rank"), (size + 1) * more
    part = F.when(rank < large, F.floor(rank / (size + 1))).otherwise(more + F.floor((rank - large) / max(1, size)))
    return ranked.withColumn(out, part.cast("int")).drop("_rank")
