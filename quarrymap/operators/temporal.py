"""Change history: co-change, structural differences, observations of entities over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymap.functions.text import nul_hash
from quarrymap.storage import stored

#: So many pairs of changes are counted in one task.
ONE_TASK = 2_000_000


def cochange(commits: DataFrame, most_files: int, at_least: int, files: DataFrame | None = None) -> DataFrame:
    """Pairs of files of (commit_ord, file) that change together, left < right. Changes of files that aren't in files (file), if given, don't
    count. Then commits of more than most_files files are left out before any pair is made, so a commit gives at most most_files ** 2 / 2 rows."""
    commits = commits.select("commit_ord", "file").distinct()
    if files is not None:
        commits = commits.join(files.select("file").distinct(), "file", "left_semi")
    size = commits.groupBy("commit_ord").agg(F.count("*").alias("n"))
    live = commits.join(size.where(F.col("n") <= most_files), "commit_ord").select("commit_ord", "file")
    live = stored(live, "live")  # read four times
    changes = live.groupBy("file").agg(F.count("*").alias("changes"))
    total = live.groupBy("commit_ord").agg((F.count("*") * (F.count("*") - 1) / 2).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # one number
    a, b = live.withColumnRenamed("file", "left"), live.withColumnRenamed("file", "right")
    # pairs grow faster than what they are made of: they are dealt into as many tasks as they need, before anything is gathered
    tasks = max(int(commits.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total) // ONE_TASK)
    pairs = a.join(b, "commit_ord").where(F.col("left") < F.col("right")).repartition(tasks, "left", "right")
    pairs = pairs.groupBy("left", "right").agg(F.count("*").alias("together"), F.array_join(F.array_sort(F.collect_list("commit_ord")), ",").alias("revisions"))
    pairs = pairs.where(F.col("together") >= at_least)
    x, y = (changes.select(F.col("file").alias(s), F.col("changes").alias(f"{s}_changes")) for s in ("left", "right"))
    out = pairs.join(x, "left").join(y, "right")
    smaller = F.col("together") / F.least("left_changes", "right_changes")
    jaccard = F.col("together") / (F.col("left_changes") + F.col("right_changes") - F.col("together"))
    return out.select("left", "right", "together", F.round(smaller, 6).alias("smaller_ratio"), F.round(jaccard, 6).alias("jaccard"), "revisions")


def diff(rows: DataFrame, key: list[str], value: str, late: str, kinds: tuple[str, str, str]) -> DataFrame:
    """(kind, id, old, new) of keys that were added, removed or whose value changed between the rows that are not late and those
    that are; each key at most once on either side. One grouped pass, no join."""
    v = F.col(value).cast("string")
    both = rows.groupBy(*key).agg(
        F.max(F.when(~F.col(late), v)).alias("old"), F.max(F.when(F.col(late), v)).alias("new"),
        F.bool_or(~F.col(late)).alias("before"), F.bool_or(late).alias("after"),
    )
    kind = F.when(~F.col("before"), kinds[0]).when(~F.col("after"), kinds[1]).when(~F.col("old").eqNullSafe(F.col("new")), kinds[2])
    return both.withColumn("kind", kind).where("kind is not null").select("kind", F.concat_ws(">", *key).alias("id"), "old", "new")


def symbol_events(rows: DataFrame) -> DataFrame:
    """(kind, id, old, new) of symbols (id, path, signature, late): added, removed, moved to another path, or of another signature;
    a symbol may do both of the last two."""
    at = lambda c, side: F.max(F.when(side, F.col(c)))
    both = rows.groupBy("id").agg(
        at("path", ~F.col("late")).alias("p0"), at("path", F.col("late")).alias("p1"), at("signature", ~F.col("late")).alias("s0"),
        at("signature", F.col("late")).alias("s1"), F.bool_or(~F.col("late")).alias("before"), F.bool_or("late").alias("after"),
    )
    event = lambda kind, old, new: F.struct(F.lit(kind).alias("kind"), old.cast("string").alias("old"), new.cast("string").alias("new"))
    stay = F.col("before") & F.col("after")
    found = F.array(
        F.when(~F.col("before"), event("symbol_added", F.lit(None), F.col("s1"))), F.when(~F.col("after"), event("symbol_removed", F.col("s0"), F.lit(None))),
        F.when(stay & ~F.col("p0").eqNullSafe(F.col("p1")), event("symbol_moved", F.col("p0"), F.col("p1"))),
        F.when(stay & ~F.col("s0").eqNullSafe(F.col("s1")), event("symbol_signature_changed", F.col("s0"), F.col("s1"))),
    )
    return both.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("e")).select("e.kind", "id", "e.old", "e.new")


def semantic_relation_id(*parts) -> Column:
    """An id of what a relation says (source, kind, targets, resolution, receiver, result), wherever it stands."""
    return F.concat(F.lit("relation-semantic:"), nul_hash(*parts))


def with_static(pairs: DataFrame, static: DataFrame) -> DataFrame:
    """pairs with the semantic and path weights of static (left, right, semantic, path), 0 where there are none."""
    return pairs.join(static, ["left", "right"], "left").fillna(0.0, ["semantic", "path"])


def hidden_coupling(pairs: DataFrame, ratio: float = 0.6) -> DataFrame:
    """Pairs that change together without a semantic tie, by the share of the side that changes less."""
    return pairs.where((F.col("semantic") <= 1e-6) & (F.col("smaller_ratio") >= ratio))


def history(observations: DataFrame, metrics: list[str]) -> DataFrame:
    """Of (snapshot_id, entity, signature, metrics...): status, number of observations, variants and the change of each
    metric from first to last."""
    latest = observations.agg(F.max("snapshot_id")).first()[0]
    out = observations.groupBy("entity").agg(
        F.count("*").alias("observations"), F.countDistinct(F.coalesce("signature", F.lit("null"))).alias("variants"),
        F.max("snapshot_id").alias("last"),
        *[(F.max_by(m, "snapshot_id") - F.min_by(m, "snapshot_id")).alias(f"{m}_delta") for m in metrics],
    )
    status = F.when(F.col("last") == F.lit(latest), "present").otherwise("absent_from_latest")
    return out.select("entity", status.alias("status"), "observations", "variants", *[f"{m}_delta" for m in metrics])
