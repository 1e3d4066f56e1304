"""Lookup, staleness and incremental merge over files (path, sha256, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.functions import text as tx


def top_groups(files: DataFrame, column: str, order: str, limit: int) -> DataFrame:
    """The largest groups; ties by the least `order` in them."""
    by = files.where(F.col(column) != "").groupBy(column).agg(F.count("*").alias("files"), F.min(order).alias("_first"))
    return by.orderBy(F.desc("files"), "_first").select(column, "files").limit(limit)


def fuzzy(paths: DataFrame, term: str) -> DataFrame:
    """Rows whose path holds the term, as it is or without punctuation, with the better score."""
    literal = tx.match_score(F.lower("path"), term, 8000)
    normal = tx.match_score(tx.normalized(F.col("path")), term, 5000)
    out = paths.withColumn("literal", literal).withColumn("score", F.greatest("literal", normal).cast("long"))
    match = F.when(F.col("literal") > 0, "exact").otherwise("normalized")
    return out.where("score > 0").select("page_id", "path", "score", match.alias("match"))


# What a match counts by where it is, as it stands and without punctuation.
BASES = {"name": (10_000, 7_000), "fqn": (9_500, 6_500), "method": (9_000, 6_000), "path": (8_000, 5_000)}


def fuzzy_files(candidates: DataFrame, term: str) -> DataFrame:
    """(path, score, match) of candidates (path, part, value), part one of BASES: the best score over all that a file has, and whether
    the term was found as it stands (exact), without punctuation (normalized), or some of both (mixed)."""
    plain = "".join(c for c in term.lower() if c.isascii() and c.isalnum())
    literal = normal = F.lit(0)
    for part, (a, b) in BASES.items():
        is_part = F.col("part") == part
        literal = F.when(is_part, tx.match_score(F.lower("value"), term.lower(), a)).otherwise(literal)
        normal = F.when(is_part, tx.match_score(tx.normalized(F.col("value")), plain, b)).otherwise(normal)
    rows = candidates.select("path", literal.alias("literal"), (normal if plain else F.lit(0)).alias("normal"))
    by = rows.groupBy("path").agg(F.max(F.greatest("literal", "normal")).alias("score"), F.bool_or(F.col("literal") > 0).alias("l"), F.bool_or((F.col("literal") == 0) & (F.col("normal") > 0)).alias("n"))
    match = F.when(F.col("l") & F.col("n"), "mixed").when(F.col("l"), "exact").otherwise("normalized")
    return by.where("score > 0").select("path", F.col("score").cast("long").alias("score"), match.alias("match")).orderBy(F.desc("score"), "path")


def mention_files(files: DataFrame, term: str, skipped: DataFrame, limit: int) -> DataFrame:
    """The first files (path, ord, content, symbols) whose content has the term as it stands; not those without symbols or skipped."""
    some = files.where((F.col("symbols") > 0) & F.col("content").contains(term)).join(skipped.select("path"), "path", "left_anti")
    return some.orderBy("ord").limit(limit).select("path", "ord")


def stale(files: DataFrame, current: DataFrame) -> DataFrame:
    out = files.select("path", "sha256").join(current, "path", "left").where("current is null or current != sha256")
    return out.select("path", F.when(F.col("current").isNull(), "missing").otherwise("hash").alias("reason"))


def merge(previous: DataFrame, fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """Fresh rows, and those of before that were not rebuilt and still exist."""
    kept = previous.join(fresh.select("path"), "path", "left_anti").join(existing, "path", "left_semi")
    return fresh.withColumn("origin", F.lit("rebuilt")).unionByName(kept.withColumn("origin", F.lit("kept")))


def changed(lists: list[DataFrame], files: DataFrame) -> DataFrame:
    """The union of the lists, each path once, and whether the map has it."""
    out = lists[0]
    for more in lists[1:]:
        out = out.union(more)
    known = files.select("path", F.lit(True).alias("indexed"))
    return out.distinct().join(known, "path", "left").select("path", F.coalesce("indexed", F.lit(False)).alias("indexed"))


def next_ids(ids: DataFrame, column: str, width: int = 100_000) -> DataFrame:
    """(column, next_id): each id with the next greater one, in ranges of ids; the least id of each range is joined on."""
    ids = ids.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_r", F.floor(F.col(column) / width))
    w = Window.partitionBy("_r").orderBy(column)
    inner = ids.withColumn("next_id", F.lead(column).over(w))
    firsts = ids.groupBy("_r").agg(F.min(column).alias("_first"))
    firsts = firsts.select("_r", F.lead("_first").over(Window.orderBy("_r")).alias("_after"))  # one row for each range
    out = inner.join(firsts, "_r").select(column, F.coalesce("next_id", "_after").alias("next_id"))
    return out.where("next_id is not null")


def by_path(files: DataFrame, asked: DataFrame) -> DataFrame:
    """files of the asked paths, written with either slash and with or without `./` before them."""
    path = F.regexp_replace(F.replace("asked", F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    return asked.distinct().withColumn("path", path).join(files, "path")


def stats(nodes: DataFrame, limit: int) -> DataFrame:
    """(files, symbols, methods, file, in_file): totals, beside the files with most symbols (ties by path)."""
    by = nodes.groupBy("file").agg(F.count_if(F.col("kind") != "method").alias("in_file"), F.count_if(F.col("kind") == "method").alias("m"))
    totals = by.agg(F.count("*").alias("files"), F.sum("in_file").alias("symbols"), F.sum("m").alias("methods"))
    top = by.orderBy(F.desc("in_file"), "file").limit(limit)
    return top.crossJoin(F.broadcast(totals)).select("files", "symbols", "methods", "file", "in_file")  # one row


def shown(rows: DataFrame, group: str, item: str, limit: int) -> DataFrame:
    """(group, shown, omitted): the first items of each group and how many are left out. Only the first ones are brought together."""
    first = rows.select(group, item).withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(item))).where(F.col("rn") <= limit)
    first = first.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("shown"))
    size = rows.groupBy(group).agg(F.greatest(F.lit(0), F.count("*") - limit).alias("omitted"))
    return first.join(size, group).select(group, "shown", "omitted")


def readiness(maps: DataFrame, files: DataFrame, current: DataFrame) -> DataFrame:
    """(map, map_state, search_state) of maps (map, snapshot, search): stale if any of its files (path, map, sha256) is, and only a
    map that is ready is held against the snapshot that its search index names (null: no index)."""
    found = stale(files, current).join(files.select("path", "map"), "path").groupBy("map").agg(F.count("*").alias("stale"))
    out = maps.join(found, "map", "left").fillna(0, ["stale"])
    search = F.when(F.col("stale") > 0, "unavailable").when(F.col("search").isNull(), "missing").when(F.col("search") == "", "invalid")
    search = search.when(F.col("search") == F.col("snapshot"), "ready").otherwise("stale")
    return out.select("map", F.when(F.col("stale") == 0, "ready").otherwise("stale").alias("map_state"), search.alias("search_state"))


def slices(files: DataFrame) -> DataFrame:
    """(path, slice): the lines start to end of files (path, sha256, current, content, start, end) that are as the map knows them."""
    lines = F.split("content", "\n")
    some = files.where((F.col("current") == F.col("sha256")) & (F.size(lines) >= F.col("start")))
    return some.select("path", F.array_join(F.slice(lines, F.col("start"), F.col("end") - F.col("start") + 1), "\n").alias("slice"))


def merged_hits(literal: DataFrame, normalized: DataFrame) -> DataFrame:
    """(symbol, methods, hit): a normalised hit takes the place of the literal one if it has more methods."""
    rows = literal.withColumn("hit", F.lit("literal")).unionByName(normalized.withColumn("hit", F.lit("normalized")))
    best = F.max_by(F.struct("methods", "hit"), F.struct("methods", (F.col("hit") == "literal").cast("int")))
    return rows.groupBy("symbol").agg(best.alias("v")).select("symbol", "v.methods", "v.hit")


def related(files: DataFrame, term: str, limit: int) -> DataFrame:
    """(section, path): files (path, namespace) whose path holds the term and is no test, tests that are likely theirs (the base
    name of one holds that of the other) and others of their namespace. What is looked around from is a top list of at most
    max(10, 3 * limit) files, so it is broadcast."""
    base = F.regexp_replace(F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""), r"(?i)(test|cest)$", "")
    files = files.withColumn("base", base).withColumn("test", tx.is_test_path("path"))
    found = files.where(~F.col("test") & F.lower("path").contains(term.lower())).orderBy("path").limit(max(10, 3 * limit))
    around = F.broadcast(found.select(F.col("path").alias("p"), F.col("base").alias("b"), F.col("namespace").alias("ns")))
    holds = (F.col("path") != F.col("p")) & (F.col("base").contains(F.col("b")) | F.col("b").contains(F.col("base")))
    tests = files.where("test").join(around, holds, "left_semi").select("path").distinct().orderBy("path").limit(limit)
    peers = files.where("namespace != ''").join(around, F.col("namespace") == F.col("ns"), "left_semi")
    peers = peers.join(around, F.col("path") == F.col("p"), "left_anti").select("path").distinct().orderBy("path").limit(limit)
    primary = found.select("path").orderBy("path").limit(limit)
    named = lambda df, name: df.select(F.lit(name).alias("section"), "path")
    return named(primary, "primary").union(named(tests, "likely_tests")).union(named(peers, "same_namespace"))
