"""From what a user names to what the map has: methods, symbols, regions, receivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUGGESTIONS = 10


def resolve_methods(methods: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, status, method_id, candidates) of targets `Class::method` over methods (fqn, name, method, state).

    A class with a backslash is compared by its full name, else by its short one, both with case. Status is found, ambiguous
    (candidates: all of them), not_found (candidates: the first ten methods of that name), conflict or invalid."""
    clean = F.regexp_replace(F.trim("target"), r"^\\+", "")
    t = targets.select("target", clean.alias("clean")).distinct()
    t = t.withColumn("cls", F.regexp_extract("clean", "^(.*)::", 1)).withColumn("m", F.substring_index("clean", "::", -1))
    t = t.withColumn("valid", F.col("clean").contains("::") & (F.col("cls") != "") & (F.col("m") != ""))
    found = t.where("valid").join(methods, F.col("m") == F.col("method")).select("target", "cls", "fqn", "name", "method", "state")
    hit = F.when(F.col("cls").contains("\\"), F.col("fqn") == F.col("cls")).otherwise(F.col("name") == F.col("cls"))
    found = found.withColumn("hit", hit).withColumn("full", F.concat("fqn", F.lit("::"), "method"))
    counts = found.groupBy("target").agg(
        F.count_if("hit").alias("hits"), F.count_if(F.col("hit") & (F.col("state") == "conflict")).alias("conflicts"),
        F.min(F.when(F.col("hit"), F.concat(F.lit("method:"), "full"))).alias("id"),
    )
    # hits come first, so where there are any the list has only them
    order = Window.partitionBy("target").orderBy(F.desc("hit"), "full")
    near = found.select("target", "hit", "full").distinct().withColumn("rn", F.row_number().over(order)).where(F.col("hit") | (F.col("rn") <= SUGGESTIONS))
    lists = near.groupBy("target").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("full")))), ",").alias("all"),
        F.array_join(F.array_sort(F.collect_set("full")), ",").alias("some"),
    )
    out = t.join(counts, "target", "left").join(lists, "target", "left").fillna(0, ["hits", "conflicts"])
    status = F.when(~F.col("valid"), "invalid").when(F.col("conflicts") > 0, "conflict").when(F.col("hits") == 0, "not_found")
    status = status.when(F.col("hits") == 1, "found").otherwise("ambiguous")
    shown = F.when(F.col("status") == "ambiguous", F.col("all")).when(F.col("status") == "not_found", F.coalesce("some", F.lit(""))).otherwise("")
    out = out.withColumn("status", status)
    return out.select("target", "status", F.when(F.col("status") == "found", F.col("id")).alias("method_id"), shown.alias("candidates"))


def select_symbols(symbols: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, status, symbol_id, matches) by full or short name over symbols (kind, fqn, name); functions win over classes."""
    by = [symbols.select(F.col(c).alias("term"), "kind", "fqn") for c in ("fqn", "name")]
    found = by[0].union(by[1]).join(terms.select("term").distinct(), "term").distinct()
    counts = found.groupBy("term").agg(
        F.count_if(F.col("kind") == "function").alias("functions"), F.count("*").alias("all"),
        F.min(F.when(F.col("kind") == "function", F.col("fqn"))).alias("f"), F.min(F.struct("fqn", "kind")).alias("c"),
    )
    matches = F.when(F.col("functions") > 0, F.col("functions")).otherwise(F.coalesce("all", F.lit(0)))
    one = F.when(F.col("functions") > 0, F.concat(F.lit("function:"), "f")).otherwise(F.concat("c.kind", F.lit(":"), "c.fqn"))
    out = terms.select("term").distinct().join(counts, "term", "left").withColumn("matches", matches).withColumn("one", one)
    status = F.when(F.col("matches") == 0, "not_found").when(F.col("matches") == 1, "found").otherwise("ambiguous")
    return out.select("term", status.alias("status"), F.when(F.col("matches") == 1, F.col("one")).alias("symbol_id"), "matches")


def select_regions(regions: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, status, region_id) over regions (id, label): an equal id or label (whatever the case) beats the start of an id."""
    q = queries.select(F.trim("query").alias("query")).distinct()
    exact = regions.select("id", F.lower("label").alias("q")).union(regions.select("id", F.lower("id")))
    exact = q.where("query != ''").withColumn("q", F.lower("query")).join(exact, "q").select("query", "id", F.lit(True).alias("exact"))
    start = F.broadcast(q.where("query != ''"))  # what a user typed
    start = regions.select("id").join(start, F.col("id").startswith(F.col("query"))).select("query", "id", F.lit(False).alias("exact"))
    found = exact.union(start).groupBy("query", "id").agg(F.max("exact").alias("exact")).groupBy("query")
    found = found.agg(F.count_if("exact").alias("e"), F.count("*").alias("n"), F.min(F.when(F.col("exact"), F.col("id"))).alias("ei"), F.min("id").alias("ni"))
    n = F.when(F.col("e") > 0, F.col("e")).otherwise(F.coalesce("n", F.lit(0)))
    out = q.join(found, "query", "left").withColumn("matches", n)
    status = F.when(F.col("query") == "", "empty").when(F.col("matches") == 0, "not_found").when(F.col("matches") == 1, "found").otherwise("ambiguous")
    return out.select("query", status.alias("status"), F.when(F.col("matches") == 1, F.coalesce("ei", "ni")).alias("region_id"))


def identifies(term: Column, qualified: Column, short: Column) -> Column:
    """Whether a term names a symbol: its full or short name, or an end of the full one after a separator; whatever the case."""
    t, full = F.lower(term), F.lower(qualified)
    return (full == t) | (F.lower(short) == t) | full.endswith(F.concat(F.lit("\\"), t)) | full.endswith(F.concat(F.lit("::"), t))


def receiver_has_owner(receiver: str, owner: str) -> Column:
    """Whether a type expression names the owner as a whole identifier; owner is a full name without a backslash before it."""
    quoted = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in owner)
    return F.col(receiver).rlike(rf"(?i)(?<![A-Za-z0-9_\\])\\?{quoted}(?![A-Za-z0-9_\\])")
