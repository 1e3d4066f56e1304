"""Queries of the lookup and ingest families: documents as files, page urls as paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymap.functions import text as tx
from quarrymap.operators import lookup
from quarrymap.plans.registry import query
from quarrymap.sources import tables as t
from quarrymap.sources.tables import COPY_SQL, FILES_SQL

FILES = f"WITH {FILES_SQL}"
URLS_SQL = "urls AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages)"


def _paths(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*/?", "").alias("path"))


@query("summary_counts", """SELECT count(*) AS files, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr,
  count(*) FILTER (lang = 'es') AS es, count(DISTINCT source) AS sources FROM documents""")  # fmt: skip
def summary_counts(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents")
    return d.agg(F.count("*").alias("files"), *[F.count_if(F.col("lang") == x).alias(x) for x in ("en", "de", "fr", "es")], F.countDistinct("source").alias("sources"))


@query("top_namespaces", f"{FILES} SELECT namespace, count(*) AS files FROM files WHERE namespace <> '' GROUP BY 1 ORDER BY 2 DESC, min(doc_id) LIMIT 5")
def top_namespaces(spark, sf_dir):
    return lookup.top_groups(t.files(spark, sf_dir), "namespace", "doc_id", 5)


@query("top_directories", f"{FILES} SELECT directory, count(*) AS files FROM files WHERE directory <> '' GROUP BY 1 ORDER BY 2 DESC, min(doc_id) LIMIT 10")
def top_directories(spark, sf_dir):
    return lookup.top_groups(t.files(spark, sf_dir), "directory", "doc_id", 10)


@query("largest_files", f"{FILES} SELECT path, len(string_split(text, chr(10))) AS lines FROM files JOIN documents USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 20")
def largest_files(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents")
    lines = (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("lines")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/doc"), "doc_id", F.lit(".txt")).alias("path")
    return d.select(path, lines).orderBy(F.desc("lines"), "path").limit(20)


TERM = "en"
_C, _N = "lower(path)", "regexp_replace(lower(path), '[^a-z0-9]+', '', 'g')"


def _score_sql(c: str, term: str, base: int) -> str:
    return f"""CASE WHEN strpos({c}, '{term}') = 0 THEN 0 WHEN {c} = '{term}' THEN {base + 1000} ELSE {base} + CASE WHEN strpos({c}, '{term}') = 1 THEN 600 ELSE 0 END
      - least(500, 10 * strlen(left({c}, strpos({c}, '{term}') - 1))) - least(99, greatest(0, strlen({c}) - strlen('{term}'))) END"""


@query("fuzzy_query", f"""WITH {URLS_SQL}, s AS (SELECT page_id, path, {_score_sql(_C, TERM, 8000)} AS literal, {_score_sql(_N, TERM, 5000)} AS normal FROM urls)
  SELECT page_id, path, greatest(literal, normal)::BIGINT AS score, CASE WHEN literal > 0 THEN 'exact' ELSE 'normalized' END AS match FROM s WHERE greatest(literal, normal) > 0""")  # fmt: skip
def fuzzy_query(spark, sf_dir):
    return lookup.fuzzy(_paths(spark, sf_dir), TERM)


@query("test_paths", f"""WITH {URLS_SQL}, p AS (SELECT page_id, path, string_split(lower(path), '/') AS parts FROM urls)
  SELECT page_id, (list_contains(parts[:-2], 'tests') OR list_contains(parts[:-2], 'test') OR parts[-1] LIKE '%test.php' OR parts[-1] LIKE '%cest.php') AS is_test FROM p""")  # fmt: skip
def test_paths(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", tx.is_test_path("path").alias("is_test"))


@query("file_scan", "SELECT DISTINCT regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages WHERE NOT regexp_matches(url, '/(vendor|cache)/') AND NOT regexp_matches(url, '[0-9]$')")
def file_scan(spark, sf_dir):
    p = t.table(spark, sf_dir, "pages").where(~F.col("url").rlike("/(vendor|cache)/") & ~F.col("url").rlike("[0-9]$"))
    return p.select(F.regexp_replace("url", "^[a-z]+://[^/]*/?", "").alias("path")).distinct()


@query("path_nearness", f"""WITH {URLS_SQL}, p AS (SELECT page_id, string_split(path, '/')[:-2] AS d, lead(string_split(path, '/')[:-2]) OVER (ORDER BY page_id) AS e FROM urls)
  SELECT page_id, round(1 / (1 + len(d) + len(e) - 2 * coalesce(list_max(list_filter(range(1, least(len(d), len(e)) + 1), lambda i: d[1:i] = e[1:i])), 0))::DOUBLE, 6) AS nearness FROM p WHERE e IS NOT NULL""")  # fmt: skip
def path_nearness(spark, sf_dir):
    """Each page's path against that of the page with the next number: ids are joined, not put into one order."""
    p = _paths(spark, sf_dir)
    ids = t.table(spark, sf_dir, "pages").select("page_id")
    following = lookup.next_ids(ids, "page_id")
    q = p.select(F.col("page_id").alias("next_id"), F.col("path").alias("other"))
    out = p.join(following, "page_id").join(q, "next_id")
    return out.select("page_id", F.round(tx.path_nearness("path", "other"), 6).alias("nearness"))


@query("stale_entries", f"{FILES}, {COPY_SQL} SELECT f.path, CASE WHEN current IS NULL THEN 'missing' ELSE 'hash' END AS reason FROM files f LEFT JOIN copy USING (path) WHERE current IS NULL OR current <> sha256")
def stale_entries(spark, sf_dir):
    f = t.files(spark, sf_dir)
    return lookup.stale(f, t.working_copy(f))


@query("incremental_merge", f"""{FILES}, {COPY_SQL}, fresh AS (SELECT f.path, current AS sha256 FROM files f JOIN copy USING (path) WHERE current <> sha256)
  SELECT path, sha256, 'rebuilt' AS origin FROM fresh UNION ALL SELECT f.path, f.sha256, 'kept' FROM files f JOIN copy USING (path) WHERE f.path NOT IN (SELECT path FROM fresh)""")  # fmt: skip
def incremental_merge(spark, sf_dir):
    f = t.files(spark, sf_dir)
    copy = t.working_copy(f)
    fresh = f.join(copy, "path").where("current != sha256").select("path", F.col("current").alias("sha256"))
    return lookup.merge(f.select("path", "sha256"), fresh, copy.select("path"))


@query("changed_files", f"""{FILES}, c AS (SELECT path FROM files WHERE doc_id % 10 = 0 UNION SELECT path FROM files WHERE doc_id % 17 = 0 UNION SELECT path || '.new' FROM files WHERE doc_id % 100 = 0)
  SELECT c.path, f.path IS NOT NULL AS indexed FROM c LEFT JOIN files f USING (path)""")  # fmt: skip
def changed_files(spark, sf_dir):
    f = t.files(spark, sf_dir).select("doc_id", "path")
    lists = [f.where("doc_id % 10 = 0").select("path"), f.where("doc_id % 17 = 0").select("path"), f.where("doc_id % 100 = 0").select(F.concat("path", F.lit(".new")).alias("path"))]
    return lookup.changed(lists, f)


@query("cache_hits", f"{FILES}, {COPY_SQL} SELECT path, sha256 = current AS hit FROM files JOIN copy USING (path)")
def cache_hits(spark, sf_dir):
    f = t.files(spark, sf_dir)
    return f.join(t.working_copy(f), "path").select("path", (F.col("sha256") == F.col("current")).alias("hit"))


@query("same_namespace", f"""{FILES}, s AS (SELECT path, namespace, doc_id, row_number() OVER (PARTITION BY namespace ORDER BY doc_id) AS rn FROM files)
  SELECT s.path, count(*) AS peers FROM files a JOIN s ON s.namespace = a.namespace AND s.path <> a.path WHERE s.rn <= 5 GROUP BY 1""")  # fmt: skip
def same_namespace(spark, sf_dir):
    """The first files of each namespace with the number of their peers, from counts of namespaces."""
    f = t.files(spark, sf_dir).select("path", "namespace", "doc_id")
    size = f.groupBy("namespace").agg(F.count("*").alias("n"))
    first = f.withColumn("rn", F.row_number().over(Window.partitionBy("namespace").orderBy("doc_id"))).where("rn <= 5")
    return first.join(size, "namespace").where("n > 1").select("path", (F.col("n") - 1).alias("peers"))


@query("refresh_stream")
def refresh_stream(spark, sf_dir):
    from quarrymap.streaming import refresh

    return refresh.merged(spark, f"{sf_dir}/documents.parquet")
