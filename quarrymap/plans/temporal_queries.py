"""Queries of the temporal family: orders as commits, shipments before and after a date, days of events as snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymap.operators import lookup, temporal
from quarrymap.plans.registry import query
from quarrymap.sources import tables as t
from quarrymap.sources.tables import COMMITS_SQL, EDGES_SQL, NODES_SQL

MOST, LEAST = 6, 2
# Parts of the greatest size are files that the map doesn't hold.
PAIRS_SQL = f"""WITH {COMMITS_SQL}, held AS (SELECT * FROM commits WHERE file IN (SELECT p_partkey FROM part WHERE p_size < 50)), live AS (SELECT commit_ord, file FROM held WHERE commit_ord IN (SELECT commit_ord FROM held GROUP BY 1 HAVING count(*) <= {MOST})),
  changes AS (SELECT file, count(*) AS n FROM live GROUP BY 1),
  pairs AS (SELECT a.file AS "left", b.file AS "right", count(*) AS together, string_agg(a.commit_ord, ',' ORDER BY a.commit_ord) AS revisions FROM live a JOIN live b ON a.commit_ord = b.commit_ord AND a.file < b.file GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
  rated AS (SELECT "left", "right", together, round(together / least(x.n, y.n)::DOUBLE, 6) AS smaller_ratio, round(together / (x.n + y.n - together)::DOUBLE, 6) AS jaccard, revisions
    FROM pairs JOIN changes x ON x.file = "left" JOIN changes y ON y.file = "right")"""


def _pairs(spark, sf_dir):
    held = t.table(spark, sf_dir, "part").where("p_size < 50").select(F.col("p_partkey").alias("file"))
    return temporal.cochange(t.commits(spark, sf_dir), MOST, LEAST, held)


@query("cochange_pairs", f'{PAIRS_SQL} SELECT * FROM rated ORDER BY together DESC, smaller_ratio DESC, jaccard DESC, "left", "right"')
def cochange_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).orderBy(F.desc("together"), F.desc("smaller_ratio"), F.desc("jaccard"), "left", "right")


@query("cochange_top", f'{PAIRS_SQL} SELECT "left", "right", together FROM rated ORDER BY together DESC, smaller_ratio DESC, jaccard DESC, "left", "right" LIMIT 20')
def cochange_top(spark, sf_dir):
    return cochange_pairs(spark, sf_dir).limit(20).select("left", "right", "together")


STATIC_SQL = """static AS (SELECT p_partkey AS "left", p_partkey + 1 AS "right", 0.7 * ln(2) AS semantic, 0.25 AS path FROM part UNION ALL SELECT p_partkey, p_partkey + 2, 0, 0.25 FROM part)"""


@query("hidden_coupling_claims", f"""{PAIRS_SQL}, {STATIC_SQL} SELECT "left", "right", together, smaller_ratio, round(coalesce(path, 0), 6)::DOUBLE AS path FROM rated
  LEFT JOIN static USING ("left", "right") WHERE smaller_ratio >= 0.05 AND coalesce(semantic, 0) <= 1e-6""")  # fmt: skip
def hidden_coupling_claims(spark, sf_dir):
    """Pairs that change together without a static tie; each part is tied to the next one, and near the one after it."""
    p = t.table(spark, sf_dir, "part")
    static = lambda step, w: p.select(F.col("p_partkey").alias("left"), (F.col("p_partkey") + step).alias("right"), w.cast("double").alias("semantic"), F.lit(0.25).alias("path"))
    pairs = temporal.with_static(_pairs(spark, sf_dir), static(1, 0.7 * F.log(F.lit(2.0))).union(static(2, F.lit(0.0))))
    return temporal.hidden_coupling(pairs, 0.05).select("left", "right", "together", "smaller_ratio", F.round("path", 6).alias("path"))


_SPLIT = "TIMESTAMP '1998-01-01'"
_IDENTITY = "'relation-semantic:' || sha256(o_custkey || chr(0) || 'calls' || chr(0) || l_partkey || chr(0) || l_returnflag || chr(0) || l_suppkey % 3 || chr(0) || l_linestatus)"
DIFF_SQL = f"""WITH l AS MATERIALIZED (SELECT *, l_shipdate >= {_SPLIT} AS late FROM lineitem),
  f AS (SELECT 'file' AS n, late, l_partkey::VARCHAR AS k, count(*)::VARCHAR || ':' || (sum(l_quantity)::BIGINT)::VARCHAR AS v FROM l GROUP BY 2, 3),
  m AS (SELECT 'method' AS n, late, l_partkey || '>' || l_suppkey AS k, max(l_quantity)::BIGINT::VARCHAR AS v FROM l GROUP BY 2, 3),
  r AS (SELECT 'relation' AS n, late, {_IDENTITY} AS k, count(*)::VARCHAR AS v FROM l JOIN orders ON o_orderkey = l_orderkey GROUP BY 2, 3),
  u AS (SELECT n, k, max(v) FILTER (NOT late) AS old, max(v) FILTER (late) AS new FROM (SELECT * FROM f UNION ALL SELECT * FROM m UNION ALL SELECT * FROM r) GROUP BY 1, 2),
  s AS (SELECT late, 'supplier:' || l_suppkey AS k, min(l_partkey)::VARCHAR AS p, 'sig' || (max(l_quantity + l_linenumber * 7)::BIGINT % 40)::VARCHAR AS v FROM l GROUP BY 1, 2),
  w AS (SELECT k, max(p) FILTER (NOT late) AS p0, max(p) FILTER (late) AS p1, max(v) FILTER (NOT late) AS s0, max(v) FILTER (late) AS s1 FROM s GROUP BY 1),
  events AS (SELECT CASE WHEN old IS NULL THEN n || '_added' WHEN new IS NULL THEN n || '_removed' ELSE n || CASE n WHEN 'file' THEN '_changed' WHEN 'method' THEN '_signature_changed' ELSE '_multiplicity_changed' END END AS kind, k AS id, old, new FROM u WHERE old IS DISTINCT FROM new
    UNION ALL SELECT 'symbol_added', k, NULL, s1 FROM w WHERE s0 IS NULL UNION ALL SELECT 'symbol_removed', k, s0, NULL FROM w WHERE s1 IS NULL
    UNION ALL SELECT 'symbol_moved', k, p0, p1 FROM w WHERE p0 <> p1 UNION ALL SELECT 'symbol_signature_changed', k, s0, s1 FROM w WHERE s0 <> s1)"""


def _events(spark, sf_dir):
    late = (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("late")
    lines = t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber", "l_returnflag", "l_linestatus", late)
    orders = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    value = F.concat(F.count("*").cast("string"), F.lit(":"), F.sum("l_quantity").cast("long").cast("string"))
    relation = [F.col("o_custkey"), F.col("l_partkey"), F.col("l_returnflag"), F.col("l_suppkey") % 3, F.col("l_linestatus")]
    # what a relation says is compared as columns; only what differs is hashed to its id
    relations = lines.join(orders, "l_orderkey").groupBy("late", *[c.alias(f"c{i}") for i, c in enumerate(relation)]).agg(F.count("*").alias("v"))
    parts = [
        (lines.groupBy("late", "l_partkey").agg(value.alias("v")), ["l_partkey"], ("file_added", "file_removed", "file_changed")),
        (lines.groupBy("late", "l_partkey", "l_suppkey").agg(F.max("l_quantity").cast("long").alias("v")), ["l_partkey", "l_suppkey"], ("method_added", "method_removed", "method_signature_changed")),
    ]
    out = None
    for rows, key, kinds in parts:
        found = temporal.diff(rows, key, "v", "late", kinds)
        out = found if out is None else out.unionByName(found)
    changed = temporal.diff(relations, ["c0", "c1", "c2", "c3", "c4"], "v", "late", ("relation_added", "relation_removed", "relation_multiplicity_changed"))
    keys = F.split("id", ">")
    changed = changed.withColumn("id", temporal.semantic_relation_id(keys[0], F.lit("calls"), keys[1], keys[2], keys[3], keys[4]))
    signature = F.concat(F.lit("sig"), F.max(F.col("l_quantity") + F.col("l_linenumber") * 7).cast("long") % 40)
    symbols = lines.groupBy("late", F.concat(F.lit("supplier:"), "l_suppkey").alias("id")).agg(F.min("l_partkey").cast("string").alias("path"), signature.alias("signature"))
    return out.unionByName(changed).unionByName(temporal.symbol_events(symbols))


@query("structural_diff_events", f"{DIFF_SQL} SELECT kind, id, old, new FROM events")
def structural_diff_events(spark, sf_dir):
    return _events(spark, sf_dir)


@query("structural_diff_counts", f"{DIFF_SQL} SELECT kind, count(*) AS events FROM events GROUP BY 1")
def structural_diff_counts(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("events"))


@query("structural_diff_report", f"{DIFF_SQL}, o AS (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY id) AS rn, count(*) OVER (PARTITION BY kind) AS n FROM events) SELECT kind, string_agg(id, ',' ORDER BY id) AS shown, max(greatest(0, n - 5)) AS omitted FROM o WHERE rn <= 5 GROUP BY 1")
def structural_diff_report(spark, sf_dir):
    """The first events of each kind and how many are left out."""
    return lookup.shown(_events(spark, sf_dir).select("kind", "id"), "kind", "id", 5)


@query("entity_observations", f"""WITH {NODES_SQL}, {EDGES_SQL}, o AS (SELECT source_id AS id, count(DISTINCT target_id) AS dependencies, count(DISTINCT CASE WHEN kind = 'calls' THEN target_id END) AS callees FROM edges GROUP BY 1),
  i AS (SELECT target_id AS id, count(DISTINCT source_id) AS dependents, count(DISTINCT CASE WHEN kind = 'calls' THEN source_id END) AS callers FROM edges GROUP BY 1)
  SELECT id, file AS region, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees, coalesce(dependents, 0) AS dependents, coalesce(dependencies, 0) AS dependencies
  FROM nodes LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")  # fmt: skip
def entity_observations(spark, sf_dir):
    edges = t.edges(spark, sf_dir)
    # parallel relations collapse first; what is shuffled again are links
    links = edges.groupBy("source_id", "target_id").agg(F.max((F.col("kind") == "calls").cast("int")).alias("calls"))
    o = links.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("dependencies"), F.sum("calls").alias("callees"))
    i = links.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("dependents"), F.sum("calls").alias("callers"))
    out = t.nodes(spark, sf_dir).select("id", F.col("file").alias("region")).join(o, "id", "left").join(i, "id", "left")
    return out.fillna(0).select("id", "region", "callers", "callees", "dependents", "dependencies")


@query("entity_history_delta", """WITH d AS (SELECT day(ts) AS snapshot_id, 'user:' || user_id AS entity, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3),
  o AS (SELECT snapshot_id, entity, arg_min(event_type, (-n, event_type)) AS signature, coalesce(sum(n) FILTER (event_type = 'view'), 0)::BIGINT AS views, coalesce(sum(n) FILTER (event_type = 'click'), 0)::BIGINT AS clicks FROM d GROUP BY 1, 2)
  SELECT entity, CASE WHEN max(snapshot_id) = (SELECT max(snapshot_id) FROM o) THEN 'present' ELSE 'absent_from_latest' END AS status, count(*) AS observations, count(DISTINCT signature) AS variants,
  arg_max(views, snapshot_id) - arg_min(views, snapshot_id) AS views_delta, arg_max(clicks, snapshot_id) - arg_min(clicks, snapshot_id) AS clicks_delta FROM o GROUP BY 1""")  # fmt: skip
def entity_history_delta(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("snapshot_id"), F.concat(F.lit("user:"), "user_id").alias("entity"), "event_type")
    d = e.groupBy("snapshot_id", "entity", "event_type").agg(F.count("*").alias("n"))
    n = lambda k: F.coalesce(F.sum(F.when(F.col("event_type") == k, F.col("n"))), F.lit(0))
    o = d.groupBy("snapshot_id", "entity").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("signature"), n("view").alias("views"), n("click").alias("clicks"))
    return temporal.history(o, ["views", "clicks"])
