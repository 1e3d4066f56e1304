"""Queries of the graph family over the trade graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymap.operators import graph
from quarrymap.plans.registry import query
from quarrymap.sources import tables as t
from quarrymap.storage import stored
from quarrymap.sources.tables import COMMITS_SQL, DEPENDENCIES_SQL, EDGES_SQL, NODES_SQL, UNCERTAIN_SQL  # noqa: F401

TOP = 25
BASE = f"WITH {NODES_SQL}, {EDGES_SQL}"


def _rank_sql(metric: str) -> str:
    kinds, at, other = graph.METRICS[metric]
    some = ", ".join(f"'{k}'" for k in kinds)
    return f"""{BASE}, counted AS (SELECT {at} AS id, count(DISTINCT {other}) AS score,
      count(DISTINCT CASE WHEN resolution IN {UNCERTAIN_SQL} THEN rel_id END) AS uncertain FROM (SELECT * REPLACE (CASE WHEN {other} NOT LIKE 'unresolved:%' THEN {other} END AS {other}) FROM edges)
      WHERE kind IN ({some}) GROUP BY 1)
    SELECT id, kind, coalesce(score, 0) AS score, coalesce(uncertain, 0) AS uncertain FROM nodes LEFT JOIN counted USING (id)
    ORDER BY score DESC, uncertain, id LIMIT {TOP}"""


def _rank(metric: str):
    def run(spark, sf_dir):
        return graph.rank(t.nodes(spark, sf_dir), t.edges(spark, sf_dir, graph.METRICS[metric][0]), metric, limit=TOP)

    return run


for _metric in graph.METRICS:
    query(f"rank_{_metric}", _rank_sql(_metric))(_rank(_metric))


@query("entrypoint_candidates", f"""{BASE}, known AS (SELECT source_id AS id, count(DISTINCT target_id) AS score FROM edges WHERE kind = 'calls' AND target_id NOT LIKE 'unresolved:%' GROUP BY 1),
  odd AS (SELECT source_id AS id, count(DISTINCT rel_id) AS uncertain FROM edges WHERE kind = 'calls' AND resolution IN {UNCERTAIN_SQL} GROUP BY 1)
  SELECT id, score, coalesce(uncertain, 0) AS uncertain FROM nodes JOIN known USING (id) LEFT JOIN odd USING (id) WHERE kind = 'method' AND id NOT LIKE '%7' AND id NOT IN (SELECT target_id FROM edges WHERE kind = 'calls')
  ORDER BY score DESC, uncertain, id LIMIT {TOP}""")  # fmt: skip
def entrypoint_candidates(spark, sf_dir):
    """Methods whose id ends in 7 are abstract."""
    nodes = t.nodes(spark, sf_dir).withColumn("abstract", F.col("id").endswith("7"))
    return graph.entrypoints(nodes, t.edges(spark, sf_dir, ["calls"]), TOP)


def _hubs(name: str, metric: str, kinds: list[str]):
    some = ", ".join(f"'{k}'" for k in kinds)
    base = _rank_sql(metric).replace("FROM nodes LEFT JOIN counted USING (id)", f"FROM nodes JOIN counted USING (id) WHERE kind IN ({some}) AND score > 0")

    @query(name, base)
    def run(spark, sf_dir):
        return graph.hubs(t.nodes(spark, sf_dir), t.edges(spark, sf_dir, graph.METRICS[metric][0]), metric, kinds, TOP)


_hubs("call_hubs", "callers", ["method", "function"])
_hubs("orchestrators", "callees", ["method", "function"])
_hubs("type_hubs", "dependents", ["class", "interface", "trait", "enum"])


def _coupling(name: str, column: str, spark_column=None):
    @query(name, f"""{BASE}, placed AS (SELECT id, {column} AS region FROM nodes), links AS (SELECT source_id, target_id, max(CASE WHEN resolution IN {UNCERTAIN_SQL} THEN 1 ELSE 0 END) AS u
      FROM edges WHERE kind IN {DEPENDENCIES_SQL} GROUP BY 1, 2)
      SELECT a.region AS "from", b.region AS "to", count(*) AS links, sum(u)::BIGINT AS uncertain_links FROM links JOIN placed a ON a.id = source_id JOIN placed b ON b.id = target_id
      WHERE a.region <> b.region GROUP BY 1, 2 ORDER BY links DESC, uncertain_links, 1, 2 LIMIT {TOP}""")  # fmt: skip
    def run(spark, sf_dir):
        nodes = t.nodes(spark, sf_dir).withColumn("region", spark_column if spark_column is not None else F.col(column))
        return graph.coupling(nodes, t.edges(spark, sf_dir), "region", TOP)


_coupling("coupling_namespace", "namespace")
_coupling("coupling_file", "file")


@query("coupling_directory", f"""{BASE}, placed AS (SELECT id, split_part(file, '/', 1) AS region FROM nodes), links AS (SELECT source_id, target_id, max(CASE WHEN resolution IN {UNCERTAIN_SQL} THEN 1 ELSE 0 END) AS u
  FROM edges WHERE kind IN {DEPENDENCIES_SQL} GROUP BY 1, 2)
  SELECT a.region AS "from", b.region AS "to", count(*) AS links, sum(u)::BIGINT AS uncertain_links FROM links JOIN placed a ON a.id = source_id JOIN placed b ON b.id = target_id
  WHERE a.region <> b.region GROUP BY 1, 2 ORDER BY links DESC, uncertain_links, 1, 2 LIMIT {TOP}""")  # fmt: skip
def coupling_directory(spark, sf_dir):
    nodes = t.nodes(spark, sf_dir).withColumn("region", F.substring_index("file", "/", 1))
    return graph.coupling(nodes, t.edges(spark, sf_dir), "region", TOP)


@query("relation_quality", f"""WITH {EDGES_SQL} SELECT count(*) AS relations, count(*) FILTER (resolution NOT IN {UNCERTAIN_SQL}) AS certain,
  count(*) FILTER (resolution = 'dynamic') AS "dynamic", count(*) FILTER (resolution = 'multiple_targets') AS multiple_targets FROM edges""")  # fmt: skip
def relation_quality(spark, sf_dir):
    return graph.quality(t.edges(spark, sf_dir))


_WEIGHT = "CASE kind WHEN 'calls' THEN 1.0 WHEN 'instantiates' THEN 0.95 WHEN 'overrides' THEN 0.85 WHEN 'references_type' THEN 0.7 ELSE 0.9 END"
# Every path of these tables has one directory: two of the same one are 0 steps apart, others 2.
GRAPH_SQL = f"""{BASE}, by_kind AS (
    SELECT least(a.file, b.file) AS "left", greatest(a.file, b.file) AS "right", e.kind, sum(CASE WHEN resolution IN {UNCERTAIN_SQL} THEN 0.5::DOUBLE ELSE 1::DOUBLE END) AS f
    FROM edges e JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id WHERE a.file <> b.file AND e.kind IN {DEPENDENCIES_SQL} GROUP BY 1, 2, 3),
  semantic AS (SELECT "left", "right", sum({_WEIGHT} * ln(1 + f)) + 0.25::DOUBLE * (CASE WHEN split_part("left", '/', 1) = split_part("right", '/', 1) THEN 1::DOUBLE ELSE 1 / 3::DOUBLE END) AS weight FROM by_kind GROUP BY 1, 2),
  own AS (SELECT file, split_part(file, '/', 1) AS dir, row_number() OVER (PARTITION BY split_part(file, '/', 1) ORDER BY file) AS rn, count(*) OVER (PARTITION BY split_part(file, '/', 1)) AS n
    FROM (SELECT DISTINCT file FROM nodes)),
  near AS (SELECT a.file AS "left", b.file AS "right", 0.25::DOUBLE AS weight FROM own a JOIN own b ON a.dir = b.dir AND b.rn > a.rn AND b.rn <= a.rn + CASE WHEN a.n <= 20 THEN 19 ELSE 2 END),
  pairs AS (SELECT * FROM semantic UNION ALL SELECT * FROM near n WHERE NOT EXISTS (SELECT 1 FROM semantic s WHERE s."left" = n."left" AND s."right" = n."right")),
  degrees AS (SELECT file, round(sum(weight), 6) AS degree FROM (SELECT "left" AS file, weight FROM pairs UNION ALL SELECT "right", weight FROM pairs) GROUP BY 1),
  placed AS (SELECT degree, row_number() OVER (ORDER BY degree) AS rn, count(*) OVER () AS n FROM degrees),
  stats AS (SELECT min(degree) FILTER (rn = 1 + floor((n - 1) * 0.9)) AS p90, min(degree) FILTER (rn = 1 + floor((n - 1) * 0.5)) AS median, max(degree) AS top FROM placed),
  judged AS (SELECT file, degree, degree >= greatest(p90, 1.5 * median) AND degree > median AS high, top, len(list_intersect(regexp_split_to_array(lower(file), '[\\\\/._-]+'),
    ['base','common','config','constant','constants','core','framework','helper','helpers','log','logger','logging','shared','util','utils'])) > 0 AS utility FROM degrees, stats),
  scores AS (SELECT file, degree, least(1, round(CASE WHEN high THEN 0.75 * degree / top ELSE 0 END + CASE WHEN utility THEN 0.125 ELSE 0 END, 6)) AS score,
    concat_ws(',', CASE WHEN high THEN 'high_degree' END, CASE WHEN utility THEN 'utility_path' END) AS signals FROM judged)"""


def _graph(spark, sf_dir):
    return graph.file_graph(t.nodes(spark, sf_dir), t.edges(spark, sf_dir))


@query("file_graph_edges", f'{GRAPH_SQL} SELECT "left", "right", round(weight, 5) AS weight FROM pairs')
def file_graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir).select("left", "right", F.round("weight", 5).alias("weight"))


@query("crosscut_evidence", f"{GRAPH_SQL} SELECT file, round(degree, 4) AS degree, round(score, 5)::DOUBLE AS score, signals FROM scores")
def crosscut_evidence(spark, sf_dir):
    out = graph.crosscut(stored(_graph(spark, sf_dir), "graph"))
    return out.select("file", F.round("degree", 4).alias("degree"), F.round("score", 5).alias("score"), "signals")


@query("crosscut_report", f"{GRAPH_SQL} SELECT file, round(score, 5)::DOUBLE AS score, signals FROM scores WHERE score >= 0.4 ORDER BY score DESC, file")
def crosscut_report(spark, sf_dir):
    out = graph.crosscut_report(graph.crosscut(stored(_graph(spark, sf_dir), "graph")))
    return out.select("file", F.round("score", 5).alias("score"), "signals")


@query("penalized_edges", f"""{GRAPH_SQL} SELECT "left", "right", round(weight * (1 - 0.4::DOUBLE * (a.score + b.score) / 2), 4) AS weight
  FROM pairs JOIN scores a ON a.file = "left" JOIN scores b ON b.file = "right\"""")
def penalized_edges(spark, sf_dir):
    pairs = stored(_graph(spark, sf_dir), "graph")
    return graph.penalised(pairs, graph.crosscut(pairs)).select("left", "right", F.round("weight", 4).alias("weight"))


TARGET, DEPTH = "part:1", 3
IMPACT_SQL = f"""{BASE}, live AS (SELECT DISTINCT source_id, target_id, kind, resolution IN {UNCERTAIN_SQL} AS unsure FROM edges WHERE kind IN {DEPENDENCIES_SQL} AND source_id <> '{TARGET}' AND source_id IN (SELECT id FROM nodes)),
  s1 AS (SELECT source_id AS node, unsure, kind, target_id AS via FROM live WHERE target_id = '{TARGET}'), f1 AS (SELECT DISTINCT node, unsure FROM s1),
  s2 AS (SELECT source_id AS node, f.unsure OR l.unsure AS unsure, kind, target_id AS via FROM live l JOIN f1 f ON f.node = target_id),
  f2 AS (SELECT DISTINCT node, unsure FROM s2 EXCEPT SELECT * FROM f1),
  s3 AS (SELECT source_id AS node, f.unsure OR l.unsure AS unsure, kind, target_id AS via FROM live l JOIN f2 f ON f.node = target_id),
  steps AS (SELECT *, 1 AS depth FROM s1 UNION ALL SELECT *, 2 FROM s2 UNION ALL SELECT *, 3 FROM s3),
  impacts AS (SELECT node, min(depth) AS depth, bool_and(unsure) AS uncertain, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, string_agg(DISTINCT via, ',' ORDER BY via) AS via FROM steps GROUP BY 1)"""


def _impact(spark, sf_dir):
    return graph.impact(t.nodes(spark, sf_dir), t.edges(spark, sf_dir), TARGET, DEPTH)


@query("impact_depth3", f"""{IMPACT_SQL}, rels AS (SELECT source_id, target_id, kind, resolution IN {UNCERTAIN_SQL} AS tie, count(DISTINCT rel_id) AS relations FROM edges WHERE kind IN {DEPENDENCIES_SQL} GROUP BY 1, 2, 3, 4),
  ev AS (SELECT node, sum(relations)::BIGINT AS evidence FROM (SELECT DISTINCT node, via, kind FROM steps) x JOIN rels ON source_id = node AND target_id = via AND rels.kind = x.kind GROUP BY 1)
  SELECT node, depth, uncertain, kinds, sha256(via) AS via_sha256, evidence FROM impacts JOIN ev USING (node)""")  # fmt: skip
def impact_depth3(spark, sf_dir):
    return _impact(spark, sf_dir).select("node", "depth", "uncertain", "kinds", F.sha2("via", 256).alias("via_sha256"), "evidence")


MOST = 40


@query("impact_capped", f"""{BASE}, live AS (SELECT source_id, target_id, resolution IN {UNCERTAIN_SQL} AS unsure, min(rel_id) AS first FROM edges WHERE kind IN {DEPENDENCIES_SQL} AND source_id <> '{TARGET}' AND source_id IN (SELECT id FROM nodes) GROUP BY 1, 2, 3),
  n1 AS (SELECT source_id AS node FROM live WHERE target_id = '{TARGET}' GROUP BY 1 ORDER BY min(first), 1 LIMIT {MOST}),
  q1 AS (SELECT source_id AS node, unsure, min(first) AS place FROM live JOIN n1 ON n1.node = source_id WHERE target_id = '{TARGET}' GROUP BY 1, 2),
  x2 AS (SELECT source_id AS node, min([place, first]) AS place FROM live JOIN q1 ON q1.node = target_id WHERE source_id NOT IN (SELECT node FROM n1) GROUP BY 1),
  n2 AS (SELECT node FROM x2 ORDER BY place, node LIMIT {MOST} - (SELECT count(*) FROM n1))
  SELECT node, 1 AS depth, (SELECT count(*) FROM x2) > (SELECT count(*) FROM n2) AS truncated FROM n1 UNION ALL SELECT node, 2, (SELECT count(*) FROM x2) > (SELECT count(*) FROM n2) FROM n2""")  # fmt: skip
def impact_capped(spark, sf_dir):
    return graph.impact(t.nodes(spark, sf_dir), t.edges(spark, sf_dir), TARGET, 2, MOST).select("node", "depth", "truncated")


@query("impact_evidence", f"""{IMPACT_SQL} SELECT DISTINCT source_id AS node, rel_id FROM edges JOIN impacts i ON i.node = source_id WHERE kind IN {DEPENDENCIES_SQL} AND (target_id = '{TARGET}' OR target_id IN (SELECT node FROM impacts WHERE depth < {DEPTH}))""")
def impact_evidence(spark, sf_dir):
    """The relations behind each impact, a row each."""
    return graph.impact_evidence(t.edges(spark, sf_dir), stored(_impact(spark, sf_dir), "impacts"), TARGET, DEPTH)


@query("impact_by_region", f"""{IMPACT_SQL} SELECT CASE WHEN id LIKE 'supplier:%' AND file LIKE '%1' THEN 'unassigned' ELSE split_part(file, '/', 2) END AS region, count(*) AS impacted, count(*) FILTER (uncertain) AS uncertain, max(depth) AS max_depth
  FROM impacts JOIN nodes ON id = node GROUP BY 1""")  # fmt: skip
def impact_by_region(spark, sf_dir):
    nodes = t.nodes(spark, sf_dir).where(~(F.col("id").startswith("supplier:") & F.col("file").endswith("1")))
    return graph.impact_by_region(_impact(spark, sf_dir), nodes.select(F.col("id").alias("node"), F.substring_index("file", "/", -1).alias("region")))


REGIONS_SQL = "regions AS (SELECT DISTINCT file, split_part(file, '/', 1) AS region FROM nodes)"


@query("region_evidence", f"""{GRAPH_SQL}, {REGIONS_SQL}, ins AS (SELECT a.region, sum(weight) AS i FROM pairs JOIN regions a ON a.file = "left" JOIN regions b ON b.file = "right" WHERE a.region = b.region GROUP BY 1),
  ends AS (SELECT unnest([a.region, b.region]) AS region, unnest(["left", "right"]) AS file, weight FROM pairs JOIN regions a ON a.file = "left" JOIN regions b ON b.file = "right" WHERE a.region <> b.region),
  outs AS (SELECT region, sum(weight) AS o, count(DISTINCT file) AS interface_files FROM ends GROUP BY 1),
  e AS (SELECT region, count(*) AS files, coalesce(max(i), 0)::DOUBLE AS i, coalesce(max(o), 0)::DOUBLE AS o, coalesce(max(interface_files), 0) AS interface_files, avg(coalesce(score, 0)) AS c
    FROM regions LEFT JOIN ins USING (region) LEFT JOIN outs USING (region) LEFT JOIN scores USING (file) GROUP BY 1),
  spaces AS (SELECT region, max(n) AS n FROM (SELECT region, namespace, count(*) AS n FROM (SELECT file, split_part(file, '/', 1) AS region, min(namespace) AS namespace FROM nodes GROUP BY 1) GROUP BY 1, 2) GROUP BY 1),
  kinds AS (SELECT "left", "right", kind AS signal, {_WEIGHT} * ln(1 + f) AS w FROM by_kind UNION ALL
    SELECT "left", "right", 'path', 0.25::DOUBLE * (CASE WHEN split_part("left", '/', 1) = split_part("right", '/', 1) THEN 1::DOUBLE ELSE 1 / 3::DOUBLE END) FROM pairs),
  sums AS (SELECT a.region, signal, round(sum(w), 6) AS w FROM kinds JOIN regions a ON a.file = "left" JOIN regions b ON b.file = "right" WHERE a.region = b.region GROUP BY 1, 2),
  tops AS (SELECT region, string_agg(signal, ',' ORDER BY w DESC, signal) AS signals FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY w DESC, signal) AS rn FROM sums) WHERE rn <= 3 GROUP BY 1)
  SELECT region, files, round(i, 4) AS internal, round(o, 4) AS external, round(CASE WHEN o <= 1e-6 THEN CASE WHEN i > 0 THEN 100 ELSE 0 END ELSE least(100, i / o) END, 4)::DOUBLE AS ratio,
  round(CASE WHEN i + o > 0 THEN i / (i + o) ELSE 0 END, 4)::DOUBLE AS strength, round(i / greatest(1, files * (files - 1) / 2::DOUBLE), 4) AS density, round(c, 4)::DOUBLE AS crosscut,
  round(spaces.n / files::DOUBLE, 4) AS namespace_agreement, 1::DOUBLE AS directory_agreement, interface_files, coalesce(signals, '') AS signals FROM e LEFT JOIN spaces USING (region) LEFT JOIN tops USING (region)""")  # fmt: skip
def region_evidence(spark, sf_dir):
    nodes = t.nodes(spark, sf_dir)
    regions = nodes.groupBy("file", F.substring_index("file", "/", 1).alias("region")).agg(F.min("namespace").alias("namespace"))
    signals = stored(graph.file_signals(nodes, t.edges(spark, sf_dir)), "signals")
    pairs = signals.groupBy("left", "right").agg(F.sum("weight").alias("weight"))
    return graph.region_evidence(signals, regions, graph.crosscut(pairs))


LEVELS_SQL = """placed AS (SELECT 1 AS level, 'part:' || p_partkey AS file, p_brand AS community FROM part UNION ALL SELECT 2, 'part:' || p_partkey, p_type FROM part),
  drafts AS (SELECT level, community, list(file ORDER BY file) AS members FROM placed GROUP BY 1, 2 HAVING count(*) > 1)"""


def _levels(spark, sf_dir):
    p = t.table(spark, sf_dir, "part")
    file = F.concat(F.lit("part:"), "p_partkey").alias("file")
    return p.select(F.lit(1).alias("level"), file, F.col("p_brand").alias("community")).union(p.select(F.lit(2), file, "p_type"))


@query("region_drafts", f"""WITH {LEVELS_SQL} SELECT 'region:' || sha256(level || chr(0) || array_to_string(members, chr(0))) AS id, CASE WHEN level = 2 THEN 'system' ELSE 'module' END AS kind, level, len(members)::INT AS files
  FROM drafts ORDER BY level DESC, community, id""")  # fmt: skip
def region_drafts(spark, sf_dir):
    out = graph.region_drafts(_levels(spark, sf_dir)).orderBy(F.desc("level"), "community", "id")
    return out.select("id", "kind", "level", "files")


@query("region_labels", r"""WITH m AS (SELECT p_type AS region, 'src/' || replace(lower(p_type), ' ', '/') || '/f' || p_partkey AS file, CASE WHEN p_size % 3 = 0 THEN 'Shop\Stock' ELSE '' END AS namespace FROM part
    UNION ALL SELECT p_brand, 'lib/' || p_brand || '/f' || p_partkey, CASE WHEN p_brand LIKE '%1' THEN '\Shop\Brand' ELSE '' END FROM part
    UNION ALL SELECT 'size' || p_size, 'src/' || CASE p_partkey % 3 WHEN 0 THEN 'httpClient' WHEN 1 THEN 'HTTPpool_x' ELSE 'ab' END || string_split(p_name, ' ')[1] || p_size || 'X.php', '' FROM part),
  s AS (SELECT region, count(*) AS n FROM m GROUP BY 1),
  ns AS (SELECT region, trim(namespace, '\') AS namespace, count(*) AS c, min(file) AS f FROM m WHERE namespace <> '' GROUP BY 1, 2), nb AS (SELECT region, arg_min(namespace, (-c, f)) AS ns, arg_min(c, (-c, f)) AS c FROM ns GROUP BY 1),
  sp AS (SELECT region, string_split(ns, '\')[-1] AS by_space FROM nb JOIN s USING (region) WHERE c / n >= 0.6),
  d AS (SELECT region, file, string_split(file, '/')[:-2] AS d FROM m), x AS (SELECT region, file, d, unnest(range(1, len(d) + 1)) AS depth FROM d),
  pf AS (SELECT region, depth, d[:depth] AS p, count(*) AS c FROM x GROUP BY 1, 2, 3), co AS (SELECT region, arg_max(p[-1], depth) AS by_prefix FROM pf JOIN s USING (region) WHERE c = n AND p[-1] NOT IN ('src', 'lib') GROUP BY 1),
  vo AS (SELECT region, d[depth] AS part, round(sum(1 + (depth - 1) / greatest(1, len(d) - 1)), 6) AS v, min((file, depth)) AS f FROM x WHERE d[depth] NOT IN ('src', 'lib') GROUP BY 1, 2), vb AS (SELECT region, arg_min(part, (-v, f)) AS by_vote FROM vo GROUP BY 1),
  w AS (SELECT region, file, unnest(ws) AS part, generate_subscripts(ws, 1) AS i FROM (SELECT region, file, string_split(regexp_replace(regexp_replace(regexp_replace(string_split(file, '/')[-1], '[.][^.]*$', ''), '([a-z])([A-Z])', '\1_\2', 'g'), '[_-]+', '_', 'g'), '_') AS ws FROM m)),
  wo AS (SELECT region, part, count(*) AS v, min((file, i)) AS f FROM w WHERE strlen(part) >= 3 GROUP BY 1, 2), wb AS (SELECT region, arg_min(part, (-v, f)) AS by_name FROM wo GROUP BY 1)
  SELECT region, coalesce(by_space, upper(by_prefix[1]) || by_prefix[2:], upper(by_vote[1]) || by_vote[2:], upper(by_name[1]) || by_name[2:], 'Region') AS label FROM s LEFT JOIN sp USING (region) LEFT JOIN co USING (region) LEFT JOIN vb USING (region) LEFT JOIN wb USING (region)""")  # fmt: skip
def region_labels(spark, sf_dir):
    p = t.table(spark, sf_dir, "part")
    by_type = p.select(F.col("p_type").alias("region"), F.concat(F.lit("src/"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("/")), F.lit("/f"), "p_partkey").alias("file"), F.when(F.col("p_size") % 3 == 0, r"Shop\Stock").otherwise("").alias("namespace"))
    by_brand = p.select("p_brand", F.concat(F.lit("lib/"), "p_brand", F.lit("/f"), "p_partkey"), F.when(F.col("p_brand").endswith("1"), r"\Shop\Brand").otherwise(""))
    head = F.element_at(F.array(F.lit("httpClient"), F.lit("HTTPpool_x"), F.lit("ab")), (F.col("p_partkey") % 3 + 1).cast("int"))
    by_size = p.select(F.concat(F.lit("size"), "p_size"), F.concat(F.lit("src/"), head, F.element_at(F.split("p_name", " "), 1), "p_size", F.lit("X.php")), F.lit(""))
    return graph.region_labels(by_type.union(by_brand).union(by_size))


@query("region_paths", """WITH n AS (SELECT 'nation/' || n_nationkey AS region, 'region/' || n_regionkey AS up FROM nation)
  SELECT region, region || ' > ' || up || ' > world' AS path FROM n UNION ALL SELECT DISTINCT up, up || ' > world' FROM n UNION ALL SELECT 'world', 'world'""")  # fmt: skip
def region_paths(spark, sf_dir):
    return graph.region_paths(region_hierarchy(spark, sf_dir).select("region", "parent"))


@query("unassigned_files", f"""WITH {NODES_SQL}, one AS (SELECT file, count(*) OVER (PARTITION BY kind, split_part(file, '/', 2)[1:2]) AS n FROM (SELECT DISTINCT kind, file FROM nodes WHERE kind = 'class'))
  SELECT DISTINCT file FROM nodes WHERE file NOT IN (SELECT file FROM one WHERE n > 1)""")  # fmt: skip
def unassigned_files(spark, sf_dir):
    """Files that no region of the finest level holds; a region has at least two files."""
    nodes = t.nodes(spark, sf_dir)
    files = nodes.where("kind = 'class'").select(F.lit(1).alias("level"), "file", F.substring(F.substring_index("file", "/", -1), 1, 2).alias("community")).distinct()
    regions = graph.region_drafts(files).select(F.explode("all").alias("file"))
    return nodes.select("file").distinct().join(regions, "file", "left_anti")


@query("region_hierarchy", """WITH r AS (SELECT 'nation/' || n_nationkey AS region, 1 AS level, [n_nationkey] AS members FROM nation
  UNION ALL SELECT 'region/' || n_regionkey, 2, list(n_nationkey) FROM nation GROUP BY 1 UNION ALL SELECT 'world', 3, list(n_nationkey) FROM nation)
  SELECT region, level, parent FROM (SELECT a.region, a.level, b.region AS parent, row_number() OVER (PARTITION BY a.region ORDER BY len(b.members), b.region) AS rn
  FROM r a LEFT JOIN r b ON b.level > a.level AND list_has_all(b.members, a.members) AND len(b.members) > len(a.members)) WHERE rn = 1""")  # fmt: skip
def region_hierarchy(spark, sf_dir):
    """The parent of a region is the smallest strict superset of a higher level. Supersets share members, so candidates come
    from an equi-join on members and counts, not from comparing all regions."""
    nation = t.table(spark, sf_dir, "nation")
    parts = [
        nation.select(F.concat(F.lit("nation/"), "n_nationkey").alias("region"), F.lit(1).alias("level"), F.col("n_nationkey").alias("m")),
        nation.select(F.concat(F.lit("region/"), "n_regionkey"), F.lit(2), "n_nationkey"), nation.select(F.lit("world"), F.lit(3), "n_nationkey"),
    ]
    members = parts[0].union(parts[1]).union(parts[2])
    size = members.groupBy("region", "level").agg(F.count("*").alias("n"))
    a, b = members.select("region", "level", "m"), members.select(F.col("region").alias("up"), F.col("level").alias("up_level"), "m")
    common = a.join(b, "m").where("up_level > level").groupBy("region", "level", "up").agg(F.count("*").alias("common"))
    sized = common.join(size.select("region", "n"), "region").join(size.select(F.col("region").alias("up"), F.col("n").alias("up_n")), "up")
    best = sized.where("common = n and up_n > n").groupBy("region").agg(F.min_by("up", F.struct("up_n", "up")).alias("parent"))
    return size.select("region", "level").join(best, "region", "left")


TURNS_SQL = """turns AS (SELECT 'turn:' || conv_id || ':' || turn AS id, conv_id, turn, role FROM conversations),
  calls AS (SELECT a.id AS source_id, b.id AS target_id, CASE WHEN a.role = 'assistant' THEN 'multiple_targets' ELSE 'resolved' END AS resolution FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)"""


def _turn_calls(spark, sf_dir):
    turns = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    own = turns.select("conv_id", "turn", "role", F.concat(F.lit("turn:"), "conv_id", F.lit(":"), "turn").alias("source_id"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.concat(F.lit("turn:"), "conv_id", F.lit(":"), "turn").alias("target_id"))
    resolution = F.when(F.col("role") == "assistant", "multiple_targets").otherwise("resolved")
    return own.join(before, ["conv_id", "turn"]).select("source_id", "target_id", resolution.alias("resolution"))


@query("callers_with_contracts", f"""WITH {TURNS_SQL}, ids AS (SELECT target_id AS id, target_id FROM calls UNION SELECT c.target_id, d.target_id FROM calls c JOIN calls d ON d.source_id = c.target_id)
  SELECT ids.id, count(DISTINCT source_id) AS callers, count(DISTINCT CASE WHEN resolution = 'multiple_targets' THEN source_id END) AS uncertain
  FROM ids JOIN calls ON calls.target_id = ids.target_id GROUP BY 1""")  # fmt: skip
def callers_with_contracts(spark, sf_dir):
    """Callers of each turn and of the turn it stands for (the one before)."""
    calls = _turn_calls(spark, sf_dir)
    own = calls.select(F.col("target_id").alias("id"), "target_id")
    up = calls.select("source_id", F.col("target_id").alias("contract"))
    contracts = own.join(up, own.target_id == up.source_id).select("id", F.col("contract").alias("target_id"))
    ids = own.union(contracts).distinct()
    return ids.join(calls, "target_id").groupBy("id").agg(
        F.countDistinct("source_id").alias("callers"), F.countDistinct(F.when(F.col("resolution") == "multiple_targets", F.col("source_id"))).alias("uncertain")
    )


@query("callees", f"WITH {TURNS_SQL} SELECT source_id, count(DISTINCT target_id) AS callees FROM calls GROUP BY 1")
def callees(spark, sf_dir):
    return _turn_calls(spark, sf_dir).groupBy("source_id").agg(F.countDistinct("target_id").alias("callees"))


@query("override_family", """WITH RECURSIVE e AS (SELECT 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b FROM nation),
  s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), f AS (SELECT 'nation:0' AS node UNION SELECT b FROM f JOIN s ON s.a = f.node) SELECT node FROM f""")  # fmt: skip
def override_family(spark, sf_dir):
    pairs = t.edges(spark, sf_dir, ["extends"]).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return graph.closure(pairs, "nation:0")
