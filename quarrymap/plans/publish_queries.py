"""Queries of labels told apart, contiguous parts, canonical and published maps, and hints from literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymap.operators import graph, hints, publish, ranks
from quarrymap.plans.registry import query
from quarrymap.sources import tables as t
from quarrymap.storage import new_folder

# Suppliers as regions: few labels (in two cases), directories by nation of which some are noise or the label, and few digests.
LABELS_SQL = """r AS (SELECT 'region:' || s_suppkey AS id, CASE WHEN s_suppkey = 3 THEN 'Shop 1 / Nation_2' WHEN s_suppkey % 9 = 4 THEN 'shop ' ELSE 'Shop ' END || s_suppkey % 4 AS label,
    CASE s_nationkey % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'shop 1' ELSE 'nation_' || s_nationkey END AS dir, sha256('d' || s_suppkey % 3) AS digest FROM supplier)"""


@query("unique_labels", f"""WITH RECURSIVE {LABELS_SQL}, g AS (SELECT *, lower(label) AS key, count(*) OVER (PARTITION BY lower(label)) AS n, row_number() OVER (PARTITION BY lower(label) ORDER BY id) AS rn FROM r),
  c AS (SELECT key, rn, id, label || ' / ' || CASE WHEN dir = 'src' OR lower(dir) = key THEN digest[1:6] ELSE array_to_string(list_transform(string_split(replace(dir, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS base, digest[1:6] AS d FROM g WHERE n > 1),
  cs AS (SELECT key, rn, id, list_concat([base, base || ' ' || d], list_transform(range(2, 400), lambda i: base || ' ' || d || '-' || i)) AS options FROM c), u AS (SELECT coalesce(list(key), []) AS singles FROM g WHERE n = 1),
  s AS (SELECT DISTINCT key, 0::BIGINT AS rn, []::VARCHAR[] AS taken, NULL::VARCHAR AS id, NULL::VARCHAR AS label FROM cs
    UNION ALL SELECT key, rn, list_append(taken, lower(pick)), id, pick FROM (SELECT s.key, cs.rn, s.taken, cs.id, list_filter(cs.options, lambda o: NOT list_contains(s.taken, lower(o)) AND NOT list_contains(u.singles, lower(o)))[1] AS pick FROM s JOIN cs ON cs.key = s.key AND cs.rn = s.rn + 1, u))
  SELECT id, label FROM s WHERE rn > 0 UNION ALL SELECT id, label FROM g WHERE n = 1""")  # fmt: skip
def unique_labels(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    start = F.when(k == 3, "Shop 1 / Nation_2").when(k % 9 == 4, "shop ").otherwise("Shop ")
    place = F.when(n % 4 == 0, "src").when(n % 4 == 1, "shop 1").otherwise(F.concat(F.lit("nation_"), n))
    return graph.unique_labels(t.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("region:"), k).alias("id"), F.concat(start, k % 4).alias("label"), F.concat(F.lit("lib/"), place, F.lit("/f.php")).alias("first"),
        F.sha2(F.concat(F.lit("d"), k % 3), 256).alias("digest"),
    ))


PARTS = 7


@query("balanced_parts", f"""WITH f AS (SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) - 1 AS r, count(*) OVER () AS n FROM pages)
  SELECT page_id, url, CASE WHEN r < (n // k + 1) * (n % k) THEN r // (n // k + 1) ELSE n % k + (r - (n // k + 1) * (n % k)) // (n // k) END::INT AS part FROM (SELECT *, least({PARTS}, n) AS k FROM f)""")  # fmt: skip
def balanced_parts(spark, sf_dir):
    """Pages in the order of their urls, in contiguous parts whose sizes differ by one at most."""
    return ranks.balanced_parts(t.table(spark, sf_dir, "pages").select("page_id", "url"), ["url", "page_id"], PARTS)


@query("canonical_json", """SELECT p_partkey, '{"brand":"' || p_brand || '","meta":{"a":[{"x":' || p_size || ',"y":null}],"z":"' || p_name || '"},"type":"' || p_type || '"}' AS json FROM part""")
def canonical_json(spark, sf_dir):
    p = t.table(spark, sf_dir, "part")
    inner = F.struct(F.col("p_name").alias("z"), F.array(F.struct(F.lit(None).cast("string").alias("y"), F.col("p_size").alias("x"))).alias("a"))
    rows = p.select("p_partkey", F.col("p_type").alias("type"), inner.alias("meta"), F.col("p_brand").alias("brand"))
    return rows.select("p_partkey", publish.canonical_json(rows.drop("p_partkey")).alias("json"))


@query("published_map", f"""WITH {t.NODES_SQL}, {t.EDGES_SQL} SELECT 'nodes' AS section, id, kind, (SELECT count(*) FROM nodes) AS rows FROM nodes UNION ALL SELECT 'relations', rel_id, kind, (SELECT count(*) FROM edges WHERE kind = 'instantiates') FROM edges WHERE kind = 'instantiates'""")
def published_map(spark, sf_dir):
    """Two sections of the trade graph, published and read back; `rows` is what the manifest says."""
    root = new_folder(spark, "map")
    nodes, relations = t.nodes(spark, sf_dir), t.edges(spark, sf_dir, [t.NEW])
    told = publish.write_map(root, {"nodes": (nodes, ["id"]), "relations": (relations, ["rel_id", "target_id"])})
    rows = lambda name: F.lit(told["sections"][name]["rows"]).alias("rows")
    a = publish.read_section(spark, root, "nodes", "id string, kind string").select(F.lit("nodes").alias("section"), "id", "kind", rows("nodes"))
    b = publish.read_section(spark, root, "relations", "rel_id string, kind string").select(F.lit("relations").alias("section"), F.col("rel_id").alias("id"), "kind", rows("relations"))
    return a.unionByName(b)


# Each part is a source of four lines: queries in literals, in a comment and cut short, and calls of templates, with names of the part.
_WORD_SQL = "replace(p_name, ' ', '_')"
_QUERY_SQL = "CASE p_size % 5 WHEN 0 THEN 'select * from' WHEN 1 THEN 'INSERT INTO' WHEN 2 THEN 'Delete  From' WHEN 3 THEN 'UPDATE' ELSE 'x JOIN' END"
_ACTION_SQL = "CASE p_size % 5 WHEN 1 THEN 'INSERT' WHEN 2 THEN 'DELETE' WHEN 3 THEN 'UPDATE' ELSE 'SELECT' END"


def _snippets(spark, sf_dir):
    p = t.table(spark, sf_dir, "part")
    word, size = F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size")
    queries = F.element_at(F.array(*map(F.lit, ["select * from", "INSERT INTO", "Delete  From", "UPDATE", "x JOIN"])), (size % 5 + 1).cast("int"))
    lit = F.lit
    content = F.concat(
        lit("<?php /* 'select * from nowhere' */ // it's \"update nothing\"\n$a = 'é "), queries, lit(" `"), word, lit("` where x = \\'from\\'';\n$b = \"UPDATE $x\" . 'z' . 'from ' . $y; $c = \""), queries, lit(" \" . $t;\nrender('t/"),
        word, lit("', 1); $o->render($v); render(); function render('no') {} \\render(/* 'c' */ 'u/"), F.col("p_brand"), lit("');"),
    )
    return p.select(F.concat(lit("p"), "p_partkey").alias("path"), content.alias("content"))


@query("table_hints", f"""SELECT 'p' || p_partkey AS path, 2::BIGINT AS line, {_WORD_SQL} AS name, {_ACTION_SQL} AS action FROM part
  UNION ALL SELECT 'p' || p_partkey, 3, '<dynamic table>', {_ACTION_SQL} FROM part""")  # fmt: skip
def table_hints(spark, sf_dir):
    out = hints.table_hints(_snippets(spark, sf_dir))
    return out.withColumn("line", F.col("line").cast("long"))


@query("template_hints", f"""SELECT 'p' || p_partkey AS path, 4::BIGINT AS line, unnest(['t/' || {_WORD_SQL}, '<dynamic>', 'u/' || p_brand]) AS template FROM part""")
def template_hints(spark, sf_dir):
    out = hints.template_hints(_snippets(spark, sf_dir), ["render"])
    return out.withColumn("line", F.col("line").cast("long"))
