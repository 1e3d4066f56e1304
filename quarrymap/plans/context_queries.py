"""Queries of the context and rename families: turns of conversations as plans, words of documents as tokens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymap.operators import context, graph
from quarrymap.plans.registry import query
from quarrymap.sources import tables as t

BUDGET = 600
CANDIDATES_SQL = """cs AS (SELECT conv_id AS plan, 'turn:' || turn AS symbol, role, 'turn' AS evidence, turn = 0 AS mandatory, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 10 ELSE 20 END AS priority, length(text) AS size FROM conversations
  UNION ALL SELECT conv_id, 'turn:' || (turn - 1), role, 'reply', FALSE, 30, length(text) FROM conversations WHERE turn > 0),
  u AS (SELECT plan, symbol, role, string_agg(DISTINCT evidence, ',' ORDER BY evidence) AS evidence, bool_or(mandatory) AS mandatory, min(priority) AS priority, max(size) AS size FROM cs GROUP BY 1, 2, 3)"""


def _candidates(spark, sf_dir):
    c = t.table(spark, sf_dir, "conversations")
    priority = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 10).otherwise(20)
    own = c.select(F.col("conv_id").alias("plan"), F.concat(F.lit("turn:"), "turn").alias("symbol"), "role", F.lit("turn").alias("evidence"), (F.col("turn") == 0).alias("mandatory"), priority.alias("priority"), F.length("text").cast("long").alias("size"))
    reply = c.where("turn > 0").select(F.col("conv_id").alias("plan"), F.concat(F.lit("turn:"), F.col("turn") - 1).alias("symbol"), "role", F.lit("reply").alias("evidence"), F.lit(False).alias("mandatory"), F.lit(30).alias("priority"), F.length("text").cast("long").alias("size"))
    return context.dedupe_candidates(own.unionByName(reply))


@query("context_candidates", f"WITH {CANDIDATES_SQL} SELECT * FROM u")
def context_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query("context_budget", f"""WITH RECURSIVE {CANDIDATES_SQL}, o AS (SELECT plan, size, row_number() OVER (PARTITION BY plan ORDER BY priority, symbol, size) AS rn, count(*) OVER (PARTITION BY plan) AS n FROM u),
  f AS (SELECT plan, 0::BIGINT AS rn, 0::BIGINT AS used, 0::BIGINT AS chosen, n FROM o WHERE rn = 1 UNION ALL
    SELECT f.plan, o.rn, CASE WHEN f.used + o.size <= {BUDGET} THEN f.used + o.size ELSE f.used END, f.chosen + CASE WHEN f.used + o.size <= {BUDGET} THEN 1 ELSE 0 END, f.n FROM f JOIN o ON o.plan = f.plan AND o.rn = f.rn + 1)
  SELECT plan, chosen, n - chosen AS omitted, used FROM f WHERE rn = n""")  # fmt: skip
def context_budget(spark, sf_dir):
    return context.within_budget(_candidates(spark, sf_dir), BUDGET)


_ROLE_SQL = "CASE turn % 5 WHEN 1 THEN 'change_candidate' WHEN 2 THEN 'dependency' WHEN 3 THEN 'verification' WHEN 4 THEN 'type_definition' ELSE 'primary' END"
CAPS = {"change_candidate": 1, "dependency": 1, "verification": 2, "type_definition": 1}
_FITS = "(f.used + o.size <= 900 AND (list_contains(f.files, o.file) OR len(f.files) < 2))"
_CAPPED = "((o.role = 'change_candidate' AND f.c >= 1) OR (o.role = 'dependency' AND f.d >= 1) OR (o.role = 'verification' AND f.v >= 2) OR (o.role = 'type_definition' AND f.t >= 1))"
_TAKEN = f"(NOT f.failed AND (o.mandatory OR NOT {_CAPPED}) AND {_FITS})"


@query("context_selection", f"""WITH RECURSIVE cand AS (SELECT conv_id AS plan, 'turn:' || turn AS symbol, {_ROLE_SQL} AS role, turn = 0 AS mandatory, (turn % 3 * 10)::INT AS priority, length(text) AS size, 'f' || turn % 3 AS file FROM conversations),
  o AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY priority, symbol, role, mandatory, size, file) AS rn, count(*) OVER (PARTITION BY plan) AS n FROM cand),
  f AS (SELECT plan, 0::BIGINT AS rn, 0::BIGINT AS used, []::VARCHAR[] AS chosen, []::VARCHAR[] AS omitted, []::VARCHAR[] AS files, FALSE AS failed, 0 AS c, 0 AS d, 0 AS v, 0 AS t, n FROM o WHERE rn = 1
    UNION ALL SELECT f.plan, o.rn, CASE WHEN {_TAKEN} THEN f.used + o.size ELSE f.used END, CASE WHEN {_TAKEN} THEN list_append(f.chosen, o.symbol) ELSE f.chosen END,
      CASE WHEN f.failed OR {_TAKEN} THEN f.omitted ELSE list_append(f.omitted, o.symbol) END, CASE WHEN {_TAKEN} AND NOT list_contains(f.files, o.file) THEN list_append(f.files, o.file) ELSE f.files END,
      f.failed OR (o.mandatory AND NOT {_FITS}), f.c + ({_TAKEN} AND o.role = 'change_candidate')::INT, f.d + ({_TAKEN} AND o.role = 'dependency')::INT, f.v + ({_TAKEN} AND o.role = 'verification')::INT, f.t + ({_TAKEN} AND o.role = 'type_definition')::INT, f.n
      FROM f JOIN o ON o.plan = f.plan AND o.rn = f.rn + 1)
  SELECT plan, array_to_string(chosen, ',') AS chosen, array_to_string(omitted, ',') AS omitted, used, len(files)::INT AS files, failed FROM f WHERE rn = n""")  # fmt: skip
def context_selection(spark, sf_dir):
    c, m = t.table(spark, sf_dir, "conversations"), F.col("turn") % 5
    role = F.when(m == 1, "change_candidate").when(m == 2, "dependency").when(m == 3, "verification").when(m == 4, "type_definition").otherwise("primary")
    rows = c.select(
        F.col("conv_id").alias("plan"), F.concat(F.lit("turn:"), "turn").alias("symbol"), role.alias("role"), (F.col("turn") == 0).alias("mandatory"),
        (F.col("turn") % 3 * 10).cast("int").alias("priority"), F.length("text").cast("long").alias("size"), F.concat(F.lit("f"), F.col("turn") % 3).alias("file"),
    )
    out = context.select_context(rows, 900, 2, CAPS)
    return out.select("plan", F.array_join("chosen", ",").alias("chosen"), F.array_join("omitted", ",").alias("omitted"), "used", "files", "failed")


@query("focus_windows", """WITH d AS (SELECT doc_id AS path, string_split(text, 'the ') AS ps, len(string_split(text, chr(10))) AS n FROM documents), h AS (SELECT path, ps, n, unnest(range(1, least(3, len(ps) - 1) + 1)) AS i FROM d WHERE len(ps) > 1),
  w AS (SELECT path, n, len(string_split(array_to_string(ps[:i], 'the '), chr(10))) AS line FROM h)
  SELECT path, greatest(1, line - 2)::INT AS "start", least(n, line + 2)::INT AS "end" FROM w UNION ALL SELECT path, 1, n::INT FROM d WHERE len(ps) = 1""")  # fmt: skip
def focus_windows(spark, sf_dir):
    return context.focus_windows(t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"), "the ", 2)


@query("blind_spots", f"""WITH {t.EDGES_SQL} SELECT source_id, CASE resolution WHEN 'dynamic' THEN 'dynamic_call' ELSE 'multiple_call_targets' END AS kind, count(*) AS evidence FROM edges WHERE kind = 'calls' AND resolution IN ('dynamic', 'multiple_targets') GROUP BY 1, 2""")
def blind_spots(spark, sf_dir):
    return context.blind_spots(t.edges(spark, sf_dir, ["calls"]))


RELATIONS_SQL = r"""rels AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_suppkey || ':' || l_partkey AS rel_id, l_orderkey AS file, l_linenumber AS line, CASE l_returnflag WHEN 'R' THEN 'calls' WHEN 'A' THEN 'instantiates' ELSE 'references_type' END AS kind,
  'class:lib\S' || l_suppkey % 5 AS target_id, l_linestatus AS resolution, 's' || l_suppkey % 3 AS source_id FROM lineitem)"""


def _relations(spark, sf_dir):
    c = F.col
    kind = F.when(c("l_returnflag") == "R", "calls").when(c("l_returnflag") == "A", "instantiates").otherwise("references_type")
    return t.table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("rel_id"), c("l_orderkey").alias("file"), c("l_linenumber").alias("line_start"),
        c("l_linenumber").alias("line_end"), kind.alias("kind"), F.concat(F.lit("class:lib\\S"), c("l_suppkey") % 5).alias("target_id"), c("l_linestatus").alias("resolution"),
        F.concat(F.lit("s"), c("l_suppkey") % 3).alias("source_id"),
    )


@query("scope_relations", f"""WITH {RELATIONS_SQL} SELECT o_custkey AS target, count(*) AS relations, count(DISTINCT file) AS files FROM rels JOIN orders ON file = o_orderkey WHERE kind IN ('calls', 'instantiates') AND line >= 1 + o_orderkey % 2 AND line <= 3 AND (o_orderkey % 4 < 2 OR source_id = 's' || o_orderkey % 3) GROUP BY 1""")
def scope_relations(spark, sf_dir):
    targets = t.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("file"), (1 + F.col("o_orderkey") % 2).alias("start"), F.lit(3).alias("end"), F.when(F.col("o_orderkey") % 4 >= 2, F.concat(F.lit("s"), F.col("o_orderkey") % 3)).alias("source"))
    return context.within(_relations(spark, sf_dir), targets).groupBy("target").agg(F.count("*").alias("relations"), F.countDistinct("file").alias("files"))


@query("enriched_calls", rf"""WITH {RELATIONS_SQL}, hints AS (SELECT DISTINCT o_orderkey AS file, ln AS line, CASE o_orderkey % 2 WHEN 0 THEN 'constructor' ELSE 'method' END AS call, 'S' || (o_custkey + ln) % 5 AS name FROM orders, (SELECT unnest([1, 2, 3])::INT AS ln)),
  b AS (SELECT file, line, kind, string_split(target_id, '\')[-1] AS name, min(rel_id) AS rel_id, arg_min(resolution, rel_id) AS resolution FROM rels GROUP BY 1, 2, 3, 4)
  SELECT h.file, h.line, call, h.name, rel_id, resolution FROM hints h LEFT JOIN b ON b.file = h.file AND b.line = h.line AND b.name = h.name AND b.kind = CASE call WHEN 'constructor' THEN 'instantiates' ELSE 'calls' END""")  # fmt: skip
def enriched_calls(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders").withColumn("line", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    call = F.when(F.col("o_orderkey") % 2 == 0, "constructor").otherwise("method")
    hints = o.select(F.col("o_orderkey").alias("file"), "line", call.alias("call"), F.concat(F.lit("S"), (F.col("o_custkey") + F.col("line")) % 5).alias("name")).distinct()
    return context.enrich_calls(hints, _relations(spark, sf_dir))


@query("merged_relations", f"WITH {RELATIONS_SQL} SELECT file, rel_id, row_number() OVER (PARTITION BY file ORDER BY line, rel_id) AS rel_ord FROM rels")
def merged_relations(spark, sf_dir):
    """The order of relations after a merge: file, line, id."""
    w = Window.partitionBy("file").orderBy("line_start", "rel_id")
    return _relations(spark, sf_dir).select("file", "rel_id", F.row_number().over(w).alias("rel_ord"))


@query("token_locations", """WITH l AS (SELECT doc_id AS path, unnest(range(1, len(ls) + 1)) AS no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
  c AS (SELECT path, no, len(regexp_extract_all(regexp_replace(line, '[^A-Za-z0-9_]+', '  ', 'g'), '(?:^| )the(?: |$)')) AS n FROM l WHERE contains(line, 'the'))
  SELECT path, no, CASE n WHEN 1 THEN 'located' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS status FROM c""")  # fmt: skip
def token_locations(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return context.located_tokens(d.select("path", (F.col("i") + 1).cast("long").alias("no"), "line"), "the")


@query("hierarchy_collisions", """WITH RECURSIVE ext AS (SELECT 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b FROM nation), imp AS (SELECT 'supplier:' || s_suppkey AS a, 'nation:' || s_nationkey AS b FROM supplier WHERE s_nationkey % 2 = 0),
  s AS (SELECT a, b FROM ext UNION SELECT b, a FROM ext UNION SELECT b, a FROM imp), f AS (SELECT 'nation:0' AS node UNION SELECT b FROM f JOIN s ON s.a = f.node) SELECT node FROM f""")  # fmt: skip
def hierarchy_collisions(spark, sf_dir):
    """Types that a renamed method could collide in: extends in both directions, implementors of interfaces downwards. Nations of an
    even key are interfaces, which suppliers implement."""
    extends = t.edges(spark, sf_dir, ["extends"]).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    s = t.table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("a"), F.concat(F.lit("nation:"), "s_nationkey").alias("b"), (F.col("s_nationkey") % 2 == 0).alias("interface"))
    return graph.hierarchy(extends, s.where("interface").select("a", "b"), "nation:0")


SLICES_SQL = """hits AS (SELECT doc_id AS path, unnest(range(1, len(ls) + 1)) AS no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
  s AS (SELECT path, greatest(1, no - 1) AS "start", no + 1 AS "end" FROM hits WHERE contains(lower(line), 'on '))"""


def _slices(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    hits = d.where(F.contains(F.lower("line"), F.lit("on "))).select("path", (F.col("i") + 1).cast("long").alias("no"))
    return hits.select("path", F.greatest(F.lit(1), F.col("no") - 1).alias("start"), (F.col("no") + 1).alias("end"))


@query("context_slices_merged", f"""WITH {SLICES_SQL}, m AS (SELECT *, max("end") OVER (PARTITION BY path ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM s),
  i AS (SELECT *, sum(CASE WHEN upto IS NULL OR "start" > upto THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
  SELECT path, min("start") AS "start", max("end") AS "end" FROM i GROUP BY path, island""")  # fmt: skip
def context_slices_merged(spark, sf_dir):
    return context.merge_slices(_slices(spark, sf_dir))


EDITS_SQL = """e AS (SELECT l_partkey AS path, l_suppkey * 5 + l_linenumber AS "start", l_suppkey * 5 + l_linenumber + (l_quantity::BIGINT % 9) AS "end", l_returnflag || l_linestatus AS token, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
  d AS (SELECT path, "start", "end", arg_max(token, ord) AS token FROM (SELECT path, "start", "end", max(token) AS token, ord FROM e GROUP BY path, "start", "end", ord) GROUP BY 1, 2, 3)"""


def _edits(spark, sf_dir):
    c = F.col
    start = c("l_suppkey") * 5 + c("l_linenumber")
    e = t.table(spark, sf_dir, "lineitem").select(
        c("l_partkey").alias("path"), start.alias("start"), (start + c("l_quantity").cast("long") % 9).alias("end"),
        F.concat("l_returnflag", "l_linestatus").alias("token"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("ord"),
    )
    return context.unique_edits(e.groupBy("path", "start", "end", "ord").agg(F.max("token").alias("token")))


@query("rename_edit_dedupe", f'WITH {EDITS_SQL} SELECT path, "start", "end", token FROM d')
def rename_edit_dedupe(spark, sf_dir):
    return _edits(spark, sf_dir)


@query("rename_overlap_prev", f"""WITH {EDITS_SQL}, o AS (SELECT path, "start", "end", lag("end") OVER (PARTITION BY path ORDER BY "start", "end") AS before FROM d) SELECT * FROM o WHERE "start" < before""")
def rename_overlap_prev(spark, sf_dir):
    return context.overlaps(_edits(spark, sf_dir), False)


_RUNNING_SQL = f"""WITH {EDITS_SQL}, o AS (SELECT path, "start", "end", max("end") OVER (PARTITION BY path ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d)"""


@query("rename_overlap_running", f"""{_RUNNING_SQL} SELECT * FROM o WHERE "start" < before""")
def rename_overlap_running(spark, sf_dir):
    return context.overlaps(_edits(spark, sf_dir), True)


@query("rename_status", f"""{_RUNNING_SQL}, b AS (SELECT path, count(*) AS blockers FROM o WHERE "start" < before GROUP BY 1), r AS (SELECT path, count(*) AS edits, count(*) FILTER (token LIKE 'R%') AS reviews FROM d GROUP BY 1)
  SELECT path, CASE WHEN blockers > 0 THEN 'blocked' WHEN reviews > 0 THEN 'review_required' ELSE 'safe' END AS status, CASE WHEN blockers > 0 THEN 0 ELSE edits END AS edits FROM r LEFT JOIN b USING (path)""")  # fmt: skip
def rename_status(spark, sf_dir):
    edits = _edits(spark, sf_dir)
    b = context.overlaps(edits, True).groupBy("path").agg(F.count("*").alias("blockers"))
    r = edits.groupBy("path").agg(F.count("*").alias("edits"), F.count_if(F.col("token").startswith("R")).alias("reviews"))
    out = r.join(b, "path", "left").fillna(0, ["blockers"])
    return out.select("path", context.status("blockers", "reviews").alias("status"), F.when(F.col("blockers") > 0, 0).otherwise(F.col("edits")).alias("edits"))
