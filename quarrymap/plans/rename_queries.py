"""Queries of rename plans: nations and regions as types, the goods of their suppliers as methods, orders as calls of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymap.operators import rename
from quarrymap.plans.registry import query
from quarrymap.sources import tables as t

# Nations are classes (two of them traits), every fifth one is extended by the next four and implements the interface of its region. A method of a type is one
# of twenty goods; methods of the same name override each other upwards. An order is a call in the file of its customer, a line each: of
# the method of a supplier, at times of a second one, at times by a name known only at run time, at times twice in a line; names differ in
# their case, and comments and strings hold more of them. Each method is asked to take the name of another, or a fresh or a bad one.
RENAME_SQL = r"""symbols AS (SELECT 'class:App\N' || n_nationkey AS id, CASE WHEN n_nationkey IN (6, 13) THEN 'trait' ELSE 'class' END AS kind, 'App\N' || n_nationkey AS fqn FROM nation UNION ALL SELECT 'class:App\R' || r_regionkey, 'interface', 'App\R' || r_regionkey FROM region),
  goods AS (SELECT DISTINCT 'N' || s_nationkey AS o, s_suppkey % 20 AS k FROM supplier UNION SELECT DISTINCT 'R' || n_regionkey, s_suppkey % 20 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 3 = 0),
  methods AS (SELECT 'method:App\' || o || '::save' || k AS id, 'class:App\' || o AS symbol, 'save' || k AS name, o || '.php' AS file, (1 + row_number() OVER (PARTITION BY o ORDER BY k))::INT AS line_start, o, k FROM goods),
  ups AS (SELECT 'N' || n_nationkey AS a, 'R' || n_regionkey AS b, 'implements' AS kind FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'N' || n_nationkey, 'N' || (n_nationkey - n_nationkey % 5), 'extends' FROM nation WHERE n_nationkey % 5 <> 0
    UNION ALL SELECT 'N' || n_nationkey, 'N6', 'uses_trait' FROM nation WHERE n_nationkey % 5 = 4),
  orders_at AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS ln, s_nationkey AS n, s_suppkey % 20 AS k FROM orders JOIN supplier ON s_suppkey = o_orderkey % 100 + 1),
  relations AS (SELECT 'o:' || a.id AS rel_id, a.id AS source_id, b.id AS target_id, 'overrides' AS kind, 'phpstan_resolved' AS resolution, a.file, a.line_start, NULL AS receiver FROM methods a JOIN ups ON ups.a = a.o AND ups.kind <> 'uses_trait' JOIN methods b ON b.o = ups.b AND b.k = a.k
    UNION ALL SELECT 'x:' || id, id, 'method:Ext\Base::' || name, 'overrides', 'phpstan_resolved', file, line_start, NULL FROM methods WHERE o = 'N3' AND k % 4 = 0
    UNION ALL SELECT 'c:' || o_orderkey, 'customer:' || o_custkey, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 40 = 7 THEN 'unresolved:calls' ELSE 'method:App\N' || n || '::save' || k END, 'calls',
      CASE WHEN o_orderstatus = 'P' AND o_orderkey % 40 = 7 THEN 'dynamic' WHEN o_orderkey % 499 = 1 THEN 'structural_only' WHEN o_orderkey % 301 = 2 THEN 'multiple_targets' ELSE 'phpstan_resolved' END, 'c' || o_custkey || '.php', ln, 'null|\App\N' || n FROM orders_at
    UNION ALL SELECT 'c:' || o_orderkey, 'customer:' || o_custkey, 'method:App\N' || n || '::save' || (k + 1) % 20, 'calls', 'multiple_targets', 'c' || o_custkey || '.php', ln, NULL FROM orders_at WHERE o_orderkey % 301 = 2 AND NOT (o_orderstatus = 'P' AND o_orderkey % 40 = 7) AND o_orderkey % 499 <> 1),
  content AS (SELECT o || '.php' AS path, '<?php // save1( é' || chr(10) || string_agg('  public function ' || name || '(int $é) { return "->' || name || '("; }', chr(10) ORDER BY k) AS content FROM methods GROUP BY o
    UNION ALL SELECT 'c' || o_custkey || '.php', string_agg('/* Größe ->save' || k || '( */ $é->' || CASE WHEN o_orderkey % 3 = 0 THEN 'SAVE' ELSE 'save' END || k || ' (1);' || CASE WHEN o_orderkey % 797 = 5 THEN ' $y->save' || k || '();' ELSE ' // ->save' || k || '(' END, chr(10) ORDER BY ln) FROM orders_at GROUP BY o_custkey),
  renames AS (SELECT id AS plan, name AS old, CASE WHEN k % 7 = 3 THEN '9bad' WHEN k % 3 = 0 THEN 'save' || (k * 3 + 1) % 20 ELSE 'keep' || k END AS new FROM methods)"""


def _tables(spark, sf_dir):
    """(renames, methods, symbols, relations, files) as RENAME_SQL has them."""
    c = F.col
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    nation, region, supplier, orders = (t.table(spark, sf_dir, n) for n in ("nation", "region", "supplier", "orders"))
    kind = F.when(c("n_nationkey").isin(6, 13), "trait").otherwise("class")
    symbols = nation.select(text("class:App\\N", c("n_nationkey")).alias("id"), kind.alias("kind"), text("App\\N", c("n_nationkey")).alias("fqn")).union(
        region.select(text("class:App\\R", c("r_regionkey")), F.lit("interface"), text("App\\R", c("r_regionkey")))
    )
    k = (c("s_suppkey") % 20).alias("k")
    shared = supplier.where("s_suppkey % 3 = 0").join(nation, c("n_nationkey") == c("s_nationkey")).select(text("R", c("n_regionkey")).alias("o"), k)
    goods = supplier.select(text("N", c("s_nationkey")).alias("o"), k).union(shared).distinct()
    name = text("save", c("k"))
    line = (1 + F.row_number().over(Window.partitionBy("o").orderBy("k"))).cast("int")
    methods = goods.select(text("method:App\\", c("o"), "::save", c("k")).alias("id"), text("class:App\\", c("o")).alias("symbol"), name.alias("name"), text(c("o"), ".php").alias("file"), line.alias("line_start"), line.alias("line_end"), "o", "k")
    n = c("n_nationkey")
    ups = nation.where(n % 5 == 0).select(text("N", n).alias("a"), text("R", c("n_regionkey")).alias("b"), F.lit("implements").alias("kind")).union(
        nation.where(n % 5 != 0).select(text("N", n), text("N", n - n % 5), F.lit("extends"))
    ).union(nation.where(n % 5 == 4).select(text("N", n), F.lit("N6"), F.lit("uses_trait")))
    at = orders.join(supplier, c("s_suppkey") == c("o_orderkey") % 100 + 1).select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("ln"), c("s_nationkey").alias("n"), k,
    )
    nothing = F.lit(None).cast("string")
    sure = F.lit("phpstan_resolved")
    row = lambda rel, source, target, kind, resolution, file, ln, receiver: [rel.alias("rel_id"), source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("kind"), resolution.alias("resolution"), file.alias("file"), ln.alias("line_start"), ln.alias("line_end"), receiver.alias("receiver_type")]
    upper = methods.select(c("id").alias("up"), c("o").alias("b"), "k")
    over = methods.withColumnRenamed("o", "a").join(ups.where("kind <> 'uses_trait'").drop("kind"), "a").join(upper, ["b", "k"])
    over = over.select(*row(text("o:", c("id")), c("id"), c("up"), "overrides", sure, c("file"), c("line_start"), nothing))
    outer = methods.where("o = 'N3' and k % 4 = 0").select(*row(text("x:", c("id")), c("id"), text("method:Ext\\Base::", c("name")), "overrides", sure, c("file"), c("line_start"), nothing))
    types = ups.select(text("u:", c("a"), c("b")).alias("rel_id"), text("class:App\\", c("a")).alias("source_id"), text("class:App\\", c("b")).alias("target_id"), "kind", sure.alias("resolution"), F.lit("").alias("file"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), nothing.alias("receiver_type"))
    dynamic = (c("o_orderstatus") == "P") & (c("o_orderkey") % 40 == 7)
    key = c("o_orderkey")
    resolution = F.when(dynamic, "dynamic").when(key % 499 == 1, "structural_only").when(key % 301 == 2, "multiple_targets").otherwise(sure)
    file, who, rel = text("c", c("o_custkey"), ".php"), text("customer:", c("o_custkey")), text("c:", key)
    target = text("method:App\\N", c("n"), "::save", c("k"))
    calls = at.select(*row(rel, who, F.when(dynamic, "unresolved:calls").otherwise(target), "calls", resolution, file, c("ln"), text("null|\\App\\N", c("n"))))
    second = at.where((key % 301 == 2) & ~dynamic & (key % 499 != 1)).select(*row(rel, who, text("method:App\\N", c("n"), "::save", (c("k") + 1) % 20), "calls", F.lit("multiple_targets"), file, c("ln"), nothing))
    declared = text("  public function ", c("name"), "(int $é) { return \"->", c("name"), "(\"; }")
    lines = lambda order, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n")
    classes = methods.groupBy(text(c("o"), ".php").alias("path")).agg(F.concat(F.lit("<?php // save1( é\n"), lines("k", declared)).alias("content"))
    word = text(F.when(key % 3 == 0, "SAVE").otherwise("save"), c("k"))
    tail = F.when(key % 797 == 5, text(" $y->save", c("k"), "();")).otherwise(text(" // ->save", c("k"), "("))
    call = F.concat(text("/* Größe ->save", c("k"), "( */ $é->"), word, F.lit(" (1);"), tail)
    used = at.groupBy(file.alias("path")).agg(lines("ln", call).alias("content"))
    files = classes.union(used).withColumn("sha256", F.sha2("content", 256)).withColumn("current", c("sha256"))
    new = F.when(c("k") % 7 == 3, "9bad").when(c("k") % 3 == 0, text("save", (c("k") * 3 + 1) % 20)).otherwise(text("keep", c("k")))
    renames = methods.select(c("id").alias("plan"), c("id").alias("target"), new.alias("replacement"))
    return renames, methods, symbols, over.unionByName(outer).unionByName(types).unionByName(calls).unionByName(second), files


TOKENS_SQL = r"""pieces AS (SELECT path, unnest(ps) AS piece, generate_subscripts(ps, 1) AS no FROM (SELECT path, regexp_extract_all(content, $$/\*(?s:.*?)\*/|//[^\n]*|'[^']*'|"[^"]*"|[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*|[^A-Za-z_\x{80}-\x{10FFFF}'"/#]+|(?s:.)$$) AS ps FROM content)),
  placed AS (SELECT path, no, piece, coalesce(sum(strlen(piece)) OVER w, 0)::BIGINT AS s, 1 + coalesce(sum(len(piece) - len(replace(piece, chr(10), ''))) OVER w, 0)::BIGINT AS line FROM pieces WINDOW w AS (PARTITION BY path ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  shown AS (SELECT *, trim(lag(piece) OVER w, ' ' || chr(10)) AS b1, lower(lag(piece, 2) OVER w) AS b2, trim(lead(piece) OVER w, ' ' || chr(10)) AS nx FROM placed WHERE NOT starts_with(piece, '/*') AND NOT starts_with(piece, '//') WINDOW w AS (PARTITION BY path ORDER BY no)),
  tokens AS (SELECT path, lower(piece) AS name, piece AS actual, s, s + strlen(piece) - 1 AS e, line, CASE WHEN b1 = '' AND b2 = 'function' THEN 'declaration' ELSE 'call' END AS role FROM shown
    WHERE regexp_matches(piece, '^[A-Za-z_]') AND (((ends_with(b1, '->') OR ends_with(b1, '::')) AND starts_with(nx, '(')) OR (b1 = '' AND b2 = 'function')))"""

PLANS_SQL = rf"""{RENAME_SQL}, {TOKENS_SQL}, ov AS (SELECT source_id AS a, target_id AS b FROM relations WHERE kind = 'overrides'), io AS (SELECT a, b FROM ov WHERE b IN (SELECT id FROM methods) UNION SELECT b, a FROM ov WHERE b IN (SELECT id FROM methods)),
  fam AS (SELECT id AS plan, id FROM methods UNION SELECT fam.plan, io.b FROM fam JOIN io ON io.a = fam.id),
  ty AS (SELECT plan, m.o AS t FROM fam JOIN methods m USING (id) UNION SELECT plan, n FROM ty JOIN (SELECT a, b AS n FROM ups WHERE kind = 'extends' UNION SELECT b, a FROM ups WHERE kind = 'extends' UNION SELECT b, a FROM ups WHERE kind = 'implements') st ON st.a = ty.t),
  scan AS (SELECT plan, t FROM ty UNION SELECT plan, b FROM ty JOIN ups ON ups.a = t AND kind IN ('implements', 'uses_trait')),
  good AS (SELECT * FROM renames WHERE new <> '9bad' AND lower(new) <> lower(old)),
  b1 AS (SELECT DISTINCT plan, 'x' || target_id AS b FROM good JOIN fam USING (plan) JOIN relations r ON r.kind = 'overrides' AND r.source_id = fam.id AND target_id LIKE 'method:Ext%'
    UNION SELECT plan, 't' || fam.id FROM good JOIN fam USING (plan) JOIN methods m USING (id) WHERE m.o IN ('N6', 'N13')
    UNION SELECT g.plan, 'c' || m.id FROM good g JOIN scan USING (plan) JOIN methods m ON m.o = scan.t AND m.name = g.new WHERE NOT EXISTS (SELECT 1 FROM fam f WHERE f.plan = g.plan AND f.id = m.id)),
  live AS (SELECT * FROM good WHERE plan NOT IN (SELECT plan FROM b1)), lf AS (SELECT fam.* FROM fam JOIN live USING (plan)),
  hit AS (SELECT plan, rel_id, any_value(resolution) AS resolution, any_value(file) AS path, any_value(line_start) AS ln FROM relations r JOIN lf ON lf.id = target_id WHERE kind = 'calls' GROUP BY 1, 2),
  stray AS (SELECT DISTINCT plan, rel_id FROM hit JOIN relations r USING (rel_id) WHERE NOT EXISTS (SELECT 1 FROM lf WHERE lf.plan = hit.plan AND lf.id = r.target_id)),
  ev AS (SELECT plan, 'declaration' AS role, file AS path, line_start AS ln, m.name, '' AS rel_id FROM lf JOIN methods m USING (id)
    UNION ALL SELECT plan, 'call', path, ln, old, rel_id FROM hit JOIN live USING (plan) WHERE resolution <> 'structural_only' AND NOT EXISTS (SELECT 1 FROM stray s WHERE s.plan = hit.plan AND s.rel_id = hit.rel_id)),
  loc AS (SELECT plan, ev.role, ev.path, ln, ev.name, rel_id, count(t.s) AS found, min(t.s) AS s, min(t.e) AS e, min(t.actual) AS actual FROM ev LEFT JOIN tokens t ON t.path = ev.path AND t.role = ev.role AND t.name = lower(ev.name) AND t.line = ln GROUP BY 1, 2, 3, 4, 5, 6),
  b2 AS (SELECT DISTINCT plan, path || ln || 's' AS b FROM hit JOIN stray USING (plan, rel_id) UNION SELECT plan, path || ln || 'u' FROM hit WHERE resolution = 'structural_only' AND NOT EXISTS (SELECT 1 FROM stray s WHERE s.plan = hit.plan AND s.rel_id = hit.rel_id)
    UNION SELECT DISTINCT plan, path || ln || role || name || 'l' FROM loc WHERE found <> 1),
  bl AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2),
  edits AS (SELECT plan, path, s, e, any_value(actual) AS expected, any_value(role) AS role FROM loc WHERE found = 1 AND plan NOT IN (SELECT plan FROM bl) GROUP BY 1, 2, 3, 4),
  blind AS (SELECT DISTINCT plan, r.file, r.line_start FROM lf JOIN methods m USING (id) JOIN relations r ON r.kind = 'calls' AND r.resolution = 'dynamic' AND r.receiver = 'null|\App\' || m.o)"""


@query("rename_plans", rf"""WITH RECURSIVE {PLANS_SQL} SELECT r.plan, CASE WHEN r.plan NOT IN (SELECT plan FROM good) THEN 'invalid' WHEN bn > 0 THEN 'blocked' WHEN dn > 0 THEN 'review_required' ELSE 'safe' END AS status,
  CASE WHEN r.plan IN (SELECT plan FROM good) THEN fn ELSE 0 END AS family, coalesce(en, 0) AS edits, coalesce(bn, 0) AS blockers, coalesce(dn, 0) AS blind_spots FROM renames r LEFT JOIN (SELECT plan, count(*) AS fn FROM fam GROUP BY 1) USING (plan) LEFT JOIN (SELECT plan, count(*) AS en FROM edits GROUP BY 1) USING (plan)
  LEFT JOIN (SELECT plan, count(*) AS bn FROM bl GROUP BY 1) USING (plan) LEFT JOIN (SELECT plan, count(*) AS dn FROM blind GROUP BY 1) USING (plan)""")  # fmt: skip
def rename_plans(spark, sf_dir):
    """Each method of the tables as a target."""
    return rename.rename_plans(*_tables(spark, sf_dir)).plans


@query("rename_edits", rf"""WITH RECURSIVE {PLANS_SQL} SELECT plan, path, s AS "start", e::BIGINT AS "end", expected, new AS replacement, role FROM edits JOIN renames USING (plan)""")
def rename_edits(spark, sf_dir):
    """The edits of all plans that nothing stands against, by place in bytes."""
    out = rename.rename_plans(*_tables(spark, sf_dir)).edits
    return out.select("plan", "path", "start", F.col("end").cast("long").alias("end"), "expected", "replacement", "role")


@query("name_tokens", rf"""WITH {RENAME_SQL}, {TOKENS_SQL} SELECT path, role, name, actual, s AS "start", e::BIGINT AS "end", line FROM tokens""")
def name_tokens(spark, sf_dir):
    files = _tables(spark, sf_dir)[4]
    return rename.name_tokens(files).withColumn("end", F.col("end").cast("long"))
