"""Queries of slices and chunks over documents as source files, and of edit contexts over the trade graph as methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymap.operators import edit_context, source
from quarrymap.plans.registry import query
from quarrymap.sources import tables as t

# Each document is a file. Files of the first source have no symbols; of the others each ten lines are a class (each third one a function)
# whose lines 2 to 5 and 6 to 9 are methods. Each eleventh file has moved on.
CODE_SQL = r"""f AS (SELECT 'doc' || doc_id AS path, source, text, sha256(text) AS sha256, CASE WHEN doc_id % 11 = 0 THEN sha256(text || '*') ELSE sha256(text) END AS current,
    CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS n, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
  y AS (SELECT path, n, unnest(range(1, n + 1, 10)) AS s FROM f WHERE source <> 'src0'),
  sy AS (SELECT path || '/' || s AS symbol_id, CASE s // 10 % 3 WHEN 2 THEN 'function' ELSE 'class' END AS kind, path, s, least(n, s + 9) AS e, n FROM y),
  me AS (SELECT symbol_id || '::m' || o AS method_id, symbol_id, path, s + 4 * o - 3 AS s, least(n, s + 4 * o) AS e, o FROM sy, (SELECT unnest([1, 2]) AS o) WHERE kind = 'class' AND s + 4 * o - 3 <= n)"""
_CUT = "array_to_string(ls[{0}:{1}], chr(10)) || CASE WHEN {1} < len(ls) THEN chr(10) ELSE '' END"


def _code(spark, sf_dir):
    """(files, symbols, methods) as CODE_SQL has them."""
    d = t.table(spark, sf_dir, "documents").where("text is not null")
    sha = F.sha2("text", 256)
    current = F.when(F.col("doc_id") % 11 == 0, F.sha2(F.concat("text", F.lit("*")), 256)).otherwise(sha)
    files = d.select(F.concat(F.lit("doc"), "doc_id").alias("path"), "source", sha.alias("sha256"), current.alias("current"), F.col("text").alias("content"))
    n = F.size(source.file_lines("content"))
    counted = files.where("source <> 'src0'").select("path", n.alias("n")).where("n > 0")
    rows = counted.select("path", "n", F.explode(F.expr("sequence(1, n, 10)")).alias("line_start"))
    kind = F.when(F.floor(F.col("line_start") / 10) % 3 == 2, "function").otherwise("class")
    symbols = rows.select(
        F.concat_ws("/", "path", "line_start").alias("symbol_id"), kind.alias("kind"), "path", "line_start", F.least("n", F.col("line_start") + 9).alias("line_end"), "n",
    ).withColumn("fqn", F.col("symbol_id")).withColumn("signature", F.concat_ws(" ", "kind", "symbol_id"))
    own = symbols.where("kind = 'class'").withColumn("ord", F.explode(F.array(F.lit(1), F.lit(2))))
    start = F.col("line_start") + 4 * F.col("ord") - 3
    name = F.concat(F.lit("m"), "ord")
    methods = own.where(start <= F.col("n")).select(
        F.concat("symbol_id", F.lit("::"), name).alias("method_id"), "symbol_id", name.alias("name"), F.concat(F.lit("public "), name, F.lit("()")).alias("signature"), "ord",
        start.alias("line_start"), F.least("n", F.col("line_start") + 4 * F.col("ord")).alias("line_end"), "path",
    )
    return files, symbols.drop("n"), methods


@query("symbol_chunks", f"""WITH {CODE_SQL},
  w AS (SELECT symbol_id, 'symbol_overview' AS kind, path, s, e, least(e, s + 20) AS cut, 'class ' || symbol_id AS signature, chr(10) || 'class ' || symbol_id || coalesce((SELECT string_agg(chr(10) || '    public m' || o || '()', '' ORDER BY o) FROM me WHERE me.symbol_id = sy.symbol_id), '') AS tail FROM sy WHERE kind = 'class'
    UNION ALL SELECT symbol_id, 'function_body', path, s, e, least(e, s + 400), 'function ' || symbol_id, '' FROM sy WHERE kind = 'function'
    UNION ALL SELECT method_id, 'method_body', path, s, e, least(e, s + 400), 'public m' || o || '()', '' FROM me),
  c AS (SELECT symbol_id, kind, path, s::INT AS "start", e::INT AS "end", signature, {_CUT.format('s', 'cut')} || tail AS content FROM w JOIN f USING (path) WHERE current = sha256),
  b AS (SELECT path, ls, n, unnest(range(1, n + 1, 400)) AS s FROM f WHERE source = 'src0' AND current = sha256)
  SELECT * REPLACE (sha256(content) AS content) FROM (SELECT * FROM c UNION ALL SELECT 'file:' || path || ':segment:' || (s // 400 + 1), 'file_body', path, s::INT, least(n, s + 399)::INT, 'file ' || path, {_CUT.format('s', 'least(n, s + 399)')} FROM b)""")  # fmt: skip
def symbol_chunks(spark, sf_dir):
    out = source.symbol_chunks(*_code(spark, sf_dir))
    return out.select("symbol_id", "kind", "path", "start", "end", "signature", F.sha2("content", 256).alias("content"))


@query("skipped_files", f"WITH {CODE_SQL} SELECT path FROM f WHERE current <> sha256")
def skipped_files(spark, sf_dir):
    return source.skipped_files(_code(spark, sf_dir)[0])


# Documents as code with comments: each line is, by the length of the one before it, blank, an attribute, a line comment, a whole doc block,
# the end, a middle or the beginning of one, or code.
_MARK_SQL = "CASE len(x) % 8 WHEN 0 THEN '  ' WHEN 1 THEN '#[A]' WHEN 2 THEN '// x' WHEN 3 THEN '/** x */' WHEN 4 THEN ' */' WHEN 5 THEN ' * x' WHEN 6 THEN '/** x' ELSE 'x();' END"


@query("declaration_slices", f"""WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {_MARK_SQL}) AS ls FROM documents WHERE text IS NOT NULL AND text <> '' AND NOT ends_with(text, chr(10))),
  t AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1, 7)) AS s FROM l),
  u AS (SELECT doc_id, ls, s, s AS up, FALSE AS inside, TRUE AS going FROM t
    UNION ALL SELECT doc_id, ls, s, CASE WHEN ok THEN up - 1 ELSE up END, CASE WHEN inside THEN x <> '/** x' AND x <> '/** x */' ELSE enters END, ok FROM (
      SELECT *, inside OR plain OR enters AS ok FROM (SELECT *, x IN ('', '#[A]', '// x', '/** x */') AS plain, x IN ('*/', '* x') AS enters FROM (SELECT *, trim(ls[up - 1]) AS x FROM u WHERE going AND up > 1 AND s - up < 30)))),
  r AS (SELECT doc_id, ls, s, min(up) AS up FROM u GROUP BY 1, 2, 3)
  SELECT 'doc' || doc_id AS path, s::INT AS line_start, up::INT AS "start", least(len(ls), s + 2)::INT AS "end", sha256(array_to_string(ls[up:least(len(ls), s + 2)], chr(10)) || CASE WHEN s + 2 < len(ls) THEN chr(10) ELSE '' END) AS content FROM r""")  # fmt: skip
def declaration_slices(spark, sf_dir):
    """Slices of three lines at each seventh line, with what belongs to them above."""
    d = t.table(spark, sf_dir, "documents").where("text is not null and text <> ''").where(~F.col("text").endswith("\n"))
    marks = ["  ", "#[A]", "// x", "/** x */", " */", " * x", "/** x", "x();"]
    mark = lambda x: F.element_at(F.array(*map(F.lit, marks)), F.length(x) % 8 + 1)
    content = F.array_join(F.transform(F.split("text", "\n"), mark), "\n")
    files = d.select(F.concat(F.lit("doc"), "doc_id").alias("path"), content.alias("content")).withColumn("sha256", F.sha2("content", 256)).withColumn("current", F.col("sha256"))
    places = files.select("path", F.explode(F.expr("sequence(1, size(split(content, '\\n')), 7)")).alias("line_start"))
    out = source.slices(files, places.withColumn("line_end", F.col("line_start") + 2), above=True)
    return out.select("path", "line_start", "start", "end", F.sha2("content", 256).alias("content"))


# The trade graph as methods: customers and suppliers, of the nation that they belong to, in a file of their nation and segment. Customers of
# the segment BUILDING are tests. A lineitem is a call of a supplier by a customer, or (flag R) of the customer by the supplier; each customer whose
# key is that of a supplier overrides it; customers name their nation as a type.
METHODS_SQL = """methods AS (SELECT 'customer:' || c_custkey AS id, 'nation:' || c_nationkey AS symbol, c_custkey AS ord, CASE c_mktsegment WHEN 'BUILDING' THEN 'tests/N' || c_nationkey || 'Test.php' ELSE 'src/' || c_mktsegment || '/N' || c_nationkey || '.php' END AS file,
    (c_custkey * 10)::INT AS line_start, (c_custkey * 10 + c_custkey % 7)::INT AS line_end FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 1000000000 + s_suppkey, 'src/supply/N' || s_nationkey || '.php', (s_suppkey * 10)::INT, (s_suppkey * 10 + s_suppkey % 5)::INT FROM supplier),
  symbols AS (SELECT 'nation:' || n_nationkey AS id, 'src/geo/N' || n_nationkey || '.php' AS file, n_nationkey + 5 AS line_start, n_nationkey * 3 + 60 AS line_end FROM nation),
  relations AS (SELECT 'c:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS rel_id, CASE l_returnflag WHEN 'R' THEN 'supplier:' || l_suppkey ELSE 'customer:' || o_custkey END AS source_id,
      CASE l_returnflag WHEN 'R' THEN 'customer:' || o_custkey ELSE 'supplier:' || l_suppkey END AS target_id, 'calls' AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT 'o:' || s_suppkey, 'customer:' || s_suppkey, 'supplier:' || s_suppkey, 'overrides' FROM supplier
    UNION ALL SELECT 't:' || c_custkey, 'customer:' || c_custkey, 'nation:' || c_nationkey, 'references_type' FROM customer)"""


def _methods(spark, sf_dir):
    """(methods, symbols, relations, files) as METHODS_SQL has them."""
    c = F.col
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    customer, supplier, nation = (t.table(spark, sf_dir, n) for n in ("customer", "supplier", "nation"))
    in_test = text("tests/N", c("c_nationkey"), "Test.php")
    file = F.when(c("c_mktsegment") == "BUILDING", in_test).otherwise(text("src/", c("c_mktsegment"), "/N", c("c_nationkey"), ".php"))
    row = lambda key, extra: [(key * 10).cast("int").alias("line_start"), (key * 10 + key % extra).cast("int").alias("line_end")]
    methods = customer.select(text("customer:", c("c_custkey")).alias("id"), text("nation:", c("c_nationkey")).alias("symbol"), c("c_custkey").alias("ord"), file.alias("file"), *row(c("c_custkey"), 7)).unionByName(
        supplier.select(text("supplier:", c("s_suppkey")).alias("id"), text("nation:", c("s_nationkey")).alias("symbol"), (c("s_suppkey") + 1000000000).alias("ord"), text("src/supply/N", c("s_nationkey"), ".php").alias("file"), *row(c("s_suppkey"), 5))
    )
    symbols = nation.select(text("nation:", c("n_nationkey")).alias("id"), text("src/geo/N", c("n_nationkey"), ".php").alias("file"), (c("n_nationkey") + 5).alias("line_start"), (c("n_nationkey") * 3 + 60).alias("line_end"))
    lines = t.table(spark, sf_dir, "lineitem").join(t.table(spark, sf_dir, "orders"), c("l_orderkey") == c("o_orderkey"))
    who, whom, back = text("customer:", c("o_custkey")), text("supplier:", c("l_suppkey")), c("l_returnflag") == "R"
    calls = lines.select(
        text("c:", c("l_orderkey"), ":", c("l_linenumber"), ":", c("l_partkey"), ":", c("l_suppkey")).alias("rel_id"), F.when(back, whom).otherwise(who).alias("source_id"),
        F.when(back, who).otherwise(whom).alias("target_id"), F.lit("calls").alias("kind"),
    )
    over = supplier.select(text("o:", c("s_suppkey")).alias("rel_id"), text("customer:", c("s_suppkey")).alias("source_id"), text("supplier:", c("s_suppkey")).alias("target_id"), F.lit("overrides").alias("kind"))
    named = customer.select(text("t:", c("c_custkey")).alias("rel_id"), text("customer:", c("c_custkey")).alias("source_id"), text("nation:", c("c_nationkey")).alias("target_id"), F.lit("references_type").alias("kind"))
    relations = calls.unionByName(over).unionByName(named)
    return methods, symbols, relations, methods.select(c("file").alias("path")).union(symbols.select("file")).distinct()


CANDIDATES_SQL = f"""{METHODS_SQL}, plans AS (SELECT id AS plan, file FROM methods), calls AS (SELECT * FROM relations WHERE kind = 'calls'), tm AS (SELECT *, file LIKE 'tests/%' AS test FROM methods),
  above AS (SELECT plan, target_id AS symbol, rel_id FROM plans JOIN relations ON source_id = plan AND kind = 'overrides'), below AS (SELECT plan, source_id AS symbol, rel_id FROM plans JOIN relations ON target_id = plan AND kind = 'overrides'),
  called AS (SELECT plan, plan AS t FROM plans UNION SELECT plan, symbol FROM above UNION SELECT plan, symbol FROM below),
  callers AS (SELECT plan, source_id AS symbol, rel_id, file, line_start, line_end, test FROM called JOIN calls ON target_id = t JOIN tm ON tm.id = source_id),
  covering AS (SELECT p.plan, source_id AS symbol, rel_id, file, line_start, line_end FROM (SELECT DISTINCT plan, symbol FROM callers WHERE NOT test) p JOIN calls ON target_id = p.symbol JOIN tm ON tm.id = source_id AND test),
  shapes AS (SELECT s.id, s.file, s.line_start, least(least(s.line_end, s.line_start + 30), coalesce(greatest(s.line_start, m.first - 1), s.line_end)) AS line_end FROM symbols s LEFT JOIN (SELECT symbol, arg_min(line_start, ord) AS first FROM methods GROUP BY 1) m ON m.symbol = s.id),
  based AS (SELECT DISTINCT file AS path, regexp_replace(regexp_replace(string_split(file, '/')[-1], '\\.[^.]*$', ''), 'Test$', '') AS base FROM (SELECT file FROM methods UNION SELECT file FROM symbols)),
  likely AS (SELECT path, test FROM (SELECT a.path, b.path AS test, row_number() OVER (PARTITION BY a.path ORDER BY b.path) AS rn FROM based a JOIN based b ON b.path LIKE 'tests/%' AND a.path <> b.path AND (contains(a.base, b.base) OR contains(b.base, a.base))) WHERE rn <= 3),
  few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ord) AS rn FROM methods) WHERE rn <= 3),
  cand AS (SELECT plan, plan AS symbol, m.file, line_start, line_end, 'primary' AS role, 0 AS priority, TRUE AS mandatory, NULL AS evidence, 'requested edit target' AS reason FROM plans JOIN methods m ON id = plan
    UNION ALL SELECT plan, a.symbol, file, line_start, line_end, 'contract', 10, TRUE, rel_id, 'overridden or implemented contract' FROM above a JOIN methods m ON id = a.symbol
    UNION ALL SELECT plan, a.symbol, file, line_start, line_end, 'contract', 10, FALSE, rel_id, 'method overriding the requested target' FROM below a JOIN methods m ON id = a.symbol
    UNION ALL SELECT plan, symbol, file, line_start, line_end, CASE WHEN test THEN 'verification' ELSE 'change_candidate' END, 20, FALSE, rel_id, CASE WHEN test THEN 'direct test caller' ELSE 'direct caller that may need adaptation' END FROM callers
    UNION ALL SELECT plan, symbol, file, line_start, line_end, 'verification', 20, FALSE, rel_id, 'test covering a direct caller of the target' FROM covering
    UNION ALL SELECT plan, target_id, m.file, line_start, line_end, 'dependency', 30, FALSE, rel_id, 'direct callee used by the target' FROM plans JOIN calls ON source_id = plan JOIN methods m ON m.id = target_id
    UNION ALL SELECT plan, target_id, s.file, line_start, line_end, 'type_definition', 40, FALSE, rel_id, 'type referenced by the target signature' FROM plans JOIN relations r ON source_id = plan AND r.kind = 'references_type' JOIN shapes s ON s.id = target_id
    UNION ALL SELECT plan, w.id, w.file, w.line_start, w.line_end, 'verification', 50, FALSE, NULL, 'heuristic test candidate; no direct test call was resolved' FROM plans JOIN likely ON likely.path = plans.file JOIN few w ON w.file = likely.test
      WHERE plan NOT IN (SELECT plan FROM callers WHERE test) AND plan NOT IN (SELECT plan FROM covering)),
  u AS (SELECT plan, symbol, role, reason, min(priority) AS priority, bool_or(mandatory) AS mandatory, min({{'f': file, 's': line_start, 'e': line_end}}) AS x, count(DISTINCT evidence) AS evidence, min(evidence) AS first_evidence FROM cand GROUP BY 1, 2, 3, 4)"""


@query("edit_candidates", f"""WITH {CANDIDATES_SQL} SELECT plan, role, reason, min(priority) AS priority, bool_or(mandatory) AS mandatory, count(*) AS candidates, min(symbol) AS first_symbol, max(symbol) AS last_symbol,
  min(x.f) AS first_file, sum(x.s)::BIGINT AS starts, sum(x.e)::BIGINT AS ends, sum(evidence)::BIGINT AS evidence, min(first_evidence) AS first_evidence FROM u GROUP BY 1, 2, 3""")  # fmt: skip
def edit_candidates(spark, sf_dir):
    """Every method of the table as a target; of each target's candidates of a kind the number and sums, since they are many."""
    return edit_context.candidate_totals(*_methods(spark, sf_dir), tests=3)


POLICY = edit_context.Policy(bytes=900, files=4, callers=3, callees=3, tests=2, types=1)
_FITS = f"(f.used + o.size <= {POLICY.bytes} AND (list_contains(f.files, o.file) OR len(f.files) < {POLICY.files}))"
_FULL = f"((o.role = 'change_candidate' AND f.c >= {POLICY.callers}) OR (o.role = 'dependency' AND f.d >= {POLICY.callees}) OR (o.role = 'verification' AND f.v >= {POLICY.tests}) OR (o.role = 'type_definition' AND f.t >= {POLICY.types}))"
_TAKEN = f"(NOT f.failed AND (o.mandatory OR NOT {_FULL}) AND {_FITS})"


@query("edit_plans", f"""WITH RECURSIVE {CANDIDATES_SQL}, sized AS MATERIALIZED (SELECT plan, symbol, role, reason, priority, mandatory, x.f AS file, x.s AS line_start, 30 * (x.e - x.s + 1) AS size FROM u),
  o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY priority, file, line_start, symbol, role, reason) AS rn, count(*) OVER (PARTITION BY plan) AS n FROM sized),
  f AS (SELECT plan, 0::BIGINT AS rn, 0::BIGINT AS used, []::VARCHAR[] AS chosen, []::VARCHAR[] AS files, FALSE AS failed, 0 AS c, 0 AS d, 0 AS v, 0 AS t, n FROM o WHERE rn = 1
    UNION ALL SELECT f.plan, o.rn, CASE WHEN {_TAKEN} THEN f.used + o.size ELSE f.used END, CASE WHEN {_TAKEN} THEN list_append(f.chosen, o.role || ' ' || o.symbol) ELSE f.chosen END,
      CASE WHEN {_TAKEN} AND NOT list_contains(f.files, o.file) THEN list_append(f.files, o.file) ELSE f.files END, f.failed OR (o.mandatory AND NOT {_FITS}),
      f.c + ({_TAKEN} AND o.role = 'change_candidate')::INT, f.d + ({_TAKEN} AND o.role = 'dependency')::INT, f.v + ({_TAKEN} AND o.role = 'verification')::INT, f.t + ({_TAKEN} AND o.role = 'type_definition')::INT, f.n
      FROM f JOIN o ON o.plan = f.plan AND o.rn = f.rn + 1)
  SELECT plan, array_to_string(chosen, ',') AS chosen, n - len(chosen) AS omitted, used, len(files)::INT AS files, failed FROM f WHERE rn = n""")  # fmt: skip
def edit_plans(spark, sf_dir):
    """Sizes are 30 bytes a line."""
    size = 30 * (F.col("line_end") - F.col("line_start") + 1).cast("long")
    out = edit_context.method_plans(*_methods(spark, sf_dir), size, POLICY, tests=3)
    return out.withColumn("chosen", F.array_join(F.transform("chosen", lambda c: F.concat_ws(" ", c["role"], c["symbol"])), ","))
