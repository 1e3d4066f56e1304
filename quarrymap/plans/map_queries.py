"""Queries of the map family: resolution, signatures, reconciliation, state, over documents and trade tables as code."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymap.functions import text as tx
from quarrymap.operators import ingest, lookup, resolve, state
from quarrymap.plans.registry import query
from quarrymap.sources import tables as t
from quarrymap.sources.tables import COPY_SQL, FILES_SQL

#: Each language and source is a class, documents are its methods.
METHODS_SQL = r"""methods AS (SELECT DISTINCT lang || '\' || source AS fqn, source AS name, 'm' || doc_id % 50 AS method, CASE WHEN doc_id % 50 = 49 THEN 'conflict' ELSE 'confirmed' END AS state FROM documents)"""
TARGETS = [r"en\src1::m1", r"\en\src1::m1", "src1::m1", "src1::zz", "nope::m3", "plain", "::m1", r"de\src2::m49", r"fr\src0::M1"]
_VALUES = "(VALUES " + ", ".join(f"('{x}')" for x in TARGETS) + ") v(target)"


def _methods(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents")
    n = F.col("doc_id") % 50
    return d.select(
        F.concat("lang", F.lit("\\"), "source").alias("fqn"), F.col("source").alias("name"), F.concat(F.lit("m"), n).alias("method"),
        F.when(n == 49, "conflict").otherwise("confirmed").alias("state"),
    ).distinct()


@query("resolve_method", rf"""WITH {METHODS_SQL}, c AS (SELECT target, regexp_replace(trim(target), '^\\+', '') AS clean FROM {_VALUES}),
  p AS (SELECT target, CASE WHEN strpos(clean, '::') > 0 THEN regexp_replace(clean, '::[^:]*$', '') ELSE '' END AS cls, string_split(clean, '::')[-1] AS m, strpos(clean, '::') > 0 AS sep FROM c),
  h AS (SELECT target, fqn || '::' || method AS full_name, state, CASE WHEN contains(cls, '\') THEN fqn = cls ELSE name = cls END AS hit FROM p JOIN methods ON method = m WHERE sep AND cls <> '' AND m <> ''),
  g AS (SELECT target, count(*) FILTER (hit) AS hits, count(*) FILTER (hit AND state = 'conflict') AS conflicts, min(full_name) FILTER (hit) AS id, list(full_name ORDER BY full_name) FILTER (hit) AS hs, list(full_name ORDER BY full_name) AS alls FROM h GROUP BY 1),
  s AS (SELECT p.target, CASE WHEN NOT (sep AND cls <> '' AND m <> '') THEN 'invalid' WHEN conflicts > 0 THEN 'conflict' WHEN coalesce(hits, 0) = 0 THEN 'not_found' WHEN hits = 1 THEN 'found' ELSE 'ambiguous' END AS status, id, hs, alls FROM p LEFT JOIN g USING (target))
  SELECT target, status, CASE WHEN status = 'found' THEN 'method:' || id END AS method_id, CASE status WHEN 'ambiguous' THEN array_to_string(hs, ',') WHEN 'not_found' THEN coalesce(array_to_string(alls[:10], ','), '') ELSE '' END AS candidates FROM s""")  # fmt: skip
def resolve_method(spark, sf_dir):
    return resolve.resolve_methods(_methods(spark, sf_dir), spark.createDataFrame([(x,) for x in TARGETS], "target string"))


TERMS = [r"en\src1", "src1", "src2", "helper", "none"]
SYMBOLS_SQL = r"""symbols AS (SELECT DISTINCT 'class' AS kind, lang || '\' || source AS fqn, source AS name FROM documents UNION ALL SELECT 'function', 'lib\src2', 'src2' UNION ALL SELECT 'function', 'lib\helper', 'helper' UNION ALL SELECT 'class', 'lib\helper', 'helper')"""


@query("select_symbol", rf"""WITH {SYMBOLS_SQL}, h AS (SELECT DISTINCT term, kind, fqn FROM (VALUES {", ".join(f"('{x}')" for x in TERMS)}) v(term) JOIN symbols ON fqn = term OR name = term),
  g AS (SELECT term, count(*) FILTER (kind = 'function') AS f, count(*) AS n, min(fqn) FILTER (kind = 'function') AS fi, min(kind || ':' || fqn) FILTER (kind <> 'function') AS ci FROM h GROUP BY 1),
  m AS (SELECT term, CASE WHEN f > 0 THEN f ELSE coalesce(n, 0) END AS matches, CASE WHEN f > 0 THEN 'function:' || fi ELSE ci END AS one FROM (VALUES {", ".join(f"('{x}')" for x in TERMS)}) v(term) LEFT JOIN g USING (term))
  SELECT term, CASE matches WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN matches = 1 THEN one END AS symbol_id, matches FROM m""")  # fmt: skip
def select_symbol(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").select(F.lit("class").alias("kind"), F.concat("lang", F.lit("\\"), "source").alias("fqn"), F.col("source").alias("name")).distinct()
    more = spark.createDataFrame([("function", r"lib\src2", "src2"), ("function", r"lib\helper", "helper"), ("class", r"lib\helper", "helper")], "kind string, fqn string, name string")
    return resolve.select_symbols(d.union(more), spark.createDataFrame([(x,) for x in TERMS], "term string"))


REGION_QUERIES = ["nation/1", "FRANCE", " france ", "region/", "region/3", "nation/2", "zzz", " "]


@query("select_region", f"""WITH r AS (SELECT 'nation/' || n_nationkey AS id, n_name AS label FROM nation UNION ALL SELECT 'region/' || r_regionkey, r_name FROM region),
  q AS (SELECT DISTINCT trim(query) AS query FROM (VALUES {", ".join(f"('{x}')" for x in REGION_QUERIES)}) v(query)),
  m AS (SELECT query, id, lower(id) = lower(query) OR lower(label) = lower(query) AS exact FROM q JOIN r ON query <> '' AND (starts_with(id, query) OR lower(id) = lower(query) OR lower(label) = lower(query))),
  g AS (SELECT query, count(*) FILTER (exact) AS e, count(*) AS n, min(id) FILTER (exact) AS ei, min(id) AS ni FROM m GROUP BY 1),
  f AS (SELECT query, CASE WHEN e > 0 THEN e ELSE coalesce(n, 0) END AS matches, coalesce(ei, ni) AS one FROM q LEFT JOIN g USING (query))
  SELECT query, CASE WHEN query = '' THEN 'empty' WHEN matches = 0 THEN 'not_found' WHEN matches = 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN matches = 1 THEN one END AS region_id FROM f""")  # fmt: skip
def select_region(spark, sf_dir):
    n = t.table(spark, sf_dir, "nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("id"), F.col("n_name").alias("label"))
    r = t.table(spark, sf_dir, "region").select(F.concat(F.lit("region/"), "r_regionkey"), "r_name")
    return resolve.select_regions(n.union(r), spark.createDataFrame([(x,) for x in REGION_QUERIES], "query string"))


@query("identified_symbols", rf"""WITH {METHODS_SQL}, n AS (SELECT fqn || '::' || method AS q, method AS s FROM methods)
  SELECT q AS id, term FROM n, (VALUES ('M1'), ('src1::m2'), ('EN\SRC1::m3'), ('rc1::m4')) v(term) WHERE lower(q) = lower(term) OR lower(s) = lower(term) OR ends_with(lower(q), '\' || lower(term)) OR ends_with(lower(q), '::' || lower(term))""")  # fmt: skip
def identified_symbols(spark, sf_dir):
    """The terms of a search are few; each row is compared with all of them where it is read."""
    m = _methods(spark, sf_dir).select(F.concat("fqn", F.lit("::"), "method").alias("id"), "method")
    terms = F.array(*[F.lit(x) for x in ("M1", "src1::m2", r"EN\SRC1::m3", "rc1::m4")])
    m = m.withColumn("term", F.explode(terms))
    return m.where(resolve.identifies(F.col("term"), F.col("id"), F.col("method"))).select("id", "term")


RECEIVER_SQL = r"""CASE doc_id % 5 WHEN 0 THEN '\' || lang || '\' || source WHEN 1 THEN lang || '\' || source || '|null' WHEN 2 THEN 'x' || lang || '\' || source WHEN 3 THEN upper(lang) || '\' || source || '&I' ELSE lang || '\' || source || '2' END"""


@query("receiver_owners", rf"""WITH r AS (SELECT doc_id, {RECEIVER_SQL} AS receiver FROM documents)
  SELECT doc_id FROM r WHERE regexp_matches(receiver, '(?i)(^|[^A-Za-z0-9_\\])\\?en\\src1($|[^A-Za-z0-9_\\])')""")  # fmt: skip
def receiver_owners(spark, sf_dir):
    own, m = F.concat("lang", F.lit("\\"), "source"), F.col("doc_id") % 5
    receiver = F.when(m == 0, F.concat(F.lit("\\"), own)).when(m == 1, F.concat(own, F.lit("|null"))).when(m == 2, F.concat(F.lit("x"), own))
    receiver = receiver.when(m == 3, F.concat(F.upper("lang"), F.lit("\\"), "source", F.lit("&I"))).otherwise(F.concat(own, F.lit("2")))
    d = t.table(spark, sf_dir, "documents").select("doc_id", receiver.alias("receiver"))
    return d.where(resolve.receiver_has_owner("receiver", r"en\src1")).select("doc_id")


@query("renamed_tokens", r"""WITH x AS (SELECT DISTINCT 'lib\' || p_brand || '\' || replace(p_name, ' ', '_') AS token, replace(p_name, ' ', '_') AS name FROM part UNION SELECT DISTINCT p_brand, p_brand FROM part)
  SELECT token, regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') AS valid, regexp_replace(token, '[^\\]*$', '') || 'Renamed' AS renamed FROM x""")  # fmt: skip
def renamed_tokens(spark, sf_dir):
    p, name = t.table(spark, sf_dir, "part"), F.replace("p_name", F.lit(" "), F.lit("_"))
    x = p.select(F.concat(F.lit("lib\\"), "p_brand", F.lit("\\"), name).alias("token"), name.alias("name")).union(p.select("p_brand", "p_brand")).distinct()
    return x.select("token", tx.is_method_name(F.col("name")).alias("valid"), tx.with_last_segment(F.col("token"), F.lit("Renamed")).alias("renamed"))


_PARAMS_SQL = "[CASE WHEN s_suppkey % 4 = 1 THEN 'int $a' WHEN s_suppkey % 4 = 2 THEN 'string &$b' ELSE '...$c' END, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'T' || s_nationkey END, 'mixed') || ' $d']"


@query("declaration_signatures", rf"""WITH s AS (SELECT 'class:shop\S' || s_suppkey AS symbol_id, 'method:shop\S' || s_suppkey || '::run' AS method_id, 'class shop\S' || s_suppkey ||
    CASE WHEN s_suppkey % 3 = 0 THEN ' (' || array_to_string({_PARAMS_SQL}, ', ') || ')' ELSE '' END || CASE WHEN s_suppkey % 5 = 0 THEN ' : int' ELSE '' END || ' extends Base' || CASE WHEN s_suppkey % 2 = 0 THEN ' implements A,Z' ELSE '' END AS symbol,
    CASE s_suppkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'protected' ELSE 'private' END || CASE WHEN s_suppkey % 2 = 0 THEN ' static' ELSE '' END || CASE WHEN s_suppkey % 7 = 0 THEN ' final' ELSE '' END || ' run(' || array_to_string({_PARAMS_SQL}, ', ') || ')' ||
    CASE WHEN s_suppkey % 5 = 0 THEN ': int' ELSE '' END || CASE WHEN s_suppkey % 4 = 0 THEN ' attributes Api,Test' ELSE '' END AS method FROM supplier) SELECT * FROM s""")  # fmt: skip
def declaration_signatures(spark, sf_dir):
    k, c = F.col("s_suppkey"), F.col
    lit = lambda *x: F.array(*map(F.lit, x))
    none = F.lit(None).cast("string")
    first = tx.parameter_display(F.when(k % 4 == 1, "int").when(k % 4 == 2, "string"), k % 4 == 2, ~(k % 4).isin(1, 2), F.when(k % 4 == 1, "a").when(k % 4 == 2, "b").otherwise("c"))
    kind = tx.type_display(F.when(k % 2 == 0, F.concat(F.lit("T"), c("s_nationkey"))), none, F.lit("mixed"))
    params = F.array(first, tx.parameter_display(kind, F.lit(False), F.lit(False), F.lit("d")))
    returns, fqn = F.when(k % 5 == 0, "int"), F.concat(F.lit("\\shop\\S"), k)
    lists = {"extends": lit("Base"), "implements": F.when(k % 2 == 0, lit("Z", "A")), "uses": F.array().cast("array<string>")}
    symbol = tx.symbol_signature(F.lit("class"), fqn, F.when(k % 3 == 0, params), returns, lists)
    visibility = F.when(k % 3 == 0, "public").when(k % 3 == 1, "protected").otherwise("private")
    method = tx.method_signature(visibility, k % 2 == 0, F.lit(False), k % 7 == 0, F.lit("run"), params, returns, F.when(k % 4 == 0, lit("Test", "Api")))
    s = t.table(spark, sf_dir, "supplier")
    return s.select(tx.symbol_id(F.lit("class"), fqn).alias("symbol_id"), tx.method_id(fqn, F.lit("run")).alias("method_id"), symbol.alias("symbol"), method.alias("method"))


@query("file_sizes", "SELECT doc_id, CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' B' ELSE regexp_replace(round(strlen(text) / 1024::DOUBLE, 1)::DECIMAL(30, 1)::VARCHAR, '\\.0$', '') || ' KB' END AS size FROM documents")
def file_sizes(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select("doc_id", tx.human_size(F.octet_length("text")).alias("size"))


STRUCTURAL_SQL = r"""structural AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'function:' ELSE 'class:' END || 'doc' || doc_id AS id, lang || '/' || source || '/' || doc_id % 20 AS file FROM documents WHERE doc_id % 7 <> 0),
  semantic AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'function:' ELSE 'class:' END || 'doc' || doc_id AS id, lang || '/' || source || '/' || doc_id % 20 AS file, 'T' || doc_id % 11 AS type FROM documents WHERE doc_id % 5 = 1),
  functions AS (SELECT 'function:doc' || doc_id AS id, 'F' || doc_id % 11 AS type FROM documents WHERE doc_id % 12 = 0),
  merged AS (SELECT s.id, s.file, CASE WHEN f.id IS NOT NULL THEN 'function' WHEN m.id IS NOT NULL THEN 'symbol' ELSE 'none' END AS record, coalesce(f.type, m.type) AS type FROM structural s LEFT JOIN semantic m USING (id) LEFT JOIN functions f USING (id))"""


def _records(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents")
    ident = F.concat(F.when(F.col("doc_id") % 3 == 0, "function:").otherwise("class:"), F.lit("doc"), "doc_id").alias("id")
    file = F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id") % 20).alias("file")
    kind = lambda x: F.concat(F.lit(x), F.col("doc_id") % 11).alias("type")
    functions = d.where("doc_id % 12 = 0").select(F.concat(F.lit("function:doc"), "doc_id").alias("id"), kind("F"))
    return d.where("doc_id % 7 != 0").select(ident, file), d.where("doc_id % 5 = 1").select(ident, file, kind("T")), functions


@query("reconciled_symbols", f"WITH {STRUCTURAL_SQL} SELECT id, file, record, type, CASE record WHEN 'none' THEN 'structural_only' ELSE 'semantic_enrichment' END AS status FROM merged")
def reconciled_symbols(spark, sf_dir):
    return ingest.reconcile(*_records(spark, sf_dir))


# Suppliers as classes: what the structure says of them, and for all but each sixth what a type analyser does.
_MERGE_SQL = r"""x AS (SELECT 'class:S' || s_suppkey AS id, s_suppkey AS k, s_nationkey AS n FROM supplier),
  s AS (SELECT id, k, CASE WHEN n % 2 = 0 THEN ['Base' || n] ELSE []::VARCHAR[] END AS own, CASE WHEN k % 5 = 2 THEN ['Base' || n, 'Extra' || k] WHEN n % 2 = 0 THEN ['Base' || n] ELSE []::VARCHAR[] END AS told FROM x)"""


def _merged(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    s = t.table(spark, sf_dir, "supplier")
    ident = F.concat(F.lit("class:S"), k).alias("id")
    base, none = F.concat(F.lit("Base"), n), F.array().cast("array<string>")
    own = F.when(n % 2 == 0, F.array(base)).otherwise(none)
    structural = s.select(ident, F.lit("class").alias("kind"), F.lit("f.php").alias("file"), own.alias("extends"), none.alias("implements"), none.alias("uses"))
    told = F.when(k % 5 == 2, F.array(F.concat(F.lit("Extra"), k), F.concat(F.lit("\\"), base), base)).when(k % 5 == 3, F.lit(None)).otherwise(own)
    kind, file = F.when(k % 11 == 4, "trait").otherwise("class"), F.when(k % 13 == 5, "g.php")
    templates = F.when(k % 17 == 6, F.create_map(F.lit("T"), F.lit("int")))
    records = s.where(k % 6 != 0).select(ident, kind.alias("kind"), file.alias("file"), told.alias("extends"), F.lit(None).cast("array<string>").alias("implements"), none.alias("uses"), templates.alias("templates"))
    symbols = ingest.merge_symbols(structural, records)
    m = F.concat(F.lit("method:S"), k, F.lit("::run")).alias("id")
    params = F.array(F.concat(F.lit("$a"), k % 3))
    methods = s.select(m, k.cast("int").alias("line_start"), F.when(k % 3 == 0, "int").alias("native"), params.alias("parameters"))
    line = F.when(k % 7 == 1, k + 1).otherwise(k).cast("int")
    known = s.where(k % 6 != 0).select(
        m, line.alias("line_start"), F.lit(None).cast("string").alias("native"), F.when(k % 9 == 2, "list<int>").alias("phpdoc"), F.when(k % 4 == 1, "int").alias("resolved"),
        F.when(k % 10 == 7, F.array(F.lit("$z"))).otherwise(none).alias("parameters"),
    )
    return symbols, ingest.merge_methods(methods, known)


@query("merged_symbols", f"""WITH {_MERGE_SQL} SELECT id, CASE WHEN k % 6 = 0 THEN array_to_string(own, ',') ELSE array_to_string(told, ',') END AS extends, CASE WHEN k % 6 <> 0 AND k % 17 = 6 THEN 1 ELSE 0 END AS templates,
  CASE WHEN k % 6 = 0 THEN 'structural_only' WHEN k % 11 = 4 OR k % 13 = 5 THEN 'conflict' WHEN k % 17 = 6 OR own <> told THEN 'semantic_enrichment' ELSE 'confirmed' END AS status FROM s""")  # fmt: skip
def merged_symbols(spark, sf_dir):
    symbols, _ = _merged(spark, sf_dir)
    return symbols.select("id", F.array_join("extends", ",").alias("extends"), F.size(F.map_keys("templates")).alias("templates"), "status")


@query("merged_methods", f"""WITH {_MERGE_SQL} SELECT 'method:S' || k || '::run' AS id, CASE WHEN k % 6 <> 0 AND k % 10 = 7 THEN '$z' ELSE '$a' || k % 3 END AS parameters, k % 6 <> 0 AND k % 7 = 1 AS moved,
  CASE WHEN k % 6 = 0 THEN 'structural_only' WHEN k % 9 = 2 OR (k % 4 = 1 AND k % 3 <> 0) OR k % 10 = 7 THEN 'semantic_enrichment' ELSE 'confirmed' END AS status FROM s""")  # fmt: skip
def merged_methods(spark, sf_dir):
    _, methods = _merged(spark, sf_dir)
    return methods.select("id", F.array_join("parameters", ",").alias("parameters"), "moved", "status")


@query("merge_diagnostics", f"""WITH {_MERGE_SQL} SELECT 'error' AS level, 'symbol_conflict' AS code, id FROM s WHERE k % 6 <> 0 AND (k % 11 = 4 OR k % 13 = 5)
  UNION ALL SELECT 'info', 'source_range_mismatch', 'method:S' || k || '::run' FROM s WHERE k % 6 <> 0 AND k % 7 = 1""")  # fmt: skip
def merge_diagnostics(spark, sf_dir):
    return ingest.merge_diagnostics(*_merged(spark, sf_dir))


@query("reconciled_files", f"WITH {STRUCTURAL_SQL} SELECT file, CASE WHEN count(*) FILTER (record <> 'none') > 0 THEN 'analysed' ELSE 'no_semantic_records' END AS semantic_status, count(*) FILTER (record = 'none') AS missing FROM merged GROUP BY 1")
def reconciled_files(spark, sf_dir):
    return ingest.file_status(ingest.reconcile(*_records(spark, sf_dir)))


@query("semantic_only_symbols", f"WITH {STRUCTURAL_SQL} SELECT id, file, type FROM semantic WHERE id NOT IN (SELECT id FROM structural) AND file IN (SELECT file FROM structural)")
def semantic_only_symbols(spark, sf_dir):
    structural, semantic, _ = _records(spark, sf_dir)
    return ingest.semantic_only(semantic, structural)


@query("relation_targets", r"""WITH r AS (SELECT doc_id AS rel_id, 'calls' AS kind, CASE WHEN doc_id % 9 <> 0 THEN CASE WHEN doc_id % 4 = 0 THEN '\' ELSE '' END || 'doc' || doc_id * 2 || CASE WHEN doc_id % 2 = 0 THEN '<int>' ELSE '' END END AS target FROM documents),
  b AS (SELECT *, regexp_replace(regexp_replace(target, '<.*$', ''), '^\\+', '') AS base FROM r)
  SELECT rel_id, kind, CASE WHEN target IS NULL THEN 'unresolved:' || kind WHEN doc_id IS NOT NULL THEN 'class:doc' || doc_id ELSE 'type:' || base END AS target_id FROM b LEFT JOIN documents ON base = 'doc' || doc_id""")  # fmt: skip
def relation_targets(spark, sf_dir):
    d, k = t.table(spark, sf_dir, "documents"), F.col("doc_id")
    target = F.concat(F.when(k % 4 == 0, "\\").otherwise(""), F.lit("doc"), k * 2, F.when(k % 2 == 0, "<int>").otherwise(""))
    relations = d.select(k.alias("rel_id"), F.lit("calls").alias("kind"), F.when(k % 9 != 0, target).alias("target"))
    known = d.select(F.concat(F.lit("doc"), "doc_id").alias("fqn"), F.concat(F.lit("class:doc"), "doc_id").alias("id"))
    return ingest.target_ids(relations, known)


@query("unique_diagnostics", """WITH r AS (SELECT 'diagnostic:' || sha256('warning' || chr(0) || event_type || chr(0) || user_id) AS id, event_type AS kind, user_id, event_id FROM events)
  SELECT id, arg_max(kind, event_id) AS kind, arg_max(user_id, event_id) AS user_id, max(event_id) AS event_id FROM r GROUP BY 1 ORDER BY 1""")  # fmt: skip
def unique_diagnostics(spark, sf_dir):
    e = t.table(spark, sf_dir, "events")
    rows = e.select(F.concat(F.lit("diagnostic:"), tx.nul_hash(F.lit("warning"), F.col("event_type"), F.col("user_id"))).alias("id"), F.col("event_type").alias("kind"), "user_id", "event_id")
    return ingest.unique_by_id(rows, "event_id")


@query("changed_hashes", f"WITH {FILES_SQL}, {COPY_SQL}, k AS (SELECT path, min(current) AS known FROM copy GROUP BY 1) SELECT path FROM files LEFT JOIN k USING (path) WHERE known IS DISTINCT FROM sha256")
def changed_hashes(spark, sf_dir):
    f = t.files(spark, sf_dir)
    return ingest.changed_hashes(f.select("path", "sha256"), t.working_copy(f).select("path", F.col("current").alias("source_sha256")))


_CHUNK_SQL = "SELECT 'c' || doc_id % 700 AS chunk_id, lang || '/' || source AS path, doc_id AS ord, sha256(text) AS sha256 FROM documents"


@query("chunk_replace", f"""WITH old AS ({_CHUNK_SQL} WHERE doc_id % 2 = 0), fresh AS ({_CHUNK_SQL} WHERE doc_id % 2 = 1), kept AS (SELECT *, 0 AS age FROM old WHERE path NOT IN (SELECT path FROM fresh WHERE ord % 11 = 0) UNION ALL SELECT *, 1 FROM fresh)
  SELECT chunk_id, arg_min(path, (age, ord)) AS path, arg_min(ord, (age, ord)) AS ord, arg_min(sha256, (age, ord)) AS sha256, count(*) - 1 AS skipped FROM kept GROUP BY 1""")  # fmt: skip
def chunk_replace(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents")
    c = d.select(F.concat(F.lit("c"), F.col("doc_id") % 700).alias("chunk_id"), F.concat("lang", F.lit("/"), "source").alias("path"), F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("sha256"))
    fresh = c.where("ord % 2 = 1")
    return state.replace_chunks(c.where("ord % 2 = 0"), fresh, fresh.where("ord % 11 = 0"))


@query("meta_upsert", "SELECT n_name AS key, CASE WHEN n_regionkey = 1 THEN 'new' ELSE n_nationkey::VARCHAR END AS value FROM nation UNION ALL SELECT 'schema', '1.1'")
def meta_upsert(spark, sf_dir):
    n = t.table(spark, sf_dir, "nation")
    fresh = n.where("n_regionkey = 1").select(F.col("n_name").alias("key"), F.lit("new").alias("value")).union(spark.createDataFrame([("schema", "1.1")], "key string, value string"))
    return state.upsert(n.select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value")), fresh, ["key"])


@query("cache_upsert", """SELECT 'm' || label AS model_fingerprint, vec_id % 100 AS content, max(vec_id) AS vector FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 5 = 0 GROUP BY 1, 2""")
def cache_upsert(spark, sf_dir):
    """The cache has the vectors of one pass; the later pass over the same contents replaces them."""
    e = t.table(spark, sf_dir, "embeddings").where("vec_id % 3 != 0 or vec_id % 5 = 0")
    key = [F.concat(F.lit("m"), "label").alias("model_fingerprint"), (F.col("vec_id") % 100).alias("content")]
    best = lambda df: df.groupBy(*key).agg(F.max("vec_id").alias("vector"))
    half = e.agg(F.expr("max(vec_id) div 2").alias("half"))
    e = e.crossJoin(F.broadcast(half))  # one row
    return state.upsert(best(e.where("vec_id <= half")), best(e.where("vec_id > half")), ["model_fingerprint", "content"])


@query("vector_store", """WITH old AS (SELECT vec_id AS chunk_id, 'old' AS v FROM embeddings WHERE vec_id % 4 = 0), fresh AS (SELECT vec_id * 3 AS chunk_id, 'new' AS v FROM embeddings WHERE vec_id * 3 IN (SELECT doc_id FROM documents))
  SELECT chunk_id, coalesce(f.v, o.v) AS vector FROM old o FULL JOIN fresh f USING (chunk_id)""")  # fmt: skip
def vector_store(spark, sf_dir):
    e = t.table(spark, sf_dir, "embeddings")
    old = e.where("vec_id % 4 = 0").select(F.col("vec_id").alias("chunk_id"), F.lit("old").alias("vector"))
    fresh = e.select((F.col("vec_id") * 3).alias("chunk_id"), F.lit("new").alias("vector"))
    return state.store_vectors(old, fresh, t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")))


@query("vector_reset", "SELECT vec_id FROM embeddings WHERE 'm' || label = 'm3'")
def vector_reset(spark, sf_dir):
    e = t.table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("m"), "label").alias("model_fingerprint"))
    return state.vector_space(e, "m3").select("vec_id")


@query("snapshot_record", """WITH d AS (SELECT day(ts) AS snapshot_id, 'user:' || user_id AS entity_id, event_id % 2 AS pass FROM events),
  old AS (SELECT snapshot_id, entity_id, count(*) AS n FROM d WHERE pass = 0 AND snapshot_id <= 20 GROUP BY 1, 2), seen AS (SELECT snapshot_id, entity_id, count(*) AS n FROM d WHERE snapshot_id >= 18 GROUP BY 1, 2)
  SELECT * FROM old WHERE snapshot_id NOT IN (SELECT snapshot_id FROM seen) UNION ALL SELECT * FROM seen""")  # fmt: skip
def snapshot_record(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("snapshot_id"), F.concat(F.lit("user:"), "user_id").alias("entity_id"), (F.col("event_id") % 2).alias("pass"))
    counted = lambda df: df.groupBy("snapshot_id", "entity_id").agg(F.count("*").alias("n"))
    old, seen = counted(e.where("pass = 0 and snapshot_id <= 20")), counted(e.where("snapshot_id >= 18"))
    named = lambda df: df.select("snapshot_id").distinct().select("snapshot_id", F.concat(F.lit("rev"), "snapshot_id").alias("revision"), F.lit("digest").alias("digest"))
    return state.recorded(named(old), old, named(seen), seen)[1]


@query("snapshot_list", """SELECT DISTINCT day(ts) AS snapshot_id, 'rev' || day(ts) AS revision, CASE WHEN day(ts) <= 20 AND day(ts) % 2 = 0 THEN 'first' ELSE 'again' END AS state FROM events""")
def snapshot_list(spark, sf_dir):
    """Snapshots that are there already are not added again, whatever else the new rows say."""
    days = t.table(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("snapshot_id")).distinct()
    rows = days.select("snapshot_id", F.concat(F.lit("rev"), "snapshot_id").alias("revision"), F.lit("d").alias("digest"))
    old = rows.where("snapshot_id <= 20 and snapshot_id % 2 = 0").withColumn("state", F.lit("first"))
    none = rows.where("false").withColumn("n", F.lit(0))
    return state.recorded(old, none, rows.withColumn("state", F.lit("again")), none)[0].drop("digest")


@query("file_lookup", f"""WITH {FILES_SQL}, q AS (SELECT DISTINCT asked, regexp_replace(replace(asked, '\\', '/'), '^(\\./)+', '') AS path FROM (SELECT CASE doc_id % 3 WHEN 0 THEN replace(path, '/', '\\') WHEN 1 THEN './' || path ELSE path || 'x' END AS asked FROM files))
  SELECT asked, sha256 FROM q JOIN files USING (path)""")  # fmt: skip
def file_lookup(spark, sf_dir):
    f, m = t.files(spark, sf_dir), F.col("doc_id") % 3
    asked = F.when(m == 0, F.replace("path", F.lit("/"), F.lit("\\"))).when(m == 1, F.concat(F.lit("./"), "path")).otherwise(F.concat("path", F.lit("x")))
    return lookup.by_path(f, f.select(asked.alias("asked"))).select("asked", "sha256")


@query("stats", """WITH n AS (SELECT 'nation/' || s_nationkey AS file, 'method' AS kind FROM supplier UNION ALL SELECT 'nation/' || c_nationkey, 'method' FROM customer UNION ALL SELECT 'brand/' || p_brand, 'class' FROM part),
  f AS (SELECT file, count(*) FILTER (kind <> 'method') AS symbols, count(*) FILTER (kind = 'method') AS methods FROM n GROUP BY 1)
  SELECT (SELECT count(*) FROM f) AS files, (SELECT sum(symbols)::BIGINT FROM f) AS symbols, (SELECT sum(methods)::BIGINT FROM f) AS methods, file, f.symbols AS in_file FROM f ORDER BY f.symbols DESC, file LIMIT 5""")  # fmt: skip
def stats(spark, sf_dir):
    """Totals beside the files with most symbols."""
    n = t.nodes(spark, sf_dir).where("namespace != 'geo'")
    return lookup.stats(n, 5)


@query("file_payloads", f"""WITH {FILES_SQL}, r AS (SELECT directory, path, row_number() OVER (PARTITION BY directory ORDER BY path) AS rn, count(*) OVER (PARTITION BY directory) AS n FROM files)
  SELECT directory, string_agg(path, ',' ORDER BY path) AS shown, max(greatest(0, n - 3)) AS omitted FROM r WHERE rn <= 3 GROUP BY 1""")  # fmt: skip
def file_payloads(spark, sf_dir):
    return lookup.shown(t.files(spark, sf_dir), "directory", "path", 3)


@query("readiness", f"""WITH {FILES_SQL}, {COPY_SQL}, s AS (SELECT namespace, count(*) FILTER (current IS NULL OR (current <> sha256 AND namespace <> 'en')) AS stale FROM files LEFT JOIN copy USING (path) WHERE namespace <> 'en' OR doc_id % 17 <> 0 GROUP BY 1),
  m AS (SELECT *, 'digest' || namespace AS snapshot, CASE WHEN namespace = 'en' THEN 'digesten' WHEN namespace = 'fr' THEN '' END AS search FROM s)
  SELECT namespace, CASE WHEN stale = 0 THEN 'ready' ELSE 'stale' END AS map_state, CASE WHEN stale > 0 THEN 'unavailable' WHEN search IS NULL THEN 'missing' WHEN search = '' THEN 'invalid' WHEN search = snapshot THEN 'ready' ELSE 'stale' END AS search_state FROM m""")  # fmt: skip
def readiness(spark, sf_dir):
    """Each language as a map of its own."""
    f = t.files(spark, sf_dir)
    files = f.where("namespace != 'en' or doc_id % 17 != 0").select("path", F.col("namespace").alias("map"), "sha256")
    copy = f.join(t.working_copy(f), "path").select("path", F.when(F.col("namespace") == "en", F.col("sha256")).otherwise(F.col("current")).alias("current"))
    maps = f.select(F.col("namespace").alias("map")).distinct()
    search = F.when(F.col("map") == "en", "digesten").when(F.col("map") == "fr", "")
    maps = maps.select("map", F.concat(F.lit("digest"), "map").alias("snapshot"), search.alias("search"))
    return lookup.readiness(maps, files, copy).withColumnRenamed("map", "namespace")


@query("source_slices", f"""WITH {FILES_SQL}, {COPY_SQL} SELECT path, sha256(array_to_string(string_split(text, chr(10))[2:4], chr(10))) AS slice FROM files JOIN documents USING (doc_id) JOIN copy USING (path) WHERE current = sha256 AND len(string_split(text, chr(10))) >= 2""")
def source_slices(spark, sf_dir):
    f = t.files(spark, sf_dir).join(t.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    f = f.join(t.working_copy(t.files(spark, sf_dir)), "path")
    out = lookup.slices(f.select("path", "sha256", "current", F.col("text").alias("content"), F.lit(2).alias("start"), F.lit(4).alias("end")))
    return out.select("path", F.sha2("slice", 256).alias("slice"))


@query("merged_symbol_hits", """WITH l AS (SELECT source AS symbol, count(*) AS methods FROM documents WHERE doc_id % 3 = 0 GROUP BY 1), n AS (SELECT source AS symbol, count(*) AS methods FROM documents WHERE doc_id % 2 = 0 AND source <> 'src0' GROUP BY 1)
  SELECT symbol, CASE WHEN l.methods IS NULL OR n.methods > l.methods THEN n.methods ELSE l.methods END AS methods, CASE WHEN l.methods IS NULL OR n.methods > l.methods THEN 'normalized' ELSE 'literal' END AS hit FROM l FULL JOIN n USING (symbol)""")  # fmt: skip
def merged_symbol_hits(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents")
    by = lambda df: df.groupBy(F.col("source").alias("symbol")).agg(F.count("*").alias("methods"))
    return lookup.merged_hits(by(d.where("doc_id % 3 = 0")), by(d.where("doc_id % 2 = 0 and source != 'src0'")))


#: Parts as source files, each third with a test.
CODE_SQL = """code AS (SELECT 'src/' || p_brand || '/' || replace(p_name, ' ', '') || p_partkey % 7 || '.php' AS path, p_brand AS namespace FROM part UNION ALL SELECT 'tests/' || replace(p_name, ' ', '') || p_partkey % 7 || 'Test.php', '' FROM part WHERE p_partkey % 3 = 0),
  bases AS (SELECT DISTINCT path, namespace, regexp_replace(regexp_replace(string_split(path, '/')[-1], '[.][^.]*$', ''), '(?i)(test|cest)$', '') AS base, starts_with(path, 'tests/') AS test FROM code)"""
RELATED = "ring"


def _code(spark, sf_dir):
    p = t.table(spark, sf_dir, "part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_partkey") % 7)
    own = p.select(F.concat(F.lit("src/"), "p_brand", F.lit("/"), name, F.lit(".php")).alias("path"), F.col("p_brand").alias("namespace"))
    return own.union(p.where("p_partkey % 3 = 0").select(F.concat(F.lit("tests/"), name, F.lit("Test.php")), F.lit(""))).distinct()


_PRIMARY_SQL = f"p AS (SELECT * FROM bases WHERE NOT test AND contains(lower(path), '{RELATED}') ORDER BY path LIMIT 30)"


@query("related_files", f"""WITH {CODE_SQL}, {_PRIMARY_SQL}, x AS (SELECT DISTINCT c.path FROM p JOIN bases c ON c.test AND c.path <> p.path AND (contains(c.base, p.base) OR contains(p.base, c.base)) ORDER BY 1 LIMIT 10),
  y AS (SELECT DISTINCT c.path FROM p JOIN bases c ON c.namespace = p.namespace AND c.namespace <> '' WHERE c.path NOT IN (SELECT path FROM p) ORDER BY 1 LIMIT 10)
  SELECT 'primary' AS section, path FROM (SELECT path FROM p ORDER BY path LIMIT 10) UNION ALL SELECT 'likely_tests', path FROM x UNION ALL SELECT 'same_namespace', path FROM y""")  # fmt: skip
def related_files(spark, sf_dir):
    return lookup.related(_code(spark, sf_dir), RELATED, 10)


_PARTS_SQL = """parts AS (SELECT path, 'path' AS part, path AS value FROM bases UNION ALL SELECT path, 'name', base FROM bases UNION ALL SELECT path, 'fqn', namespace || '::' || base FROM bases UNION ALL SELECT path, 'method', 'get_' || left(base, 4) FROM bases WHERE NOT test)"""


def _score_sql(c: str, term: str, base: str) -> str:
    return f"""CASE WHEN strpos({c}, '{term}') = 0 THEN 0 WHEN {c} = '{term}' THEN {base} + 1000 ELSE {base} + CASE WHEN strpos({c}, '{term}') = 1 THEN 600 ELSE 0 END - least(500, 10 * (strpos({c}, '{term}') - 1)) - least(99, greatest(0, length({c}) - length('{term}'))) END"""


@query("fuzzy_symbols", f"""WITH {CODE_SQL}, {_PARTS_SQL}, b AS (SELECT path, lower(value) AS l, regexp_replace(lower(value), '[^a-z0-9]+', '', 'g') AS n, CASE part WHEN 'name' THEN 10000 WHEN 'fqn' THEN 9500 WHEN 'method' THEN 9000 ELSE 8000 END AS x FROM parts),
  s AS (SELECT path, {_score_sql("l", "get_r", "x")} AS literal, {_score_sql("n", "getr", "(x - 3000)")} AS normal FROM b), g AS (SELECT path, max(greatest(literal, normal))::BIGINT AS score, bool_or(literal > 0) AS l, bool_or(literal = 0 AND normal > 0) AS n FROM s GROUP BY 1)
  SELECT path, score, CASE WHEN l AND n THEN 'mixed' WHEN l THEN 'exact' ELSE 'normalized' END AS match FROM g WHERE score > 0 ORDER BY score DESC, path""")  # fmt: skip
def fuzzy_symbols(spark, sf_dir):
    f = _code(spark, sf_dir)
    base = F.regexp_replace(F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""), r"(?i)(test|cest)$", "")
    f = f.withColumn("base", base)
    part = lambda name, value: F.struct(F.lit(name).alias("part"), value.alias("value"))
    method = F.when(~F.col("path").startswith("tests/"), part("method", F.concat(F.lit("get_"), F.substring("base", 1, 4))))
    parts = F.array(part("path", F.col("path")), part("name", F.col("base")), part("fqn", F.concat("namespace", F.lit("::"), "base")), method)
    rows = f.select("path", F.explode(parts).alias("p")).where("p is not null").select("path", "p.part", "p.value")
    return lookup.fuzzy_files(rows, "get_r")


@query("mention_files", f"""WITH {FILES_SQL} SELECT path, doc_id AS ord FROM files JOIN documents d USING (doc_id) WHERE contains(text, 'the') AND n_chars > 100 AND d.source <> 'src1' ORDER BY doc_id LIMIT 10""")
def mention_files(spark, sf_dir):
    f = t.files(spark, sf_dir).join(t.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", "source"), "doc_id")
    f = f.select("path", F.col("doc_id").alias("ord"), F.col("text").alias("content"), (F.col("n_chars") > 100).cast("int").alias("symbols"), "source")
    return lookup.mention_files(f, "the", f.where("source = 'src1'"), 10)


@query("tests_by_name", f"""WITH {CODE_SQL} SELECT s.path, string_agg(DISTINCT c.path, ',' ORDER BY c.path) AS tests FROM bases s JOIN bases c ON c.test AND c.base = s.base WHERE NOT s.test AND s.base <> '' GROUP BY 1""")
def tests_by_name(spark, sf_dir):
    """Every source file with the tests of its base name."""
    base = F.regexp_replace(F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""), r"(?i)(test|cest)$", "")
    f = _code(spark, sf_dir).withColumn("base", base).withColumn("test", tx.is_test_path("path"))
    tests = f.where("test").groupBy("base").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("tests"))
    return f.where("not test and base != ''").join(tests, "base").select("path", "tests")
