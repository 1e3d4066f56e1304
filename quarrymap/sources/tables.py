"""Readers: driver tables, and their projections into nodes, relations, files, chunks, commits and snapshots.

Every projection has the same rows as the SQL beside it, which the oracles use as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS, TYPES, NEW, EXTENDS, DECLARES = "calls", "references_type", "instantiates", "extends", "declares_method"
#: Kinds of relations by which one node depends on another.
DEPENDENCY_KINDS = ["calls", "extends", "implements", "instantiates", "overrides", "references_type", "uses_trait"]
UNCERTAIN = ["dynamic", "multiple_targets"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, name, file, namespace) of the trade graph."""
    t = lambda n: table(spark, sf_dir, n)
    c = F.col
    parts = [
        t("region").select(_text("region:", c("r_regionkey")).alias("id"), F.lit("class").alias("kind"), c("r_name").alias("name"), _text("geo/", c("r_name")).alias("file"), F.lit("geo").alias("namespace")),
        t("nation").select(_text("nation:", c("n_nationkey")), F.lit("class"), c("n_name"), _text("nation/", c("n_nationkey")), F.lit("geo")),
        t("supplier").select(_text("supplier:", c("s_suppkey")), F.lit("method"), c("s_name"), _text("nation/", c("s_nationkey")), F.lit("supply")),
        t("customer").select(_text("customer:", c("c_custkey")), F.lit("method"), c("c_name"), _text("nation/", c("c_nationkey")), c("c_mktsegment")),
        t("part").select(_text("part:", c("p_partkey")), F.lit("class"), c("p_name"), _text("brand/", c("p_brand")), F.lit("parts")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


NODES_SQL = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'class' AS kind, r_name AS name, 'geo/' || r_name AS file, 'geo' AS namespace FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'class', n_name, 'nation/' || n_nationkey, 'geo' FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'method', s_name, 'nation/' || s_nationkey, 'supply' FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'method', c_name, 'nation/' || c_nationkey, c_mktsegment FROM customer
  UNION ALL SELECT 'part:' || p_partkey, 'class', p_name, 'brand/' || p_brand, 'parts' FROM part)"""


def edges(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    """(rel_id, source_id, target_id, kind, resolution): one row for each relation and target; only some kinds if given, so
    that tables which give none of them are not read. Customers in debt also call something unresolved, and the file of a nation calls
    its suppliers by itself."""
    t = lambda n: table(spark, sf_dir, n)
    c = F.col
    resolution = F.when(c("l_returnflag") == "R", "dynamic").when(c("l_returnflag") == "A", "multiple_targets").otherwise("phpstan_resolved")
    line = [c("l_orderkey"), ":", c("l_linenumber"), ":", c("l_partkey"), ":", c("l_suppkey")]
    sure = F.lit("phpstan_resolved")
    parts = {
        CALLS: lambda: [t("lineitem").join(t("orders"), c("l_orderkey") == c("o_orderkey")).select(_text("c:", *line).alias("rel_id"), _text("customer:", c("o_custkey")).alias("source_id"), _text("supplier:", c("l_suppkey")).alias("target_id"), F.lit(CALLS).alias("kind"), resolution.alias("resolution")),
            t("customer").where("c_acctbal < 0").select(_text("x:", c("c_custkey")).alias("rel_id"), _text("customer:", c("c_custkey")).alias("source_id"), F.lit("unresolved:calls").alias("target_id"), F.lit(CALLS).alias("kind"), F.lit("dynamic").alias("resolution")),
            t("supplier").select(_text("f:", c("s_suppkey")).alias("rel_id"), _text("file:nation/", c("s_nationkey")).alias("source_id"), _text("supplier:", c("s_suppkey")).alias("target_id"), F.lit(CALLS).alias("kind"), sure.alias("resolution"))],
        TYPES: lambda: [t("lineitem").select(_text("t:", *line).alias("rel_id"), _text("supplier:", c("l_suppkey")).alias("source_id"), _text("part:", c("l_partkey")).alias("target_id"), F.lit(TYPES).alias("kind"), resolution.alias("resolution"))],
        NEW: lambda: [
            t("customer").select(_text("n:c", c("c_custkey")).alias("rel_id"), _text("customer:", c("c_custkey")).alias("source_id"), _text("nation:", c("c_nationkey")).alias("target_id"), F.lit(NEW).alias("kind"), sure.alias("resolution")),
            t("supplier").select(_text("n:s", c("s_suppkey")).alias("rel_id"), _text("supplier:", c("s_suppkey")).alias("source_id"), _text("nation:", c("s_nationkey")).alias("target_id"), F.lit(NEW).alias("kind"), sure.alias("resolution")),
        ],
        EXTENDS: lambda: [t("nation").select(_text("e:", c("n_nationkey")).alias("rel_id"), _text("nation:", c("n_nationkey")).alias("source_id"), _text("region:", c("n_regionkey")).alias("target_id"), F.lit(EXTENDS).alias("kind"), sure.alias("resolution"))],
        DECLARES: lambda: [t("customer").select(_text("d:", c("c_custkey")).alias("rel_id"), _text("nation:", c("c_nationkey")).alias("source_id"), _text("customer:", c("c_custkey")).alias("target_id"), F.lit(DECLARES).alias("kind"), sure.alias("resolution"))],
    }
    frames = [f for kind, make in parts.items() if kinds is None or kind in kinds for f in make()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


EDGES_SQL = """edges AS (
  SELECT 'c:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS rel_id, 'customer:' || o_custkey AS source_id, 'supplier:' || l_suppkey AS target_id, 'calls' AS kind,
    CASE l_returnflag WHEN 'R' THEN 'dynamic' WHEN 'A' THEN 'multiple_targets' ELSE 'phpstan_resolved' END AS resolution FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 't:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey, 'supplier:' || l_suppkey, 'part:' || l_partkey, 'references_type',
    CASE l_returnflag WHEN 'R' THEN 'dynamic' WHEN 'A' THEN 'multiple_targets' ELSE 'phpstan_resolved' END FROM lineitem
  UNION ALL SELECT 'n:c' || c_custkey, 'customer:' || c_custkey, 'nation:' || c_nationkey, 'instantiates', 'phpstan_resolved' FROM customer
  UNION ALL SELECT 'n:s' || s_suppkey, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'instantiates', 'phpstan_resolved' FROM supplier
  UNION ALL SELECT 'e:' || n_nationkey, 'nation:' || n_nationkey, 'region:' || n_regionkey, 'extends', 'phpstan_resolved' FROM nation
  UNION ALL SELECT 'd:' || c_custkey, 'nation:' || c_nationkey, 'customer:' || c_custkey, 'declares_method', 'phpstan_resolved' FROM customer
  UNION ALL SELECT 'x:' || c_custkey, 'customer:' || c_custkey, 'unresolved:calls', 'calls', 'dynamic' FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'f:' || s_suppkey, 'file:nation/' || s_nationkey, 'supplier:' || s_suppkey, 'calls', 'phpstan_resolved' FROM supplier)"""
DEPENDENCIES_SQL = "('calls','extends','implements','instantiates','overrides','references_type','uses_trait')"
UNCERTAIN_SQL = "('dynamic','multiple_targets')"


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_ord, file): an order changes its parts."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_ord"), F.col("l_partkey").alias("file")).distinct()


COMMITS_SQL = "commits AS (SELECT DISTINCT l_orderkey AS commit_ord, l_partkey AS file FROM lineitem)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, sha256, namespace, directory) of the documents as files."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", _text(F.col("lang"), "/", F.col("source"), "/doc", F.col("doc_id"), ".txt").alias("path"),
        F.sha2("text", 256).alias("sha256"), F.col("lang").alias("namespace"), _text(F.col("lang"), "/", F.col("source")).alias("directory"),
    )


FILES_SQL = """files AS (SELECT doc_id, lang || '/' || source || '/doc' || doc_id || '.txt' AS path, sha256(text) AS sha256, lang AS namespace,
  lang || '/' || source AS directory FROM documents)"""


def working_copy(files: DataFrame) -> DataFrame:
    """The files as they are on disk: each tenth edited, each seventeenth gone."""
    edited = F.when(F.col("doc_id") % 10 == 0, F.sha2(F.concat("sha256", F.lit("*")), 256)).otherwise(F.col("sha256"))
    return files.where(F.col("doc_id") % 17 != 0).select("path", edited.alias("current"))


COPY_SQL = """copy AS (SELECT path, CASE WHEN doc_id % 10 = 0 THEN sha256(sha256 || '*') ELSE sha256 END AS current FROM files WHERE doc_id % 17 <> 0)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, symbol_id, symbol_name, signature, content) of the documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        _text("doc:", F.col("doc_id"), "#body:v1").alias("chunk_id"), _text("doc:", F.col("doc_id")).alias("symbol_id"),
        F.col("source").alias("symbol_name"), F.col("lang").alias("signature"), F.col("text").alias("content"), "doc_id",
    )


def code_map(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    """One section of an exported map (a JSON document with a list under each section name), one row for each entry. Other
    sections are not parsed into rows."""
    return spark.read.schema(f"{section} array<struct<{schema}>>").option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline(section))


def source_files(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), glob: str = "*.php") -> DataFrame:
    """(path, sha256, content) of the files below root whose path matches none of the patterns, by path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    for pattern in excludes:
        f = f.where(~F.col("path").rlike(pattern))
    return f.select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("content")).orderBy("path")
