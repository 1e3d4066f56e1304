"""Structural declarations meet the records of a type analyser; relations, diagnostics and hashes after that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(structural: DataFrame, symbols: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, file, record, type, status) of structural symbols (id, file): a function's own record beats one of its symbol."""
    f = functions.select("id", F.col("type").alias("f_type"), F.lit(True).alias("has_f"))
    s = symbols.select("id", F.col("type").alias("s_type"), F.lit(True).alias("has_s"))
    out = structural.select("id", "file").join(s, "id", "left").join(f, "id", "left")
    record = F.when(F.col("has_f"), "function").when(F.col("has_s"), "symbol").otherwise("none")
    kind = F.when(F.col("has_f"), F.col("f_type")).otherwise(F.col("s_type"))
    return out.select("id", "file", record.alias("record"), kind.alias("type"), F.when(record == "none", "structural_only").otherwise("semantic_enrichment").alias("status"))


def _names(c: str) -> Column:
    """A list of type names without leading backslashes, empty ones and repeats, in order; null counts as empty."""
    clean = F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), lambda x: F.regexp_replace(x, r"^\\+", ""))
    return F.array_sort(F.array_distinct(clean))


def merge_symbols(structural: DataFrame, records: DataFrame) -> DataFrame:
    """(id, file, extends, implements, uses, templates, status) of structural (id, kind, file, extends, implements, uses) and records (id, kind, file, extends,
    implements, uses, templates) of a type analyser: `conflict` if kind or file differ, else `semantic_enrichment` if the record has templates or
    other lists, else `confirmed`; `structural_only` without a record. What a record doesn't say (null) is taken from the structure."""
    r = records.select("id", *[F.col(c).alias(f"r_{c}") for c in ("kind", "file", "extends", "implements", "uses", "templates")], F.lit(True).alias("has"))
    out = structural.join(r, "id", "left")
    lists = {}
    for c in ("extends", "implements", "uses"):
        own = _names(c)
        lists[c] = own, F.when(F.col(f"r_{c}").isNull(), own).otherwise(_names(f"r_{c}"))
    templates = F.coalesce("r_templates", F.create_map().cast("map<string,string>"))
    conflict = (F.coalesce("r_kind", "kind") != F.col("kind")) | (F.coalesce("r_file", "file") != F.col("file"))
    richer = F.size(F.map_keys(templates)) > 0
    for own, told in lists.values():
        richer = richer | (own != told)
    status = F.when(F.col("has").isNull(), "structural_only").when(conflict, "conflict").when(richer, "semantic_enrichment").otherwise("confirmed")
    return out.select("id", "file", *[told.alias(c) for c, (_, told) in lists.items()], templates.alias("templates"), status.alias("status"))


def merge_methods(structural: DataFrame, records: DataFrame) -> DataFrame:
    """(id, native, phpdoc, resolved, parameters, status, moved) of structural (id, line_start, native, parameters) and records (id, line_start, native,
    phpdoc, resolved, parameters): `semantic_enrichment` if a record knows a documented type, a resolved one other than the native one, or other
    parameters, else `confirmed`; `structural_only` without a record. moved tells that the lines differ."""
    r = records.select("id", *[F.col(c).alias(f"r_{c}") for c in ("line_start", "native", "phpdoc", "resolved", "parameters")], F.lit(True).alias("has"))
    out = structural.join(r, "id", "left")
    native = F.coalesce("r_native", "native")
    told = F.when(F.coalesce(F.size("r_parameters"), F.lit(0)) > 0, F.col("r_parameters")).otherwise(F.col("parameters"))
    resolved = F.col("r_resolved").isNotNull() & ~F.col("r_resolved").eqNullSafe(native)
    richer = F.col("r_phpdoc").isNotNull() | resolved | ~told.eqNullSafe(F.col("parameters"))
    status = F.when(F.col("has").isNull(), "structural_only").when(richer, "semantic_enrichment").otherwise("confirmed")
    moved = F.coalesce(F.col("r_line_start") != F.col("line_start"), F.lit(False))
    return out.select("id", native.alias("native"), F.col("r_phpdoc").alias("phpdoc"), F.col("r_resolved").alias("resolved"), told.alias("parameters"), status.alias("status"), moved.alias("moved"))


def merge_diagnostics(symbols: DataFrame, methods: DataFrame) -> DataFrame:
    """(level, code, id) of what merged symbols and methods have to say."""
    a = symbols.where("status = 'conflict'").select(F.lit("error").alias("level"), F.lit("symbol_conflict").alias("code"), "id")
    return a.unionByName(methods.where("moved").select(F.lit("info").alias("level"), F.lit("source_range_mismatch").alias("code"), "id"))


def file_status(reconciled: DataFrame) -> DataFrame:
    """(file, semantic_status, missing): whether any symbol of a file has a record, and how many have none."""
    missing = F.count_if(F.col("record") == "none")
    status = F.when(F.count_if(F.col("record") != "none") > 0, "analysed").otherwise("no_semantic_records")
    return reconciled.groupBy("file").agg(status.alias("semantic_status"), missing.alias("missing"))


def semantic_only(records: DataFrame, structural: DataFrame) -> DataFrame:
    """Records (id, file, type) of indexed files that no structural symbol answers to."""
    return records.join(structural.select("id"), "id", "left_anti").join(structural.select("file").distinct(), "file", "left_semi").select("id", "file", "type")


def target_ids(relations: DataFrame, known: DataFrame) -> DataFrame:
    """relations (rel_id, kind, target) with target_id: the known symbol (fqn, id), else `type:` and the name without generics,
    or `unresolved:` and the kind where there is no target."""
    base = F.regexp_replace(F.regexp_replace("target", "<.*$", ""), r"^\\+", "")
    rows = relations.withColumn("base", base).join(known.select(F.col("fqn").alias("base"), "id"), "base", "left")
    target = F.when(F.col("target").isNull(), F.concat(F.lit("unresolved:"), "kind")).otherwise(F.coalesce("id", F.concat(F.lit("type:"), "base")))
    return rows.select("rel_id", "kind", target.alias("target_id"))


def unique_by_id(rows: DataFrame, order: str, by: str = "id") -> DataFrame:
    """One row for each id: the last one in `order`; sorted by id."""
    value = F.struct(*[c for c in rows.columns if c != by])
    return rows.groupBy(by).agg(F.max_by(value, order).alias("v")).select(by, "v.*").orderBy(by)


def changed_hashes(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Paths of files (path, sha256) whose chunks (path, source_sha256) come from another text, or that have none."""
    known = chunks.groupBy("path").agg(F.min("source_sha256").alias("known"))
    return files.join(known, "path", "left").where(~F.col("known").eqNullSafe(F.col("sha256"))).select("path")
