"""Plans for renaming methods, many targets at once: which methods change with the target, what stands against it, and which tokens to edit.

Tables: renames (plan, target, replacement), methods (id, symbol, name, file, line_start, line_end), symbols (id, kind, fqn), relations (rel_id,
source_id, target_id, kind, resolution, file, line_start, line_end, receiver_type; a row for each target), files (path, sha256, current, content).

A plan with any blocker has no edits. Every token that is edited is found by its place in bytes in an index of the sources: evidence
that doesn't meet exactly one token of its name in its lines is a blocker.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.functions.text import is_method_name
from quarrymap.operators import graph
from quarrymap.storage import stored

#: Pieces of a source: comments, the opening of an attribute, strings, names, what is between them. Each loop runs over single characters,
#: so that the pattern takes linear time and no stack; escaped quotes are masked before.
PIECES = (
    r"/\*(?s:.*?)(?:\*/|\z)|//[^\n]*|#\[|#[^\n]*|'[^']*(?:'|\z)|\"[^\"]*(?:\"|\z)|"
    r"[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*|[^A-Za-z_\x{80}-\x{10FFFF}'\"/#]+|(?s:.)"
)
_NAME = r"^[A-Za-z_\x{80}-\x{10FFFF}]"
#: Resolutions of calls that a rename may rely on.
SURE = ["phpstan_resolved", "multiple_targets"]


def ascii_lower(c: Column | str) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def source_pieces(files: DataFrame) -> DataFrame:
    """(path, no, kind, piece, start, line) of files (path, content): code, comments and strings in order, with the byte each starts at
    and its line. One pass of a pattern cuts a file; running sums of lengths give the places."""
    masked = F.regexp_replace("content", r"\\(['\"\\])", "\u0001\u0001")  # as many bytes
    rows = files.select("path", F.posexplode(F.regexp_extract_all(masked, F.lit(PIECES), 0)).alias("no", "piece"))
    p = F.col("piece")
    comment = p.startswith("/*") | p.startswith("//") | (p.startswith("#") & (p != "#["))
    kind = F.when(comment, "comment").when(p.startswith("'") | p.startswith('"'), "string").when(p.rlike(_NAME), "name").otherwise("other")
    before = Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return rows.select("path", "no", kind.alias("kind"), "piece", so_far(F.octet_length(p)).alias("start"), (1 + so_far(breaks)).alias("line"))


def code_pieces(files: DataFrame) -> DataFrame:
    """source_pieces without comments and what is blank: what stands beside each other here does so for the parser."""
    return source_pieces(files).where((F.col("kind") != "comment") & (F.btrim("piece", F.lit(" \t\r\n")) != ""))


def name_tokens(files: DataFrame) -> DataFrame:
    """(path, role, name, actual, start, end, line): names that are called as methods (after -> or ::, before a parenthesis) or declared as functions,
    outside comments and strings; end is the last byte. name is in lower case."""
    rows = code_pieces(files)
    w = Window.partitionBy("path").orderBy("no")
    rows = rows.select(
        "path", "kind", "start", "line", F.col("piece").alias("actual"), F.lag("piece").over(w).alias("b1"), F.lower(F.lag("piece", 2).over(w)).alias("b2"),
        F.lead("piece").over(w).alias("next"),
    )
    b1 = F.btrim("b1", F.lit(" \t\r\n"))
    call = (b1.endswith("->") | b1.endswith("::")) & F.btrim("next", F.lit(" \t\r\n")).startswith("(")
    declared = (F.lower("b1") == "function") | ((b1 == "&") & (F.col("b2") == "function"))
    rows = rows.where("kind = 'name'").withColumn("role", F.when(call, "call").when(declared, "declaration")).where("role is not null")
    return rows.select("path", "role", ascii_lower("actual").alias("name"), "actual", "start", (F.col("start") + F.octet_length("actual") - 1).alias("end"), "line")


def located(evidence: DataFrame, tokens: DataFrame) -> DataFrame:
    """evidence (ev, path, role, name, line_start, line_end) with how many tokens it meets (found) and the first one (start, end, actual): those of
    its file, role and name (whatever the case) in its lines."""
    wanted = evidence.select("ev", "path", "role", ascii_lower("name").alias("name"), "line_start", "line_end")
    meet = wanted.join(tokens, ["path", "role", "name"]).where("line >= line_start and line <= line_end")
    found = meet.groupBy("ev").agg(F.count("*").alias("found"), F.min(F.struct("start", "end", "actual")).alias("t"))
    return evidence.join(found, "ev", "left").select(evidence["*"], F.coalesce("found", F.lit(0)).alias("found"), "t.start", "t.end", "t.actual")


def families(methods: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(family, id) of methods: those that override each other, in either direction and over any number of steps; and (family, missing) of
    ids that a family's relations lead to and that are no methods."""
    ids = methods.select("id").distinct()
    a, b = ids.withColumnRenamed("id", "source_id"), ids.withColumnRenamed("id", "target_id")
    both = overrides.select("source_id", "target_id").distinct()
    inside = both.join(a, "source_id", "left_semi").join(b, "target_id", "left_semi").where("source_id <> target_id")
    tied = graph.components(inside.select(F.col("source_id").alias("left"), F.col("target_id").alias("right")))
    members = ids.join(tied.select(F.col("file").alias("id"), "component"), "id", "left").select(F.coalesce("component", "id").alias("family"), "id")
    members = stored(members, "families")
    turned = both.select(F.col("source_id").alias("id"), F.col("target_id").alias("missing"))
    turned = turned.unionByName(both.select(F.col("target_id").alias("id"), F.col("source_id").alias("missing")))
    outside = turned.join(ids.withColumnRenamed("id", "missing"), "missing", "left_anti")
    return members, members.join(outside, "id").select("family", "missing").distinct()


def related_types(owners: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """(family, type) of types whose methods a renamed one could collide with, from owners (family, type): types above and below over
    extends, implementors of interfaces among these, and then the contracts and traits of all of them. One step of all families is
    one join with the types that are new."""
    known = symbols.select("id", "kind")
    pairs = lambda kinds: relations.where(F.col("kind").isin(kinds)).select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct()
    extends, implements = pairs(["extends"]), pairs(["implements"])
    interfaces = known.where("kind = 'interface'").select(F.col("id").alias("b"))
    steps = extends.union(extends.select("b", "a")).union(implements.join(interfaces, "b", "left_semi").select("b", "a"))
    steps = stored(steps.toDF("type", "next").distinct().join(known.select(F.col("id").alias("next")), "next", "left_semi").select("type", "next"), "type-steps")
    seen = fresh = stored(owners.select("family", "type").distinct(), "types")
    while True:
        found = fresh.join(steps, "type").select("family", F.col("next").alias("type")).distinct()
        fresh = stored(found.join(seen, ["family", "type"], "left_anti"), "types")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    beside = pairs(["implements", "uses_trait"]).join(known.select(F.col("id").alias("b")), "b", "left_semi")
    return seen.unionByName(seen.join(beside, F.col("type") == F.col("a")).select("family", F.col("b").alias("type"))).distinct()


def _receivers(relations: DataFrame) -> DataFrame:
    """(rel_id, path, line_start, line_end, type) of calls whose name is only known when they run: each type name in the receiver's type."""
    rows = relations.where("kind = 'calls' and resolution = 'dynamic' and receiver_type is not null")
    names = F.regexp_extract_all("receiver_type", F.lit(r"[A-Za-z0-9_\\]+"), 0)
    rows = rows.select("rel_id", F.col("file").alias("path"), "line_start", "line_end", F.explode(names).alias("type")).distinct()
    return rows.withColumn("type", ascii_lower(F.regexp_replace("type", r"^\\", "")))


@dataclass
class Plans:
    """plans (plan, status, family, edits, blockers, blind_spots): status and counts; edits (plan, path, start, end, expected, replacement, role), blockers
    (plan, blocker), blind_spots (plan, path, line_start, line_end), family (plan, id), stale (path)."""

    plans: DataFrame
    edits: DataFrame
    blockers: DataFrame
    blind_spots: DataFrame
    family: DataFrame
    stale: DataFrame


def rename_plans(renames: DataFrame, methods: DataFrame, symbols: DataFrame, relations: DataFrame, files: DataFrame, semantic: bool = True) -> Plans:
    """Plans of all renames. Status: `invalid` where the target is unknown, or the new name is none or the old one but for its case; `blocked` where
    the map is not semantic, any file has moved on, or anything stands against it; `review_required` where calls may reach the method by a name
    that is only known when they run; else `safe`."""
    m = methods.select("id", "symbol", "name", "file", "line_start", "line_end")
    asked = renames.select("plan", "target", F.trim("replacement").alias("replacement"))
    asked = asked.join(m.select(F.col("id").alias("target"), F.col("name").alias("old")), "target", "left")
    fit = is_method_name(F.col("replacement")) & F.col("old").isNotNull() & (ascii_lower("replacement") != ascii_lower("old"))
    asked = stored(asked.withColumn("fit", F.coalesce(fit, F.lit(False))), "renames")
    good = asked.where("fit")
    stale = files.where("current is null or current <> sha256").select("path")
    halted = not semantic or not stale.isEmpty()
    members, missing = families(methods, relations.where("kind = 'overrides'"))
    seeds = good.join(members.withColumnRenamed("id", "target"), "target").select("plan", "target", "old", "replacement", "family")
    seeds = stored(seeds, "seeds")
    said = lambda text, *parts: F.concat(F.lit(text), *parts).alias("blocker")
    if halted:
        family = good.select("plan", F.col("target").alias("id"))
        text = [] if semantic else ["Method rename requires a map with semantic types, so that callers are known by more than their text."]
        blockers = good.select("plan", F.explode(F.array(*map(F.lit, text)) if text else F.array().cast("array<string>")).alias("blocker"))
        edits = good.select("plan", F.lit("").alias("path"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), *[F.lit("").alias(c) for c in ("expected", "replacement", "role")]).limit(0)
        blind = good.select("plan", F.lit("").alias("path"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end")).limit(0)
    else:
        family = stored(seeds.join(members, "family").select("plan", "id"), "plan-families")
        first = _structural_blockers(seeds, family, m, symbols, relations, members, missing, said)
        first = stored(first.distinct(), "blockers")
        live = seeds.join(first.select("plan").distinct(), "plan", "left_anti")
        edits, second, blind = _edits(live, family.join(live.select("plan"), "plan", "left_semi"), m, symbols, relations, files, said)
        blockers = first.unionByName(second.distinct())
    blockers = stored(blockers, "all-blockers")
    count = lambda df, name: df.groupBy("plan").agg(F.count("*").alias(name))
    edits = stored(edits.join(blockers.select("plan").distinct(), "plan", "left_anti"), "edits")
    out = asked.select("plan", "fit")
    for df, name in ((family, "family"), (edits, "edits"), (blockers, "blockers"), (blind, "blind_spots")):
        out = out.join(count(df, name), "plan", "left")
    out = out.fillna(0, ["family", "edits", "blockers", "blind_spots"])
    blocked = F.lit(True) if halted else F.col("blockers") > 0
    status = F.when(~F.col("fit"), "invalid").when(blocked, "blocked").when(F.col("blind_spots") > 0, "review_required").otherwise("safe")
    return Plans(out.select("plan", status.alias("status"), "family", "edits", "blockers", "blind_spots"), edits, blockers, blind, family, stale)


def _structural_blockers(seeds, family, m, symbols, relations, members, missing, said) -> DataFrame:
    crossing = seeds.join(missing, "family").select("plan", said("Rename family crosses an unindexed method contract: ", F.col("missing")))
    owned = family.join(m.select("id", "symbol"), "id")
    traits = owned.join(symbols.where("kind = 'trait'").select(F.col("id").alias("symbol")), "symbol", "left_semi")
    traits = traits.select("plan", said("Trait method rename is blocked until aliases of trait methods can be told: ", F.col("id")))
    owners = members.join(m.select("id", F.col("symbol").alias("type")), "id").join(seeds.select("family").distinct(), "family", "left_semi")
    types = related_types(owners, symbols, relations)
    named = m.select(F.col("symbol").alias("type"), F.col("id").alias("other"), ascii_lower("name").alias("name"))
    # the family of a plan is the family of its seed, so what is outside it is told by the family alone
    rivals = types.join(named, "type").join(members.select(F.col("family").alias("own"), F.col("id").alias("other")), "other").where("own <> family")
    wanted = seeds.select("plan", "family", ascii_lower("replacement").alias("name"))
    clashes = wanted.join(rivals.select("family", "name", "other"), ["family", "name"])
    clashes = clashes.select("plan", said("Replacement name would collide with related method ", F.col("other"), F.lit(".")))
    return crossing.unionByName(traits).unionByName(clashes)


def _edits(live, family, m, symbols, relations, files, said) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edits, blockers, blind spots) of plans that nothing structural stands against."""
    where = F.concat(F.col("path"), F.lit(":"), F.col("line_start"), F.lit("-"), F.col("line_end"))
    declared = family.join(m, "id").select(
        "plan", F.col("id").alias("rel_id"), F.col("file").alias("path"), "name", "line_start", "line_end", F.lit("declaration").alias("role"),
    )
    calls = relations.where("kind = 'calls'")
    reached = calls.join(family.select("plan", F.col("id").alias("target_id")), "target_id").groupBy("plan", "rel_id").agg(
        F.countDistinct("target_id").alias("inside"), F.first("resolution").alias("resolution"), F.first("file").alias("path"), F.first("line_start").alias("line_start"), F.first("line_end").alias("line_end")
    )
    reached = stored(reached, "reached")
    all_targets = calls.join(reached.select("plan", "rel_id"), "rel_id").select("plan", "rel_id", "target_id").distinct()
    outside = all_targets.join(family.select("plan", F.col("id").alias("target_id")), ["plan", "target_id"], "left_anti")
    outside = outside.groupBy("plan", "rel_id").agg(F.array_join(F.array_sort(F.collect_set("target_id")), ", ").alias("outside"))  # targets of one call
    known = files.select("path").distinct().withColumn("known", F.lit(True))
    judged = stored(reached.join(outside, ["plan", "rel_id"], "left").join(known, "path", "left"), "judged")
    stray = F.col("outside").isNotNull()
    unsure = ~stray & ~F.col("resolution").isin(SURE)
    unknown = ~stray & ~unsure & F.col("known").isNull()
    against = judged.where(stray).select("plan", said("Call at ", where, F.lit(" can target both the rename family and outside method(s): "), F.col("outside"), F.lit(".")))
    against = against.unionByName(judged.where(unsure).select("plan", said("Call at ", where, F.lit(' reaches the rename family with unsupported resolution "'), F.col("resolution"), F.lit('".'))))
    against = against.unionByName(judged.where(unknown).select("plan", said("Call relation points outside the indexed source set: ", F.col("path"))))
    usable = judged.where(~stray & ~unsure & F.col("known")).join(live.select("plan", F.col("old").alias("name")), "plan")
    called = usable.select("plan", "rel_id", "path", "name", "line_start", "line_end", F.lit("call").alias("role"))
    evidence = stored(declared.unionByName(called).withColumn("ev", F.concat_ws("\0", "plan", "role", "rel_id")), "evidence")
    # each place once, however many plans speak of it
    places = evidence.select("path", "role", "name", "line_start", "line_end").distinct().withColumn("ev", F.struct("path", "role", "name", "line_start", "line_end"))
    at = located(places, name_tokens(files.select("path", "content"))).drop("ev")
    at = stored(evidence.join(at, ["path", "role", "name", "line_start", "line_end"]), "located")
    noun = F.when(F.col("role") == "call", "method call").otherwise("method declaration")
    lost = at.where("found <> 1").select("plan", said("Cannot map ", noun, F.lit(' evidence to exactly one "'), F.col("name"), F.lit('" token at '), where, F.lit("; found "), F.col("found"), F.lit(" candidate(s).")))
    last = F.max_by(F.struct("actual", "role"), F.struct(F.col("role") == "call", "rel_id")).alias("v")
    edits = at.where("found = 1").groupBy("plan", "path", "start", "end").agg(last).join(live.select("plan", "replacement"), "plan")
    edits = edits.select("plan", "path", "start", "end", F.col("v.actual").alias("expected"), "replacement", F.col("v.role").alias("role"))
    w = Window.partitionBy("plan", "path").orderBy("start", "end")
    over = edits.withColumn("b", F.lag("start").over(w)).withColumn("e", F.lag("end").over(w)).where("start <= e")
    over = over.select("plan", said("Rename edits overlap in ", F.col("path"), F.lit(" at byte ranges "), F.col("b"), F.lit("-"), F.col("e"), F.lit(" and "), F.col("start"), F.lit("-"), F.col("end"), F.lit(".")))
    owners = family.join(m.select("id", "symbol"), "id").join(symbols.select(F.col("id").alias("symbol"), "fqn"), "symbol")
    owners = owners.select("plan", ascii_lower(F.regexp_replace("fqn", r"^\\+", "")).alias("type")).distinct()
    blind = owners.join(_receivers(relations), "type").join(reached.select("plan", "rel_id"), ["plan", "rel_id"], "left_anti")
    return edits, against.unionByName(lost).unionByName(over), blind.select("plan", "path", "line_start", "line_end").distinct()
