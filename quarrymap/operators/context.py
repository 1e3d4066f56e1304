"""Budgeted context selection and rename edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """One row for each (plan, symbol, role): evidence joined, mandatory if any is, least priority."""
    return candidates.groupBy("plan", "symbol", "role").agg(
        F.array_join(F.array_sort(F.collect_set("evidence")), ",").alias("evidence"), F.bool_or("mandatory").alias("mandatory"),
        F.min("priority").alias("priority"), F.max("size").alias("size"),
    )


def within_budget(candidates: DataFrame, budget: int) -> DataFrame:
    """(plan, chosen, omitted, used): candidates in the order of priority and symbol, each taken if it still fits; a later
    smaller one may fit after a larger one did not. The fold runs inside each plan's row."""
    rows = candidates.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("priority", "symbol", "size"))).alias("cs"))
    fold = (
        "aggregate(cs, named_struct('used', 0L, 'chosen', 0L, 'omitted', 0L), (a, x) -> "
        f"if(a.used + x.size <= {budget}, named_struct('used', a.used + x.size, 'chosen', a.chosen + 1, 'omitted', a.omitted), "
        "named_struct('used', a.used, 'chosen', a.chosen, 'omitted', a.omitted + 1)))"
    )
    return rows.select("plan", F.expr(fold).alias("f")).select("plan", "f.chosen", "f.omitted", "f.used")


ROLES = ["change_candidate", "dependency", "verification", "type_definition"]


def select_context(candidates: DataFrame, budget: int, most_files: int, caps: dict[str, int]) -> DataFrame:
    """(plan, chosen, omitted, used, files, failed) of (plan, symbol, role, mandatory, priority, size, file), in the order of priority,
    symbol and role: what is over the cap of its role is left out unless it is mandatory, then what is over the bytes or would
    need one file too many; later smaller ones may still fit. A mandatory one that doesn't fit fails the plan, and what comes
    after it is not looked at. The fold runs inside each plan's row; it counts chosen ones for each role."""
    row = F.struct("priority", "symbol", "role", "mandatory", "size", "file")
    rows = candidates.groupBy("plan").agg(F.array_sort(F.collect_list(row)).alias("cs"))
    state = "used bigint, chosen array<string>, omitted array<string>, files array<string>, failed boolean, " + ", ".join(f"{r} int" for r in ROLES)
    start = "named_struct('used', 0L, 'chosen', array(), 'omitted', array(), 'files', array(), 'failed', false, " + ", ".join(f"'{r}', 0" for r in ROLES) + ")"
    start = f"cast({start} as struct<{', '.join(f'{c.rsplit(chr(32), 1)[0]}:{c.rsplit(chr(32), 1)[1]}' for c in state.split(', '))}>)"
    capped = " or ".join(f"(x.role = '{r}' and a.{r} >= {caps[r]})" for r in ROLES)
    fits = f"(a.used + x.size <= {budget} and (array_contains(a.files, x.file) or size(a.files) < {most_files}))"
    taken = (
        "named_struct('used', a.used + x.size, 'chosen', array_append(a.chosen, x.symbol), 'omitted', a.omitted, "
        "'files', if(array_contains(a.files, x.file), a.files, array_append(a.files, x.file)), 'failed', false, "
        + ", ".join(f"'{r}', a.{r} + int(x.role = '{r}')" for r in ROLES) + ")"
    )
    left = "named_struct('used', a.used, 'chosen', a.chosen, 'omitted', array_append(a.omitted, x.symbol), 'files', a.files, 'failed', {0}, " + ", ".join(f"'{r}', a.{r}" for r in ROLES) + ")"
    step = f"if(a.failed, a, if(({capped}) and not x.mandatory, {left.format('false')}, if({fits}, {taken}, if(x.mandatory, {left.format('true')}, {left.format('false')}))))"
    f = F.expr(f"aggregate(cs, {start}, (a, x) -> {step})")
    return rows.select("plan", f.alias("f")).select("plan", "f.chosen", "f.omitted", "f.used", F.size("f.files").alias("files"), "f.failed")


def focus_windows(texts: DataFrame, term: str, around: int = 12, most: int = 3) -> DataFrame:
    """(path, start, end) of (path, text): so many lines around each of the first matches of a term, or the whole text without any."""
    pieces = F.split(F.col("text"), F.lit("\\Q" + term + "\\E"), -1)
    lines = F.size(F.split("text", "\n"))
    rows = texts.select("path", pieces.alias("ps"), lines.alias("n"))
    count = F.least(F.lit(most), F.size("ps") - 1)
    whole = rows.where(F.size("ps") == 1).select("path", F.lit(1).alias("start"), F.col("n").alias("end"))
    hits = rows.where(F.size("ps") > 1).withColumn("i", F.explode(F.sequence(F.lit(1), count)))
    line = F.size(F.split(F.array_join(F.slice("ps", F.lit(1), F.col("i")), term), "\n"))
    return hits.select("path", F.greatest(F.lit(1), line - around).alias("start"), F.least(F.col("n"), line + around + term.count("\n")).alias("end")).union(whole)


def blind_spots(relations: DataFrame) -> DataFrame:
    """(source_id, kind, evidence): calls that can't be told for sure, each kind once for a source, with the number of relations."""
    kind = F.when(F.col("resolution") == "dynamic", "dynamic_call").when(F.col("resolution") == "multiple_targets", "multiple_call_targets")
    return relations.where("kind = 'calls'").withColumn("spot", kind).where("spot is not null").groupBy("source_id", F.col("spot").alias("kind")).agg(F.count("*").alias("evidence"))


def within(relations: DataFrame, targets: DataFrame) -> DataFrame:
    """Calls and instantiations (rel_id, source_id, file, line_start, line_end, kind, ...) inside the line ranges of targets (target, source, file, start, end):
    those of the target's source, or of any where it is null."""
    some = relations.where(F.col("kind").isin("calls", "instantiates"))
    inside = (F.col("line_start") >= F.col("start")) & (F.col("line_end") <= F.col("end"))
    return some.join(targets, "file").where(inside & (F.col("source").isNull() | (F.col("source") == F.col("source_id"))))


def enrich_calls(hints: DataFrame, relations: DataFrame) -> DataFrame:
    """hints (file, line, call, name) with rel_id and resolution of the first relation that answers to them: of the kind that the
    call makes, on its line, with a target of that name."""
    kind = F.when(F.col("call") == "constructor", "instantiates").otherwise("calls").alias("kind")
    names = relations.select("file", F.col("line_start").alias("line"), "kind", F.substring_index(F.substring_index("target_id", ":", -1), "\\", -1).alias("name"), "rel_id", "resolution")
    best = names.groupBy("file", "line", "kind", "name").agg(F.min(F.struct("rel_id", "resolution")).alias("r"))
    out = hints.withColumn("kind", kind).join(best, ["file", "line", "kind", "name"], "left")
    return out.select("file", "line", "call", "name", "r.rel_id", "r.resolution")


def located_tokens(lines: DataFrame, word: str) -> DataFrame:
    """(path, no, status) of lines (path, no, line) that hold a word: an edit needs exactly one place for it."""
    found = F.regexp_count("line", F.lit(rf"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])"))
    status = F.when(found == 1, "located").when(found == 0, "missing").otherwise("ambiguous")
    return lines.where(F.col("line").contains(word)).select("path", "no", status.alias("status"))


def merge_slices(slices: DataFrame) -> DataFrame:
    """(path, start, end) of slices merged where they overlap; those that only touch stay apart."""
    w = Window.partitionBy("path").orderBy("start", "end")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = slices.withColumn("fresh", F.when(upto.isNull() | (F.col("start") > upto), 1).otherwise(0))
    islands = fresh.withColumn("island", F.sum("fresh").over(w))
    return islands.groupBy("path", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def unique_edits(edits: DataFrame) -> DataFrame:
    """One edit for each (path, start, end): the last one."""
    return edits.groupBy("path", "start", "end").agg(F.max_by("token", "ord").alias("token"))


def overlaps(edits: DataFrame, running: bool) -> DataFrame:
    """Edits that begin before the end of the edit before them, or (running) of any edit before them."""
    w = Window.partitionBy("path").orderBy("start", "end")
    end = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) if running else F.lag("end").over(w)
    return edits.withColumn("before", end).where("start < before").select("path", "start", "end", "before")


def status(blockers: str, reviews: str):
    return F.when(F.col(blockers) > 0, "blocked").when(F.col(reviews) > 0, "review_required").otherwise("safe")
