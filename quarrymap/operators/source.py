"""Parts of source files by tables of line intervals: slices with the comments above them, and chunks for search by symbol.

Files are (path, sha256, current, content): sha256 as the map knows it, current as the file is now. A file that has moved on gives no slices.
Intervals of a file are brought to its row, where each line is cut once, however many intervals there are; what is brought together are
the different intervals of one file, which its declarations bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lines that are looked at above a declaration, lines of a declaration's head, of a body, and of a block of a file.
ABOVE, HEAD, BODY, BLOCK = 30, 20, 400, 400
_BLANKS = " \t\n\r\0\x0b"


def file_lines(content: str) -> Column:
    """The lines of a text with their line ends; a line end at the end of the text begins no further line."""
    return F.filter(F.split(content, r"(?<=\n)"), lambda line: line != "")


def _first_above(lines: Column, start: Column) -> Column:
    """The line from which what belongs to a declaration at `start` begins: blank lines, attributes, line comments and doc blocks above it,
    at most ABOVE lines. A fold upwards over the lines; its state says whether it is inside a doc block and whether it has stopped."""
    before = F.reverse(F.slice(lines, F.greatest(F.lit(1), start - ABOVE), F.least(F.lit(ABOVE), start - 1)))
    state = F.struct(start.cast("int").alias("at"), F.lit(False).alias("inside"), F.lit(True).alias("open"))

    def step(s: Column, line: Column) -> Column:
        text = F.btrim(line, F.lit(_BLANKS))
        opens, closes = text.startswith("/**"), text.endswith("*/")
        plain = (text == "") | text.startswith("#[") | text.startswith("//") | (opens & closes)
        enters = ~plain & (closes | text.startswith("*"))
        taken = s["open"] & (s["inside"] | plain | enters)
        inside = F.when(s["inside"], ~opens).otherwise(enters)
        return F.struct((s["at"] - taken.cast("int")).alias("at"), (taken & inside).alias("inside"), taken.alias("open"))

    return F.aggregate(before, state, step)["at"]


def slices(files: DataFrame, intervals: DataFrame, above: bool = False) -> DataFrame:
    """(path, line_start, line_end, start, end, content) of intervals (path, line_start, line_end) of files that are as the map knows
    them: the lines from start to end, at least one place and at most the file's lines; with `above` from what belongs to the declaration."""
    some = intervals.select("path", "line_start", "line_end").where("line_start is not null and line_end is not null").distinct()
    some = some.groupBy("path").agg(F.collect_list(F.struct("line_start", "line_end")).alias("parts"))
    rows = files.where("current = sha256").join(some, "path").select("path", file_lines("content").alias("lines"), "parts")

    def cut(part: Column) -> Column:
        first = F.greatest(F.lit(1), part["line_start"].cast("int"))
        end = F.greatest(first, F.least(part["line_end"].cast("int"), F.size("lines")))
        start = _first_above(F.col("lines"), first) if above else first
        content = F.array_join(F.slice("lines", start, end - start + 1), "")
        return F.struct(part["line_start"].alias("line_start"), part["line_end"].alias("line_end"), start.alias("start"), end.alias("end"), content.alias("content"))

    return rows.select("path", F.inline(F.transform("parts", cut)))


def symbol_chunks(files: DataFrame, symbols: DataFrame, methods: DataFrame) -> DataFrame:
    """(symbol_id, kind, path, name, start, end, sha256, signature, content) of search chunks.

    symbols (symbol_id, kind, fqn, signature, path, line_start, line_end), methods (method_id, symbol_id, name, signature, ord, line_start,
    line_end). A function gives its body, another symbol an overview (its head and the signatures of its methods, without bodies) and each
    method a body, of at most BODY lines after the first; a file without symbols gives blocks of BLOCK lines. A chunk's start and end are those
    of what it stands for, even where its content is cut."""
    body = lambda start, end: F.least(end, start + BODY)
    named = methods.withColumn("line", F.concat(F.lit("    "), "signature")).groupBy("symbol_id")
    named = named.agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("ms"))  # the methods of one symbol
    heads = symbols.where("kind <> 'function'").join(named, "symbol_id", "left")
    listed = F.concat_ws("\n", "signature", F.transform("ms", lambda m: m["line"]))
    common = ["path", "line_start", "line_end", "signature"]
    overview = heads.select(
        "symbol_id", F.lit("symbol_overview").alias("kind"), F.col("fqn").alias("name"), *common,
        F.least(F.col("line_end"), F.col("line_start") + HEAD).alias("cut"), F.concat(F.lit("\n"), listed).alias("tail"),
    )
    bodies = symbols.where("kind = 'function'").select(
        "symbol_id", F.lit("function_body").alias("kind"), F.col("fqn").alias("name"), *common, body(F.col("line_start"), F.col("line_end")).alias("cut"), F.lit("").alias("tail"),
    )
    owner = symbols.select("symbol_id", "path", "fqn")
    own = methods.select("method_id", "symbol_id", "name", "signature", "line_start", "line_end").join(owner, "symbol_id").select(
        F.col("method_id").alias("symbol_id"), F.lit("method_body").alias("kind"), F.concat("fqn", F.lit("::"), "name").alias("name"), *common,
        body(F.col("line_start"), F.col("line_end")).alias("cut"), F.lit("").alias("tail"),
    )
    wanted = overview.unionByName(bodies).unionByName(own)
    parts = slices(files, wanted.select("path", "line_start", F.col("cut").alias("line_end"))).select("path", "line_start", F.col("line_end").alias("cut"), "content")
    made = wanted.join(parts, ["path", "line_start", "cut"]).join(files.select("path", "sha256"), "path").select(
        "symbol_id", "kind", "path", "name", F.col("line_start").cast("int").alias("start"), F.col("line_end").cast("int").alias("end"), "sha256", "signature",
        F.concat("content", "tail").alias("content"),
    )
    return made.unionByName(_file_blocks(files.join(symbols.select("path"), "path", "left_anti")))


def _file_blocks(files: DataFrame) -> DataFrame:
    rows = files.where("current = sha256").select("path", "sha256", file_lines("content").alias("lines")).where(F.size("lines") > 0)
    count = F.ceil(F.size("lines") / BLOCK).cast("int")
    rows = rows.select("path", "sha256", "lines", F.explode(F.sequence(F.lit(1), count)).alias("no"))
    start = (F.col("no") - 1) * BLOCK + 1
    return rows.select(
        F.concat(F.lit("file:"), "path", F.lit(":segment:"), "no").alias("symbol_id"), F.lit("file_body").alias("kind"), "path", F.col("path").alias("name"),
        start.alias("start"), F.least(F.size("lines"), start + BLOCK - 1).alias("end"), "sha256", F.concat(F.lit("file "), "path").alias("signature"),
        F.array_join(F.slice("lines", start, F.lit(BLOCK)), "").alias("content"),
    )


def skipped_files(files: DataFrame) -> DataFrame:
    """(path) of files that have moved on since the map was built: they give no chunk until the map is refreshed."""
    return files.where("current is null or current <> sha256").select("path")
