"""Hints from string literals of sources: tables that queries in them name, and templates that calls are given.

Sources are cut into code, comments and literals in one pass (`rename.code_pieces`), so that a query in a comment gives no hint and a literal
that is no comment does. Double-quoted strings with variables in them are no literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.operators.rename import code_pieces

# The words before a table in a query.
WORDS = r"INSERT\s+INTO|DELETE\s+FROM|REPLACE\s+INTO|UPDATE|FROM|JOIN"
TABLE = rf"(?i)\b({WORDS})\s+`?([a-zA-Z_][a-zA-Z0-9_]*)`?"
OPEN_END = rf"(?i)({WORDS})\s*$"
_BLANKS = " \t\r\n"


def _action(words: Column) -> Column:
    first = F.upper(F.regexp_extract(words, r"^\w+", 0))
    return F.when(first.isin("INSERT", "DELETE", "REPLACE", "UPDATE"), first).otherwise("SELECT")


def _around(files: DataFrame) -> DataFrame:
    """Pieces without comments, with the trimmed ones around them and what a literal holds (null for others)."""
    w = Window.partitionBy("path").orderBy("no")
    rows = code_pieces(files)
    rows = rows.withColumn("variable", (F.col("kind") == "string") & F.col("piece").startswith('"') & F.col("piece").rlike(r"\$[A-Za-z_{]|\{\$"))
    literal = F.when((F.col("kind") == "string") & ~F.col("variable"), F.expr("substring(piece, 2, length(piece) - 2)"))
    near = lambda c, n: F.btrim((F.lag if n < 0 else F.lead)(c, abs(n)).over(w), F.lit(_BLANKS))
    return rows.select(
        "path", "line", "no", "kind", "piece", literal.alias("text"), near("piece", -1).alias("b1"), near("piece", 1).alias("n1"),
        near("piece", 3).alias("n3"), F.lead(literal, 2).over(w).alias("next_text"),
    )


def table_hints(files: DataFrame) -> DataFrame:
    """(path, line, name, action) of files (path, content): each table that a query in a literal names, and `<dynamic table>` where a literal
    that begins a concatenation ends before the table."""
    rows = _around(files).where("text is not null")
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(TABLE), F.lit(1)).alias("words"), F.regexp_extract_all("text", F.lit(TABLE), F.lit(2)).alias("name"))
    named = rows.select("path", "line", F.explode(zipped).alias("m")).select("path", "line", F.col("m.name").alias("name"), _action(F.col("m.words")).alias("action"))
    continued = F.col("n1").startswith(".") & ~F.coalesce(F.col("b1").endswith("."), F.lit(False)) & ~((F.col("n1") == ".") & F.col("next_text").isNotNull())
    ends = F.regexp_extract(F.rtrim("text"), OPEN_END, 1)
    open_ = rows.where(continued & (ends != "")).select("path", "line", F.lit("<dynamic table>").alias("name"), _action(ends).alias("action"))
    return named.unionByName(open_)


def template_hints(files: DataFrame, names: list[str]) -> DataFrame:
    """(path, line, template) of calls of these names with an argument: their first argument if it is a literal, else `<dynamic>`."""
    rows = _around(files).where((F.col("kind") == "name") & F.col("piece").isin(names) & F.col("n1").startswith("(") & (F.lower(F.coalesce("b1", F.lit(""))) != "function"))
    bare = F.btrim(F.substring("n1", 2, 1_000_000), F.lit(_BLANKS))
    literal = (bare == "") & F.col("next_text").isNotNull() & (F.col("n3").startswith(",") | F.col("n3").startswith(")"))
    return rows.where(~bare.startswith(")")).select("path", "line", F.when(literal, F.col("next_text")).otherwise("<dynamic>").alias("template"))
