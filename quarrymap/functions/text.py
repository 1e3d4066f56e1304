"""Scalar functions over texts and paths, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def match_score(candidate: Column, term: str, base: int) -> Column:
    """0 without a match, base + 1000 if equal, else base with a bonus at the start and a loss by place and length, both in bytes."""
    found = F.instr(candidate, term)
    at = F.octet_length(F.substring(candidate, F.lit(1), found - 1))
    longer = F.octet_length(candidate) - len(term.encode())
    score = base + F.when(at == 0, 600).otherwise(0) - F.least(F.lit(500), 10 * at) - F.least(F.lit(99), F.greatest(F.lit(0), longer))
    return F.when(found == 0, 0).when(candidate == term, base + 1000).otherwise(score)


def is_test_path(path: str) -> Column:
    """A directory named test or tests, or a file name that ends in test.php or cest.php."""
    parts = F.split(F.lower(path), "/")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    last = F.element_at(parts, -1)
    return F.array_contains(above, "tests") | F.array_contains(above, "test") | last.endswith("test.php") | last.endswith("cest.php")


def path_nearness(a: str, b: str) -> Column:
    """1 / (1 + steps between the directories of two paths)."""
    d, e = (f"slice(split({x}, '/'), 1, size(split({x}, '/')) - 1)" for x in (a, b))
    same = f"size(filter(sequence(0, least(size({d}), size({e}))), i -> slice({d}, 1, i) = slice({e}, 1, i))) - 1"
    return F.expr(f"1D / (1 + size({d}) + size({e}) - 2 * ({same}))")


def type_display(resolved: str, phpdoc: str, native: str) -> Column:
    return F.coalesce(resolved, phpdoc, native)


def parameter_display(kind: Column, by_reference: Column, variadic: Column, name: Column) -> Column:
    """`type &...$name`."""
    sign = F.concat(F.when(by_reference, "&").otherwise(""), F.when(variadic, "...").otherwise(""), F.lit("$"), name)
    return F.concat_ws(" ", F.nullif(kind, F.lit("")), sign)


def symbol_id(kind: Column, fqn: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.regexp_replace(fqn, r"^\\+", ""))


def method_id(fqn: Column, name: Column) -> Column:
    return F.concat(F.lit("method:"), F.regexp_replace(fqn, r"^\\+", ""), F.lit("::"), name)


def nul_hash(*parts: Column) -> Column:
    """sha256 of the NUL-joined parts; a null part counts as empty, it is not left out."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def human_size(n: Column) -> Column:
    """Bytes below 1024, else KB with one place unless it is 0."""
    kb = F.regexp_replace(F.round(n / 1024, 1).cast("decimal(30,1)").cast("string"), r"\.0$", "")
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(kb, F.lit(" KB")))


def is_method_name(name: Column) -> Column:
    """Letters, digits and underscores, not a digit first; code points from 128 on count as letters."""
    return F.coalesce(name.rlike(r"^[A-Za-z_\x{80}-\x{10ffff}][A-Za-z0-9_\x{80}-\x{10ffff}]*\z"), F.lit(False))


def with_last_segment(token: Column, replacement: Column) -> Column:
    """The token with what follows its last backslash (or all of it) replaced."""
    return F.concat(F.regexp_extract(token, r"^(.*\\)?", 0), replacement)


def _list(label: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{label} "), F.array_join(F.array_sort(values), ",")))


def symbol_signature(kind: Column, fqn: Column, parameters: Column, returns: Column, lists: dict[str, Column]) -> Column:
    """`kind fqn (parameters) : type extends a,b ...` of a symbol; lists by label, sorted."""
    parts = [
        kind, F.regexp_replace(fqn, r"^\\+", ""), F.when(F.size(parameters) > 0, F.concat(F.lit("("), F.array_join(parameters, ", "), F.lit(")"))),
        F.when(returns.isNotNull(), F.concat(F.lit(": "), returns)), *[_list(k, v) for k, v in lists.items()],
    ]
    return F.concat_ws(" ", *parts)


def method_signature(visibility: Column, static: Column, abstract: Column, final: Column, name: Column, parameters: Column, returns: Column, attributes: Column) -> Column:
    """`public static name(parameters): type attributes a,b` of a method."""
    modifiers = F.concat_ws(" ", visibility, F.when(static, "static"), F.when(abstract, "abstract"), F.when(final, "final"))
    head = F.concat(modifiers, F.lit(" "), name, F.lit("("), F.array_join(parameters, ", "), F.lit(")"), F.when(returns.isNotNull(), F.concat(F.lit(": "), returns)).otherwise(""))
    return F.trim(F.concat_ws(" ", head, _list("attributes", attributes)))
