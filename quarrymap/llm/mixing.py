"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent and normalised: w ~ p ** a. The exponent is bisected in [0, 1] for the
largest one whose weights reach the target entropy (`entropy` of the way from that of p to that of even shares) without
passing any source over more than `max_epochs` times; where both can't hold, the repetition limit wins. The budget is the
tokens of the corpus times `passes` over the source that is reduced most, so that with passes >= 1 no document is lost.

Weights become whole passes over a source plus a part of one more. The part follows a block permutation: documents fall
into blocks by a hash, blocks stand in the order of another hash, documents within a block likewise, and the part ends
with the document that meets the source's budget. Only sums for each block are put in order as a whole; a source of any
size is never sorted in one task.

A null source is a source of its own. Null or negative token counts count as 0. Documents of 0 tokens get the copies of
the whole passes. Repeated rows count each; rows equal in doc_id and source stand in the same place.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.llm.common import stored

ENTROPY, MAX_EPOCHS, PASSES, BLOCK_DOCS, SEED = 0.5, 4.0, 1.0, 4096, 17
LEVELS, JOBS = 6, 5


def _measures(sources: DataFrame, total: float, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: sum of p ** a, sum of p ** a * ln(p ** a), and the greatest p ** a / p."""
    p = F.col("tokens") / F.lit(total)
    aggs = []
    for i, a in enumerate(exponents):
        x = F.pow(p, F.lit(a))
        aggs += [F.sum(x).alias(f"s{i}"), F.sum(x * F.log(x)).alias(f"e{i}"), F.max(x / p).alias(f"m{i}"), F.min(x / p).alias(f"l{i}")]
    row = sources.agg(*aggs).first()
    return [(row[f"s{i}"], row[f"e{i}"], row[f"m{i}"], row[f"l{i}"]) for i in range(len(exponents))]


def _entropy(m: tuple) -> float:
    return math.log(m[0]) - m[1] / m[0]


def bisect_exponent(sources: DataFrame, entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, passes: float = PASSES) -> float:
    """The exponent for (source, tokens). Each job evaluates all midpoints of six bisection steps at once."""
    sources = sources.where("tokens > 0")
    total, n = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not total or n < 2:
        return 1.0
    one = _measures(sources, float(total), [1.0])[0]
    target = _entropy(one) + entropy * (math.log(n) - _entropy(one))

    def rises(m: tuple) -> bool:
        """Whether these weights reach the entropy, or repeat a source too often: then a larger exponent is right."""
        return _entropy(m) > target or passes * m[2] / m[3] > max_epochs

    low, high = 0.0, 1.0
    for _ in range(JOBS):
        steps = 2**LEVELS
        grid = [low + (high - low) * i / steps for i in range(1, steps)]
        flags = [True, *map(rises, _measures(sources, float(total), grid)), False]
        a, b = 0, steps
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if flags[mid] else (a, mid)
        low, high = low + (high - low) * a / steps, low + (high - low) * b / steps
    return round(high, 6)


def targets(sources: DataFrame, exponent: float, passes: float = PASSES) -> DataFrame:
    """(source, tokens, docs, weight, budget): weights p ** a over their sum, budgets in whole tokens."""
    live = sources.where("tokens > 0")
    total = float(live.agg(F.sum("tokens")).first()[0] or 1)
    p = F.col("tokens") / F.lit(total)
    raw = F.when(F.col("tokens") > 0, F.pow(p, F.lit(exponent))).otherwise(F.lit(0.0))
    norm = live.agg(F.sum(F.pow(p, F.lit(exponent))).alias("s"), F.min(F.pow(p, F.lit(exponent)) / p).alias("l")).first()
    scale = passes / (norm.l or 1.0)  # the source that is reduced most is passed over `passes` times
    return sources.select(
        "source", "tokens", "docs",
        F.round(raw / F.lit(norm.s or 1.0), 9).alias("weight"),
        F.round(raw * F.lit(scale * total)).cast("long").alias("budget"),
    )


def mix(
    docs: DataFrame,
    entropy: float = ENTROPY,
    max_epochs: float = MAX_EPOCHS,
    passes: float = PASSES,
    block_docs: int = BLOCK_DOCS,
    seed: int = SEED,
    key: str | None = None,
) -> DataFrame:
    """(doc_id, source, n_tokens) -> those with weight, copies and the place: block and rank in it. `key` names a column that
    tells all rows apart, if there is one; it is returned too."""
    rid = (F.col(key) if key else F.monotonically_increasing_id()).alias("rid")
    docs = docs.select(
        "doc_id", "source", F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"), rid
    )
    docs = stored(docs, "mix")
    sources = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    sources = stored(sources, "sources")
    exponent = bisect_exponent(sources, entropy, max_epochs, passes)
    goals = targets(sources, exponent, passes)
    goals = goals.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1)))
    goals = goals.withColumn("rest", F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(F.lit(0)))
    goals = goals.withColumn("blocks", F.ceil(F.col("docs") / block_docs).cast("long")).drop("tokens", "docs", "budget")
    # the sources come to each row by a join that AQE may broadcast or split; a hot source is not brought together
    rows = docs.join(goals, docs.source.eqNullSafe(goals.source)).drop(goals.source)
    place = F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), F.col("doc_id"))
    rows = rows.withColumn("place", place).withColumn("block", F.pmod(F.col("place"), F.col("blocks")))
    rows = rows.withColumn("block", F.xxhash64(F.lit(seed + 1), F.coalesce("source", F.lit("")), F.col("block")))
    sums = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_block").over(before), F.lit(0)))
    sums = sums.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "before", "in_block")
    rows = rows.join(sums, rows.source.eqNullSafe(sums._s) & (rows.block == sums._b)).drop("_s", "_b")
    inside = Window.partitionBy("source", "block").orderBy("place", "doc_id", "rid")
    earlier = F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("rank", F.row_number().over(inside)).withColumn("earlier", F.col("before") + earlier)
    extra = ((F.col("earlier") < F.col("rest")) & (F.col("n_tokens") > 0)).cast("long")
    known = [F.col("rid").alias(key)] if key else []
    return rows.select(*known, "doc_id", "source", "n_tokens", "weight", (F.col("whole") + extra).alias("copies"), "block", "rank")
