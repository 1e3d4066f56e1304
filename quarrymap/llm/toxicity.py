"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens are runs of letters of a lower-cased text. From labelled documents, each different text counted once, a token's score is the
log of how much more of the toxic documents' tokens it is than of the others', under a Dirichlet prior with the token's own frequency
in both, drawn towards 0 by DEVIATIONS standard deviations; tokens without significance score 0. Every token loses DRIFT, so that
ordinary text runs downwards, and all maximal scoring segments of a document are found in one scan over its tokens.

Scores of segments are set against chance as extreme values: a quarter of the labelled documents is judged by the counts of the rest. The
segments of those that are not toxic are K a token and their scores lie exponentially about 1 / LAMBDA, so that n tokens have K * n * exp(-LAMBDA * s)
of at least s; one segment of score 1 is added to those that were found, for where there are few. A passage is significant if that number is at most SIGNIFICANT. The best r segments of a document count together by the
probability of such a sum; the least over r is the document's evidence. On the same labelled documents a logistic curve from evidence to
label is fitted by sums over bins of evidence, and gives the score of any document, 0 to 1.

Learning takes at most MOST_LABELS labelled rows (the least by a hash of doc_id; a label of a repeated doc_id is the greatest); what goes to
all tasks are their numbers and labels and the scores of significant tokens, which cannot be more than their tokens. Everything else covers
all rows and whole texts. Null and empty texts have no segment and the evidence 0. Without rows of both labels no text is toxic: the score is 0.
Tokens longer than LONGEST are known by their hash. Rows whose doc_id or label is null aren't learned from; rows that are repeated are scored
each. Other columns are kept, but for one that is named like the new one: it is replaced.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymap.llm.common import spare, stored

MOST_LABELS = 400_000
DEVIATIONS, PRIOR, LEAST_COUNT, DRIFT = 3.0, 0.1, 0.01, 0.1
SIGNIFICANT, BEST, LONGEST, CACHE = 0.01, 2, 64, 400_000
COUNTS = ["other", "toxic", "other_apart", "toxic_apart"]
#: The bins of evidence.
BIN, MOST_EVIDENCE = 0.25, 400.0
_TOKEN = re.compile(r"[^\W\d_]+")


def token_key(token: str) -> str:
    return token if len(token) <= LONGEST else "#" + hashlib.sha256(token.encode("utf-8", "surrogatepass")).hexdigest()


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """(start, end, sum) of all maximal scoring segments, in order: none scores more if it is made longer or shorter. One pass: each
    found segment remembers the last one before it whose sum begins lower, so that none is looked at again once it is passed over."""
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before it, sum after it, the last that begins lower
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        start, lower = i, len(found) - 1
        while True:
            while lower >= 0 and found[lower][2] >= before:
                lower = found[lower][4]
            if lower < 0 or found[lower][3] >= total:
                break
            start, _, before, _, up = found[lower]
            del found[lower:]
            lower = up
        found.append((start, i + 1, before, total, lower))
    return [(a, b, after - before) for a, b, before, after, _ in found]


@dataclass
class Chance:
    """Extreme values of segment scores in ordinary text, and the curve from evidence to label."""

    rate: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    middle: float = 0.0

    def expected(self, score: float, tokens: int) -> float:
        """How many segments of at least this score ordinary text of so many tokens has."""
        return self.k * tokens * math.exp(-self.rate * score)

    def evidence(self, scores: list[float], tokens: int) -> float:
        """-ln of the least probability, over r, of r segments as good as the best r in ordinary text."""
        best, total, base = 0.0, 0.0, math.log(max(self.k * tokens, 1e-300))
        for r, score in enumerate(sorted(scores, reverse=True)[:BEST], 1):
            total += self.rate * score - base
            if total <= 0:
                break
            if r == 1:
                log_p = math.log(-math.expm1(-math.exp(-total))) if total < 30 else -total
            else:
                log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
            best = max(best, -log_p - (math.log(r) if r > 1 else 0.0))
        return min(best, MOST_EVIDENCE)

    def score(self, evidence: float) -> float:
        return 0.0 if self.slope <= 0 else 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * (evidence - self.middle)))))


@dataclass
class Model:
    weights: dict[str, float]
    chance: Chance


class _Scores(dict):
    """Score of a token; those that are seen again are kept, up to CACHE."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        score = self.weights.get(token_key(token), 0.0) - DRIFT
        if len(token) <= LONGEST:
            self[token] = score
        return score


def _of_text(text: str | None, known: _Scores) -> tuple[list[float], list[tuple[int, int, float]]]:
    scores = list(map(known.__getitem__, _TOKEN.findall((text or "").lower())))
    return scores, segments(scores)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32(doc_id as text) mod 5 is 0; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _learned(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, toxic, apart) of at most `most` labelled documents, each different text once; a quarter is set apart."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    rows = stored(rows.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")), "labels")
    n, place = rows.count(), F.xxhash64("doc_id")
    share = 1.1 * most / max(n, 1)  # so that what is sorted is about the bound, not all rows
    few = rows if n <= most else rows.where(F.shiftrightunsigned(place, 11) * F.lit(2.0**-53) < share).orderBy(place, "doc_id").limit(most)
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("same")).join(few, "doc_id")
    once = texts.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    return stored(once.select("doc_id", "toxic", (F.pmod(F.xxhash64("same"), F.lit(4)) == 0).alias("apart")), "learned")


def _labelled_texts(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """Of rows with the same doc_id all are taken; learned has at most MOST_LABELS rows of three numbers."""
    return docs.select("doc_id", "text").join(F.broadcast(learned), "doc_id").select("text", "toxic", "apart")


def _counted(texts: DataFrame) -> DataFrame:
    """(token, other, toxic, other_apart, toxic_apart): how many texts of each label have the token, and how many of those set apart; a
    null token tells how many tokens these texts have together."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str | None, list[int]] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(t, c[0] + c[2], c[1] + c[3], c[2], c[3]) for t, c in counts.items()], columns=["token", *COUNTS])
            counts.clear()
            return out

        for batch in batches:
            for text, toxic, apart in zip(batch.text, batch.toxic, batch.apart):
                place = int(toxic) + 2 * int(apart)
                tokens = set(map(token_key, _TOKEN.findall((text or "").lower())))
                for token in tokens:
                    counts.setdefault(token, [0] * 4)[place] += 1
                counts.setdefault(None, [0] * 4)[place] += len(tokens)
            if len(counts) > CACHE:
                yield flush()
        yield flush()

    counted = texts.mapInPandas(work, "token string, " + ", ".join(f"{c} long" for c in COUNTS))
    return counted.groupBy("token").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _weights(counted: DataFrame, other: str, toxic: str) -> dict[str, float]:
    """Scores of the significant tokens. One that only a few texts have never is, so their number is bounded by the learned texts."""
    total = counted.where("token is null").select(F.expr(other).alias("other"), F.expr(toxic).alias("toxic")).first()
    if total is None or not total.other or not total.toxic:
        return {}
    n0, n1 = float(total.other), float(total.toxic)
    some = counted.where("token is not null").select("token", F.expr(other).alias("other"), F.expr(toxic).alias("toxic"))
    share = (F.col("other") + F.col("toxic")) / F.lit(n0 + n1)
    a0 = F.col("other") + share * (n0 * PRIOR) + LEAST_COUNT * n0 / (n0 + n1)
    a1 = F.col("toxic") + share * (n1 * PRIOR) + LEAST_COUNT * n1 / (n0 + n1)
    odds = F.log(a1 / n1) - F.log(a0 / n0)
    score = F.signum(odds) * (F.abs(odds) - DEVIATIONS * F.sqrt(1 / a0 + 1 / a1))
    return {r.token: r.score for r in some.select("token", odds.alias("odds"), score.alias("score")).where("odds * score > 0").collect()}


def _measured(texts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(toxic, tokens, found, total, scores) of labelled texts: their segments, the sum of these and the best of them."""
    shared = texts.sparkSession.sparkContext.broadcast(pickle.dumps(weights))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Scores(pickle.loads(shared.value))
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.text, batch.toxic):
                scores, found = _of_text(text, known)
                sums = sorted((s for *_, s in found), reverse=True)
                rows.append((int(toxic), len(scores), len(sums), float(sum(sums)), sums[:BEST]))
            yield pd.DataFrame(rows, columns=["toxic", "tokens", "found", "total", "scores"])

    return texts.mapInPandas(work, "toxic int, tokens long, found long, total double, scores array<double>")


def _chance(measured: DataFrame) -> Chance:
    sums = measured.where("toxic = 0").agg(F.sum("tokens").alias("n"), F.sum("found").alias("m"), F.sum("total").alias("s")).first()
    if not sums.n:
        return Chance()
    return Chance(rate=(sums.m + 1) / (sums.s + 1), k=(sums.m + 1) / sums.n)


def _curve(measured: DataFrame, chance: Chance) -> Chance:
    """The logistic curve over bins of evidence, by Newton's steps; labels are drawn in by one row of the other label in each class."""
    rate, k = chance.rate, chance.k

    @F.pandas_udf("long")
    def binned(tokens: pd.Series, scores: pd.Series) -> pd.Series:
        known = Chance(rate, k)
        return pd.Series([int(known.evidence(list(s), int(n)) / BIN) if n else 0 for n, s in zip(tokens, scores)], dtype="int64")

    rows = measured.groupBy(binned("tokens", "scores").alias("bin")).agg(F.count_if(F.col("toxic") == 0).alias("c0"), F.count_if(F.col("toxic") == 1).alias("c1")).collect()
    n0, n1 = sum(r.c0 for r in rows), sum(r.c1 for r in rows)
    if not n0 or not n1:
        return chance
    x = np.array([(r.bin + 0.5) * BIN for r in rows])
    c0, c1 = np.array([float(r.c0) for r in rows]), np.array([float(r.c1) for r in rows])
    high, low = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)
    hits, n = c1 * high + c0 * low, c0 + c1
    scale = max(1.0, float((x * n).sum() / n.sum()))
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.array([0.0, math.log((n1 + 1) / (n0 + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z.T * (n * p * (1 - p) + 1e-9)) @ z + 1e-6 * np.eye(2), z.T @ (hits - n * p) - 1e-6 * w)
        w += step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return Chance(rate, k, float(w[0] / scale), float(-w[1] * scale / w[0])) if w[0] > 0 else chance


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Model:
    """Learn from labels (doc_id, toxic) that are not held out, and from the texts of docs (doc_id, text)."""
    texts = _labelled_texts(docs, _learned(docs, labels, most))
    counted = stored(_counted(texts), "token-counts")
    without = _weights(counted, "other - other_apart", "toxic - toxic_apart")  # what judges the texts set apart hasn't seen them
    measured = stored(_measured(texts.where("apart"), without), "measured")
    return Model(_weights(counted, "other", "toxic"), _curve(measured, _chance(measured)))


def toxicity(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a struct (score double, evidence double, passages array<struct<start, end, score, expected>>): significant passages with
    their places in the lower-cased text (code points, end exclusive), their scores and how many as good chance gives."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = "score double, evidence double, passages array<struct<start:int,end:int,score:double,expected:double>>"

    @F.pandas_udf(schema)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = pickle.loads(shared.value)
        weights, chance = _Scores(known.weights), known.chance
        for texts in batches:
            rows = []
            for value in texts:
                scores, found = _of_text(value, weights)
                evidence = chance.evidence([s for *_, s in found], len(scores)) if scores else 0.0
                good = [(a, b, s, e) for a, b, s in found if (e := chance.expected(s, len(scores))) <= SIGNIFICANT]
                places = [m.span() for m in _TOKEN.finditer(value.lower())] if good else []
                passages = [{"start": places[a][0], "end": places[b - 1][1], "score": s, "expected": e} for a, b, s, e in good]
                rows.append((chance.score(evidence), evidence, passages))
            yield pd.DataFrame(rows, columns=["score", "evidence", "passages"])

    both = spare("judged", docs.columns)
    return docs.withColumn(both, judged(text)).withColumn(out, F.col(both)).drop(both)
