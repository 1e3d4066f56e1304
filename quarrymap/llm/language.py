"""Language identification in two steps: the family first, then support vector machines between its languages.

Features are counts of 1- to 3-byte grams of the lower-cased letters of a whole text, hashed into a fixed number of
buckets, square-rooted and scaled to length one. A linear support vector machine per family (one against the rest) picks
the family; within it, one linear support vector machine for each two languages votes, ties going to the larger margin.

Margins only compare the learned languages, so the score is their product with how likely the text is to be any of them:
the mean log-likelihood of its grams under each language's gram frequencies, less the mean for that language, in standard
deviations for a text of its length; the best language counts, or the two nearest in parts, so that a text in two languages is known. Random letters, code and languages that were not learned
score near 0, and so does a text of one letter, which tells no language. Short texts give little evidence either way.

Training takes at most `per_language` labelled documents of each language (in the order of a hash of doc_id and text): a
bounded sample, fitted in one task; everything else covers all rows, and a text of any length is one vector of counts. Texts that are null or have no letter are `und` with
score 0. Without any labelled row every text is `und`; with one language every text with a letter gets it.
Labels that are null, and rows whose doc_id is null, are not learned from; rows that are repeated may be drawn each. Other
columns are kept as they are, but for one that is named like the new one: it is replaced.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymap.llm.common import stored

BUCKETS = 4096
PER_LANGUAGE, MOST_LANGUAGES = 400, 400
# Language families by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "be"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "semitic": ["ar", "he", "mt"],
    "indic": ["hi", "bn", "ur", "mr", "pa", "gu"],
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: Likelihood: weight of the even distribution in the gram frequencies, how much more the grams of a text vary than
#: independent ones, least variance between texts of a language, grams from which texts show that variance, and the
#: deviations below the mean at which a text is as likely as not to be of no learned language.
EVEN, OVERLAP, LEAST_VARIANCE, LONG, FAR = 0.01, 4.0, 0.02, 3000, 4.5
#: Texts that are farther than this from each language are held against parts of the two nearest.
NEAR, PARTS = -2.0, (0.2, 0.35, 0.5, 0.65, 0.8)


def grams(text: str) -> np.ndarray:
    """The counts of a whole text; runs of other characters count as one blank."""
    letters = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split()) + b" "
    b = np.frombuffer(letters, np.uint8).astype(np.uint32)
    mask = np.uint32(BUCKETS - 1)
    two = (b[:-1] * np.uint32(2654435761)) ^ (b[1:] * np.uint32(40503))
    three = (two[:-1] * np.uint32(2246822519)) ^ (b[2:] * np.uint32(3266489917))
    counts = np.bincount((b * np.uint32(2654435769) >> 7) & mask, minlength=BUCKETS)
    counts += np.bincount((two ^ (two >> 15)) & mask, minlength=BUCKETS)
    if len(three):
        counts += np.bincount((three ^ (three >> 13)) & mask, minlength=BUCKETS)
    return counts.astype(np.float32)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Rows of counts as vectors of length one."""
    x = np.sqrt(counts)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linear_svm(x: np.ndarray, y: np.ndarray, rounds: int = 20, c: float = 10.0) -> np.ndarray:
    """Weights (the last one the bias) of a linear machine with squared hinge loss, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, alpha, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1) + 0.5 / c
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            new = max(0.0, alpha[i] - (y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c) / q[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class Profile:
    """Log frequencies of the grams of a language; mean and variance of a gram's, and the variance between texts."""

    log_share: np.ndarray
    mean: float
    variance: float
    between: float

    @staticmethod
    def of(counts: np.ndarray) -> Profile:
        n = counts.sum(axis=1, dtype=np.float64)
        shares = counts / n[:, None]
        q = shares.mean(axis=0) + EVEN / counts.shape[1]
        q /= q.sum()
        log_share = np.log(q)
        mean = float(q @ log_share)
        off = (shares @ log_share - mean)[n > LONG]
        between = max(LEAST_VARIANCE, float(off.var()) if len(off) else 0.0)
        return Profile(log_share, mean, float(q @ (log_share - mean) ** 2), between)

    def with_part(self, other: Profile, part: float) -> Profile:
        """The profile of texts of which such a part is in the other language."""
        q = (1 - part) * np.exp(self.log_share) + part * np.exp(other.log_share)
        log_share = np.log(q)
        mean = float(q @ log_share)
        return Profile(log_share, mean, float(q @ (log_share - mean) ** 2), max(self.between, other.between))

    def deviations(self, counts: np.ndarray) -> np.ndarray:
        n = counts.sum(axis=1, dtype=np.float64)
        return (counts @ self.log_share / n - self.mean) / np.sqrt(OVERLAP * self.variance / n + self.between)


@dataclass
class Model:
    families: list[str]
    languages: dict[str, list[str]]
    family_weights: np.ndarray
    pair_weights: dict[str, dict[tuple[int, int], np.ndarray]] = field(default_factory=dict)
    profiles: list[Profile] = field(default_factory=list)

    def known(self, counts: np.ndarray) -> np.ndarray:
        """How likely each row of counts is to be of any learned language, or of the two nearest ones in parts, 0 to 1."""
        each = np.stack([p.deviations(counts) for p in self.profiles])
        best = each.max(axis=0)
        if len(self.profiles) > 1:
            two = np.sort(np.argsort(-each, axis=0, kind="stable")[:2], axis=0)
            for row in np.flatnonzero(best < NEAR):  # few
                a, b = (self.profiles[i] for i in two[:, row])
                best[row] = max(best[row], *(a.with_part(b, w).deviations(counts[row : row + 1])[0] for w in PARTS))
        # n letters make 3 n + 3 grams, with the blanks at both ends
        return np.where(counts.sum(axis=1) <= 6, 0.0, _logistic((best + FAR) / 2))

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of counts; the score is the product of both steps' logistic margins and known."""
        x = scaled(counts)
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        margins = x @ self.family_weights.T
        family, sure = margins.argmax(axis=1), np.ones(len(x))
        if len(self.families) > 1:
            two = np.sort(margins, axis=1)[:, -2:]
            sure = _logistic(two[:, 1] - two[:, 0])
        names = np.empty(len(x), object)
        for f, name in enumerate(self.families):
            rows, langs = np.flatnonzero(family == f), self.languages[name]
            votes, least = np.zeros((len(rows), len(langs))), np.full((len(rows), len(langs)), np.inf)
            for (a, b), w in self.pair_weights[name].items():
                m = x[rows] @ w
                votes[np.arange(len(rows)), np.where(m > 0, a, b)] += 1
                least[:, a], least[:, b] = np.minimum(least[:, a], m), np.minimum(least[:, b], -m)
            best = (votes + _logistic(np.where(np.isinf(least), 0, least)) / 2).argmax(axis=1)
            names[rows] = np.array(langs, object)[best]
            if len(langs) > 1:
                sure[rows] *= _logistic(2 * least[np.arange(len(rows)), best])
        return list(names), np.clip(sure * self.known(counts), 0.0, 1.0)


def _logistic(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(m, -30, 30)))


def fit(rows: list[tuple[str, np.ndarray]]) -> Model | None:
    """A model of (language, counts) rows, None if there are none."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    counts, y = np.stack([v for _, v in rows]), np.array([lang for lang, _ in rows])
    x = scaled(counts)
    family = {lang: FAMILY_OF.get(lang, f"only {lang}") for lang in langs}
    names = sorted(set(family.values()))
    of = np.array([family[lang] for lang in y])
    model = Model(names, {n: [g for g in langs if family[g] == n] for n in names}, np.zeros((len(names), x.shape[1] + 1)))
    model.profiles = [Profile.of(counts[y == lang]) for lang in langs]
    for f, name in enumerate(names):
        if len(names) > 1:
            model.family_weights[f] = linear_svm(x, np.where(of == name, 1.0, -1.0))
        own, model.pair_weights[name] = model.languages[name], {}
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                some = (y == own[a]) | (y == own[b])
                model.pair_weights[name][a, b] = linear_svm(x[some], np.where(y[some] == own[a], 1.0, -1.0))
    return model


@F.pandas_udf(T.BinaryType())
def _grams(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: zlib.compress(grams(t).tobytes(), 1))


def has_letter(text: str):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: str = "doc_id"):
    """Whether crc32(doc_id as text) mod 4 is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model | None:
    """Fit on (doc_id, text, lang): per_language rows of each language, the least by a hash of doc_id and text. Of more than
    most_languages labels the most frequent are learned (of as frequent ones the first by name), the others aren't.

    Rows above a threshold of that hash, from the count of the language, are left out where they are read, so that about three
    times per_language rows of a language go on, as vectors, whatever the number of tasks. One task fits the model; it gets
    per_language rows of a few KB for each of at most most_languages languages. Only the weights come to the driver."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & has_letter("text"))
    rows = rows.select("lang", "doc_id", "text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    shares = stored(sizes.select("lang", (F.lit(3.0 * per_language) / F.col("n")).alias("share")), "languages")
    place = F.xxhash64("doc_id", "text")
    rows = rows.withColumn("place", place).join(F.broadcast(shares), "lang")
    rows = rows.where(F.shiftrightunsigned("place", 11) * F.lit(2.0**-53) < F.col("share"))
    rows = rows.select("lang", "place", "doc_id", _grams("text").alias("v"))
    w = Window.partitionBy("lang").orderBy("place", "doc_id")
    picked = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_language)

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lang", "k"])
        got = [(x, np.frombuffer(zlib.decompress(v), np.float32)) for x, v in zip(rows["lang"], rows["v"])]
        return pd.DataFrame({"model": [pickle.dumps(fit(got))]})

    found = picked.groupBy(F.lit(0).alias("all")).applyInPandas(fitted, "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else None


def identify(df: DataFrame, model: Model | None, text: str = "text", out: str = "language") -> DataFrame:
    """df with a struct (lang string, score double) of each whole text; a column that is called `out` already is replaced."""

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = np.array(["und"] * len(texts), object), np.zeros(len(texts))
        if model is not None:
            known = np.flatnonzero(texts.notna().to_numpy())
            for part in np.array_split(known, max(1, len(known) // 256)):
                if len(part):
                    langs[part], scores[part] = model.predict(np.stack([grams(t) for t in texts.iloc[part]]))
        return pd.DataFrame({"lang": langs, "score": scores})

    return df.withColumn(out, predict(F.when(has_letter(text), F.col(text))))
