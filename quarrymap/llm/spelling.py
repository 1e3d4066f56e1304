"""Spelling variants: words one inserted, deleted or replaced code point apart, by two-dimensional range reporting.

A word that differs from another at position i shares with it what is before i and what is after it. In the order of the words the
first makes an interval, in the order of the reversed words the second one, and the words in both are a rectangle among the points
(place in the one order, place in the other). A wavelet tree of the words of one length reports the points of a rectangle without
looking at others; for each edit position of a word, words of its own length are reported for a replacement and those one longer for
an insertion. Of an insertion that can be made at several positions only the leftmost is reported.

The words are dealt to tasks so that near words meet: the first half of the positions leaves the word's second half untouched, and the
other way round, so a word is sent by the hash of each half for the positions of the other, once in its own length and once for words one
shorter. A half that more than BIG words share has its positions divided again, with more of the word in the key, down to a single
position, where no more than BIG words over these letters can meet. So each position of a word is searched in one task, each pair is found once
in each direction, and counts of tasks can be added. The orders' intervals come from the lengths of common prefixes of neighbours, so
that a long word which shares little with others costs little.

Words are counted over all texts. Null texts have no words; a null doc_id counts as empty where words are garbled; runs of any length are
whole; rows that are repeated count each. An empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymap.llm.common import partitions, stored

LEAST_LENGTH, LEAST_COUNT, FACTOR, GARBLED = 6, 5, 5, 199
#: At a single position at most 90 words of one length and 90 * 90 of the next can share all the rest (a-z and the letters U+00C0 to U+00FF).
BIG, ROWS_PER_TASK, QUERIES = 8192, 100_000, 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, garbled: int | None = GARBLED) -> DataFrame:
    """(word, n) of the words of at least so many code points that occur at least so many times in docs (doc_id, text). With
    `garbled`, a run whose unsigned crc32 of `<doc_id>:<run>` it divides loses the code point at that number mod its length."""
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), 0)  # shorter ones give no word
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if garbled:
        h = F.crc32(F.concat("id", F.lit(":"), "word"))
        at = F.pmod("h", F.length("word").cast("long")).cast("int")
        short = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        rows = rows.withColumn("h", h).select(F.when(F.col("h") % garbled == 0, short).otherwise(F.col("word")).alias("word"))
        rows = rows.where(F.length("word") >= least_length)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _keyed(entries: DataFrame) -> DataFrame:
    """entries (word, n, size, low, high) with the hash of what stays untouched by edits at positions low to high - 1 of a word of
    length size; the word has that length or one more."""
    rest = F.greatest(F.col("size") - F.col("high"), F.lit(0))
    before, after = F.substring("word", F.lit(1), F.col("low")), F.substring("word", F.length("word") - rest + 1, rest)
    return entries.withColumn("key", F.xxhash64("size", "low", "high", before, after))


def _entries(words: DataFrame, least_length: int) -> DataFrame:
    sizes = F.when(F.length("word") > least_length, F.array(F.length("word"), F.length("word") - 1)).otherwise(F.array(F.length("word")))
    rows = words.select("word", "n", F.explode(sizes).alias("size")).withColumn("half", F.floor(F.col("size") / 2).cast("int"))
    sides = F.array(F.struct(F.lit(0).alias("low"), F.col("half").alias("high")), F.struct(F.col("half").alias("low"), (F.col("size") + 1).alias("high")))
    return _keyed(rows.select("word", "n", "size", F.inline(sides)))


def _dealt(words: DataFrame, least_length: int, big: int) -> DataFrame:
    """The entries of all words under keys of at most `big` of them, or of a single position."""
    entries, out = _entries(words, least_length), None
    while True:
        counts = entries.where("high - low > 1").groupBy("key").agg(F.count("*").alias("rows"))
        hot = stored(counts.where(F.col("rows") > big).select("key"), "hot-keys")
        if hot.isEmpty():
            return entries if out is None else out.unionByName(entries)
        fine = entries.join(hot, "key", "left_anti")
        out = fine if out is None else out.unionByName(fine)
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        parts = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))
        again = entries.join(hot, "key", "left_semi").select("word", "n", "size", F.inline(parts))
        entries = stored(_keyed(again), "divided")


class WaveletTree:
    """A sequence of different integers 0 .. m - 1, level by level from the highest bit; each level keeps how many zeros come before each
    place, and the next one has the numbers with a zero first."""

    def __init__(self, values: np.ndarray):
        self.levels: list[tuple[int, np.ndarray]] = []
        for bit in range(max(1, int(len(values) - 1).bit_length()) - 1, -1, -1):
            one = (values >> bit) & 1
            zeros = np.zeros(len(values) + 1, np.int64)
            np.cumsum(1 - one, out=zeros[1:])
            self.levels.append((bit, zeros))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in low .. high - 1 at places left .. right - 1, for many queries at once."""
        query, base = np.arange(len(left)), np.zeros(len(left), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[left], zeros[right]
            query, base = np.concatenate([query, query]), np.concatenate([base, base + (1 << bit)])
            left, right = np.concatenate([a, zeros[-1] + left - a]), np.concatenate([b, zeros[-1] + right - b])
            some = (left < right) & (base < high[query]) & (base + (1 << bit) > low[query])
            query, base, left, right = query[some], base[some], left[some], right[some]
        return query, base


class Order:
    """Words in order: their code points one after another, and for each the intervals of places that share a prefix with it."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        common = self._common()
        #: How much of each word another one shares, and where its intervals (one for each length up to that) begin.
        self.shared = np.maximum(common, np.append(common[1:], 0)) if len(words) > 1 else np.zeros(len(words), np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.shared + 1)])
        self.low, self.high = np.zeros(self.at[-1], np.int64), np.zeros(self.at[-1], np.int64)
        alive, depth = np.arange(len(words)), 0
        while len(alive):
            first = common[alive] < depth
            first[0] = True
            run, starts = np.cumsum(first) - 1, alive[first]
            ends = np.append(alive[np.flatnonzero(first)[1:] - 1], alive[-1]) + 1
            self.low[self.at[alive] + depth], self.high[self.at[alive] + depth] = starts[run], ends[run]
            depth += 1
            alive = alive[self.shared[alive] >= depth]

    def _common(self) -> np.ndarray:
        """The length of the common prefix of each word and the one before it."""
        common = np.zeros(len(self.size), np.int64)
        if len(common) < 2:
            return common
        rows = np.arange(1, len(common))
        most = np.minimum(self.size[1:], self.size[:-1])
        depth = 0
        while len(rows):
            rows = rows[most[rows - 1] > depth]
            rows = rows[self.codes[self.start[rows] + depth] == self.codes[self.start[rows - 1] + depth]]
            depth += 1
            common[rows] = depth
        return common


def near_pairs(words: list[str], entry: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of numbers of different words, in code-point order, that are one edit apart at position low .. high - 1 of the word
    `entry` of length `size`: a replacement from that word, an insertion into it in both directions."""
    forward = Order(words)
    turned = sorted(range(len(words)), key=lambda i: words[i][::-1])
    back = Order([words[i][::-1] for i in turned])
    turned = np.array(turned, np.int64)
    place = np.empty(len(words), np.int64)
    place[turned] = np.arange(len(words))
    members: dict[int, tuple[np.ndarray, np.ndarray, WaveletTree]] = {}

    def of_length(n: int) -> tuple[np.ndarray, np.ndarray, WaveletTree] | None:
        if n not in members:
            mine = np.flatnonzero(forward.size == n)
            mirror = np.sort(place[mine])
            members[n] = (mine, mirror, WaveletTree(np.searchsorted(mirror, place[mine]))) if len(mine) else None
        return members[n]

    for longer in (0, 1):
        for n in np.unique(size).tolist():
            known = of_length(n + longer)
            if known is None:
                continue
            mine, mirror, tree = known
            some = np.flatnonzero(size == n)
            w, back_w = entry[some], place[entry[some]]
            # a word and one that is `longer` longer share i code points before the edit and n - 1 + longer - i after it
            first = np.maximum(low[some], n - 1 + longer - back.shared[back_w])
            last = np.minimum(np.minimum(high[some] - 1, n - 1 + longer), forward.shared[w])
            count = np.maximum(last - first + 1, 0)
            upto = np.cumsum(count)
            for part in np.split(np.arange(len(some)), np.searchsorted(upto, np.arange(QUERIES, int(upto[-1]) + 1, QUERIES)) if len(upto) else []):
                if not len(part) or not count[part].sum():
                    continue
                who = np.repeat(part, count[part])
                i = first[who] + np.arange(len(who)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
                f, g = forward.at[w[who]] + i, back.at[back_w[who]] + n - 1 + longer - i
                box = [np.searchsorted(mine, forward.low[f]), np.searchsorted(mine, forward.high[f]), np.searchsorted(mirror, back.low[g]), np.searchsorted(mirror, back.high[g])]
                full = (box[0] < box[1]) & (box[2] < box[3])
                query, value = tree.report(*[b[full] for b in box])
                a, i, b = w[who[full]][query], i[full][query], turned[mirror[value]]
                if longer:
                    before = np.where(i > 0, forward.codes[forward.start[a] + np.maximum(i, 1) - 1], 0)
                    leftmost = before != forward.codes[forward.start[b] + i]
                    a, b = a[leftmost], b[leftmost]
                    yield np.concatenate([a, b]), np.concatenate([b, a])
                else:
                    yield a[a != b], b[a != b]


def _near(entries: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): what each task found; the numbers of near words of a word add up."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        del parts
        counts = dict(zip(rows.word, rows.n))
        words = sorted(counts)
        number = {w: i for i, w in enumerate(words)}
        n = np.array([counts[w] for w in words], np.int64)
        own = rows[rows.word.str.len() == rows["size"]]
        entry = own.word.map(number).to_numpy(np.int64)
        for a, b in near_pairs(words, entry, *(own[c].to_numpy(np.int64) for c in ("size", "low", "high"))):
            if not len(a):
                continue
            order = np.lexsort((b, -n[b], a))  # words are numbered in order
            a, b = a[order], b[order]
            at = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            yield pd.DataFrame({
                "word": [words[i] for i in a[at]], "n_near": np.diff(np.append(at, len(a))), "form_n": n[b[at]], "form": [words[i] for i in b[at]],
            })

    return entries.select("word", "n", "size", "low", "high").mapInPandas(work, "word string, n_near long, form_n long, form string")


def variants(words: DataFrame, least_length: int = LEAST_LENGTH, factor: int = FACTOR, big: int = BIG, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(word, n, n_near, form, form_n) of words (word, n), each once: how many are near it, and the most frequent of these (the smallest
    of several) if it is at least factor times as frequent."""
    words = stored(words, "words")
    entries = _dealt(words, least_length, big)
    tasks = max(partitions(words.sparkSession), -(-4 * words.count() // rows_per_task))
    found = _near(entries.repartition(tasks, "key"))
    best = F.min(F.struct((-F.col("form_n")).alias("o"), "form")).alias("best")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    out = words.join(near, "word", "left")
    some = -F.col("best.o") >= factor * F.col("n")
    return out.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(some, F.col("best.form")).alias("form"), F.when(some, -F.col("best.o")).alias("form_n"),
    )


def with_roots(found: DataFrame) -> DataFrame:
    """found (word, form, ...) with the last form that forms lead to, the word itself if it has none. A form is more frequent than its
    word by a factor, so that there are as few steps as that factor's powers; only words that have not arrived take part in a step."""
    found = stored(found, "variants")
    forms = found.where("form is not null").select("word", "form")
    moving, arrived = forms.withColumnRenamed("form", "root"), None
    while True:
        moved = moving.join(forms.select(F.col("word").alias("root"), "form"), "root", "left")
        moved = stored(moved.select("word", F.coalesce("form", "root").alias("root"), F.col("form").isNotNull().alias("on")), "roots")
        ended = moved.where("not on").select("word", "root")
        arrived = ended if arrived is None else arrived.unionByName(ended)
        moving = moved.where("on").select("word", "root")
        if moving.isEmpty():
            break
    return found.join(arrived, "word", "left").withColumn("root", F.coalesce("root", "word"))
