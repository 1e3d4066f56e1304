"""Best-fit packing of documents into bins of a fixed length under conflicts.

Documents longer than a bin are cut into full bins and a rest. Rests are placed longest first into the open bin of least
residual that takes them: not two of one duplicate cluster in a bin, and of one source at most `per_source`. Bins stand
in a list for each residual, a bitmap says which residuals have any, and each bin carries a bitmap of its clusters and one
of the sources that are full; the search goes from the least sufficient residual upwards until a bin is compatible.

A document may be of several clusters and conflicts with all that share one. `clusters_of` deals the hashes of its word 5-grams into 96 bins and takes
the least of each; sixteen groups of six of these are its clusters. Two documents of similarity s share one with a probability of
1 - (1 - s^6)^16: 0.992 at 0.8, 0.22 at 0.5, 0.012 at 0.3. Equal texts share all.

Packing is done in shards of about `shard_docs` documents by a hash, each by one task that holds only ids and numbers;
cluster and source may be as large as they like, and rows that are equal in all columns are dealt out if there are many.
Rows without clusters (or null) conflict with nothing, a null source counts as a source. Documents of length null or below 1
count as length 1 (their end mark). Repeated rows are packed each. Other columns are not returned.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymap.llm import ngram_join
from quarrymap.llm.common import stored

CAPACITY, PER_SOURCE, SHARD_DOCS = 4096, 8, 4096
WORDS, BANDS, ROWS = 5, 16, 6
SCHEMA = "doc_id long, piece int, start long, length int, bin string, position int, offset int"

_FACTOR, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PLACES = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
_WEIGHTS = np.random.default_rng(11).integers(1, 1 << 62, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: For each bin, the bins that are asked in turn for their least hash if it has none.
_DONORS = np.random.default_rng(12).integers(0, BANDS * ROWS, (BANDS * ROWS, 48))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _FACTOR
    return h ^ (h >> np.uint64(29))


def bands(grams: np.ndarray) -> np.ndarray:
    """The cluster numbers of a set of hashes. A bin without any takes the
    least of the first of its donors that has some, told apart by its turn, so that bins beside each other don't take the same."""
    n = len(_DONORS)
    h = _mixed(grams)
    where = (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.uint8)  # one byte: sorted by counting
    order = where.argsort(kind="stable")
    where = where[order]
    starts = np.flatnonzero(np.diff(where, prepend=255))
    least = np.minimum.reduceat(h[order], starts)
    if len(starts) < n:
        place = np.full(n, -1)
        place[where[starts]] = np.arange(len(starts))
        asked = place[_DONORS]
        turn = (asked >= 0).argmax(axis=1)
        given = asked[np.arange(n), turn]  # -1: nobody asked had one
        least = np.where(place >= 0, least[place], np.where(given >= 0, least[given] + (turn + 1).astype(np.uint64) * _STEP, least[0]))
    return _mixed((_mixed(least).reshape(BANDS, ROWS) * _WEIGHTS).sum(axis=1, dtype=np.uint64) + _PLACES).astype(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def clusters_of(texts: pd.Series) -> pd.Series:
    """The clusters of each text; a null text has none, texts without words share one."""
    out = []
    for text, grams in zip(texts, ngram_join.shingles([t or "" for t in texts], WORDS)):
        if text is None:
            out.append(np.zeros(0, np.int64))
        else:
            out.append(bands(grams) if len(grams) else np.zeros(1, np.int64))
    return pd.Series(out, dtype=object)


class Bins:
    """Open bins by residual, with successor search."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0  # bit r: there is a bin of residual r
        self.residual: list[int] = []
        self.clusters: list[int] = []
        self.full: list[int] = []
        self.sources: list[Counter] = []
        self.size: list[int] = []

    def place(self, length: int, source: int, cluster_bit: int) -> tuple[int, int, int]:
        """(bin, position, offset) of a piece in the tightest compatible bin, or in a new one."""
        source_bit, found, r = 1 << source, -1, length
        while found < 0:
            above = self.some >> r
            if not above:
                break
            r += (above & -above).bit_length() - 1
            for b in self.at[r]:
                if not (self.clusters[b] & cluster_bit or self.full[b] & source_bit):
                    found = b
                    break
            else:
                r += 1
                if r > self.capacity:
                    break
        if found < 0:
            found, r = len(self.residual), self.capacity
            self.residual.append(r)
            self.clusters.append(0)
            self.full.append(0)
            self.sources.append(Counter())
            self.size.append(0)
        else:
            self.at[r].remove(found)
            if not self.at[r]:
                self.some ^= 1 << r
        left = r - length
        self.residual[found] = left
        if left:
            self.at[left].append(found)
            self.some |= 1 << left
        self.clusters[found] |= cluster_bit
        self.sources[found][source] += 1
        if self.sources[found][source] >= self.per_source:
            self.full[found] |= source_bit
        self.size[found] += 1
        return found, self.size[found] - 1, self.capacity - r


def pack_shard(rows: pd.DataFrame, capacity: int, per_source: int, shard: int) -> pd.DataFrame:
    """Pack rows (doc_id, source, clusters, length, tie)."""
    rows = rows.sort_values(["length", "doc_id", "tie"], ascending=[False, True, True], kind="stable", na_position="last")
    sources = {s: i for i, s in enumerate(sorted(rows["source"].dropna().unique()))}
    some = [set() if c is None else set(np.asarray(c).tolist()) for c in rows["clusters"]]
    counts = Counter(c for own in some for c in own)
    bits = {c: 1 << i for i, c in enumerate(c for c, n in counts.items() if n > 1)}
    bins, full, out, rests = Bins(capacity, per_source), 0, [], []
    for doc, source, own, length in zip(rows["doc_id"], rows["source"], some, rows["length"]):
        pieces, rest = divmod(int(length), capacity)
        for k in range(pieces):
            out.append((doc, k, k * capacity, capacity, f"{shard}-full-{full}", 0, 0))
            full += 1
        if rest:
            taken = 0
            for c in own:
                taken |= bits.get(c, 0)
            rests.append((rest, doc, pieces, sources.get(source, len(sources)), taken))
    rests.sort(key=lambda x: -x[0])
    for rest, doc, piece, source, taken in rests:
        b, position, offset = bins.place(rest, source, taken)
        out.append((doc, piece, piece * capacity, rest, f"{shard}-{b}", position, offset))
    got = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "bin", "position", "offset"])
    return got.astype({"doc_id": "Int64"})


def pack(
    docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_docs: int = SHARD_DOCS
) -> DataFrame:
    """(doc_id, source, clusters array<bigint>, length) -> a row for each piece: doc_id, piece, start of it in the document,
    length, bin, position in it and offset in it. The same rows give the same bins, however they are stored."""
    length = F.greatest(F.coalesce(F.col("length").cast("long"), F.lit(1)), F.lit(1))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "clusters", length.alias("length"))
    tie = F.xxhash64("doc_id", "source", "clusters", "length")
    docs = stored(docs.select("*", tie.alias("tie"), F.lit(0).alias("salt")), "pack")
    shards = max(1, -(-docs.count() // shard_docs))
    # rows that are equal in everything, if more than a shard's worth: which is which doesn't matter, so they are numbered
    hot = stored(docs.groupBy("tie").agg(F.count("*").alias("n")).where(F.col("n") > shard_docs).select("tie", F.lit(True).alias("hot")), "hot")
    if not hot.isEmpty():
        docs = docs.join(hot, "tie", "left").withColumn("salt", F.when(F.col("hot"), F.monotonically_increasing_id()).otherwise(0)).drop("hot")
    shard = F.pmod(F.xxhash64("tie", "salt"), F.lit(shards)).cast("int")

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(rows.astype({"doc_id": "Int64"}), capacity, per_source, int(key[0]))

    columns = ["doc_id", "source", "clusters", "length", "tie"]
    return docs.withColumn("shard", shard).select("shard", *columns).groupBy("shard").applyInPandas(one, SCHEMA)
