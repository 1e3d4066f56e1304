"""Similarity self-join of documents on word n-grams by prefix filtering, and its connected components.

A text becomes the set of its distinct n-grams of lower-cased (A-Z) words; with fewer words the whole sequence is one
n-gram; without words the set is empty and links with nothing. Two documents link when
100 * |intersection| >= percent * |union|.

1. Sets become 64-bit hashes. Documents of equal sets are one class; only classes are joined. A count sketch of fixed size
   estimates how many documents hold an n-gram, over all documents: the order "rare first" is by estimate, then hash. Any
   one order gives right results, so an estimate that is off costs only time.
2. Classes meet in the buckets of their prefix n-grams (length and positional filter). In a bucket of few classes all
   pairs are candidates. In a larger one each class is compared with one central class, then, while components differ,
   with others, and what is still apart at the end with everything else in the bucket: pairs whose ends are in one
   component already are never made.
3. Of each distinct candidate the suffix filter bounds the overlap by the counts of n-grams between pivots (256 bytes a set);
   what passes is verified once on the whole sets.

Rows whose doc_id is null get n_shingles and a null component and link with nothing. Repeated rows are one class.
Other columns are not returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymap.llm.common import connected_components, dropped, partitions, stored

WORDS, PERCENT = 4, 85
#: Counters of the sketch and their upper bound in one task: 2 MB each, whatever the input.
SKETCH_BITS, SKETCH_CHUNKS = 20, 16
#: Buckets up to this size give all their pairs at once.
SMALL = 8
#: Rounds in which each large bucket compares its classes with one central class.
STAR_ROUNDS = 3
#: Ids that may be broadcast, at 16 bytes each.
SENT = 200_000
_PIECE = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANKS = re.compile(rb"[\x20\x09-\x0d]")
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_ODD, 4096), _powers(_INVERSE, 4096)


def _grown(n: int) -> None:
    global _UP, _DOWN
    if len(_UP) < n:
        _UP, _DOWN = _powers(_ODD, 2 * n), _powers(_INVERSE, 2 * n)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; worked off in pieces that end between words."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        if end < len(data):
            cut = max(data.rfind(b, at, end) for b in (b" ", b"\n", b"\t", b"\r"))
            if cut <= at:  # a word of more than a piece
                found = _BLANKS.search(data, end)
                cut = found.start() if found else len(data)
            end = cut
        b = np.frombuffer(data, np.uint8, end - at, at)
        blank = _BLANK[b]
        edge = np.diff(blank.astype(np.int8), prepend=1, append=1)
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(first):
            _grown(len(b) + 1)
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _UP[: len(b)], out=sums[1:])
            hashes.append(_mixed((sums[last] - sums[first]) * _DOWN[first] + (last - first).astype(np.uint64)))
            starts.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    return map(np.unique, shingles(texts, words))


def shingles(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The n-gram hashes of each text in order."""
    batch: list[bytes] = []
    size = 0
    for text in texts:
        batch.append((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
        size += len(batch[-1])
        if size >= _PIECE:
            yield from _sets(batch, words)
            batch, size = [], 0
    if batch:
        yield from _sets(batch, words)


def _sets(batch: list[bytes], words: int) -> Iterator[np.ndarray]:
    hashes, starts = word_hashes(b" ".join(batch))
    bounds = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in batch]))
    factors = _powers(_ODD, 2 * words + 1)[1::2]
    grams = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        grams += hashes[k : k + len(grams)] * factors[k]
    grams, a = _mixed(grams + np.uint64(words)), 0
    for b in bounds.tolist():
        if b - a >= words:
            yield grams[a : b - words + 1]
        elif b > a:
            few = (hashes[a:b] * factors[: b - a]).sum(keepdims=True)
            yield _mixed(few + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
        a = b


def class_of(grams: np.ndarray) -> int:
    """A 64-bit hash of the whole set, as a signed number."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), len(grams))).astype(np.int64))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def overlap_needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of sets of n and m n-grams that link."""
    return -(-percent * (n + m) // (100 + percent))


def _features(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, cls) of each document, and in the same pass rows (chunk, counts) with each task's sketch."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, seen = np.zeros(1 << SKETCH_BITS, np.uint32), set()
        for rows in batches:
            n, cls, fresh = [], [], []
            for grams in shingle_sets(list(rows["text"]), words):
                c = class_of(grams)
                n.append(len(grams))
                cls.append(c)
                if c not in seen:
                    seen.add(c)
                    fresh.append(grams)
                if len(fresh) >= 2000:
                    counts += _counted(fresh)
                    fresh = []
            if fresh:
                counts += _counted(fresh)
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "n": n, "cls": cls, "chunk": -1, "counts": None})
        if counts.any():
            parts = np.minimum(counts, 65535).astype("<u2").reshape(SKETCH_CHUNKS, -1)
            yield pd.DataFrame({
                "doc_id": pd.array([None] * SKETCH_CHUNKS, "Int64"), "n": 0, "cls": 0, "chunk": range(SKETCH_CHUNKS),
                "counts": [p.tobytes() for p in parts],
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        work, "doc_id long, n int, cls long, chunk int, counts binary"
    )


def _counted(sets: list[np.ndarray]) -> np.ndarray:
    at = np.concatenate(sets) & np.uint64((1 << SKETCH_BITS) - 1)
    return np.bincount(at.astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)


def _sketch(features: DataFrame) -> np.ndarray:
    """Rarity class of each counter: the logarithm of its count in steps of an eighth of an octave; 1 MB in all."""

    def add(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_CHUNKS, np.uint64)
        for part in rows:
            for c in part["counts"]:
                total += np.frombuffer(c, "<u2")
        level = np.minimum(np.round(8 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)
        yield pd.DataFrame({"chunk": [key[0]], "levels": [level.tobytes()]})

    parts = features.where("chunk >= 0").select("chunk", "counts").groupBy("chunk")
    got = sorted(parts.applyInPandas(add, "chunk int, levels binary").collect())
    if not got:
        return np.zeros(1 << SKETCH_BITS, np.uint8)
    return np.frombuffer(b"".join(bytes(r.levels) for r in got), np.uint8)


def _prefixes(docs: DataFrame, words: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(h, cls, n, pos, centre): the prefix n-grams of each class, once for each task; centre is larger the more common
    the n-grams of the class are."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for rows in batches:
            out = []
            for grams in shingle_sets(list(rows["text"]), words):
                c = class_of(grams)
                if not len(grams) or c in seen:
                    continue
                seen.add(c)
                level = shared.value[(grams & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
                k = prefix_length(len(grams), percent)
                order = np.argsort(level, kind="stable")[:k]  # grams are sorted: ties stay in the order of the hash
                out.append((grams[order].astype(np.int64), np.full(k, c), np.full(k, len(grams), np.int32), np.arange(k, dtype=np.int32), np.full(k, level.mean(dtype=np.float32))))
            if out:
                h, cls, n, pos, centre = map(np.concatenate, zip(*out))
                yield pd.DataFrame({"h": h, "cls": cls, "n": n, "pos": pos, "centre": centre})

    return docs.where("doc_id is not null").select("text").mapInPandas(work, "h long, cls long, n int, pos int, centre float")


def _groups(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal keys."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    bounds = np.concatenate([[0], edges, [len(keys)]]).tolist()
    return zip(bounds[:-1], bounds[1:])


def _shared_buckets(prefixes: DataFrame, tasks: int) -> DataFrame:
    """The prefix rows whose bucket has two classes or more."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        h, cls = rows["h"].to_numpy(), rows["cls"].to_numpy()
        order = np.lexsort((cls, h))
        h, cls = h[order], cls[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
        order, h = order[fresh], h[fresh]
        alone = np.ones(len(h), bool)
        alone[1:] &= h[1:] != h[:-1]
        alone[:-1] &= h[1:] != h[:-1]
        yield rows.iloc[order[~alone]]

    return prefixes.repartition(tasks, "h").mapInPandas(work, prefixes.schema)


def _candidates(buckets: DataFrame, tasks: int, percent: int, stage: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of classes of different components that may link; see the head of the module. At the last
    stage all such pairs of a bucket, a row of the triangle at a time."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True).sort_values(["h", "centre", "cls"], ascending=[True, False, True])
        h, cls, n, pos, comp = (rows[c].to_numpy() for c in ("h", "cls", "n", "pos", "comp"))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        left, right, held = [], [], 0

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal held
            far = comp[i] != comp[j]
            i, j = i[far], j[far]
            fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            rest = np.minimum(n[i] - pos[i], n[j] - pos[j])  # n-grams from this one on
            fits &= rest >= overlap_needed(n[i], n[j], percent)
            i, j = i[fits], j[fits]
            left.append(np.minimum(cls[i], cls[j]))
            right.append(np.maximum(cls[i], cls[j]))
            held += len(i)

        def taken() -> pd.DataFrame:
            nonlocal held
            got = pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)}).drop_duplicates()
            left.clear()
            right.clear()
            held = 0
            return got

        for a, b in _groups(h):
            if (comp[a:b] == comp[a]).all():
                continue
            if b - a <= SMALL or stage == STAR_ROUNDS:
                for i in range(a, b - 1):
                    keep(np.full(b - i - 1, i), np.arange(i + 1, b))
                    if held > 500_000:
                        yield taken()
            else:
                # the stage-th most central class of each of the largest components
                firsts = a + np.unique(comp[a:b], return_index=True)[1]
                centre = (a + stage) if stage < 2 else firsts.max()
                for i in {a, int(centre)}:
                    keep(np.full(b - a, i), np.arange(a, b))
            if held > 500_000:
                yield taken()
        if left:
            yield taken()

    pairs = buckets.repartition(tasks, "h").mapInPandas(work, "a long, b long")
    return pairs.distinct()


def _class_sets(docs: DataFrame, ids: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(cls, grams, parts) of the classes of pairs, from their least document. Up to SENT classes their doc_ids go to the scan of
    the documents (16 bytes each); beyond that the documents are shuffled."""

    @F.pandas_udf("cls long, grams binary, parts binary")
    def sets(texts: pd.Series) -> pd.DataFrame:
        got = list(shingle_sets(list(texts), words))
        return pd.DataFrame({"cls": [class_of(g) for g in got], "grams": [g.tobytes() for g in got], "parts": [parts_of(g) for g in got]})

    sets = sets.asNondeterministic()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(ids, "cls")
    wanted = stored(wanted, "wanted")
    if wanted.count() <= SENT:
        wanted = F.broadcast(wanted)
    rows = docs.select("doc_id", "text").join(wanted, "doc_id")
    # rows of one doc_id may have several texts: only that of the class counts. As a function that isn't deterministic, sets
    # stays above the join; else the comparison would become a key of the join, and sets be taken of every document
    rows = rows.select("cls", sets("text").alias("s")).where("cls = s.cls").select("cls", "s.grams", "s.parts")
    return rows.dropDuplicates(["cls"])


def parts_of(grams: np.ndarray) -> bytes:
    """How many n-grams of a sorted set fall between each two of 257 even pivots; empty if a byte can't hold one of them."""
    counts = np.diff(np.searchsorted(grams, _FINE), prepend=0, append=len(grams))
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_link(x: list[bytes], y: list[bytes], n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Suffix filter: whether the parts of two sets of n and m n-grams allow the overlap that a link needs. Sets of a part with
    too many n-grams for a byte always may."""
    out = np.ones(len(n), bool)
    known = np.flatnonzero([len(a) > 0 and len(b) > 0 for a, b in zip(x, y)])
    if len(known):
        a, b = (np.frombuffer(b"".join(s[i] for i in known), np.uint8).reshape(-1, 256) for s in (x, y))
        out[known] = np.minimum(a, b).sum(axis=1, dtype=np.int64) >= overlap_needed(n[known], m[known], percent)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link. Whole sets only go to pairs that pass the suffix filter, which takes 256 bytes a set."""

    @F.pandas_udf(T.BooleanType())
    def may(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(may_link(list(x), list(y), n.to_numpy(np.int64), m.to_numpy(np.int64), percent))

    @F.pandas_udf(T.BooleanType())
    def links(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(left, right)], dtype=bool)

    size = (F.octet_length("grams") / 8).cast("int")
    one = sets.select(F.col("cls").alias("a"), F.col("parts").alias("x"), size.alias("n"))
    two = sets.select(F.col("cls").alias("b"), F.col("parts").alias("y"), size.alias("m"))
    close = stored(pairs.join(one, "a").join(two, "b").where(may("x", "y", "n", "m")).select("a", "b"), "close")
    one = sets.select(F.col("cls").alias("a"), F.col("grams").alias("x"))
    two = sets.select(F.col("cls").alias("b"), F.col("grams").alias("y"))
    return close.join(one, "a").join(two, "b").where(links("x", "y")).select("a", "b")


_FINE = np.arange(1, 256, dtype=np.uint64) << np.uint64(56)
_PIVOTS = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link; the parts between fixed pivots bound the overlap first."""
    need = int(overlap_needed(len(x), len(y), percent))
    parts = [np.diff(np.searchsorted(g, _PIVOTS), prepend=0, append=len(g)) for g in (x, y)]
    if np.minimum(*parts).sum() < need:
        return False
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= need


def ngram_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Features (doc_id, n, cls) of (doc_id, text), and labels (node, label) of classes by component."""
    spark = docs.sparkSession
    tasks = partitions(spark)
    features = stored(_features(docs, words), "features")
    levels = _sketch(features)
    features = features.where("chunk < 0").select("doc_id", "n", "cls")
    buckets = stored(_shared_buckets(_prefixes(docs, words, percent, levels), tasks), "buckets")
    ids = features.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    links = spark.createDataFrame([], "a long, b long")
    tried = links
    labels = spark.createDataFrame([], "node long, label long")
    for stage in range(STAR_ROUNDS + 1):
        placed = buckets.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        placed = placed.withColumn("comp", F.coalesce("label", "cls")).drop("label")
        pairs = _candidates(placed, tasks, percent, stage)
        pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            if stage == STAR_ROUNDS:
                break
            continue
        tried = tried.unionByName(pairs)
        sets = stored(_class_sets(docs, ids, pairs, words), "sets")
        found = stored(_verified(pairs, sets, percent), "links")
        dropped(sets)
        links = links.unionByName(found)
        if not found.isEmpty():
            labels = connected_components(links)
    dropped(buckets)
    return features, labels


def ngram_pairs(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Features (doc_id, n, cls) of (doc_id, text), and every link (a, b), a < b, between different classes.

    Each distinct candidate is verified, also where its ends are in one component already: a group of n different near copies
    costs n * (n - 1) / 2 of them. `ngram_components` doesn't pay for that."""
    tasks = partitions(docs.sparkSession)
    features = stored(_features(docs, words), "features")
    levels = _sketch(features)
    features = features.where("chunk < 0").select("doc_id", "n", "cls")
    buckets = stored(_shared_buckets(_prefixes(docs, words, percent, levels), tasks), "buckets")
    ids = features.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    pairs = stored(_candidates(buckets.withColumn("comp", F.col("cls")), tasks, percent, STAR_ROUNDS), "pairs")
    sets = stored(_class_sets(docs, ids, pairs, words), "sets")
    links = stored(_verified(pairs, sets, percent), "links")
    dropped(buckets, sets, pairs)
    return features, links


def link_counts(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_links) of each document of (doc_id, text): how many other documents it links with, equal ones included."""
    features, links = ngram_pairs(docs, words, percent)
    live = features.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.count("*").alias("size"))
    both = links.union(links.select("b", "a")).toDF("cls", "other")
    near = both.join(live.select(F.col("cls").alias("other"), "size"), "other").groupBy("cls").agg(F.sum("size").alias("near"))
    counts = live.join(near, "cls", "left").select("cls", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    counted = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("links")).otherwise(F.lit(0)).alias("n_links")
    return features.join(counts, "cls", "left").select("doc_id", counted)


def ngram_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document of (doc_id, text)."""
    features, labels = ngram_links(docs, words, percent)
    node = labels.select(F.col("node").alias("cls"), "label")
    ids = features.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    least = ids.join(node, "cls", "left").select("cls", "doc_id", F.coalesce("label", "cls").alias("label"))
    least = least.join(least.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("cls", "component_id")
    out = features.join(least, "cls", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
