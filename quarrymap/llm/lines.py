"""Line deduplication: lines near each other are one class, and a class keeps its first line.

Lines are compared without blanks at their ends; first means least doc_id (null first), then line number. One edit is allowed
in a line of `min_chars` code points or more, and none in a shorter one (numbers and headings differ in one): so these only
match lines equal to them. `min_chars` may be 1. Blank lines stay as they are.

With threshold 1 a line is split into two segments (halves). A line of length l puts its halves into an index under
(l, side, half); it probes the index of its own length with them and that of length l - 1 with the prefix and suffix of
the lengths of those halves: one of the two segments must be untouched, and beside it nothing is left to shift. Pairs that
meet are verified once with a bit-parallel edit distance in a band of threshold width, all pairs of a batch at a time.
A segment that more than `SMALL` lines share makes no pairs: what is left beside it, within one edit in turn, is split into
two segments again, up to `ROUNDS` times. Where many lines still share all but a little, that little is joined on what
remains after deleting one code point (or none), and lines that agree there are paired with the least one that is within one
edit of all of them. These pairs are verified like all others. This is exact and grows with the length of those lines, not with
the square of their number. However often a line occurs, it is indexed once.

Components of the links are the classes. Rows equal in doc_id and text count as one document and get the same result.
A null text stays null with 0 lines; the empty text is one blank line; a line of any length is compared whole. Other columns
are not returned by dedup_lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymap.llm.common import connected_components, partitions, spare, stored

MIN_CHARS, SMALL, ROUNDS = 20, 16, 5


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, no, line, k1, k2, size): each line without blanks at its ends, under a key of 128 bits."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    rows = rows.withColumn("line", F.trim(F.col("line"))).where("line != ''")
    return rows.select(
        "doc_id", "doc", "no", "line", F.xxhash64("line").alias("k1"), F.xxhash64(F.reverse("line")).alias("k2"), F.length("line").alias("size")
    )


def _distinct(lines: DataFrame) -> DataFrame:
    """(k1, k2, first, size, hs) of the different lines: the place where each stands first and the hashes of its index entries."""
    half, less = "cast(size div 2 as int)", "cast((size - 1) div 2 as int)"
    hashes = (
        f"array(xxhash64(size, 0, substring(line, 1, {half})), xxhash64(size, 1, substring(line, {half} + 1)), "
        f"xxhash64(size - 1, 0, substring(line, 1, {less})), xxhash64(size - 1, 1, substring(line, {less} + 2)))"
    )
    rows = lines.select("k1", "k2", F.struct("doc_id", "doc", "no").alias("first"), "size", F.expr(hashes).alias("hs"))
    return rows.groupBy("k1", "k2").agg(F.min("first").alias("first"), F.first("size").alias("size"), F.first("hs").alias("hs"))


def _entries(distinct: DataFrame, min_chars: int) -> DataFrame:
    """(h, probe, k1, k2): index entries of each line, and its probes of the lines that are one shorter."""
    long = distinct.where(F.col("size") >= min_chars).select("k1", "k2", F.posexplode("hs").alias("i", "h"))
    return long.select("h", (F.col("i") >= 2).alias("probe"), "k1", "k2")


def _meetings(entries: DataFrame, tasks: int) -> DataFrame:
    """Rows (a1, a2, b1, b2) of small buckets, both lines of a candidate pair; of large ones (h, probe, a1, a2) and, if the
    entries have them, the bounds lo and hi of what is still to be compared."""
    bounds = [c for c in ("lo", "hi") if c in entries.columns]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        h, probe, k1, k2 = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("h", "probe", "k1", "k2"))
        order = np.lexsort((k2, k1, probe, h))
        h, probe, k1, k2 = h[order], probe[order], k1[order], k2[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (probe[1:] != probe[:-1])
        h, probe, k1, k2 = h[fresh], probe[fresh], k1[fresh], k2[fresh]
        kept = {c: np.concatenate([p[c].to_numpy() for p in parts])[order][fresh] for c in bounds}
        edges = np.flatnonzero(np.diff(h)) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(h)]])
        some = (ends - starts > 1) & ~probe[starts]
        left, right, hot = [], [], []
        for a, b in zip(starts[some].tolist(), ends[some].tolist()):
            inner = b - int(probe[a:b].sum())
            if b - a > SMALL:
                hot.append(np.arange(a, b))
                continue
            for i in range(a, inner):
                left.append(np.full(b - i - 1, i))
                right.append(np.arange(i + 1, b))
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            swap = (k1[i] > k1[j]) | ((k1[i] == k1[j]) & (k2[i] > k2[j]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            got = pd.DataFrame({"a1": k1[i], "a2": k2[i], "b1": k1[j], "b2": k2[j]}).drop_duplicates()
            yield got.reindex(columns=names).astype({c: "Int64" for c in ("h", *bounds)}).astype({"probe": "boolean"})
        if hot:
            i = np.concatenate(hot)
            got = pd.DataFrame({"h": h[i], "probe": probe[i], "a1": k1[i], "a2": k2[i], **{c: kept[c][i] for c in bounds}})
            yield got.reindex(columns=names).astype({"b1": "Int64", "b2": "Int64"})

    names = ["h", "probe", "a1", "a2", "b1", "b2", *bounds]
    schema = "h long, probe boolean, a1 long, a2 long, b1 long, b2 long" + "".join(f", {c} int" for c in bounds)
    return entries.repartition(tasks, "h").mapInPandas(work, schema)


def edit_distances(left: list[str], right: list[str], band: int = 1) -> np.ndarray:
    """The edit distance of each pair up to band, band + 1 beyond it. A bit vector holds the diagonal band of a pair
    (vertical differences, as in the banded form of the bit-parallel algorithm of Myers and Hyyro, with the lowest row of
    the band in the highest bit); all pairs advance together, one column at a time."""
    out = np.full(len(left), band + 1)
    sizes = [(len(x), len(y)) for x, y in zip(left, right)]
    live = sorted((i for i, (n, m) in enumerate(sizes) if abs(n - m) <= band and n > band), key=lambda i: -sizes[i][1])
    for i, (n, m) in enumerate(sizes):
        if n <= band and abs(n - m) <= band:
            out[i] = min(band + 1, _plain_distance(left[i], right[i]))
    # pairs of like length together, so that a long line doesn't widen the arrays of many short ones
    for at in range(0, len(live), 4096):
        part = live[at : at + 4096]
        out[part] = _banded([left[i] for i in part], [right[i] for i in part], band)
    return out


def _plain_distance(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def _codes(texts: list[str], before: int, after: int) -> np.ndarray:
    out = np.zeros((len(texts), max(map(len, texts)) + before + after), np.uint32)
    for r, t in enumerate(texts):
        out[r, before : before + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    return out


def _banded(left: list[str], right: list[str], band: int) -> np.ndarray:
    """Pairs in the order of falling length of the right text."""
    n, m = np.array([len(x) for x in left]), np.array([len(y) for y in right])
    x, y = _codes(left, band, 3 * band + 1), _codes(right, 0, 0)
    one, high = np.uint64(1), np.uint64(1 << 63)
    vp = np.full(len(n), ((1 << 64) - 1) << (63 - band) & ((1 << 64) - 1), np.uint64)
    vn = np.zeros(len(n), np.uint64)
    mask = np.full(len(n), 1 << 62, np.uint64)
    score = np.full(len(n), band)
    for j in range(int(m[0])):
        k = int(np.searchsorted(-m, -j, "left"))  # the pairs that have a column j
        p, q, match = vp[:k], vn[:k], np.zeros(k, np.uint64)
        for d in range(2 * band + 1):
            same = (x[:k, j + d] == y[:k, j]).astype(np.uint64)
            match |= same << np.uint64(63 - 2 * band + d)
        d0 = (((match & p) + p) ^ p) | match | q
        hp, hn = q | ~(d0 | p), d0 & p
        down = j < n[:k] - band  # the lowest row of the band is still within the left text
        flat = ((hp & mask[:k]) > 0).astype(np.int64) - ((hn & mask[:k]) > 0)
        score[:k] += np.where(down, (d0 & high) == 0, flat)
        mask[:k] = np.where(down, mask[:k], mask[:k] >> one)
        x0 = d0 >> one
        vp[:k], vn[:k] = hn | ~(x0 | hp), x0 & hp
    return np.minimum(score, band + 1)


def _halves(hot: DataFrame) -> DataFrame:
    """Entries of (h, probe, k1, k2, lo, hi, line) for the next round: what is left to compare is split as the line was."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for rows in batches:
            out = []
            for h, probe, k1, k2, lo, hi, line in zip(*(rows[c] for c in ("h", "probe", "k1", "k2", "lo", "hi", "line"))):
                half, more = (hi - lo - probe) // 2, int(probe)
                for side, a, b in ((0, lo, lo + half), (1, lo + half + more, hi)):
                    key = xxhash.xxh64_intdigest(line[a:b].encode("utf-8", "surrogatepass"), xxhash.xxh64_intdigest(f"{h} {side}"))
                    left = (b, hi) if side == 0 else (lo, a)
                    out.append((key - (1 << 64) if key >> 63 else key, probe, k1, k2, *left))
            yield pd.DataFrame(out, columns=["h", "probe", "k1", "k2", "lo", "hi"])

    return hot.mapInPandas(work, "h long, probe boolean, k1 long, k2 long, lo int, hi int")


def _deletions(hot: DataFrame) -> DataFrame:
    """(h, variant, sure, k1, k2) of (h, probe, k1, k2, lo, hi, line): hashes of what each hot line leaves beside the shared
    parts. Lines that agree in h and variant are tied if one of them is sure: two lines that lose a code point to become the
    same one are so only if that one is there."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for h, probe, k1, k2, lo, hi, line in zip(*(rows[c] for c in ("h", "probe", "k1", "k2", "lo", "hi", "line"))):
                v = _variants(line[lo:hi], bool(probe))
                out.append(pd.DataFrame({"h": h, "variant": v, "sure": not probe, "k1": k1, "k2": k2}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return hot.mapInPandas(work, "h long, variant long, sure boolean, k1 long, k2 long")


def _variants(text: str, longer: bool) -> np.ndarray:
    """Of a line that is one longer: the text without each one of its code points. Of others: the text itself, and the
    text without each one together with the place, for a substitution there."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    up = np.full(len(c) + 1, 0x9E3779B97F4A7C15, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * up[:-1], dtype=np.uint64)])
    without = sums[:-1] + (sums[-1] - sums[1:]) * down
    if longer:
        return np.unique(_mix(without)).astype(np.int64)
    places = _mix(without) ^ _mix(np.arange(len(c), dtype=np.uint64) + np.uint64(7))
    return np.concatenate([_mix(sums[-1:]), places]).astype(np.int64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _near_links(lines: DataFrame, distinct: DataFrame, min_chars: int) -> DataFrame:
    """Links (a, b) of different lines within one edit, each line as a struct of its key; enough of them to connect all
    that are connected by single edits."""
    spark = lines.sparkSession
    met = stored(_meetings(_entries(distinct, min_chars), partitions(spark)), "meetings")
    pairs = met.where("b1 is not null").select("a1", "a2", "b1", "b2").distinct()
    hot = met.where("b1 is null").select("h", "probe", F.col("a1").alias("k1"), F.col("a2").alias("k2"))
    wanted = pairs.select(F.explode(F.expr("array(struct(a1 as k1, a2 as k2), struct(b1 as k1, b2 as k2))")).alias("k"))
    wanted = wanted.select("k.k1", "k.k2").unionByName(hot.select("k1", "k2")).distinct()
    # the few lines that meet others, with their texts, from the one place where each stands first
    places = distinct.join(wanted, ["k1", "k2"], "left_semi").select("k1", "k2", "first.doc", "first.no")
    texts = lines.select("doc", "no", "line").join(places.hint("shuffle_hash"), ["doc", "no"])
    texts = stored(texts.select("k1", "k2", "line").dropDuplicates(["k1", "k2"]), "lines")

    @F.pandas_udf(T.BooleanType())
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(edit_distances(list(x), list(y)) <= 1)

    hot = hot.join(texts, ["k1", "k2"])
    size = "(length(line) - int(probe))"
    half = f"cast({size} div 2 as int)"
    front = F.col("h") == F.expr(f"xxhash64({size}, 0, substring(line, 1, {half}))")
    hot = hot.withColumn("lo", F.when(front, F.expr(half)).otherwise(0))
    hot = hot.withColumn("hi", F.when(front, F.length("line")).otherwise(F.expr(f"{half} + int(probe)")))
    hot = stored(hot, "hot")
    for _ in range(ROUNDS):  # split what is left until few lines share it
        if hot.isEmpty():
            break
        met = stored(_meetings(_halves(hot), partitions(spark)), "meetings")
        pairs = pairs.unionByName(met.where("b1 is not null").select("a1", "a2", "b1", "b2"))
        hot = met.where("b1 is null").select("h", "probe", F.col("a1").alias("k1"), F.col("a2").alias("k2"), "lo", "hi")
        hot = stored(hot.join(texts, ["k1", "k2"]), "hot")
    variants = _deletions(hot)
    key = F.struct("k1", "k2")
    least = variants.groupBy("h", "variant").agg(F.min(key).alias("m"), F.max(key).alias("z"), F.min(F.when(F.col("sure"), key)).alias("a"))
    least = least.where("a is not null and m != z").select("h", "variant", "a")
    tied = variants.join(least, ["h", "variant"]).where(F.col("a") != key)
    swapped = F.col("a") > key
    low, high = F.when(swapped, key).otherwise(F.col("a")), F.when(swapped, F.col("a")).otherwise(key)
    tied = tied.select(low.alias("x"), high.alias("y")).select(F.col("x.k1").alias("a1"), F.col("x.k2").alias("a2"), F.col("y.k1").alias("b1"), F.col("y.k2").alias("b2"))
    pairs = pairs.unionByName(tied).distinct()
    one, two = (texts.select(F.col("k1").alias(f"{s}1"), F.col("k2").alias(f"{s}2"), F.col("line").alias(f"{s}_line")) for s in "ab")
    links = pairs.join(one, ["a1", "a2"]).join(two, ["b1", "b2"]).where(near("a_line", "b_line"))
    return links.select(F.struct(F.col("a1").alias("k1"), F.col("a2").alias("k2")).alias("a"), F.struct(F.col("b1").alias("k1"), F.col("b2").alias("k2")).alias("b"))


def line_classes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, no, near) of the first line of each class of (doc_id, text); near: how many different lines it has besides."""
    lines = _lines(docs)
    distinct = stored(_distinct(lines), "distinct")
    links = stored(_near_links(lines, distinct, min_chars), "near")
    firsts = distinct.select("k1", "k2", "first")
    if links.isEmpty():
        return firsts.select("first.doc", "first.no", F.lit(0).alias("near"))
    labels = connected_components(links).select("node.k1", "node.k2", F.col("label.k1").alias("c1"), F.col("label.k2").alias("c2"))
    firsts = firsts.join(labels, ["k1", "k2"], "left")
    firsts = firsts.withColumn("c1", F.coalesce("c1", "k1")).withColumn("c2", F.coalesce("c2", "k2"))
    firsts = firsts.groupBy("c1", "c2").agg(F.min("first").alias("first"), (F.count("*") - 1).cast("int").alias("near"))
    return firsts.select("first.doc", "first.no", "near")


@F.pandas_udf(T.StringType())
def _kept_text(texts: pd.Series, keep: pd.Series) -> pd.Series:
    def kept(text: str, numbers: list[int] | None) -> str:
        some = set(() if numbers is None else numbers)
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i in some or not x.strip(" "))

    return pd.Series([None if t is None else kept(t, k) for t, k in zip(texts, keep)], dtype=object)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_kept, n_near, text) of (doc_id, text): lines that are not blank, those that stay, those of them
    that stand for others near them, and the text of what stays."""
    docs = docs.select("doc_id", "text")
    keep = line_classes(docs, min_chars).groupBy("doc").agg(
        F.collect_list("no").alias("keep"), F.sum((F.col("near") > 0).cast("long")).alias("n_near")
    )
    out = docs.withColumn("doc", F.xxhash64("doc_id", "text")).join(keep, "doc", "left")
    filled = F.coalesce(F.regexp_count("text", F.lit(r"(?md)^ *[^ \n]")), F.lit(0)).cast("long")
    return out.select(
        "doc_id", filled.alias("n_lines"), F.when(F.size("keep") > 0, F.size("keep")).otherwise(0).cast("long").alias("n_kept"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), _kept_text("text", "keep").alias("text"),
    )


def with_lines_dropped(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the lines that stay in text (n_chars, if there, follows). Documents of which no line stays go, unless
    they had none; all other columns stay as they are."""
    doc, kept = spare("doc", docs.columns), spare("keep", docs.columns)
    keep = line_classes(docs.select("doc_id", "text"), min_chars)
    keep = keep.groupBy(F.col("doc").alias(doc)).agg(F.collect_list("no").alias(kept))
    out = docs.withColumn(doc, F.xxhash64("doc_id", "text")).join(keep, doc, "left")
    out = out.where(F.col(kept).isNotNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^ \n]"))
    out = out.withColumn("text", _kept_text("text", kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
