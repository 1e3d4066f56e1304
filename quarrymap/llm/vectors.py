"""Vector code compression: product codes with integer codebooks, each searched through a kd-tree.

A component x becomes the integer floor(1024 * x); vectors are cut into equal consecutive parts, and each part position has a
codebook. It starts as that part of the first vectors (by vec_id, null last, then by the vector) and is updated for a number of
rounds. In each round the driver builds a kd-tree of every codebook and broadcasts the trees (parts x entries x width integers,
whatever the number of rows). Tasks find the nearest entry of each part by branch and bound: a subtree is left out only if its
box is farther than the best so far, so that a box at an equal distance is still looked into and the lower index wins a tie.
A task adds up the parts of an entry and their number as integers; the sums of all tasks are added by Spark, and each entry becomes
their componentwise floor(sum / count). Entries that nothing is nearest to stay.

Left out are vectors that are null or empty, that hold a null or a component that isn't finite, whose length can't be cut into
equal parts, or whose length isn't that of the first vector. A component of 2^17 or more in size stops the job, since squared
distances would no longer be exact. Null vec_ids are coded like others. Rows that are repeated are coded and counted each. An
empty table gives an empty one. Other columns are kept, but for those called like new ones: they are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymap.llm.common import spare, stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LEAF, BOUND = 16, 2**17
#: Up to this size of a component, distances are sums of products that doubles hold exactly (for parts of up to 2^10 components).
SMALL = 2**20


@dataclass
class Node:
    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None = None
    axis: int = 0
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def grow(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The kd-tree of a codebook (entries x width): halves along the widest side of the box; leaves list entries in order."""
    entries = np.arange(len(book)) if entries is None else entries
    inside = book[entries]
    node = Node(inside.min(axis=0), inside.max(axis=0))
    node.axis = int((node.high - node.low).argmax())
    if len(entries) <= LEAF or node.high[node.axis] == node.low[node.axis]:
        node.entries = entries
        return node
    values = inside[:, node.axis]
    node.cut = int(np.sort(values)[len(values) // 2])
    below = values < node.cut
    if not below.any():  # more than half share the least value
        node.cut = int(values[values > node.cut].min())
        below = values < node.cut
    node.left, node.right = grow(book, entries[below]), grow(book, entries[~below])
    return node


def nearest(tree: Node, book: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each point; of entries at the same distance the lower one."""
    best, found = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(book), np.int64)
    exact = max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)) > SMALL or book.shape[1] > 2**10
    floats, squares = points.astype(np.float64), None
    if not exact:
        squares = (floats * floats).sum(axis=1)

    def leaf(node: Node, rows: np.ndarray) -> None:
        some = book[node.entries]
        if exact:
            away = np.stack([((points[rows] - entry) ** 2).sum(axis=1) for entry in some], axis=1)
        else:
            some = some.astype(np.float64)
            away = squares[rows, None] - 2 * (floats[rows] @ some.T) + (some * some).sum(axis=1)
        at = away.argmin(axis=1)
        least, entry = away[np.arange(len(rows)), at].astype(np.int64), node.entries[at]
        better = (least < best[rows]) | ((least == best[rows]) & (entry < found[rows]))
        best[rows[better]], found[rows[better]] = least[better], entry[better]

    def visit(node: Node, rows: np.ndarray) -> None:
        x = points[rows]
        gap = np.maximum(np.maximum(node.low - x, x - node.high), 0)
        rows = rows[(gap * gap).sum(axis=1) <= best[rows]]
        if not len(rows):
            return
        if node.entries is not None:
            return leaf(node, rows)
        below = points[rows, node.axis] < node.cut
        near, far = rows[below], rows[~below]
        for child, some in ((node.left, near), (node.right, far), (node.right, near), (node.left, far)):
            if len(some):
                visit(child, some)

    visit(tree, np.arange(len(points)))
    return found, best


@dataclass
class Codebooks:
    """books[p] has the entries of part p, one a row."""

    books: list[np.ndarray]

    def digest(self) -> str:
        """sha256 of all integers by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()

    def trees(self) -> list[tuple[np.ndarray, Node]]:
        return [(book, grow(book)) for book in self.books]


def whole(vectors: DataFrame, vector: str, out: str, parts: int) -> DataFrame:
    """The rows with a usable vector, and its integers."""
    v = F.col(vector)
    usable = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    too_large = F.raise_error(F.lit(f"a component of {BOUND} or more in size"))
    one = lambda x: F.when(F.abs(x) < BOUND, F.floor(x.cast("double") * SCALE)).otherwise(too_large).cast("int")
    return vectors.where(usable).where(finite).withColumn(out, F.transform(v, one))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _sums(kept: DataFrame, column: str, trees, entries: int, width: int) -> DataFrame:
    """(part, entry, place, total, n): the sums over all parts that are nearest to an entry."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = trees.value
        totals, counts = np.zeros((len(known), entries, width), np.int64), np.zeros((len(known), entries), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            for p, (book, tree) in enumerate(known):
                part = x[:, p * width : (p + 1) * width]
                entry, _ = nearest(tree, book, part)
                order = np.argsort(entry, kind="stable")
                some, starts, n = np.unique(entry[order], return_index=True, return_counts=True)
                totals[p, some] += np.add.reduceat(part[order], starts, axis=0)
                counts[p, some] += n
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "part": np.repeat(part, width).astype(np.int32), "entry": np.repeat(entry, width).astype(np.int32),
            "place": np.tile(np.arange(width, dtype=np.int32), len(part)), "total": totals[part, entry].ravel(),
            "n": np.repeat(counts[part, entry], width),
        })

    sums = kept.select(column).mapInArrow(work, "part int, entry int, place int, total long, n long")
    return sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def train(kept: DataFrame, key: str, column: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of integer vectors of one length. What comes to the driver are the first `entries` vectors and one sum a component of
    an entry: their number depends on the parameters and the length of a vector alone."""
    spark = kept.sparkSession
    first = kept.orderBy(F.col(key).asc_nulls_last(), column).select(column).limit(entries).collect()
    start = np.array([r[0] for r in first], np.int64)
    width = start.shape[1] // parts
    books = Codebooks([start[:, p * width : (p + 1) * width].copy() for p in range(parts)])
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast(books.trees())
        for r in _sums(kept, column, trees, len(first), width).collect():
            books.books[r.part][r.entry, r.place] = r.total // r.n
        trees.destroy()
    return books


def encode(kept: DataFrame, column: str, books: Codebooks, code: str = "code", error: str = "error") -> DataFrame:
    """kept with the code of each integer vector (two hex digits a part) and the sum of the squared distances of its parts."""
    trees, width = books.trees(), books.books[0].shape[1]  # a few entries: sent with the tasks

    @F.pandas_udf("code string, error long")
    def coded(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()).astype(np.int64) if len(vectors) else np.zeros((0, width * len(trees)), np.int64)
        found = [nearest(tree, book, x[:, p * width : (p + 1) * width]) for p, (book, tree) in enumerate(trees)]
        digits = [np.char.mod("%02x", entry) for entry, _ in found]
        text = digits[0].astype(object)
        for d in digits[1:]:
            text = text + d.astype(object)
        return pd.DataFrame({"code": text, "error": np.sum([away for _, away in found], axis=0, dtype=np.int64)})

    both = spare("coded", kept.columns)
    out = kept.withColumn(both, coded(column))
    return out.withColumn(code, F.col(f"{both}.code")).withColumn(error, F.col(f"{both}.error")).drop(both)


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """The usable rows with `code` and `error` in place of the vector, and the codebooks they were coded with."""
    if entries > 256:
        raise ValueError("two hex digits tell 256 entries")
    ints = spare("integers", vectors.columns)
    kept = stored(whole(vectors, vector, ints, parts).drop(vector), "integers")
    first = kept.orderBy(F.col(key).asc_nulls_last(), ints).select(F.size(ints)).first()
    if first is None:
        return kept.drop(ints).withColumn("code", F.lit("")).withColumn("error", F.lit(0).cast("long")), Codebooks([])
    kept = kept.where(F.size(ints) == first[0])
    books = train(kept, key, ints, parts, entries, rounds)
    return encode(kept, ints, books).drop(ints), books


def with_group_error(coded: DataFrame, group: str, out: str) -> DataFrame:
    """coded with the sum of `error` over rows of equal group, nulls together. One sum a group is joined back, so that no group is
    gathered; the coded rows are written down first, since they are read twice."""
    coded = stored(coded, "coded")
    g = spare("group", coded.columns)
    sums = stored(coded.groupBy(F.col(group).alias(g)).agg(F.sum("error").alias(out)), "group-errors")
    return coded.drop(out).join(sums, F.col(group).eqNullSafe(F.col(g)), "left").drop(g)
