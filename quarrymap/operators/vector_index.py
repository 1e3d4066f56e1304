"""A stored index of vectors by coarse cells: a search reads the cells that matter and ranks what is in them exactly.

Cells are the places nearest to centroids, which are fitted on a bounded sample of the vectors (SAMPLE, the first by a hash of their ids); every
vector is put into a cell, and a cell remembers how far its farthest vector is from the centroid. On the same sample it is measured how many of the nearest
cells hold RECALL of the true neighbours of QUERIES of its vectors, and that number is kept. A search looks into so many cells (or `probes`); an
exact one then also into all cells that could hold something as near as what was found, by the triangle inequality. Cells are folders, so
that a search of a few cells reads these alone; a cell of any size is written in as many files as its bytes need.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymap.operators.retrieval import distance
from quarrymap.storage import stored

SAMPLE, MOST_CELLS, FIT_ROUNDS = 20_000, 4096, 8
RECALL, QUERIES, NEAR = 0.97, 200, 10
#: Distances are rounded to four places; what could tie after that is looked at too.
MARGIN = 1e-4
#: So many vectors of a cell and so many queries meet in one task at most, and it looks at no more than AT_ONCE of their pairs at once.
PIECE, AT_ONCE = 4096, 1 << 18


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell, apart = np.zeros(len(x), np.int32), np.zeros(len(x))
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        squares = (part * part).sum(axis=1)[:, None] - 2 * part @ centroids.T + (centroids * centroids).sum(axis=1)
        cell[at : at + 1024] = squares.argmin(axis=1)
        apart[at : at + 1024] = np.sqrt(((part - centroids[cell[at : at + 1024]]) ** 2).sum(axis=1))
    return cell, apart


def _fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    centroids = sample[:cells].copy()
    for _ in range(FIT_ROUNDS):
        cell, _ = _nearest(sample, centroids)
        sums, n = np.zeros_like(centroids), np.bincount(cell, minlength=len(centroids))
        np.add.at(sums, cell, sample)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def _probes(sample: np.ndarray, centroids: np.ndarray) -> int:
    """How many cells a search has to look into to find RECALL of the NEAR nearest of each of QUERIES vectors of the sample."""
    if len(sample) < 2:
        return 1
    squares = lambda a, b: (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)
    asked = sample[:QUERIES]
    away = squares(asked, sample)
    away[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(away, axis=1)[:, :NEAR]
    cell, _ = _nearest(sample, centroids)
    place = np.argsort(np.argsort(squares(asked, centroids), axis=1, kind="stable"), axis=1)
    return int(np.quantile(np.take_along_axis(place, cell[near], axis=1), RECALL, method="higher")) + 1


def _rounded(x: np.ndarray) -> np.ndarray:
    """To four places, halves up, as Spark rounds."""
    y = x * 1e4
    out = np.floor(y + 0.5) / 1e4
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-5):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.0001"), ROUND_HALF_UP))
    return out


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _best(asked: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """(query, id, distance) of the k nearest of rows (id, vector) to each of asked (query, q, worst), none farther than its worst. A product of
    matrices says which could be among them; these alone are measured term by term, as `distance` does."""
    queries, ids = asked["query"].to_numpy(), rows["id"].to_numpy()
    q, x, worst = _matrix(asked["q"]), _matrix(rows["vector"]), asked["worst"].to_numpy()
    code = {v: i for i, v in enumerate(sorted(set(ids)))}  # places of ids in order
    place, own = np.array([code[v] for v in ids]), np.array([code.get(v, -1) for v in queries])
    found = []
    step = max(1, AT_ONCE // len(x))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        away = np.sqrt(np.maximum(0, (part * part).sum(axis=1)[:, None] - 2 * part @ x.T + (x * x).sum(axis=1)))
        away[own[at : at + step, None] == place] = np.inf
        most = worst[at : at + step]
        if len(x) > k:
            most = np.minimum(most, np.partition(away, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero((away <= most[:, None] + 2 * MARGIN) & np.isfinite(away))
        squares = np.zeros(len(i))
        for d in range(q.shape[1]):
            squares += (x[j, d] - part[i, d]) ** 2
        far = _rounded(np.sqrt(squares))
        order = np.lexsort((place[j], far, i))
        i, j, far = i[order], j[order], far[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((at + i[kept], j[kept], far[kept]))
    i, j, far = (np.concatenate(a) for a in zip(*found, strict=True))
    return pa.table({"query": asked["query"].take(pa.array(i)), "id": rows["id"].take(pa.array(j)), "distance": far})


def write_cells(vectors: DataFrame, folder: str, cells: int | None = None) -> None:
    """Index vectors (id, vector) of one length under a folder: `vectors` by cell, and `cells` (cell, n, radius, centroid, probes). Null vectors are left
    out."""
    spark = vectors.sparkSession
    vectors = stored(vectors.where("vector is not null").select("id", "vector"), "vectors")
    cells = cells or max(1, min(MOST_CELLS, int(vectors.count() ** 0.5)))
    sample = vectors.orderBy(F.xxhash64("id"), "id").select("vector").limit(min(SAMPLE, 64 * cells)).collect()
    sample = np.array([r.vector for r in sample], np.float64)
    centroids = _fitted(sample, cells) if len(sample) else np.zeros((0, 0))
    probes = _probes(sample, centroids) if len(sample) else 1

    @F.pandas_udf("cell int, apart double")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch.to_numpy()).astype(np.float64) if len(batch) else np.zeros((0, centroids.shape[1]))
            cell, apart = _nearest(x, centroids)
            yield pd.DataFrame({"cell": cell, "apart": apart})

    rows = vectors.withColumn("p", placed("vector")).select("id", "vector", F.col("p.apart").alias("apart"), F.col("p.cell").alias("cell"))
    rows.limit(0).write.mode("overwrite").parquet(f"{folder}/empty")  # for the types, where there is no row
    rows.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors")
    schema = rows.schema
    known = spark.read.schema(schema).parquet(f"{folder}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius"))
    places = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    known.join(places, "cell").withColumn("probes", F.lit(probes)).write.mode("overwrite").parquet(f"{folder}/cells")


def _cells(spark: SparkSession, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cell, radius, centroid) of the cells that hold anything, MOST_CELLS at most, and how many to look into."""
    rows = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()
    return np.array([r.cell for r in rows], np.int32), np.array([r.radius for r in rows]), np.array([r.centroid for r in rows], np.float64), max([r.probes for r in rows], default=1)


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/empty").schema
    return spark.read.schema(schema).parquet(f"{folder}/vectors").select("id", "vector", "cell")


def search(spark: SparkSession, folder: str, vector: list[float], k: int, exact: bool = True, probes: int | None = None) -> DataFrame:
    """(id, distance) of the k nearest to one vector, by distance and id. The folders of other cells are not read."""
    cell, radius, centroid, usual = _cells(spark, folder)
    probes = probes or usual
    rows = _vectors(spark, folder)
    if not len(cell):
        return rows.select("id", F.lit(0.0).alias("distance")).limit(0)
    away = np.sqrt(((centroid - np.array(vector)) ** 2).sum(axis=1))
    first = away.argsort(kind="stable")[:probes]
    q = F.array(*[F.lit(float(x)) for x in vector])

    def best(cells: np.ndarray) -> DataFrame:
        some = rows.where(F.col("cell").isin([int(c) for c in cells])).withColumn("q", q)
        return some.select("id", F.round(distance("vector", "q"), 4).alias("distance")).orderBy("distance", "id").limit(k)

    found = stored(best(cell[first]), "found")
    if not exact:
        return found.orderBy("distance", "id")
    n, worst = found.agg(F.count("*"), F.max("distance")).first()
    could = away - radius <= (worst + MARGIN if n >= k else np.inf)
    could[first] = False
    if not could.any():
        return found.orderBy("distance", "id")
    return found.unionByName(best(cell[could])).orderBy("distance", "id").limit(k)


def neighbours(spark: SparkSession, folder: str, queries: DataFrame, k: int, exact: bool = True, probes: int | None = None) -> DataFrame:
    """(query, id, distance, rank) of the k nearest other vectors of each of queries (id, vector), as one meeting by cell, or two if exact. Cells and
    queries are cut into pieces that a task can hold, and each pair of pieces gives k rows a query at most."""
    cell, radius, centroid, usual = _cells(spark, folder)
    probes = probes or usual
    queries = stored(queries.where("vector is not null").select(F.col("id").alias("query"), F.col("vector").alias("q"), F.lit(float("inf")).alias("worst")), "queries")
    parts = -(-queries.count() // PIECE)
    known = spark.read.parquet(f"{folder}/cells").select("cell", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces"))
    rows = _vectors(spark, folder).join(F.broadcast(known), "cell")  # a row for each cell, MOST_CELLS at most
    rows = rows.select("id", "vector", "cell", F.pmod(F.xxhash64("id"), "pieces").cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1))).alias("part"))
    key, q_type = (dict(queries.dtypes)[c] for c in ("query", "q"))

    def visits(second: bool):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step = max(1, 65_536 // max(1, len(cell)))  # what is sent on at once has so many rows at most
            for whole in batches:
                for i in range(0, len(whole) if len(cell) else 0, step):
                    batch = whole.iloc[i : i + step]
                    x = np.stack(batch.q.to_numpy()).astype(np.float64)
                    away = np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ centroid.T + (centroid * centroid).sum(axis=1)))
                    first = np.zeros(away.shape, bool)
                    np.put_along_axis(first, away.argsort(axis=1, kind="stable")[:, :probes], True, axis=1)
                    worst = batch.worst.to_numpy()
                    # MARGIN is wider than what rounding does to the distances
                    some = ~first & (away - radius - MARGIN <= worst[:, None] + MARGIN) if second else first
                    at, which = np.nonzero(some)
                    yield pd.DataFrame({"query": batch["query"].to_numpy()[at], "q": batch.q.to_numpy()[at], "worst": worst[at], "cell": cell[which]})

        return work

    w = Window.partitionBy("query").orderBy("distance", "id")
    meeting = ["cell", "piece", "part"]

    def best(asked: pa.Table, some: pa.Table) -> pa.Table:
        return _best(asked, some.select(["id", "vector"]), k) if len(asked) and len(some) else pa.table({"query": asked["query"].slice(0, 0), "id": some["id"].slice(0, 0), "distance": pa.array([], pa.float64())})

    def met(asked: DataFrame, second: bool) -> DataFrame:
        asked = asked.mapInPandas(visits(second), f"query {key}, q {q_type}, worst double, cell int").join(F.broadcast(known), "cell")
        piece = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")
        asked = asked.select("query", "q", "worst", "cell", piece, F.pmod(F.xxhash64("query"), F.lit(max(parts, 1))).cast("int").alias("part"))
        pairs = asked.groupBy(*meeting).cogroup(rows.groupBy(*meeting)).applyInArrow(best, f"query {key}, id {dict(rows.dtypes)['id']}, distance double")
        return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    found = stored(met(queries, False), "found")
    if not exact:
        return found
    worst = found.groupBy("query").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("worst"))
    again = queries.drop("worst").join(worst, "query", "left").select("query", "q", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
    both = found.drop("rank").unionByName(met(again, True).drop("rank"))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
