"""A lexical index that is refreshed in place: segments of postings, tombstones, and a manifest that says which of them make the index.

A refresh writes one segment with the chunks of the paths that changed, and those paths (with the ones that are gone) as tombstones: what earlier
segments have of them doesn't count any more. Statistics are carried on by what was taken away and what was added, so nothing else is read.
A merge writes what is live into one segment. Each step ends by putting a new manifest in place of the old one, in one rename.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.operators import publish
from quarrymap.operators import retrieval as r
from quarrymap.storage import delete_folder, stored

POSTINGS = "term string, chunk_id string, path string, tf int, len int, bucket int"


def _write(root: str, name: str, postings: DataFrame, sizes: DataFrame, gone: DataFrame) -> None:
    r.write_postings(postings.select("term", "chunk_id", "path", "tf", "len", "bucket"), f"{root}/{name}/postings")
    sizes.write.parquet(f"{root}/{name}/chunks")
    gone.write.parquet(f"{root}/{name}/gone")


def _publish(spark: SparkSession, root: str, segments: list[str], n: int, total: int) -> dict:
    told = {"segments": segments, "chunks": n, "terms": total}
    publish._replace(spark, f"{root}/manifest.json", json.dumps(told, sort_keys=True) + "\n")
    return told


def _sizes(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "path", r.term_count(r.search_text()).cast("int").alias("len"))


def _totals(sizes: DataFrame) -> tuple[int, int]:
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    return int(n), int(total)


def _live(spark: SparkSession, root: str, segments: list[str], what: str, where=None) -> DataFrame:
    """Rows of all segments but for paths that a later one buries."""
    rows, graves = None, None
    for i, name in enumerate(segments):
        reader = spark.read.schema(POSTINGS) if what == "postings" else spark.read
        some = reader.option("basePath", f"{root}/{name}/{what}").parquet(f"{root}/{name}/{what}").withColumn("segment", F.lit(i))
        some = some if where is None else some.where(where)
        rows = some if rows is None else rows.unionByName(some)
        buried = spark.read.parquet(f"{root}/{name}/gone").select(F.col("path").alias("p"), F.lit(i).alias("by"))
        graves = buried if graves is None else graves.unionByName(buried)
    if len(segments) == 1:
        return rows.drop("segment")
    last = graves.groupBy("p").agg(F.max("by").alias("by"))
    return rows.join(last, (F.col("path") == F.col("p")) & (F.col("segment") < F.col("by")), "left_anti").drop("segment")


def build(root: str, chunks: DataFrame) -> dict:
    """A new index of all chunks as one segment."""
    spark, name = chunks.sparkSession, f"segment-{uuid.uuid4().hex}"
    chunks = stored(chunks.select("chunk_id", "path", "symbol_name", "signature", "content"), "chunks")
    _write(root, name, r.postings(chunks, "path"), _sizes(chunks), chunks.select("path").limit(0))
    return _publish(spark, root, [name], *_totals(spark.read.parquet(f"{root}/{name}/chunks")))


def refresh(root: str, changed: DataFrame, chunks: DataFrame) -> dict:
    """Bring the index up to date: changed (path) are the files that are new, other than they were, or gone; chunks has those of all files, of
    which only the changed ones are looked at."""
    spark = chunks.sparkSession
    now = json.loads(publish.read_text(spark, f"{root}/manifest.json"))
    paths = stored(changed.select("path").distinct(), "changed")
    fresh = stored(chunks.select("chunk_id", "path", "symbol_name", "signature", "content").join(paths, "path", "left_semi"), "fresh")
    before_n, before_total = _totals(_live(spark, root, now["segments"], "chunks").join(paths, "path", "left_semi"))
    name = f"segment-{uuid.uuid4().hex}"
    _write(root, name, r.postings(fresh, "path"), _sizes(fresh), paths)
    added_n, added_total = _totals(spark.read.parquet(f"{root}/{name}/chunks"))
    return _publish(spark, root, [*now["segments"], name], now["chunks"] - before_n + added_n, now["terms"] - before_total + added_total)


def merge(spark: SparkSession, root: str) -> dict:
    """All that is live as one segment; the folders of the old ones go after the manifest has changed."""
    now = json.loads(publish.read_text(spark, f"{root}/manifest.json"))
    name, old = f"segment-{uuid.uuid4().hex}", now["segments"]
    sizes = stored(_live(spark, root, old, "chunks"), "sizes")
    _write(root, name, _live(spark, root, old, "postings"), sizes, sizes.select("path").limit(0))
    told = _publish(spark, root, [name], now["chunks"], now["terms"])
    for folder in old:
        delete_folder(spark, f"{root}/{folder}")
    return told


def search(spark: SparkSession, root: str, words: list[str]) -> DataFrame:
    """(chunk_id, matched, score) as `retrieval.lexical` gives, from the buckets of the words in each segment."""
    now = json.loads(publish.read_text(spark, f"{root}/manifest.json"))
    if not words:
        return spark.createDataFrame([], "chunk_id string, matched int, score double")
    buckets = spark.createDataFrame([(w,) for w in words], "term string").select(r._bucket(F.col("term")).alias("b")).distinct()
    mine = F.col("bucket").isin([x.b for x in buckets.collect()]) & F.col("term").isin(words)  # of the words of the query
    hits = stored(_live(spark, root, now["segments"], "postings", mine), "hits")
    df = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))  # a row for each word
    n, average = now["chunks"], now["terms"] / max(1, now["chunks"])
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    score = idf * F.col("tf") * (r.K1 + 1) / (F.col("tf") + r.K1 * (1 - r.B + r.B * F.col("len") / max(average, 1e-9)))
    some = hits.join(df, "term").groupBy("chunk_id").agg(F.count("*").cast("int").alias("matched"), F.round(F.sum(score), 6).alias("score"))
    return r._all_or_any(some, len(words))
