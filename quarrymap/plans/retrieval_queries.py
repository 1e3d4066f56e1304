"""Queries of the retrieval family: documents as chunks, and the stored vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymap.functions import text as tx
from quarrymap.operators import retrieval as r
from quarrymap.operators import segments, vector_index
from quarrymap.plans.registry import query
from quarrymap.sources import tables as t
from quarrymap.storage import new_folder, stored

SEGMENT = 3
TERMS = ["license", "the", "public"]
#: Terms by the same rule as the operator's, from a list of lower-cased runs.
TERMS_SQL = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_:\\\\]+'), lambda x: length(x) >= 2)"
SEARCH_SQL = TERMS_SQL.replace("lower(text)", "lower(source || ' ' || lang || ' ' || text)")


@query("chunk_segments", f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), s AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1, {SEGMENT})) AS a FROM d)
  SELECT doc_id, a::INT AS start_line, least(a + {SEGMENT - 1}, len(ls))::INT AS end_line, sha256(array_to_string(ls[a:a + {SEGMENT - 1}], chr(10))) AS sha256 FROM s""")  # fmt: skip
def chunk_segments(spark, sf_dir):
    return r.segments(t.chunks(spark, sf_dir), SEGMENT)


@query("chunk_fingerprints", """SELECT 'doc:' || doc_id || '#body:v1' AS chunk_id, sha256('v1' || chr(0) || 'doc:' || doc_id || chr(0) || rtrim(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(0))) AS content_sha256 FROM documents""")
def chunk_fingerprints(spark, sf_dir):
    body = F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "[ \t\n\r\\x0B\\x00]+\\z", "")
    return t.chunks(spark, sf_dir).select("chunk_id", tx.nul_hash(F.lit("v1"), F.col("symbol_id"), body).alias("content_sha256"))


@query("chunk_dedupe", "SELECT sha256(text) AS content_sha256, min(doc_id) AS kept, count(*) - 1 AS skipped FROM documents GROUP BY 1")
def chunk_dedupe(spark, sf_dir):
    """The first chunk of each content; a group of any size is only counted."""
    c = t.chunks(spark, sf_dir).select(F.sha2("content", 256).alias("content_sha256"), "doc_id")
    return c.groupBy("content_sha256").agg(F.min("doc_id").alias("kept"), (F.count("*") - 1).alias("skipped"))


@query("prune_missing", "SELECT lang, count(*) AS pruned, count(DISTINCT source) AS sources FROM documents WHERE doc_id % 17 = 0 GROUP BY 1")
def prune_missing(spark, sf_dir):
    f = t.files(spark, sf_dir)
    gone = f.join(t.working_copy(f).select("path"), "path", "left_anti")
    return gone.groupBy(F.col("namespace").alias("lang")).agg(F.count("*").alias("pruned"), F.countDistinct("directory").alias("sources"))


_STOP_SQL = ", ".join(f"'{w}'" for w in r.STOP_WORDS)


@query("structural_terms", rf"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[\p{{L}}_\\][\p{{L}}\p{{N}}_\\]*(?:::[\p{{L}}_][\p{{L}}\p{{N}}_]*)?'))) AS term FROM documents)
  SELECT term, count(*) AS chunks FROM w WHERE lower(term) NOT IN ({_STOP_SQL}) AND (contains(term, '::') OR contains(term, '\') OR (length(term) >= 2 AND
  (regexp_matches(term, '\p{{Ll}}\p{{Lu}}') OR regexp_matches(term, '^[\p{{Lu}}\p{{N}}_]{{2,4}}$') OR regexp_matches(term, '^\p{{Lu}}') OR contains(term, '_')))) GROUP BY 1""")  # fmt: skip
def structural_terms(spark, sf_dir):
    w = t.chunks(spark, sf_dir).select(F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r.CANDIDATE), F.lit(0)))).alias("term"))
    return w.where(r.is_structural(F.col("term"))).groupBy("term").agg(F.count("*").alias("chunks"))


def _bm25_sql(every: bool) -> str:
    n = len(TERMS)
    tf = ", ".join(f"len(list_filter(ws, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(TERMS))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(n))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)), 1e-6) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / av))" for i in range(n))
    matched = " + ".join(f"(tf{i} > 0)::INT" for i in range(n))
    return f"""WITH w AS (SELECT 'doc:' || doc_id || '#body:v1' AS chunk_id, {SEARCH_SQL} AS ws FROM documents), c AS (SELECT chunk_id, len(ws) AS len, {tf} FROM w),
      s AS (SELECT count(*) AS n, avg(len) AS av, {df} FROM c), scored AS (SELECT chunk_id, {matched} AS matched, {score} AS score FROM c, s)
      SELECT chunk_id, matched, round(score, 4) AS score FROM scored WHERE matched >= {n if every else 1}"""


@query("lexical_bm25_and", _bm25_sql(True))
def lexical_bm25_and(spark, sf_dir):
    return r.bm25(t.chunks(spark, sf_dir), TERMS, True).withColumn("score", F.round("score", 4))


@query("lexical_bm25_or", _bm25_sql(False))
def lexical_bm25_or(spark, sf_dir):
    return r.bm25(t.chunks(spark, sf_dir), TERMS, False).withColumn("score", F.round("score", 4))


def _embed_sql(text: str) -> str:
    """The tokens that embeddings count, as a list: humps become underscores before the parts are cut."""
    parts = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(w, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '_+'), lambda p: lower(p)), lambda p: length(p) >= 3 AND p <> lower(w))"
    return rf"flatten(list_transform(list_filter(regexp_split_to_array({text}, '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3), lambda w: list_concat([lower(w)], {parts})))"


IDF_SQL = f"""t AS (SELECT doc_id, unnest({_embed_sql('text')}) AS term FROM documents), dfs AS (SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY 1),
  known AS (SELECT term, df, round(ln((SELECT count(*) + 1 FROM documents)::DOUBLE / (df + 1)) + 1, 6) AS idf FROM dfs)"""
_HASHED = "('0x' || x[1:8])::BIGINT % 256 AS bucket, CASE WHEN ('0x' || x[9:10])::BIGINT % 2 = 0 THEN idf ELSE -idf END AS w"


@query("idf_table", f"WITH {IDF_SQL} SELECT term, df, idf FROM known")
def idf_table(spark, sf_dir):
    return r.idf(t.chunks(spark, sf_dir))


@query("hashed_embedding", f"""WITH {IDF_SQL}, h AS (SELECT term, idf, sha256(term) AS x FROM known), b AS (SELECT term, {_HASHED} FROM h),
  s AS (SELECT doc_id, bucket, sum(w) AS v FROM t JOIN b USING (term) GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM s GROUP BY 1)
  SELECT 'doc:' || doc_id || '#body:v1' AS chunk_id, count(*) AS buckets, round(sum(abs(v / norm)), 2) AS mass FROM s JOIN n USING (doc_id) WHERE norm > 1e-9 AND abs(v / norm) > 1e-6 GROUP BY 1""")  # fmt: skip
def hashed_embedding(spark, sf_dir):
    """A summary of each chunk's unit vector: its buckets and the sum of absolute values."""
    chunks = t.chunks(spark, sf_dir)
    counts = r.counted_chunks(chunks)
    rows = r.unit_vectors(r.block_embedding(counts, r.idf(chunks, counts)))
    size = F.transform("vector", lambda x: F.abs(x).cast("double"))
    held = F.filter(size, lambda x: x > 1e-6)
    return rows.select("chunk_id", F.size(held).cast("long").alias("buckets"), F.round(F.aggregate(held, F.lit(0.0), lambda a, x: a + x), 2).alias("mass"))


DISTANCE_SQL = "round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4)"


@query("knn_l2", f"""SELECT e.vec_id, {DISTANCE_SQL} AS distance, row_number() OVER (ORDER BY {DISTANCE_SQL}, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
  WHERE e.vec_id <> 0 ORDER BY 2, 1 LIMIT 20""")  # fmt: skip
def knn_l2(spark, sf_dir):
    return r.knn(t.table(spark, sf_dir, "embeddings"), 0, 20)


#: These vectors are about 1.1 to 1.7 apart; this keeps some of the sixty nearest.
KNN_CUTOFF = 1.22


@query("knn_cutoff", f"""WITH k AS (SELECT e.vec_id, {DISTANCE_SQL} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 ORDER BY 2, 1 LIMIT 60)
  SELECT vec_id, distance, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM k WHERE distance <= {KNN_CUTOFF}""")  # fmt: skip
def knn_cutoff(spark, sf_dir):
    return r.knn(t.table(spark, sf_dir, "embeddings"), 0, 60, KNN_CUTOFF)


QUERY, LIMIT = "the licence of doc:7 and the public license", 10
WORDS = r.query_terms(QUERY)
#: Of the reference 1.0; these chunks are whole documents, far from any query, so that a wider one is needed to see any.
CUTOFF = 1.4
_WORDS_SQL = ", ".join(f"'{w}'" for w in WORDS)


def _lexical_sql() -> str:
    tf = ", ".join(f"len(list_filter(ws, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(WORDS))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(WORDS)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)), 1e-6) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / av))" for i in range(len(WORDS)))
    matched = " + ".join(f"(tf{i} > 0)::INT" for i in range(len(WORDS)))
    return f"""lw AS (SELECT 'doc:' || doc_id || '#body:v1' AS chunk_id, {SEARCH_SQL} AS ws FROM documents), lc AS (SELECT chunk_id, len(ws) AS len, {tf} FROM lw),
      ls AS (SELECT count(*) AS n, avg(len) AS av, {df} FROM lc), lx AS (SELECT chunk_id, {matched} AS matched, round({score}, 4) AS score FROM lc, ls),
      lex AS (SELECT * FROM lx WHERE matched >= 1 AND (matched = {len(WORDS)} OR (SELECT max(matched) FROM lx) < {len(WORDS)}))"""


def _scored(spark, sf_dir):
    return r.lexical(t.chunks(spark, sf_dir), WORDS).withColumn("score", F.round("score", 4))


@query("lexical_search", f"WITH {_lexical_sql()} SELECT chunk_id, matched, score FROM lex")
def lexical_search(spark, sf_dir):
    return _scored(spark, sf_dir)


@query("lexical_postings", f"WITH {_lexical_sql()} SELECT chunk_id, matched, score FROM lex")
def lexical_postings(spark, sf_dir):
    """The same from stored postings."""
    return _posted(spark, sf_dir)


def _posted(spark, sf_dir):
    return r.search_index(spark, _index(spark, sf_dir), WORDS).withColumn("score", F.round("score", 4))


def _refreshed(spark, sf_dir, merged: bool):
    """An index of the documents as they were (each tenth said something else, each thirteenth wasn't there yet, and others were that are gone), brought up
    to date in two refreshes."""
    root, now = new_folder(spark, "segments"), t.chunks(spark, sf_dir).withColumn("path", F.col("symbol_id"))
    old = now.where("doc_id % 13 != 0").withColumn("content", F.when(F.col("doc_id") % 10 == 0, "the public license was here").otherwise(F.col("content")))
    lost = now.where("doc_id % 50 = 3").withColumns({"path": F.concat("path", F.lit("/old")), "chunk_id": F.concat("chunk_id", F.lit("/old"))})
    segments.build(root, old.unionByName(lost))
    segments.refresh(root, now.where("doc_id % 10 = 0").select("path").union(lost.select("path")), now)
    segments.refresh(root, now.where("doc_id % 13 = 0").select("path"), now)
    if merged:
        segments.merge(spark, root)
    return segments.search(spark, root, WORDS).withColumn("score", F.round("score", 4))


@query("postings_refreshed", f"WITH {_lexical_sql()} SELECT chunk_id, matched, score FROM lex")
def postings_refreshed(spark, sf_dir):
    """A refreshed index finds what one that was built anew does."""
    return _refreshed(spark, sf_dir, False)


@query("postings_merged", f"WITH {_lexical_sql()} SELECT chunk_id, matched, score FROM lex")
def postings_merged(spark, sf_dir):
    return _refreshed(spark, sf_dir, True)


@query("stop_word_terms", f"""WITH w AS (SELECT DISTINCT unnest({TERMS_SQL}) AS term FROM documents) SELECT count(*) AS terms, count(*) FILTER (term IN ({_STOP_SQL})) AS stop_words FROM w""")
def stop_word_terms(spark, sf_dir):
    w = t.chunks(spark, sf_dir).select(F.explode(r.terms(F.col("content"))).alias("term")).distinct()
    return w.agg(F.count("*").alias("terms"), F.count_if(F.col("term").isin(r.STOP_WORDS)).alias("stop_words"))


SEMANTIC_SQL = f"""{IDF_SQL}, h AS (SELECT term, idf, sha256(term) AS x FROM known), b AS (SELECT term, {_HASHED} FROM h),
  v AS (SELECT doc_id, bucket, sum(w) AS v FROM t JOIN b USING (term) GROUP BY 1, 2),
  q AS (SELECT bucket, sum(w) AS q FROM (SELECT {_HASHED} FROM (SELECT coalesce(idf, 1) AS idf, sha256(term) AS x FROM (SELECT unnest({_embed_sql("'" + QUERY + "'")}) AS term) LEFT JOIN known USING (term))) GROUP BY 1),
  d AS (SELECT doc_id, sqrt(sum(v * v)) AS norm, sum(v * coalesce(q, 0)) AS dot FROM v LEFT JOIN q USING (bucket) GROUP BY 1),
  near AS (SELECT 'doc:' || doc_id || '#body:v1' AS chunk_id, round(sqrt(greatest(0, 2 - 2 * dot / (norm * (SELECT sqrt(sum(q * q)) FROM q)))), 4) AS distance FROM d WHERE norm > 1e-9 ORDER BY 2, 1 LIMIT {3 * LIMIT})"""

_BUILT: dict[tuple[str, int], str] = {}


def _index(spark, sf_dir) -> str:
    """The folder of the stored index of a table's chunks: postings, weights, and the vectors under these. It is built once for the files as they
    are; a search reads of it what it needs."""
    file = F.col("_metadata")
    files = t.table(spark, sf_dir, "documents").select(F.xxhash64(file.file_path, file.file_size, file.file_modification_time).alias("f")).distinct()
    revision = int(files.agg(F.coalesce(F.sum(F.col("f").cast("decimal(38,0)")), F.lit(0))).first()[0])
    if (sf_dir, revision) not in _BUILT:
        folder, chunks = new_folder(spark, "search"), t.chunks(spark, sf_dir)
        r.write_index(chunks, folder)
        counts = r.counted_chunks(chunks)
        r.idf(chunks, counts).write.parquet(f"{folder}/weights")
        vectors = r.unit_vectors(r.block_embedding(counts, spark.read.parquet(f"{folder}/weights")))
        vector_index.write_cells(vectors.withColumnRenamed("chunk_id", "id"), folder)
        _BUILT[sf_dir, revision] = folder
    return _BUILT[sf_dir, revision]


def _semantic(spark, sf_dir):
    folder = _index(spark, sf_dir)
    vector = r.query_vector(spark, spark.read.parquet(f"{folder}/weights"), QUERY)
    near = vector_index.search(spark, folder, vector, 3 * LIMIT).withColumnRenamed("id", "chunk_id")
    return near.where(F.col("distance") <= CUTOFF)  # after the first so many, as ranks go


@query("embedding_restored", f"""WITH t AS (SELECT doc_id, unnest({_embed_sql('text')}) AS term FROM documents), dfs AS (SELECT term, count(DISTINCT doc_id) AS df FROM t WHERE doc_id % 2 = 0 GROUP BY 1),
  known AS (SELECT term, round(ln((SELECT count(*) + 1 FROM documents WHERE doc_id % 2 = 0)::DOUBLE / (df + 1)) + 1, 6) AS idf FROM dfs),
  h AS (SELECT term, coalesce(idf, 1) AS idf, sha256(term) AS x FROM (SELECT DISTINCT term FROM t) LEFT JOIN known USING (term)), b AS (SELECT term, {_HASHED} FROM h),
  s AS (SELECT doc_id, bucket, sum(w) AS v FROM t JOIN b USING (term) GROUP BY 1, 2) SELECT 'doc:' || doc_id || '#body:v1' AS chunk_id, count(*) AS buckets, round(sum(v), 6) AS total FROM s GROUP BY 1""")  # fmt: skip
def embedding_restored(spark, sf_dir):
    """A refresh takes the weights that were fitted before, here on every other document, and doesn't fit again; what they don't know counts with 1."""
    chunks = t.chunks(spark, sf_dir)
    counts = r.counted_chunks(chunks, "doc_id")
    fitted = stored(r.idf(chunks, counts.where("doc_id % 2 = 0")), "model")
    held = F.filter("sums", lambda x: x.isNotNull())
    out = r.block_embedding(counts, fitted).select("chunk_id", held.alias("held")).where(F.size("held") > 0)
    return out.select("chunk_id", F.size("held").cast("long").alias("buckets"), F.round(F.aggregate("held", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


NEAR = 5
_NEIGHBOURS_SQL = f"""SELECT q.vec_id AS query, e.vec_id AS id, {DISTANCE_SQL} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {DISTANCE_SQL}, e.vec_id)::INT AS rank FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id"""


def _neighbours(spark, sf_dir, exact: bool):
    """Of each vector whose id 50 divides, in an index of all vectors."""
    rows = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    folder = new_folder(spark, "cells")
    vector_index.write_cells(rows, folder)
    return vector_index.neighbours(spark, folder, rows.where("id % 50 = 0"), NEAR, exact)


@query("vector_neighbours", f"SELECT * FROM ({_NEIGHBOURS_SQL}) WHERE rank <= {NEAR}")
def vector_neighbours(spark, sf_dir):
    return _neighbours(spark, sf_dir, True)


@query("vector_neighbours_probed")
def vector_neighbours_probed(spark, sf_dir):
    """The same from the nearest cells alone; tests hold the recall against the exact one."""
    return _neighbours(spark, sf_dir, False)


@query("semantic_search", f"WITH {SEMANTIC_SQL} SELECT chunk_id, distance FROM near WHERE distance <= {CUTOFF}")
def semantic_search(spark, sf_dir):
    return _semantic(spark, sf_dir)


def _structural(spark, sf_dir):
    """The documents that the query names, by symbol id; `src1`, which is many files, names none."""
    c = t.chunks(spark, sf_dir).withColumn("file", F.col("symbol_id")).withColumn("ord", F.col("doc_id"))
    return r.structural(c, ["doc:7", "src1", "doc:12", "DOC:3"], LIMIT)


STRUCTURAL_SQL = f"""structural AS (SELECT chunk_id, row_number() OVER (ORDER BY place) AS rank FROM (SELECT 'doc:' || doc_id || '#body:v1' AS chunk_id, CASE doc_id WHEN 7 THEN 0 WHEN 12 THEN 2 ELSE 3 END AS place FROM documents WHERE doc_id IN (7, 12, 3)) LIMIT {LIMIT})"""


@query("structural_search", f"WITH {STRUCTURAL_SQL} SELECT * FROM structural")
def structural_search(spark, sf_dir):
    return _structural(spark, sf_dir)


CHANNELS_SQL = f"""WITH {_lexical_sql()}, l AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM lex ORDER BY score DESC, chunk_id LIMIT {3 * LIMIT}), {STRUCTURAL_SQL}, {SEMANTIC_SQL},
  s AS (SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM near WHERE distance <= {CUTOFF}),
  a AS (SELECT chunk_id, rank, 1.0::DOUBLE AS w, 'lexical' AS c FROM l UNION ALL SELECT chunk_id, rank, 1.0::DOUBLE, 'structural' FROM structural UNION ALL SELECT chunk_id, rank, 0.5::DOUBLE, 'semantic' FROM s),
  fused AS (SELECT chunk_id, round(sum(w / (60 + rank)), 6) AS score, min(rank) AS best, string_agg(DISTINCT c, '+' ORDER BY c) AS reasons FROM a GROUP BY 1 ORDER BY 2 DESC, 3, 1 LIMIT {2 * LIMIT})"""


def _channels(spark, sf_dir) -> dict:
    near = stored(_semantic(spark, sf_dir), "semantic")
    ranked = near.select("chunk_id", F.row_number().over(Window.orderBy("distance", "chunk_id")).alias("rank"))  # 3 * LIMIT rows at most
    lists = {"structural": _structural(spark, sf_dir), "lexical": r.top_ranks(_posted(spark, sf_dir), 3 * LIMIT), "semantic": ranked}
    return {name: stored(df, name) for name, df in lists.items()}


@query("hybrid_rrf", f"{CHANNELS_SQL} SELECT *, CASE WHEN (SELECT count(*) FROM s) = 0 THEN 'semantic_channel_unavailable' END AS degraded FROM fused")
def hybrid_rrf(spark, sf_dir):
    """Three channels; where the semantic one has nothing to say the rows tell so."""
    channels = _channels(spark, sf_dir)
    degraded = "semantic_channel_unavailable" if channels["semantic"].isEmpty() else None
    return r.rrf(channels, 2 * LIMIT).withColumn("degraded", F.lit(degraded).cast("string"))


@query("search_benchmark", f"""{CHANNELS_SQL}, f AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, best, chunk_id) AS rank FROM fused),
  lists AS (SELECT 'lexical' AS channel, chunk_id, rank FROM l UNION ALL SELECT 'structural', chunk_id, rank FROM structural UNION ALL SELECT 'semantic', chunk_id, rank FROM s UNION ALL SELECT 'hybrid', chunk_id, rank FROM f),
  hits AS (SELECT channel, lang || '/' || source AS expected, min(rank) AS rank FROM lists JOIN documents ON chunk_id = 'doc:' || doc_id || '#body:v1' GROUP BY 1, 2),
  cases AS (SELECT DISTINCT lang AS category, lang || '/' || source AS expected FROM documents), c AS (SELECT category, channel, rank FROM cases CROSS JOIN (SELECT unnest(['lexical', 'structural', 'semantic', 'hybrid']) AS channel) LEFT JOIN hits USING (channel, expected))
  SELECT coalesce(category, '_all') AS category, channel, count(*) AS cases, round(avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 4)::DOUBLE AS recall5, round(avg(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END), 6)::DOUBLE AS mrr10
  FROM c GROUP BY GROUPING SETS ((category, channel), (channel))""")  # fmt: skip
def search_benchmark(spark, sf_dir):
    """Each language and source is a case that expects one of its chunks, in four result lists."""
    c = t.chunks(spark, sf_dir).select("chunk_id", F.col("signature").alias("category"), F.concat("signature", F.lit("/"), "symbol_name").alias("expected"))
    channels = _channels(spark, sf_dir)
    fused = r.rrf(channels, 2 * LIMIT)
    channels["hybrid"] = fused.select("chunk_id", F.row_number().over(Window.orderBy(F.desc("score"), "best", "chunk_id")).alias("rank"))
    hits = {name: c.join(F.broadcast(df), "chunk_id").select("expected", "rank") for name, df in channels.items()}  # lists of a few rows
    return r.benchmark(c.select("category", "expected").distinct(), hits)


@query("embedding_cache", """SELECT sha256(text) AS content_sha256, bool_or(doc_id % 2 = 0) AS cached, count(*) AS chunks FROM documents GROUP BY 1""")
def embedding_cache(spark, sf_dir):
    """Contents that a cache of the even documents already holds, and fresh ones."""
    c = t.chunks(spark, sf_dir).select(F.sha2("content", 256).alias("content_sha256"), "doc_id")
    cache = c.where("doc_id % 2 = 0").select("content_sha256").distinct().withColumn("hit", F.lit(True))
    all_ = c.groupBy("content_sha256").agg(F.count("*").alias("chunks"))
    return all_.join(cache, "content_sha256", "left").select("content_sha256", F.coalesce("hit", F.lit(False)).alias("cached"), "chunks")


@query("index_health", f"""WITH w AS (SELECT 'doc:' || doc_id || '#body:v1' AS id, len({SEARCH_SQL}) AS len, len({_embed_sql('text')}) AS tokens FROM documents)
  SELECT count(*) AS chunks, count(*) FILTER (len = 0) AS without_postings, count(*) FILTER (tokens = 0) AS without_vector, 0 AS orphan_postings, 0 AS orphan_vectors, sum(len)::BIGINT AS terms FROM w""")  # fmt: skip
def index_health(spark, sf_dir):
    """What the stored index has for the chunks, and what it has that no chunk stands behind."""
    folder = _index(spark, sf_dir)
    chunks = t.chunks(spark, sf_dir).select("chunk_id")
    posted = spark.read.parquet(f"{folder}/postings").groupBy("chunk_id").agg(F.sum("tf").alias("terms"))
    placed = spark.read.parquet(f"{folder}/vectors").select(F.col("id").alias("chunk_id"), F.lit(True).alias("vector"))
    both = chunks.withColumn("chunk", F.lit(True)).join(posted, "chunk_id", "full").join(placed, "chunk_id", "full")
    none = lambda c: F.col(c).isNull()
    return both.agg(
        F.count("chunk").alias("chunks"), F.count_if(~none("chunk") & none("terms")).alias("without_postings"), F.count_if(~none("chunk") & none("vector")).alias("without_vector"),
        F.count_if(none("chunk") & ~none("terms")).alias("orphan_postings"), F.count_if(none("chunk") & ~none("vector")).alias("orphan_vectors"), F.sum("terms").alias("terms"),
    )
