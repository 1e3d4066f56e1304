"""The queries of this package: each applies one operator to its whole table. SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.llm import (
    fingerprint, language, lines, media, mixing, ngram_join, packing, pii, spelling, tokenfile, tokens, toxicity, vectors,
)
from quarrymap.llm.common import documents, small_batches

TOKEN_LIMIT = 4096


def _n_bytes(text: str = "text"):
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def _token_lengths(docs: DataFrame) -> DataFrame:
    """docs with n_tokens of each whole text."""
    return tokens.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text", _n_bytes().alias("n_bytes"))
    docs = media.media_columns(docs.select("doc_id", "n_bytes", "text")).select("doc_id", "n_bytes", "features")
    f = F.col("features")
    return docs.select(
        "doc_id", "n_bytes", f.payload_bytes.alias("payload_bytes"), f.payload_sha256.alias("payload_sha256"),
        f.tail_crc32.alias("tail_crc32"), f.media_bytes.alias("media_bytes"), f.media_sha256.alias("media_sha256"),
        media.hex_of(f.phash).alias("feature"),
    )


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text", _n_bytes().alias("n_bytes"))
    docs = tokens.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return docs.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language.train(docs.where(~language.held_out()))
    docs = language.identify(docs.select("doc_id", "text"), model)
    return docs.select(
        "doc_id", language.held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.find_spans(documents(spark, sf_dir))
    counts = [
        F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as bigint)").alias(f"n_{name}")
        for k, name in enumerate(pii.KINDS[:4])
    ]
    return spans.select("doc_id", *counts, F.sha2(pii.spans_text("base"), 256).alias("base_sha256"), pii.spans_text("spans").alias("spans"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_kept", "n_near", F.sha2("text", 256).alias("kept_sha256"), "text")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return ngram_join.ngram_components(docs, words=4, percent=85)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return tokenfile.roundtrip(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = _token_lengths(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixing.mix(docs.select("doc_id", "source", "n_tokens"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "source", "text", packing.clusters_of("text").alias("clusters"))
    return packing.pack(_token_lengths(docs).select("doc_id", "source", "clusters", F.col("n_tokens").alias("length")))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(documents(spark, sf_dir))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    words = spelling.vocabulary(documents(spark, sf_dir).select("doc_id", "text"))
    return spelling.with_roots(spelling.variants(words)).select("word", "form", "root", "n", "n_near", "form_n")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    coded, books = vectors.compress(rows)
    out = vectors.with_group_error(coded, "label", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    t = F.col("toxicity")
    places = F.array_join(F.transform(t.passages, lambda p: F.concat_ws(":", p["start"], p["end"])), ",")
    return toxicity.toxicity(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), t.score.alias("score"), (t.score >= 0.5).cast("int").alias("predicted"), places.alias("passages")
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_media, op2_tokens, op3_language, op4_pii, op5_line_dedup, op6_ngram_join, op7_token_files, op8_mixing,
        op9_packing, op10_fingerprints, op11_spelling, op12_vector_codes, op13_toxicity, pipeline,
    )
}

_ROUNDS = "".join(
    f"""a{r} AS MATERIALIZED (SELECT part, id, v, arg_min(entry, (d, entry)) AS entry FROM (SELECT p.part, id, v, entry, list_inner_product(v, v) - 2 * list_inner_product(v, e) + list_inner_product(e, e) AS d FROM p JOIN c{r} USING (part)) GROUP BY 1, 2, 3),
  m{r} AS (SELECT part, entry, list(x ORDER BY pos) AS e FROM (SELECT part, entry, pos, floor(sum(v[pos]) / count(*)) AS x FROM a{r}, (SELECT unnest(range(1, 1 + (SELECT max(w) FROM k))) AS pos) GROUP BY 1, 2, 3) GROUP BY 1, 2),
  c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN m{r} USING (part, entry)), """
    for r in range(4)
)

ORACLE_SQL: dict[str, str] = {
    "op12_vector_codes": f"""WITH k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS id, len(embedding) // 4 AS w, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
  p AS MATERIALIZED (SELECT part, id, v[part * w + 1 : part * w + w] AS v FROM k, (SELECT unnest([0, 1, 2, 3]) AS part)), c0 AS (SELECT part, id - 1 AS entry, v AS e FROM p WHERE id <= 256),
  {_ROUNDS}f AS (SELECT part, id, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT p.part, id, entry, list_inner_product(v, v) - 2 * list_inner_product(v, e) + list_inner_product(e, e) AS d FROM p JOIN c4 USING (part)) GROUP BY 1, 2),
  g AS (SELECT id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY 1),
  h AS (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c4)
  SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM g JOIN k USING (id), h""",
}
