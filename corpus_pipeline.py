"""A corpus pipeline of five stages over `documents`; each stage's result is written as Parquet and read back.

1. language: rows without a letter, or whose language the model can't tell (score under MIN_SCORE), go.
2. lines: lines near an earlier line go; a document of which nothing is left goes.
3. near copies: of each group of rows linked by word 5-grams (similarity 0.8 and more) the one of least doc_id stays (null
   last; of several with that doc_id the one that is read first).
4. mixing: documents get the copies that realise the target weights of the sources, by tokens; none is lost.
5. packing: the documents are packed into bins of tokens; copies of one document never share a bin.

All but the last return the columns of `documents`, whatever else these are called. Rows are told apart by a number of their
own, not by doc_id, so that repeated doc_ids lose nothing. Null texts go in the first stage; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymap.llm import language, lines, mixing, ngram_join, packing, tokens
from quarrymap.llm.common import new_folder, small_batches, spare, stored

MIN_SCORE = 0.05
WORDS, PERCENT = 5, 80


def _numbered(docs: DataFrame, row: str) -> DataFrame:
    """docs with a number of each row, written down so that it stays the same when tasks run again."""
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = language.train(docs.select("doc_id", "text", "lang").where(~language.held_out()))
    out = spare("language", docs.columns)
    found = language.identify(docs, model, out=out)
    return found.where((F.col(f"{out}.lang") != "und") & (F.col(f"{out}.score") >= MIN_SCORE)).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lines.with_lines_dropped(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    row = spare("row", docs.columns)
    numbered = _numbered(docs, row)
    found = ngram_join.ngram_components(numbered.select(F.col(row).alias("doc_id"), "text"), WORDS, PERCENT)
    shared = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    own = numbered.select(F.col(row).alias("doc_id"), F.col("doc_id").alias("id"))
    members = stored(found.join(shared, "component_id").join(own, "doc_id").select("component_id", "doc_id", "id"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id")).alias("first"))
    gone = members.select("doc_id").join(first.select(F.col("first.doc_id")), "doc_id", "left_anti")
    return numbered.join(gone.select(F.col("doc_id").alias(row)), row, "left_anti").select(docs.columns)


def _token_lengths(docs: DataFrame) -> DataFrame:
    return tokens.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    row, copies = spare("row", docs.columns), spare("copies", docs.columns)
    numbered = _numbered(docs, row)
    lengths = _token_lengths(numbered.select(F.col(row).alias("row"), "doc_id", "source", "text"))
    mixed = mixing.mix(lengths.select("row", "doc_id", "source", "n_tokens"), key="row")
    out = numbered.join(mixed.select(F.col("row").alias(row), F.col("copies").alias(copies)), row).where(F.col(copies) > 0)
    out = out.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return out.select(docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies are gone by now: what may not share a bin are the copies of one document."""
    small_batches(spark)
    docs = docs.select("doc_id", "source", "text", F.array(F.xxhash64("doc_id", "text")).alias("clusters"))
    return packing.pack(_token_lengths(docs).select("doc_id", "source", "clusters", F.col("n_tokens").alias("length")))


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

#: No SQL: the stages train a model, chain edit distances and pack greedily.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
