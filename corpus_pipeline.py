"""From raw documents to token ids: reject poor texts, drop repeated lines, keep one of each group of
near-duplicates, cut out benchmark passages, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. ``n_chars`` follows the text. A null or empty text passes through
every stage that does not reject it; an empty table stays empty; columns beside those of documents
are dropped by the first stage.

``run`` drops what the operators staged as soon as a stage is written. Given a place, it keeps the
written stages there, under a name made of the states of its tables and its parameters, and a later run over the same ones takes up after the last stage that was finished.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codexloom.llm import bpe, decontaminate, line_dedup, quality, simhash
from codexloom.llm.common import n_staged, release, shared_dir, stage, written
from codexloom.sources import store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above stay, unchanged."""
    docs = docs.select(*COLUMNS)
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_documents(docs, machine).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them only."""
    return _documents(line_dedup.drop_repeated_lines(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the least id stays; exact repeats of its row collapse."""
    key = F.coalesce("doc_id", F.lit(line_dedup.NO_ID))
    found = simhash.near_duplicates(docs)
    kept = stage(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key.alias("_key")).distinct(), "kept")
    # the kept ids grow with the documents, so they are never broadcast; the texts are moved once
    one = Window.partitionBy("_key", F.xxhash64("text")).orderBy(F.lit(0))
    return (docs.withColumn("_key", key).join(kept.hint("merge"), "_key", "left_semi")
            .withColumn("_n", F.row_number().over(one)).where("_n = 1").select(*COLUMNS))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside a benchmark window are cut out of the texts; all documents stay."""
    return _documents(decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the bytes they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe_encode(docs, path, public_tokenizers.PATTERN).drop("decoded")


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("near_copies", keep_one_of_near_copies), ("benchmark", cut_benchmark), ("encode", encode)]

#: A fitted model decides the first stage, which SQL cannot express.
ORACLE_SQL = None


#: Raised whenever a stage's code changes what it gives.
VERSION = 3


def _state(spark: SparkSession, sf_dir: str) -> str:
    """A digest of the tables that the stages read, as they are now, and of what the stages go by."""
    tables = [store.fingerprint(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "benchmark")]
    return hashlib.sha256(repr((VERSION, tables, quality.THRESHOLD, [name for name, _ in STAGES])).encode()).hexdigest()[:24]


def run(spark: SparkSession, sf_dir: str, place: str | None = None) -> DataFrame:
    docs, place = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{place.rstrip('/')}/{_state(spark, sf_dir)}" if place else shared_dir(spark)
    for k, (name, apply) in enumerate(STAGES[:-1]):
        path, before = f"{place}/{k}_{name}", n_staged()
        if not written(path):
            apply(spark, docs, sf_dir).write.mode("overwrite").option("compression", "zstd").parquet(path)
            release(spark, before)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
