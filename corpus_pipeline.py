"""A corpus pipeline: five of the operators in :mod:`almanac.llm`, each stage over all that its
predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next stage's ``docs``. All but the last return the columns of documents:

* toxicity: documents that score as toxic go. The model is fitted on labelled rows.
* exact_dedup: of equal texts (A-Z lower-cased) the document with the largest id stays.
* simhash: of each group linked by fingerprints the document with the smallest id stays.
* mixing: every document as often as the mix takes it (not at all, once or twice).
* bpe: token ids of every text, and the digest of what they decode to.

Null texts count as empty, null ids and extra columns are handled as the operators say, and an empty table
gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import bpe, exact_dedup, mixing, simhash, toxicity
from almanac.llm.common import prepare, scratch, table
from almanac.llm.queries import tokenizer_path


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.survivors(docs, shingle=3, max_bits=3, seed=42)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, total_share=1.5, max_copies=2.0, weights=(3, 1, 2))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.transcode(docs, tokenizer_path()).select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", keep_clean), ("exact_dedup", drop_copies), ("simhash", drop_near_copies),
          ("mixing", mix_sources), ("bpe", tokenize)]

#: Fingerprints, learned scores and tokens are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
