"""Exact dedup with a persistent digest index.

The index is an external table bucketed and sorted by digest. A batch of documents is reduced to one
row per digest before any shuffle (a group of any size leaves each task as one row), the digests that
the index lacks are found by a sort-merge anti join against its buckets, and only those are appended.
Everything is DataFrame code; no text is shuffled.

Defined results: a null text is the empty text; of equal texts the row with the largest ``doc_id``
stays; rows that repeat one ``doc_id`` and text share one decision; a null ``doc_id`` stays only where
its group has no other id; an empty table gives an empty result. Extra columns are ignored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, partitions, scratch, stored, text_or_empty


class DigestIndex:
    """Digests seen so far: ``digest`` (binary SHA-256), ``keep_id`` (the document that stands for it).

    ``path`` names an existing or new folder in shared storage; reopening needs the same ``buckets``."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or partitions(spark)
        self.path = path or scratch(spark, "digest-index")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, groups: DataFrame) -> None:
        """Append the rows of ``groups`` (digest, keep_id; one row per digest) that the index lacks."""
        fresh = groups.select("digest", "keep_id").join(self.rows().hint("merge"), "digest", "left_anti")
        # stored first: a table can't be read and appended to in one command
        fresh = stored(fresh, "digest-fresh")
        (fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .write.insertInto(self.name))
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Forget the table name; the files stay and can be opened again."""
        self.spark.sql(f"DROP TABLE {self.name}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the SHA-256 of its text with A-Z lower-cased."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _digest(text_col).alias("digest"))


def _digest(text_col: str):
    return F.unhex(F.sha2(ascii_lower(text_or_empty(text_col)).cast("binary"), 256))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Decide every row of ``docs`` against the index and append its new digests to it.

    Returns doc_id, keep_id (the document that stands for the text: one of an earlier batch, or the
    largest id of this one), group_size (rows of this batch with the text), kept, text_sha256."""
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    d = stored(digests(docs, id_col, text_col), "digests")
    groups = stored(d.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
                    "digest-groups")
    index.append_new(groups)
    known = stored(groups.select("digest", "group_size").join(index.rows().hint("merge"), "digest"), "digest-known")
    # a plain equi-join of two shuffled sides: AQE splits the partition of a hot digest
    return (d.join(known, "digest")
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def survivors(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; rows that repeat an id and text stay once."""
    kept = stored(deduplicate(docs, index, id_col, text_col).filter("kept")
                  .groupBy("doc_id", F.unhex("text_sha256").alias("digest")).agg(F.count(F.lit(1)).alias("times")), "dedup-kept")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("id"), _digest(text_col).alias("sha"))

    def of(times: str) -> DataFrame:
        k = kept.filter(times)
        return rows.join(k, (rows["sha"] == k["digest"]) & rows["id"].eqNullSafe(k["doc_id"]), "left_semi")

    out = of("times = 1").select("row.*")
    if kept.filter("times > 1").limit(1).count():
        out = out.unionAll(of("times > 1").dropDuplicates(["id", "sha"]).select("row.*"))
    return out
