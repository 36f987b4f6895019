"""Mixing sources to target weights by Pareto order sampling.

Each source's target is the multiple r of its size. Every document first gets floor(r) certain whole
copies; the remainder p = r - floor(r) is sampled without replacement by Pareto order sampling: with a
random U per document, documents are ranked by the ratio of their random odds U / (1 - U) to their
inclusion odds l / (1 - l) and the lowest are taken until the source's remaining words are reached.
Without ``weight_col`` all documents of a source have l = p; with it l follows the weight. U comes from
a hash of the id, so reruns agree.

The rank is never materialised: the ratio is mapped to a 48-bit ``key`` that keeps the order, words are
added up per source and key range (4096 ranges, then 4096 ranges of the range that holds the cut), and
only the keys of the last range are summed one by one. A source with any share of the rows is thus a
partial aggregate in every task. Since whole documents rarely end exactly at the target, one more
document of the remaining order, the one that best closes the gap, is added where it helps.

Defined results: a null text has size 0; null is a source of its own, after all others; documents that
share a key (repeated ids) are taken together; sources of size 0 take nothing; an empty table gives an
empty result. Extra columns are ignored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, text_or_empty

KEY_BITS, STEP_BITS = 48, 12


def _columns(seed: str, id_col: str, text_col: str, source_col: str, weight_col: str | None) -> dict:
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 12),
               16, 10).cast("bigint")
    return {"doc_id": F.col(id_col).cast("bigint"), "source": F.col(source_col),
            "size": F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint"), "key": u,
            "weight": F.col(weight_col).cast("double") if weight_col else F.lit(1.0)}


def source_targets(base: DataFrame, total_share: float, max_copies: float, weights: Sequence[float]) -> DataFrame:
    """One row per source: source_size, target. Shares by weight, no target above ``max_copies`` times
    the size, the excess given to the others by weight: with the sources in order of limit / weight,
    those below the common level are at their limit."""
    per = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    # the windows below see one row per source, not documents
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    return (per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
            .withColumn("ratio", F.col("cap") / F.col("w"))
            .withColumn("pool", F.sum("source_size").over(every) * F.lit(float(total_share)))
            .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("rest_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("level", (F.col("pool") - F.col("before")) / F.col("rest_w"))
            .withColumn("free", F.col("cap") > F.col("level") * F.col("w"))
            .withColumn("cut", F.min(F.when(F.col("free"), F.col("ratio"))).over(every))
            .withColumn("common", F.max(F.when(F.col("free") & (F.col("ratio") == F.col("cut")), F.col("level"))).over(every))
            .withColumn("target", F.when(F.col("cap") > F.col("common") * F.col("w"), F.col("common") * F.col("w"))
                        .otherwise(F.col("cap")))
            .select("source", "source_size", "target"))


def _cut(lots: DataFrame, shift: int) -> DataFrame:
    """Per source the key range of width 2**shift in which the running size first exceeds the need;
    ``before`` is the size ahead of it."""
    bins = (lots.groupBy("source", "need", "before", F.shiftright("key", shift).alias("bin"))
            .agg(F.sum("size").alias("n")))
    run = F.sum("n").over(Window.partitionBy("source").orderBy("bin"))
    return (bins.withColumn("upto", F.col("before") + run).filter(F.col("upto") > F.col("need"))
            .groupBy("source").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("before")), "bin").alias("c"))
            .select("source", F.col("c.bin").alias("bin"), F.col("c.before").alias("before")))


def _by_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """The per-source side is a stored table, so its size is known: Spark broadcasts it while it is below
    its threshold and otherwise merges, splitting a skewed source."""
    return left.join(right.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def _rank(key, p, weight, mean_weight):
    """The key of a document whose inclusion odds follow its weight: odds(U) / odds(l) x odds(p), mapped
    back to (0, 1); U itself where l = p."""
    limit = lambda x: F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), x))
    odds = lambda x: x / (1 - x)
    q = odds((key + 0.5) / float(2 ** KEY_BITS)) / odds(limit(p * weight / mean_weight)) * odds(limit(p))
    return F.when(q.isNull(), key).otherwise(F.floor(q / (1 + q) * float(2 ** KEY_BITS)).cast("bigint"))


def plan(docs: DataFrame, total_share: float = 1.5, max_copies: float = 2.0, weights: Sequence[float] = (3, 1, 2),
         seed: str = "mix", weight_col: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, source, size, key, weight; sources: source, source_size, target, certain, p,
    mean_weight, cut_key, fill_key). A document is sampled if its key is at most cut_key or equals fill_key."""
    base = stored(docs.select(*(c.alias(n) for n, c in _columns(seed, id_col, text_col, source_col, weight_col).items())), "mix-base")
    t = source_targets(base, total_share, max_copies, weights)
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = t.withColumn("certain", F.floor(r)).withColumn("p", r - F.floor(r))
    t = t.withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("certain") * F.col("source_size")))
    rows = base
    if weight_col:
        mean = base.groupBy("source").agg((F.sum(F.col("weight") * F.col("size")) / F.sum("size")).alias("mean_weight"))
        t = stored(_by_source(t, stored(mean, "mix-mean")), "mix-targets")
        rows = _by_source(base, t.select("source", "p", "mean_weight")).withColumn("key", _rank(F.col("key"), F.col("p"), F.col("weight"), F.col("mean_weight")))
        rows = base = stored(rows.select(*base.columns), "mix-base")
    else:
        t = stored(t.withColumn("mean_weight", F.lit(1.0)), "mix-targets")

    rows = _by_source(rows.filter(F.col("size") > 0), t.select("source", "need"))
    lots = rows.select("source", "key", "size", "need").withColumn("before", F.lit(0).cast("bigint"))
    for shift in (KEY_BITS - STEP_BITS, KEY_BITS - 2 * STEP_BITS):
        c = stored(_cut(lots, shift), "mix-cut")
        lots = _by_source(lots.drop("before"), c).filter(F.shiftright("key", shift) == F.col("bin")).drop("bin")
    by_key = lots.groupBy("source", "key", "need", "before").agg(F.sum("size").alias("n"))
    run = F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("key"))
    last = by_key.withColumn("upto", run).groupBy("source").agg(
        F.max(F.when(F.col("upto") <= F.col("need"), F.col("key"))).alias("last_key"), F.min("key").alias("first_key"),
        F.max(F.when(F.col("upto") <= F.col("need"), F.col("upto"))).alias("upto"), F.min("before").alias("before"),
        F.min("need").alias("need"))
    # keys up to cut_key are in; gap is what is still missing
    cut = stored(last.select("source", F.coalesce("last_key", F.col("first_key") - 1).alias("cut_key"),
                             (F.col("need") - F.coalesce("upto", "before")).alias("gap")), "mix-last")
    fill = (_by_source(rows, cut).filter((F.col("key") > F.col("cut_key")) & (F.col("size") < 2 * F.col("gap")))
            .groupBy("source", "key", "gap").agg(F.sum("size").alias("n"))
            .filter(F.col("n") < 2 * F.col("gap"))
            .groupBy("source").agg(F.min_by("key", F.struct(F.abs(F.col("gap") - F.col("n")), "key")).alias("fill_key")))
    sources = _by_source(_by_source(t.drop("need"), cut.drop("gap")), stored(fill, "mix-fill"))
    return base, stored(sources, "mix-sources")


def _copies():
    sampled = (F.col("size") > 0) & ((F.col("key") <= F.col("cut_key")) | (F.col("key") == F.col("fill_key")))
    return (F.col("certain") + F.when(sampled, 1).otherwise(0)).cast("bigint")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (both of its source), copies, taken. Options
    as in :func:`plan`."""
    base, sources = plan(docs, **options)
    rows = _by_source(base, sources).withColumn("copies", _copies())
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix", weight_col: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its columns. Only the per-source
    table meets the rows; no text is shuffled."""
    names = dict(seed=seed, weight_col=weight_col, id_col=id_col, text_col=text_col, source_col=source_col)
    _, sources = plan(docs, **names, **options)
    rows = docs.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in _columns(**names).items()))
    rows = _by_source(rows, sources)
    if weight_col:
        rows = rows.withColumn("key", _rank(F.col("key"), F.col("p"), F.col("weight"), F.col("mean_weight")))
    rows = rows.select("row", _copies().cast("int").alias("copies")).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
