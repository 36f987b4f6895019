"""Sharding by balanced label propagation.

Documents that share a link key (here: equal texts) are neighbours. Every document starts in a shard by
hash. Groups larger than a fiftieth of a shard (some fifty a shard at most) are placed one by one, the largest
first, each in the emptiest shard; one larger than a shard fills whole shards first. The others move in rounds
towards the shard that holds most of them. Shards exchange: what a shard takes is bounded by what its quota
(plus a fiftieth, where linked documents fill all shards) leaves free plus what leaves it, and movers are accepted with probability
taken / wanted per pair of shards (a hash of the group decides, so reruns agree). Documents without neighbours
are ballast: they cost no cut edge and make room. A last exact step moves the overhang of each shard to shards
below their quota: ballast first, then the smallest groups, whole but for those at the ends of a move.

Rounds run on cells (link key, first shard, and a hash part for groups larger than a shard), one row per
cell with its count, so a group of copies of any size is a few rows. Slots come from counts per (shard, size
class, large group, hash bucket) plus a row number inside the bucket.

Defined results: a null text counts as empty (size 1, CRC 0); a null id is hashed like any value; repeated
rows get different slots; an empty table gives an empty result. Extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored, text_or_empty

PARTS = 256


def described(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = text_or_empty(text_col).cast("binary")
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
                    F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("link"))
    d = d.withColumn("salt", F.coalesce("doc_id", F.monotonically_increasing_id()))  # parts equal rows without an id
    return d.withColumn("first", F.pmod(F.xxhash64("doc_id", "link"), F.lit(shards)).cast("int"))


def _placed(large: list, shards: int, cap: int) -> list[tuple]:
    """(link, part below which, shard) of large groups, given as (link, total), by descending size."""
    load, out = [0] * shards, []
    for link, total in large:
        at = 0
        while at < total:
            j = min(range(shards), key=lambda i: (load[i], i))
            n = min(total - at, max(1, cap) if total > cap else total)
            load[j] += n
            at += n
            out.append((link, PARTS if at >= total else at * PARTS // total, j))
    return out


def _accepted(wanted: list[list[int]], free: list[int]) -> list[list[float]]:
    """The share of the rows wanted from i to j that may move, so that no shard takes more than what is
    free in it and what leaves it."""
    n = len(free)
    share = [[1.0] * n for _ in free]
    for _ in range(100):
        leaves = [sum(w * s for w, s in zip(wanted[i], share[i])) for i in range(n)]
        for j in range(n):
            comes = sum(wanted[i][j] * share[i][j] for i in range(n))
            if comes > (room := max(0.0, free[j] + leaves[j])):
                for i in range(n):
                    share[i][j] *= room / comes
    return share


def _propagate(cells: DataFrame, shards: int, cap: int, rounds: int) -> DataFrame:
    """cells: link, first, part, n (rows of the cell), total (rows of the group). Adds ``shard``."""
    slack = cap // 50
    large = stored(cells.filter(F.col("total") > slack).select("link", "total").distinct(), "shard-large")
    placed = _placed([(r["link"], r["total"]) for r in large.orderBy(F.desc("total"), "link").collect()], shards, cap)  # some 50 a shard
    spark = cells.sparkSession
    upto = (spark.createDataFrame(placed, "link binary, upto int, goal int").groupBy("link")
            .agg(F.array_sort(F.collect_list(F.struct("upto", "goal"))).alias("goals")))
    first = F.element_at(F.filter("goals", lambda x: x["upto"] > F.col("part")), 1)["goal"]
    cells = stored(cells.join(F.broadcast(upto), "link", "left")
                   .select("link", "first", "part", "total", "n", F.coalesce(first, "first").alias("shard")), "shard-cells")
    small = F.col("total") <= slack
    even = (cells.agg(F.sum("n")).head()[0] or 0) // shards  # linked rows a shard if all had as many
    aim = min(cap + slack, max((even + cap) // 2, even + slack))  # beyond the quota only where linked rows fill it
    idle = 0
    for turn in range(rounds):
        load = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
        free = [aim - load.get(j, 0) for j in range(shards)]
        frag = cells.filter(small).groupBy("link", "shard").agg(F.sum("n").alias("n"))
        # every other round only shards with room are goals, for groups that a full shard keeps apart
        usable = frag.filter(F.col("shard").isin([j for j in range(shards) if free[j] > 0])) if turn % 2 else frag
        goal = usable.groupBy("link").agg(F.max_by("shard", F.struct("n", F.xxhash64("link", "shard", F.lit(turn)))).alias("goal"))
        moves = stored(frag.join(goal, "link").filter(F.col("shard") != F.col("goal")).select("link", "shard", "goal", "n"), "shard-moves")
        wanted = [[0] * shards for _ in range(shards)]
        for r in moves.groupBy("shard", "goal").agg(F.sum("n").alias("n")).collect():  # one row a pair of shards
            wanted[r["shard"]][r["goal"]] = r["n"]
        share = _accepted(wanted, free)
        if sum(w * s for ws, ss in zip(wanted, share) for w, s in zip(ws, ss)) < 0.5:  # no row would move
            idle += 1
            if idle == 2 or not (turn % 2 or any(map(any, wanted))):
                break
            continue
        idle = 0
        odds = F.element_at(F.array(*[F.lit(s) for ss in share for s in ss]), F.col("shard") * shards + F.col("goal") + 1)
        yes = F.pmod(F.xxhash64("link", F.lit(turn)), F.lit(1 << 20)) < odds * float(1 << 20)
        cells = stored(cells.join(moves.drop("n"), ["link", "shard"], "left")
                       .select("link", "first", "part", "total", "n",
                               F.when(F.col("goal").isNotNull() & yes, F.col("goal")).otherwise(F.col("shard")).alias("shard")),
                       "shard-cells")
    return cells


def shard(docs: DataFrame, shards: int = 16, rounds: int = 40, bucket_rows: int = 10_000, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Per document: doc_id, size, text_crc32, law ('rows': shard counts differ by one at most), shard, slot,
    grown_shard (null under this law)."""
    d = stored(described(docs, shards, id_col, text_col), "shard-docs")
    total = d.count()
    cap = total // shards
    groups = stored(d.groupBy("link").agg(F.count(F.lit(1)).alias("total")).filter("total > 1"), "shard-groups")
    part = F.when(F.col("total") > cap, F.pmod(F.xxhash64("doc_id", "link", F.lit(7)), F.lit(PARTS))).otherwise(0).cast("int")
    d = stored(d.join(groups, "link", "left").withColumn("part", part), "shard-linked")
    cells = d.filter(F.col("total").isNotNull()).groupBy("link", "first", "part", "total").agg(F.count(F.lit(1)).alias("n"))
    cells = _propagate(cells, shards, cap, rounds).select("link", "first", "part", "shard")
    d = d.join(cells, ["link", "first", "part"], "left").select(
        "doc_id", "salt", "size", "text_crc32", "link", F.coalesce("shard", "first").alias("shard"),
        F.coalesce("total", F.lit(1)).alias("total"))
    return _balanced(stored(d, "shard-placed"), total, shards, bucket_rows)


def _balanced(d: DataFrame, total: int, shards: int, bucket_rows: int) -> DataFrame:
    """Exact counts and gapless slots. Rows of a shard are numbered by group, the largest first and rows
    without a group last; those beyond its quota go to the shards below theirs. Groups too large for one
    bucket are numbered on their own, over buckets by their rows. There are some four buckets a shuffle partition,
    more where they would exceed ``bucket_rows``."""
    buckets = max(4, -(-4 * partitions(d.sparkSession) // shards), -(-total // (shards * bucket_rows)))
    rows = max(64, total // (shards * buckets))
    wide = F.col("total") > max(64, rows // 4)
    key = F.when(F.col("total") == 1, F.xxhash64("link", "doc_id")).otherwise(F.xxhash64("link"))
    spread = F.ceil(F.col("total") / rows)
    d = (d.withColumn("level", -F.floor(F.log2("total")).cast("int"))
         .withColumn("wide", F.when(wide, F.xxhash64("link")).otherwise(0))
         .withColumn("bucket", F.when(wide, F.pmod(F.xxhash64("link", "salt"), spread)).otherwise(F.pmod(key, F.lit(buckets))).cast("int")))
    place = ["shard", "level", "wide", "bucket"]
    counts = stored(d.groupBy(*place).agg(F.count(F.lit(1)).alias("n")), "shard-counts")
    count = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    offset = F.sum("n").over(Window.partitionBy("shard").orderBy("level", "wide", "bucket")) - F.col("n")
    offsets = stored(counts.select(*place, offset.alias("offset")), "shard-offsets")
    inside = F.row_number().over(Window.partitionBy(*place).orderBy("link", "doc_id")) - 1
    d = d.withColumn("row", inside).join(offsets, place).withColumn("row", F.col("row") + F.col("offset"))

    quota = [total // shards + (j < total % shards) for j in range(shards)]
    have = [count.get(j, 0) for j in range(shards)]
    over, at = [], 0
    for j in range(shards):
        over.append(at)  # number of the first row that leaves shard j
        at += max(0, have[j] - quota[j])
    lit = lambda xs: F.element_at(F.array(*[F.lit(int(x)).cast("bigint") for x in xs]), F.col("shard") + 1)
    leaves = F.col("row") >= lit(quota)
    number = F.when(leaves, lit(over) + F.col("row") - lit(quota))
    to, slot, at = F.col("shard"), F.col("row"), 0
    for j in range(shards):
        if (gap := quota[j] - have[j]) > 0:
            here = leaves & (F.col("number") >= at) & (F.col("number") < at + gap)
            to, slot = F.when(here, j).otherwise(to), F.when(here, F.col("number") - at + have[j]).otherwise(slot)
            at += gap
    return (d.withColumn("number", number)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), to.cast("int").alias("shard"),
                    slot.cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
