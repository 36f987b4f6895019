"""Exact top-k inner product search with norm-bucketed retrieval.

Vectors are sorted by length (a range partition on the norm, ties on the id, so equal lengths spread) and
packed into buckets. First every query meets the longest bucket; its k-th best score there is a threshold
that no later candidate may stay below. For any other bucket that threshold, divided by the query's
length and the bucket's greatest, is a local cosine threshold. Above 1 the bucket is skipped; if it is so
high that few vectors can reach it, vectors are pruned by coordinates (a vector at least that close to the
query has each coordinate in a known interval, searched at the query's largest one and tested at others);
otherwise by length (a prefix of the bucket). What is left is verified by exact integer products.

The queries are packed in blocks, and a task takes a span of buckets past a block of queries: it holds one
bucket at a time and the k best so far of each query, which raise the thresholds as it goes, and returns
these alone. Blocks and buckets are read where they are stored, so neither is copied by a shuffle; a
bucket that no query of the block can use is left out before its bytes are copied. Partitions and files
follow the bytes, not the buckets, and nothing but one number for each dimension is broadcast.

Defined results: vectors that are null or hold null or non-finite components take no part, neither do
empty ones; a query meets the vectors of its own dimension; rows that repeat the query's id are not
candidates; repeated candidate rows are candidates each; with fewer than k candidates all are returned; an
empty table gives an empty result. Extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stored

BLOCK, QUERIES = 8192, 16384  # most rows of a bucket and of a block of queries,
BLOCK_BYTES, QUERY_BYTES = 4 << 20, 16 << 20  # and most bytes of each, at four a component
PART_BYTES = 48 << 20  # sorted at once, at eight bytes a component
BATCH_BYTES = 8 << 20  # of pairs that a task hands to its worker at once, or one pair
SPAN = 128  # most buckets of a task
TILE = 256  # queries that are multiplied at once
GROUP, LINE = 64, 512  # scores of which the greatest is taken first, or that are tested at once
COSINE = 0.5  # local thresholds from here on are worth testing coordinates
FOCUS = 4
PACKED = "bucket bigint, dim int, longest double, ids binary, matrix binary"
SLACK, ANGLE_SLACK = 1e-9, 1e-6  # bounds are computed in floating point
NONE = np.iinfo(np.int64).min + 1  # no score, below any


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (floor(scale * x) of each component), norm2 for the vectors that take part."""
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    fine = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _packed(rows: DataFrame, most: int, size: int) -> DataFrame:
    """Rows of a partition in order in blocks of at most ``most`` rows and ``size`` bytes, one row a block and
    dimension. bucket: rises with the partition and in it; longest: the greatest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, wait = TaskContext.get().partitionId() << 32, {}

        def block(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            low, high = int(m.min()), int(m.max())
            kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([m.shape[1]], pa.int32()), pa.array([float(_lengths(m).max())], pa.float64()),
                 pa.array([ids.tobytes()], pa.binary()), pa.array([m.astype(kind).tobytes()], pa.binary())],
                names=["bucket", "dim", "longest", "ids", "matrix"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            dims, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            begin = np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                of = np.flatnonzero(dims == dim)
                m = values.reshape(-1, dim) if len(of) == len(dims) else values[begin[of, None] + np.arange(dim)]
                held = wait.setdefault(dim, [])
                held.append((ids[of], m))
                n = max(1, min(most, size // (4 * dim)))
                if sum(len(i) for i, _ in held) >= n:
                    i, m = (np.concatenate(x) for x in zip(*held))
                    full = len(i) - len(i) % n
                    for a in range(0, full, n):
                        yield block(i[a:a + n], m[a:a + n])
                    wait[dim] = [(i[full:], m[full:])] if full < len(i) else []
        for dim in sorted(wait):
            if wait[dim]:
                yield block(*(np.concatenate(x) for x in zip(*wait[dim])))

    return rows.select("vec_id", "v").mapInArrow(run, PACKED)


def _matrix(ids: pa.Scalar, matrix: pa.Scalar, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i, data = np.frombuffer(ids.as_buffer(), np.int64), matrix.as_buffer()
    return i, np.frombuffer(data, f"i{data.size // (len(i) * dim)}").reshape(-1, dim)


def _lengths(m: np.ndarray) -> np.ndarray:
    f = m.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", f, f))


class _Rows:
    """Vectors with their lengths, in the types that products need."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        self.ids, self.m, self.lengths, self.typed = ids, m, _lengths(m), {}
        self.longest = float(self.lengths.max(initial=0))

    def of(self, kind: type) -> np.ndarray:
        if kind not in self.typed:
            self.typed[kind] = self.m.astype(kind)
        return self.typed[kind]


class Bucket(_Rows):
    """Vectors, the longest first."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        lengths = _lengths(m)
        if (lengths[1:] > lengths[:-1]).any():
            order = np.argsort(-lengths, kind="stable")
            ids, m = ids[order], m[order]
        super().__init__(ids, m)
        self.by_id = np.argsort(ids, kind="stable")
        self.sorted_ids = ids[self.by_id]
        self.unit, self.axes = None, {}

    def axis(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """The vectors in the order of coordinate a of their directions, and that coordinate."""
        if self.unit is None:
            self.unit = (self.m / np.maximum(self.lengths, 1.0)[:, None]).astype(np.float32)
        if a not in self.axes:
            order = np.argsort(self.unit[:, a])
            self.axes[a] = order, self.unit[order, a]
        return self.axes[a]


def _kind(bucket: _Rows, queries: _Rows) -> type:
    """The type in which every partial sum of a product is exact: none exceeds the product of the lengths."""
    bound = bucket.longest * queries.longest * (1 + SLACK)
    return np.float32 if max(bound, bucket.longest, queries.longest) < 2.0 ** 24 else np.float64 if bound < 2.0 ** 53 else np.int64


def _marked(marks: np.ndarray, size: int) -> np.ndarray:
    """The marks that are set among the first ``size``; few are, so they are looked through by the LINE."""
    upto = -(-size // LINE) * LINE
    marks[size:upto] = False
    lines = np.flatnonzero(np.bitwise_or.reduce(marks[:upto].view(np.uint64).reshape(-1, LINE // 8), axis=1))
    if len(lines) > size // LINE // 2:
        return np.flatnonzero(marks[:size])
    line, place = np.divmod(np.flatnonzero(marks[:upto].reshape(-1, LINE)[lines]), LINE)
    return lines[line] * LINE + place


def _hits(s: np.ndarray, floors: np.ndarray, marks: np.ndarray, by_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells that reach their row's floor; of a row with many, about the k best (equal ones by id). marks: to work in."""
    over = marks[:s.size].reshape(s.shape)
    np.greater_equal(s, floors[:, None], out=over)
    flat = _marked(marks, s.size)
    if len(flat) > 8 * k:
        crowded = np.flatnonzero(np.bincount(flat // s.shape[1], minlength=len(s)) > 8 * k)
        if len(crowded):
            # the k-th of the greatest of groups is a floor too
            part, groups = s[crowded], s.shape[1] // GROUP
            if groups >= k:
                greatest = part[:, :groups * GROUP].reshape(len(part), groups, GROUP).max(axis=2)
                over[crowded] &= part >= np.partition(greatest, groups - k, axis=1)[:, [groups - k]]
            still = np.count_nonzero(over[crowded], axis=1) > 8 * k
            if still.any():
                by_id = by_id[by_id < s.shape[1]]
                part = part[still][:, by_id]
                kth = np.partition(part, part.shape[1] - k, axis=1)[:, [part.shape[1] - k]]
                above, equal = part > kth, part == kth
                equal &= np.cumsum(equal, axis=1, dtype=np.int32) <= k - np.count_nonzero(above, axis=1)[:, None]
                best = np.empty_like(above)
                best[:, by_id] = above | equal
                over[crowded[still]] &= best
            flat = _marked(marks, s.size)
    return flat // s.shape[1], flat % s.shape[1]


class Queries(_Rows):
    """Queries with the k best candidates of each so far, none below the query's floor."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, floors: np.ndarray, k: int):
        super().__init__(ids, m)
        self.k, self.least = k, floors
        self.floors = floors.copy()
        self.found, self.scores = np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), NONE)
        focus = np.argpartition(-np.abs(m.astype(np.float64)), min(FOCUS, m.shape[1]) - 1, axis=1)[:, :FOCUS]
        size = np.take_along_axis(m, focus, axis=1) / np.maximum(self.lengths, 1.0)[:, None]
        order = np.argsort(-np.abs(size), axis=1)
        self.lead, size = np.take_along_axis(focus, order, axis=1), np.take_along_axis(size, order, axis=1)
        self.own = np.arccos(np.clip(size, -1, 1))
        #: From here on the interval at the largest coordinate lies on one side of 0.
        self.narrow = np.maximum(COSINE, np.sqrt(np.maximum(0, 1 - size[:, 0] ** 2)))

    def _add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        some = np.unique(rows)
        rows = np.concatenate([rows, np.repeat(some, self.k)])
        ids, scores = np.concatenate([ids, self.found[some].ravel()]), np.concatenate([scores, self.scores[some].ravel()])
        order = np.lexsort((ids, -scores, rows))
        rows = rows[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
        self.found[some], self.scores[some] = ids[order][first].reshape(-1, self.k), scores[order][first].reshape(-1, self.k)
        self.floors[some] = np.maximum(self.least[some], self.scores[some, -1])

    def _wanted(self, rows: np.ndarray, bucket: Bucket) -> np.ndarray:
        """The least scores that count: above the k-th best so far if its id is below all of the bucket."""
        return self.floors[rows] + ((self.scores[rows, -1] > NONE) & (self.found[rows, -1] < bucket.sorted_ids[0]))

    def _few(self, bucket: Bucket, rows: np.ndarray, cosines: np.ndarray, kind: type) -> np.ndarray:
        """Settle, by coordinates, the queries to which few vectors of the bucket can be close; whether it did."""
        # the angle to each axis differs from the query's by at most the angle between the two
        apart, own, lead = np.arccos(np.minimum(1.0, cosines))[:, None], self.own[rows], self.lead[rows]
        low, high = np.cos(np.minimum(np.pi, own + apart)) - ANGLE_SLACK, np.cos(np.maximum(0, own - apart)) + ANGLE_SLACK
        done, wanted = np.zeros(len(rows), bool), self._wanted(rows, bucket)
        m, q, dim = bucket.of(kind), self.of(kind), self.m.shape[1]
        limit, at_once = len(bucket.ids) * (16 if kind is np.int64 else 1) * max(64, dim) // 1024, max(1, (1 << 22) // dim)
        for a in np.unique(lead[:, 0]).tolist():
            order, column = bucket.axis(a)
            of = np.flatnonzero(lead[:, 0] == a)
            start, stop = np.searchsorted(column, low[of, 0], "left"), np.searchsorted(column, high[of, 0], "right")
            fits = stop - start <= limit
            of, start, n = of[fits], start[fits], (stop - start)[fits]
            done[of] = True
            upto = np.cumsum(n)
            x = 0
            while x < len(of):  # as many queries as have at_once candidates, but one
                y = max(x + 1, int(np.searchsorted(upto, upto[x] - n[x] + at_once, "right")))
                j = np.repeat(of[x:y], n[x:y])
                c = order[np.arange(len(j)) - np.repeat(upto[x:y] - n[x:y] - (upto[x] - n[x]), n[x:y]) + np.repeat(start[x:y], n[x:y])]
                for f in range(1, lead.shape[1]):
                    at = bucket.unit[c, lead[j, f]]
                    fits = (at >= low[j, f]) & (at <= high[j, f])
                    j, c = j[fits], c[fits]
                s = np.einsum("ij,ij->i", m[c], q[rows[j]]).astype(np.int64)
                fits = (s >= wanted[j]) & (bucket.ids[c] != self.ids[rows[j]])
                if fits.any():
                    self._add(rows[j[fits]], bucket.ids[c[fits]], s[fits])
                x = y
        return done

    def meet(self, bucket: Bucket) -> None:
        kind = _kind(bucket, self)
        reach = self.lengths * bucket.longest * (1 + SLACK)
        rows = np.flatnonzero(self.floors <= reach)  # else the local cosine threshold is above 1
        cosines = self.floors[rows] / np.maximum(reach[rows], 1e-300)
        close = np.flatnonzero(cosines >= self.narrow[rows])
        if len(close):
            done = self._few(bucket, rows[close], cosines[close], kind)
            rows = np.delete(rows, close[done])
        if not len(rows):
            return
        m, q = bucket.of(kind), self.of(kind)
        none = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        left, right = (np.searchsorted(bucket.sorted_ids, self.ids[rows], side) for side in ("left", "right"))
        room, marks = np.empty(TILE * len(m), kind), np.empty(TILE * len(m) + LINE, bool)
        for a in range(0, len(rows), TILE):
            t = rows[a:a + TILE]
            wanted = self._wanted(t, bucket)
            least = (wanted / np.maximum(self.lengths[t], 1e-300)).min() if (wanted > 0).all() else 0
            upto = int(np.searchsorted(-bucket.lengths * (1 + SLACK), -least, "right"))  # length pruning
            s = np.matmul(q[t], m[:upto].T, out=room[:len(t) * upto].reshape(len(t), upto))
            for j in np.flatnonzero(right[a:a + TILE] > left[a:a + TILE]):  # rows with the query's id
                same = bucket.by_id[left[a + j]:right[a + j]]
                s[j, same[same < upto]] = none
            if upto:
                j, c = _hits(s, wanted.astype(kind), marks, bucket.by_id, self.k)
                if len(j):
                    self._add(t[j], bucket.ids[c], s[j, c].astype(np.int64))


def retrieve(ids: np.ndarray, m: np.ndarray, qids: np.ndarray, qm: np.ndarray, floors: np.ndarray, k: int):
    """(query position, ids, scores) of the bucket's vectors that can be among a query's k best."""
    floors = np.where(np.isfinite(floors), np.ceil(floors), float(NONE)).astype(np.int64)
    queries = Queries(qids, qm, floors, k)
    if len(ids):
        queries.meet(Bucket(ids, m))
    for j in range(len(qids)):
        n = int((queries.scores[j] > NONE).sum())
        if n:
            yield j, queries.found[j, :n], queries.scores[j, :n]


def _with_floors(pairs: DataFrame, k: int) -> DataFrame:
    """Query blocks with the k-th best score of each query in the longest bucket (or none), the queries by what
    length they need of a vector; needs: the least of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, dim, qids, qmatrix, ids, matrix in zip(*batch.columns):
                qids, qm = _matrix(qids, qmatrix, dim.as_py())
                queries = Queries(qids, qm, np.full(len(qids), NONE), k)
                queries.meet(Bucket(*_matrix(ids, matrix, dim.as_py())))
                needs = np.where(queries.floors > 0, queries.floors / np.maximum(queries.lengths, 1e-300), 0.0)
                order = np.argsort(needs, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.as_py()], pa.int64()), pa.array([dim.as_py()], pa.int32()), pa.array([needs.min()], pa.float64()), pa.array([qids[order].tobytes()], pa.binary()),
                     pa.array([qm[order].tobytes()], pa.binary()), pa.array([queries.floors[order].tobytes()], pa.binary())],
                    names=["block", "qdim", "needs", "qids", "qmatrix", "floors"])

    return pairs.select("block", "qdim", "qids", "qmatrix", "ids", "matrix").mapInArrow(
        run, "block bigint, qdim int, needs double, qids binary, qmatrix binary, floors binary")


def _candidates(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query in the buckets that the task's pairs bring it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, Queries] = {}
        last, bucket = None, None
        for batch in batches:
            for block, dim, qids, qmatrix, floors, number, ids, matrix in zip(*batch.columns):
                block, dim, number = block.as_py(), dim.as_py(), number.as_py()
                if block not in met:
                    i, m = _matrix(qids, qmatrix, dim)
                    met[block] = Queries(i.copy(), m.copy(), np.frombuffer(floors.as_buffer(), np.int64).copy(), k)
                if number != last:
                    last, bucket = number, Bucket(*_matrix(ids, matrix, dim))
                met[block].meet(bucket)
        for queries in met.values():
            some = queries.scores > NONE
            if some.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(queries.ids, some.sum(axis=1))), pa.array(queries.found[some]), pa.array(queries.scores[some])],
                    names=["query_id", "vec_id", "score"])

    return (pairs.select("block", "qdim", "qids", "qmatrix", "floors", "bucket", "ids", "matrix")
            .mapInArrow(run, "query_id bigint, vec_id bigint, score bigint"))


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """A pair is megabytes, and Spark's batches stand in the executor and twice in the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def search(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k best rows for every row where ``is_query`` (a condition on vec_id) holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows, slots = stored(quantised(vectors, scale, id_col, vec_col), "topk-rows"), partitions(spark)
    n, components = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    mean = max(1, components // max(1, n))
    blocks = max(1, -(-n // max(1, min(BLOCK, BLOCK_BYTES // (4 * mean)))))
    parts = max(1, -(-components * 8 // PART_BYTES), min(blocks, slots))
    buckets = stored(_packed(rows.repartitionByRange(parts, F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id"),
                             BLOCK, BLOCK_BYTES), "topk-buckets")
    asked = stored(rows.filter(is_query).select("vec_id", "v").dropDuplicates(["vec_id"]), "topk-asked")
    # three quarters full on average, so that a block more for a few rows is rare
    full = max(1, min(QUERIES, QUERY_BYTES // (4 * mean)) * 3 // 4)
    groups = max(1, -(-asked.count() // full))
    queries = stored(_packed(asked.repartition(groups, "vec_id"), QUERIES, QUERY_BYTES), "topk-queries").select(
        F.col("bucket").alias("block"), F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("matrix").alias("qmatrix"))
    first = buckets.groupBy("dim").agg(F.min("bucket").alias("bucket")).select("bucket")  # the longest of each dimension
    first = stored(buckets.join(F.broadcast(first), "bucket", "left_semi").select("dim", "ids", "matrix").repartition(1), "topk-first")
    with _small_batches(spark):
        queries = stored(_with_floors(queries.join(first.hint("shuffle_replicate_nl"), F.col("dim") == F.col("qdim")), k), "topk-floors")
    # rows of both are read from the store by each task of the product of their partitions
    spans = max(-(-blocks // SPAN), -(-slots // groups))
    reaches = (F.col("dim") == F.col("qdim")) & (F.col("longest") * (1 + SLACK) >= F.col("needs"))
    with _small_batches(spark):
        found = stored(_candidates(buckets.coalesce(spans).join(queries.hint("shuffle_replicate_nl"), reaches), k), "topk-found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
