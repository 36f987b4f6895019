"""op5 where the buckets are many, and its kernel on every path against a plain sort."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import topk
from almanac.session import ensure_checkpoint_dir


def brute(ids, m, qids, q, k):
    s = q.astype(object) @ m.astype(object).T
    return [sorted((-int(x), int(i)) for x, i in zip(s[j], ids) if i != qids[j])[:k] for j in range(len(qids))]


def small(monkeypatch, **names):
    for name, value in names.items():
        monkeypatch.setattr(topk, name, value)


def table(spark, data):
    return spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")


def test_partitions_and_pairs_do_not_follow_the_buckets(spark, monkeypatch):
    """The driver plans, samples for and keeps track of as many tasks as there are partitions."""
    small(monkeypatch, BLOCK=4)
    base = re.sub("^file:", "", ensure_checkpoint_dir(spark))
    before = set(os.listdir(base))
    data = np.floor(np.random.default_rng(3).normal(size=(1200, 6)) * 40)
    out = topk.search(table(spark, data), F.col("vec_id") % 100 == 0, k=3, scale=1)
    parts = {re.sub("-[0-9a-f]{32}$", "", d): sum(f.startswith("part-") for f in os.listdir(f"{base}/{d}")) for d in set(os.listdir(base)) - before}
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts["topk-buckets"] <= slots < 1200 // 4
    assert parts["topk-first"] == 1 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
    got = [tuple(x) for x in out.orderBy("query_id", "rank").collect()]
    ids = np.arange(1200)
    want = brute(ids, data.astype(int), ids[::100], data[::100].astype(int), 3)
    assert got == [(int(q), r + 1, i, -s) for q, best in zip(ids[::100], want) for r, (s, i) in enumerate(best)]


def test_a_task_returns_no_more_than_k_of_a_query(spark, monkeypatch):
    small(monkeypatch, BLOCK=8)
    data = np.random.default_rng(4).integers(-50, 50, (400, 5))
    rows = topk._packed(topk.quantised(table(spark, data), 1).coalesce(1), 8, 1 << 20)
    asked = topk._packed(topk.quantised(table(spark, data), 1).where("vec_id < 10").coalesce(1), 64, 1 << 20)
    pairs = rows.crossJoin(asked.select(F.col("bucket").alias("block"), F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("matrix").alias("qmatrix"),
                                        F.udf(lambda b: np.full(len(b) // 8, topk.NONE).tobytes(), "binary")("ids").alias("floors")).hint("shuffle_replicate_nl"))
    assert rows.count() == 50 and topk._candidates(pairs.coalesce(1), 5).count() == 10 * 5


@pytest.mark.parametrize("spread", [50, 5000, 2 ** 30])
@pytest.mark.parametrize("case", ["plain", "ties", "close", "one vector", "own ids repeated"])
def test_every_path_of_the_kernel(spread, case, monkeypatch):
    """spread: products in single precision, double precision or integers."""
    small(monkeypatch, TILE=16, GROUP=8, LINE=64)
    r = np.random.default_rng(5)
    n, dim, k = 700, 3 if spread == 2 ** 30 else 12, 4
    m = r.integers(-spread, spread, (n, dim))
    ids = r.permutation(n)
    if case == "ties":
        m = m // max(1, spread // 2)
    elif case == "close":
        m[100:] = m[r.integers(0, 100, n - 100)] + r.integers(-2, 3, (n - 100, dim))
    elif case == "one vector":
        m[:600] = m[0]
    elif case == "own ids repeated":
        ids = ids % 40
    q, qids = m[::9][:50], ids[::9][:50]
    queries = topk.Queries(qids, q, np.full(len(q), topk.NONE), k)
    order = np.lexsort((ids, -(m.astype(float) ** 2).sum(axis=1)))
    for a in range(0, n, 64):
        queries.meet(topk.Bucket(ids[order[a:a + 64]], m[order[a:a + 64]]))
    got = [[(-int(s), int(i)) for s, i in zip(queries.scores[j], queries.found[j]) if s > topk.NONE] for j in range(len(q))]
    assert got == brute(ids, m, qids, q, k)


def test_few_vectors_are_found_by_coordinates(monkeypatch):
    settled, few = [], topk.Queries._few
    monkeypatch.setattr(topk.Queries, "_few", lambda self, *a: settled.append(few(self, *a)) or settled[-1])
    r = np.random.default_rng(6)
    m = r.normal(size=(3000, 24)) * 100
    m[1000:] = m[r.integers(0, 1000, 2000)] + r.normal(size=(2000, 24)) * 4
    m = (m / np.linalg.norm(m, axis=1)[:, None] * 256).astype(int)
    ids, q = r.permutation(3000), m[::30]
    best = brute(ids, m, ids[::30], q, 3)
    got = {j: [(-int(s), int(i)) for i, s in zip(found, scores)] for j, found, scores in topk.retrieve(ids, m, ids[::30], q, np.array([-b[-1][0] for b in best], float), 3)}
    assert got == dict(enumerate(best)) and sum(x.sum() for x in settled) > 20
