"""SimHash near-dedup: byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Fingerprints that differ in at most three bits share at
least five of them, so in one half of the eight at least three of four. The index therefore posts every
distinct fingerprint under the eight choices of three positions from one half; any pair to be found meets
in at least one list. Inside a list the shared positional bytes of each pair are tallied, pairs that reach
five are kept, and their bit distance is verified.

Equal fingerprints are one row before anything is posted. Of a list only a spanning set of links leaves
the task, never all pairs. Lists longer than ``list_rows`` are posted again under the ten choices of two
more positions (five shared bytes); what is still longer shares five exact bytes and differs in 24 bits
only, and is linked by masking every choice of three of those bits: equal masked values are within three
bits of each other, so a link to the smallest document of each value loses nothing. That covers lists of
any length without comparing all their pairs.

Defined results: a null text is the empty text (fingerprint 0, linked like any other); documents with
null ids get their fingerprint and the component of equal fingerprints but no links of their own; repeated
rows share a fingerprint; an empty table gives an empty result. Extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components

LINK = "a bigint, b bigint"
ROWS = 512


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII space characters
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.array([xxhash.xxh64_intdigest(g, seed) for g in grams], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):  # bounded however long the text is
        ones += np.unpackbits(h[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(h)).tolist()))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fp (the 64 bits as bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                fp = np.array([fingerprint(t or "", shingle, seed) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id bigint, fp bigint"))


def _byte(i: int):
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))


def _key(number: int, positions: tuple[int, ...]):
    """The bytes at ``positions`` behind the number of the choice."""
    key = F.lit(number).cast("bigint")
    for i in positions:
        key = key * 256 + _byte(i)
    return key


TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def _postings(reps: DataFrame) -> DataFrame:
    keys = F.array(*[F.struct(_key(k, t).alias("key"), F.lit(k).alias("choice")) for k, t in enumerate(TRIPLES)])
    return reps.select("fp", "rep", F.explode(keys).alias("k")).select("k.key", "k.choice", "fp", "rep")


def _finer(postings: DataFrame) -> DataFrame:
    """The same rows under three plus two positions."""
    choices, number = [], 0
    for k, t in enumerate(TRIPLES):
        rest = [i for i in range(8) if i not in t]
        mine = []
        for two in combinations(rest, 2):
            free = [i for i in rest if i not in two]
            mask = sum(255 << (8 * i) for i in free)
            mine.append(F.struct(_key(number, t + two).alias("key"), F.lit(mask - (1 << 64) if mask >> 63 else mask).alias("free")))
            number += 1
        choices.append(F.array(*mine))
    at = F.element_at(F.array(*choices), F.col("choice") + 1)
    return postings.select("fp", "rep", F.explode(at).alias("k")).select("k.key", "k.free", "fp", "rep")


def _with_length(postings: DataFrame, name: str) -> DataFrame:
    """Rows of lists of two or more, with the list's length."""
    n = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return stored(postings.join(n, "key"), name)


def _linked(postings: DataFrame, max_bits: int, shared: int) -> DataFrame:
    """Links inside lists that fit a task; the lists of a partition are read in order of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = spanning_links(rows[0], rows[1], rows[2], max_bits, shared)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            rows = np.concatenate(held, axis=1)
            end = int(np.searchsorted(rows[0], rows[0, -1], "left"))  # the last list may go on
            yield from found(rows[:, :end])
            held = [rows[:, end:]]
        if held:
            yield from found(held[0])

    return (postings.select("key", "fp", "rep").repartition("key").sortWithinPartitions("key", "fp")
            .mapInArrow(run, LINK))


def spanning_links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, max_bits: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key, then fp. All pairs of equal keys are tallied and verified; of each connected set
    of fingerprints the links to its first row are returned."""
    n = len(key)
    parent, u = np.arange(n), fp.view(np.uint64)

    def root(i: np.ndarray) -> np.ndarray:
        r = parent[i]
        while True:
            up = parent[r]
            if np.array_equal(up, r):
                parent[i] = r
                return r
            r = up

    step, at = 1, np.flatnonzero(key[:-1] == key[1:])
    while at.size:
        x = u[at] ^ u[at + step]
        tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = at[(tally >= shared) & (np.bitwise_count(x) <= max_bits)]
        if near.size:
            ra, rb = root(near), root(near + step)
            for a, b in zip(near[ra != rb].tolist(), (near[ra != rb] + step).tolist()):
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)
        step += 1
        at = at[at + step < n]
        at = at[key[at] == key[at + step]]
    r = root(np.arange(n))
    inner = np.flatnonzero(r != np.arange(n))
    return rep[inner], rep[r[inner]]


def _masked(postings: DataFrame, max_bits: int) -> DataFrame:
    """Links of fingerprints that agree outside ``max_bits`` bits of ``free``."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("free"), i) == 1)
    rows = postings.withColumn("bits", bits)
    rows = rows.withColumn("mask", F.lit(0).cast("bigint")).withColumn("low", F.lit(-1))
    for _ in range(max_bits):
        rows = (rows.withColumn("bit", F.explode(F.filter("bits", lambda i: i > F.col("low"))))
                .withColumn("mask", F.expr("mask | shiftleft(1L, bit)")).withColumn("low", F.col("bit")).drop("bit"))
    value = F.col("fp").bitwiseAND(F.bitwise_not("mask"))
    rows = rows.select("key", "mask", value.alias("value"), "rep")
    first = rows.groupBy("key", "mask", "value").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(first, ["key", "mask", "value"]).filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def links(reps: DataFrame, max_bits: int = 3, list_rows: int = 4096) -> DataFrame:
    """reps: fp (distinct), rep (a document of it). Links (a, b) between representatives whose
    connected sets are those of all pairs within ``max_bits`` (at most 3) bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the index guarantees five shared bytes for at most three bits")
    shared = 8 - max_bits
    lists = _with_length(_postings(reps), "simhash-lists")
    out = _linked(lists.filter(F.col("n") <= list_rows), max_bits, shared)
    long = lists.filter(F.col("n") > list_rows)
    if long.limit(1).count():
        finer = _with_length(_finer(long.drop("n")), "simhash-finer")
        out = out.union(_linked(finer.filter(F.col("n") <= list_rows), max_bits, shared))
        out = out.union(_masked(finer.filter(F.col("n") > list_rows), max_bits))
    return stored(out.distinct(), "simhash-links")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, seed: int = 42, list_rows: int = 4096,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fp, fingerprint (hex), component_id (smallest doc_id reachable by links)."""
    fps = stored(fingerprints(docs, shingle, seed, id_col, text_col), "simhash-fps")
    reps = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    found = components(links(reps.filter("rep IS NOT NULL"), max_bits, list_rows))
    of = (reps.join(found.withColumnRenamed("node", "rep"), "rep", "left")
          .select("fp", F.coalesce("component", "rep").alias("component_id")))
    return (fps.join(stored(of, "simhash-of"), "fp")
            .select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def survivors(docs: DataFrame, shingle: int = 3, max_bits: int = 3, seed: int = 42, list_rows: int = 4096,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that another document of their group stands for (the one with the
    smallest id); rows with null ids stay."""
    found = near_duplicates(docs, shingle, max_bits, seed, list_rows, id_col, text_col)
    gone = stored(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")), "simhash-gone").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("id"))
    return rows.join(gone, rows["id"] == gone["gone"], "left_anti").select("row.*")
