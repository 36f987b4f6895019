"""Substring dedup by seed and extend.

A run of ``window`` words that also starts in a document with a smaller id is removed. Seeds are winnowed
anchors: of the hashes of ``k`` words in every window the smallest is an anchor, so a repeated run has the
same anchor, at the same place, in every document. Documents are joined on anchors and matches extended:

1. Each anchor is posted with a hash of its full reach, every word of any window that can hold it. Where an
   earlier document has anchor and reach alike, the match extends over the whole reach: all of it repeats.
2. Anchors that documents share with different reaches mark the ends of repeats. Only there the extension
   goes step by step: each window around the anchor is posted, and an earlier document with the same window
   settles it.

Adjacent matches join to maximal repeats; their words go. Postings are columns of numbers packed per task
and bucket. A task first settles what it can by itself: of equal postings only the one with the smallest
id leaves it, so a passage in any share of the documents is one posting for some 30 MB of text; an anchor that a task sees
with more than ``reaches`` reaches goes to step 2 at once, behind a marker. A bucket is settled as it
streams in: equal postings leave with their verdict, and an anchor of more than ``STREAM_REACHES`` reaches becomes a
marker, so memory holds the different postings of a bucket and not their number. Texts are shuffled to meet
the verdicts, never compared in pairs.

A word has two 64-bit hashes, the halves of its seeded 128-bit XXH3; runs of words are hashed by mixing halves of doubling
length, for each of the two apart (no polynomial, whose structure texts could meet). Anchors and windows meet by the first, and
the second, over all words that count, has to agree too: two different runs are taken for equal with a
chance of about 2**-128, in one and the same document 2**-64.

Defined results: a null text has no words; a null id neither removes nor loses words; rows that repeat an
id don't remove each other's words; verdicts belong to an id and its text; texts shorter than the window
keep all words; an empty table gives an empty result. Extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

CHUNK = 2 << 20  # bytes of text that are hashed at once
POSTINGS = 1 << 20  # postings that a task settles at once
STREAM_REACHES = 4096
BLOCK = 1 << 19
SEED = 0x616C6D616E6163
U = np.uint64
FORWARD, TAKEN = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)  # odd multipliers
SPACE = frozenset(b"\x20\x09\x0A\x0B\x0C\x0D")
POSTED = "bucket int, key binary, reach binary, doc binary, text binary, pos binary"
VERDICT = "doc_id bigint, th bigint, pos int, whole boolean"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: bytes) -> np.ndarray:
    """Two hashes of every word, in rows."""
    at, digests = 0, []
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and text[end] not in SPACE:
            end += 1  # a word is never cut
        digests.extend(map(xxhash.xxh3_128_digest, text[at:end].split(), repeat(SEED)))
        at = end
    return np.frombuffer(b"".join(digests), U).reshape(-1, 2)


class Spans:
    """Hashes of runs of words: of 1, 2, 4, ... words by mixing two halves, of any other length by its binary digits."""

    def __init__(self, words: np.ndarray):
        self.levels = [np.ascontiguousarray(words)]

    def of(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n words from each place."""
        while len(self.levels) < n.bit_length():
            half, h = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(mixed(h[:max(0, len(h) - half)] * FORWARD + h[half:]))
        out = np.full(len(at), U(n))
        for bit in range(n.bit_length() - 1, -1, -1):
            if n >> bit & 1:
                out = mixed(out * TAKEN + self.levels[bit][at])
                at = at + (1 << bit)
        return out

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words from a to b; lengths are few."""
        out, sizes = np.zeros(len(a), U), b - a
        for n in np.unique(sizes).tolist():
            out[sizes == n] = self.of(a[sizes == n], n)
        return out


class Texts:
    """Word-level view of some texts laid end to end."""

    def __init__(self, texts: list[bytes], window: int, k: int):
        self.window, self.k, self.wide = window, k, window - k + 1
        hashes = [word_hashes(t) for t in texts]
        sizes = np.array([len(h) for h in hashes], np.int64)
        self.last = np.cumsum(sizes)
        self.first = self.last - sizes  # word of each document
        self.doc = np.repeat(np.arange(len(texts)), sizes)  # of each word
        self.words = np.concatenate(hashes) if hashes else np.zeros((0, 2), U)
        n = len(self.words)
        self._keys, self._checks = Spans(self.words[:, 0]), Spans(self.words[:, 1])
        grams = self.span(np.arange(max(0, n - k + 1)), k)
        whole = np.zeros(n, bool)  # windows that lie in one document
        if n >= window:
            whole[:n - window + 1] = self.doc[:n - window + 1] == self.doc[window - 1:]
        self.starts = np.flatnonzero(whole)
        least = np.zeros(n, U)
        if self.starts.size:
            low = grams[self.starts]
            for j in range(1, self.wide):
                low = np.minimum(low, grams[self.starts + j])
            least[self.starts] = low
        self.grams, self.least, self.whole = grams, least, whole
        chosen = np.zeros(n, bool)
        for j in range(self.wide):
            s = self.starts
            chosen[s[grams[s + j] == least[s]] + j] = True
        self.anchors = np.flatnonzero(chosen)
        a = np.maximum(self.anchors - (self.wide - 1), self.first[self.doc[self.anchors]])
        b = np.minimum(self.anchors + window, self.last[self.doc[self.anchors]])
        self.reach_from, self.reach_to = a, b
        cut = (self.anchors - a).astype(U) * U(64) + (b - self.anchors).astype(U)
        self.reach = mixed(self._checks.between(a, b) ^ mixed(cut + U(1)))

    def span(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n words from each place."""
        return self._keys.of(at, n)

    def check(self, at: np.ndarray, n: int) -> np.ndarray:
        """The other hash of the n words from each place."""
        return self._checks.of(at, n)


def _new(*cols: np.ndarray) -> np.ndarray:
    """Rows where any of the sorted columns changes."""
    out = np.ones(len(cols[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return out


class Rows:
    """Postings: key, reach, doc (id), text (hash), pos; pos -1 marks a key with too many reaches."""

    COLS = (("key", U), ("reach", U), ("doc", np.int64), ("text", np.int64), ("pos", np.int32))

    def __init__(self, *cols: np.ndarray):
        self.cols = list(cols)

    def take(self, at: np.ndarray) -> Rows:
        return Rows(*(c[at] for c in self.cols))

    def settled(self) -> tuple[Rows, np.ndarray, np.ndarray]:
        """Sorted rows, one per key, reach and document; whether an earlier document has the same key and
        reach; the number of the key."""
        key, reach, doc, text, pos = self.cols
        r = self.take(np.lexsort((pos, text, doc, reach, key)))
        r = r.take(_new(*r.cols[:4]))
        group = _new(*r.cols[:2])
        smallest = r.cols[2][np.flatnonzero(group)][np.cumsum(group) - 1] if len(group) else r.cols[2]
        return r, r.cols[2] > smallest, np.cumsum(_new(r.cols[0])) - 1


def _verdicts(rows: Rows, whole: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """doc, text, pos, whole of the postings with a verdict: a whole match or the end of one."""
    some = whole | ends
    return [*(c[some] for c in rows.cols[2:]), whole[some]]


def _outgoing(rows: Rows, buckets: int, reaches: int) -> Iterator[tuple]:
    """What a task can't settle by itself, by bucket; and its own verdicts in bucket -1 (key: whether whole)."""
    r, later, number = rows.settled()
    first, ends = ~later, np.zeros(len(later), bool)
    if reaches and len(number):
        many = np.bincount(number[first], minlength=number[-1] + 1) > reaches
        ends = first & many[number]
        first &= ~ends
    doc, text, pos, whole = _verdicts(r, later, ends)
    if len(doc):
        yield -1, whole.tobytes(), b"", doc.tobytes(), text.tobytes(), pos.tobytes()
    left = r.take(first)
    if ends.any():
        marks = r.take(np.flatnonzero(ends)[_new(r.cols[0][ends])])
        marks.cols[1], marks.cols[4] = np.zeros_like(marks.cols[1]), np.full_like(marks.cols[4], -1)
        left = Rows(*(np.concatenate(x) for x in zip(left.cols, marks.cols)))
    bucket = (left.cols[0] % U(buckets)).astype(np.int64)
    # in order of documents inside a bucket: their columns are runs, which compress
    left = left.take(order := np.lexsort((left.cols[4], left.cols[2], bucket)))
    bucket = bucket[order]
    cut = np.flatnonzero(_new(bucket))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)]):
        yield int(bucket[a]), *(c[a:b].tobytes() for c in left.cols)


class Bucket:
    """Postings of one bucket as they come in. ``steps``: whether keys with several reaches need the second step."""

    def __init__(self, steps: bool):
        self.steps, self.held, self.size, self.limit = steps, [], 0, POSTINGS

    def add(self, rows: Rows) -> list[np.ndarray] | None:
        """Verdicts, where enough postings came in to settle some."""
        self.held.append(rows)
        self.size += len(rows.cols[0])
        if self.size < self.limit:
            return None
        out = self._settle(False)
        self.limit = max(POSTINGS, 2 * self.size)
        return out

    def end(self) -> list[np.ndarray]:
        return self._settle(True)

    def _settle(self, last: bool) -> list[np.ndarray]:
        rows = Rows(*(np.concatenate([h.cols[i] for h in self.held]) for i in range(len(Rows.COLS)))) if self.held else Rows(*(np.zeros(0, t) for _, t in Rows.COLS))
        mark = rows.cols[4] < 0
        marked = np.unique(rows.cols[0][mark])
        r, later, number = rows.take(~mark).settled()
        first, ends = ~later, np.zeros(len(later), bool)
        if self.steps and len(number):
            keys = number[-1] + 1
            known = np.isin(r.cols[0], marked)
            kinds = np.bincount(number[_new(*r.cols[:2])], minlength=keys)
            if last:
                low, high = np.full(keys, np.iinfo(np.int64).max), np.full(keys, np.iinfo(np.int64).min)
                np.minimum.at(low, number[first], r.cols[2][first])
                np.maximum.at(high, number[first], r.cols[2][first])
                ends = first & (((kinds > 1) & (low < high))[number] | known)
            else:
                many = (kinds > STREAM_REACHES)[number] | known
                ends = first & many
                marked = np.unique(np.concatenate([marked, r.cols[0][many]]))
        if not last:
            left = r.take(first & ~ends)
            none = np.zeros(len(marked), np.int64)
            self.held = [left, Rows(marked, none.astype(U), none, none, np.full(len(marked), -1, np.int32))]
            self.size = len(left.cols[0]) + len(marked)
        return _verdicts(r, later, ends)


def _posted(found: Iterator[Rows], buckets: int, reaches: int) -> Iterator[pa.RecordBatch]:
    """Postings of a task, settled together as far as they fit."""
    held, size = [], 0

    def batches() -> Iterator[pa.RecordBatch]:
        if size and (out := list(_outgoing(Rows(*(np.concatenate([h.cols[i] for h in held]) for i in range(len(Rows.COLS)))), buckets, reaches))):
            yield _batch(out, P_SCHEMA)

    for rows in found:
        held.append(rows)
        size += len(rows.cols[0])
        if size >= POSTINGS:
            yield from batches()
            held, size = [], 0
    yield from batches()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


P_SCHEMA = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("key", "reach", "doc", "text", "pos"))])
V_SCHEMA = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("whole", pa.bool_())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows with a text (second column, as bytes) in lists of about CHUNK bytes."""
    rows, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            for row in zip(*(c.to_pylist() if not pa.types.is_string(c.type) else c.cast(pa.binary()).to_pylist() for c in part.columns)):
                rows.append(row)
                size += len(row[1] or b"")
                if size >= CHUNK:
                    yield rows
                    rows, size = [], 0
    if rows:
        yield rows


def _meeting(posted: DataFrame, buckets: int, steps: bool) -> DataFrame:
    """Bring the postings of a bucket together and give the verdicts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = Bucket(steps), None

        def verdicts(out: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
            if out is not None and len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], schema=V_SCHEMA)

        for batch in batches:
            for bucket, *cols in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket < 0:
                    yield from verdicts([*(np.frombuffer(c, t) for c, (_, t) in zip(cols[2:], Rows.COLS[2:])), np.frombuffer(cols[0], bool)])
                    continue
                if bucket != at:
                    yield from verdicts(held.end())
                    held, at = Bucket(steps), bucket
                yield from verdicts(held.add(Rows(*(np.frombuffer(c, t) for c, (_, t) in zip(cols, Rows.COLS)))))
        yield from verdicts(held.end())

    # a task's own verdicts (bucket -1) may go anywhere
    to = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("doc"), F.lit(buckets))).otherwise(F.col("bucket")).cast("int")
    return (posted.withColumn("to", to).repartition(buckets, "to").sortWithinPartitions("to", "bucket").drop("to")
            .mapInArrow(run, VERDICT))


def _gathered(verdicts: DataFrame, *kinds: str) -> DataFrame:
    """One row per document and text, with the places of each kind (a document's own, so bounded by it)."""
    return verdicts.groupBy("doc_id", "th").agg(*(F.collect_list(F.when(F.col("kind") == k, F.col("pos"))).alias(k) for k in kinds))


def _places(pos: list[int] | None) -> np.ndarray:
    return np.array(pos or (), np.int64)


def remove_repeats(docs: DataFrame, window: int = 13, k: int = 5, bucket_rows: int = 300_000, reaches: int = 32,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the words left, joined by a space)."""
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = base.withColumn("th", F.xxhash64("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
    buckets = max(8, int(size / 6 * 2 / (window - k + 2) / bucket_rows) + 1)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[Rows]:
            for rows in _chunks(batches):
                t = Texts([r[1] for r in rows], window, k)
                ids, hashes = np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
                d = t.doc[t.anchors]
                yield Rows(t.grams[t.anchors], t.reach, ids[d], hashes[d], (t.anchors - t.first[d]).astype(np.int32))
        yield from _posted(found(), buckets, reaches)

    known = keyed.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    v = stored(_meeting(known.mapInArrow(anchors, POSTED), buckets, True), "repeats-anchors")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[Rows]:
            for rows in _chunks(batches):
                t = Texts([r[1] for r in rows], window, k)
                ids, hashes = np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
                at = np.concatenate([_places(r[3]) + t.first[i] for i, r in enumerate(rows)])
                # every occurrence of the same anchor and reach in the document stands behind its first one
                s = np.unique(np.concatenate([x[(x >= 0)] for x in (at - j for j in range(t.wide))]))
                s = s[t.whole[s]]
                s = np.unique(np.concatenate([s[(t.grams[s + j] == t.least[s]) & np.isin(s + j, at)] for j in range(t.wide)]))
                d = t.doc[s]
                yield Rows(t.span(s, window), t.check(s, window), ids[d], hashes[d], (s - t.first[d]).astype(np.int32))
        yield from _posted(found(), buckets, 0)

    v = v.withColumn("kind", F.when(F.col("whole"), "whole").otherwise("ends"))
    ends = _gathered(v.filter("kind = 'ends'"), "ends")
    step = known.join(ends, ["doc_id", "th"]).select("doc_id", "text", "th", "ends").mapInArrow(windows, POSTED)
    w = _meeting(step, buckets, False).withColumn("kind", F.lit("steps"))
    every = _gathered(v.filter("kind = 'whole'").union(w), "whole", "steps")

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc, text, whole, steps in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    words = (text or "").encode().split()
                    kept = words
                    if whole or steps:
                        kept = list(compress(words, ~removed(text, _places(whole), _places(steps), window, k)))
                    out.append((doc, len(words), len(words) - len(kept), b" ".join(kept).decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                                 names=["doc_id", "n_words", "n_removed", "kept"])

    return (keyed.join(every, ["doc_id", "th"], "left").select("doc_id", "text", "whole", "steps")
            .mapInArrow(final, "doc_id bigint, n_words bigint, n_removed bigint, kept string"))


def removed(text: str, whole: np.ndarray, steps: np.ndarray, window: int, k: int) -> np.ndarray:
    """Mask of the words in the maximal repeats: the reaches of whole matches and the matched windows,
    wherever the document repeats them."""
    t = Texts([text.encode()], window, k)
    mark = np.zeros(len(t.words) + 1, np.int32)
    alike = np.isin(t.anchors, whole)
    alike = np.isin(t.reach, t.reach[alike])
    np.add.at(mark, t.reach_from[alike], 1)
    np.add.at(mark, t.reach_to[alike], -1)
    if len(steps):
        all_windows = t.span(t.starts, window)
        same = t.starts[np.isin(all_windows, t.span(steps, window))]
        np.add.at(mark, same, 1)
        np.add.at(mark, same + window, -1)
    return np.cumsum(mark[:-1]) > 0
