"""Hashes and hot anchors of substring dedup."""

import random

import numpy as np

from almanac.llm import substring_dedup as sd
from tests.llm.test_operators import brute_repeats, table


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_of_equal_polynomials_are_told_apart(spark):
    x = thue_morse(4096)
    y = x.translate(str.maketrans("ab", "ba"))
    assert len(np.unique(sd.word_hashes(f"{x} {y}".encode()), axis=0)) == 2
    head = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{head} {x}", "s"), (2, f"{head} {y}", "s"), (3, f"{head} {x} {y}", "s"), (4, f"{x} {y} " * 12, "s"), (5, f"{y} {x} " * 12, "s")]
    got = sorted((tuple(r) for r in sd.remove_repeats(table(spark, rows)).collect()), key=str)
    assert got == brute_repeats(rows) and {r[0]: r[2] for r in got}[2] == 0


def test_runs_of_two_words_in_thue_morse_order(spark):
    """Word sequences that a polynomial modulo a power of two takes for alike."""
    x = thue_morse(64)
    words = {"a": "alpha", "b": "beta"}
    rows = [(i, " ".join(words[c] for c in t), "s") for i, t in enumerate((x, x.translate(str.maketrans("ab", "ba")), x[::-1], x[16:], "ab" * 30, "a" * 40))]
    got = sorted((tuple(r) for r in sd.remove_repeats(table(spark, rows)).collect()), key=str)
    assert got == brute_repeats(rows)


def test_spans_hash_every_length_by_its_words():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 400).astype(sd.U)
    spans = sd.Spans(sd.mixed(words + sd.U(7)))
    for n in (1, 2, 5, 8, 13, 21):
        at = np.arange(len(words) - n + 1)
        by_words = {}
        for i, h in zip(at.tolist(), spans.of(at, n).tolist()):
            assert by_words.setdefault(tuple(words[i:i + n].tolist()), h) == h
        assert len(set(by_words.values())) == len(by_words)
    a = rng.integers(0, 300, 50)
    b = a + rng.integers(1, 22, 50)
    assert spans.between(a, b).tolist() == [int(spans.of(np.array([x]), int(y - x))[0]) for x, y in zip(a, b)]


def test_a_bucket_settles_as_it_streams(monkeypatch):
    monkeypatch.setattr(sd, "POSTINGS", 60)
    monkeypatch.setattr(sd, "STREAM_REACHES", 3)
    rng = random.Random(2)
    rows = [(rng.choice((1, 1, 1, 2, 3, rng.randrange(4, 40))), rng.randrange(8), rng.randrange(200), 0, 5) for _ in range(3_000)]
    bucket, out, most = sd.Bucket(True), [], 0
    for at in range(0, len(rows), 20):
        cols = zip(*rows[at:at + 20])
        got = bucket.add(sd.Rows(*(np.array(c, t) for c, (_, t) in zip(cols, sd.Rows.COLS))))
        most = max(most, sum(len(h.cols[0]) for h in bucket.held))
        out += [] if got is None else list(zip(*got))
    out += list(zip(*bucket.end()))
    assert most < 400  # the different postings, far fewer than came in
    by_key, smallest = {}, {}
    for key, reach, doc, _, _ in rows:
        by_key.setdefault(key, set()).add(reach)
        smallest[key, reach] = min(doc, smallest.get((key, reach), doc))
    whole = {int(d) for d, _, _, w in out if w}
    ends = {int(d) for d, _, _, w in out if not w}
    for key, reach, doc, _, _ in rows:
        if doc != smallest[key, reach]:
            assert doc in whole or doc in ends
        elif len(by_key[key]) > 1 and len({smallest[key, r] for r in by_key[key]}) > 1:
            assert doc in ends


def test_a_passage_in_every_document_over_many_tasks(spark):
    rng = random.Random(4)
    passage = " ".join(f"licence{i}" for i in range(40))
    rows = [(i, " ".join(f"x{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(30))) + f" {passage} " +
             " ".join(f"y{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(30))), "s") for i in range(600)]
    got = sorted((tuple(r) for r in sd.remove_repeats(table(spark, rows).repartition(40)).collect()), key=str)
    assert got == brute_repeats(rows)
