"""Stages of the pipeline against brute force, each on its own input."""

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from almanac.llm import mixing, queries, toxicity
from tests.conftest import SF
from tests.llm.test_operators import brute_groups, brute_simhash, lowered


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_stages_follow_each_other(spark):
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    matcher, columns = model.matcher(), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        out = stage(spark, docs, SF).cache()
        ids = sorted(r.doc_id for r in out.collect())
        if name == "toxicity":
            want = [i for i, t, _ in rows if toxicity.probability(toxicity.evidence(t, model, matcher), model) < 0.5]
        elif name == "exact_dedup":
            want = list({lowered(t): i for i, t, _ in sorted(rows)}.values())
        elif name == "simhash":
            groups = brute_groups({rows[k][0]: v for k, v in brute_simhash(rows).items()})
            want = [i for i, c in groups.items() if i == c]
        elif name == "mixing":
            want = [r.doc_id for r in mixing.mix(docs).collect() for _ in range(r.copies)]
        else:
            t = Tokenizer.from_file(queries.tokenizer_path())
            want = [i for i, _, _ in rows]
            texts = {i: t.encode(x, add_special_tokens=False).ids for i, x, _ in rows}
            assert all(np.frombuffer(r.ids, "<u4").tolist() == texts[r.doc_id] for r in out.collect())
        assert ids == sorted(want), name
        if name != "bpe":
            assert out.columns == columns
        docs = out


@pytest.mark.parametrize("name", ["op1_bpe", "op3_token_counts", "op4_sharding", "op6_pii", "op8_toxicity", "op10_simhash"])
def test_queries_cover_their_table(spark, name):
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


CLASH = ["row", "id", "key", "digest", "size", "fp", "bucket", "th", "rep", "link", "again", "taken", "copies", "score", "ids"]


def corpus(spark, path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    spark.createDataFrame([(i, t, "en", s, len(t or ""), *["x"] * len(CLASH)) for i, t, s in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("zorkel" in (t or ""))) for i, t, _ in rows if i is not None], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{path}/labels.parquet")


def test_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    vocab = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(vocab, 40)) + (" zorkelt" if i % 9 == 0 else ""), ["a", "b", None][i % 3]) for i in range(240)]
    rows += [(1000 + i, rows[1][1], "a") for i in range(5)] + [(2000, rows[2][1].upper(), "b"), (None, "an only text without an id", "a"), (3000, None, None),
                                                              (3001, "", "a"), (3002, " ".join(rng.choice(vocab, 60_000)), "b"), (5, rows[5][1], "b")]
    corpus(spark, str(tmp_path), rows)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert not ids & {i for i, t, _ in rows if "zorkel" in (t or "")}
    assert not ids & {1, 1000, 1001, 1002, 1003, 2} and not {3000, 3001} <= ids
    assert all(r.n_tokens * 4 == len(r.ids) for r in out) and 100 < len(ids) <= 216


def test_an_empty_corpus(spark, tmp_path):
    corpus(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
