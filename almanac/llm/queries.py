"""The registered queries opN_<name> and their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, exact_dedup, html_text, infill, mixing, pii, sharding, simhash, substring_dedup, token_counts, topk, toxicity
from .common import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file of the installed public tokenizers; any path of a like file does."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    out = bpe.transcode(table(spark, sf, "documents"), tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op2_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
                  AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d""")
def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf, "documents"))


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(table(spark, sf, "documents"), shards=16)


@query("op5_topk", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op5_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.search(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
                                              F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query("op9_mixing", r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 12))::UBIGINT::BIGINT AS key
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w
  FROM base GROUP BY source),
lev AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS pool FROM per),
lev2 AS (
  SELECT *, (pool - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM lev),
com AS (SELECT arg_min(level, cap / w) AS common FROM lev2 WHERE cap > level * w),
tgt AS (SELECT source, source_size, CASE WHEN cap > common * w THEN common * w ELSE cap END AS target FROM lev2, com),
need AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS certain,
         greatest(0.0, target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size) AS need
  FROM tgt),
lots AS (SELECT source, key, sum(size) AS n FROM base WHERE size > 0 GROUP BY ALL),
run AS (
  SELECT l.source, l.key, l.n, t.need, sum(l.n) OVER (PARTITION BY l.source ORDER BY l.key) AS upto
  FROM lots l JOIN need t ON l.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT source, max(CASE WHEN upto <= need THEN key END) AS cut_key,
         max(need) - coalesce(max(CASE WHEN upto <= need THEN upto END), 0) AS gap
  FROM run GROUP BY source),
fill AS (
  SELECT r.source, arg_min(r.key, {'a': abs(c.gap - r.n), 'b': r.key}) AS fill_key
  FROM run r JOIN cut c ON r.source IS NOT DISTINCT FROM c.source
  WHERE r.key > coalesce(c.cut_key, -1) AND r.n < 2 * c.gap GROUP BY r.source)
SELECT b.doc_id, b.size, t.source_size, t.target,
       (b.size * (t.certain + CASE WHEN b.size > 0 AND (b.key <= coalesce(c.cut_key, -1) OR b.key = f.fill_key) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM base b JOIN need t ON b.source IS NOT DISTINCT FROM t.source
LEFT JOIN cut c ON b.source IS NOT DISTINCT FROM c.source
LEFT JOIN fill f ON b.source IS NOT DISTINCT FROM f.source""")
def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return (mixing.mix(table(spark, sf, "documents"), total_share=1.5, max_copies=2.0, weights=(3, 1, 2))
            .select("doc_id", "size", "source_size", "target", "taken"))


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf, "documents"), shingle=3, max_bits=3, seed=42)
    return out.select("doc_id", "fingerprint", "component_id")


@query("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of every whole text, and after three edits of it: a passage written over with capitals, a cut,
    an insertion; all placed by the document's id."""
    n, at = F.length(F.coalesce("text", F.lit(""))), F.pmod(F.xxhash64("doc_id"), F.lit(1000)) / 1000
    place = lambda x: F.floor(n * x).cast("bigint")
    edit = lambda start, length, new: F.struct(start.alias("start"), F.lit(length).cast("bigint").alias("length"), new.alias("replacement"))
    first = place(at)
    edits = F.array(edit(first, 20, F.upper(F.substring("text", first.cast("int") + 1, F.lit(20)))),
                    edit(place(1 - at), 9, F.lit("")), edit(place(at / 2), 0, F.lit(" it's edited\n\n ")))
    return token_counts.counts(table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), edits)


@query("op6_pii")
def op6_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.surrogates(table(spark, sf, "documents"), key=b"almanac surrogate key")


@query("op11_conversations")
def op11_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.repair(*conversations.damaged(table(spark, sf, "conversations")))


@query("op12_html_text")
def op12_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


@query("op13_infill", r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok,
         list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), i, 8))::UBIGINT) AS h
  FROM documents),
c AS (
  SELECT *, len(tok)::BIGINT AS n, least(h[1] % (len(tok) + 1), h[2] % (len(tok) + 1)) AS a, greatest(h[1] % (len(tok) + 1), h[2] % (len(tok) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
p AS (
  SELECT doc_id, n, form, text, array_to_string(tok[1:a], '') AS prefix, array_to_string(tok[a + 1:b], '') AS middle,
         array_to_string(tok[b + 1:n], '') AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p""")
def op13_infill(spark: SparkSession, sf: str) -> DataFrame:
    out = infill.restore(infill.transform(table(spark, sf, "documents"), seed=42, rate=50, spm=80), texts=False)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
