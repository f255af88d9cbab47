"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprint, lattice_lm, lexical, mixing, packing, quality, simhash, token_files, topk, toxicity, url_rules, whitening
from .shared import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def toxicity_folds(doc_id: Column) -> Column:
    """Documents whose labels toxicity may be learned from."""
    return remainder(doc_id, 4) != 2


def quality_folds(doc_id: Column) -> Column:
    """Documents whose labels quality may be learned from."""
    return remainder(doc_id, 5) != 0


@register("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                     toxicity_folds(F.col("doc_id")), threshold=0.3)
    return scored.select("doc_id", (~toxicity_folds(F.col("doc_id"))).alias("held_out"), "score", "predicted")


@register("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_files.token_store(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(spark, store).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _fits(verdict: str, rule: str) -> str:
    host, _, path = rule.partition("/")
    return (f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') "
            f"THEN {{'rule': '{rule}', 'verdict': '{verdict}'}}")


@register("op3_url_rules", f"""
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict FROM (
  SELECT *, CASE {" ".join(_fits(v, r) for v, r in sorted(URL_RULES, key=lambda x: -len(x[1])))} END AS hit FROM (
    SELECT page_id,
           translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
    FROM pages))""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@register("op4_mixing", """
WITH k0 AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 12))::BIGINT AS key
  FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source, key) AS nth FROM k0),
d AS (
  SELECT doc_id, source, size, CASE WHEN nth = 1 THEN key ELSE ('0x' || substr(md5(key || ' ' || nth), 1, 12))::BIGINT END AS key
  FROM n),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS w FROM s),
r AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER p, 0) AS room,
         sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS rest_w
  FROM w WINDOW p AS (ORDER BY source_size * (6 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, room * w > 3 * source_size * rest_w AS capped FROM r),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE
    (w * (SELECT max(room) FROM c WHERE NOT capped))::DOUBLE / (SELECT max(rest_w) FROM c WHERE NOT capped)::DOUBLE END AS target
  FROM c),
b AS (
  SELECT *, target - whole * source_size AS budget FROM (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t)),
k AS (SELECT source, key, sum(size)::BIGINT AS inside FROM d GROUP BY source, key),
u AS (SELECT *, sum(inside) OVER (PARTITION BY source ORDER BY key) AS reached FROM k),
e AS (
  SELECT b.source, min_by(CASE WHEN reached - budget < budget - (reached - inside) THEN key + 1 ELSE key END, key) AS bound
  FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source WHERE budget > 0 AND reached >= budget GROUP BY b.source)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN key < coalesce(bound, 0) THEN 1 ELSE 0 END) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)


@register("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=1,
                                    window=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@register("op6_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT row_number() OVER () AS q, * FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT q.q, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT * FROM (
  SELECT query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
WHERE rank <= 10""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@register("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                   quality_folds(F.col("doc_id")), threshold=0.3)
    return scored.select("doc_id", (~quality_folds(F.col("doc_id"))).alias("held_out"), "score", "predicted")


@register("op8_fingerprint")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints_and_edits(table(spark, sf_dir, "documents"))


@register("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register("op10_lattice_lm")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lattice_lm.score_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"),
                                        learns=remainder(F.col("doc_id"), 10) != 0)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@register("op11_lexical", f"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS terms FROM documents),
c AS (SELECT count(*) AS total_docs, sum(len(terms))::BIGINT AS total_terms FROM d WHERE len(terms) > 0),
f AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM d) GROUP BY d, term),
w AS (
  SELECT term, floor(1000 * ln((2 * total_docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM f GROUP BY term), c),
q AS (
  SELECT i, item_id, term, count(*) AS many FROM (
    SELECT i, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark))
  GROUP BY i, item_id, term),
s AS (
  SELECT i, item_id, d, doc_id, sum(many * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM (SELECT *, 100 - 75 + ((75 * len(terms) * total_docs) // total_terms) AS m FROM d, c WHERE len(terms) > 0)
  JOIN f USING (d) JOIN w USING (term) JOIN q USING (term) GROUP BY i, item_id, d, doc_id)
SELECT * FROM (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM s WHERE score > 0)
WHERE rank <= 10""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@register("op12_exact_dedup", """
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
             AS text_sha256 FROM documents)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@register("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"), most=32).withColumn(
        "deviation", F.col("deviation").cast("long"))
