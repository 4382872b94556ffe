"""The thin queries over the operators: production parameters, whole tables, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents_of


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(documents_of(spark, sf_dir), 2048, vocabulary(), 0)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .neighbours import nearest

    return nearest(documents_of(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import span_table

    return span_table(documents_of(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(documents_of(spark, sf_dir), documents_of(spark, sf_dir, "labels"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents_of(spark, sf_dir), shingle=3, radius=2)


#: The rules (host, path, verdict) that op7 applies.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(documents_of(spark, sf_dir), documents_of(spark, sf_dir, "labels"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import judge

    return judge(documents_of(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(documents_of(spark, sf_dir), documents_of(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeated

    return remove_repeated(documents_of(spark, sf_dir), 200).drop("kept")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_table

    return token_table(documents_of(spark, sf_dir), vocabulary(), 2)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_nearest_neighbours, op3_personal_data, op4_quality_classifier, op5_simhash_near_dedup, op6_toxicity, op7_url_filters, op8_suffix_dedup, op9_token_files, op10_decontamination)}

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op7_url_filters": f"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(h, p, v) AS (VALUES {_RULE_ROWS}),
fits AS (
  SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC) AS k
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM fits WHERE k = 1) f USING (r)""",
    "op8_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (
  SELECT r, p, md5_number(substr(x, 2 * p + 1, 400)) AS h
  FROM (SELECT r, x, unnest(range(0, length(x) // 2 - 199)) AS p FROM d WHERE length(x) >= 400)),
hits AS (SELECT r, p FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
opened AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM hits),
island AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM opened),
span AS (SELECT r, min(p) AS s, max(p) + 200 AS e FROM island GROUP BY r, k),
kept AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS was FROM span),
cut AS (
  SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * was + 1, 2 * (s - was)), '' ORDER BY s) AS y, max(e) AS last
  FROM kept JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(y, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)""",
    "op10_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s + 1 : s + least(10, len(w))], ' ') AS t
  FROM (SELECT *, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (
  SELECT r, n, s, array_to_string(w[s + 1 : s + n], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d JOIN sizes ON len(w) >= n)),
hits AS (SELECT r, s, runs.n, item_id FROM runs JOIN win USING (n, t)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN ids USING (r)""",
}
