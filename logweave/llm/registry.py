"""The queries of this subpackage over the tables, and SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import archive, classify, decontaminate, exact, html, near_dup, packing, paragraphs, tokens
from logweave.plans.materialize import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(texts(spark, sf_dir), shingle=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")


#: Every pair of different sets that share a shingle, and all that can be reached over links.
SQL["op1_minhash"] = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END)) AS g FROM d),
 k AS (SELECT doc_id, g, len(g) AS n, CASE WHEN len(g) > 0 THEN min(doc_id) OVER (PARTITION BY g) ELSE doc_id END AS class_id FROM s),
 u AS (SELECT doc_id, n, unnest(g) AS h FROM k WHERE doc_id = class_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
 l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r(node, root) AS (SELECT DISTINCT doc_id, doc_id FROM u UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
 m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
 SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(root, class_id) AS component_id, doc_id = coalesce(root, class_id) AS kept, class_id FROM k LEFT JOIN m ON node = class_id"""


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


SQL["op3_exact_dedup"] = r"""WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
 SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
 doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d"""


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op5_decontaminate"] = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 s AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
 g AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
 p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
 m AS (SELECT p.doc_id, p.i, g.n, g.item_id FROM (SELECT DISTINCT n FROM g) k JOIN p ON p.i + k.n - 1 <= len(p.w)
 JOIN g ON g.n = k.n AND g.gram = array_to_string(list_slice(p.w, p.i, p.i + k.n - 1), ' ')),
 h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "warc")
    archive.write_warc(table(spark, sf_dir, "pages"), folder)
    return archive.read_warc(spark, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op6_warc"] = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
 q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY sha256(h)) AS f FROM p)
 SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to FROM q"""


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))
