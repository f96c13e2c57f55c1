"""The registered queries of this subpackage, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, histogram_sort, near_dedup, packing, passages, perspectives, token_prefixes, topk_search, toxic_spans, url_filters
from .shared import workers_can_import

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary_file(name: str) -> str:
    """Where the public tokenizers lie on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_can_import(spark)
    # rows hold whole texts, so few of them go to Python at once
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(table(spark, sf_dir, "documents"), words=50, identity=0.8)
    return found.select(
        F.col("doc").alias("doc_id"), "start", "end", F.col("other").alias("other_doc_id"), "other_start", "other_end", "matched", "identity"
    )


#: Rules of the url query: decision, host, path prefix.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op2_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op3_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort.digest(table(spark, sf_dir, "documents"), shards=24)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.digest(packing.pack(docs, vocabulary_file("byte_bpe_50k.json"), vocabulary_file("byte_bpe_50k.tiktoken")))


def op6_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op7_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_prefixes.token_prefixes(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))
    return counts.selectExpr("id as doc_id", "n_bytes", "n_tokens", "n_tokens > 4096 as over_limit")


def op8_chosen_path_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, size=5).withColumnRenamed("doc", "doc_id")


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op10_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_spans.digest(toxic_spans.toxic_spans(docs, toxic_spans.train(docs, table(spark, sf_dir, "labels"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_collinear_passages,
        op2_redirect_url_filter,
        op3_histogram_sort_shards,
        op4_benchmark_decontamination,
        op5_bounded_space_packing,
        op6_threshold_top_k,
        op7_prefix_token_counts,
        op8_chosen_path_near_duplicates,
        op9_perspective_rotation,
        op10_crf_toxicity,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_benchmark_decontamination": rf"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
wins AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, grams.n, item FROM grams JOIN wins ON wins.g = grams.g AND wins.n = grams.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    # the pages have neither redirects nor canonical links, so aliases are the urls of one canonical spelling
    "op2_redirect_url_filter": rf"""
WITH u AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '^[^?#]*(\?[^#]*)', 1), '') AS q FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(q, '([?&])(?:utm_[a-z]*|ref|fbclid|gclid)=[^&]*', '\1', 'g'), '&+', '&', 'g') AS q1 FROM u),
k AS (SELECT page_id, host, path, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(?:www\.|m\.)', '') || regexp_replace(path, '/$', '')
    || regexp_replace(regexp_replace(q1, '^\?&', '?'), '[?&]$', '') END AS key FROM q),
r AS (SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'allow www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'block example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'block net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'block net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'allow com/' END AS found FROM k),
bad AS (SELECT DISTINCT key FROM r WHERE starts_with(found, 'block'))
SELECT page_id, host, path, substr(found, 7) AS rule,
  CASE WHEN found IS NOT NULL THEN substr(found, 1, 5) WHEN key IN (SELECT key FROM bad WHERE key IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN found IS NOT NULL THEN 'rule' WHEN key IN (SELECT key FROM bad WHERE key IS NOT NULL) THEN 'alias' ELSE 'default' END AS because
FROM r""",
    "op6_threshold_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_perspective_rotation": r"""
WITH t AS (SELECT conv_id, turn, CASE WHEN coalesce(trim(role), '') = '' THEN 'unknown' ELSE role END AS speaker,
    regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<\\|\1|>', 'g') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (SELECT t.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
    FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM s),
r AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM h),
o AS (SELECT *, row_number() OVER w - 1 AS seq, sum(length(rendered)) OVER (w ROWS UNBOUNDED PRECEDING) AS e FROM r
    WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, md5(text)))
SELECT conv_id, perspective, seq, turn, role, name, rendered, CAST(e - length(rendered) AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end,
  CAST(CASE WHEN role = 'assistant' THEN e - length(rendered) + length(head) ELSE e END AS BIGINT) AS mask_start, CAST(e AS BIGINT) AS mask_end, role <> 'assistant' AS masked
FROM o""",
    "op8_chosen_path_near_duplicates": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM low LEFT JOIN n USING (doc_id)""",
}
