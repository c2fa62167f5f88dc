"""Queries op1 to op10 with production parameters, over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    out = exact_dedup(_read(spark, sf_dir, "documents"), hash_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


OP1_SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept,
       text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""

URL_RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "block"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls, rule_table

    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH rules(host, path, verdict) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rest AS (
  SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (
  SELECT page_id, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule,
         arg_max(rules.verdict, length(rules.host || rules.path)) AS verdict
  FROM parts JOIN rules ON (parts.host = rules.host OR ends_with(parts.host, '.' || rules.host)) AND starts_with(parts.path, rules.path)
  GROUP BY page_id)
SELECT parts.page_id, parts.host, parts.path, fits.rule, coalesce(fits.verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (page_id)
"""

#: Target weights of the sources; every other source together weighs 1.
SOURCE_WEIGHTS = {"src0": 4.0} | {f"src{i}": 1.0 for i in range(1, 20)}
MIX_SEED = 17


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_read(spark, sf_dir, "documents"), SOURCE_WEIGHTS, rest_weight=1.0, seed=MIX_SEED)


OP10_SQL = """
WITH w(s, weight) AS (
  SELECT 'src' || i, CASE WHEN i = 0 THEN 4.0 ELSE 1.0 END::DOUBLE FROM range(0, 20) t(i)
  UNION ALL SELECT '*', 1.0::DOUBLE),
d AS (
  SELECT documents.*, coalesce(w.s, '*') AS s,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '-')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents LEFT JOIN w ON w.s = documents.source),
sizes AS (SELECT s, count(*) AS n FROM d GROUP BY s),
rates AS (
  SELECT s, (SELECT sum(n) FROM sizes) * weight / (SELECT sum(weight) FROM sizes JOIN w USING (s)) / n AS rate
  FROM sizes JOIN w USING (s)),
ks AS (SELECT s, rate, unnest(range(0, (rate + 12 * sqrt(rate) + 41)::BIGINT)) AS k FROM rates WHERE rate > 0),
pmf AS (SELECT s, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM ks),
cdf AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM pmf),
counts AS (SELECT d.doc_id, d.s, count(*) AS copies FROM d JOIN cdf ON d.s = cdf.s AND cdf.c <= d.u GROUP BY ALL),
copied AS (SELECT d.*, counts.copies::INTEGER AS copies FROM d JOIN counts ON d.doc_id IS NOT DISTINCT FROM counts.doc_id AND d.s = counts.s)
SELECT doc_id, text, lang, source, n_chars, copies, copy_no::INTEGER AS copy_no,
       md5('order:17:' || coalesce(doc_id::VARCHAR, '-') || ':' || copy_no) AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy_no FROM copied)
"""


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are; they are read in place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_topk import vector_topk

    return vector_topk(_read(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    pieces = pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


TOKEN_LIMIT = 512


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    counts = count_tokens(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    out = classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runindex import remove_repeats

    out = remove_repeats(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS place
  FROM documents),
starts AS (SELECT place, h, unnest(range(strlen(h) // 2 - 99)) AS start FROM d),
windows AS (SELECT place, start, md5_number(substr(h, 2 * start + 1, 200)) AS w FROM starts),
firsts AS (SELECT w, min(place * 4294967296 + start) AS first FROM windows GROUP BY w HAVING count(*) > 1),
later AS (SELECT place, start FROM windows JOIN firsts USING (w) WHERE place * 4294967296 + start > first),
marked AS (
  SELECT place, start, CASE WHEN start - lag(start) OVER (PARTITION BY place ORDER BY start) <= 100 THEN 0 ELSE 1 END AS opens
  FROM later),
numbered AS (SELECT place, start, sum(opens) OVER (PARTITION BY place ORDER BY start) AS run FROM marked),
spans AS (SELECT place, min(start) AS b, max(start) + 100 AS e FROM numbered GROUP BY place, run),
gaps AS (
  SELECT place, coalesce(lag(e) OVER (PARTITION BY place ORDER BY b), 0) AS b, b AS e FROM spans
  UNION ALL SELECT place, max(e), strlen(any_value(h)) // 2 FROM spans JOIN d USING (place) GROUP BY place),
pieces AS (SELECT place, string_agg(substr(h, 2 * b + 1, 2 * (e - b)), '' ORDER BY b) AS kept FROM gaps JOIN d USING (place) GROUP BY place),
sums AS (SELECT place, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY place)
SELECT doc_id, strlen(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN sums USING (place) LEFT JOIN pieces USING (place)
"""


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    out = near_duplicates(_read(spark, sf_dir, "documents"), words=2, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id,
         CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
              ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM d),
forms AS (SELECT dense_rank() OVER (ORDER BY list_sort(s)) AS form, doc_id, s FROM sets),
texts AS (SELECT form, any_value(s) AS s, len(any_value(s)) AS n, min(doc_id) AS doc_id FROM forms WHERE len(s) > 0 GROUP BY form),
items AS (SELECT form, n, unnest(s) AS x FROM texts),
links AS (
  SELECT a.form AS p, b.form AS q
  FROM items a JOIN items b ON a.x = b.x AND a.form < b.form AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.form, b.form, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT p, q FROM links UNION ALL SELECT q, p FROM links),
reached AS (
  SELECT form AS root, form FROM texts
  UNION SELECT reached.root, edges.q FROM reached JOIN edges ON reached.form = edges.p),
roots AS (SELECT root AS form, min(doc_id) AS component_id FROM reached JOIN texts USING (form) GROUP BY root)
SELECT forms.doc_id, len(forms.s) AS n_shingles, coalesce(component_id, forms.doc_id) AS component_id,
       forms.doc_id = coalesce(component_id, forms.doc_id) AS kept
FROM forms LEFT JOIN roots USING (form)
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_folder, read_archives, write_archives

    folder = archive_folder(spark)
    index = write_archives(_read(spark, sf_dir, "pages"), folder)
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op2_vector_topk": OP2_SQL,
        "op6_suffix_repeats": OP6_SQL,
        "op7_minhash": OP7_SQL,
        "op9_warc": OP9_SQL,
        "op8_url_filter": OP8_SQL,
        "op10_mix_sources": OP10_SQL,
    }
