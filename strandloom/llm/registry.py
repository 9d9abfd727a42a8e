"""The ten operators' queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_search, html_extract, language_id, lattice_lm, media, mixing, near_dup, packing, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (host, path, verdict)
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_dom_sum_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op2_url_digest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_byte_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = warc.capture_history(_table(spark, sf_dir, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp")


def op6_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_search.top_k(_table(spark, sf_dir, "embeddings"))


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(mixing.token_table(_table(spark, sf_dir, "documents")), tokens="n_tokens")
    return mixing.realise(mixed).select("doc_id", "source", "n_tokens", "weight", "epochs", "copies", "block", "copy", "position")


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op10_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(_table(spark, sf_dir, "documents"))


def media_payload_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can tell: those of the payload, read back from the media."""
    return op8_progressive_jpeg(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def word_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can tell: the unigram base."""
    scored = op10_subword_lattice(spark, sf_dir)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    found = dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))
    return found | {"media_payload_digests": media_payload_digests, "word_base_scores": word_base_scores}


_OP2_SQL = """
WITH parts AS (
  SELECT page_id,
    CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), cut AS (
  SELECT page_id, regexp_extract(rest, '^[^?#]*') AS body FROM parts
), hp AS (
  SELECT page_id,
    translate(regexp_extract(body, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(body, length(regexp_extract(body, '^[^/]*')) + 1) AS path
  FROM cut
), rules(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), ranked AS (
  SELECT h.page_id, h.host, h.path, r.rhost || r.rpath AS rule, r.rverdict,
    row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS rn
  FROM hp h LEFT JOIN rules r
    ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM ranked WHERE rn = 1
"""


#: Words of a text in SQL: A-Z lower-cased, cut at blank and 0x09-0x0D.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""


def _crc32_sql(blob: str) -> str:
    """CRC-32 of a non-empty blob, bit by bit."""
    bit = f"((CAST('0x' || substr(hex({blob}), 1 + 2 * (i // 8), 2) AS BIGINT) >> (i % 8)) & 1)"
    bits = f"list_transform(range(8 * octet_length({blob})), lambda i: {bit})"
    return f"xor(list_reduce(list_concat([4294967295], {bits}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


_OP3_SQL = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM worded
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * common >= 75 * (x.n + y.n - common)
), edges AS (
  SELECT u, v FROM links UNION SELECT v, u FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.v FROM reach r JOIN edges e ON e.u = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


_MEDIA_SQL = f"""
WITH raw AS (
  SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents
), padded AS (
  SELECT doc_id, octet_length(t) AS n_bytes, t || unhex(repeat('00', CAST(greatest(64, 64 * ceil(octet_length(t) / 64)) - octet_length(t) AS BIGINT))) AS p FROM raw
), tails AS (
  SELECT *, unhex(right(hex(p), 128)) AS tail FROM padded
)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(octet_length(p) AS BIGINT) AS payload_bytes, sha256(p) AS payload_sha256, CAST({_crc32_sql("tail")} AS BIGINT) AS tail_crc32
FROM tails
"""


_BASE_SQL = f"""
WITH docs AS (
  SELECT doc_id, {_crc32_sql("encode(CAST(doc_id AS VARCHAR))")} % 7 = 2 AS held_out, list_concat({_WORDS}, [chr(10)]) AS w FROM documents
), tokens AS (
  SELECT doc_id, held_out, unnest(w) AS t FROM docs
), counts AS (
  SELECT t AS word, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY t
), whole AS (
  SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM counts
)
SELECT doc_id, held_out, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(c) AS BIGINT) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
  round(sum(log10((coalesce(c, 0) + 1.0) / (n + v + 1))), 4) AS base_score
FROM tokens CROSS JOIN whole LEFT JOIN counts ON word = t GROUP BY doc_id, held_out
"""


_OP5_SQL = """
WITH raw AS (
  SELECT page_id, lower(coalesce(url, '')) AS u, encode(coalesce(html, '')) AS payload FROM pages
), hashed AS (
  SELECT page_id, u, octet_length(payload) AS payload_bytes, sha1(payload) AS hex,
    min(page_id) OVER (PARTITION BY payload) AS first,
    regexp_matches(u, '^[a-z][a-z0-9+.-]*://') AS absolute,
    regexp_extract(u, '(?s)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)(.*)$', 1) AS host,
    regexp_extract(u, '(?s)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)(.*)$', 2) AS rest
  FROM raw
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to,
  CASE WHEN absolute THEN array_to_string(list_reverse(string_split(split_part(host, ':', 1), '.')), ',')
      || CASE WHEN strpos(host, ':') > 0 AND split_part(host, ':', 2) <> '' THEN ':' || substr(host, strpos(host, ':') + 1) ELSE '' END
      || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END
    ELSE u END AS urlkey,
  '20240101000000' AS timestamp
FROM hashed
"""


_OP6_SQL = """
WITH parts AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i, len(embedding) AS n
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), ints AS (
  SELECT vec_id, n, i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM parts
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(sum(q.v * d.v) AS BIGINT) AS score
  FROM ints q JOIN ints d ON q.i = d.i AND q.n = d.n AND q.vec_id <> d.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY 1, 2
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    more = {"op3_minhash_hamming": _OP3_SQL, "media_payload_digests": _MEDIA_SQL, "word_base_scores": _BASE_SQL}
    return more | {"op2_url_digest_filter": _OP2_SQL, "op5_warc_index_merge": _OP5_SQL, "op6_cover_tree_topk": _OP6_SQL}
