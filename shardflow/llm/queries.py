"""The thin queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardflow.llm import language_id, quality_model
from shardflow.llm.common import crc_of, read
from shardflow.llm.decontaminate import with_matches
from shardflow.llm.line_dedup import dedup_lines
from shardflow.llm.ngram_join import near_duplicates
from shardflow.llm.pieces import decode, encode, load_pieces
from shardflow.llm.quality_rules import filter_quality
from shardflow.llm.search import search
from shardflow.llm.source_audit import audit_sources
from shardflow.llm.substring_dedup import dedup_passages
from shardflow.llm.toxicity import score_toxicity
from shardflow.llm.url_filter import Rule, filter_urls
from shardflow.llm.warc import round_trip

def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measures and the verdict of the adaptive rules."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return filter_quality(docs, keep_text=False).select(*columns)


#: A SentencePiece model; it is read where the query is built, and only its pieces travel with the job.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number and a hash of its piece ids, and whether decoding gives the text back (by 128 bits
    of hashes, so that texts needn't move)."""
    pieces = load_pieces(PIECE_MODEL)
    both = lambda t: F.struct(F.xxhash64(t), F.xxhash64(F.lit(1), t))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", both(F.translate(F.coalesce(F.col("text"), F.lit("")), "\u2581", " ")).alias("plain"))
    encoded = decode(encode(docs, pieces, keep_text=False), pieces)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), (both(F.col("decoded")) == F.col("plain")).alias("round_trip"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 3-word shingles and its class at a Jaccard similarity of 0.9."""
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), n=3, percent=90).drop("text_hash")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [array_to_string(a, ' ')]
    ELSE [a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] FOR i IN range(1, len(a) - 1)] END) AS g FROM w
), e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.t = y.t AND x.doc_id <> y.doc_id
    AND 10 * x.n >= 9 * y.n AND 10 * y.n >= 9 * x.n
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))
), l AS MATERIALIZED (SELECT * FROM p),
r AS (
  SELECT doc_id AS d, doc_id AS c FROM s
  UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d WHERE r.c < l.b
)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE d = s.doc_id)::BIGINT AS component_id FROM s
"""


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected grade, tail probability and verdict."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.train(docs, read(spark, sf_dir, "labels"))
    return quality_model.score_quality(docs, model).select("doc_id", "expected_grade", "tail_prob", "kept")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it has, up to a fifth of the item's characters edited."""
    found = with_matches(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.distance", "m.first_word")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(crc_of("doc_id"), F.lit(4)) == 2
    trees = language_id.train(docs, ~held)
    return language_id.identify(docs.select("doc_id", "text"), trees).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.pmod(crc_of("doc_id"), F.lit(5)) == 0
    return score_toxicity(docs, read(spark, sf_dir, "labels"), ~held).select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose keys ten documents share."""
    cleaned = dedup_lines(read(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    left = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return cleaned.select("doc_id", "n_lines", "n_dropped", left.alias("kept_sha256"))


OP7_SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS n FROM s),
k AS (SELECT doc_id, n, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id
"""


URL_RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]
URL_GLOBS = ["*.ads-track.**", "*.doubleclick.**", "**/wp-admin/**", "**.exe"]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` with its host, path, rule and verdict."""
    return filter_urls(read(spark, sf_dir, "pages"), URL_RULES, URL_GLOBS).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT page_id, host, path, CASE
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/es/') THEN 'org/es/'
    END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE
  WHEN rule = 'example.com/en/7' THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN contains('.' || host, '.ads-track.') OR contains('.' || host, '.doubleclick.') OR contains(path, '/wp-admin/')
    OR ends_with('.' || host || path, '.exe') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""

def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives that are normalised, and its record as read back."""
    return round_trip(read(spark, sf_dir, "pages"), min_bytes=0)


# Base 32 has no SQL function: 40 groups of 5 bits are taken from the hex digest.
OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first FROM d),
e AS (SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + (('0x' || substr(h, 1 + i * 5 // 4, 1) || coalesce(nullif(substr(h, 2 + i * 5 // 4, 1), ''), '0'))::BIGINT
    // (1 << (3 - (i * 5) % 4)) % 32)::INT, 1) FOR i IN range(32)], '') AS digest FROM f)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM e
"""


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of each language against the language's other sources, and the terms it overuses."""
    return audit_sources(read(spark, sf_dir, "documents").select("text", "lang", "source"), min_docs=10, k=10)


OP11_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT doc_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d
), c AS MATERIALIZED (SELECT lang, source, w, count(*) AS n FROM t GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, w, count(*) AS total FROM t GROUP BY lang, w HAVING count(DISTINCT doc_id) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
x AS MATERIALIZED (SELECT g.lang, g.source, k.w, k.total, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.w = k.w),
z AS (SELECT lang, source, count(*) AS v, sum(n) AS big_n, sum(total) AS big_l FROM x GROUP BY lang, source),
p AS MATERIALIZED (
  SELECT x.lang, x.source, x.w, x.n, (1 + (1000000000::HUGEINT * (x.n + 2)) // (big_n + 2 * v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (x.total + 2)) // (big_l + 2 * v))::BIGINT AS q
  FROM x JOIN z ON z.lang = x.lang AND z.source = x.source
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY ALL
), u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', w, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q
), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=50)


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents
), c AS MATERIALIZED (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY doc_id, w),
d AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY doc_id),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark
), f AS (SELECT w, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM c, a GROUP BY w, docs),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // len) AS m FROM d, a),
s AS (
  SELECT q.item_id, c.doc_id, sum(f.weight * ((1000000000 * c.tf) // (1000 * c.tf + 20 * m.m)))::BIGINT AS score
  FROM q JOIN c ON c.w = q.w JOIN f ON f.w = q.w JOIN m ON m.doc_id = c.doc_id GROUP BY q.item_id, c.doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of passages of 400 bytes that are found elsewhere."""
    cleaned = dedup_passages(read(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_quality_rules": op1_quality_rules, "op2_pieces": op2_pieces, "op3_ngram_join": op3_ngram_join, "op4_quality_model": op4_quality_model, "op5_decontaminate": op5_decontaminate, "op6_language_id": op6_language_id, "op7_line_dedup": op7_line_dedup, "op8_toxicity": op8_toxicity, "op9_url_filter": op9_url_filter, "op10_warc": op10_warc, "op11_source_audit": op11_source_audit, "op12_search": op12_search, "op13_suffix_dedup": op13_suffix_dedup}
ORACLE = {"op3_ngram_join": OP3_SQL, "op7_line_dedup": OP7_SQL, "op9_url_filter": OP9_SQL, "op10_warc": OP10_SQL, "op11_source_audit": OP11_SQL, "op12_search": OP12_SQL}
