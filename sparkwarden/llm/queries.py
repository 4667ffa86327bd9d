"""The operators of this subpackage as registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, language, license_scan, merkle, near_dedup, packing, pii, prefix_trie, quality, secret_scan, twins
from .blocks import share
from .topk import exact_top_k
from .url_rules import UrlRule, filter_urls

#: The rules of the contract.
URL_RULES = [
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
]


def ranks_path() -> str:
    """The rank file that the contract names; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def words_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    labels = labels.filter(~share(F.col("doc_id"), 1, 3)).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return quality.score_quality(table(spark, sf_dir, "documents"), labels, share(F.col("doc_id"), 1, 3))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = share(F.col("doc_id"), 2, 4)
    return language.identify(table(spark, sf_dir, "documents"), ~held_out & F.col("doc_id").isNotNull(), held_out)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks_path())


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = prefix_trie.turn_lists(table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    return prefix_trie.trie(prefix_trie.regrafted(lists, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, 5))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"), share(F.col("doc_id"), 0, 3))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), words_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_personal_data": op3_personal_data,
    "op4_quality_fm": op4_quality_fm,
    "op5_language_id": op5_language_id,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_decontamination": op7_decontamination,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_secret_scan": op9_secret_scan,
    "op10_url_filter": op10_url_filter,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_packing": op13_packing,
}

ORACLES: dict[str, str] = {
    "op11_prefix_trie": twins.TRIE,
    "op12_merkle_manifest": twins.MERKLE,
    "op2_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingles
  FROM words
), each AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 85 * (len(x.shingles) + len(y.shingles) - n)
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN low USING (doc_id)
""",
    "op8_exact_top_k": """
WITH parts AS (
  SELECT vec_id, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x, generate_subscripts(embedding, 1) AS dim
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM parts q JOIN parts c ON q.dim = c.dim AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
  GROUP BY q.vec_id, c.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op10_url_filter": r"""
WITH rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, row_number() OVER () AS row_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), fits AS (
  SELECT p.row_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.row_id
), base AS (
  SELECT p.*, f.rule, f.verdict, list_filter(list_distinct(list_concat(
      list_transform(list_reverse(string_split(host, '.')), lambda x, i: 'h' || least(i - 1, 3) || ':' || x),
      list_transform(regexp_split_to_array(path, '[/._-]+'), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g')))),
    lambda x: NOT regexp_full_match(x, '[hp0-9]+:') AND NOT list_contains(['h0:com', 'h0:net', 'h1:example', 'h2:www', 'p:en', 'p:es', 'p:fr'], x)) AS tokens
  FROM parts p LEFT JOIN fits f USING (row_id)
), held AS (SELECT row_id, verdict, unnest(tokens) AS t FROM base WHERE rule IS NOT NULL
), least_count AS (SELECT ceil(0.002 * count(*)) AS n FROM base WHERE rule IS NOT NULL
), combos AS (
  SELECT [t] AS needs, verdict FROM held
  UNION ALL SELECT [a.t, b.t], a.verdict FROM held a JOIN held b ON a.row_id = b.row_id AND a.t < b.t
  UNION ALL SELECT [a.t, b.t, c.t], a.verdict FROM held a JOIN held b ON a.row_id = b.row_id AND a.t < b.t JOIN held c ON c.row_id = a.row_id AND b.t < c.t
), counted AS (SELECT needs, verdict, count(*) AS support, sum(count(*)) OVER (PARTITION BY needs) AS total FROM combos GROUP BY needs, verdict
), strong AS (
  SELECT needs, verdict, support, support / total AS confidence FROM counted, least_count WHERE support >= n AND support / total >= 0.9
), mined AS (
  SELECT s.* FROM strong s WHERE NOT EXISTS (SELECT 1 FROM strong w WHERE w.verdict = s.verdict AND len(w.needs) < len(s.needs)
    AND list_has_all(s.needs, w.needs) AND w.confidence >= s.confidence)
), found AS (
  SELECT b.row_id, arg_max(m.verdict, [m.confidence, m.support, (m.verdict = 'block')::INT]) AS verdict
  FROM base b JOIN mined m ON b.rule IS NULL AND list_has_all(b.tokens, m.needs) GROUP BY b.row_id
)
SELECT b.page_id, b.host, b.path, b.rule, coalesce(b.verdict, f.verdict, 'allow') AS verdict, f.verdict IS NOT NULL AS mined
FROM base b LEFT JOIN found f USING (row_id)
""",
}
