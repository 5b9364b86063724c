"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_trie, fingerprints, html_blocks, merkle_manifest, ngram_join, packing, pii, quality, sharding, suffix_array, topk, unigram_lm, whitening
from .common import small_batches, table

#: Where the vocabulary file lies; a parameter, for the files are never copied.
VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def _joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    base = pii.KINDS[:4]
    found = table(spark, sf_dir, "documents").select("doc_id", pii.pii_spans("text").alias("s"))
    counts = {f"n_{k}": F.size(F.filter("s", functools.partial(lambda k, x: x["kind"] == k, k))).cast("long") for k in base}
    first = F.filter("s", lambda x: x["kind"].isin(*base))
    return found.select("doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(_joined(first).cast("binary"), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"))


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = spark.sparkContext.broadcast(html_blocks.trained())  # of fixed size
    return table(spark, sf_dir, "pages").select("page_id", "url", html_blocks.extracted("html", model).alias("x")).select("page_id", "url", "x.*")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    return sharding.shard(docs, 8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copy_key")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), 4096))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, forest).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
), k AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM k WHERE n <= 5
"""


def op8_unigram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_lm.lm_scores(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.passage_rows(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", bpe_trie.bpe_digests("text", public_tokenizers.path(VOCABULARY)).alias("e")).select("doc_id", "e.*")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as leaves of one tree; every row's proof is folded, for every other one (by checksum) from a text without its line ends."""
    proven = merkle_manifest.manifest(merkle_manifest.dataset_leaves(table(spark, sf_dir, "documents")))
    out = proven.withColumn("folded_root", merkle_manifest.folded(F.col("claim"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(x: str) -> str:
    return f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(map(_field_sql, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


def _climb_sql(leaves: str, levels: str) -> str:
    """levels: g, level, slot, n, digest of all nodes over leaves (g, slot, n, digest)."""
    return f"""{levels} AS (
  SELECT g, 0 AS level, slot, n, digest FROM {leaves}
  UNION ALL
  SELECT g, level + 1, slot // 3, (min(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY slot)) FROM {levels} WHERE n > 1 GROUP BY g, level, slot // 3
)"""


def _proof_sql(leaves: str, levels: str) -> str:
    """g, slot and p: the siblings 'left|right' of each level, joined by commas."""
    return f"""(
  SELECT g, slot, string_agg(a || '|' || b, ',' ORDER BY level) AS p FROM (
    SELECT x.g, x.slot, t.level, coalesce(string_agg(t.digest, '' ORDER BY t.slot) FILTER (t.slot < x.slot // (3 ** t.level)::BIGINT), '') AS a, coalesce(string_agg(t.digest, '' ORDER BY t.slot) FILTER (t.slot > x.slot // (3 ** t.level)::BIGINT), '') AS b
    FROM {leaves} x JOIN {levels} t ON t.g = x.g AND t.n > 1 AND t.slot // 3 = x.slot // (3 ** (t.level + 1))::BIGINT
    GROUP BY ALL) GROUP BY ALL)"""


#: The checksum bit by bit; 3988292384 is its polynomial.
CRC32_SQL = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda r, c: list_reduce([xor(r, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))), 4294967295::BIGINT), 4294967295::BIGINT)"
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN {CRC32_SQL} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS altered FROM documents
), l AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf_sql("text")} AS digest, {_leaf_sql("altered")} AS claim FROM d
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS slot, count(*) OVER (PARTITION BY g) AS n FROM l
), {_climb_sql("leaves", "lower_levels")}, subs AS (
  SELECT g AS name, '' AS g, row_number() OVER (ORDER BY g) - 1 AS slot, count(*) OVER () AS n, digest FROM lower_levels WHERE n = 1
), {_climb_sql("subs", "upper_levels")}, proven AS (
  SELECT l.doc_id, l.digest AS leaf, l.claim, s.digest AS subroot, r.digest AS root, list_filter(string_split(concat_ws(',', p.p, q.p), ','), lambda x: x <> '') AS steps
  FROM leaves l JOIN subs s ON s.name = l.g JOIN upper_levels r ON r.n = 1
  LEFT JOIN {_proof_sql("leaves", "lower_levels")} p ON p.g = l.g AND p.slot = l.slot
  LEFT JOIN {_proof_sql("subs", "upper_levels")} q ON q.slot = s.slot
), done AS (
  SELECT *, list_reduce(steps, lambda node, s: sha256(split_part(s, '|', 1) || node || split_part(s, '|', 2)), claim) AS folded_root FROM proven
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.fixed_points(table(spark, sf_dir, "embeddings"))
    found = whitening.fit_components(rows)
    return whitening.whiten(rows, found).withColumn("identity_error", F.lit(whitening.identity_error(rows, found)))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document beside its edited text, whose end is the next document's beginning, and beside the next document."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    out = fingerprints.with_next(table(spark, sf_dir, "documents")).withColumn("edited", edited).withColumn("edited_fingerprint", fingerprints.fingerprint(F.col("edited")))
    own = F.col("fingerprint")
    near = {"near_edited": fingerprints.likeness(own, F.col("edited_fingerprint")), "near_next": fingerprints.likeness(own, F.col("next_fingerprint"))}
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", *[c.alias(n) for n, c in near.items()])


_BORDER_SQL = f"IN ({', '.join(map(repr, fingerprints.BORDER))})"
_LIKENESS_SQL = "CASE WHEN left({a}, 64) = left({b}, 64) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({pa}, {pb})) / (len({pa}) + len({pb})) END AS {name}"
OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), n AS (
  SELECT *, coalesce(lag(text) OVER (ORDER BY doc_id NULLS FIRST), last_value(text) OVER (ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS following, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS k FROM d
), e AS (
  SELECT *, substring(text, 1, length(text) - length(text) // 2) || substring(following, 1, length(text) // 2) AS edited FROM n
), texts AS (
  SELECT k, 'own' AS kind, text AS t FROM e UNION ALL SELECT k, 'edited', edited FROM e UNION ALL SELECT k, 'next', following FROM e
), lines AS (
  SELECT k, kind, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM texts
), marked AS (
  SELECT k, kind, i, line, sha256(line) AS leaf, regexp_replace(array_to_string(list_transform(regexp_extract_all(line, '{fingerprints.WORD}'), lambda w: CASE WHEN left(md5(w), 1) {_BORDER_SQL} THEN w || chr(1) ELSE w END), ''), '\x01\\z', '') AS words FROM lines
), paragraphs AS (
  SELECT k, kind, i, leaf, left(leaf, 1) {_BORDER_SQL} OR trim(line) = '' AS ends, array_to_string(list_transform(string_split(words, chr(1)), lambda p: ',' || left(md5(p), {fingerprints.PHRASE})), '') AS phrases FROM marked
), placed AS (
  SELECT *, coalesce(sum(ends::INTEGER) OVER (PARTITION BY k, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM paragraphs
), sections AS (
  SELECT k, kind, s, sha256(string_agg(leaf, '' ORDER BY i)) AS node, string_agg(';' || left(leaf, {fingerprints.SHORT}) || phrases, '' ORDER BY i) AS body FROM placed GROUP BY ALL
), prints AS (
  SELECT k, kind, sha256(string_agg(node, '' ORDER BY s)) || string_agg('|' || left(node, {fingerprints.SHORT}) || body, '' ORDER BY s) AS f FROM sections GROUP BY ALL
), wide AS (
  SELECT k, max(f) FILTER (kind = 'own') AS a, max(f) FILTER (kind = 'edited') AS b, max(f) FILTER (kind = 'next') AS c FROM prints GROUP BY k
), shared AS (
  SELECT *, list_distinct(regexp_extract_all(a, ',([0-9a-f]{{{fingerprints.PHRASE}}})', 1)) AS pa, list_distinct(regexp_extract_all(b, ',([0-9a-f]{{{fingerprints.PHRASE}}})', 1)) AS pb, list_distinct(regexp_extract_all(c, ',([0-9a-f]{{{fingerprints.PHRASE}}})', 1)) AS pc FROM wide
)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, a AS fingerprint, b AS edited_fingerprint, {_LIKENESS_SQL.format(a="a", b="b", pa="pa", pb="pb", name="near_edited")}, {_LIKENESS_SQL.format(a="a", b="c", pa="pa", pb="pc", name="near_next")}
FROM e JOIN shared USING (k)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_html_blocks": op2_html_blocks,
        "op3_sharding": op3_sharding,
        "op4_ngram_join": op4_ngram_join,
        "op5_packing": op5_packing,
        "op6_quality": op6_quality,
        "op7_topk": op7_topk,
        "op8_unigram_lm": op8_unigram_lm,
        "op9_suffix_array": op9_suffix_array,
        "op10_bpe": op10_bpe,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_whitening": op12_whitening,
        "op13_fingerprints": op13_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_topk": OP7_SQL, "op11_merkle_manifest": OP11_SQL, "op13_fingerprints": OP13_SQL}
