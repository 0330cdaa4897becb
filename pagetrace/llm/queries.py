"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import credentials, decontamination, dominance, language, mixture, negatives, order_minhash, range_join, sharding, token_store, vector_codes, warc, wrapper
from .common import new_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored(table(spark, sf_dir, "documents"), spark, new_dir(spark, "tokens"), vocabulary())


def op3_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept", "copies")


def op5_host_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_texts(table(spark, sf_dir, "pages"))


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "warc")
    index = warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(index, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.report(table(spark, sf_dir, "documents"))


def op8_pivot_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.pack(table(spark, sf_dir, "documents"), vocabulary())


def op10_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    return language.identify(docs, model, ["doc_id"]).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, seventh = table(spark, sf_dir, "embeddings"), F.col("vec_id") % 7 == 0
    return negatives.hard_negatives(rows.withColumn("label", F.when(seventh, (F.col("label") + 1) % 10).otherwise(F.col("label"))), F.col("vec_id") % 100 == 0)


def op12_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = dominance.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_sliced_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    told = vector_codes.with_label_errors(coded).withColumn("codebooks_sha256", F.lit(vector_codes.sha256(books)))
    return told.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_lpt_sharding,
        op2_token_store,
        op3_simhash_windows,
        op4_order_minhash,
        op5_host_wrappers,
        op6_warc_index,
        op7_credential_links,
        op8_pivot_range_join,
        op9_mixture_packing,
        op10_language_codes,
        op11_residue_negatives,
        op12_dominance_packing,
        op13_sliced_codes,
    )
}



def _refined(round_: int) -> str:
    """The codebook after a round: c{n} from c{n-1}."""
    return f"""
n{round_} AS MATERIALIZED (
  SELECT part, entry, v FROM (
    SELECT p.vec_id, p.part, any_value(p.v) AS v, arg_min(c.entry, {{'d': list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, c.v) + list_dot_product(c.v, c.v), 'e': c.entry}}) AS entry
    FROM p JOIN c{round_ - 1} c USING (part) GROUP BY p.r, p.vec_id, p.part)
), s{round_} AS (
  SELECT part, entry, place, floor(sum(v[place]) / count(*)) AS x FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS place FROM n{round_}) GROUP BY part, entry, place
), c{round_} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{round_ - 1} c LEFT JOIN (SELECT part, entry, list(x ORDER BY place) AS v FROM s{round_} GROUP BY part, entry) m USING (part, entry)
)"""


#: DuckDB SQL of those that SQL can express.
ORACLES: dict[str, str] = {
    "op8_pivot_range_join": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98
), reach AS (
  SELECT a AS vec_id, a AS other FROM links
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(least.component_id, v.vec_id) AS component_id,
  coalesce(least.component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN least USING (vec_id)
""",
    "op6_warc_index": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), d AS (
  SELECT *, max(page_id) OVER (PARTITION BY x) AS last,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
      (CAST(('0x' || substr(x, CAST(1 + 10 * (i // 8) AS BIGINT), 10)) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS digest
  FROM p
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
""",
    "op11_residue_negatives": """
WITH k AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM k a JOIN k b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT r, anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.r, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s USING (r) WHERE NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.r, p.positive_id ORDER BY s.score DESC, s.other_id) <= 5
""",
    "op13_sliced_codes": f"""
WITH k AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, vec_id, part, e[CAST(part * len(e) // 4 + 1 AS BIGINT):CAST((part + 1) * len(e) // 4 AS BIGINT)] AS v FROM k, range(4) t(part)
), c0 AS MATERIALIZED (
  SELECT part, first.entry, p.v FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 256) first USING (r)
), {",".join(_refined(n) for n in range(1, 5))}, told AS (
  SELECT p.r, p.part, min({{'d': list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, c.v) + list_dot_product(c.v, c.v), 'e': c.entry}}) AS best
  FROM p JOIN c4 c USING (part) GROUP BY p.r, p.part
), coded AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM told JOIN k USING (r) GROUP BY k.r, k.vec_id, k.label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) FROM c4) AS codebooks_sha256
FROM coded
""",
}
