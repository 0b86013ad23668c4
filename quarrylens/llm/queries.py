"""The operators over the test tables, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.byte_cnn import fit, score_texts
from quarrylens.llm.byte_pairs import encode_and_decode
from quarrylens.llm.common import table
from quarrylens.llm.hard_negatives import hard_negatives
from quarrylens.llm.html_text import extract_text
from quarrylens.llm.line_runs import dedup_lines
from quarrylens.llm.mixture import mix_sources
from quarrylens.llm.passages import repeated_passages
from quarrylens.llm.pieces import round_trip
from quarrylens.llm.pivots import near_vectors
from quarrylens.llm.quality_rules import quality_rules
from quarrylens.llm.simhash import simhash_groups
from quarrylens.llm.tool_calls import DIALOGUE_SCHEMAS, as_tool_messages, link_tool_calls
from quarrylens.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_html_blocks")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op2_repeated_passages")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("part")


# All pairs, in double precision, and the smallest id reachable by links.
OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), found AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
)
SELECT f.vec_id, count(l.b) AS n_links, f.component_id, f.vec_id = f.component_id AS kept
FROM found f LEFT JOIN links l ON l.a = f.vec_id GROUP BY f.vec_id, f.component_id"""


@query("op3_pivot_permutation", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op4_simhash_pigeonring")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op5_sentencepiece")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_tokens", "token_ids", F.col("same").alias("round_trip"))


@query("op6_tool_calls")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(as_tool_messages(table(spark, sf_dir, "conversations")), DIALOGUE_SCHEMAS)


@query("op7_tokeniser_fertility")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    first = F.get("fertility", F.lit(0))  # null where a document has no words
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        first["n_tokens"].alias("n_tokens"),
        first["chars_per_token"].alias("chars_per_token"),
        first["byte_share"].alias("byte_share"),
        first["token_entropy"].alias("token_entropy"),
        first["band"].alias("band"),
    )


@query("op8_byte_cnn")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    found = score_texts(docs, fit(docs, labels))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents))
), shared AS (
  SELECT key, min(doc_id) AS holder FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AND l.doc_id <> s.holder AS dropped
  FROM lines l LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op9_line_runs", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)
), weighed AS (
  SELECT *, CAST([3, 1, 2][CAST(pos % 3 + 1 AS INT)] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS room
  FROM ranked
), levelled AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(room) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY room / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, pos, source_size,
         least(room, coalesce(max(CASE WHEN level * weight <= room THEN level END) OVER () * weight, room)) AS target
  FROM levelled
), asked AS (
  SELECT *, CASE WHEN sum(target) OVER () > 0 THEN target / sum(target) OVER () ELSE 0 END AS part,
         floor(sum(target) OVER () / 16 + 0.5) AS seats, CAST(ceil(2 * source_size / 16) AS BIGINT) AS most,
         count(*) OVER () AS n
  FROM targets
), ranged AS (
  SELECT *, CAST(least(greatest(floor(part * seats - (part * n / 2 + 1)), 0), most) AS BIGINT) AS sure,
         CAST(least(ceil(part * seats + (part * n / 2 + 1)), most) AS BIGINT) AS top
  FROM asked
), wanted AS (
  SELECT pos, target, unnest(range(sure + 1, top + 1)) AS seat, seats - sum(sure) OVER () AS left_over FROM ranged
), won AS (
  SELECT pos, count(*) AS won
  FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, pos) AS place FROM wanted)
  WHERE place <= left_over GROUP BY pos
), quotas AS (
  SELECT r.*, sure + coalesce(won, 0) AS quota,
         CAST(greatest(1, ceil(source_size / 65536)) AS BIGINT) AS shards
  FROM ranged r LEFT JOIN won USING (pos)
), known AS (
  SELECT s.doc_id, s.size, q.pos, q.source_size, q.target, q.quota,
         CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % q.shards AS shard
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source
), rings AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY pos, shard
           ORDER BY md5('21:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e,
         CAST(sum(size) OVER (PARTITION BY pos, shard) AS BIGINT) AS ring
  FROM known
), worded AS (
  SELECT *, e - size AS b, CASE WHEN ring > 0 THEN
           least(CAST(floor(quota * ring / source_size + 0.5) AS BIGINT) * 16, 2 * ring) ELSE 0 END AS words,
         CASE WHEN ring > 0 THEN
           CAST('0x' || substr(md5('22:' || pos || ':' || shard), 1, 8) AS BIGINT) % ring ELSE 0 END AS start
  FROM rings
), runs AS (
  SELECT *, CASE WHEN ring > 0 THEN words // ring ELSE 0 END AS passes,
         CASE WHEN ring > 0 THEN words % ring ELSE 0 END AS run
  FROM worded
)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(e, start + run) - greatest(b, start))
            + greatest(0, least(e, start + run - ring) - greatest(b, 0)) AS BIGINT) AS taken
FROM runs"""


@query("op10_sainte_lague_mix", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


# Every anchor against all rows; the scores are integers, exact as doubles.
OP11_SQL = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""


@query("op11_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = (F.col("label").cast("bigint") + 1) % 10
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label")))
    return hard_negatives(vectors)


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    # One row per component; n and the deviation are the row's own.
    found = found.select("vec_id", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return found.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.col("explained")[F.col("at")].alias("explained"),
        "identity_error",
    )


@query("op13_byte_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = encode_and_decode(docs)
    return found.select("doc_id", "n_tokens", F.sha2("packed_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
