"""One query per operator, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import (
    alignment, bpe_automaton, chosen_path, class_lm, compression_quality, hash_index, line_dedup, line_frequency, repair, sharding, tiling, toxicity, warc,
)
from wattloom.llm.common import held_out, table
from wattloom.llm.registry import ORACLES, QUERIES, query
from wattloom.session import materialize

__all__ = ["ORACLES", "QUERIES"]


def vocabulary_path(name: str) -> str:
    return public_tokenizers.path(name)


def _learned(scores: DataFrame, least: float) -> DataFrame:
    return scores.select(
        F.col("doc").alias("doc_id"), held_out("doc", 5).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


@query("op1_nnpu_toxicity")
def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic labels of the training rows are the positives; the unlabelled pool is drawn from all training texts."""
    docs, train = table(spark, sf_dir, "documents"), ~held_out("doc_id", 5)
    labels = table(spark, sf_dir, "labels").where(train)
    model = toxicity.fit(docs.where(train), labels.where("toxic = 1"), toxicity.prior_of(labels))
    return _learned(model.with_score(docs.select(F.col("doc_id").alias("doc"), "text"), keep=["doc"]), 0.5)


@query("op6_compression_quality")
def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries and curve from labelled training rows, scores of every text."""
    docs, train = table(spark, sf_dir, "documents"), ~held_out("doc_id", 5)
    model = compression_quality.fit(docs.where(train), table(spark, sf_dir, "labels").where(train))
    return _learned(model.score(docs), 0.3)


@query("op2_bounded_ring")
def op2_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: at load factor 1 every shard is filled to its quota, so counts are at most one apart."""
    out = sharding.shard(table(spark, sf_dir, "documents"), n_shards=8, load_factor=1.0)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op3_line_frequency")
def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base counts, its verdict and the base verdict."""
    return line_frequency.assess(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.top IS NOT NULL AND c.top <> k.doc_id AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op4_line_bitmaps", OP4_SQL)
def op4_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its numbers of lines and dropped lines and the digest of the lines that stay."""
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"),
    )


OP5_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


@query("op5_seekable_warc", OP5_SQL)
def op5_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the written bundles."""
    archive = materialize(warc.bundles(table(spark, sf_dir, "pages")), "warc")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return warc.records(archive).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


@query("op7_class_bigrams")
def op7_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's log10 probability by class bigrams beside its base score."""
    return class_lm.score_documents(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


@query("op8_string_tiling")
def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item of which at least half the tokens lie under tiles."""
    out = tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_item_tokens", "n_covered", "coverage", "n_tiles"
    )


@query("op9_chosen_path")
def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and its number of links."""
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


@query("op10_bpe_automaton")
def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by the automaton and decoded again."""
    out = bpe_automaton.round_trip(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return out.select(
        F.col("doc").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op11_merge_path_alignment")
def op11_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text by the byte-level vocabulary and by the piece vocabulary: groups, links and corpus-wide pair counts."""
    paths = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
    return alignment.cross_alignment(table(spark, sf_dir, "documents"), *paths).withColumnRenamed("doc", "doc_id")


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), r AS (
  SELECT doc_id, sha256(body) AS text_sha256, count(*) OVER (PARTITION BY body) AS group_size,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept
  FROM t WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
"""


@query("op12_extendible_hash", OP12_SQL)
def op12_extendible_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays of its group of equal texts."""
    return hash_index.exact_copies(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


OP13_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab
), src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(cast(conv_id AS VARCHAR), ' ') || ':' || coalesce(cast(turn AS VARCHAR), ' ') AS place FROM conversations
), kinds AS (
  SELECT src.* EXCLUDE place, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(place, ''), lambda c: ascii(c)::BIGINT)),
         lambda c, b: xor(c // 256, tab[(xor(c, b) % 256) + 1])), 4294967295) % 20 AS kind
  FROM src, crc_table
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM hurt
), numbered AS (
  SELECT conv_id, turn, role, text, n, left(role, 1) AS ini,
         CASE WHEN bare = '' THEN 'b' WHEN again THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
         left(role, 1) || left(lead(role) OVER (PARTITION BY conv_id ORDER BY n), 1) AS pair
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
         count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS rows
  FROM numbered GROUP BY conv_id
), inserts(q, p, c, audit, rep) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 2, 'I', ['user:']),
         (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:'])
), steps(p, op, ini, r, c) AS (
  VALUES (0, 'D', '*', 0, 3), (1, 'D', '*', 1, 3), (2, 'D', '*', 2, 3), (3, 'D', '*', 3, 3), (0, 'R', '*', 2, 2), (1, 'R', '*', 2, 2),
         (2, 'R', '*', 3, 2), (3, 'R', '*', 2, 2), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0)
), walk AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS q, {'c': 0::BIGINT, 'a': '', 'm': []::VARCHAR[]} AS best FROM counted
  UNION ALL
  SELECT w.conv_id, w.n + 1, s.r, min({
           'c': w.best.c + i.c + s.c + CASE WHEN fault = 't' AND op <> 'D' THEN 1 ELSE 0 END, 'a': w.best.a || i.audit || op,
           'm': list_concat(w.best.m, i.rep, CASE op WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text]
                ELSE [CASE s.r WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] END)})
  FROM walk w JOIN numbered t ON t.conv_id = w.conv_id AND t.n = w.n + 1 JOIN inserts i ON i.q = w.q JOIN steps s ON s.p = i.p
  WHERE (op = 'D' OR fault IN ('t', '-')) AND (op <> 'K' OR s.ini = t.ini)
  GROUP BY w.conv_id, w.n, s.r
), ended AS (
  SELECT w.conv_id, min({'c': w.best.c + i.c, 'a': w.best.a || i.audit, 'm': list_concat(w.best.m, i.rep)}) AS best
  FROM walk w JOIN counted USING (conv_id) JOIN inserts i ON i.q = w.q WHERE w.n = counted.rows AND i.p IN (0, 3) GROUP BY w.conv_id
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(array_to_string(best.m, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counted USING (conv_id) LEFT JOIN ended USING (conv_id)
"""


@query("op13_edit_lattice", OP13_SQL)
def op13_edit_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by the crc32 of its rows' places, with its faults and its cheapest repair."""
    rows, gone = repair.damage(table(spark, sf_dir, "conversations"))
    return repair.repair(rows, gone=gone).withColumnRenamed("conv", "conv_id")
