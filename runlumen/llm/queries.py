"""Registered queries of the text operators and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlumen.llm import (
    conversations, decontaminate, jaccard, lines, lm, mixing, pages, quality, search, sharding, suffixes, tokens,
    whitening,
)
from runlumen.llm.common import fold_of, n_bytes, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents; sources weigh 1, 2, 3 in turn, at most three times their words."""
    docs = table(spark, sf_dir, "documents")
    schedule = mixing.ramps(mixing.cyclic_weights(docs))
    narrow = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("words"),
                         F.xxhash64("text").alias("text_hash"))
    mixed = mixing.mix(narrow, schedule, cap=3.0, size=F.col("words"))
    return mixing.sort_by_position(mixed).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), "position")


@query
def op3_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    import public_tokenizers

    return tokens.count_tokens(
        table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))


@query
def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by doc_id."""
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select(
        "doc_id", (n_bytes(F.col("text")) + 16).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.assign(narrow, 40).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminating(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "items", F.size("items").alias("n_items"),
                        (F.size("items") > 0).alias("contaminated"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from two thirds of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, "score")
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents alike in their 4-word shingles (85 %)."""
    return jaccard.join(table(spark, sf_dir, "documents"), n=4, percent=85)


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that repeat 50-byte strings of earlier documents."""
    return suffixes.deduplicate(table(spark, sf_dir, "documents"), length=50)


@query
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents, learnt from four fifths of them."""
    return lm.score(table(spark, sf_dir, "documents"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later repeats of runs of two lines or more, or of one line of 50 words or more."""
    return lines.deduplicate(table(spark, sf_dir, "documents"), run=2, words=50).select(
        "doc_id", "n_lines", "n_removed", F.md5(F.col("kept").cast("binary")).alias("kept_md5"))


ORACLES["op6_line_dedup"] = """
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i,
    unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (
  SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS line2 FROM l),
o AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, i) > 1 AS again
  FROM w WHERE line2 IS NOT NULL),
a AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS again
  FROM l WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= 50),
g AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i FROM o WHERE again
    UNION ALL SELECT doc_id, i + 1 FROM o WHERE again UNION ALL SELECT doc_id, i FROM a WHERE again))
SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
  md5(coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '')) AS kept_md5
FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
"""


@query
def op7_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 50."""
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.filter(F.col("doc_id") % 50 == 0), k=10)


@query
def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after planned damage: faults, cheapest repair, digest of the repaired rows."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(rows), rows)


@query
def op13_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings projected on four whitened components of their distinct integer vectors."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


@query
def op12_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of all pages, by a labeller fitted on a bounded sample of them."""
    found = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.extract(found, pages.train(found)).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
