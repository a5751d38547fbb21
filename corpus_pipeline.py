"""Corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each to
the shared folder and reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import decontaminate, language, mixing, sharding, simhash
from tidepool.llm.shared import clear, made, written

#: Phrases a letter above which a text is in none of the learned languages.
MAX_RATE = 0.6


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones too) and texts in no learned
    language; of any length, each row is judged alone, so repeated rows stay or go alike."""
    return language.filter_known(docs, language.learn(docs), MAX_RATE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of texts with five-word Jaccard similarity of 0.8 or more
    the document of smallest doc_id, once (a null doc_id comes last, ties by a hash of the
    text, then of the row). Texts of fewer words compare as a whole; those without words are one component."""
    keep = written(simhash.representatives(docs).select(F.col("key").alias("c_near_key"), F.col("rows").alias("c_rows")), "keep")
    names = docs.columns
    packed = docs.select(F.struct("*").alias("c_row"), simhash.row_key(F.col("doc_id"), F.col("text")).alias("c_key"))
    # the keys are the hash side: texts are shuffled once and not sorted
    kept = packed.join(keep.hint("shuffle_hash"), F.col("c_key") == F.col("c_near_key")).select("c_row", "c_key", "c_rows")
    # rows of one key are alike in doc_id and text; the other columns decide by a hash
    repeated = kept.where("c_rows > 1").groupBy("c_key").agg(F.min_by("c_row", F.xxhash64("c_row")).alias("c_row"))
    rows = kept.where("c_rows = 1").select("c_row").unionByName(repeated.select("c_row"))
    return rows.select(*(F.col("c_row")[n].alias(n) for n in names))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts spans of test items from whole texts; drops documents that consist mostly of
    them. Null and empty texts stay; repeated rows are cut alike."""
    return decontaminate.remove_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that tokens meet the targets of source, language and topic. A
    null source or language is a value of its own; a document is drawn by a hash of id and
    text, so repeated rows stay or go alike; texts without tokens stay with their cell."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with shard and slot, which replace columns of these names. Every row is placed
    by a number of its own, so null and repeated doc_ids stay as they are; a long text may
    fill a shard's step alone."""
    names = [n for n in docs.columns if n.lower() not in ("shard", "slot")]
    rows = written(docs.select(F.struct(*names).alias("c_row"), F.monotonically_increasing_id().alias("c_n")), "rows")
    texts = rows.select(F.col("c_row")["doc_id"].alias("doc_id"), F.col("c_row")["text"].alias("text"), "c_n")
    placed = written(sharding.placed_rows(texts, F.col("c_n")).select("n", "shard", "slot"), "shards")
    joined = rows.join(placed.hint("shuffle_hash"), F.col("c_n") == F.col("n"))
    return joined.select(*(F.col("c_row")[n].alias(n) for n in names), "shard", "slot")


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Cross-parsing and automata are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage leaves in the shared folder besides its result goes when
    the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        clear(mark, but=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
