"""A training corpus from the documents table, in five stages.

Language identification drops documents without a recognised language and names the language of the others, exact and
near deduplication leave one document of each group, mixing takes each source's share of a token budget (each document
once at most, the last of a source up to the word at which the share ends), and byte-level BPE encodes what is left. Each
stage takes (spark, docs, sf_dir) and returns all columns of docs, but for the last, which returns doc_id, n_tokens,
ids_sha256 and decoded_sha256.

Rows are told apart by doc_id. Null or empty texts have no language and go in the first stage (the others take them as
empty texts). Equal texts, rows repeated as a whole among them, leave one row in the exact stage; after it, rows that
share a doc_id with unlike texts stay or go together. Ties go to the smallest doc_id. An empty table stays empty, and
columns of any name pass through.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cauza.llm import bpe_codec, budget_mix, byte_gru, exact_dedup, simhash_similar
from cauza.llm.common import among, give_back, leave, written

#: Of the way from chance to certainty that the score of the best language must go; see language().
LEAST_CONFIDENCE = 1 / 3
#: Scores that a worker holds at once: fewer than op4, as later in a session the JVM beside it keeps all of its heap.
HELD = 4 << 20
SHARE, EPOCHS = 90, 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and a language; lang becomes the predicted one. The score is a mean probability, and chance is one by the number of languages."""
    net = byte_gru.train(docs)
    chance = 1 / max(1, len(net.labels))
    return byte_gru.recognised(docs, net, chance + LEAST_CONFIDENCE * (1 - chance), held=HELD)


def _thinned(docs: DataFrame, found: DataFrame, stays: Column, keys: dict[str, Column]) -> DataFrame:
    """The rows of docs whose row in found (columns keys, one row for each of docs) stays; of rows repeated as a whole, one."""
    # a row that stays but is there more than once: all of its copies go, and one comes back
    again = written(found.filter(stays).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys), "repeated")
    left = leave(docs, found.filter(~stays).select(*keys).union(again).distinct(), keys)
    return left if again.isEmpty() else left.unionByName(among(docs, again, keys).dropDuplicates(["doc_id", "text"]))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    found = written(exact_dedup.exact_dedup(docs), "exact-classes")
    return _thinned(docs, found, F.col("kept"), {"doc_id": F.col("doc_id"), "text_hash": F.xxhash64("text")})


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest identifier of each component of texts whose five-word shingles are 0.8 similar."""
    found = written(simhash_similar.near_dedup(docs), "near-classes")
    return _thinned(docs, found, F.col("doc_id").eqNullSafe(F.col("component_id")), {"doc_id": F.col("doc_id")})


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token-prefix of each leaf: whole documents, and the one at its end cut behind the last word that is taken."""
    taken = written(budget_mix.mix(docs, share=SHARE, epochs=EPOCHS).select("doc_id", "tokens", "take_tokens"), "mix-taken")
    ends = taken.filter("take_tokens < tokens").groupBy("doc_id").agg(F.max("take_tokens").alias("__take"))  # one document of a leaf at most
    whole = taken.filter("take_tokens = tokens").select("doc_id").distinct()
    gone = docs.select("doc_id").join(whole.select(F.col("doc_id").alias("__id")), F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti").distinct()
    words = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = among(docs, ends, {"doc_id": F.col("doc_id")}).withColumn("text", F.array_join(F.slice(words, F.lit(1), F.col("__take").cast("int")), ""))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return leave(docs, gone, {"doc_id": F.col("doc_id")}).unionByName(cut.filter("__take > 0").select(docs.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return bpe_codec.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _lean(stage):
    """The stage, before which executors give back the memory that earlier stages made them take: else heaps only grow, and the last stages find no room beside them."""

    @wraps(stage)
    def out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return out


STAGES = [(name, _lean(stage)) for name, stage in (("language", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("budget_mix", mixed), ("bpe_codec", encoded))]

#: A recurrent network and a merge table are not SQL; tests hold run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
