"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, budget_mix, byte_gru, chosen_path, divergence_audit, exact_dedup, importance_resample, line_templates, mpeg_audio, preference, simhash_vptree, suffix_repeats, token_packing
from .common import clean


__all__ = ["clean", "oracle_sql", "queries"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of all documents through the keyed state."""
    return exact_dedup.exact_dedup(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components that their links make."""
    return simhash_vptree.near_dedup(_documents(spark, sf_dir))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recurring templates dropped from all documents but the first."""
    out = line_templates.line_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each even conversation as chosen, its first half continued by its neighbour as rejected."""
    return preference.branches(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves of domain, language and source, under one token budget."""
    return budget_mix.mix(_documents(spark, sf_dir))


def op3_token_packing(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """All documents as rows of 2,048 token ids."""
    import public_tokenizers

    return token_packing.pack(_documents(spark, sf_dir), public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents in windows of 50 that start in an earlier document."""
    return suffix_repeats.remove_repeats(_documents(spark, sf_dir))


def op4_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the documents that are not held out."""
    return byte_gru.identify(_documents(spark, sf_dir))


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text as an MPEG stream, read back."""
    return mpeg_audio.digests(_documents(spark, sf_dir))


def op10_bpe_codec(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Each whole text to ids of a public byte-level vocabulary and back."""
    import public_tokenizers

    return bpe_codec.round_trip(_documents(spark, sf_dir), public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language against the others, and the terms that set it apart."""
    return divergence_audit.audit(_documents(spark, sf_dir))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents of 20 words or more, drawn towards the benchmark's words."""
    return importance_resample.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of three-word shingles have a Jaccard similarity of 0.85 or more."""
    return chosen_path.near_dedup(_documents(spark, sf_dir))


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op9_simhash_vptree": op9_simhash_vptree,
        "op2_line_templates": op2_line_templates,
        "op5_preference": op5_preference,
        "op6_budget_mix": op6_budget_mix,
        "op3_token_packing": op3_token_packing,
        "op8_suffix_repeats": op8_suffix_repeats,
        "op4_byte_gru": op4_byte_gru,
        "op7_mpeg_audio": op7_mpeg_audio,
        "op10_bpe_codec": op10_bpe_codec,
        "op11_divergence_audit": op11_divergence_audit,
        "op12_importance_resample": op12_importance_resample,
        "op13_chosen_path": op13_chosen_path,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.SQL,
        "op2_line_templates": line_templates.SQL,
        "op5_preference": preference.SQL,
        "op6_budget_mix": budget_mix.SQL,
        "op11_divergence_audit": divergence_audit.SQL,
        "op12_importance_resample": importance_resample.SQL,
    }
