"""One query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from ..session import ship
from . import sql
from .batches import small_batches
from .binary_ids import ids_round_trip
from .exact_dedup import exact_dedup
from .language import identify
from .line_dedup import line_dedup
from .mixing import plan_mix
from .near_dedup import near_classes
from .packing import pack
from .quality import quality
from .token_counts import count_tokens
from .warc import archive_round_trip


def prepared(spark: SparkSession) -> None:
    """Lets the session run the operators: package on the workers, bounded batches."""
    ship(spark)
    small_batches(spark)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(_documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(_documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    found = archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, which stands beside this package."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_near_dedup": op2_near_dedup,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_quality": op4_quality,
        "op5_mixing": op5_mixing,
        "op6_line_dedup": op6_line_dedup,
        "op7_token_counts": op7_token_counts,
        "op8_language": op8_language,
        "op9_warc": op9_warc,
        "op10_binary_ids": op10_binary_ids,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": sql.EXACT_DEDUP,
        "op5_mixing": sql.MIXING,
        "op6_line_dedup": sql.LINE_DEDUP,
        "op9_warc": sql.WARC,
    }
