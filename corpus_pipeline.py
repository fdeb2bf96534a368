"""The corpus pipeline: quality rules, line dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the
shared folder as Parquet and gives the next stage what it reads back, so a stage is never
computed twice and a lost executor costs a re-read. All stages but the last return the
columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapstride.llm.line_dedup import line_dedup
from snapstride.llm.mixing import mixed
from snapstride.llm.near_dedup import keep_first
from snapstride.llm.packing import pack
from snapstride.llm.quality import keep_good
from snapstride.llm.queries import prepared
from snapstride.llm.scratch import staged

#: No SQL: the forest's verdict, the near-duplicate classes and the packing are not
#: expressible; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the forest reject go.

    A null or empty text goes; repeated rows are judged one by one; without labels only the
    base rules decide.
    """
    prepared(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose lines that many documents share; ``n_chars`` follows the text.

    A null text becomes empty, as does one all of whose lines go; rows that repeat a doc_id are
    one document and are each cleaned; rows without a doc_id keep their lines.
    """
    prepared(spark)
    cleaned = line_dedup(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(kind))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the least doc_id stays.

    Rows that repeat a doc_id, or have none, are told apart; of equal ones one stays. Texts
    without a word are a class each.
    """
    prepared(spark)
    return keep_first(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Rows that repeat a doc_id, or have none, are planned one by one; texts without a word are
    taken in whole epochs of their source only; null sources are one source.
    """
    prepared(spark)
    return mixed(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, as pieces of documents.

    A null or empty text is its end token alone; repeated rows are packed one by one.
    """
    prepared(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", lines_stage),
    ("near_dedup", near_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of a table folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
