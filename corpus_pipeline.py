"""A training corpus from raw documents: quality rules, near-dedup, decontamination, pseudonyms, packing.

Each stage takes what the one before kept, whole, and its decisions take effect: documents leave, texts change, and the
last stage packs what is left. Between stages documents are written as Parquet in the shared folder and read again.

Defined results: a null, empty or very short text fails the quality rules and goes; a row with a null doc_id is judged by
the quality rules and by nothing that goes by id, so it stays if they keep it; rows that repeat a doc_id go or stay
together in the stages that go by id; an empty table gives no rows; extra columns, whatever their names, pass through
up to the last stage. The key of the pseudonyms comes from the session (see quillon.llm.pii).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import dropped, stored, without
from quillon.llm.decontaminate import decontaminate, judged
from quillon.llm.neardup import near_duplicates
from quillon.llm.packing import pack
from quillon.llm.pii import key_of, pseudonymized
from quillon.llm.quality import quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return without(docs, near_duplicates(docs).filter("not kept"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    return without(docs, judged(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))).filter("contaminated"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values become pseudonyms; n_chars follows the text."""
    done = pseudonymized(docs, key_of(spark))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("changed"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("benchmark decontamination", benchmark_decontamination), ("PII", pii), ("best-fit packing", best_fit_packing)]
#: SQL can't train a classifier or confirm MinHash components; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
            if before is not None:  # what the stage read has been written again
                dropped(before)
            before = docs
    return docs
