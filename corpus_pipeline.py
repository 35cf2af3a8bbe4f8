"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of ``documents``; where a stage changes the text it also corrects n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import materialise, table
from ebbtide.llm.mixing import mix_documents
from ebbtide.llm.packing import pack
from ebbtide.llm.quality_rules import quality_filter
from ebbtide.llm.queries import DOMAINS, MIX_WEIGHTS, tokenizer
from ebbtide.llm.simhash import simhash_dedup
from ebbtide.llm.suffix_dedup import dedup_texts

#: Share of the tokens that the mix draws; every document is drawn at most once.
BUDGET = 0.9


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return simhash_dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut."""
    cut = dedup_texts(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights."""
    return mix_documents(docs, budget=BUDGET, weights=MIX_WEIGHTS, domains=DOMAINS, max_epochs=1)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset."""
    return pack(docs, tokenizer("word_bpe_49k.json")).drop("ids")


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeated_passages),
          ("mixing", mixing), ("packing", packing)]

#: Fingerprints, token ids and robust estimates are beyond SQL; the stages are
#: tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
