"""The corpus pipeline: from raw documents to packed sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelkiln.llm.exact_dedup import drop_exact
from panelkiln.llm.near_dups import drop_near
from panelkiln.llm.packing import pack_documents
from panelkiln.llm.secrets import redact
from panelkiln.llm.shared import fresh_dir, small_batches, table
from panelkiln.llm.toxicity import drop_toxic


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact),
    ("near_dups", drop_near),
    ("secrets", redact),
    ("packing", pack),
]

#: Training a classifier, the similarity join and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
