"""Operator 3, exact deduplication by two-pass Bloom filtering (native expressions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.llm.shared import MOST_HOT, cut, exact_groups, free_name, parted, table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are (SHA-256 stands for them; nothing is normalised). Null text
    counts as empty. Of equal texts the row with the largest id stays; null ids rank below all others, and rows
    that repeat the kept id are the same document and all kept. An empty table gives an empty result. Other
    columns are not looked at. Texts are read once and never move: id and hash go on.
    """
    base = cut(docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("text_sha256")))
    return exact_groups(base, "doc_id", "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id is not distinct from max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """One document of each text, that of the largest id (null ids below all others), all its columns as they were.

    Rows are told apart by id and hash of the text, so an id that several texts or null ids share loses no text; of rows that repeat both, one stays.
    A Bloom filter of the rows that go or repeat lets all others pass where they are; only those it holds back move with their text. Rows that repeat
    very often (at most MOST_HOT pairs, by construction) meet their pairs by broadcast. Null texts count as empty; an empty table stays one.
    """
    found = exact_dedup(docs)
    pairs = cut(found.groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_text")).agg(F.first("kept").alias("_kept"), F.count(F.lit(1)).alias("_n")).filter("not _kept or _n > 1"))
    mark = free_name(docs, "_sha")
    rows = docs.withColumn(mark, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    stay, maybe = parted(rows, F.xxhash64(F.col("doc_id").cast("long"), mark), pairs.select(F.xxhash64(F.col("_id").cast("long"), "_text")))
    hot = F.col("_n") >= max(32, -(-found.count() // MOST_HOT))
    same = lambda p: maybe["doc_id"].eqNullSafe(p["_id"]) & (maybe[mark] == p["_text"])
    often, rest = F.broadcast(pairs.filter(hot)), pairs.filter(~hot)
    out = stay.unionByName(maybe.join(often, same(often), "left_anti").join(rest, same(rest), "left_anti")).drop(mark)
    repeated = pairs.filter("_kept")
    if repeated.isEmpty():
        return out
    often, rest = F.broadcast(repeated.filter(hot)), repeated.filter(~hot)
    once = maybe.join(often, same(often), "left_semi").unionByName(maybe.join(often, same(often), "left_anti").join(rest, same(rest), "left_semi"))
    return out.unionByName(once.dropDuplicates(["doc_id", mark]).drop(mark))
