"""Operator 5, exact top-k inner products with vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkiln.llm.shared import cut, set_for, table

#: Cells along each component, numbered by one byte; they share the range that the component has in a block.
CELLS = 256
#: Vectors in a candidate block and queries in a query block.
BLOCK, QUERIES = 8192, 1024


def integers(embedding: str = "embedding", scale: int = 64):
    """floor(scale * x) of each component as long; null where the vector is null or has null or non-finite components."""
    x = F.col(embedding)
    bad = x.isNull() | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long")))


def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (id, ints, uid) as blocks of about `size` vectors, dealt by hash of uid: block number, dimension, ids and vectors as bytes.

    Vectors of different lengths never share a block, since they have no inner product.
    """
    n = max(1, -(-rows.count() // size))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["ints"].to_numpy()).astype("<i8") if key[1] else np.zeros((len(pdf), 0), "<i8")
        return pd.DataFrame({f"{name}": [int(key[0])], "dim": [int(key[1])], f"{name}_ids": [pdf["id"].to_numpy("<i8").tobytes()], f"{name}_vectors": [v.tobytes()]})

    dealt = rows.withColumns({"_b": F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int"), "_d": F.size("ints")})
    return dealt.groupBy("_b", "_d").applyInPandas(run, f"{name} int, dim int, {name}_ids binary, {name}_vectors binary")


def longs(data: bytes, dim: int | None = None) -> np.ndarray:
    """Ids, or vectors of `dim` components, from their bytes."""
    return np.frombuffer(data, "<i8") if dim is None else np.frombuffer(data, "<i8").reshape(-1, dim)


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's least values, widths of cells (whole numbers) and cell numbers, by component."""
    low = v.min(0)
    width = np.array([max(1, -(-(int(h) - int(x) + 1) // CELLS)) for h, x in zip(v.max(0), low, strict=True)], "u8")
    # Differences of 64-bit numbers fit unsigned ones.
    return low, width, ((v.astype("u8") - low.astype("u8")) // width).astype("u1")


def bounds(q: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of queries with the centres of cells, and for each query how far from them exact ones can be at most."""
    half = (width.astype("f8") - 1) / 2
    centre = low.astype("f8") + cells * width.astype("f8") + half
    qf = q.astype("f8")
    most = np.abs(qf) @ np.abs(centre).max(0, initial=0)
    kind = "f4" if most.max(initial=0) < 1e30 else "f8"
    # Half a cell, and room for rounding in single precision.
    slack = np.abs(qf) @ half + 1e-5 * most * max(1, q.shape[1] / 16) + 1e-3
    return (qf.astype(kind) @ centre.astype(kind).T).astype(kind), slack


def survivors(near: np.ndarray, slack: float, kth: float, c_ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the vectors that may be among a query's best, by falling bound.

    Where the bounds leave one whole number the score is known, so that ties beyond the k smallest ids go before any vector is read.
    """
    left = np.flatnonzero((near + slack >= kth) & (near > -np.inf))
    if slack < 0.5:
        return left[np.lexsort((c_ids[left], -np.rint(near[left])))][:k]
    return left[np.argsort(-near[left], kind="stable")]


def read_exact(q: np.ndarray, c: np.ndarray, c_ids: np.ndarray, order: np.ndarray, high: np.ndarray, k: int) -> list[tuple]:
    """(-score, id) of a query's k best, from exact vectors in the order of their bounds, until no bound left reaches the kth score."""
    best: list[tuple] = []
    for at in range(0, len(order), 2 * k):
        if len(best) >= k and high[at] < -best[k - 1][0]:
            break
        some = order[at : at + 2 * k]
        best += [(-int(s), int(x)) for s, x in zip((c[some] @ q).tolist(), c_ids[some].tolist(), strict=True)]
        best.sort()
        del best[k:]
    return best


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", embedding_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with every other row.

    Queries are the rows whose id is divisible by `every`, candidates all rows but those with the query's id. The approximation file, a byte for
    a component, is stored by block beside the exact vectors. One scan of it gives each query's kth largest lower bound over all
    blocks; another keeps the vectors whose upper bound reaches that. Exact blocks meet the pairs of blocks that keep any, and are read in the order of bounds.
    Query blocks meet candidate blocks by an equi-join on block number; a meeting gives k rows a query at most, merged by a window that Spark limits to k
    rows map-side. Null ids and vectors that are null or have null or non-finite components take no part; vectors of
    other lengths than the query's are no candidates for it. Rows that repeat an id are candidates each. Scores beyond 64 bits are clamped to them; components
    must fit 64 bits. Fewer than k candidates give fewer rows.
    """
    ready = vectors.select(F.col(id_col).cast("long").alias("id"), integers(embedding_col).alias("ints")).filter("id is not null and ints is not null")
    ready = cut(ready.withColumn("uid", F.monotonically_increasing_id()))
    held = cut(blocks(ready, BLOCK, "c"))
    asked = cut(blocks(ready.filter(F.col("id") % every == 0), QUERIES, "q"))
    n = held.agg(F.max("c")).first()[0]
    if n is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def approximate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                v = longs(r.c_vectors, r.dim) if r.dim else np.zeros((len(longs(r.c_ids)), 0), "<i8")
                low, width, cells = quantise(v)
                yield pd.DataFrame({"c": [r.c], "dim": [r.dim], "c_ids": [r.c_ids], "low": [low.tobytes()], "width": [width.tobytes()], "cells": [cells.tobytes()]})

    file = cut(held.mapInPandas(approximate, "c int, dim int, c_ids binary, low binary, width binary, cells binary"))

    def met(queries: DataFrame) -> DataFrame:
        """Each query block once with each block of the approximation file."""
        return queries.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(int(n))))).join(file, ["c", "dim"])

    def near_of(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a meeting: ids of candidates, bounds' middles (minus infinity for a query itself), distances of bounds from them."""
        q_ids, c_ids = longs(r.q_ids), longs(r.c_ids)
        q = longs(r.q_vectors, r.dim) if r.dim else np.zeros((len(q_ids), 0), "<i8")
        near, slack = bounds(q, np.frombuffer(r.low, "<i8"), np.frombuffer(r.width, "<u8"), np.frombuffer(r.cells, "u1").reshape(len(c_ids), r.dim))
        near[q_ids[:, None] == c_ids[None, :]] = -np.inf
        return c_ids, near, slack

    def lower(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                _, near, slack = near_of(r)
                m = near.shape[1]
                top = np.partition(near, m - k, axis=1)[:, m - k :] if m > k else near
                i, j = np.nonzero(top > -np.inf)
                yield pd.DataFrame({"q": r.q, "dim": r.dim, "i": i.astype("i4"), "low": top[i, j].astype("f8") - slack[i]})

    by_query = ["q", "dim", "i"]
    found = met(asked).mapInPandas(lower, "q int, dim int, i int, low double")
    best_low = found.withColumn("_n", F.row_number().over(Window.partitionBy(*by_query).orderBy(F.desc("low")))).filter(F.col("_n") <= k)
    kth = best_low.groupBy(*by_query).agg(F.when(F.count(F.lit(1)) >= k, F.min("low")).otherwise(F.lit(float("-inf"))).alias("kth"))
    # At most a query block's queries to a row.
    limits = kth.groupBy("q", "dim").agg(F.sort_array(F.collect_list(F.struct("i", "kth"))).alias("limits"))
    limited = cut(asked.join(limits.select("q", "dim", F.col("limits.i").alias("i"), F.col("limits.kth").alias("kth")), ["q", "dim"]))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                c_ids, near, slack = near_of(r)
                of, at, high = [], [], []
                for i, least in zip(r.i, r.kth, strict=True):
                    x = survivors(near[i], slack[i], least, c_ids, k)
                    of.append(np.full(len(x), i, "<i4"))
                    at.append(x.astype("<i4"))
                    high.append(near[i][x].astype("<f8") + slack[i])
                if sum(map(len, of)):
                    yield pd.DataFrame({"q": [r.q], "c": [r.c], "dim": [r.dim], **{m: [np.concatenate(v).tobytes()] for m, v in (("of", of), ("at", at), ("high", high))}})

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                q_ids, c_ids = longs(r.q_ids), longs(r.c_ids)
                q, c = (longs(x, r.dim) if r.dim else np.zeros((len(y), 0), "<i8") for x, y in ((r.q_vectors, q_ids), (r.c_vectors, c_ids)))
                top = np.abs(q.astype("f8")).sum(1).max(initial=0) * np.abs(c.astype("f8")).max(initial=0)
                kind = "f8" if top < 2**52 else "i8" if top < 2**62 else object
                q, c = q.astype(kind), c.astype(kind)
                of, at, high = np.frombuffer(r.of, "<i4"), np.frombuffer(r.at, "<i4"), np.frombuffer(r.high, "<f8")
                out = []
                for i in np.unique(of):
                    a, z = np.searchsorted(of, i), np.searchsorted(of, i, "right")
                    out += [(int(q_ids[i]), x, max(-(2**63), min(2**63 - 1, -s))) for s, x in read_exact(q[i], c, c_ids, at[a:z], high[a:z], k)]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    kept = met(limited).mapInPandas(keep, "q int, c int, dim int, of binary, at binary, high binary")
    best = kept.join(asked, ["q", "dim"]).join(held, ["c", "dim"]).select("dim", "q_ids", "q_vectors", "c_ids", "c_vectors", "of", "at", "high").mapInPandas(exact, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A row here is a pair of blocks: few to a batch, while this query runs.
    with set_for(spark, spark__sql__execution__arrow__maxRecordsPerBatch="4"):
        return cut(exact_top_k(table(spark, sf_dir, "embeddings")))


OP5_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e, len(embedding) as d from embeddings
  where embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and q.d = c.d
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= 20
"""
