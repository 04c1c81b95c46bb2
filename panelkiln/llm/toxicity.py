"""Operator 2, toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.llm.shared import cut, free_name, small_batches, table
from panelkiln.llm.words import NO_LETTERS, word_hashes

#: Bounds of the training sample (expected number of documents of each kind) and of the features.
POSITIVES, UNLABELLED, FEATURES = 4096, 8192, 4096
#: Features are words, and first bytes of longer words, so that inflected forms count alike.
PREFIXES = (4, 5, 6, 7)
#: Words in at least so many toxic documents become features.
LEAST_DOCS = 3


def features(text: str) -> np.ndarray:
    """Distinct feature hashes of a whole text: its words of letters, and their beginnings."""
    return np.unique(np.concatenate(word_hashes(text, NO_LETTERS, PREFIXES)))


class Finder:
    """Finds which of a sorted list of 64-bit hashes a text has."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = np.uint64((1 << 20) - 1)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[keys & self.mask] = True

    def __call__(self, text: str) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(0, "i8")
        h = np.concatenate(word_hashes(text, NO_LETTERS, PREFIXES))
        h = np.unique(h[self.maybe[h & self.mask]])
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at[self.keys[at] == h]


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, steps: int = 400, rate: float = 0.1, ridge: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias of a linear model, by the non-negative risk estimator with the logistic loss.

    Risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)). Where the second term falls below nought, the step goes up
    that term alone, which keeps the model from fitting the positives among the unlabelled as negatives. Full batches and Adam: the
    same sample gives the same weights.
    """
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([*rows, np.zeros(0, "i8")]).astype("i8")
    w = np.zeros(n_features + 1)
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m, v = np.zeros_like(w), np.zeros_like(w)
    p, u = positive, ~positive
    for t in range(1, steps + 1):
        s = np.bincount(row, w[col], len(rows)) + w[-1]
        as_one = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        loss_minus = np.logaddexp(0, s)
        kept = loss_minus[u].mean() - prior * loss_minus[p].mean() >= 0
        g = np.zeros(len(rows))
        # Slopes: of the loss as positive as_one - 1, as negative as_one.
        g[u] = as_one[u] / u.sum() * (1 if kept else -1)
        g[p] = prior * ((as_one[p] - 1) * kept - as_one[p] * (1 if kept else -1)) / p.sum()
        grad = np.append(np.bincount(col, g[row], n_features), g.sum())
        grad[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learnt from: crc32 of the id as text divisible by 5 (a null id: as the empty text, so held out)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, n_features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature hashes and the model's weights (bias last), learnt from rows that aren't held out.

    Positives are documents labelled toxic; the unlabelled sample is of all documents, whatever their labels. Both are samples by
    hash of the id with the expected sizes given. The class prior is the share of toxic rows among the labels that
    may be learnt from. Only counts of features, and each sampled document's feature numbers, reach the driver.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count(F.lit(1)), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    n_docs = docs.count()
    if not n_toxic or not n_docs:
        return np.zeros(0, "u8"), np.array([-np.inf])
    share = lambda col, bound, of: F.pmod(F.xxhash64(col, F.lit(bound)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, bound / of))
    toxic = known.filter("toxic = 1").filter(share("doc_id", positives, n_toxic)).select(F.col("doc_id").alias("_toxic"))
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(~held_out())
    # At most about `positives` ids.
    pos = text.join(F.broadcast(toxic), F.col("doc_id") == F.col("_toxic")).select(F.lit(True).alias("positive"), "text")
    sample = cut(pos.unionByName(text.filter(share("doc_id", unlabelled, n_docs)).select(F.lit(False).alias("positive"), "text")))

    size = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = size.get(True, 0), size.get(False, 0)
    if not n_p or not n_u:
        return np.zeros(0, "u8"), np.array([-np.inf])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for positive, texts in b.groupby("positive")["text"]:
                keys, n = np.unique(np.concatenate([features(x) for x in texts]), return_counts=True)
                yield pd.DataFrame({"key": keys.astype("i8"), "p": n * bool(positive), "u": n * (not positive)})

    # All features of enough positive documents are tested; the best are ordered by z, then by hash (unsigned).
    p, u = F.col("p"), F.col("u")
    both = (p + u) / float(n_p + n_u)
    z = (p / float(n_p) - u / float(n_u)) / F.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u) + 1e-12)
    counted = sample.mapInPandas(count, "key long, p long, u long").groupBy("key").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).filter(p >= LEAST_DOCS)
    best = counted.withColumn("z", z).filter("z > 3").orderBy(F.desc("z"), F.col("key") < 0, "key").limit(n_features).select("key").collect()
    keys = np.sort(np.array([r[0] for r in best], "i8").astype("u8"))

    def hits(keys: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find = Finder(keys)
            for b in batches:
                yield pd.DataFrame({"positive": b["positive"], "hits": [find(x) for x in b["text"]]})

        return sample.mapInPandas(run, "positive boolean, hits array<int>")

    got = hits(keys).collect()
    w = fit_nnpu([np.array(r["hits"], "i8") for r in got], np.array([r["positive"] for r in got], bool), len(keys), n_toxic / n)
    return keys, w


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; whole texts, nothing shuffles. Null text counts as empty."""
    keys, w = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Finder(keys)
        for b in batches:
            s = np.array([w[find(x)].sum() for x in b["text"]], "f8") + w[-1]
            out = b[["doc_id", "held_out"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["score"] = np.where(np.isneginf(s), 0.0, 1 / (1 + np.exp(-np.clip(s, -700, 700))))
            out["predicted"] = (out["score"] >= 0.5).astype("int32")
            yield out

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return ready.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on the labels and scores every document; see train and score.

    Without toxic labels to learn from, or without documents, all scores are 0. Labels of null doc_ids or null values are no labels;
    of several labels of one document toxic wins. Repeated documents are scored each; texts are inputs of a score, nothing else is.
    """
    return score(docs, train(docs, labels))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted toxic, all their columns as they were."""
    small_batches(spark)
    keys, w = train(docs, table(spark, sf_dir, "labels"))

    @F.pandas_udf("boolean")
    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = Finder(keys)
        for b in texts:
            yield pd.Series([bool(w[find(x)].sum() + w[-1] >= 0) for x in b], dtype=bool)

    mark = free_name(docs, "_toxic")
    return docs.withColumn(mark, toxic(F.coalesce("text", F.lit("")))).filter(~F.col(mark)).drop(mark)
