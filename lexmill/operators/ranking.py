"""Ranked retrieval for batches of queries: TF-IDF, BM25, and bound-pruned exact top-k BM25.

Queries are the small side; whether they are broadcast is left to the adaptive planner, which knows their
size. The postings are joined by term without being shuffled in that case. A single query is a batch of one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions import scoring
from lexmill.functions.text import clean_tokens
from lexmill.operators import arrays
from lexmill.operators.index import DEPTHS, Index
from lexmill.session import stored

#: Digits that scores are rounded to before they are ranked, so that summation order can't change an order.
DIGITS = 6


def query_terms(queries: DataFrame, dedup: bool = False) -> DataFrame:
    """qid, term, qtf: the normalised words of each query with their multiplicity (1, if ``dedup``)."""
    counted = clean_tokens(queries, keep=("qid",)).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    return counted.withColumn("qtf", F.lit(1).cast("bigint")) if dedup else counted


def bound_terms(index: Index, queries: DataFrame, dedup: bool = False) -> DataFrame:
    """Query terms that the index knows: qid, term, qtf, df.

    They are written once, so that the planner knows their size before it joins the postings: a small batch is
    broadcast and the postings are filtered where they lie; a batch above the session's broadcast threshold
    is joined by a shuffle.
    """
    return stored(query_terms(queries, dedup).join(index.terms.select("term", "df"), "term"), "asked")


def top_k(scored: DataFrame, k: int, *keys: str, score: str = "score", item: str = "doc_id") -> DataFrame:
    """keys..., rank, item, score: the k best per key, equal scores by the smaller item. k < 1 gives no row."""
    order = W.partitionBy(*keys).orderBy(F.desc(score), F.asc(item))
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(*keys, F.col("rank").cast("bigint").alias("rank"), item, score)


def _accumulated(parts: DataFrame) -> DataFrame:
    total = parts.groupBy("qid", "doc_id").agg(F.sum("gain").alias("score"))
    return total.withColumn("score", F.round("score", DIGITS))


def tfidf_scores(index: Index, queries: DataFrame) -> DataFrame:
    """qid, doc_id, score = sum over the query's words, repeated ones again, of ln(N/df) (1 + ln tf).

    A document that holds only terms of all documents is returned with score 0.
    """
    terms = bound_terms(index, queries).withColumn("idf", scoring.tfidf_idf(F.col("df"), index.n_docs()))
    hits = index.postings.join(terms, "term")
    return _accumulated(hits.select("qid", "doc_id", (F.col("qtf") * F.col("idf") * scoring.tf_weight(F.col("tf"))).alias("gain")))


def _gains(index: Index, terms: DataFrame, k1: float, b: float) -> DataFrame:
    """qid, doc_id, gain of each query term in each of its documents."""
    hits = index.gains(terms.select("term", "idf").distinct(), k1, b).join(terms.select("qid", "term", "qtf"), "term")
    return hits.select("qid", "doc_id", (F.col("qtf") * F.col("gain")).alias("gain"))


def _bm25_terms(index: Index, queries: DataFrame, dedup: bool, k1: float) -> DataFrame:
    idf = scoring.bm25_idf(F.col("df"), index.n_docs())
    terms = bound_terms(index, queries, dedup).withColumn("idf", idf)
    return terms.withColumn("ub", F.col("qtf") * scoring.bm25_bound(F.col("idf"), k1))


def bm25_scores(index: Index, queries: DataFrame, dedup: bool = False, k1: float = scoring.K1, b: float = scoring.B) -> DataFrame:
    """qid, doc_id, score of every document that holds a query term; ``dedup`` counts each query term once."""
    return _accumulated(_gains(index, _bm25_terms(index, queries, dedup, k1), k1, b))


def _tfidf_gain(group: arrays.Group, idf: np.ndarray) -> np.ndarray:
    """As in ``tfidf_scores``, of all postings of a group."""
    return idf * np.where(group.tfs > 0, 1 + np.log(np.maximum(group.tfs, 1)), 0)


def _bm25_gain(avgdl: float, k1: float, b: float) -> arrays.Gain:
    """As ``Index.gains``, of all postings of a group."""
    def gain(group: arrays.Group, idf: np.ndarray) -> np.ndarray:
        length = np.where(np.isnan(group.lengths), avgdl, group.lengths)[group.docs]
        return idf * group.tfs * (k1 + 1) / (group.tfs + k1 * (1 - b + b * length / avgdl))

    return gain


def tfidf(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    if k < 1:
        return top_k(tfidf_scores(index, queries), k, "qid")
    terms = bound_terms(index, queries).withColumn("idf", scoring.tfidf_idf(F.col("df"), index.n_docs())).withColumn("ub", F.lit(0.0))
    return top_k(arrays.best(index, terms, "idf", _tfidf_gain, k, DIGITS), k, "qid")


def _bm25_best(index: Index, queries: DataFrame, k: int, dedup: bool, k1: float, b: float, pruned: bool) -> DataFrame:
    terms = _bm25_terms(index, queries, dedup, k1)
    terms = terms if pruned else terms.withColumn("ub", F.lit(0.0))
    avgdl = index.docs.agg(F.avg("doc_len").alias("a")).first()["a"]
    return top_k(arrays.best(index, terms, "idf", _bm25_gain(avgdl or 1.0, k1, b), k, DIGITS), k, "qid")


def bm25(index: Index, queries: DataFrame, k: int = 10, dedup: bool = False, k1: float = scoring.K1, b: float = scoring.B) -> DataFrame:
    if k < 1:
        return top_k(bm25_scores(index, queries, dedup, k1, b), k, "qid")
    return _bm25_best(index, queries, k, dedup, k1, b, pruned=False)


#: No longer read: terms that can't lift a document to the bound are left out in every group of documents.
CANDIDATES_FIRST = 20_000_000


def pruned_terms(index: Index, queries: DataFrame, k: int = 10, k1: float = scoring.K1, b: float = scoring.B) -> tuple[DataFrame, DataFrame]:
    """Gains (term, doc_id, gain) of the batch's terms, and its terms (qid, term, df, ub, essential).

    As gains are positive, a query's k-th best score is at least the k-th best gain of any of its terms, theta.
    Terms are non-essential as long as their bounds, the least first, add up to less: a document that holds
    no other term can't be among the k best.
    """
    asked = _bm25_terms(index, queries, True, k1)
    gains = index.gains(asked.select("term", "idf").distinct(), k1, b)
    depth = next((d for d in DEPTHS if d >= k), None)
    if index.thresholds is not None and depth and (k1, b) == (scoring.K1, scoring.B):
        # the gain at a greater depth is less, so that it is a threshold as well
        kth = index.thresholds.select("term", F.col(f"kth_{depth}").alias("kth"))
    else:
        gains = stored(gains, "gains")
        # the k best of each term are cut within each task before the shuffle
        best = gains.withColumn("n", F.row_number().over(W.partitionBy("term").orderBy(F.desc("gain")))).filter(F.col("n") <= k)
        kth = best.groupBy("term").agg(F.min("gain").alias("kth"), F.count("*").alias("n")).filter(F.col("n") == k)
    theta = F.max("kth").over(W.partitionBy("qid"))
    upto = F.sum("ub").over(W.partitionBy("qid").orderBy("ub", "term").rowsBetween(W.unboundedPreceding, W.currentRow))
    slack = 10 ** -(DIGITS - 1)
    marked = asked.join(kth.select("term", "kth"), "term", "left").withColumn("essential", upto >= F.coalesce(theta, F.lit(0.0)) - slack)
    return gains, marked.select("qid", "term", "df", "ub", "essential")


def _met(gains: DataFrame, terms: DataFrame) -> DataFrame:
    """qid, doc_id, score, essential: documents that hold a query term, and whether they hold an essential one."""
    hits = gains.join(terms.select("qid", "term", "essential"), "term")
    return hits.groupBy("qid", "doc_id").agg(F.sum("gain").alias("score"), F.max("essential").alias("essential"))


def bm25_pruned(index: Index, queries: DataFrame, k: int = 10, k1: float = scoring.K1, b: float = scoring.B) -> DataFrame:
    """The same rows as ``bm25(dedup=True)``, leaving out documents whose bound stays below the threshold."""
    if k < 1:
        return top_k(bm25_scores(index, queries, True, k1, b), k, "qid")
    return _bm25_best(index, queries, k, True, k1, b, pruned=True)


def pruning_statistics(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """qid, met, kept: documents that hold a query term, and those that the bounds leave over."""
    return _met(*pruned_terms(index, queries, k)).groupBy("qid").agg(F.count("*").alias("met"), F.count_if("essential").alias("kept"))


def weight_matrix(index: Index, n_docs: Column | None = None) -> DataFrame:
    """term, doc_id, weight = (1 + ln tf) ln(N / (df + 1)); N counts all documents known, if given."""
    n = index.n_docs() if n_docs is None else n_docs
    rows = index.postings.join(index.terms.select("term", "df"), "term")
    return rows.select("term", "doc_id", scoring.lsi_weight(F.col("tf"), F.col("df"), n).alias("weight"))
