"""Metrics of rankings (qid, rank, rel): RBP, DCG, NDCG, AP, and their means per method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """run(qid, rank, doc_id, ...) with rel from qrels(qid, doc_id, rel); 0 where there is no judgement."""
    rel = qrels.groupBy("qid", "doc_id").agg(F.max("rel").alias("rel"))
    return run.join(rel, ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def _by_query(ranking: DataFrame, value, name: str) -> DataFrame:
    return ranking.groupBy("qid").agg(F.coalesce(value, F.lit(0.0)).alias(name))


def _cut(ranking: DataFrame, p: int | None) -> DataFrame:
    return ranking if p is None else ranking.filter(F.col("rank") <= p)


def rbp(ranking: DataFrame, p: float = 0.8) -> DataFrame:
    """(1 - p) * sum of rel p^(rank - 1)"""
    return _by_query(ranking, (1 - p) * F.sum(F.col("rel") * F.pow(F.lit(p), F.col("rank") - 1)), "rbp")


def _discounted(rank: str):
    return F.sum(F.when(F.col("rel") > 0, F.col("rel") * F.ln(F.lit(2.0)) / F.ln(F.col(rank).cast("double") + 1)))


def dcg(ranking: DataFrame, p: int | None = None) -> DataFrame:
    """Sum of rel / log2(rank + 1) over the first p ranks, positive rel only."""
    return _by_query(_cut(ranking, p), _discounted("rank"), "dcg")


def ndcg(ranking: DataFrame, p: int | None = None) -> DataFrame:
    """DCG over that of the same (cut) list in its best order; 0 if nothing in it is relevant."""
    cut = _cut(ranking, p)
    best = cut.withColumn("best", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rel"), F.asc("rank"))))
    both = best.groupBy("qid").agg(_discounted("rank").alias("d"), _discounted("best").alias("i"))
    return both.select("qid", F.coalesce(F.when(F.col("i") > 0, F.col("d") / F.col("i")), F.lit(0.0)).alias("ndcg"))


def ap(ranking: DataFrame) -> DataFrame:
    """Mean precision at the ranks with rel = 1, over the sum of rel retrieved; 0 without any."""
    run = W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    hit = (F.col("rel") == 1).cast("double")
    seen = ranking.withColumn("precision", F.sum(hit).over(run) / F.col("rank"))
    total = F.sum("rel")
    return _by_query(seen, F.when(total > 0, F.sum(F.when(F.col("rel") == 1, F.col("precision"))) / total), "ap")


def ap_full(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """As ``ap``, over all relevant documents of the query, retrieved or not."""
    run = W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = ranking.withColumn("precision", F.sum((F.col("rel") == 1).cast("double")).over(run) / F.col("rank"))
    gained = seen.groupBy("qid").agg(F.sum(F.when(F.col("rel") == 1, F.col("precision"))).alias("g"))
    total = qrels.groupBy("qid").agg(F.sum("rel").alias("r"))
    return gained.join(total, "qid", "left").select("qid", F.coalesce(F.when(F.col("r") > 0, F.col("g") / F.col("r")), F.lit(0.0)).alias("ap_full"))


def ndcg_full(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """As ``ndcg``, over the best order of all judged documents of the query, retrieved or not."""
    order = W.partitionBy("qid").orderBy(F.desc("rel"), F.asc("doc_id"))
    once = qrels.groupBy("qid", "doc_id").agg(F.max("rel").alias("rel")).filter("rel > 0")
    ideal = once.withColumn("best", F.row_number().over(order)).groupBy("qid").agg(_discounted("best").alias("i"))
    gained = ranking.groupBy("qid").agg(F.coalesce(_discounted("rank"), F.lit(0.0)).alias("d"))
    return gained.join(ideal, "qid", "left").select("qid", F.coalesce(F.when(F.col("i") > 0, F.col("d") / F.col("i")), F.lit(0.0)).alias("ndcg_full"))


def all_metrics(ranking: DataFrame) -> DataFrame:
    """qid, rbp, dcg, ndcg, ap in one aggregation after two windows over the same partitioning."""
    by = W.partitionBy("qid")
    run = by.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = ranking.withColumn("precision", F.sum((F.col("rel") == 1).cast("double")).over(run) / F.col("rank")).withColumn(
        "best", F.row_number().over(by.orderBy(F.desc("rel"), F.asc("rank")))
    )
    sums = rows.groupBy("qid").agg(
        (F.lit(0.2) * F.sum(F.col("rel") * F.pow(F.lit(0.8), F.col("rank") - 1))).alias("rbp"),
        F.coalesce(_discounted("rank"), F.lit(0.0)).alias("dcg"), F.coalesce(_discounted("best"), F.lit(0.0)).alias("ideal"),
        F.sum(F.when(F.col("rel") == 1, F.col("precision"))).alias("gained"), F.sum("rel").alias("r"),
    )
    zero = F.lit(0.0)
    return sums.select(
        "qid", "rbp", "dcg",
        F.coalesce(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")), zero).alias("ndcg"),
        F.coalesce(F.when(F.col("r") > 0, F.col("gained") / F.col("r")), zero).alias("ap"),
    )


def report(queries: DataFrame, rankings: dict[str, DataFrame]) -> DataFrame:
    """method, mean_rbp, mean_dcg, mean_ndcg, mean_ap over all queries; one without a hit counts as 0."""
    out = None
    for method, ranking in rankings.items():
        scored = queries.select("qid").join(all_metrics(ranking), "qid", "left")
        means = [F.avg(F.coalesce(m, F.lit(0.0))).alias(f"mean_{m}") for m in ("rbp", "dcg", "ndcg", "ap")]
        row = scored.agg(*means).select(F.lit(method).alias("method"), *[f"mean_{m}" for m in ("rbp", "dcg", "ndcg", "ap")])
        out = row if out is None else out.unionByName(row)
    return out
