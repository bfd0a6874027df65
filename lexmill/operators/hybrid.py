"""Fusion of a lexical and a semantic ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.scoring import min_max
from lexmill.functions.text import clean_words
from lexmill.operators.ranking import DIGITS, top_k

#: Weight of the semantic score; for queries of one token or none, whatever weight is asked for.
WEIGHT, SHORT_WEIGHT = 0.6, 0.2
DEPTH = 100


def fuse(lexical: DataFrame, semantic: DataFrame, queries: DataFrame, k: int = 10, weight: float = WEIGHT) -> DataFrame:
    """qid, rank, doc_id, score from (qid, doc_id, score) lists that are at most DEPTH deep.

    Each list is scaled by its least and greatest score per query, the range being at least 1e-5, so a list
    of one hit scales to 0. A document absent from a list counts with that list's least score.
    """
    both = lexical.select("qid", "doc_id", F.col("score").alias("lex")).join(semantic.select("qid", "doc_id", F.col("score").alias("sem")), ["qid", "doc_id"], "full_outer")
    per = W.partitionBy("qid")

    def scaled(c: str):
        low, high = F.min(c).over(per), F.max(c).over(per)
        return F.coalesce(min_max(F.coalesce(c, low), low, high), F.lit(0.0))

    tokens = queries.select("qid", F.size(clean_words(F.col("text"))).alias("n"))
    w = F.when(F.coalesce("n", F.lit(0)) <= 1, F.lit(SHORT_WEIGHT)).otherwise(F.lit(weight))
    scored = both.select("qid", "doc_id", scaled("lex").alias("l"), scaled("sem").alias("s")).join(tokens, "qid", "left")
    return top_k(scored.select("qid", "doc_id", F.round((1 - w) * F.col("l") + w * F.col("s"), DIGITS).alias("score")), k, "qid")
