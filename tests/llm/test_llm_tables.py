"""Counting, top N, distinctiveness, fusion: against plain Python over small tables with all kinds of dirt."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import common, distinctive, frequency, fusion, topn
from tests.conftest import rows

POSTINGS = [("a", 1, 2), (" A ", 1, 2), ("a", 2, 1), ("b", 2, 5), ("\tb", 3, 1), ("", 1, 1), (None, 1, 1), ("c", None, 1), ("c", 3, 0), ("c", 3, None), ("d", 3, 4), ("d", 3, 4)]


@pytest.fixture(scope="module")
def postings(spark):
    return spark.createDataFrame(POSTINGS, "term string, doc_id bigint, tf bigint").withColumn("value", F.lit("clash"))


def test_valid_postings(postings):
    assert set(rows(common.valid_postings(postings))) == {("a", 1, 2), ("a", 2, 1), ("b", 2, 5), ("b", 3, 1), ("d", 3, 4)}


def test_frequencies(spark, postings):
    valid = common.valid_postings(postings)
    got = frequency.value_frequencies(valid, "term", "doc_id", F.col("tf"))
    assert rows(got) == [("a", 3, 2), ("b", 6, 2), ("d", 4, 1)]
    n = frequency.record_count(valid, "doc_id").scalar()
    assert {r.term: r.mark for r in frequency.marked_frequencies(got, n).collect()} == {"a": "common", "b": "common", "d": "rare"}
    tokens = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), (None, 1), ("y", None)], "term string, doc_id bigint")
    assert rows(frequency.value_frequencies(tokens, "term", "doc_id", repeats=True)) == [("x", 3, 2)]
    assert frequency.value_frequencies(tokens.limit(0), "term", "doc_id").count() == 0


def test_hot_term_is_counted_in_shards(spark):
    hot = spark.range(3000).select(F.lit("hot").alias("term"), F.col("id").alias("doc_id")).union(spark.range(50).select(F.lit("cold"), "id"))
    for salts in (None, 1, 1000):
        assert rows(frequency.value_frequencies(hot.union(hot), "term", "doc_id", salts=salts)) == [("cold", 50, 50), ("hot", 3000, 3000)]


def test_top_n(spark):
    data = [("q", 1, 2.0), ("q", 2, 2.0), ("q", 3, 5.0), ("q", 3, 1.0), ("q", 4, None), ("q", 5, float("nan")), ("q", -9, 2.0), (None, 1, 1.0), ("z", None, 1.0),
            ("m", -(2**63), 1.0), ("m", 2**63 - 1, 1.0), ("n", 1, -1.0), ("n", 2, float("inf")), ("n", 3, float("-inf"))]
    df = spark.createDataFrame(data, "qid string, doc_id bigint, score double").withColumn("rank", F.lit(7))
    got = defaultdict(list)
    for r in topn.top_n(df, "qid", "doc_id", "score", 3).orderBy("qid", "rank").collect():
        got[r.qid].append((r.doc_id, r.score))
    assert got == {"q": [(3, 5.0), (-9, 2.0), (1, 2.0)], "m": [(-(2**63), 1.0), (2**63 - 1, 1.0)], "n": [(2, math.inf), (1, -1.0), (3, -math.inf)]}
    assert topn.top_n(df, "qid", "doc_id", "score", 0).count() == 0 and topn.top_n(df.limit(0), "qid", "doc_id", "score").count() == 0


def test_top_n_of_a_hot_group(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("g"), F.col("id"))).otherwise("hot").alias("qid"), F.col("id").alias("doc_id"), (F.col("id") % 10).cast("double").alias("score"))
    hot = topn.top_n(df, "qid", "doc_id", "score", 4).filter("qid = 'hot'").orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in hot] == [(19, 9.0), (29, 9.0), (49, 9.0), (59, 9.0)]


def test_heaps_merge_in_any_order(spark, monkeypatch):
    """Small heaps that are handed on early, items that come again with a better score, one shuffle only."""
    monkeypatch.setattr(topn, "GATHERED", 7)
    monkeypatch.setattr(topn, "HELD", 20)
    rng = random.Random(3)
    data = [(rng.choice("aaaab") if i % 3 else f"g{i % 50}", rng.randrange(60), float(rng.randrange(25))) for i in range(4000)]
    best = defaultdict(dict)
    for g, i, x in data:
        best[g][i] = max(best[g].get(i, -1.0), x)
    want = {g: sorted(v.items(), key=lambda e: (-e[1], e[0]))[:5] for g, v in best.items()}
    df = spark.createDataFrame(data, "g string, item bigint, x double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    got = defaultdict(list)
    top = topn.top_n(df, "g", "item", "x", 5)
    for r in top.orderBy("g", "rank").collect():
        got[r.g].append((r["item"], r.x))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    plan = topn.top_n(spark.range(5).select("id", F.col("id").alias("i"), F.col("id").alias("x")), "id", "i", "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_distinctiveness(spark, postings):
    lengths = spark.createDataFrame([(1, 10), (1, 4), (2, 1), (2, None), (9, 3), (None, 3)], "doc_id bigint, doc_len bigint")
    got = {(r.doc_id, r.term): r for r in distinctive.distinctiveness(common.valid_postings(postings), lengths).collect()}
    assert len(got) == 5 and got[1, "a"].doc_len == 10 and got[2, "b"].doc_len == 6 and got[3, "d"].doc_total == 5
    assert math.isclose(got[1, "a"].score, 2 / 10 * (math.log(4 / 3) + 1))
    assert distinctive.distinctiveness(common.valid_postings(postings.limit(0))).count() == 0


def test_heavy_terms_take_the_broadcast_side(spark, monkeypatch):
    monkeypatch.setattr(distinctive, "HEAVY", 50)
    pairs = spark.range(200).select(F.lit("hot").alias("term"), F.col("id").alias("doc_id"), F.lit(1).cast("bigint").alias("tf")).union(spark.range(7).select(F.lit("cold"), "id", F.lit(2).cast("bigint")))
    got = distinctive.distinctiveness(pairs).groupBy("term", "df").count()
    assert rows(got) == [("cold", 7, 7), ("hot", 200, 200)]


def dense_walk(ranks, damping):
    n, scores = ranks.shape
    p = np.zeros((n, n))
    for i in range(n):
        have = [s for s in range(scores) if ranks[i, s] >= 0]
        for s in have:
            for j in range(n):
                if 0 <= ranks[j, s] <= ranks[i, s]:
                    p[i, j] += 1 / len(have) / (ranks[i, s] + 1)
        if not have:
            p[i] = 1 / n
    p = damping * p + (1 - damping) / n
    v = np.full(n, 1 / n)
    for _ in range(500):
        v = v @ p
    return v


def some_ranks(rng, n):
    """Two rankings of n items, of which the second one lacks some."""
    ranks = np.stack([rng.permutation(n), rng.permutation(n)], 1)
    drop = rng.random(n) < 0.3
    ranks[:, 1] = np.where(drop, -1, np.searchsorted(np.sort(ranks[~drop, 1]), ranks[:, 1]))
    return ranks


def test_walk_is_the_stationary_distribution():
    ranks = some_ranks(np.random.default_rng(5), 12)
    assert np.allclose(fusion.walk(ranks), dense_walk(ranks, fusion.DAMPING), rtol=1e-11, atol=0)


def test_groups_walk_alike_together(monkeypatch):
    rng = np.random.default_rng(6)
    groups = [some_ranks(rng, n) for n in (1, 2, 3, 7, 8, 9, 40, 5, 8)]
    alone = np.concatenate([fusion.walk(g) for g in groups])
    sizes = np.array([len(g) for g in groups])
    together = fusion.walks(np.concatenate(groups), sizes)
    monkeypatch.setattr(fusion, "CELLS", 16)
    assert np.allclose(together, alone, rtol=1e-12, atol=0) and np.allclose(fusion.walks(np.concatenate(groups), sizes), alone, rtol=1e-12, atol=0)


SCORES = [("q", i, float(i * 1000 % 37) if i % 4 else None, float(-i % 11) if i % 3 else None) for i in range(25)] + [("q", 1, 2000.0, None), (None, 1, 1.0, 1.0), ("z", None, 1.0, 1.0), ("w", 5, float("nan"), None)]


def test_fused_ranking(spark, monkeypatch):
    df = spark.createDataFrame(SCORES, "qid string, doc_id bigint, lex_score double, sem_score double").withColumn("mass", F.lit(1))
    names = ["lex_score", "sem_score"]
    local = fusion.fused_ranking(df, "qid", "doc_id", names)
    top = local.filter("qid = 'q'").orderBy("rank").collect()
    assert [r["rank"] for r in top] == list(range(1, 26)) and top[0].rank_lex_score is not None
    assert local.filter("qid = 'w'").first()["rank"] == 1
    scaled = df.withColumn("lex_score", F.exp(F.col("lex_score") / 300))
    assert [(r.qid, r.doc_id) for r in local.orderBy("qid", "rank").collect()] == [(r.qid, r.doc_id) for r in fusion.fused_ranking(scaled, "qid", "doc_id", names).orderBy("qid", "rank").collect()]
    monkeypatch.setattr(fusion, "STRIP", 4)
    few = [rows(fusion.fused_ranking(df, "qid", "doc_id", names, damping=0.4, local=n)) for n in (10, 1000)]
    mass = slice(4, 5)
    assert [r[:4] + r[5:] for r in few[0]] == [r[:4] + r[5:] for r in few[1]]
    assert np.allclose([r[mass] for r in few[0]], [r[mass] for r in few[1]], rtol=1e-11, atol=0)
    assert fusion.fused_ranking(df.limit(0), "qid", "doc_id", names).count() == 0


def test_masses_of_a_group_of_a_million_stay_apart(spark):
    n = fusion.LOCAL
    df = spark.range(n).select(F.lit("q").alias("qid"), F.col("id").alias("doc_id"), F.xxhash64("id", F.lit(1)).cast("double").alias("a"), F.xxhash64("id", F.lit(2)).cast("double").alias("b"))
    got = fusion.fused_ranking(df, "qid", "doc_id", ["a", "b"]).agg(F.count("*"), F.countDistinct("mass"), F.countDistinct("rank")).first()
    assert got[0] == got[2] == n and got[1] >= n - 5


def test_groups_of_many_batches(spark, monkeypatch):
    """Groups lie across the borders of batches."""
    df = spark.range(9000).select((F.sqrt("id")).cast("int").alias("qid"), F.col("id").alias("doc_id"), F.xxhash64("id").cast("double").alias("a"))
    want = [tuple(r) for r in df.orderBy("qid", F.desc("a")).select("qid", "doc_id").collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    got = [tuple(r) for r in fusion.fused_ranking(df, "qid", "doc_id", ["a"]).orderBy("qid", "rank").select("qid", "doc_id").collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
