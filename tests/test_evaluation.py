"""The registered evaluation over a small collection that is deeper than the depth of the SQL."""

import __spark_entry__ as entry
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("deep"))
    # the first 120 documents rank above the others, but only the others hold the query's words in a row
    docs = [(i, f"d{i}", "a", "cat big" if i < 120 else "big cat " + "fish " * 40) for i in range(150)] + [(200 + i, f"d{200 + i}", "a", "bird") for i in range(400)]
    spark.createDataFrame(docs, "doc_id bigint, doc_name string, block string, text string").write.parquet(f"{path}/collection_docs.parquet")
    spark.createDataFrame([("Q1", "big cat")], "qid string, text string").write.parquet(f"{path}/queries.parquet")
    return path


def test_evaluation_reaches_the_depth_of_the_reference(spark, folder):
    ask = lambda name: entry.queries()[name](spark, folder)
    found = ask("qrels_join_1000")
    assert found.count() == 150 and [r["rank"] for r in found.filter("rel = 1").orderBy("rank").collect()] == list(range(121, 151))
    precision = sum((i + 1) / (121 + i) for i in range(30)) / 30
    assert ask("metric_ap_1000").first()["ap"] == round(precision, 6)
    assert ask("metric_dcg_1000").first()["dcg"] > 0 and ask("metric_ndcg_1000").first()["ndcg"] > 0
    assert ask("metric_rbp_1000").count() == 1
    report = {r["method"]: r for r in ask("eval_report_1000").collect()}
    assert set(report) == {"tfidf", "bm25", "wand", "adaptive"}
    assert all(report[m]["mean_ap"] == round(precision, 6) for m in ("tfidf", "bm25", "wand"))


def test_singular_values_have_the_full_rank(spark, tmp_path):
    docs = [(i, f"d{i}", "a", f"z{chr(98 + i // 8)}{chr(98 + i % 8)}k") for i in range(60)]
    spark.createDataFrame(docs, "doc_id bigint, doc_name string, block string, text string").write.parquet(f"{tmp_path}/collection_docs.parquet")
    assert entry.queries()["lsi_singular_values"](spark, str(tmp_path)).count() == 59
