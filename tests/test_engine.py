import math

import pytest
from pyspark.sql import functions as F

from lexmill.operators import dictionary, hybrid, index, lsi, metrics, ranking, snippets
from lexmill.plans import evaluate
from tests.conftest import rows

DOCS = [(1, "a", "cat cat dog"), (2, "a", "dog bird"), (3, "b", "bird bird bird fish"), (4, "b", ""), (5, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, block string, text string")


@pytest.fixture(scope="module")
def toy(docs):
    return index.Index.build(docs).cached()


def ask(spark, *texts):
    return spark.createDataFrame([(f"Q{i}", t) for i, t in enumerate(texts)], "qid string, text string")


def scores(df):
    return {(r.qid, r.doc_id): round(r.score, 6) for r in df.collect()}


def test_statistics(toy):
    assert rows(toy.docs) == [(1, 3), (2, 2), (3, 4)]
    assert rows(toy.terms) == [("bird", 2, 4), ("cat", 1, 2), ("dog", 2, 2), ("fish", 1, 1)]
    assert tuple(toy.stats.first()) == (3, 9, 3.0)
    ub = {r.term: round(r.ub, 6) for r in toy.weighted_terms().collect()}
    assert ub["cat"] == 2.157824 and ub["dog"] == 1.034008


def test_rankings(spark, toy):
    q = ask(spark, "cat dog", "dog dog", "", "unknown")
    assert scores(ranking.bm25(toy, q)) == {("Q0", 1): 1.818644, ("Q0", 2): 0.544215, ("Q1", 2): 1.088429, ("Q1", 1): 0.940007}
    assert scores(ranking.tfidf(toy, q.filter("qid = 'Q0'"))) == {("Q0", 1): 2.265577, ("Q0", 2): 0.405465}
    plain, pruned = rows(ranking.bm25(toy, q, 1, dedup=True)), rows(ranking.bm25_pruned(toy, q, 1))
    assert plain == pruned and len(plain) == 2
    assert ranking.bm25(toy, q, 0).count() == 0


def test_pruned_equals_exhaustive_on_many(spark, monkeypatch):
    words = [f"w{c}" for c in "abcdefghij"]
    docs = [(i, "x", " ".join(words[(i * k) % 10][1:] * 2 for k in range(1, 2 + i % 7))) for i in range(120)]
    ix = index.Index.build(spark.createDataFrame(docs, "doc_id bigint, block string, text string")).cached()
    q = ask(spark, "aa bb cc", "dd ee ff gg", "aa", "hh ii jj aa bb")
    for k in (1, 3, 10):
        assert rows(ranking.bm25(ix, q, k, dedup=True)) == rows(ranking.bm25_pruned(ix, q, k))
    monkeypatch.setattr(ranking, "CANDIDATES_FIRST", -1)
    assert rows(ranking.bm25(ix, q, 3, dedup=True)) == rows(ranking.bm25_pruned(ix, q, 3))


def test_pruning_leaves_out_documents_of_common_terms(spark, toy):
    docs = [(i, "x", "rare common" if i < 30 else "common word") for i in range(400)]
    ix = index.Index.build(spark.createDataFrame(docs, "doc_id bigint, block string, text string"))
    q = ask(spark, "rare common")
    for known in (ix, ix.cached()):
        assert rows(ranking.pruning_statistics(known, q, 10)) == [("Q0", 400, 30)]
        assert rows(ranking.bm25(ix, q, 7, dedup=True)) == rows(ranking.bm25_pruned(known, q, 7))
    assert rows(ranking.bm25(ix, q, 10, dedup=True)) == rows(ranking.bm25_pruned(ix, q, 10))


def test_blocks_merge_to_the_same_postings(docs, toy):
    assert rows(index.merge_postings(index.block_postings(docs))) == rows(toy.postings)
    assert rows(index.merge_postings(toy.postings, toy.postings)) == [(t, d, 2 * n) for t, d, n in rows(toy.postings)]
    assert rows(index.gaps_decoded(index.postings_gaps(toy.postings)).select("term", "doc_id", "tf")) == rows(toy.postings)


def test_long_lists_are_cut(spark):
    postings = spark.createDataFrame([("t", i * 3, 1) for i in range(100)] + [("t", 10**9, 3)] + [("u", 5, 2)], "term string, doc_id bigint, tf bigint")
    lists = index.postings_lists(postings, chunk=16)
    back = lists.select("term", F.explode(F.arrays_zip("doc_ids", "tfs")).alias("p")).select("term", "p.doc_ids", "p.tfs")
    assert rows(back) == rows(postings) and [r.df for r in lists.filter("term = 't'").orderBy("chunk").collect()] == [16] * 6 + [5]
    assert rows(lists.filter("chunk > 0 and doc_ids[0] <= 45")) == []
    for codec in ("standard", "vbe", "elias"):
        coded = index.encoded_lists(lists, codec).agg(F.sum(F.octet_length("postings_bytes")), F.sum(F.octet_length("tf_bytes"))).first()
        assert tuple(coded) == tuple(index.codec_sizes(postings, chunk=16).filter(F.col("codec") == codec).first())[1:]


def test_save_and_open(spark, toy, tmp_path):
    saved = toy.save(str(tmp_path / "ix"), files=2)
    assert rows(saved.postings) == rows(toy.postings) and rows(saved.lookup("cat")) == [("cat", 1, 2)]
    assert [(r.term_id, r.term, round(r.ub, 6)) for r in saved.terms.orderBy("term_id").collect()][1] == (1, "cat", 2.157824)
    assert saved.thresholds.count() == 4 and "kth_10" not in saved.terms.columns
    assert rows(ranking.bm25_pruned(saved, ask(spark, "cat dog"), 1)) == rows(ranking.bm25(toy, ask(spark, "cat dog"), 1))
    assert rows(ranking.bm25(saved, ask(spark, "cat dog"))) == rows(ranking.bm25(toy, ask(spark, "cat dog")))
    with pytest.raises(ValueError):
        index.Index.open(spark, str(tmp_path / "ix"), "elias")


def test_an_index_of_the_first_version_opens(spark, toy, tmp_path):
    path = str(tmp_path / "old")
    toy.save(path, files=2)
    toy.terms.write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame([("vbe", 1)], "codec string, version int").write.mode("overwrite").parquet(f"{path}/meta")
    old = index.Index.open(spark, path)
    assert {r.term: round(r.ub, 6) for r in old.terms.collect()}["cat"] == 2.157824 and old.names is None


def test_metadata_of_old_blocks(spark):
    rows_ = [("a", "cat", 2, 1.5), ("a", "cat", 2, 1.5), ("b", "cat", 1, 1.7), ("a", "dog", 1, None), ("b", "dog", 1, 0.4), (None, "x", 1, 1.0), ("a", None, 1, 1.0)]
    got = {r.term: (r.df, round(r.ub, 6)) for r in index.block_metadata(spark.createDataFrame(rows_, "block string, term string, df bigint, ub double"), F.lit(3)).collect()}
    assert got == {"cat": (3, 1.7), "dog": (2, 1.034008)}


def test_empty_corpus(spark):
    ix = index.Index.build(spark.createDataFrame([], "doc_id bigint, block string, text string"))
    assert ix.stats.first()[0] == 0 and ranking.bm25(ix, ask(spark, "cat")).count() == 0
    assert ranking.bm25_pruned(ix, ask(spark, "cat")).count() == 0


def test_dictionary(spark):
    terms = spark.createDataFrame([("cat",), ("car",), ("dog",), (None,), ("cat",)], "term string")
    assert rows(dictionary.dense_ids(terms, "term", "id")) == [(0, "car"), (1, "cat"), (2, "dog")]
    assert tuple(dictionary.tree_nodes(terms.distinct()).first()) == (7, 4)
    assert rows(dictionary.unknown(spark.createDataFrame([("cow",), ("cat",)], "term string"), terms, "term")) == [("cow",)]


def test_metrics(spark):
    ranking_ = spark.createDataFrame([("q", i + 1, r) for i, r in enumerate([1, 0, 1, 1, 0])] + [("z", 1, 0), ("z", 2, 0)], "qid string, rank bigint, rel int")
    got = {r.qid: r for r in metrics.all_metrics(ranking_).collect()}
    assert [round(x, 6) for x in got["q"][1:]] == [0.4304, 1.930677, 0.906025, 0.805556]
    assert list(got["z"][1:]) == [0.0, 0.0, 0.0, 0.0]
    for f, c in ((metrics.rbp, "rbp"), (metrics.dcg, "dcg"), (metrics.ndcg, "ndcg"), (metrics.ap, "ap")):
        assert {r.qid: round(r[c], 6) for r in f(ranking_).collect()} == {k: round(v[c], 6) for k, v in got.items()}
    assert {r.qid: r.dcg for r in metrics.dcg(ranking_, 2).collect()}["q"] == 1.0
    qrels = spark.createDataFrame([("q", 1, 1), ("q", 3, 1), ("q", 4, 1), ("q", 9, 1), ("q", 9, 1)], "qid string, doc_id bigint, rel int")
    full = 1.930677 / sum(1 / math.log2(i + 1) for i in range(1, 5))
    assert {r.qid: round(r.ndcg_full, 5) for r in metrics.ndcg_full(ranking_, qrels).collect()} == {"q": round(full, 5), "z": 0.0}


def test_report_counts_queries_without_hits(spark, toy):
    q = ask(spark, "cat", "unknown")
    qrels = spark.createDataFrame([("Q0", 1, 1)], "qid string, doc_id bigint, rel int")
    row = evaluate.evaluate(evaluate.lexical_methods(toy), q, qrels, 10).filter("method = 'bm25'").first()
    assert row.mean_ap == 0.5 and row.mean_ndcg == 0.5


def test_fusion(spark):
    lex = spark.createDataFrame([("Q0", 1, 10.0), ("Q0", 2, 5.0), ("Q1", 1, 10.0), ("Q1", 2, 5.0), ("Q2", 1, 10.0)], "qid string, doc_id bigint, score double")
    sem = spark.createDataFrame([("Q0", 2, 0.9), ("Q0", 3, 0.1), ("Q1", 2, 0.9), ("Q1", 3, 0.1)], "qid string, doc_id bigint, score double")
    got = scores(hybrid.fuse(lex, sem, ask(spark, "cat dog", "cat", "cat dog")))
    assert got == {("Q0", 2): 0.6, ("Q0", 1): 0.4, ("Q0", 3): 0.0, ("Q1", 1): 0.8, ("Q1", 2): 0.2, ("Q1", 3): 0.0, ("Q2", 1): 0.0}


def test_snippets(spark):
    long = " ".join(f"w{i}" if i != 35 else "dog" for i in range(40))
    docs = spark.createDataFrame([(1, "dogs and cats saw Dogma"), (2, long), (3, ""), (4, None)], "doc_id bigint, text string")
    q = ask(spark, "dog", "the")
    hits = q.select("qid").crossJoin(docs.select("doc_id"))
    got = {(r.qid, r.doc_id): r.snippet for r in snippets.snippets(hits, docs, q).collect()}
    assert got["Q0", 1] == "... **dogs** and cats saw **Dogma** ..." and got["Q0", 3] == got["Q0", 4] == got["Q1", 1] == ""
    assert snippets.best_windows(hits, docs, q).filter("doc_id = 2").first().start == 6


def test_latent_vectors_match_a_dense_decomposition(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    docs = [(i, "x", " ".join(rng.choice(list("bcdfghjklm"), 12)).replace(" ", "q ") + "q") for i in range(30)]
    ix = index.Index.build(spark.createDataFrame(docs, "doc_id bigint, block string, text string")).cached()
    w = ranking.weight_matrix(ix).toPandas().pivot_table(index="term", columns="doc_id", values="weight", fill_value=0.0).to_numpy()
    sigma = np.linalg.svd(w, compute_uv=False)
    fitted = lsi.fit(ix, rank=4)
    assert np.allclose(fitted.sigma, sigma[:4], rtol=1e-3)
    assert all(math.isclose(sum(x * x for x in r.vec), 1, rel_tol=1e-9) for r in fitted.docs.collect())
    near = lsi.semantic_top(fitted.docs, lsi.query_vectors(fitted, ask(spark, "bq cq", "zzz")), 3)
    assert [r.doc_id for r in near.filter("qid = 'Q1'").orderBy("rank").collect()] == [0, 1, 2]
    saved = fitted.save(str(tmp_path / "vectors"))
    assert saved.sigma == fitted.sigma and rows(saved.docs) == rows(fitted.docs) and rows(saved.terms) == rows(fitted.terms)


def test_queries_in_blocks_equal_queries_sent_to_all(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, rng.standard_normal(6).tolist()) for i in range(300)], "doc_id bigint, vec array<double>")
    queries = spark.createDataFrame([(f"q{i}", rng.standard_normal(6).tolist()) for i in range(50)], "qid string, vec array<double>")
    assert rows(lsi.semantic_top(docs, queries, 5)) == rows(lsi.semantic_top(docs, queries, 5, block=7))
    assert lsi.semantic_top(docs, queries.limit(0), 5).count() == 0 and lsi.semantic_top(docs.limit(0), queries, 5, block=7).count() == 0


def test_rankings_over_arrays_equal_those_over_rows(spark):
    """Groups tell bounds first; ties, queries with fewer documents than asked for, terms of all documents."""
    import random

    rng = random.Random(5)
    words = ["brim", "calt", "dolp", "fent", "gorm", "hask", "jund"]
    docs = [(i * 7 - 900, "x", " ".join(["all"] + rng.choices(words, range(7, 0, -1), k=rng.randint(1, 6)))) for i in range(900)] + [(10**12, "x", "zorp brim")]
    ix = index.Index.build(spark.createDataFrame(docs, "doc_id bigint, block string, text string"))
    q = ask(spark, "brim", "brim calt brim", "jund hask gorm", "all", "zorp", "all jund", "nothing")
    for k in (1, 10, 64, 1000):
        assert rows(ranking.tfidf(ix, q, k)) == rows(ranking.top_k(ranking.tfidf_scores(ix, q), k, "qid"))
        assert rows(ranking.bm25(ix, q, k)) == rows(ranking.top_k(ranking.bm25_scores(ix, q), k, "qid"))
        assert rows(ranking.bm25_pruned(ix, q, k)) == rows(ranking.top_k(ranking.bm25_scores(ix, q, True), k, "qid"))


def test_rankings_make_no_row_of_every_query_and_document(spark):
    """What is shuffled grows with the results: 400 queries that each meet 2,000 documents give up 800,000 rows before."""
    from lexmill.operators import arrays

    docs = [(i, "x", "brim " + "calt " * (i % 50)) for i in range(2000)]
    ix = index.Index.build(spark.createDataFrame(docs, "doc_id bigint, block string, text string"))
    asked = spark.createDataFrame([(f"Q{i}", "brim", 1, 0.0, 1.0) for i in range(400)], "qid string, term string, qtf bigint, ub double, idf double")
    got = arrays.best(ix, asked, "idf", ranking._bm25_gain(25.0, 1.2, 0.75), 5, 6)
    assert 400 * 5 <= got.count() <= 400 * 20


def test_a_decomposition_leaves_no_tables_of_its_rounds(spark):
    """Before, the matrix, and vectors of all terms and documents for each round, stayed on disk."""
    from lexmill import session

    docs = [(i, "x", f"w{chr(98 + i % 9)}q w{chr(98 + i % 7)}k brim") for i in range(40)]
    ix = index.Index.build(spark.createDataFrame(docs, "doc_id bigint, block string, text string"))
    before = set(session._TABLES)
    fitted = lsi.fit(ix, rank=3)
    assert len(fitted.sigma) == 3 and fitted.docs.count() == 40
    assert {p.rsplit("/", 1)[-1].split("-")[0] for p in session._TABLES - before} == {"groups", "vectors"}
