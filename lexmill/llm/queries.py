"""Named queries of the subpackage over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.llm import bpe, common, distinctive, frequency, fusion, leakage, neardup, neighbours, stuffing, topn
from lexmill.sources.tables import table


def _frequencies(s, d):
    return frequency.value_frequencies(common.valid_postings(table(s, d, "postings")), "term", "doc_id", F.col("tf"))


def _marked(s, d):
    n = frequency.record_count(common.valid_postings(table(s, d, "postings")), "doc_id").scalar()
    return frequency.marked_frequencies(_frequencies(s, d), n)


def _top(s, d):
    return topn.top_n(table(s, d, "bm25_scores"), "qid", "doc_id", "score", 10)


def _distinctive(s, d):
    return distinctive.distinctiveness(common.valid_postings(table(s, d, "postings")), table(s, d, "doc_stats"))


def p6_found(s, d):
    scored = _distinctive(s, d)
    return scored.filter("df between 2 and 8 and tf * 5 >= doc_total").select("doc_id", "term")


def p5_found(s, d):
    pairs = neardup.near_duplicate_pairs(table(s, d, "collection_docs"), "doc_id", "text", width=3, threshold=0.6)
    return pairs.select(F.col("record_a").alias("doc_id_a"), F.col("record_b").alias("doc_id_b"))


def p5_groups(s, d):
    groups = neardup.near_duplicate_groups(table(s, d, "collection_docs"), "doc_id", "text", width=3, threshold=0.6)
    return groups.select(F.col("record").alias("doc_id"), F.col("group").alias("group_id"))


def p1_found(s, d):
    nearest = neighbours.most_similar(table(s, d, "term_vectors"), "id", "vec", k=10, least=0.9)
    return neighbours.mutual_pairs(nearest, "id")


def p1_nearest(s, d):
    """The ten most similar terms of every twentieth term, against all terms."""
    vectors = table(s, d, "term_vectors")
    asked = vectors.filter("id % 20 = 0").select("id").distinct()
    return neighbours.most_similar(vectors, "id", "vec", k=10, queries=asked, refine=True)


def _fused(s, d):
    return fusion.fused_ranking(table(s, d, "adaptive_scores"), "qid", "doc_id", ["lex_score", "sem_score"])


def _leaked(s, d):
    """All exact pairs, and the near ones that the SQL asks for: one side of a window's rarest term is as it was."""
    return leakage.leaked_passages(table(s, d, "documents"), "doc_id", "text", table(s, d, "eval_items"), "item_id", "text", whole=False)


def _stuffed(s, d):
    return stuffing.stuffed_pages(table(s, d, "documents"), "doc_id", "text", "lang", table(s, d, "page_labels"))


QUERIES = {
    "p1_found": p1_found,
    "p1_nearest": p1_nearest,
    "p2_found": lambda s, d: _marked(s, d).filter("mark is not null").select("term", "mark"),
    "p2_frequencies": _marked,
    "p3_found": lambda s, d: _top(s, d).select("qid", "doc_id"),
    "p3_top": _top,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_scores": lambda s, d: _distinctive(s, d).withColumn("score", F.round("score", 6)),
    "p7_found": lambda s, d: _fused(s, d).filter("rank_lex_score <= 10 and rank_sem_score <= 10").select("qid", "doc_id"),
    "p7_ranking": lambda s, d: _fused(s, d).withColumn("mass", F.round("mass", 9)),
    "p8_ids": lambda s, d: bpe.encoded(table(s, d, "documents"), "doc_id", "text"),
    "p9_found": lambda s, d: _leaked(s, d).filter("match = 'exact'").select("doc_id", "item_id"),
    "p9_matches": _leaked,
    "p10_found": lambda s, d: _stuffed(s, d).filter("flagged").select("doc_id"),
    "p10_pages": lambda s, d: _stuffed(s, d).select("doc_id", "lang", "n_parts", *[F.round(c, 6).alias(c) for c in ("listed", "slope_z", "residual_z", "divergence_z")], "flagged"),
}
