"""The named queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions.text import normalised_term
from lexmill.operators import skew
from lexmill.plans import retrieval
from lexmill.sources.tables import table

#: A term is heavy with at least so many in a hundred of the rows.
HEAVY_PERCENT = 3


def _delivered(s, d):
    """postings with a non-blank term, normalised; other rows and columns as delivered."""
    return table(s, d, "postings").withColumn("term", normalised_term(F.col("term"))).filter("term is not null")


def _term_loads(s, d):
    rows = _delivered(s, d)
    valid = F.col("doc_id").isNotNull() & (F.col("tf") >= 1)
    return skew.balanced_aggregate(
        rows.select("term", "doc_id", "tf", "block", "written_at"), "term",
        {"n": F.count("*"), "v": F.count_if(valid), "t": F.sum(F.when(valid, F.col("tf")).otherwise(0)), "d": F.max("written_at")},
        {"n_rows": F.sum("n"), "n_valid": F.sum("v"), "tf_total": F.sum("t"), "last_written": F.max("d")},
        by=["doc_id", "block", "tf", "written_at"],
    )


def p4_found(s, d):
    """Terms that hold at least 3 in 100 of the rows with a non-blank term."""
    loads = _term_loads(s, d)
    total = _delivered(s, d).agg(F.count("*").alias("n")).scalar()
    return loads.filter(F.col("n_rows") * 100 >= total * HEAVY_PERCENT).select("term")


def p4_block_check(s, d):
    """term, block, rows delivered, and the df and ub that the block's metadata records, by the balanced join."""
    meta = table(s, d, "index_terms").withColumn("term", normalised_term(F.col("term"))).filter("term is not null and block is not null")
    meta = meta.groupBy("block", "term").agg(F.max("df").alias("recorded_df"), F.max("ub").alias("recorded_ub"))
    joined = skew.balanced_join(_delivered(s, d).select("term", "block", "doc_id"), meta, "term", by=["doc_id", "block"], how="left", more=["block"])
    return joined.groupBy("term", "block").agg(F.count("*").alias("n_rows"), F.max("recorded_df").alias("recorded_df"), F.round(F.max("recorded_ub"), 6).alias("recorded_ub"))


QUERIES = {
    **retrieval.QUERIES,
    "p4_found": p4_found,
    "p4_term_loads": lambda s, d: _term_loads(s, d).select("term", "n_rows", "n_valid", "tf_total"),
    "p4_block_check": p4_block_check,
}
