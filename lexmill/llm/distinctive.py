"""How distinctive a term is per record: length-normalised tf times smoothed idf."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A term with at least this many records counts as heavy when frequencies are joined back.
HEAVY = 10_000
#: Most heavy terms whose frequencies are sent to every task.
MOST_HEAVY = 100_000


def _heavy_from(n_rows: int) -> int:
    """Terms with so many rows number at most MOST_HEAVY, as together they can't hold more rows than there are."""
    return max(HEAVY, -(-n_rows // MOST_HEAVY))


def with_record_counts(pairs: DataFrame, counts: DataFrame, n_rows: int) -> DataFrame:
    """Joins counts(term, df) back to pairs(term, ...) without a hot task.

    Counts of heavy terms are broadcast: their number is bounded by ``_heavy_from``. All other terms have few
    rows each and go through a shuffled join.
    """
    bound = _heavy_from(n_rows)
    heavy = counts.filter(F.col("df") >= bound).select("term", F.col("df").alias("_heavy"))
    marked = pairs.join(F.broadcast(heavy), "term", "left")
    hot = marked.filter("_heavy is not null").withColumnRenamed("_heavy", "df")
    cold = marked.filter("_heavy is null").drop("_heavy").join(counts.filter(F.col("df") < bound), "term")
    return hot.unionByName(cold)


def distinct_pairs(postings: DataFrame) -> DataFrame:
    """term, doc_id, tf of valid postings; repeated (term, doc_id) once."""
    return postings.groupBy("term", "doc_id").agg(F.max("tf").alias("tf"))


def distinctiveness(postings: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """doc_id, term, tf, df, doc_total, doc_len, score of every (document, term) of valid postings(term, doc_id, tf).

    score = tf / doc_len * (ln((1 + N) / (1 + df)) + 1), N being the documents that have a posting and
    doc_total the sum of a document's tf. doc_len is the recorded length (``lengths``: doc_id, doc_len; the
    greatest one, if there are several) unless it is missing, null or stale, that is, less than doc_total;
    then it is doc_total. An empty table gives no row.
    """
    from lexmill.session import stored

    pairs = stored(distinct_pairs(postings), "pairs")
    n_rows = pairs.count()
    counts = pairs.groupBy("term").agg(F.count("*").alias("df"))
    totals = pairs.groupBy("doc_id").agg(F.sum("tf").alias("doc_total"))
    n = totals.agg(F.count("*").alias("n")).scalar()
    if lengths is not None:
        recorded = lengths.filter("doc_id is not null").groupBy("doc_id").agg(F.max("doc_len").alias("recorded"))
        totals = totals.join(recorded, "doc_id", "left").select("doc_id", "doc_total", F.greatest("doc_total", F.coalesce("recorded", F.lit(0))).alias("doc_len"))
    else:
        totals = totals.withColumn("doc_len", F.col("doc_total"))
    idf = F.ln((1 + n).cast("double") / (1 + F.col("df"))) + 1
    rows = with_record_counts(pairs, counts, n_rows).join(totals, "doc_id")
    return rows.select("doc_id", "term", "tf", "df", "doc_total", "doc_len", (F.col("tf") / F.col("doc_len") * idf).alias("score"))
