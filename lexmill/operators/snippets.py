"""Context snippets: the window of words with most query hits, with the hits highlighted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.text import clean_words

#: What stands around a highlighted word: for a terminal, and as plain text.
ANSI = ("\033[1;33m", "\033[0m")
STARS = ("**", "**")


def split_words(text: Column) -> Column:
    """Parts between white space."""
    return F.regexp_extract_all(text, F.lit("\\S+"), F.lit(0))


def best_windows(hits: DataFrame, texts: DataFrame, queries: DataFrame, size: int = 30) -> DataFrame:
    """qid, doc_id, start, n_hits, words, stems: the first of the windows with most words that contain a stem.

    hits: qid, doc_id of the results to show. A stem counts as a substring anywhere in the lower-cased word.
    Windows start where a whole one fits; a shorter text is one window. Results without words, or of queries
    without a stem, are dropped.
    """
    stems = queries.select("qid", F.array_distinct(clean_words(F.col("text"))).alias("stems")).filter("size(stems) > 0")
    shown = hits.select("qid", "doc_id").join(stems, "qid").join(texts.select("doc_id", split_words(F.col("text")).alias("words")), "doc_id").filter("size(words) > 0")
    rows = shown.select("qid", "doc_id", "stems", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
    hit = F.exists("stems", lambda s: F.contains(F.lower("word"), s)).cast("bigint")
    ahead = W.partitionBy("qid", "doc_id").orderBy("pos").rowsBetween(0, size - 1)
    scored = rows.select("qid", "doc_id", "n", F.col("pos").cast("bigint").alias("start"), F.sum(hit).over(ahead).alias("n_hits"))
    starts = scored.filter(F.col("start") <= F.greatest(F.col("n") - size, F.lit(0)))
    best = starts.groupBy("qid", "doc_id").agg(F.max(F.struct("n_hits", F.negative("start").alias("back"))).alias("b"))
    return best.select("qid", "doc_id", F.negative("b.back").alias("start"), F.col("b.n_hits").alias("n_hits")).join(shown, ["qid", "doc_id"])


def highlighted(snippet: Column, stems: Column, marks: tuple[str, str] = STARS) -> Column:
    """Every stem with the letters after it between the marks, ignoring case; longer stems are tried first."""
    longest = F.array_sort(stems, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    pattern = F.concat(F.lit("(?i)((?:"), F.array_join(longest, "|"), F.lit(")[a-z]*)"))
    opening, closing = (m.replace("\\", "\\\\").replace("$", "\\$") for m in marks)
    return F.regexp_replace(snippet, pattern, F.lit(f"{opening}$1{closing}"))


def snippets(hits: DataFrame, texts: DataFrame, queries: DataFrame, size: int = 30, marks: tuple[str, str] = STARS) -> DataFrame:
    """qid, doc_id, snippet of each result; the empty string where there is nothing to show."""
    best = best_windows(hits, texts, queries, size)
    words = F.array_join(F.slice("words", (F.col("start") + 1).cast("int"), F.lit(size)), " ")
    shown = best.select("qid", "doc_id", F.concat(F.lit("... "), highlighted(words, F.col("stems"), marks), F.lit(" ...")).alias("snippet"))
    return hits.select("qid", "doc_id").join(shown, ["qid", "doc_id"], "left").withColumn("snippet", F.coalesce("snippet", F.lit("")))
