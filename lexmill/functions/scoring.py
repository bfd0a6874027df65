"""Weighting formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual parameters of the formulas.
K1, B = 1.2, 0.75


def tfidf_idf(df: Column, n: Column) -> Column:
    """ln(N / df)"""
    return F.ln(n.cast("double") / df)


def tf_weight(tf: Column) -> Column:
    """1 + ln tf; 0 without an occurrence."""
    return F.when(tf > 0, 1 + F.ln(tf.cast("double"))).otherwise(F.lit(0.0))


def bm25_idf(df: Column, n: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5))"""
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def bm25_tf(tf: Column, doc_len: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """Saturated, length-normalised term frequency."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avgdl))


def bm25_bound(idf: Column, k1: float = K1) -> Column:
    """No document can gain more from the term than this."""
    return idf * (k1 + 1)


def lsi_weight(tf: Column, df: Column, n: Column) -> Column:
    """(1 + ln tf) * ln(N / (df + 1)); zero or negative for terms of almost all documents."""
    return tf_weight(tf) * F.ln(n.cast("double") / (df + 1))


def min_max(score: Column, low: Column, high: Column) -> Column:
    """(score - low) / range, the range being at least 1e-5, so a single value becomes 0."""
    return (score - low) / F.greatest(high - low, F.lit(1e-5))


def result_line(name: str = "doc_name", score: str = "score") -> Column:
    """One line of a result, as it is printed."""
    return F.format_string("  %-45s %8.4f", F.col(name), F.col(score))
