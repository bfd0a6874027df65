"""Text normalisation as native column expressions: tokens, stop-words, suffix stemmer.

All functions map columns to columns and stay inside whole-stage code generation, so that a corpus is
normalised during its scan, without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stop-word list, the suffix tables and their order decide the results.
STOPWORDS = tuple(
    """a an the and or but in on at to for of with by from is was are were be been being have has had do does did
    will would could should may might shall can this that these those it its as if not no nor so yet both either
    neither each few more most other some such than too very just about above after all also am any because before
    between during he her him his how i into me my our out own same she their them then there they through under
    until up us we what when where which while who whom why you your""".split()
)
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = (
    "ement", "ment", "ance", "ence", "able", "ible", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize",
    "al", "er", "ic",
)

WORD = "([a-z]+)"


def _cut(w: Column, n: int) -> Column:
    return F.left(w, F.length(w) - n)


def _first_match(w: Column, cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case that holds, else the word as it is."""
    (cond, value), *rest = cases
    return reduce(lambda acc, case: acc.when(*case), rest, F.when(cond, value)).otherwise(w)


def _plural(w: Column) -> Column:
    return _first_match(
        w,
        [
            (w.endswith("sses") | w.endswith("ies"), _cut(w, 2)),
            (w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)),
        ],
    )


def _past_participle(w: Column) -> Column:
    """Drops -ed / -ing after a vowel; leaves a ``#`` behind where the ending still has to be repaired."""
    def dropped(n: int) -> Column:
        return F.when(_cut(w, n).rlike("[aeiou]"), F.concat(_cut(w, n), F.lit("#"))).otherwise(w)

    return _first_match(
        w,
        [
            (w.endswith("eed"), F.when(F.length(w) > 3, _cut(w, 1)).otherwise(w)),
            (w.endswith("ed"), dropped(2)),
            (w.endswith("ing"), dropped(3)),
        ],
    )


def _repair(w: Column) -> Column:
    bare = F.rtrim(w, F.lit("#"))
    return F.when(
        w.endswith("#"),
        F.when(bare.rlike("(at|bl|iz)$"), F.concat(bare, F.lit("e")))
        .when(bare.rlike("([^lsz])\\1$"), _cut(bare, 1))
        .otherwise(bare),
    ).otherwise(w)


def _final_y(w: Column) -> Column:
    return F.when(w.rlike("[aeiou].*y$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _suffixes(rules: tuple[tuple[str, str], ...], least: int):
    """The first suffix that matches decides, also where the rest is too short to be changed."""
    def step(w: Column) -> Column:
        return _first_match(
            w,
            [
                (
                    w.endswith(suffix),
                    F.when(F.length(w) >= len(suffix) + least, F.concat(_cut(w, len(suffix)), F.lit(new))).otherwise(w),
                )
                for suffix, new in rules
            ],
        )

    return step


def _final_e(w: Column) -> Column:
    return F.when(w.endswith("e") & (F.length(w) > 1), _cut(w, 1)).otherwise(w)


def _final_ll(w: Column) -> Column:
    return F.when(w.endswith("ll") & (F.length(w) > 2), _cut(w, 1)).otherwise(w)


STEPS = (
    _plural, _past_participle, _repair, _final_y, _suffixes(STEP2, 1), _suffixes(STEP3, 1),
    _suffixes(tuple((s, "") for s in STEP4), 2), _final_e, _final_ll,
)


def _step_by_step(words: Column) -> Column:
    """All steps over an array of words, each as one transform.

    A lambda binds its word once per step, so the expression grows by a step's size only; chained projections
    or nested CASE columns would be substituted into each other by the optimiser and grow exponentially.
    """
    for step in STEPS:
        words = F.transform(words, step)
    return words


def stems(words: Column) -> Column:
    """Stems of an array of lower-case words; words of up to two letters stay as they are."""
    pairs = F.arrays_zip(words.alias("word"), _step_by_step(words).alias("stem"))
    return F.transform(pairs, lambda p: F.when(F.length(p["word"]) > 2, p["stem"]).otherwise(p["word"]))


def with_stem(df: DataFrame, word: str, out: str) -> DataFrame:
    """Adds ``out``, the stem of the column ``word``."""
    return df.withColumn(out, F.get(stems(F.array(word)), F.lit(0)))


def raw_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per maximal ``[a-z]+`` run of the lower-cased text: keep..., pos (bigint, from 0), token.

    Null and empty texts give no row.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))
    return df.select(*keep, F.posexplode(words).alias("pos", "token")).withColumn("pos", F.col("pos").cast("bigint"))


def clean_words(text: Column) -> Column:
    """The indexed words of a text as an array: longer than one letter, no stop-word, stemmed,
    stem longer than one letter. Null for a null text.

    Stop-words are tested before stemming only, so a stem may coincide with one and stays.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    spoken = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))
    return F.filter(stems(spoken), lambda w: F.length(w) > 1)


def clean_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per indexed word: keep..., term. Null and empty texts give no row."""
    return df.select(*keep, F.explode(clean_words(F.col(text))).alias("term"))


def normalised_term(term: Column) -> Column:
    """A term without outer white space, in lower case; the empty string becomes null."""
    bare = F.regexp_replace(F.lower(term), "^[\\s\\u00a0\\u200b\\ufeff]+|[\\s\\u00a0\\u200b\\ufeff]+$", "")
    return F.when(bare != "", bare)
