import pytest
from pyspark.sql import functions as F

from lexmill.functions.text import STOPWORDS, clean_words, raw_tokens, with_stem

STEMS = {
    "caress": "caresses", "studi": "studies studying", "ne": "need", "agre": "agreed", "agr": "agreement", "hop": "hopping hoping hopefulness",
    "fal": "falling", "control": "controlling", "siz": "sized", "troubl": "troubled", "eat": "eating", "sing": "sing", "dying": "dying",
    "happi": "happy", "sky": "sky", "alwai": "always", "rel": "relational", "condit": "conditional", "rat": "rational", "organ": "organization",
    "gener": "generalization", "good": "goodness", "ness": "ness", "med": "medical", "commun": "communicate", "educ": "education",
    "comput": "computer computed computing", "pati": "patients", "treat": "treatment", "metabol": "metabolism", "alkyl": "alkylated",
    "radioact": "radioactive", "iodoacet": "iodoacetate", "glucos": "glucose", "cas": "cases", "viru": "virus", "ga": "gas", "on": "one", "i": "ies",
    "is": "is",
}


def test_golden_stems(spark):
    pairs = [(w, stem) for stem, ws in STEMS.items() for w in ws.split()]
    got = with_stem(spark.createDataFrame(pairs, "w string, want string"), "w", "got").collect()
    assert {r.w: r.got for r in got} == {r.w: r.want for r in got}


def test_clean_words(spark):
    texts = ["The CATS, dogs & 3 running birds' x-rays!", "", "the a 123", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(clean_words(F.col("text"))).collect()]
    assert got == [["cat", "dog", "run", "bird", "rai"], [], [], None]
    assert len(STOPWORDS) == len(set(STOPWORDS)) and "your" in STOPWORDS


def test_raw_tokens_keep_place_and_order(spark):
    df = spark.createDataFrame([(1, "B a-b É"), (2, None), (3, "")], "doc_id bigint, text string")
    assert [tuple(r) for r in raw_tokens(df).orderBy("pos").collect()] == [(1, 0, "b"), (1, 1, "a"), (1, 2, "b")]


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "cats " * 50_000)], "doc_id bigint, text string")
    assert df.select(F.size(clean_words(F.col("text")))).first()[0] == 50_000


@pytest.mark.parametrize("word", ["a", "be", "eed", "ing", "ll", "s", "ss", "y", "ee", "ational", "xment"])
def test_short_words_do_not_fail(spark, word):
    assert with_stem(spark.createDataFrame([(word,)], "w string"), "w", "s").count() == 1
