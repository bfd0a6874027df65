"""Near-duplicates, encoding, leakage, stuffing, neighbours: against brute force over small tables."""

import os
import random
import re
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmill.llm import bpe, common, leakage, neardup, neighbours, stuffing
from lexmill.session import shared_folder
from tests.conftest import rows

WORD = re.compile("[a-z0-9]+")


def shingle_set(text, width):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(30)]
    out = []
    for i in range(160):
        words = list(base[i % 30])
        for _ in range(rng.randrange(6)):
            words[rng.randrange(60)] = f"e{rng.randrange(50)}"
        out.append((i, " ".join(words).upper() if i % 5 == 0 else ", ".join(words)))
    return out + [(500, out[3][1]), (3, out[3][1]), (501, None), (502, ""), (503, "two words"), (None, out[3][1]), (504, "x " * 20000), (505, "x " * 20000)]


@pytest.mark.parametrize(("width", "threshold"), [(3, 0.6), (5, 0.8)])
def test_pairs_and_groups_equal_brute_force(spark, texts, width, threshold):
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("record", F.lit(0))
    sets = {i: s for i, t in texts if i is not None and (s := shingle_set(t, width))}
    want = sorted((a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= threshold)
    got = neardup.near_duplicate_pairs(df, "doc_id", "text", width, threshold)
    assert rows(got.select("record_a", "record_b")) == sorted(want, key=repr)
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in want:
        x, y = find(a), find(b)
        group[max(x, y)] = min(x, y)
    got = {r["record"]: r["group"] for r in neardup.near_duplicate_groups(df, "doc_id", "text", width, threshold).collect()}
    assert got == {i: find(i) for i in sets}


def test_many_nearly_equal_texts_form_one_group(spark):
    """20,000 different texts that nearly all resemble each other: their pairs are never listed."""
    words = [F.concat(F.lit(f"w{j}x"), F.when(F.pmod(F.xxhash64("id", F.lit(j)), F.lit(70)) == 0, F.col("id")).otherwise(0)) for j in range(60)]
    alike = spark.range(20000).select("id", F.concat_ws(" ", *words, F.lit("end"), F.col("id")).alias("text"))
    other = spark.range(30000, 30050).select("id", F.concat_ws(" ", *[F.xxhash64("id", F.lit(j)) for j in range(60)]).alias("text"))
    groups = neardup.near_duplicate_groups(alike.union(other), "id", "text", width=3, threshold=0.6)
    sizes = {r.group: r["count"] for r in groups.groupBy("group").count().collect()}
    assert sizes[0] > 19900 and sum(sizes.values()) == 20050 and all(sizes[i] == 1 for i in range(30000, 30050))


def test_shingles_of_many_texts():
    shingler = neardup.Shingler(3)
    texts = ["a b c d", "", "a b", "x a b c; A".lower(), "a b c a b c a b c"]
    offsets, h = shingler.sets(texts)
    sets = [set(h[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]
    assert [len(x) for x in sets] == [2, 0, 0, 3, 3] and len(sets[0] & sets[3]) == 1 and len(sets[3] & sets[4]) == 2
    assert all((np.diff(h[a:b].astype(object)) > 0).all() for a, b in zip(offsets[:-1], offsets[1:]))


def test_no_texts(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.near_duplicate_pairs(empty, "doc_id", "text").count() == 0
    assert neardup.near_duplicate_groups(empty, "doc_id", "text").count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    ids = neardup._mix(np.arange(1, 91, dtype=np.uint64))
    wa, wb = rng.uniform(0.2, 4, 90), rng.uniform(0.2, 4, 90)
    wb[:60] = wa[:60]
    k = 2048
    sig = neardup.dart_signatures(np.array([0, 90, 180, 180, 181]), np.concatenate([ids, ids, ids[:1]]), np.concatenate([wa, wb, [0.5]]), k)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04
    assert (sig[2] == 0).all() and len(set(sig[3])) > 1


def test_components_of_a_long_path(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(i,) for i in [*range(n + 1), 100, 101, 300]], "node bigint")
    got = dict(rows(neardup.connected_components(nodes, edges)))
    assert {got[i] for i in range(n + 1)} == {0} and got[100] == got[101] == 100 and got[300] == 300


RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
needs_ranks = pytest.mark.skipif(not os.path.exists(RANKS), reason="the public rank file is not here")


@needs_ranks
def test_encoding_equals_public_tokenizers(spark):
    import tiktoken

    ranks = bpe.load_ranks(open(RANKS, "rb").read())
    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", " ", "\n\n \t", "Hello  world's <|endoftext|>", "don’t ½ x²٣ 你好 ß🙂", "a" * 5000, "ab" * 300 + " " * 400, "\u0000x"]
    texts += ["".join(rng.choice("abcdeé '\n\t019,.XYZ-") for _ in range(rng.randrange(200))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None)], "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: list(r.ids) for r in bpe.encoded(df, "doc_id", "text", RANKS).collect()}
    assert got == {i: public.encode_ordinary(t) for i, t in enumerate(texts)} | {900: []}
    assert all(public.decode(got[i]) == t for i, t in enumerate(texts))
    assert bpe.encoded(df.limit(0), "doc_id", "text", RANKS).dtypes[1] == ("ids", "array<int>")


@needs_ranks
def test_both_merges_agree():
    ranks = bpe.load_ranks(open(RANKS, "rb").read())
    rng = random.Random(9)
    for _ in range(300):
        word = "".join(rng.choice("aetoin shé\n1") for _ in range(rng.randrange(1, 60))).encode()
        assert bpe.merge_short(word, ranks) == bpe.merge_long(word, ranks)


def test_leaks_equal_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(40)] + ["the"] * 20
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, say(30)) for i in range(12)] + [(50, say(11)), (51, [])]
    docs = []
    for i in range(60):
        w = say(40)
        it = items[rng.randrange(12)][1]
        a, n = rng.randrange(15), rng.randrange(9, 16)
        docs.append((i, w[:10] + it[a : a + n] + w[10:] if i % 2 else w))
    docs += [(100, items[0][1]), (101, items[1][1][:12]), (102, items[1][1][18:]), (103, [])]
    grams = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    want = sorted((d, i) for d, w in docs for i, q in items if grams(w) & grams(q))
    df = spark.createDataFrame([(d, "; ".join(w).upper()) for d, w in docs] + [(104, None)], "doc_id bigint, text string").withColumn("term", F.lit("v1"))
    ev = spark.createDataFrame([(i, " ".join(q)) for i, q in items] + [(60, None)], "item_id bigint, text string")
    got = leakage.leaked_passages(df, "doc_id", "text", ev, "item_id", "text").persist()
    exact = got.filter("match = 'exact'")
    assert len(want) > 10 and rows(exact.select("doc_id", "item_id")) == sorted(want, key=repr)
    assert all(r.run_words >= 12 and r.near_words == 12 for r in exact.collect())
    assert all(r.run_words < 12 and r.near_words >= 10 for r in got.filter("match = 'near'").collect())
    assert leakage.leaked_passages(df, "doc_id", "text", ev.limit(0), "item_id", "text").count() == 0
    assert leakage.leaked_passages(df.limit(0), "doc_id", "text", ev, "item_id", "text").count() == 0
    # a saved index answers the same; so does the way for vocabularies too large to be sent
    path = f"{tmp_path}/index"
    saved = leakage.save_index(df, "doc_id", "text", path, files=2)
    assert rows(leakage.leaked_passages(None, "doc_id", "text", ev, "item_id", "text", index=saved)) == rows(got)
    with pytest.raises(ValueError):
        leakage.open_index(spark, path, run=8)
    monkeypatch.setattr(leakage, "SENT_BYTES", 0)
    monkeypatch.setattr(common, "SENT_BYTES", 0)
    assert rows(leakage.leaked_passages(df, "doc_id", "text", ev, "item_id", "text")) == rows(got)


def test_passages_with_small_edits_are_near(spark):
    rng = random.Random(12)
    item = [f"q{i}" for i in range(30)]
    edited = item[:11] + ["inserted"] + item[11:18] + ["changed"] + item[19:]
    noise = [f"n{rng.randrange(500)}" for _ in range(40)]
    df = spark.createDataFrame([(1, " ".join(noise + edited[:20] + noise)), (2, " ".join(noise)), (3, " ".join(item[:6] + noise))], "doc_id bigint, text string")
    ev = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    # every word occurs somewhere, so that no window of the item lacks an anchor
    df = df.union(spark.createDataFrame([(4, " ".join(reversed(item)))], df.schema))
    got = leakage.leaked_passages(df, "doc_id", "text", ev, "item_id", "text").collect()
    assert [(r.doc_id, r.run_words, r.near_words, r["match"]) for r in got] == [(1, 11, 12, "near")]


def test_all_near_passages_are_found(spark, tmp_path, monkeypatch):
    """Also those with edits on both sides of a window's rarest word, and with words that no document has."""
    rng = random.Random(21)
    vocab = [f"v{i}" for i in range(60)] + ["the"] * 15
    items = [(i, [rng.choice(vocab) for _ in range(rng.choice([11, 12, 13, 30]))]) for i in range(14)] + [(90, [f"u{i}" for i in range(12)])]
    docs = [(900, ["u0", "u1", "u2", "x", "u4", "u5", "u6", "x", "u8", "u9", "u10", "u11"])]
    items.append((91, [f"x{i}" for i in range(12)]))
    docs.append((901, ["x0", "x1", "x2", "x3", "x4", "y", "y", "y", "x5", "x6", "x7", "x8", "x9", "y", "y"]))
    for i in range(70):
        w = list(items[rng.randrange(14)][1])
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(2)
        if i % 3 == 0:
            w[::2], w[1::2] = w[1::2] + w[::2][len(w[1::2]) :], w[::2][: len(w[1::2])]
        docs.append((i, [rng.choice(vocab) for _ in range(rng.randrange(8))] + w))
    want = {}
    for d, w in docs:
        for i, q in items:
            for shift in range(-len(q) - 2, len(w) + 3):
                met = [t in w[max(0, shift + p - 2) : max(0, shift + p + 3)] for p, t in enumerate(q)]
                n = max((sum(met[a : a + 12]) for a in range(len(q) - 11)), default=0)
                if n >= 10:
                    want[d, i] = max(n, want.get((d, i), 0))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string")
    ev = spark.createDataFrame([(i, " ".join(q)) for i, q in items], "item_id bigint, text string")
    got = rows(leakage.leaked_passages(df, "doc_id", "text", ev, "item_id", "text"))
    assert {(d, i): n for d, i, _, n, _ in got} == want and (900, 90) in want and (901, 91, 0, 10, "near") in got
    part = rows(leakage.leaked_passages(df, "doc_id", "text", ev, "item_id", "text", whole=False))
    assert {r[:2] for r in part} < {r[:2] for r in got}
    assert {r[:2] for r in part if r[4] == "exact"} == {r[:2] for r in got if r[4] == "exact"}
    saved = leakage.save_index(df, "doc_id", "text", f"{tmp_path}/index", files=2)
    monkeypatch.setattr(leakage, "_MET", 50)
    assert rows(leakage.leaked_passages(None, "doc_id", "text", ev, "item_id", "text", index=saved)) == got


def test_stuffed_pages(spark):
    rng = random.Random(6)
    letters = ("kar", "mel", "tos", "vin", "dro", "sal", "bre", "fun", "hod", "jit")
    nouns = [f"{a}{b}{c}" for a in letters for b in letters for c in ("pa", "lin", "gor", "tes", "mu")]
    sentence = lambda: f"the {rng.choice(nouns)} of the {rng.choice(nouns)} was in a {rng.choice(nouns)} with the {rng.choice(nouns)} and it is on to {rng.choice(nouns)}. "
    prose = [(i, "".join(sentence() for _ in range(6)), "en" if i % 7 else None) for i in range(150)]
    links = " | ".join(f"[{rng.choice(nouns)} pills](https://x{i}.test/buy-{i})" for i in range(40))
    stuffed = " ".join(["karsalpa", "melfunmu"][i % 2] if i % 3 else rng.choice(["karsalpa", "of"]) for i in range(90))
    menu = "\n".join(rng.choice(["Home", "Log In", "All Brands", "Catalogue"]) for _ in range(60))
    pages = prose + [(900, links, "EN"), (901, stuffed, "en"), (902, menu, "xx"), (903, prose[0][1] + links[:120], "en"), (904, None, "en"), (905, " \n", "en"), (906, "one", None)]
    df = spark.createDataFrame(pages, "doc_id bigint, text string, lang string").withColumn("key", F.lit(1))
    got = {r.doc_id: r for r in stuffing.stuffed_pages(df, "doc_id", "text", "lang").collect()}
    assert {i for i, r in got.items() if r.flagged and i != 906} == {900, 901, 902}
    assert 904 not in got and 905 not in got and len(got) == 155
    assert stuffing.stuffed_pages(df.limit(0), "doc_id", "text", "lang").count() == 0


FINNISH = (
    "Keväällä metsän reunassa kasvoi sinivuokkoja, ja lapset keräsivät niitä äidilleen. Illalla satoi vettä, joten kaikki palasivat kotiin ennen pimeää. "
    "Isoäiti keitti kahvia ja kertoi, miten kylässä ennen elettiin. Kukaan ei huomannut, kun kissa hiipi ulos ovesta.",
    "Laiva lähti satamasta aamulla, vaikka tuuli oli kova. Matkustajat seisoivat kannella ja katselivat, kuinka ranta jäi taakse. "
    "Kapteeni sanoi, että perille päästään vasta huomenna. Yöllä meri tyyntyi, ja moni nukkui hyvin.",
    "Kirjastossa on hiljaista, koska useimmat lukijat ovat lomalla. Uudet kirjat saapuivat viime viikolla, mutta niitä ei ole vielä luetteloitu. "
    "Johtaja toivoo, että syksyllä väkeä tulee enemmän kuin viime vuonna.",
)


def test_prose_of_a_language_without_a_head_is_not_stuffed(spark):
    rng = random.Random(8)
    draw = lambda letters, n: ["".join(rng.choice(letters) for _ in range(6)) for _ in range(n)]
    common, other = draw("abcdef", 300), draw("uvwxyz", 300)
    say = lambda heads, words: " ".join(f"{heads[i % 8]} {rng.choice(words[8:])} {heads[(i + 3) % 8]} {rng.choice(words[8:])}." for i in range(20))
    stuffed = " ".join(other[i % 3] for i in range(80))
    links = " | ".join(f"[{w}](https://x.test/{w})" for w in other[:40])
    pages = [(i, say(common[:8], common), "en") for i in range(100)] + [(200, say(other[:8], other), "SW "), (201, stuffed, "sw"), (202, links, "sw"), (203, say(other[:8], other), "en")]
    pages += [(210 + i, t, "fi") for i, t in enumerate(FINNISH)]
    df = spark.createDataFrame(pages, "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in stuffing.stuffed_pages(df, "doc_id", "text", "lang").filter("flagged").collect()} == {201, 202, 203}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no test tables")
def test_finnish_prose_among_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/page_labels.parquet")
    more = spark.createDataFrame([(-1 - i, t, "fi") for i, t in enumerate(FINNISH)], docs.schema)
    got = {r.doc_id: r for r in stuffing.stuffed_pages(docs.union(more), "doc_id", "text", "lang", labels).collect()}
    assert not any(got[-1 - i].flagged for i in range(3)) and got[-1].lang == "fi" and sum(r.flagged for r in got.values()) > 30


def test_neighbourhoods_are_told_in_spite_of_wrong_labels():
    rng = np.random.default_rng(1)
    d = len(stuffing.MEASURES)
    side = np.array(list(stuffing.MEASURES.values()))
    pages, spam, told = [], [], []
    for i in range(300):
        part = [0.0, 0.2, 0.8, 1.0][i % 4]
        lists = np.arange(30) < part * 30
        pages.append(rng.normal(0, 0.1, (30, d)) + lists[:, None] * side * 0.35)
        spam.append(part > 0.5)
        told.append((part > 0.5) ^ (i % 25 == 0))
    x = np.concatenate(pages)
    net = stuffing.fit_neighbourhoods(x, np.repeat(np.arange(300), 30), np.array(told), x)
    shares = net(x).reshape(300, 30).mean(1)
    assert ((shares > 0.5) == np.array(spam)).mean() > 0.99
    none = stuffing.fit_neighbourhoods(x[:0], np.zeros(0, int), np.zeros(0, bool), x)
    assert none(x).reshape(300, 30).mean(1)[3::4].min() > none(x).reshape(300, 30).mean(1)[0::4].max()


def test_curve_and_divergence_move_the_decision():
    rng = np.random.default_rng(2)
    listed = rng.uniform(-0.3, 0.3, 400)
    curve = rng.normal(0, 1, 400)
    spam = listed + 0.1 * curve > 0
    w = stuffing.fit_pages(np.column_stack([listed, curve, np.zeros(400), np.zeros(400)]), spam)
    odds = lambda w: listed * w[0] + curve * w[1] + w[4]
    assert ((odds(w) > 0) == spam).mean() > 0.95 > ((listed > 0) == spam).mean()
    assert (stuffing.fit_pages(np.zeros((0, 4)), np.zeros(0, bool)) == [stuffing.SHARP, 0, 0, 0, 0]).all()


def test_curves_of_pages(spark):
    df = spark.createDataFrame([(1, [4, 2, 1], [1, 2, 5]), (2, [1], [7])], "doc bigint, freqs array<int>, words array<int>")
    got = {r.doc: r for r in stuffing.page_curves(df).collect()}
    slope, level = np.polyfit(np.log([1, 3, 8]), np.log([4, 2, 1]), 1)
    rest = np.log([4, 2, 1]) - slope * np.log([1, 3, 8]) - level
    assert np.isclose(got[1].slope, slope) and np.isclose(got[1].residual, np.sqrt((rest**2).mean())) and got[2].slope is None


def test_most_similar_vectors(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((40, 100))
    x = centres[rng.integers(0, 40, 1500)] + rng.standard_normal((1500, 100)) * 0.6
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(2000 + i, x[7].tolist()) for i in range(30)] + [(3, x[3].tolist()), (4000, None), (4001, [0.0] * 100), (4002, [1.0] * 99), (4003, [float("nan")] + [1.0] * 99), (None, x[1].tolist())]
    df = spark.createDataFrame(data, "id bigint, vec array<double>").withColumn("neighbour", F.lit(1))
    ids = np.array([*range(1500), *range(2000, 2030)])
    v = np.concatenate([x, np.repeat(x[7:8], 30, 0)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sim = v @ v.T
    np.fill_diagonal(sim, -2)
    order = np.lexsort((np.broadcast_to(ids, sim.shape), -np.round(sim, 6)), axis=1)[:, :10]
    want = {ids[i]: {ids[j] for j in order[i]} for i in range(len(ids))}
    got = {}
    for r in neighbours.most_similar(df, "id", "vec").collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert set(got) == set(want) and all(len(s) == 10 for s in got.values())
    assert np.mean([len(want[i] & got[i]) / 10 for i in want]) >= 0.9
    assert got[2029] == {7, *range(2000, 2009)}
    asked = neighbours.most_similar(df, "id", "vec", queries=spark.createDataFrame([(7,), (9999,)], "id bigint"))
    assert {r.neighbour for r in asked.collect()} == got[7]
    assert neighbours.most_similar(df.limit(0), "id", "vec").count() == 0


@pytest.mark.parametrize("kind", ["latent", "clusters", "isotropic"])
@pytest.mark.parametrize("top", [(64, 64), (8, 8)])
def test_recall_where_many_partitions_are_left_out(spark, monkeypatch, kind, top):
    """64 leaves on one level or on two; how far to look is found out from the vectors themselves."""
    monkeypatch.setattr(neighbours, "PER_PART", 100)
    monkeypatch.setattr(neighbours, "TOP", top)
    rng = np.random.default_rng(4)
    n = 6000
    x = {
        "latent": lambda: rng.standard_normal((n, 12)) @ rng.standard_normal((12, 100)) + rng.standard_normal((n, 100)) * 0.5,
        "clusters": lambda: rng.standard_normal((300, 100))[rng.integers(0, 300, n)] + rng.standard_normal((n, 100)) * 0.5,
        "isotropic": lambda: rng.standard_normal((n, 100)),
    }[kind]()
    trees = []
    fit = neighbours.fit_tree
    monkeypatch.setattr(neighbours, "fit_tree", lambda *a: trees.append(fit(*a)) or trees[-1])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "vec": x.tolist()}))
    asked = spark.range(0, n, 20)
    got = {}
    for r in neighbours.most_similar(df, "id", "vec", queries=asked).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    want = {i: set(np.argsort(-sim[i])[:10].tolist()) for i in range(0, n, 20)}
    assert np.mean([len(want[i] & got[i]) / 10 for i in want]) >= 0.9
    tree = trees[-1]
    leaves = np.bincount(tree.home(u.astype(np.float32)), minlength=tree.leaves)
    rows, to = tree.routes(u[::20].astype(np.float32))
    share = leaves[to].sum() / len(want) / n
    assert tree.leaves >= 32 and (share < 0.5 or kind == "isotropic") and (len(tree.below) > 1) == (top[0] == 8)


def test_exact_search_looks_into_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_PART", 50)
    x = np.random.default_rng(5).standard_normal((1000, 100))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    got = {r.id: r.neighbour for r in neighbours.most_similar(df, "id", "vec", k=1, exact=True).collect()}
    assert got == {i: sim[i].argmax() for i in range(1000)}


def test_hot_partition_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    x = np.random.default_rng(2).standard_normal((400, 100))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = v @ v.T
    np.fill_diagonal(sim, -2)
    best = np.argsort(-sim, 1)[:, 0]
    got = {r.id: r.neighbour for r in neighbours.most_similar(df, "id", "vec", k=1).collect()}
    assert got == {i: best[i] for i in range(400)}


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("block", [16_384, 64])
def test_search_in_rounds_finds_the_same_on_bounded_disk(spark, monkeypatch, exact, block):
    """Vectors without structure, so that a query looks into most of 32 partitions."""
    n = 3000
    x = np.random.default_rng(6).standard_normal((n, 100))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    folders = [*spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString(), shared_folder(spark).removeprefix("file:")]

    def used():
        files = (os.path.join(at, f) for folder in folders for at, _, names in os.walk(folder) for f in names if f.startswith(("shuffle_", "part-")))
        return sum(os.path.getsize(f) for f in files if os.path.exists(f))

    monkeypatch.setattr(neighbours, "PER_PART", 100)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "ROUND_LEAST", 0)
    before, peak, over = used(), [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            try:
                peak[0] = max(peak[0], used())
            except OSError:  # removed meanwhile
                pass

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = {r.id: r.neighbour for r in neighbours.most_similar(df, "id", "vec", k=1, exact=exact).collect()}
    finally:
        over.set()
        watcher.join()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    right = np.mean([got[i] == sim[i].argmax() for i in range(n)])
    assert len(got) == n and right >= (1 if exact else 0.9)
    assert peak[0] - before < 4 * 8 * 100 * n


def test_balanced_partition_follows_clusters():
    rng = np.random.default_rng(0)
    x = np.repeat(np.eye(8, 100), 50, 0) * 3 + rng.standard_normal((400, 100)) * 0.1
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = neighbours.neighbour_graph(x, 10)
    label = neighbours.balanced_partition(graph, 4)
    assert np.bincount(label).tolist() == [100] * 4 and (label[graph] == label[:, None]).mean() > 0.9
