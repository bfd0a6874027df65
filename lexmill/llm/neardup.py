"""Near-duplicate records: dart-thrown weighted MinHash signatures, banded joining, exact verification."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import Memo, chunks
from lexmill.session import discard, stored, task_count

#: Bands and rows of a band: at a similarity of 0.6 a pair is missed with probability (1 - 0.6^4)^56 = 0.0004,
#: at 0.8 with less than 1e-12; a pair with similarity 0.05 becomes a candidate with probability 0.0004.
BANDS, ROWS = 56, 4
#: Bands whose buckets are tried first when only groups are asked for.
FIRST = 4
#: Squares that darts are thrown into at once: few enough for the processor's cache.
SLICE = 1 << 16
#: Different words that a task remembers the hashes of.
_HELD = 1 << 20

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift); wraps around."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in [0, 1)."""
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


#: Number of darts, Poisson distributed with mean 1, by the first 16 bits of a square's hash.
_POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(n) for n in range(16)]), np.arange(1 << 16) / 65536, side="right").astype(np.int8)
_GOLDEN = _U(0x9E3779B97F4A7C15)


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and running number within the owner for ``counts`` things each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    start = np.repeat(np.cumsum(counts) - counts, counts)
    return owner, np.arange(len(owner)) - start


def _rank(row: np.ndarray, dart: np.ndarray) -> np.ndarray:
    """Height of darts in their squares' row; of a dart's bits these are the ones that decide nothing else."""
    return row + ((dart >> _U(8)) & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32


def _squares(element: np.ndarray, column: np.ndarray, row: np.ndarray) -> np.ndarray:
    return _mix(element + _mix((column << 32).astype(np.uint64) + row.astype(np.uint64) + _U(1)))


def _darts(element: np.ndarray, weight: np.ndarray, high: np.ndarray):
    """Darts that land in each element's region [0, weight] x [0, high].

    The plane of every element is cut into unit squares; a square holds Poisson(1) darts, their number and
    places being hashes of (element, square), so that records with the element see the same darts. Returns the
    element's place, the rank (height) and the dart's hash.
    """
    if (weight == 1).all():
        return _unit_darts(element, int(high.max(initial=1)))
    wide = np.ceil(weight).astype(np.int64)
    owner, at = _expand(wide * high)
    column, row = at % wide[owner], at // wide[owner]
    square = _squares(element[owner], column, row)
    hits, nth = _expand(_POISSON[square >> _U(48)])
    dart = _mix(square[hits] + (nth.astype(np.uint64) + _U(1)) * _GOLDEN)
    source = owner[hits]
    inside = column[hits] + _unit(_mix(dart ^ _U(0xA5A5A5A5A5A5A5A5))) <= weight[source]
    return source[inside], _rank(row[hits], dart)[inside], dart[inside]


def _unit_darts(element: np.ndarray, high: int):
    """The same for elements of weight 1, all as high as the highest: what lies deeper than asked for changes nothing.

    Squares form a matrix, so that nothing is repeated or looked up square by square.
    """
    rows = np.arange(high)
    square = _squares(element[:, None], np.zeros(1, np.int64), rows[None, :]).ravel()
    many = _POISSON[square >> _U(48)]
    found = [np.flatnonzero(many > nth) for nth in range(int(many.max(initial=0)))]
    hits = np.concatenate([*found, np.zeros(0, np.int64)])
    dart = np.concatenate([*[_mix(square[at] + np.array([nth + 1], np.uint64) * _GOLDEN) for nth, at in enumerate(found)], np.zeros(0, np.uint64)])
    source = hits // high
    return source, _rank(hits - source * high, dart), dart


def dart_signatures(offsets: np.ndarray, elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Signatures [records, k] of weighted sets given as offsets into elements (uint64) and positive weights.

    Every record gets darts in regions deep enough to expect k (ln k + 2) of them; each dart belongs to one
    coordinate and the earliest (lowest) one stays. Records with an empty coordinate throw again with twice
    the depth: that adds later darts only. Two records agree in a coordinate with the probability of their
    weighted Jaccard similarity. Records without an element keep zeros.
    """
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.zeros((n, k), np.uint64)
    record = np.repeat(np.arange(n), sizes)
    total = np.bincount(record, weights=weights, minlength=n)
    depth = np.ceil(k * (math.log(k) + 2) / np.maximum(total, 1e-9)).astype(np.int64)
    wide = np.bincount(record, weights=np.ceil(weights), minlength=n)
    todo = np.flatnonzero(sizes > 0)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    while len(todo):
        again = []
        # slices of records of like depth, each with a bounded number of squares
        todo = todo[np.argsort(depth[todo], kind="stable")]
        group = (np.cumsum(wide[todo] * depth[todo]) // SLICE).astype(np.int64)
        for part in np.split(todo, np.flatnonzero(np.diff(group)) + 1):
            count = sizes[part]
            owner, nth = _expand(count)
            mine = offsets[part][owner] + nth
            source, rank, dart = _darts(elements[mine], weights[mine], depth[part][owner])
            cell = owner[source] * k + (((dart >> _U(40)) * _U(k)) >> _U(24)).astype(np.int64)
            # ranks as the bits of single precision, which order like the numbers; then bits that tell darts apart
            value = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32)) | (dart & _U(0xFFFFFFFF))
            flat = np.full(len(part) * k, empty)
            np.minimum.at(flat, cell, value)
            flat = flat.reshape(-1, k)
            whole = (flat != empty).all(1)
            out[part[whole]] = flat[whole]
            again.append(part[~whole])
        todo = np.concatenate(again)
        depth[todo] *= 2
    return out


_WORD = re.compile("[a-z0-9]+")


class Shingler:
    """Sets of runs of ``width`` consecutive words as sorted 64-bit hashes; words' hashes are remembered."""

    def __init__(self, width: int):
        self.width = width
        self.memo = Memo(xxhash.xxh3_64_intdigest)

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and hashes of the sets of lower-cased texts; those of shorter texts are empty."""
        if len(self.memo) > _HELD:
            self.memo.clear()
        words = [_WORD.findall(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        flat = self.memo.of(list(itertools.chain.from_iterable(words)), np.uint64)
        runs = np.maximum(sizes - self.width + 1, 0)
        owner, nth = _expand(runs)
        at = (np.cumsum(sizes) - sizes)[owner] + nth
        h = np.zeros(len(at), np.uint64)
        for j in range(self.width):
            h = _mix(h * _U(31) + flat[at + j] + _U(j + 1))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        counts = np.bincount(owner[first], minlength=len(texts))
        return np.concatenate([[0], np.cumsum(counts)]), h[first]


def text_classes(rows: DataFrame, record: str, text: str, width: int) -> tuple[DataFrame, DataFrame]:
    """members(record, class) and classes(class, shingles): records with the same set of shingles form a class.

    The class is a 128-bit digest of the sorted set, so members need no join to find it. Records that are
    null or have a null or too short text have no class; repeated records count once.
    """
    lower = rows.select(F.col(record).alias("record"), F.lower(F.col(text)).alias("text")).filter("record is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts):
                offsets, hashes = shingler.sets(texts[a:b])
                data = hashes.tobytes()
                digests = [hashlib.blake2b(data[8 * i : 8 * j], digest_size=16).digest() for i, j in zip(offsets[:-1], offsets[1:])]
                sets = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(hashes.view(np.int64)))
                out = pa.RecordBatch.from_arrays([batch.column("record").slice(a, b - a), pa.array(digests, pa.binary()), sets], names=["record", "class", "shingles"])
                yield out.filter(pa.array(np.diff(offsets) > 0))

    named = stored(lower.mapInArrow(run, f"record {lower.schema['record'].dataType.simpleString()}, class binary, shingles array<bigint>"), "shingles")
    members = named.select("record", "class").distinct()
    classes = named.groupBy("class").agg(F.first("shingles").alias("shingles"))
    return members, classes


def signed(classes: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """class, n (elements), keys (a bigint per band of the class's signature)."""
    k = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = batch.column("shingles")
            offsets = sets.offsets.to_numpy().astype(np.int64)
            values = sets.values.to_numpy(zero_copy_only=False).view(np.uint64)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            signature = dart_signatures(offsets, values, np.ones(len(values)), k).reshape(-1, bands, rows)
            key = np.zeros(signature.shape[:2], np.uint64)
            for j in range(rows):
                key = _mix(key * _U(31) + signature[:, :, j] + _U(j + 1))
            key = _mix(key + np.arange(bands, dtype=np.uint64)[None, :]).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, key.size + 1, bands, dtype=np.int32), pa.array(key.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(np.diff(offsets).astype(np.int32)), lists], names=["class", "n", "keys"])

    # an explicit number of partitions: signing is work for the CPU, which the bytes of the sets do not show
    spread_out = classes.select("class", "shingles").repartition(task_count(classes), "class")
    return spread_out.mapInArrow(sign, "class binary, n int, keys array<bigint>")


def verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of those pairs(a, b) of classes whose exact Jaccard similarity reaches the threshold."""
    both = pairs.join(classes.select(F.col("class").alias("a"), F.col("shingles").alias("sa")), "a").join(
        classes.select(F.col("class").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), shared.alias("shared")).withColumn(
        "similarity", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    ).filter(F.col("similarity") >= threshold).select("a", "b", "similarity")


def _fit(threshold: float):
    """Sizes that do not rule the threshold out."""
    return F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold)


def _candidates(keys: DataFrame, threshold: float) -> DataFrame:
    """a, b (a < b) of classes(class, n, keys) that share a band.

    Sizes that rule the threshold out are dropped within the join. No bucket is gathered: the banded join is an
    equi-join whose hot keys the adaptive planner splits.
    """
    side = lambda x: keys.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.explode("keys").alias("band_key"))
    return side("a").join(side("b"), "band_key").filter((F.col("a") < F.col("b")) & _fit(threshold)).select("a", "b").distinct()


def similar_classes(classes: DataFrame, threshold: float, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """a, b, similarity for pairs of classes (a < b) whose Jaccard similarity reaches the threshold.

    Candidate pairs share a band and are made distinct before the sets are joined to them.
    """
    keys = stored(signed(classes, bands, rows), "bands")
    return verified(_candidates(keys, threshold), classes, threshold)


def near_duplicate_pairs(rows: DataFrame, record: str, text: str, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """record_a, record_b, similarity of all pairs (a < b) at or above the threshold, copies included.

    Pairs are found between classes of equal shingle sets and only then expanded to records.
    """
    members, classes = text_classes(rows, record, text, width)
    links = similar_classes(classes, threshold)
    one, two = members.select(F.col("record").alias("x"), F.col("class").alias("a")), members.select(F.col("record").alias("y"), F.col("class").alias("b"))
    across = links.join(one, "a").join(two, "b").filter("x <> y").select(
        F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"), "similarity"
    )
    within = one.join(two.withColumnRenamed("b", "a"), "a").filter("x < y").select(
        F.col("x").alias("record_a"), F.col("y").alias("record_b"), F.lit(1.0).alias("similarity")
    )
    # a record delivered with several texts counts with its best one
    return across.unionByName(within).groupBy("record_a", "record_b").agg(F.max("similarity").alias("similarity"))


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component (its least node) over undirected edges(a, b), by alternating large-star and small-star.

    Each round is two aggregations over the edges, written as a table; nothing is gathered, whatever the size
    of a component. The number of rounds is logarithmic in the longest path; it fails loudly rather than stop early.
    """
    edges = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = stored(small.filter("a <> b").distinct(), "edges")
        same = new.count() == edges.count() and new.exceptAll(edges.select("a", "b")).isEmpty()
        discard(edges)
        edges = new
        if same:
            found = edges.groupBy("a").agg(F.min("b").alias("component"))
            return nodes.select("node").distinct().join(found.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """class, part after the parts that verified links(a, b) lie in have been joined."""
    name = lambda x: parts.select(F.col("class").alias(x), F.col("part").alias(f"p{x}"))
    edges = links.join(name("a"), "a").join(name("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    found = connected_components(parts.select(F.col("part").alias("node")), edges)
    return stored(parts.join(found.withColumnRenamed("node", "part"), "part").select("class", F.col("component").alias("part")), "parts")


def _pivots(keys: DataFrame, threshold: float) -> DataFrame:
    """a, b: members of each bucket with the bucket's pivot, where the two lie in different parts and sizes fit.

    keys: class, n, part, keys. The pivot is drawn by a hash, so that it differs from band to band, from the
    bucket's least part, so that a part which holds most of a bucket is mostly left alone. A bucket gives as many
    pairs as it has members, never their square.
    """
    rows = keys.select(F.col("class").alias("a"), F.col("n").alias("na"), "part", F.explode("keys").alias("band_key"))
    drawn = F.min(F.struct((F.col("part") == F.col("a")).alias("alone"), F.when(F.col("part") != F.col("a"), F.col("part")).alias("p"), F.xxhash64("a", "band_key").alias("h"), F.col("a").alias("b"), F.col("na").alias("nb"), F.col("part").alias("pb"))).alias("pivot")
    mixed = rows.groupBy("band_key").agg(drawn, F.min("part").alias("least"), F.max("part").alias("most")).filter("least < most")
    pairs = rows.join(mixed.select("band_key", "pivot.b", "pivot.nb", "pivot.pb"), "band_key").filter((F.col("part") != F.col("pb")) & _fit(threshold))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def class_groups(classes: DataFrame, threshold: float, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """class, part: classes connected by pairs at or above the threshold have the same part.

    Members of a bucket are first verified against one pivot a bucket, in the FIRST bands and then in all; what
    that connects needs no further comparison. Only then all pairs of a bucket whose parts still differ are
    verified, so no link is lost, while a group of many near-equal texts is never paired up with itself.
    """
    keys = stored(signed(classes, bands, rows), "bands")
    parts = keys.select("class", F.col("class").alias("part"))
    placed = lambda parts: keys.join(parts, "class")
    links = verified(_pivots(placed(parts).withColumn("keys", F.slice("keys", 1, FIRST)), threshold), classes, threshold)
    parts = _merged(parts, links)
    parts = _merged(parts, verified(_pivots(placed(parts), threshold), classes, threshold))
    return _merged(parts, verified(_unlike(placed(parts), threshold), classes, threshold))


def _unlike(keys: DataFrame, threshold: float) -> DataFrame:
    """a, b (a < b) of all classes(class, n, part, keys) that share a band but lie in different parts.

    Of such two at least one is outside the bucket's largest part, so only those outside are joined with all.
    """
    rows = keys.select("class", "n", "part", F.explode("keys").alias("band_key"))
    sizes = rows.groupBy("band_key", "part").agg(F.count("*").alias("size"))
    main = sizes.groupBy("band_key").agg(F.max(F.struct("size", "part")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    mixed = stored(rows.join(main.select("band_key", "main.part").withColumnRenamed("part", "main"), "band_key"), "mixed")
    side = lambda x: mixed.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("part").alias(f"p{x}"), "band_key", *(["main"] if x == "a" else []))
    outside = side("a").filter("pa <> main").drop("main")
    # two that are both outside meet twice, which the order of a and b undoes
    pairs = outside.join(side("b"), "band_key").filter((F.col("pa") != F.col("pb")) & _fit(threshold))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicate_groups(rows: DataFrame, record: str, text: str, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """record, group: one row per record with a class; group is the least record of those connected.

    Records are connected by chains of pairs at or above the threshold. Copies share their text's group and are
    never paired up. Null records and null or too short texts give no row; of a record delivered with several
    texts the least group counts; an empty table gives no row.
    """
    members, classes = text_classes(rows, record, text, width)
    labelled = stored(members.join(class_groups(classes, threshold), "class").select("record", "part"), "labelled")
    least = labelled.groupBy("part").agg(F.min("record").alias("group"))
    return labelled.join(least, "part").groupBy("record").agg(F.min("group").alias("group"))
