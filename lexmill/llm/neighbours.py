"""Most similar vectors for every vector: learned partitions of a neighbour graph, routed by a classifier."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.session import discard, shuffles_removed, stored, task_count

#: Rows that the partitioning and the classifier are fitted on, at most; and of each partition that is cut again.
SAMPLE, SAMPLE_BELOW = 12_000, 6_000
#: Aim for so many vectors in a partition, at any size of the collection.
PER_PART = 1_000
#: Partitions of the first level (the second number only for collections too large for the first one), and
#: partitions that each of them is cut into, at most. Up to 65 million vectors a partition holds about PER_PART.
TOP, BELOW = (64, 256), 256
#: Part of the sample that is held back to find out how many partitions a query must look into.
HELD_BACK = 2_000
#: Share of a held-back vector's nearest vectors that must be met.
RECALL = 0.96
#: Members of a partition that one task compares at once; larger partitions are cut into such blocks.
BLOCK = 16_384
#: Rows with a vector that one round of the search shuffles: so many for each member, or so many in all, if that is
#: more. What a round has shuffled is removed before the next, so disk doesn't grow with the partitions that a query
#: looks into.
ROUND, ROUND_LEAST = 3, 1 << 18
GRAPH_K = 10
#: Neighbours found beyond the k wanted where the vectors as given are to rank them.
SLACK = 6


# --- fitted on the sample, on the driver ---------------------------------------------------------------------


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices [n, k] of each unit vector's nearest others."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        sim = x[a : a + 1024] @ x.T
        sim[np.arange(len(sim)), np.arange(a, a + len(sim))] = -2
        out[a : a + 1024] = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k else out[a : a + 1024]
    return out


def _halves(graph: np.ndarray, seed: int) -> np.ndarray:
    """Two equal halves of a graph with few edges between them (boolean side per node).

    The order of the second eigenvector of the random walk, by power iteration, is cut at the median; then
    nodes that gain most are swapped across in pairs while that removes edges.
    """
    n = len(graph)
    valid = graph >= 0
    source = np.repeat(np.arange(n), valid.sum(1))
    target = graph[valid]
    src, dst = np.concatenate([source, target]), np.concatenate([target, source])
    degree = np.bincount(src, minlength=n) + 1.0
    v = np.random.default_rng(seed).standard_normal(n)
    for _ in range(40):
        v -= (v * degree).sum() / degree.sum()
        v = (v + (np.bincount(src, weights=v[dst], minlength=n) + v) / degree) / 2
        v /= np.abs(v).max() + 1e-30
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(8):
        other = np.bincount(src, weights=side[src] != side[dst], minlength=n)
        gain = 2 * other - np.bincount(src, minlength=n)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right), max(1, n // 50))
        good = gain[left[:m]] + gain[right[:m]] > 0
        if not good.any():
            break
        cut = int((side[src] != side[dst]).sum())
        new = side.copy()
        new[left[:m][good]], new[right[:m][good]] = True, False
        if int((new[src] != new[dst]).sum()) >= cut:
            break
        side = new
    return side


def balanced_partition(graph: np.ndarray, parts: int, seed: int = 1) -> np.ndarray:
    """A partition 0..parts-1 (parts a power of two) per node, sizes equal up to one per cut."""
    label = np.zeros(len(graph), np.int64)
    size = 1
    while size < parts:
        new = label * 2
        for part in range(size):
            nodes = np.flatnonzero(label == part)
            if len(nodes) < 2:
                continue
            place = np.full(len(graph), -1)
            place[nodes] = np.arange(len(nodes))
            new[nodes] += _halves(place[graph[nodes]], seed + part)
        label, size = new, size * 2
    return label


@dataclass
class Router:
    """A small network with one hidden layer: vector to log-probabilities of partitions."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit_router(x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, hidden: int = 128, epochs: int = 25, seed: int = 7) -> Router:
    """Trained (Adam, mini-batches) to tell the partitions of a vector's neighbours and its own."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    target = np.zeros((n, parts), np.float32)
    for column in [label, *(label[graph[:, j]] for j in range(graph.shape[1]))]:
        np.add.at(target, (np.arange(n), column), 1)
    target /= target.sum(1, keepdims=True)
    f = np.float32
    w = [(rng.standard_normal((d, hidden)) * np.sqrt(2 / d)).astype(f), np.zeros(hidden, f), (rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden)).astype(f), np.zeros(parts, f)]
    scale = f(np.sqrt(d))
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, 256):
            i = order[a : a + 256]
            xb = x[i] * scale
            xb = xb + rng.standard_normal(xb.shape).astype(f) * f(0.1)
            h = np.maximum(xb @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - target[i]) / len(i)
            gh = (g @ w[2].T) * (h > 0)
            step += 1
            for j, grad in enumerate((xb.T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[j] = 0.9 * m[j] + 0.1 * grad
                v[j] = 0.999 * v[j] + 0.001 * grad * grad
                w[j] -= f(2e-3) * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + f(1e-8))
    return Router(w[0] * scale, w[1], w[2], w[3])


def fit_partitions(x: np.ndarray, parts: int, graph: np.ndarray | None = None) -> Router:
    """Graph, balanced partition and router for at most ``parts`` partitions (a power of two) from unit vectors."""
    while parts > 1 and parts * 8 > len(x):
        parts //= 2
    if parts <= 1:
        d = x.shape[1]
        return Router(np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32))
    graph = neighbour_graph(x, GRAPH_K)
    return fit_router(x, graph, balanced_partition(graph, parts), parts)


def parts_for(rows: float) -> int:
    """The power of two of partitions that leaves about PER_PART rows in each."""
    return 1 << max(0, math.ceil(math.log2(max(rows / PER_PART, 1))))


@dataclass
class Tree:
    """Partitions of one or two levels; the leaves are numbered through. enough: see ``routes``."""

    top: Router
    below: dict[int, Router]
    enough: float = 1.0

    def __post_init__(self):
        widths = [self.below[i].b2.size if i in self.below else 1 for i in range(self.top.b2.size)]
        self.first = np.concatenate([[0], np.cumsum(widths)])

    @property
    def leaves(self) -> int:
        return int(self.first[-1])

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each member: the most probable one on either level."""
        part = self.top.logits(x).argmax(1)
        out = self.first[part]
        for i in np.unique(part):
            if i in self.below:
                mine = part == i
                out[mine] += self.below[i].logits(x[mine]).argmax(1)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """[rows, leaves]: of the first level times those within."""
        p = self.top.probabilities(x)
        out = np.empty((len(x), self.leaves), np.float32)
        for i in range(p.shape[1]):
            share = p[:, i : i + 1]
            out[:, self.first[i] : self.first[i + 1]] = share * self.below[i].probabilities(x) if i in self.below else share
        return out

    def routes(self, x: np.ndarray, enough: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves: of each row the most probable leaves until they hold ``enough`` probability."""
        enough = self.enough if enough is None else enough
        if enough > 1:
            return np.repeat(np.arange(len(x)), self.leaves), np.tile(np.arange(self.leaves), len(x))
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        sorted_p = np.take_along_axis(p, order, 1).astype(np.float64)
        rows, cols = np.nonzero(np.cumsum(sorted_p, 1) - sorted_p < enough)
        return rows, order[rows, cols]


def calibrated(tree: Tree, x: np.ndarray, asked: np.ndarray, k: int, recall: float) -> float:
    """The probability that leaves must hold together so that the vectors ``asked`` (row numbers of x, not seen by
    the router) meet ``recall`` of their k nearest in x."""
    home = tree.home(x)
    needed = []
    for a in range(0, len(asked), 128):
        i = asked[a : a + 128]
        sim = x[i] @ x.T
        sim[np.arange(len(i)), i] = -2
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        p = tree.probabilities(x[i])
        for row, leaves in zip(p, home[near]):
            needed += [float(row[row > row[leaf]].sum(dtype=np.float64)) for leaf in leaves]
    # so much must have been looked into before the leaf's turn comes; a little more lets it in
    return float(np.quantile(needed, recall)) + 1e-6 if needed else 1.0


# --- over all rows ---------------------------------------------------------------------------------------------


def usable(vec: Column, dim: int) -> Column:
    """``dim`` finite elements, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0)


def usable_vectors(rows: DataFrame, record: str, vec: str, dim: int) -> DataFrame:
    """record, vec of usable vectors; of a record's several vectors the least."""
    clean = rows.select(F.col(record).alias("record"), F.col(vec).cast("array<double>").alias("vec"))
    return clean.filter(F.col("record").isNotNull() & usable(F.col("vec"), dim)).groupBy("record").agg(F.min("vec").alias("vec"))


def directions(rows: DataFrame, record: str, vec: str, dim: int) -> DataFrame:
    """record, unit (binary: ``dim`` float32 of the normalised vector) of usable vectors; a record counts once.

    Records of exactly the same direction have the same ``unit``.
    """
    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(-1, dim)
                x = x / np.abs(x).max(1, keepdims=True)
                x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32) + np.float32(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["record", "unit"])

    return usable_vectors(rows, record, vec, dim).mapInArrow(normalise, "record bigint, unit binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _sample(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of least hashes: the same on every run."""
    return rows.orderBy(F.xxhash64("id"), "id").limit(n)


def fit_tree(classes: DataFrame, dim: int, k: int, recall: float) -> Tree | None:
    """The partitions and how far to look into them, fitted on bounded samples; None without a row.

    The first level is fitted on the driver. Where the collection asks for more partitions than it has, every
    partition is cut again by a router of its own, fitted by one task each on SAMPLE_BELOW of its rows.
    """
    sample = _sample(classes.select("id", "unit"), SAMPLE).select("unit").toPandas()
    if not len(sample):
        return None
    x = np.frombuffer(b"".join(sample["unit"]), np.float32).reshape(-1, dim)
    n = classes.count()
    wanted = parts_for(n)
    if wanted == 1:
        return Tree(fit_partitions(x, 1), {})
    held = min(HELD_BACK, len(x) // 6)
    top = fit_partitions(x[held:], min(wanted, TOP[0] if wanted <= TOP[0] * BELOW else TOP[1]))
    below = _fit_below(classes, dim, top) if wanted > top.b2.size else {}
    tree = Tree(top, below)
    # as the sample is thinner than the collection, its nearest few lie as far as the collection's k nearest
    tree.enough = calibrated(tree, x, np.arange(held), min(max(1, math.ceil(k * len(x) / n)), k, len(x) - 1), recall)
    return tree


def _fit_below(classes: DataFrame, dim: int, top: Router) -> dict[int, Router]:
    shared = classes.sparkSession.sparkContext.broadcast(Tree(top, {}))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home = shared.value.home(_matrix(batch.column(1), dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32))], names=["id", "unit", "part"])

    placed = stored(classes.select("id", "unit").mapInArrow(place, "id bigint, unit binary, part int"), "top")
    # a row for each partition of the first level: at most TOP[1]
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    large = [(p, n, min(parts_for(n), BELOW)) for p, n in sorted(sizes.items()) if parts_for(n) > 1]
    if not large:
        discard(placed)
        return {}
    plan = F.broadcast(classes.sparkSession.createDataFrame(large, "part int, n bigint, parts int"))
    some = placed.join(plan, "part").filter(F.pmod(F.xxhash64("id", F.lit(7)), F.col("n")) < SAMPLE_BELOW)

    def fit(rows):
        rows = rows.sort_values("id")
        router = fit_partitions(np.frombuffer(b"".join(rows["unit"]), np.float32).reshape(-1, dim), int(rows["parts"].iloc[0]))
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "router": [pickle.dumps(router)]})

    fitted = some.select("part", "parts", "id", "unit").groupBy("part").applyInPandas(fit, "part int, router binary").collect()
    discard(placed)
    return {r["part"]: pickle.loads(bytes(r["router"])) for r in fitted}


#: A cell, a partition and a group of its queries, is numbered so that cells lie in the order of both.
_CELLS = 1 << 20


def rounds_of(members: dict[int, int], visits: dict[int, int], limit: float) -> list[tuple[int, int]]:
    """First and last cell of each round: consecutive cells that together shuffle ``limit`` rows at most, or one cell.

    members, visits: rows of each partition and queries that come to it. A partition of n blocks has n cells.
    """
    rounds: list[tuple[int, int]] = []
    load = math.inf
    for part, m in sorted(members.items()):
        n = -(-m // BLOCK)
        # a cell has all members and a group of the queries, which meet every block
        each = m + visits.get(part, 0)
        for cell in range(part * _CELLS, part * _CELLS + n):
            load += each
            if load > limit:
                rounds.append((cell, cell))
                load = each
            rounds[-1] = rounds[-1][0], cell
    return rounds


def nearest_classes(classes: DataFrame, dim: int, k: int, least: float, queries: DataFrame | None = None, recall: float = RECALL, exact: bool = False) -> DataFrame:
    """a, b, cosine: for each class its k nearest other classes, as a table that is stored.

    classes: id, unit with distinct units; a stored table is discarded once its rows lie in partitions. queries: the
    ids to search for (all, if None). Partitions are searched in rounds of as many as disk has room for (see ROUND).
    """
    spark = classes.sparkSession
    schema = "a bigint, b bigint, cosine double"
    tree = fit_tree(classes, dim, k, recall)
    if tree is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(tree)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x, asked = _matrix(part.column(1), dim), part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                sizes, leaves = np.zeros(len(x), np.int64), np.zeros(0, np.int64)
                if asked.any() and not exact:
                    rows, leaves = shared.value.routes(x[asked])
                    sizes[asked] = np.bincount(rows, minlength=int(asked.sum()))
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                looks = pa.ListArray.from_arrays(ends, pa.array(leaves.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.home(x).astype(np.int32)), looks], names=["id", "unit", "asked", "part", "looks"])

    marked = classes.withColumn("asked", F.lit(True)) if queries is None else classes.join(queries.select("id", F.lit(True).alias("asked")), "id", "left")
    marked = marked.select("id", "unit", F.coalesce("asked", F.lit(False)).alias("asked"))
    # looks: the partitions that a query looks into (all of them, if exact, and then they aren't written out)
    members = stored(marked.mapInArrow(route, "id bigint, unit binary, asked boolean, part int, looks array<int>"), "members")
    discard(classes)
    asked = members.filter("asked")
    # a row for each partition: at most TOP[1] * BELOW
    sizes = {r["part"]: r["n"] for r in members.groupBy("part").agg(F.count("*").alias("n")).collect()}
    if exact:
        visits = dict.fromkeys(sizes, asked.count())
    else:
        visits = {r["part"]: r["n"] for r in asked.select(F.explode("looks").alias("part")).groupBy("part").agg(F.count("*").alias("n")).collect()}
    # a partition with more than BLOCK members is cut into blocks, and the queries that come to it into as many
    # groups; each block meets each group in a task of its own. The table has a row per such partition.
    cut = [(p, -(-m // BLOCK)) for p, m in sizes.items() if m > BLOCK]
    cut = F.broadcast(spark.createDataFrame(cut, "part int, n int"))

    def laid(rows: DataFrame, own: str, each: str, first: int, last: int) -> DataFrame:
        n = F.coalesce(F.col("n"), F.lit(1))
        placed = rows.join(cut, "part", "left").withColumn(own, F.pmod(F.xxhash64("id"), n).cast("int"))
        placed = placed.withColumn(each, F.explode(F.sequence(F.lit(0), n - 1)))
        cell = F.col("part").cast("bigint") * _CELLS + F.col("group")
        return placed.filter(cell.between(first, last)).select("part", "block", "group", "role", "id", "unit")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (part, block, group, role): the members of a block, at most a few BLOCK, then queries."""
        here, ids, held, flat = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("part", "block", "group", "role")], 1)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1 if len(keys) else []
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if a == b:
                    continue
                *place, role = keys[a].tolist()
                if place != here:
                    here, ids, held, flat = place, [], [], None
                x, i = _matrix(batch.column("unit").slice(a, b - a), dim), batch.column("id").slice(a, b - a).to_numpy()
                if role == 0:
                    held.append(x)
                    ids.append(i)
                    continue
                if not held:
                    continue
                if flat is None:
                    flat, members_ids = np.concatenate(held), np.concatenate(ids)
                for c in range(0, len(x), 512):
                    yield _best(x[c : c + 512], i[c : c + 512], flat, members_ids, k, least)

    near = None
    limit = max(ROUND * sum(sizes.values()), ROUND_LEAST)
    for first, last in rounds_of(sizes, visits, limit):
        low, high = first // _CELLS, last // _CELLS
        inside = F.sequence(F.lit(low), F.lit(high)) if exact else F.filter("looks", lambda p: p.between(low, high))
        probing = asked.select("id", "unit", F.explode(inside).alias("part"), F.lit(1).cast("tinyint").alias("role"))
        held = members.filter(F.col("part").between(low, high)).select("id", "unit", "part", F.lit(0).cast("tinyint").alias("role"))
        both = laid(held, "block", "group", first, last).unionByName(laid(probing, "group", "block", first, last))
        tasks = min(task_count(members), sum((-(-m // BLOCK)) ** 2 for p, m in sizes.items() if low <= p <= high))
        ordered = both.repartition(tasks, "part", "block", "group").sortWithinPartitions("part", "block", "group", "role")
        found = ordered.mapInArrow(search, schema)
        before, near = near, _first(found if near is None else found.unionByName(near), "a", k, F.desc("cosine"), F.asc("b")).drop("_n")
        with shuffles_removed(spark):
            near = stored(near, "near")
        if before is not None:
            discard(before)
    discard(members)
    return near


def _first(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key with their rank ``_n``: cut within each task before the shuffle, so that no
    class or list is gathered."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= n)


def _best(x: np.ndarray, i: np.ndarray, members: np.ndarray, ids: np.ndarray, k: int, least: float) -> pa.RecordBatch:
    sim = x @ members.T
    sim[i[:, None] == ids[None, :]] = -2
    if len(ids) > k:
        edge = np.partition(sim, len(ids) - k, axis=1)[:, len(ids) - k]
        # ties with the k-th stay in; the slack covers the rounding of single precision
        keep = sim >= np.maximum(edge, least)[:, None] - 1e-6
    else:
        keep = sim >= max(least, -1.5) - 1e-6
    rows, cols = np.nonzero(keep)
    cosine = (x[rows].astype(np.float64) * members[cols].astype(np.float64)).sum(1)
    return pa.RecordBatch.from_arrays([pa.array(i[rows]), pa.array(ids[cols]), pa.array(cosine)], names=["a", "b", "cosine"])


def most_similar(rows: DataFrame, record: str, vec: str, k: int = 10, dim: int = 100, least: float = -1.0, queries: DataFrame | None = None, recall: float = RECALL, exact: bool = False, refine: bool = False) -> DataFrame:
    """record, neighbour, cosine, rank: the k nearest other records by cosine, ties by the smaller record.

    Approximate: a query is compared with all vectors of its most probable partitions. How many those are is found
    out on held-back vectors, so that ``recall`` of the nearest are met whatever the vectors are like; there is no
    cap. Vectors without any structure make a query look into most partitions. ``exact`` looks into all. Cosines are of
    single precision unless ``refine`` asks for those of the vectors as given, rounded to nine digits before they
    are ranked: then SLACK more neighbours are found first, so that rounding can't decide who is among the k. ``least`` leaves out neighbours of a lower cosine. ``queries`` (a column named as the record)
    restricts the records searched for, never those searched. Null vectors, vectors of another length, with
    non-finite elements or of zero length do not take part; repeated records count once; an empty table gives
    no row. Records of equal direction are one class in the search; each class hands on its k + 1 least records
    only, as no further one can be among anybody's k nearest.
    """
    spark = rows.sparkSession
    held = k + 1 + (SLACK if refine else 0)
    # tables with vectors go as soon as nothing reads them any more: disk holds one or two of them at any time
    with shuffles_removed(spark):
        units = stored(directions(rows, record, vec, dim), "units")
        classes = stored(units.groupBy("unit").agg(F.min("record").alias("id")), "classes")
        named = classes.select("id", F.sha2("unit", 256).alias("key"))
        members = stored(units.select("record", F.sha2("unit", 256).alias("key")).join(named, "key").select("record", "id"), "records")
        discard(units)
        wanted = members if queries is None else members.join(queries.select(F.col(record).cast("bigint").alias("record")), "record", "left_semi")
        asked = wanted.select("id").distinct()
        near = nearest_classes(classes, dim, held - 1, least, None if queries is None else asked, recall, exact)

    # the k + 1 least records of each class
    first = _first(members, "id", held, F.asc("record")).select(F.col("id").alias("b"), F.col("record").alias("neighbour"))
    near = near.unionByName(asked.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine")))
    # k nearest classes hold the k nearest records; the lists are made once a class, then handed to its records
    lists = _first(near.join(first, "b"), "a", held, F.desc("cosine"), F.asc("neighbour")).select("a", "neighbour", "cosine")
    pairs = wanted.withColumnRenamed("id", "a").join(lists, "a").filter("record <> neighbour")
    out = _first(pairs, "record", k + SLACK if refine else k, F.desc("cosine"), F.asc("neighbour"))
    if refine:
        vecs = usable_vectors(rows, record, vec, dim)
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
        both = out.select("record", "neighbour").join(vecs, "record").join(vecs.select(F.col("record").alias("neighbour"), F.col("vec").alias("other")), "neighbour")
        cosine = F.round(dot("vec", "other") / F.sqrt(dot("vec", "vec")) / F.sqrt(dot("other", "other")), 9)
        out = _first(both.select("record", "neighbour", cosine.alias("cosine")), "record", k, F.desc("cosine"), F.asc("neighbour"))
    out = out.filter(F.col("cosine") >= least)
    return out.select(F.col("record").alias(record), "neighbour", "cosine", F.col("_n").cast("bigint").alias("rank"))


def mutual_pairs(nearest: DataFrame, record: str) -> DataFrame:
    """id_a, id_b (id_a < id_b) of records that are in each other's list."""
    ordered = nearest.select(F.least(record, "neighbour").alias("id_a"), F.greatest(record, "neighbour").alias("id_b"))
    return ordered.groupBy("id_a", "id_b").agg(F.count("*").alias("n")).filter("n = 2").select("id_a", "id_b")
