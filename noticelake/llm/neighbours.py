"""Approximate nearest neighbours over balanced posting lists.

About ``2 sqrt(n)`` centroids, fitted on bounded samples in two levels, are held
in memory with a graph that links each to its nearest ones.  A vector goes to
the list of its nearest centroid and, near a boundary, to the lists of others
almost as near.  A query searches the graph and reads the lists whose centroids
are within a ratio of the distance up to which centroids hold a few times what
is asked for.  The ratio isn't fixed: a bounded sample of the queries is searched
in all vectors, and the ratio is what ``TARGET`` of their true neighbours need, so
that data with clusters read little and data without any read most lists.  Where
the graph loses some of these neighbours, all centroids are compared.  Long lists are dealt to chunks and their queries to
parts, so that no task holds more than one of each.  Equal vectors are searched
once, under their smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import stored

#: Vectors that reach the driver for fitting, centroids that are fitted there, and centroids in all, at most.
MAX_SAMPLE, DIRECT, MAX_LISTS = 20_000, 512, 65_536
#: Vectors that each centroid of the second level is fitted on; the levels' sample is so many times the lists.
PER_LIST = 32
#: Groups of centroids, nearest to a vector's own, that it is compared with.
NEAR_GROUPS = 12
#: A vector is copied to lists up to this ratio of its nearest centroid's distance, and to so many.
COPY_RATIO, MAX_COPIES = 1.06, 4
#: A query reads so many lists at least; up to this share of the lists it finds them in the graph, beyond it all centroids are compared.
LEAST_READ, GRAPH_SHARE = 128, 1 / 6
#: Queries that are searched in all vectors to find the ratio, and the share of their true neighbours that it is to reach.
PROBES, TARGET = 200, 0.98
#: Links of a centroid in the graph, the search's breadth beyond what is asked for, and the centroids it starts from.
LINKS, BREADTH, STARTS = 24, 32, 8
#: Vectors in a chunk of a list, and queries in a part of those that read it.
CHUNK, PART = 2_000, 4_000
K = 10


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components, and one other than zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, good enough to choose by; about the middle of b, as rounding grows with what all have in common."""
    middle = b.mean(0)
    a, b = a - middle, b - middle
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


class Graph:
    """Centroids and their links, searched from those near a vector's own group; and their groups with what a vector of each is compared with."""

    def __init__(self, points: np.ndarray, groups: np.ndarray | None = None, of: np.ndarray | None = None) -> None:
        self.points, n = points, len(points)
        self.groups = points.mean(0, keepdims=True) if groups is None else groups
        of = np.zeros(n, int) if of is None else of
        near_groups = np.argsort(distances(self.groups, self.groups), axis=1, kind="stable")[:, :NEAR_GROUPS]
        self.compared = [np.flatnonzero(np.isin(of, g)) for g in near_groups]
        links = min(LINKS, n - 1)
        near = np.empty((n, links), int)
        for at in range(0, n, 256):  # bounds the driver's memory
            d = distances(points[at : at + 256], points)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near[at : at + 256] = np.argpartition(d, max(links - 1, 0), axis=1)[:, :links]
        ring = (np.arange(n)[:, None] + np.array([1, n // 2 + 1])) % n  # so that every centroid can be reached
        self.links = np.concatenate([near, ring], axis=1)

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, -1 where there are fewer, and squared distances of the k nearest centroids of each row, nearest first, among those of the groups near its own."""
        ids, dist = np.full((len(x), k), -1), np.full((len(x), k), np.inf)
        own = distances(x, self.groups).argmin(1)
        for g in np.unique(own):
            rows, among = np.flatnonzero(own == g), self.compared[g]
            d = distances(x[rows], self.points[among])
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            ids[rows, : best.shape[1]], dist[rows, : best.shape[1]] = among[best], np.take_along_axis(d, best, 1)
        return ids, dist

    def search(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and squared distances of about the k nearest centroids of each row, nearest first.

        All rows go on together: each expands its nearest open centroid, and a
        row is through when none of its ``k + BREADTH`` nearest is open.
        """
        k = min(k, len(self.points))
        width, rows = min(k + BREADTH, len(self.points)), np.arange(len(x))
        ids = np.full((len(x), width), -1)
        dist = np.full((len(x), width), np.inf)
        seen = np.zeros((len(x), len(self.points)), bool)
        start = self.nearest(x, min(STARTS, width))[0]
        ids[:, : start.shape[1]] = start
        dist[:, : start.shape[1]] = np.where(start >= 0, ((x[:, None, :] - self.points[start]) ** 2).sum(2), np.inf)
        r, c = np.nonzero(start >= 0)
        seen[r, start[r, c]] = True
        open_ = ids >= 0
        while True:
            waiting = np.where(open_, dist, np.inf)
            at = waiting.argmin(1)
            live = np.flatnonzero(np.isfinite(waiting[rows, at]))
            if not len(live):
                return ids[:, :k], dist[:, :k]
            open_[live, at[live]] = False
            new = self.links[ids[live, at[live]]]
            d = ((x[live, None, :] - self.points[new]) ** 2).sum(2)
            d[seen[live[:, None], new]] = np.inf
            seen[live[:, None], new] = True
            order = np.sort(new, axis=1)  # a link may be listed twice
            if (order[:, 1:] == order[:, :-1]).any():
                for r in range(len(new)):
                    _, first = np.unique(new[r], return_index=True)
                    d[r, np.setdiff1d(np.arange(new.shape[1]), first)] = np.inf
            all_d, all_i = np.concatenate([dist[live], d], 1), np.concatenate([ids[live], new], 1)
            all_o = np.concatenate([open_[live], np.isfinite(d)], 1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            take = lambda m: np.take_along_axis(m, best, 1)
            dist[live], ids[live], open_[live] = take(all_d), take(all_i), take(all_o)

    def ordered(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and squared distances of the ``most`` nearest centroids of each row, nearest first: from the graph where they are few, else by comparing all."""
        if most <= GRAPH_SHARE * len(self.points):
            return self.search(x, most)
        d = distances(x, self.points)
        ids = np.argsort(d, axis=1, kind="stable")[:, :most]
        return ids, np.take_along_axis(d, ids, 1)


def centroids(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means centroids of the sample; an empty cluster takes the point of the sample that is farthest from its own."""
    order = np.random.default_rng(seed).permutation(len(sample))
    points = sample[order[:n]].copy()
    for _ in range(rounds):
        of, far = np.empty(len(sample), int), np.empty(len(sample))
        for at in range(0, len(sample), 1000):  # bounds the driver's memory
            d = distances(sample[at : at + 1000], points)
            of[at : at + 1000], far[at : at + 1000] = d.argmin(1), d.min(1)
        size = np.bincount(of, minlength=n)
        total = np.zeros_like(points)
        np.add.at(total, of, sample)
        points = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], points)
        empty = np.flatnonzero(size == 0)
        points[empty] = sample[np.argsort(-far, kind="stable")[: len(empty)]]
    return points


def fitted(vectors: DataFrame, n: int) -> Graph:
    """The graph of about ``2 sqrt(n)`` centroids of the distinct vectors.

    Up to ``DIRECT`` come from one sample on the driver.  More are fitted by
    groups: the driver finds the groups, each task the centroids of one group
    within a larger sample, as many as its share of it.
    """
    by_hash = F.xxhash64("v"), "v"
    sample = matrix(vectors.select("v").orderBy(*by_hash).limit(MAX_SAMPLE).toPandas()["v"])  # bounded
    lists = int(np.clip(np.ceil(2 * np.sqrt(n)), 1, min(MAX_LISTS, n)))
    if lists <= DIRECT:
        return Graph(centroids(sample, min(lists, len(sample))))
    groups = centroids(sample, int(np.ceil(np.sqrt(lists))))
    sent = vectors.sparkSession.sparkContext.broadcast(groups)
    share = min(1.0, PER_LIST * lists / n)

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"group": distances(matrix(frame["v"]), sent.value).argmin(1), "v": frame["v"]})

    chosen = vectors.select("v").where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)  # by hash, about PER_LIST a list
    members = stored(chosen.mapInPandas(own, "group int, v binary"))
    total = members.count()

    def fine(frame: pd.DataFrame) -> pd.DataFrame:
        points = centroids(matrix(frame["v"]), int(np.clip(round(lists * len(frame) / total), 1, len(frame))))
        return pd.DataFrame({"group": frame["group"].iloc[0], "v": [p.tobytes() for p in points]})

    rows = members.groupBy("group").applyInPandas(fine, "group int, v binary").toPandas().sort_values(["group", "v"])  # about MAX_LISTS rows at most
    return Graph(matrix(rows["v"]), groups, rows["group"].to_numpy())


def _postings(vectors: DataFrame, graph) -> DataFrame:
    """(v, ids) -> (list, v, ids) for every list that a vector belongs to."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 1000):
                part = frame.iloc[at : at + 1000]
                ids, d = graph.value.nearest(matrix(part["v"]), MAX_COPIES)
                rows, cols = np.nonzero((ids >= 0) & (d <= COPY_RATIO**2 * d[:, :1]))
                yield pd.DataFrame({"list": ids[rows, cols], "v": part["v"].to_numpy()[rows], "ids": part["ids"].to_numpy()[rows]})

    return vectors.select("v", "ids").mapInPandas(run, "list int, v binary, ids array<long>")


class Reach(NamedTuple):
    """Which lists queries read: the ``LEAST_READ`` nearest, and of the ``most`` nearest those within ``ratio``."""

    ratio: float
    most: int

    def read(self, ids: np.ndarray, d: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """Which of the lists ``ids``, at squared distances ``d`` and nearest first, each row reads: ``ratio`` is of the distance at which lists hold ``least``."""
        return (ids >= 0) & ((np.arange(ids.shape[1]) < LEAST_READ) | (d <= self.ratio**2 * _base(ids, d, sizes, least)))


def _base(ids: np.ndarray, d: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """The squared distance of the list with which the nearest ones hold ``least`` vectors, a column."""
    held = np.cumsum(np.where(ids >= 0, sizes[ids], 0), axis=1)
    at = np.minimum((held < least).sum(1), ids.shape[1] - 1)
    return d[np.arange(len(d)), at][:, None]


def _batch(lists: int) -> int:
    """Queries that are compared with so many lists at once."""
    return max(1, min(500, 4_000_000 // lists))


def _truth(vectors: DataFrame, probes: np.ndarray, k: int) -> dict[int, np.ndarray]:
    """The k vectors nearest to each probe, other than its own, among all: each task finds its own k, and these are merged by probe."""
    sent = vectors.sparkSession.sparkContext.broadcast(probes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {p.tobytes(): i for i, p in enumerate(sent.value)}
        best_d, best_v = np.full((len(own), k), np.inf), np.full((len(own), k), None, object)
        for frame in frames:
            v = frame["v"].to_numpy()
            d = distances(sent.value, matrix(frame["v"]))
            for j in np.flatnonzero([bytes(x) in own for x in v]):
                d[own[bytes(v[j])], j] = np.inf
            for i in range(len(d)):
                near = np.argpartition(d[i], k - 1)[:k] if d.shape[1] > k else np.arange(d.shape[1])
                all_d, all_v = np.concatenate([best_d[i], d[i][near]]), np.concatenate([best_v[i], v[near]])
                take = np.argsort(all_d, kind="stable")[:k]
                best_d[i], best_v[i] = all_d[take], all_v[take]
        rows, cols = np.nonzero(np.isfinite(best_d))
        yield pd.DataFrame({"probe": rows, "d": best_d[rows, cols], "v": best_v[rows, cols]})

    found = vectors.select("v").mapInPandas(run, "probe int, d double, v binary")
    best = found.groupBy("probe").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "v"))), 1, k).alias("best")).select("probe", F.col("best.v").alias("v"))
    return {r["probe"]: matrix(pd.Series([bytes(x) for x in r["v"]])) for r in best.collect()}  # PROBES * k vectors


def _reach(vectors: DataFrame, queries: DataFrame, model: Graph, sizes: np.ndarray, least: int, k: int) -> Reach:
    """What the lists of a bounded sample's true neighbours ask for."""
    lists = len(sizes)
    if lists <= LEAST_READ:
        return Reach(1.0, lists)
    probes = queries.select("v").orderBy(F.xxhash64("v", F.lit(1)), "v").limit(PROBES).toPandas()["v"]
    if not len(probes):
        return Reach(1.0, LEAST_READ)
    x = matrix(probes)
    truth = _truth(vectors, x, k)
    place, need, base, order, dist = {}, [], np.empty(len(x)), np.empty((len(x), lists), np.int32), np.empty((len(x), lists))
    for at in range(0, len(x), _batch(lists)):
        part = slice(at, at + _batch(lists))
        order[part], dist[part] = model.ordered(x[part], lists)
        base[part] = _base(order[part], dist[part], sizes, least)[:, 0]
    for i, v in truth.items():
        ids, d = model.nearest(v, MAX_COPIES)
        place[i] = [row[(row >= 0) & (near <= COPY_RATIO**2 * near[0])] for row, near in zip(ids, d)]
        at = np.empty(lists, int)
        at[order[i]] = np.arange(lists)
        # what the nearest lists hold anyway needs no ratio
        first = [at[p].min() for p in place[i]]
        need += [0.0 if f < LEAST_READ else np.sqrt(dist[i, f] / max(base[i], 1e-300)) for f in first]
    ratio = max(1.0, float(np.quantile(need, TARGET, method="higher")) * (1 + 1e-9)) if need else 1.0
    wide = int(((dist <= ratio**2 * base[:, None]).sum(1)).max())
    for most in (max(LEAST_READ, min(lists, int(np.ceil(1.25 * wide)))), lists):
        reach, hits = Reach(ratio, most), 0
        for i in truth:
            ids, d = model.ordered(x[i : i + 1], most)
            read = ids[0][reach.read(ids, d, sizes, least)[0]]
            hits += sum(np.isin(p, read).any() for p in place[i])
        if hits >= (TARGET - 0.01) * len(need):
            break
    return reach


def _reads(queries: DataFrame, graph, sizes: np.ndarray, least: int, reach: Reach) -> DataFrame:
    """(q, v) -> (list, q, v) for every list that a query reads."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), _batch(len(sizes))):
                part = frame.iloc[at : at + _batch(len(sizes))]
                ids, d = graph.value.ordered(matrix(part["v"]), reach.most)
                rows, cols = np.nonzero(reach.read(ids, d, sizes, least))
                yield pd.DataFrame({"list": ids[rows, cols], "q": part["q"].to_numpy()[rows], "v": part["v"].to_numpy()[rows]})

    return queries.mapInPandas(run, "list int, q long, v binary")


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(vec_id, v) -> (v, ids): a batch's equal vectors with their smallest ids."""
    for frame in frames:
        groups = frame.sort_values("vec_id").groupby("v", sort=False)["vec_id"]
        yield pd.DataFrame([(v, ids.to_numpy()[: K + 1]) for v, ids in groups], columns=["v", "ids"])


def search(df: DataFrame, k: int = K, every: int = 100) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score) for the queries, the rows whose ``vec_id`` is divisible by ``every``.

    ``score`` is the Euclidean distance in double precision on the original
    vectors; ties go to the smaller ``vec_id``, and a query never finds its own
    row.  Vectors that are null, zero, or hold null or non-finite components
    take no part, nor do rows without a ``vec_id``.  Columns beyond the two are
    not read.  Vectors of different lengths are never neighbours: each length is
    a search of its own.  Empty tables give no rows.  Recall against brute
    force, at several sizes, is in the README.
    """
    spark = df.sparkSession

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"vec_id": frame["vec_id"].array, "v": [(np.asarray(x, np.float64) + 0.0).tobytes() for x in frame["x"]]})

    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & usable(F.col("x")))
    rows = stored(rows.mapInPandas(pack, "vec_id long, v binary"))
    lengths = sorted(r["n"] for r in rows.select(F.length("v").alias("n")).distinct().collect())  # a number per dimension
    parts = [_search(rows if len(lengths) == 1 else rows.where(F.length("v") == n), k, every) for n in lengths]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _FOUND)


_FOUND = "query_id long, rank int, vec_id long, score double"


def _search(rows: DataFrame, k: int, every: int) -> DataFrame:
    """``search`` over packed vectors of one length."""
    spark = rows.sparkSession
    few = rows.mapInPandas(_merge, "v binary, ids array<long>").groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    vectors = stored(few)
    n = vectors.count()
    model = fitted(vectors, n)
    graph = spark.sparkContext.broadcast(model)

    postings = stored(_postings(vectors, graph))
    sizes = np.zeros(len(model.points), np.int64)
    held = stored(postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")))  # a row per list
    for r in held.collect():
        sizes[r["list"]] = r["n"]
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = stored(asked.groupBy("v").agg(F.min("vec_id").alias("q")).select("q", "v"))
    least = 20 * (k + 1)
    reads = stored(_reads(queries, graph, sizes, least, _reach(vectors, queries, model, sizes, least, k)))
    deal = held.select("list", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")).join(reads.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "list")
    # each part of a list's queries meets each chunk of its vectors in a task of its own
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = reads.join(deal, "list").select("list", every_of("chunks").alias("chunk"), F.pmod(F.xxhash64("q"), "parts").cast("int").alias("part"), "q", "v")
    right = postings.join(deal, "list").select("list", F.pmod(F.xxhash64("v"), "chunks").cast("int").alias("chunk"), every_of("parts").alias("part"), "v", "ids")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            b = matrix(right["v"])
            middle = b.mean(0)
            widest = ((b - middle) ** 2).sum(1).max()
            ids, low = right["ids"].to_numpy(), right["ids"].map(lambda x: x[0]).to_numpy()
            for at in range(0, len(left), 256):
                names = left["q"].to_numpy()[at : at + 256]
                a = matrix(left["v"].iloc[at : at + 256])
                d = distances(a, b)
                m = min(k + 1, len(b))
                # all that may be as near as the last one, which rounding and ties leave open
                slack = 1e-9 * (((a - middle) ** 2).sum(1) + widest)
                last = np.partition(d, m - 1, axis=1)[:, m - 1] + slack
                for i in range(len(a)):
                    c = np.flatnonzero(d[i] <= last[i])
                    exact = np.sqrt(((b[c] - a[i]) ** 2).sum(1))
                    for j in np.lexsort((low[c], exact))[: k + 1]:
                        out.append((names[i], float(exact[j]), ids[c[j]]))
        return pd.DataFrame(out, columns=["q", "score", "ids"])

    keys = ("list", "chunk", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, "q long, score double, ids array<long>")
    # per distinct query vector: its k + 1 nearest vectors, copies from several lists once
    best = found.groupBy("q", "ids").agg(F.min("score").alias("score")).groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "ids"))), 1, k + 1).alias("best"))
    flat = F.array_sort(F.flatten(F.transform("best", lambda x: F.transform(x["ids"], lambda i: F.struct(x["score"].alias("score"), i.alias("vec_id"))))))
    best = best.select("q", flat.alias("best")).join(queries, "q")
    own = asked.join(best, "v").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
