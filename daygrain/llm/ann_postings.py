"""Approximate nearest neighbours over balanced posting lists.

Centroids come from balanced k-means on a bounded sample: a centroid's price rises with the
share of vectors it holds. Each vector goes to the list of its nearest centroid, and a boundary
vector also to further lists whose centroids are nearly as near and not closer to a list it already
has than to it. The centroids (at most ``max_lists``, whatever the table's size) are searched by an
in-memory neighbour graph. A query visits all lists whose centroid is within a ratio of its reach: the
nearest centroid's distance, or that list's radius where the query lies nearer to the centroid than that. The ratio is the least
with which queries of the sample find ``recall`` of their neighbours in the sample, which lie farther off than those in the table. Further
lists follow until those visited hold k other vectors.

A list is cut into chunks by a hash of the id, so that a list (or a group of equal vectors) of
any size is spread over tasks, and the queries that visit a list into blocks by a hash of theirs; each block meets
each chunk of the list, a query returns its best rows of that chunk,
and the few best of all chunks are ranked. Distances are taken on the original vectors in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from daygrain.llm.common import as_table

SAMPLE_ROWS = 20_000
MAX_LISTS = 2048
LIST_ROWS = 64
CHUNK_ROWS = 4096
QUERY_ROWS = 4096
REPLICAS = 3
BOUNDARY = 1.06
RECALL = 0.94  # of the sample's own neighbours; the ratio follows from it
RATIOS = np.arange(1.0, 1.61, 0.02)
TRIED = 300  # queries of the sample
DEGREE = 24
BEAM = 160  # the graph search expands at least so many centroids
ROUNDS = 12


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def balanced_centroids(sample: np.ndarray, k: int, rounds: int = ROUNDS, price: float = 0.5) -> np.ndarray:
    """k-means in which a centroid that holds more than its share gets dearer, and a poor one cheaper.

    Equal vectors count once. Each list is represented by its member nearest to the mean, not by the mean, whose
    smaller norm would draw vectors from everywhere.
    """
    points = np.unique(sample, axis=0)
    k = min(k, len(points))
    centroids = points[np.random.default_rng(7).permutation(len(points))[:k]].copy()
    extra, scale = np.zeros(k), None
    for step in range(rounds):
        own, least = np.zeros(len(points), int), np.zeros(len(points))
        for at, x in zip(range(0, len(points), 2048), _blocks(points)):
            d = _squared(x, centroids)
            least[at:at + 2048] = d.min(axis=1)
            scale = scale or float(np.median(least[:at + 2048])) or 1.0
            own[at:at + 2048] = (d + extra * scale).argmin(axis=1)
        scale = float(np.median(least)) or 1.0
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        full = size > 0
        means = np.where(full[:, None], sums / np.maximum(size, 1)[:, None], centroids)
        to_mean = ((points - means[own]) ** 2).sum(axis=1)
        order = np.lexsort((to_mean, own))
        first = order[np.searchsorted(own[order], np.flatnonzero(full))]
        centroids[full] = points[first]
        # an empty list starts anew inside a list that holds too many
        crowd = np.argsort(-size[own], kind="stable")
        centroids[~full] = points[crowd[:: max(1, len(crowd) // max(1, (~full).sum()) // 4)][:(~full).sum()]]
        extra = np.where(full, np.clip(extra + price * (np.minimum(size * k / len(points), 3) - 1) / (step + 2), -0.3, 0.5), 0.0)
    return centroids


@dataclass(frozen=True)
class CentroidGraph:
    """Each centroid's nearest centroids, and those that it is one of the nearest of; a search walks along them."""
    centroids: np.ndarray
    neighbours: list[np.ndarray]

    @staticmethod
    def build(centroids: np.ndarray, degree: int = DEGREE) -> "CentroidGraph":
        d = _squared(centroids, centroids)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, :max(0, min(degree, len(centroids) - 1))]
        # a link to a random centroid joins parts that the nearest links leave apart
        far = np.random.default_rng(3).integers(0, max(len(centroids), 1), (len(centroids), 2))
        ring = (np.arange(len(centroids))[:, None] + 1) % max(len(centroids), 1)
        ahead = np.concatenate([near, far, ring], axis=1)
        linked = np.zeros((len(centroids), len(centroids)), bool)
        linked[np.arange(len(centroids))[:, None], ahead] = True
        return CentroidGraph(centroids, [np.flatnonzero(x) for x in linked | linked.T])

    def search(self, v: np.ndarray, ratio: float, radius: np.ndarray | None = None, rows: np.ndarray | None = None,
               least: int = 0) -> np.ndarray:
        """The centroids within ``ratio`` of the reach of ``v``, nearest first, and as many more as hold ``least`` rows.

        Best-first search: it goes on while a centroid within the ratio or among the ``BEAM`` nearest found is not yet
        expanded, and returns all it found within the ratio.
        """
        seen = np.zeros(len(self.centroids), bool)
        found, dist, open_ = np.zeros(0, int), np.zeros(0), np.zeros(0, bool)
        new = np.unique(np.linspace(0, len(self.centroids) - 1, 8).astype(int))
        while len(new):
            seen[new] = True
            d = np.sqrt(((self.centroids[new] - v) ** 2).sum(axis=1))
            found, dist, open_ = np.append(found, new), np.append(dist, d), np.append(open_, np.ones(len(new), bool))
            order = np.argsort(dist, kind="stable")
            found, dist, open_ = found[order], dist[order], open_[order]
            within = dist <= ratio * self._reach(found, dist, radius)
            count = int(within.sum())
            if rows is not None and least:
                count = max(count, int(np.searchsorted(np.cumsum(rows[found]), least)) + 1)
            wanted = max(count, BEAM)
            new = np.zeros(0, int)
            while not len(new) and open_[:wanted].any():
                step = np.flatnonzero(open_[:wanted])[:8]
                open_[step] = False
                new = np.unique(np.concatenate([self.neighbours[i] for i in found[step]]))
                new = new[~seen[new]]
        return found[:count]

    @staticmethod
    def _reach(found: np.ndarray, dist: np.ndarray, radius: np.ndarray | None) -> float:
        """A distance that is zero only if all centroids found are equal to the vector."""
        reach = max(dist[0], radius[found[0]] if radius is not None else 0.0)
        return reach or next(iter(dist[dist > 0]), 0.0)


@dataclass(frozen=True)
class Index:
    """The graph with each list's radius, and the ratio that the sample asks for."""
    graph: CentroidGraph
    radius: np.ndarray
    ratio: float


def lists_of(x: np.ndarray, c: np.ndarray, between: np.ndarray, boundary: float, replicas: int) -> list[list[int]]:
    """The lists of each row: the nearest centroid's, and for a boundary row some more."""
    d = _squared(x, c)
    near = np.argpartition(d, min(4 * replicas, d.shape[1]) - 1, axis=1)[:, :4 * replicas]
    out = []
    for row, at in zip(d, near):
        at = at[np.argsort(row[at], kind="stable")]
        kept = [at[0]]
        for i in at[1:]:
            if len(kept) == replicas or row[i] > boundary ** 2 * row[at[0]]:
                break
            if row[i] <= boundary ** 2 * min(between[i, j] for j in kept):
                kept.append(i)
        out.append([int(i) for i in kept])
    return out


def fitted_ratio(sample: np.ndarray, centroids: np.ndarray, radius: np.ndarray, recall: float = RECALL, k: int = 10,
                 boundary: float = BOUNDARY, replicas: int = REPLICAS) -> float:
    """The least of ``RATIOS`` with which queries of the sample reach ``recall``; the largest if none does."""
    points = np.unique(sample, axis=0)
    if len(points) <= k or len(centroids) < 2:
        return float(RATIOS[-1])
    tried = points[np.random.default_rng(5).permutation(len(points))[:TRIED]]
    between, to = _squared(centroids, centroids), np.sqrt(_squared(tried, centroids))
    nearest = to.argmin(axis=1)
    reach = np.maximum(to.min(axis=1), radius[nearest])
    reach = np.where(reach > 0, reach, np.where(to > 0, to, np.inf).min(axis=1))
    needed = []
    for v, row, r, d in zip(tried, to, reach, _squared(tried, points)):
        near = np.argsort(d, kind="stable")[:k + 1]
        near = near[(points[near] != v).any(axis=1)][:k]
        # a neighbour is found once the nearest of its lists is visited
        needed += [min(row[i] for i in held) / r for held in lists_of(points[near], centroids, between, boundary, replicas)]
    wanted = float(np.quantile(needed, recall, method="higher"))
    return float(next((x for x in RATIOS if x >= wanted), RATIOS[-1]))


def _valid(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; all have the same length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def lists_column(vector: Column, shared, boundary: float = BOUNDARY, replicas: int = REPLICAS) -> Column:
    """The lists that keep a vector: the nearest centroid's, and for a boundary vector some more."""
    @F.arrow_udf("array<int>")
    def run(vectors: pa.Array) -> pa.Array:
        c = shared.value.graph.centroids
        between = _squared(c, c)
        out = [held for x in _blocks(_matrix(vectors)) for held in lists_of(x, c, between, boundary, replicas)]
        return pa.array(out, pa.list_(pa.int32()))
    return run(vector)


def _blocks(x: np.ndarray, rows: int = 2048):
    return (x[i:i + rows] for i in range(0, len(x), rows))


def radius_of(sample: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """By list, the mean distance of the sample's rows in it, but for the centroid, which is one of them."""
    total, count = np.zeros(len(centroids)), np.zeros(len(centroids))
    for x in _blocks(sample):
        d = np.sqrt(_squared(x, centroids))
        own = d.argmin(axis=1)
        near = d[np.arange(len(x)), own]
        off = near > 1e-6 * np.sqrt((x * x).sum(axis=1))  # as exact as _squared is
        np.add.at(total, own[off], near[off])
        np.add.at(count, own[off], 1)
    return total / np.maximum(count, 1)


def probes_column(vector: Column, shared, ratio: float | None = None, rows: np.ndarray | None = None, least: int = 0) -> Column:
    """The lists that a query visits: all within ``ratio`` of its reach (None: the index's), and more until they hold ``least`` of ``rows``."""
    @F.arrow_udf("array<int>")
    def run(vectors: pa.Array) -> pa.Array:
        graph, radius, within = shared.value.graph, shared.value.radius, shared.value.ratio if ratio is None else ratio
        out = [[int(i) for i in graph.search(v, within, radius, rows, least)] for v in _matrix(vectors)]
        return pa.array(out, pa.list_(pa.int32()))
    return run(vector)


def _best_of_chunk(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """Each query's k nearest rows of one chunk of a list, exact on the original vectors."""
        out = []
        if len(queries) and len(rows):
            rows = rows.sort_values("vec_id", kind="stable")
            ids, x = rows["vec_id"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype(float)
            asked, v = queries["query_id"].to_numpy(), np.stack(queries["vector"].to_numpy()).astype(float)
            out = [_nearest(asked[at:at + 256], v[at:at + 256], ids, x, k) for at in range(0, len(v), 256)]
        query, vec, score = (np.concatenate(c) for c in zip(*out)) if out else ([], [], [])
        return pd.DataFrame({"query_id": query, "vec_id": vec, "score": score})
    return run


def _nearest(asked: np.ndarray, v: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k nearest rows of other ids, exact; a matrix product only tells which rows may be among them."""
    squared = _squared(v, x)
    squared[asked[:, None] == ids] = np.inf
    most = np.full(len(v), np.finfo(float).max)
    if len(ids) > k:
        # the product's error grows with the vectors' squared length
        slack = 1e-9 * ((v * v).sum(axis=1) + (x * x).sum(axis=1).max())
        most = np.minimum(most, np.partition(squared, k - 1, axis=1)[:, k - 1] + slack)
    query, row = np.nonzero(squared <= most[:, None])
    d = np.sqrt(((x[row] - v[query]) ** 2).sum(axis=1))
    order = np.lexsort((row, d, query))  # the rows come by id
    query, row, d = query[order], row[order], d[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
    best = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)])) < k
    return asked[query[best]], ids[row[best]], d[best]


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS,
                max_lists: int = MAX_LISTS, list_rows: int = LIST_ROWS, chunk_rows: int = CHUNK_ROWS, recall: float = RECALL):
    """(valid rows, postings, chunks, index): every valid row is in one or more lists.

    The centroids are fitted on at most ``sample_rows`` rows of smallest hashed id; there are at most ``max_lists``.
    Repeated ids are rows of their own; null ids, and vectors of another length than most, take no part.
    """
    v, spark = F.col(vector_col), vectors.sparkSession
    rows = as_table(vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where(F.col(id_col).isNotNull() & _valid(v)))
    sizes = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if sizes is None:
        return rows, None, None, None
    rows = rows.where(F.size("vector") == sizes["width"])
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").collect()], float)
    k = max(1, min(max_lists, sizes["count"] // list_rows))
    centroids = balanced_centroids(sample, k)
    radius = radius_of(sample, centroids)
    shared = spark.sparkContext.broadcast(Index(CentroidGraph.build(centroids), radius, fitted_ratio(sample, centroids, radius, recall)))
    postings = as_table(rows.select("vec_id", "vector", F.posexplode(lists_column(F.col("vector"), shared)).alias("place", "list")))
    # one row a list: at most max_lists; own: the rows for which it is the nearest
    chunks = as_table(postings.groupBy("list").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"),
                                                   F.count_if(F.col("place") == 0).alias("own")))
    return rows, postings, chunks, shared


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
           ratio: float | None = None, query_rows: int = QUERY_ROWS, **index_options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row where ``is_query`` (of ``vec_id``) holds.

    Smallest Euclidean distance first, ties to the smaller id; a query is not its own candidate. A query has
    fewer than k rows only if the table has fewer candidates.
    """
    rows, postings, chunks, shared = build_index(vectors, id_col, vector_col, **index_options)
    if postings is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    all_chunks = F.broadcast(chunks.drop("own"))
    own = np.zeros(len(shared.value.radius), int)
    for r in chunks.select("list", "own").collect():
        own[r["list"]] = r["own"]
    probes = as_table(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vector",
                                                  F.explode(probes_column(F.col("vector"), shared, ratio, own, k + 1)).alias("list")))
    # one row a list: at most max_lists; a list that no query visits needs no rows
    blocks = F.broadcast(probes.groupBy("list").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt_to = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    queries = (probes.join(all_chunks, "list").join(blocks, "list")
               .select("query_id", "vector", "list", dealt_to("query_id", "blocks").alias("block"), each("chunks").alias("chunk")))
    dealt = (postings.join(all_chunks, "list").join(blocks, "list")
             .select("vec_id", "vector", "list", dealt_to("vec_id", "chunks").alias("chunk"), each("blocks").alias("block")))
    near = queries.groupBy("list", "chunk", "block").cogroup(dealt.groupBy("list", "chunk", "block")).applyInPandas(
        _best_of_chunk(k), "query_id long, vec_id long, score double")
    best = near.distinct()
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
