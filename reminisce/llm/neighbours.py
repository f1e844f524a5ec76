"""Approximate nearest neighbours by Euclidean distance.

Method: an inverted file. Coarse centroids split the vectors into lists; residuals are coded by product quantisation;
a query probes its nearest lists, estimates distances from the codes through asymmetric tables, and ranks by the exact
distance on the original vectors until no estimate that is left, less the error of its vector's code, can beat the k-th.
Centroids and codebooks come from a bounded sample, on which the number of probes is set by measured recall; every
vector is indexed. A list is cut into blocks of bounded size, so a list that holds most vectors is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reminisce.llm.common import cut
from reminisce.llm.samples import bounded

#: Bytes of a code, and values of a byte.
PARTS, CODES = 16, 256


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, fast and approximate."""
    return (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from differences of components."""
    difference = vectors.astype(np.float64) - query.astype(np.float64)
    return np.sqrt((difference * difference).sum(1))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """k centres of the distinct rows of x, or those rows where there are no more."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = np.concatenate([squared(x[i : i + 8192], centres).argmin(1) for i in range(0, len(x), 8192)])
        sums = np.zeros(centres.shape)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class Index:
    """Coarse centroids, codebooks by part, and how many lists a query probes."""

    dim: int
    centroids: np.ndarray
    edges: list[int]
    books: list[np.ndarray]
    probes: int

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each row, nearest first."""
        return np.argsort(squared(x, self.centroids), axis=1, kind="stable")[:, :n]

    def encode(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[at]
        return np.stack([squared(rest[:, a:b], book).argmin(1) for a, b, book in zip(self.edges, self.edges[1:], self.books, strict=False)], axis=1).astype(np.uint8)

    def errors(self, x: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each vector is from what its code stands for: no distance is off its estimate by more."""
        rest = x - self.centroids[at]
        return np.sqrt(sum(((rest[:, a:b] - book[codes[:, j]]) ** 2).sum(1) for j, (a, b, book) in enumerate(zip(self.edges, self.edges[1:], self.books, strict=False))))

    def estimate(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of each query to coded vectors of a list, from one table a part."""
        rest = queries - self.centroids[at]
        total = np.zeros((len(queries), len(codes)))
        for j, (a, b, book) in enumerate(zip(self.edges, self.edges[1:], self.books, strict=False)):
            total += ((book - rest[:, None, a:b]) ** 2).sum(2)[:, codes[:, j]]
        return total


def train(vectors: DataFrame, dim: int, n: int, sample_rows: int = 20_000, max_lists: int = 4096, recall: float = 0.985, k: int = 10, seed: int = 5) -> Index:
    """The index's centroids and codebooks from those of n vectors of dim components with the smallest hashes of vec_id.

    Probes are the fewest lists that hold `recall` of the sample's true neighbours for 200 of its vectors, found by brute
    force within the sample. Lists follow the square root of the number of vectors, up to max_lists, which the sample
    bounds: it has sample_rows vectors, or 16 a list where that is more.
    """
    lists = int(np.clip(round(np.sqrt(n) / 4), 4, max_lists))
    sample = bounded(vectors, "vec_id", max(sample_rows, 16 * lists)).select("embedding").toArrow()["embedding"]
    x = np.unique(_matrix(sample, dim), axis=0)
    rng = np.random.default_rng(seed)
    centroids = kmeans(x, lists, rng)
    edges = np.unique(np.linspace(0, dim, min(PARTS, dim) + 1).astype(int)).tolist()
    at = squared(x, centroids).argmin(1)
    rest = x - centroids[at]
    books = [kmeans(rest[:, a:b], CODES, rng, 6) for a, b in zip(edges, edges[1:], strict=False)]
    index = Index(dim, centroids, edges, books, len(centroids))
    asked = rng.choice(len(x), min(200, len(x)), replace=False)
    distance = squared(x[asked], x)
    distance[np.arange(len(asked)), asked] = np.inf
    true = np.argsort(distance, axis=1)[:, : min(k, len(x) - 1)]
    order = np.argsort(index.lists(x[asked], len(centroids)), axis=1)  # the place of each list
    places = np.sort(order[np.arange(len(asked))[:, None], at[true]].ravel())
    if len(places):
        index.probes = int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) + 1
    return index


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def build(vectors: DataFrame, index: Index) -> DataFrame:
    """vec_id, list, code, the code's error and the vector itself of every vector, all of the index's dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding"), index.dim).astype(np.float64)
                at = np.concatenate([index.lists(x[i : i + 4096], 1)[:, 0] for i in range(0, len(x), 4096)])
                codes = index.encode(x, at)
                yield pa.record_batch([batch.column("vec_id"), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(index.errors(x, at, codes)), batch.column("embedding")], ["vec_id", "list", "code", "error", "embedding"])

    return vectors.mapInArrow(run, "vec_id long, list int, code binary, error double, embedding array<double>")


def search(rows: DataFrame, every: int = 100, k: int = 10, depth: int = 64, block_rows: int = 20_000, probes: int | None = None, query_rows: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, nearest first, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`; candidates all rows with another vec_id. Rows with a null
    id or an unusable vector (null, empty, zero, with null or non-finite components) take no part. Vectors of different
    dimensions have no distance: each dimension has an index of its own, and a query finds vectors of its dimension.
    A query that finds fewer than k in its nearest lists reads further ones, twice as many each time, until it has k or has
    read them all. A repeated vec_id is one candidate, at its smallest distance, and one query a dimension, by the smallest
    of its vectors. Equal vectors are estimated once, so copies never crowd out others: the k + 1 smallest ids of each
    distinct vector stay. Of each block of up to about block_rows, depth estimates are ranked exactly at first, and more until
    the rest can't be among the k nearest: within the lists that are probed the result is exact. probes is how many lists a
    query reads at first, by default as many as the sample asks for. A task holds a block and up to about query_rows of the
    queries that read it, however many a list has of either. An empty table gives none.
    """
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    # a row a dimension
    dims = {r["dim"]: r["n"] for r in vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    found = []
    for dim, n in sorted(dims.items()):
        own = vectors.filter(F.size("embedding") == dim)
        index = train(own, dim, n, k=k)
        index.probes = min(probes or index.probes, len(index.centroids))
        found.append(_found(own, index, every, k, depth, block_rows, query_rows))
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_list(numbers: list[int]) -> Column:
    """The number of a row's list."""
    return F.element_at(F.array(*map(F.lit, numbers)), F.col("list") + 1)


def _found(vectors: DataFrame, index: Index, every: int, k: int, depth: int, block_rows: int, query_rows: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest of each query in each block that it reads."""
    table = cut(build(vectors, index), "ivf")
    sizes = {r["list"]: r["n"] for r in table.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list, max_lists at most
    blocks = [max(1, -(-sizes.get(i, 0) // block_rows)) for i in range(len(index.centroids))]
    table = table.withColumn("block", F.pmod(F.xxhash64("vec_id"), _of_list(blocks)).cast("int"))
    asked = table.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    begin, end, out = 0, index.probes, None
    while True:
        found = _probed(table, asked, index, sizes, blocks, begin, end, k, depth, query_rows)
        if end >= len(index.centroids):
            return found if out is None else out.unionByName(found)
        found = cut(found, "ivf-found")
        out = found if out is None else out.unionByName(found)
        enough = out.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
        asked = cut(asked.join(enough, "vec_id", "left_anti"), "ivf-short")
        if asked.isEmpty():
            return out
        begin, end = end, min(2 * end, len(index.centroids))


def _probed(table: DataFrame, asked: DataFrame, index: Index, sizes: dict[int, int], blocks: list[int], begin: int, end: int, k: int, depth: int, query_rows: int) -> DataFrame:
    """The k nearest of each query in each block of its lists begin..end-1, the nearest list being 0."""
    some = np.zeros(len(index.centroids), bool)
    some[list(sizes)] = True

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                probes = index.lists(_matrix(part.column("embedding"), index.dim), end)[:, begin:]
                row, place = np.nonzero(some[probes])
                take = pa.array(row)
                yield pa.record_batch([part.column("vec_id").take(take), pa.array(probes[row, place].astype(np.int32)), part.column("embedding").take(take)], ["query_id", "list", "query"])

    routed = cut(asked.mapInArrow(route, "query_id long, list int, query array<double>"), "ivf-routed")
    asking = {r["list"]: r["n"] for r in routed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
    parts = [-(-asking.get(i, 0) // query_rows) for i in range(len(blocks))]
    each = lambda numbers: F.explode(F.sequence(F.lit(0), _of_list(numbers) - 1))
    # every block meets every part of the queries of its list; lists that none asks for aren't read
    candidates = table.filter(_of_list(parts) > 0).select("vec_id", "list", "code", "error", "embedding", "block", each(parts).alias("part"))
    queries = routed.select("query_id", "list", "query", each(blocks).alias("block"), F.pmod(F.xxhash64("query_id"), _of_list(parts)).cast("int").alias("part"))

    def probe(key: tuple, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if candidates.num_rows and queries.num_rows:
            ids = candidates["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _matrix(candidates["embedding"], index.dim)[order]
            codes = np.frombuffer(b"".join(candidates["code"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            # distinct vectors by their bytes, the smallest ids of each
            _, first, same = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
            group = np.argsort(same, kind="stable")
            starts = np.r_[0, np.cumsum(np.bincount(same))]
            vectors, codes, error = x[first], codes[first], candidates["error"].to_numpy()[order][first]
            asking, points = queries["query_id"].to_numpy(), _matrix(queries["query"], index.dim)
            once = len(np.unique(ids)) == len(ids)
            size = int(np.clip(2_000_000 // len(vectors), 1, 256))
            for i in range(0, len(asking), size):
                own = points[i : i + size]
                near = np.sqrt(index.estimate(own, key[0].as_py(), codes))
                # the least that each distance can be, rounding allowed for; 0 where numbers overflow
                least = np.nan_to_num(near - error - 1e-9 * (near + error) - 1e-12 * np.abs(own).max(1)[:, None], nan=0.0, posinf=0.0)
                for q, query, low in zip(asking[i : i + size].tolist(), own, least, strict=True):
                    m, d = nearest(q, query, low, vectors, ids, group, starts, once)
                    found.append((np.full(len(m), q), m, d))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    def nearest(q: int, query: np.ndarray, least: np.ndarray, vectors: np.ndarray, ids: np.ndarray, group: np.ndarray, starts: np.ndarray, once: bool) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest ids and their distances: the lowest `depth` estimates first, then all that can still be among them.

        once: whether every id is there once, so that k + 1 vectors hold k ids beside the query's own.
        """
        d, m = np.empty(0), np.empty(0, np.int64)
        first = np.argpartition(least, depth - 1)[:depth] if 0 < depth < len(least) else np.arange(len(least))
        rest: np.ndarray | None = None
        while True:
            distance = exact(query, vectors[first])
            most = d[-1] if len(m) == k else np.inf
            if once and len(first) > k + 1:
                most = min(most, np.partition(distance, k)[k])
            close = distance <= most
            members = [group[starts[b] : min(starts[b] + k + 1, starts[b + 1])] for b in first[close]]
            distance = distance[close]
            d, m = np.r_[d, np.repeat(distance, [len(y) for y in members])], np.concatenate([m, *(ids[y] for y in members)])
            d, m = d[m != q], m[m != q]
            o = np.lexsort((m, d))
            _, at = np.unique(m[o], return_index=True)  # a repeated id once, at its nearest
            o = o[np.sort(at)][:k]
            d, m = d[o], m[o]
            bound = d[-1] if len(m) == k else np.inf
            if rest is None:
                left = least <= bound
                left[first] = False
                rest = np.flatnonzero(left)
                rest = rest[np.argsort(least[rest], kind="stable")]
            rest = rest[least[rest] <= bound]
            if not len(rest):
                return m, d
            first, rest = rest[:4096], rest[4096:]

    return candidates.groupBy("list", "block", "part").cogroup(queries.groupBy("list", "block", "part")).applyInArrow(probe, "query_id long, vec_id long, score double")
