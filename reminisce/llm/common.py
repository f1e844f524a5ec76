"""What several operators share: the shared folder, tables that cut lineage, words and hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reminisce.sources.scratch import keep

_WORD = re.compile(r"\w+")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of `rows` rows at most: whole texts are long, and a batch lies in memory twice on either side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them, so that helper columns never meet a user's."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, *names: str) -> list[str]:
    """df's columns but those of these names, in any case."""
    low = {x.lower() for x in names}
    return [c for c in df.columns if c.lower() not in low]


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what follows doesn't recompute it when an executor is lost."""
    return keep(df, name)


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _WORD.findall((text or "").lower())


class Hashes(dict):
    """word -> 64-bit hash; the first `bound` of them are remembered, which holds the common ones."""

    def __init__(self, bound: int = 100_000):
        self.bound = bound

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < self.bound:
            self[word] = h
        return h

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter((self[x] for x in tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.copy()
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """The hash of every run of k words, in order; of all the words where there are fewer."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - k + 1 + i]
    return mix(out)


def by_key(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """fn(table) -> table for the rows of each key, which are brought together and streamed: a task holds one key's rows at a time."""

    def run(batches):
        import pyarrow as pa

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            first = tuple(c[0] for c in columns)
            change[0] = last is not None and first != last
            starts = [0, *np.flatnonzero(change[1:]) + 1, batch.num_rows]
            for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
                if held and (i or change[0]):
                    yield from fn(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(a, b - a))
            last = tuple(c[-1] for c in columns)
        if held:
            yield from fn(pa.Table.from_batches(held)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root of an undirected graph's edges (a, b): root is the smallest node that is connected with it.

    Large-star and small-star steps until nothing changes. Nodes are rows and never meet on the driver; a hub is
    a key of joins that split, and only its minimum is aggregated.
    """
    own = F.xxhash64("a", "b")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(own), F.sum(F.pmod(own, F.lit(2_147_483_647)))).first())
    edges = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = mark(edges)
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join below reads two exchanges of its own, and a hub's can be split
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = cut(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct(), name)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(least, "a").select(F.col("b"), F.col("m"), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        small = cut(small, name)
        # the fixed point is a star around each root, which the next steps would give again: count and digests tell
        now, edges = mark(small), small
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
