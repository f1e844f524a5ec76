"""N-gram Jaccard join: which documents share THRESHOLD of their word shingles or more.

Method: MinHash with Bayesian candidate pruning. Texts are collapsed to classes of equal words; a class's MinHash bands put it in
buckets; within a bucket, pairs are compared by a few MinHash values at a time and dropped once the posterior
probability of reaching the threshold falls below TOLERANCE. The pairs that are left connect classes into candidate
components, and within a component every pair is verified exactly on its shingles.

No pair becomes a row. Buckets and components are cut into blocks of BLOCK classes; a task compares two blocks and returns a
spanning forest and the number of links of each class. A pair of similarity 0.8 shares a bucket with probability
1 - (1 - 0.8**ROWS)**BANDS = 0.999997, and is dropped by the posterior with at most about TOLERANCE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reminisce.llm.common import Hashes, by_key, components, cut, fresh, mix, shingles, words

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, BLOCK, CHUNK = 32, 5, 256, 32
#: Rows of a side up to which it is broadcast; beyond, it is joined.
BROADCAST_ROWS = 200_000

_FACTORS = np.random.default_rng(17).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def minhash(s: np.ndarray) -> np.ndarray:
    """BANDS * ROWS values of 16 bits of a set of shingles."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        least = np.minimum(least, (s[i : i + 1024, None] * _FACTORS).min(0))
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def fewest(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest that may agree): below it, the posterior of reaching the threshold is under the tolerance."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for m in range(CHUNK, BANDS * ROWS + 1, CHUNK):
        for k in range(m + 1):
            log = k * np.log(grid) + (m - k) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[grid >= threshold].sum() / density.sum() >= tolerance:
                out.append((m, k))
                break
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class (digest of the words, or of the stripped text where there are none), signature; that is null without words, and both for a blank text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                classes, signatures = [], []
                for text in part.column("text").to_pylist():
                    tokens = words(text)
                    # a stripped text without words never equals joined words
                    content = " ".join(tokens) or (text or "").strip()
                    classes.append(xxhash.xxh3_128_digest(content) if content else None)
                    signatures.append(minhash(shingles(hashes.of(tokens), SHINGLE)).tobytes() if tokens else None)
                yield pa.record_batch([part.column("doc_id"), part.column("text_hash"), pa.array(classes, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "text_hash", "class", "signature"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, class binary, signature binary")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) for each member of the components of pairs a, b of 0..n-1."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
    return [(r, i) for i in range(n) if (r := find(i)) != i]


def _tiles(df: DataFrame, key: str, size: str) -> DataFrame:
    """df, whose rows belong to groups (key, size), once for each pair of blocks that a row's block is in: columns i <= j, block."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    df = df.withColumn("block", F.pmod(F.xxhash64("class", key), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return df.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", size)


def _pairs(table: pa.Table) -> np.ndarray:
    """Which pairs of a tile's rows are its own: of two blocks those across, of one block each once."""
    block = table["block"].to_numpy()
    n = len(block)
    if table["i"][0].as_py() != table["j"][0].as_py():
        return (block[:, None] < block[None, :]) if n else np.zeros((0, 0), bool)
    return np.triu(np.ones((n, n), bool), 1)


def candidates(classes: DataFrame) -> DataFrame:
    """a, b: edges that connect all pairs of classes which share a bucket and survive the posterior."""
    width = ROWS * 2
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.col("signature").substr(b * width + 1, F.lit(width))))
    exploded = classes.select("class", F.explode(bands).alias("bucket"))
    own = F.xxhash64("class")
    buckets = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(own).alias("x"), F.sum(F.pmod(own, F.lit(1_000_003))).alias("s")).filter("n > 1")
    # buckets of the same members need comparing once
    buckets = buckets.groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members = exploded.join(buckets, "bucket").join(classes.select("class", "signature"), "class")
    limits = fewest()

    def compare(table: pa.Table) -> pa.Table:
        mine = _pairs(table)
        s = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(len(mine), -1)
        a, b = np.nonzero(mine)
        agree = np.zeros(len(a), np.int32)
        for m, k in limits:
            agree += (s[a, m - CHUNK : m] == s[b, m - CHUNK : m]).sum(1, dtype=np.int32)
            keep = agree >= k
            a, b, agree = a[keep], b[keep], agree[keep]
        names = table["class"].to_pylist()
        edges = _forest(len(names), a, b)
        return pa.table([pa.array([names[x] for x, _ in edges], pa.binary()), pa.array([names[y] for _, y in edges], pa.binary())], ["a", "b"])

    return by_key(_tiles(members, "bucket", "n"), ["bucket", "i", "j"], compare, "a binary, b binary")


def verify(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of two kinds from the components' members (class, copies, component, n, text): edges (a, b), and with a null b
    the numbers of texts and documents that a is linked to within a tile."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        kept = ["class", "copies", "component", "n"]
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                sets = [np.unique(shingles(hashes.of(words(x)), SHINGLE)).tobytes() for x in part.column("text").to_pylist()]
                yield pa.record_batch([*(part.column(c) for c in kept), pa.array(sets, pa.binary())], [*kept, "shingles"])

    members = members.mapInArrow(shingled, "class binary, copies long, component binary, n long, shingles binary")
    members = members.withColumn("key", F.xxhash64("component"))

    def exact(table: pa.Table) -> pa.Table:
        names = table["class"].to_pylist()
        once = [i for i, x in enumerate(names) if x not in names[:i]] if len(set(names)) < len(names) else range(len(names))
        table = table.take(pa.array(list(once), pa.int64()))
        names, copies = table["class"].to_pylist(), table["copies"].to_numpy()
        mine = _pairs(table)
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        n, sizes = len(sets), np.array([len(x) for x in sets])
        common = np.zeros((n, n))
        # shingles are hashes, so equal ranges of them hold about as many each; a range at a time bounds the memory
        ranges = -(-int(sizes.sum()) // 500_000)
        edges_of = [int(i * 2**64 // ranges) for i in range(1, ranges)]
        cuts = [np.r_[0, np.searchsorted(x, np.array(edges_of, np.uint64)), len(x)] for x in sets]
        for k in range(ranges):
            part = [x[c[k] : c[k + 1]] for x, c in zip(sets, cuts, strict=True)]
            _, at, times = np.unique(np.concatenate(part), return_inverse=True, return_counts=True)
            doc = np.repeat(np.arange(n), [len(x) for x in part])
            shared, number = times[at] > 1, np.cumsum(times > 1) - 1
            doc, at = doc[shared], number[at[shared]]
            order = np.argsort(at, kind="stable")
            doc, at = doc[order], at[order]
            total, width = int((times > 1).sum()), 8192
            for c in range(0, total, width):
                lo, hi = np.searchsorted(at, (c, c + width))
                held = np.zeros((n, min(width, total - c)), np.float32)
                held[doc[lo:hi], at[lo:hi] - c] = 1
                common += held @ held.T
        linked = mine & (common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9)
        a, b = np.nonzero(linked)
        either = linked | linked.T
        edges = _forest(n, a, b)
        texts, docs = either.sum(1), either @ copies
        some = np.flatnonzero(texts)
        return pa.table([
            pa.array([names[x] for x, _ in edges] + [names[i] for i in some], pa.binary()), pa.array([names[y] for _, y in edges] + [None] * len(some), pa.binary()),
            pa.array([0] * len(edges) + texts[some].tolist(), pa.int64()), pa.array([0] * len(edges) + docs[some].tolist(), pa.int64()),
        ], ["a", "b", "texts", "docs"])

    tiles = _tiles(members, "key", "n")
    return by_key(tiles.withColumnRenamed("key", "bucket").select("bucket", "i", "j", "block", "class", "copies", "shingles"), ["bucket", "i", "j"], exact, "a binary, b binary, texts long, docs long")


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: doc_id, class_id, text_id, n_links, n_texts, and text_hash and keep for one_of_each().

    class_id is the smallest doc_id of the documents connected by links of `threshold` or more, text_id that of those with
    the same words, n_links how many other documents a document is linked to (copies of its words included) and n_texts to
    how many other texts. Words are runs of letters and digits, without case; a text of fewer words than a shingle has one
    shingle. A text without words is linked to its exact copies only, white space around it aside; a blank or null one is linked to
    none and its own class. A null doc_id is no smallest id
    unless there is no other.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    sketches = cut(sketch(slim), "join-sketches")
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
    classes = sketches.filter("class is not null").groupBy("class").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("signature").alias("signature"))
    classes = cut(classes, "join-classes")
    found = components(candidates(classes.filter("signature is not null")), "join-candidates")
    sizes = cut(found.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "join-sizes")
    members = cut(found.join(sizes, "root").join(classes.drop("signature"), found["node"] == classes["class"]).select("class", "copies", F.col("root").alias("component"), "n", "first.d", "first.t"), "join-members")
    side = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    texts = slim.join(side, slim["doc_id"].eqNullSafe(F.col("d")) & (slim["text_hash"] == F.col("t"))).select("class", "copies", "component", "n", "text")
    verified = cut(verify(texts, threshold), "join-verified")
    links = verified.filter("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    groups = components(verified.filter("b is not null").select("a", "b"), "join-links").select(F.col("node").alias("class"), "root")
    leader = cut(groups.join(classes.select("class", "first"), "class").groupBy("root").agg(F.min("first").alias("leader")), "join-leaders")
    info = classes.select("class", "first", "copies").join(links, "class", "left").join(groups.join(leader, "root").select("class", "leader"), "class", "left")
    info = info.select("class", F.coalesce("leader", "first").alias("leader"), F.col("first.d").alias("text_id"), (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts"))
    # only classes of several documents or links need to be looked up
    info = info.filter("n_links > 0")
    out = sketches.drop("signature").join(info, "class", "left")
    alone = F.col("leader").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("leader.d")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("text_id")).alias("text_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), "text_hash",
        (alone | (F.col("doc_id").eqNullSafe(F.col("leader.d")) & (F.col("text_hash") == F.col("leader.t")))).alias("keep"), (~alone).alias("grouped"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class: that of the smallest doc_id; rows that repeat it go too. Columns stay as they are.

    A blank or null text is a class of its own and stays; a null doc_id stays only where its class has no other.
    """
    own, doc, which, times = fresh(docs, "own", "doc", "which", "times")
    found = cut(join(docs, threshold).filter("grouped").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(which), "keep"), "join-decided")
    gone = found.filter("not keep").select(doc, which).distinct()
    again = found.filter("keep").groupBy(doc, which).agg(F.count(F.lit(1)).alias(times)).filter(F.col(times) > 1).drop(times)
    small = found.count() <= BROADCAST_ROWS
    side = (lambda x: F.broadcast(x)) if small else (lambda x: x)
    marked = docs.withColumn(own, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(which))
    stay = marked.join(side(gone), on, "left_anti")
    if again.limit(1).count():
        stay = stay.join(side(again), on, "left_anti").unionByName(stay.join(side(again), on, "left_semi").dropDuplicates(["doc_id", own]))
    return stay.drop(own)
