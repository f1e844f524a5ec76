"""How an incoming batch continues what is stored: overlaps of identities, found in time that follows the rows compared.

A task holds one conversation's batch and as many of its newest stored rows, never its whole history.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap(first: list, then: list) -> int:
    """The largest k such that the last k of first are the first k of then, by the borders of then."""
    border = [0] * len(then)
    k = 0
    for i in range(1, len(then)):
        while k and then[i] != then[k]:
            k = border[k - 1]
        k += then[i] == then[k]
        border[i] = k
    k = 0
    for x in first[max(0, len(first) - len(then)) :]:
        while k and (k == len(then) or x != then[k]):
            k = border[k - 1]
        k += bool(then) and x == then[k]
    return k


def matched_until(batch: list, stored: list) -> int:
    """The rows of the batch up to the last place where it and the stored rows, read backwards, agree as far as both go; 0 for none.

    A single row that ends the batch is no proof, as a turn may be said twice.
    """
    # the length of agreement of every place of the reversed batch with the reversed stored rows
    pattern, text = stored[::-1], batch[::-1]
    both, n = [*pattern, object(), *text], len(pattern)
    z, a, b = [0] * len(both), 0, 0
    for i in range(1, len(both)):
        if i < b:
            z[i] = min(b - i, z[i - a])
        while i + z[i] < len(both) and both[z[i]] == both[i + z[i]]:
            z[i] += 1
        if i + z[i] > b:
            a, b = i, i + z[i]
    for i in range(len(text)):
        length = min(len(text) - i, n)
        if n and z[n + 1 + i] >= length and (i or length > 1):
            return len(text) - i
    return 0


def _paired(batch: DataFrame, stored: DataFrame, decide: Callable[[list, list], int], name: str) -> DataFrame:
    """conversation_id and decide(batch's identities, as many newest stored ones), in order of seq, for each conversation of the batch."""
    sizes = batch.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("_n"))
    newest = stored.select("conversation_id", "seq", "identity_hash").withColumn("_r", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("seq"))))
    newest = newest.join(sizes, "conversation_id").filter("_r <= _n").select("conversation_id", "seq", "identity_hash")

    def one(key: tuple, given: pa.Table, held: pa.Table) -> pa.Table:
        a, b = (t.sort_by("seq")["identity_hash"].to_pylist() for t in (given, held))
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([decide(a, b)], pa.int64())], ["conversation_id", name])

    # under names of their own, as both may come from one table
    own = lambda df: df.select(*(F.col(c).alias(c) for c in ("conversation_id", "seq", "identity_hash")))
    both = own(batch).groupBy("conversation_id").cogroup(own(newest).groupBy("conversation_id"))
    return both.applyInArrow(one, f"conversation_id long, {name} long")


def align(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """conversation_id, covered: the largest k such that the stored messages' last k equal the batch's first k."""
    return _paired(batch, stored, lambda given, held: overlap(held, given), "covered")


def new_rows(batch: DataFrame, stored: DataFrame, without_overlap: str = "ingest") -> DataFrame:
    """The batch's rows that follow what is stored. A batch that is the stored tail has none.

    Elsewhere the last place counts where batch and stored rows agree backwards as far as both go. Without any overlap the
    whole batch is new, or, with "skip", nothing is, for callers who have a stronger proof of what is new.
    """
    if without_overlap not in ("ingest", "skip"):
        raise ValueError("without_overlap is ingest or skip")
    until = _paired(batch, stored, lambda given, held: len(given) if given == held else matched_until(given, held), "until")
    some = stored.select("conversation_id").distinct().withColumn("some", F.lit(True))
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy("seq"))
    j = batch.withColumn("_p", place).join(until, "conversation_id").join(some, "conversation_id", "left")
    if without_overlap == "skip":
        j = j.filter(F.col("some").isNull() | (F.col("until") > 0))
    return j.filter(F.col("_p") > F.col("until")).select(*batch.columns)


def without_known_ids(batch: DataFrame, stored: DataFrame, ids: str = "raw_ids") -> DataFrame:
    """The batch's rows but those all of whose raw ids (an array) are stored in their conversation; rows without ids stay."""
    known = stored.select("conversation_id", F.explode(ids).alias("_id")).distinct().withColumn("_known", F.lit(True))
    held = batch.select("conversation_id", "seq", F.explode(ids).alias("_id")).join(known, ["conversation_id", "_id"], "left")
    replayed = held.groupBy("conversation_id", "seq").agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("all")).filter("all").drop("all")
    return batch.join(replayed, ["conversation_id", "seq"], "left_anti").select(*batch.columns)


def replayed_prefix(batch: DataFrame, bootstrapped: DataFrame) -> DataFrame:
    """The batch's rows after its leading ones that bootstrap stored: those up to the first whose identity is new go."""
    known = bootstrapped.select("conversation_id", "identity_hash").distinct().withColumn("_known", F.lit(True))
    j = batch.join(known, ["conversation_id", "identity_hash"], "left")
    first = j.filter("_known is null").groupBy("conversation_id").agg(F.min("seq").alias("_first"))
    return j.join(first, "conversation_id").filter(F.col("seq") >= F.col("_first")).select(*batch.columns)
