"""Fresh tails and budgets: which newest messages are protected, and which older ones fit beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reminisce.operators.streamed import carried


def _newest(key: str, order: str) -> Window:
    return Window.partitionBy(key).orderBy(F.desc(order))


def running(df: DataFrame, key: str = "conversation_id", order: str = "seq", tokens: str = "token_count") -> DataFrame:
    """df with rank (1 is the newest) and cum, the tokens from the newest to the row."""
    w = _newest(key, order)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("cum", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def listing_tail(df: DataFrame, n: int, cap: int | None = None) -> DataFrame:
    """The tail that listings show: the newest n rows within cap tokens, the newest always."""
    r = running(df)
    keep = F.col("rank") <= n
    if cap is not None:
        keep &= (F.col("rank") == 1) | (F.col("cum") <= cap)
    return r.filter(keep)


def runtime_tail(df: DataFrame, n: int, cap: int | None = None, order: str = "seq", role: str = "role") -> DataFrame:
    """df with in_tail: the newest n rows within cap tokens, the newest always, and every row from the newest user message on."""
    r = running(df, order=order)
    user = F.max(F.when(F.col(role) == "user", F.col(order))).over(Window.partitionBy("conversation_id"))
    near = F.col("rank") <= n
    if cap is not None:
        near &= (F.col("rank") == 1) | (F.col("cum") <= cap)
    return r.withColumn("in_tail", near | F.coalesce(F.col(order) >= user, F.lit(False)))


def counted_tail(df: DataFrame, n: int) -> DataFrame:
    """The newest n rows, without cap or user rule."""
    return running(df).filter(F.col("rank") <= n)


def newest_suffix(df: DataFrame, budget: int) -> DataFrame:
    """The newest rows whose tokens fit the budget; none if the newest alone exceeds it."""
    return running(df).filter(F.col("cum") <= budget)


def split_budget(df: DataFrame, budget: int, n: int, cap: int | None = None) -> DataFrame:
    """Rows of the tail, and of the others the newest that fit what the tail leaves of the budget, up to the first that doesn't."""
    t = runtime_tail(df, n, cap)
    spent = F.sum(F.when(F.col("in_tail"), F.col("token_count")).otherwise(0)).over(Window.partitionBy("conversation_id"))
    t = t.withColumn("left", F.greatest(F.lit(0), budget - spent))
    older = F.sum(F.when(F.col("in_tail"), 0).otherwise(F.col("token_count"))).over(_newest("conversation_id", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("older", older).withColumn("selected", F.col("in_tail") | (F.col("older") <= F.col("left")))


def packer(used: int | None, tokens: int, budget: int) -> tuple[int, bool]:
    """A step of a fold over items in order: each is taken where it fits what is left of the budget, and skipped otherwise."""
    used = used or 0
    fits = used + tokens <= budget
    return used + tokens if fits else used, fits


def prompt_terms(prompt: str) -> list[str]:
    """Lower-case runs of two letters or digits and more, each once."""
    import re

    return list(dict.fromkeys(re.findall(r"[a-z0-9]{2,}", prompt.lower())))


def relevance(content: Column, prompt: str) -> Column:
    """Sum over the prompt's terms of their count in the text over the text's number of terms."""
    terms = F.regexp_extract_all(F.lower(content), F.lit(r"([a-z0-9]{2,})"), F.lit(1))
    wanted = F.array(*map(F.lit, prompt_terms(prompt)))
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.filter(terms, lambda t: F.array_contains(wanted, t))) / F.size(terms))


def prompt_aware(df: DataFrame, prompt: str, budget: int, n: int) -> DataFrame:
    """Rows kept when the prompt decides: the tail, and older rows by relevance, newer first among equals, skipping what doesn't fit."""
    t = runtime_tail(df, n).withColumn("score", relevance(F.col("content"), prompt)).drop("rank", "cum")
    spent = F.sum(F.when(F.col("in_tail"), F.col("token_count")).otherwise(0)).over(Window.partitionBy("conversation_id"))
    t = t.withColumn("_left", F.greatest(F.lit(0), budget - spent).cast("long"))
    slim = t.filter("not in_tail").select("conversation_id", "message_id", "seq", "score", F.col("token_count").cast("long").alias("tokens"), "_left")
    taken = carried(slim, "conversation_id", [F.desc("score"), F.desc("seq")], ["tokens", "_left"], packer, "taken", T.BooleanType()).filter("taken").select("message_id")
    return t.filter("in_tail").unionByName(t.filter("not in_tail").join(taken, "message_id", "left_semi")).drop("_left")
