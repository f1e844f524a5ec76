"""Mixing sources to target weights with DataFrame functions alone.

Method: the sources' token shares are raised to an exponent, which is bisected until the weights meet a target
entropy or a repetition limit. The weights are realised as budgeted block permutations: every source's documents
lie in blocks by hash, each source repeats whole as often as its quota allows, and for the rest its blocks are taken in
permuted order until the quota is spent; in the block where it ends, documents are taken by hash.
Only per-source and per-block sums are shuffled, and the documents of one range of one block a source; the decision for
a document is then a function of its row and its source's, so texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reminisce.llm.common import cut, fresh, others

#: Steps of the bisection: the exponent is found to 2**-40.
STEPS = 40
#: Sources, of a few numbers each, up to which they are broadcast; beyond, they are joined.
BROADCAST_ROWS = 200_000
#: Bits of a place that tell apart the ranges of the block where a quota ends.
PARTS = 10


def _number(text: Column) -> Column:
    """60 bits of a text's md5, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """Null sources are a source of their own, apart from any text."""
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("null"))


def tokens(text: Column) -> Column:
    """Words between white space; 1 for a text without any, so that every document has weight."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^ \t\n\f\r]+"))).cast("long")


def exponent(sums: DataFrame, budget: Column, max_repetition: float | None, entropy: float | None) -> DataFrame:
    """One row: exponent, norm (sum of share ** exponent), total, budget; from the rows (key, mass) of all sources.

    Smaller exponents flatten the weights. With max_repetition, the smallest exponent in [0, 1] under which no
    source exceeds that many passes; with entropy, the one where the weights' entropy is that fraction of its
    maximum. Where the target can't be met in [0, 1] the nearer end is taken. The array has a double per source.
    """
    one = sums.agg(F.array_sort(F.collect_list("mass")).alias("masses"), F.sum("mass").alias("total"))
    one = one.filter(F.size("masses") > 0).select("total", budget.alias("budget"), F.transform("masses", lambda m: m / F.col("total")).alias("p"))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda a, p: a + f(p))

    def too_flat(x: Column) -> Column:
        norm = total(lambda p: F.pow(p, x))
        if max_repetition is not None:
            worst = F.aggregate("p", F.lit(0.0), lambda a, p: F.greatest(a, F.pow(p, x - 1)))
            return worst / norm * F.col("budget") / F.col("total") > max_repetition
        return F.log(norm) - x * total(lambda p: F.pow(p, x) * F.log(p)) / norm > entropy * F.log(F.size("p").cast("double"))

    ends = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(a: Column, _: Column) -> Column:
        middle = (a["lo"] + a["hi"]) / 2
        flat = too_flat(middle)
        return F.struct(F.when(flat, middle).otherwise(a["lo"]).alias("lo"), F.when(flat, a["hi"]).otherwise(middle).alias("hi"))

    one = one.withColumn("exponent", F.when(~too_flat(F.lit(0.0)), 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), ends, step)["hi"]))
    return one.withColumn("exponent", F.round("exponent", 9)).select("total", "budget", "exponent", F.aggregate("p", F.lit(0.0), lambda a, p: a + F.pow(p, F.col("exponent"))).alias("norm"))


def _decisions(docs: DataFrame, budget_tokens: int | None, max_repetition: float | None, entropy: float | None, blocks: int, seed: int) -> tuple[DataFrame, list[str]]:
    """docs with n_tokens, weight of its source and copies under names that docs doesn't have, and those names."""
    key, words = source_key(F.col("source")), tokens(F.col("text"))
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    block = F.pmod(_number(F.concat(F.lit(f"block-{seed}-"), name)), F.lit(blocks)).cast("int")
    place = _number(F.concat(F.lit(f"doc-{seed}-"), name))
    turn = lambda k, b: F.struct(_number(F.concat(F.lit(f"order-{seed}-"), k, F.lit("-"), b.cast("string"))).alias("order"), b.alias("block"))
    # a few numbers a document, read three times
    slim = cut(docs.select(key.alias("key"), words.alias("mass"), block.alias("block"), place.alias("place")), "mix-slim")
    block_sums = cut(slim.groupBy("key", "block").agg(F.sum("mass").alias("mass")), "mix-blocks")
    sums = block_sums.groupBy("key").agg(F.sum("mass").alias("mass"))
    budget = F.col("total").cast("double") if budget_tokens is None else F.lit(float(budget_tokens))
    one = exponent(sums, budget, max_repetition, entropy)
    weights = sums.join(F.broadcast(one)).select(
        "key", F.col("mass").alias("source_mass"), (F.pow(F.col("mass") / F.col("total"), F.col("exponent")) / F.col("norm")).alias("weight"), F.col("budget"))
    weights = weights.withColumn("quota", F.floor(F.col("weight") * F.col("budget") + 1e-6))
    weights = weights.select("key", F.round("weight", 9).alias("weight"), F.floor(F.col("quota") / F.col("source_mass")).cast("long").alias("full"), (F.col("quota") % F.col("source_mass")).cast("long").alias("rest"))
    small = F.broadcast if sums.count() <= BROADCAST_ROWS else (lambda x: x)
    # the block where a source's quota ends, and what is left of it there
    ranked = block_sums.join(small(weights), "key").withColumn("turn", turn(F.col("key"), F.col("block")))
    until = F.sum("mass").over(Window.partitionBy("key").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    ends = ranked.withColumn("left", F.col("rest") - until + F.col("mass")).filter("left < mass").groupBy("key").agg(F.min_by("left", "turn").alias("left"), F.min("turn").alias("turn"))
    ends = cut(ends.select("key", "turn", F.col("turn.block").alias("block"), "left"), "mix-ends")
    # of that block, the range of places where it ends, and within the range the last document
    inside = slim.join(small(ends.select("key", "block", "left")), ["key", "block"]).withColumn("part", F.shiftright("place", 60 - PARTS))
    until = F.sum("mass").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    parts = inside.groupBy("key", "part", "left").agg(F.sum("mass").alias("mass")).withColumn("left", F.col("left") - until + F.col("mass")).filter("left < mass")
    parts = parts.groupBy("key").agg(F.min_by("left", "part").alias("left"), F.min("part").alias("part"))
    until = F.sum("mass").over(Window.partitionBy("key").orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    last = inside.drop("left").join(small(parts), ["key", "part"]).withColumn("until", until).groupBy("key", "part").agg(F.max(F.when(F.col("until") <= F.col("left"), F.col("place"))).alias("bound"))
    last = last.select("key", F.coalesce("bound", F.shiftleft("part", 60 - PARTS) - 1).alias("bound"))
    k, w, full, end, bound, n, own, weight, copies = names = fresh(docs, "k", "w", "full", "end", "bound", "n", "own", "share", "times")
    decided = weights.join(ends.select("key", "turn"), "key", "left").join(last, "key", "left").select(F.col("key").alias(k), F.col("weight").alias(w), F.col("full").alias(full), F.col("turn").alias(end), F.col("bound").alias(bound))
    out = docs.withColumns({own: key, n: words}).join(small(cut(decided, "mix-sources")), F.col(own) == F.col(k))
    mine = turn(F.col(own), block)
    taken = F.when(F.col(end).isNull() | (mine < F.col(end)), 1).when((mine == F.col(end)) & (place <= F.col(bound)), 1).otherwise(0)
    return out.select(*docs.columns, n, F.col(w).alias(weight), (F.col(full) + taken).cast("long").alias(copies)), [n, weight, copies]


def _asked(max_repetition: float | None, entropy: float | None) -> None:
    if (max_repetition is None) == (entropy is None):
        raise ValueError("give max_repetition or entropy")


def mix(docs: DataFrame, budget_tokens: int | None = None, max_repetition: float | None = 1.25, entropy: float | None = None, blocks: int = 1024, seed: int = 7) -> DataFrame:
    """One row for each row of docs, with n_tokens, weight (its source's target) and copies.

    budget_tokens: tokens of the mixture, by default those of docs. Give max_repetition or entropy (a fraction of
    the largest). A source's copies hold at most its quota, and fall short of it by less than its next document.
    Null sources are one source; null and empty texts count as one token; rows that repeat a doc_id share its place in
    the permutation, so they are taken together. Columns of docs stay, but those named as the new ones, which are
    replaced; an empty table gives an empty one.
    """
    _asked(max_repetition, entropy)
    new = ("n_tokens", "weight", "copies")
    out, names = _decisions(docs, budget_tokens, max_repetition, entropy, blocks, seed)
    return out.select(*others(docs, *new), *(F.col(a).alias(b) for a, b in zip(names, new, strict=True)))


def mixture(docs: DataFrame, budget_tokens: int | None = None, max_repetition: float | None = 1.25, entropy: float | None = None, blocks: int = 1024, seed: int = 7) -> DataFrame:
    """The mixture itself: each row of docs as many times as mix() would say, with all columns of docs and no others."""
    _asked(max_repetition, entropy)
    out, (_, _, copies) = _decisions(docs, budget_tokens, max_repetition, entropy, blocks, seed)
    (each,) = fresh(out, "each")
    return out.filter(F.col(copies) > 0).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def realise(mixed: DataFrame) -> DataFrame:
    """Each row of what mix() gave as many times as its copies say, without the columns that mix() added."""
    columns, (each,) = others(mixed, "n_tokens", "weight", "copies"), fresh(mixed, "each")
    return mixed.filter("copies > 0").withColumn(each, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)


#: The same in DuckDB, with the query's parameters.
SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s:' || source, 'null') AS key, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\f\\r]+'))) AS mass,
    ('0x' || substr(md5('block-7-' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % 1024 AS block,
    ('0x' || substr(md5('doc-7-' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS place
  FROM documents),
b AS (SELECT key, block, sum(mass)::BIGINT AS mass FROM d GROUP BY ALL),
s AS (SELECT key, sum(mass)::BIGINT AS mass FROM b GROUP BY key),
o AS (SELECT list_sort(list(mass / t)) AS p, any_value(t) AS total FROM s, (SELECT sum(mass)::DOUBLE AS t FROM s)),
x AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN f THEN m ELSE lo END, CASE WHEN f THEN hi ELSE m END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS m, list_max(list_transform(p, lambda q: pow(q, (lo + hi) / 2 - 1))) / list_sum(list_transform(p, lambda q: pow(q, (lo + hi) / 2))) > 1.25 AS f FROM x, o) WHERE i < 40),
e AS (SELECT round(CASE WHEN list_max(list_transform(p, lambda q: pow(q, -1))) / len(p) <= 1.25 THEN 0.0 ELSE (SELECT hi FROM x WHERE i = 40) END, 9) AS a, p, total FROM o),
w AS (SELECT key, mass AS source_mass, weight, floor(weight * total + 1e-6)::BIGINT AS quota FROM (SELECT key, mass, total, pow(mass / total, a) / list_sum(list_transform(p, lambda q: pow(q, a))) AS weight FROM s, e)),
r AS (SELECT b.key, b.block, weight, quota // source_mass AS full_, quota % source_mass AS rest, mass,
    sum(mass) OVER (PARTITION BY b.key ORDER BY ('0x' || substr(md5('order-7-' || b.key || '-' || b.block), 1, 15))::BIGINT, b.block ROWS UNBOUNDED PRECEDING) AS until
  FROM b JOIN w USING (key)),
c AS (SELECT d.*, weight, full_, rest, until, until - r.mass AS before,
    sum(d.mass) OVER (PARTITION BY d.key, d.block ORDER BY place RANGE UNBOUNDED PRECEDING) AS within
  FROM d JOIN r USING (key, block))
SELECT doc_id, source, mass::BIGINT AS n_tokens, round(weight, 9) AS weight, (full_ + CASE WHEN until <= rest OR (before < rest AND before + within <= rest) THEN 1 ELSE 0 END)::BIGINT AS copies FROM c
"""
