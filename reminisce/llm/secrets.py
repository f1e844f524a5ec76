"""Secret scans with DataFrame functions alone: three patterns, and strings that a Markov model finds random.

Method: two first-order character models, one of random strings and one of ordinary identifiers, are trained
from labelled samples; a long token is reported where the log-likelihood ratio of the two is high.
Scanning is a map over rows: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reminisce.llm.samples import bounded

#: The patterns of the base scan, and the least length of what each must hold.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")

#: Characters that the Markov models tell apart; long runs of them are their tokens.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1
TOKEN, SHORTEST = r"[A-Za-z0-9+/_=-]", 16


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """join over the values up to each, by doubling steps: the array is copied once for each binary digit of its size."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1.0)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, values, lambda a, n: F.transform(a, lambda x, i: F.coalesce(join(x, F.get(a, i - n)), x)))


def _with_positions(df: DataFrame, patterns: dict[str, tuple[str, int]]) -> DataFrame:
    """df (with the column text) with array<struct<s, e, v>> for each name of a pattern and group: begin and end of each match in code points, and the group.

    split() gives what lies between the matches, so a match ends after the sum of the gaps and matches up to it. Each step
    is a projection of its own, as its arrays are used several times.
    """
    names = list(patterns)
    inside = lambda p, x: F.when(F.col("text").rlike(p), x).otherwise(F.array().cast("array<string>"))
    raw = df.select("*", *(inside(p, F.split("text", p, -1)).alias(f"{k}_gaps") for k, (p, _) in patterns.items()), *(inside(p, F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))).alias(f"{k}_hits") for k, (p, _) in patterns.items()))
    sized = raw.select(*df.columns, *(F.transform(F.arrays_zip(F.slice(f"{k}_gaps", 1, F.size(f"{k}_hits")).alias("g"), F.col(f"{k}_hits").alias("m")), lambda x: F.struct((F.length(x["g"]) + F.length(x["m"])).cast("long").alias("t"), F.length(x["m"]).cast("long").alias("n"), x["m"].alias("m"))).alias(k) for k in names))
    ends = sized.select("*", *(_running(F.transform(k, lambda x: x["t"]), lambda x, y: x + y).alias(f"{k}_ends") for k in names))
    value = lambda k, m: F.regexp_extract(m, *patterns[k]) if patterns[k][1] else m
    made = lambda k: F.transform(F.arrays_zip(F.col(k).alias("x"), F.col(f"{k}_ends").alias("e")), lambda z: F.struct((z["e"] - z["x"]["n"]).alias("s"), z["e"].alias("e"), value(k, z["x"]["m"]).alias("v")))
    return ends.select(*df.columns, *(made(k).alias(k) for k in names))


def _span(kind: str):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"))


#: name -> pattern and group. A match that falls short is dropped, not searched again: runs of hex digits are maximal, as are those
#: that follow the first AKIA of a run, so asking for the least length within the pattern drops the same ones.
BASE = {"assign": (ASSIGN, 2), "access": (f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", 0), "hex": (f"[0-9a-f]{{{LEAST['hex']},}}", 0)}


def _with_base(df: DataFrame, more: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """df with the spans of the three patterns, and of more."""
    return _with_positions(df, BASE | (more or {})).withColumn("assign", F.filter("assign", lambda x: F.length(x["v"]) >= LEAST["assign"]))


def _generated(spark: SparkSession, n: int) -> DataFrame:
    """Random strings, labelled so: hexadecimal, base64 and upper-case forms of digests of 1 to n."""
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    coded = F.base64(F.unhex(digest))
    return spark.range(n).select(F.explode(F.array(F.substring(digest, 1, 40), F.substring(coded, 1, 40), F.upper(F.substring(F.regexp_replace(coded, "[+/=]", ""), 1, 20)))).alias("token"), F.lit(1).alias("random"))


def train(docs: DataFrame, sample_docs: int = 1000, generated: int = 2000, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of each character after each other, random against ordinary: SIZE x SIZE, rounded.

    Labelled samples: what the patterns match in a sample of documents and generated strings are random, all other
    words of the sample ordinary. sample_docs bounds the sample: the documents of the smallest hashes of doc_id.
    The counts that reach the driver are SIZE x SIZE x 2 at most.
    """
    spark = docs.sparkSession
    sample = bounded(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "doc_id", sample_docs)
    value = lambda x: x["v"]
    sample = _with_base(sample.select("text")).select("text", F.concat(*(F.transform(k, value) for k in BASE)).alias("found"))
    labelled = sample.select(F.explode("found").alias("token"), F.lit(1).alias("random"))
    ordinary = sample.select(F.explode(F.array_except(F.regexp_extract_all("text", F.lit(f"({TOKEN}{{2,}})"), F.lit(1)), F.col("found"))).alias("token"), F.lit(0).alias("random"))
    tokens = labelled.unionByName(_generated(spark, generated)).unionByName(ordinary)
    pairs = tokens.filter(F.length("token") >= 2).select("random", "token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i")).select("random", F.instr(F.lit(ALPHABET), F.col("token").substr(F.col("i"), F.lit(1))).alias("a"), F.instr(F.lit(ALPHABET), F.col("token").substr(F.col("i") + 1, F.lit(1))).alias("b"))
    counts = {(r["random"], r["a"], r["b"]): r["n"] for r in pairs.groupBy("random", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = []
    for a in range(SIZE):
        totals = [sum(counts.get((y, a, b), 0) for b in range(SIZE)) + smoothing * SIZE for y in (0, 1)]
        for b in range(SIZE):
            ordinary_p, random_p = ((counts.get((y, a, b), 0) + smoothing) / totals[y] for y in (0, 1))
            model.append(round(math.log(random_p / ordinary_p), 4))
    return model


def unlikely(tokens: Column, model: list[float], least: float, mean: float) -> Column:
    """Those of array<struct<s, e, v>> whose summed ratio is at least `least` and `mean` a character."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    place = lambda token, i: F.instr(F.lit(ALPHABET), token.substr(i, F.lit(1)))
    score = lambda token: F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda total, i: total + F.element_at(table, place(token, i) * SIZE + place(token, i + 1) + 1))
    return F.filter(tokens, lambda x: score(x["v"]) >= F.greatest(F.lit(float(least)), F.length(x["v"]) * mean))


def scan(docs: DataFrame, model: list[float], least: float = 12.0, mean: float = 0.6) -> DataFrame:
    """A row for each row of docs: doc_id, counts and digest of the base spans, and all spans.

    spans are kind:start:end in code points, end exclusive, by start and then kind. A null text counts as empty, and
    a row without spans has an empty string. A Markov span that overlaps a base span isn't added. Repeated rows
    give repeated rows, an empty table an empty one; whole texts are read, other columns aren't. The arrays held for one
    row grow with that row's matches alone, and the time with their number and its binary digits.
    """
    df = _with_base(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), {"tokens": (f"{TOKEN}{{{SHORTEST},}}", 0)})
    df = df.select("doc_id", *BASE, F.array_sort(F.concat(*(F.transform(F.col(k), _span(k)) for k in BASE))).alias("base"), unlikely(F.col("tokens"), model, least, mean).alias("tokens"))
    # base spans at their begins and tokens at their ends, in order: the largest end so far tells if one reaches into a token
    event = lambda at, side, s, e: F.struct(at.alias("at"), F.lit(side).alias("side"), s.alias("s"), e.alias("e"))
    zero = F.lit(0).cast("long")
    df = df.withColumn("events", F.array_sort(F.concat(F.transform("tokens", lambda x: event(x["e"], 0, x["s"], zero)), F.transform("base", lambda y: event(y["s"], 1, zero, y["e"])))))
    df = df.withColumn("reach", F.when(F.size("tokens") > 0, _running(F.transform("events", lambda x: x["e"]), lambda x, y: F.greatest(x, y))).otherwise(F.array().cast("array<bigint>")))
    clear = F.filter(F.arrays_zip("events", "reach"), lambda z: (z["events"]["side"] == 0) & (z["reach"] <= z["events"]["s"]))
    found = F.transform(clear, lambda z: F.struct(z["events"]["s"].alias("s"), F.lit(KINDS.index("markov")).alias("k"), z["events"]["at"].alias("e")))
    df = df.withColumn("every", F.when(F.size("tokens") > 0, F.array_sort(F.concat("base", found))).otherwise(F.col("base")))
    names = F.array(*map(F.lit, KINDS))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")
    return df.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(said("base"), 256).alias("base_sha256"), said("every").alias("spans"))
