"""Search over messages, summaries and files: substrings, regular expressions, ranked full text, languages without spaces."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, reduce
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reminisce.functions.text import fallback_snippet
from reminisce.plans.search import cjk_groups, has_cjk, like_terms, phrases, safe_pattern

#: Terms of a text as the index has them: runs of letters and digits, without case and accents.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
K1, B = 1.2, 0.75


@cache
def folding() -> tuple[str, str]:
    """(letters, what each becomes): accented Latin, Greek and Cyrillic letters without their marks; marks beyond the second's end go."""
    letters = {}
    for i in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        base = unicodedata.normalize("NFD", chr(i).lower())
        plain = "".join(c for c in base if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(i).lower():
            letters[chr(i).lower()] = plain
    marks = "".join(chr(i) for i in range(0x300, 0x370) if unicodedata.combining(chr(i)))
    letters = {k: v for k, v in letters.items() if len(k) == 1}
    return "".join(letters) + marks, "".join(letters.values())


def fold(text: Column) -> Column:
    """Lower case without accents, as fold_text() has it."""
    return F.translate(F.lower(text), *folding())


def fold_text(text: str) -> str:
    """Lower case without accents: the same table as for columns, so that query and text agree."""
    letters, plain = folding()
    return text.lower().translate({ord(c): plain[i] if i < len(plain) else None for i, c in enumerate(letters)})


def compiles(df: DataFrame, pattern: str) -> bool:
    """Whether the engine that will run the pattern takes it."""
    try:
        df.sparkSession.range(1).select(F.lit("").rlike(pattern)).collect()
    except Exception as e:  # the engine's own error, whose class differs between kinds of sessions
        if "REGEX" not in str(e).upper() and "PATTERN" not in str(e).upper():
            raise
        return False
    return True


def terms(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(f"({TOKEN})"), F.lit(1))


def like(df: DataFrame, query: str, limit: int | None = 50, text: str = "content", time: str = "created_at", key: str = "message_id") -> DataFrame:
    """Rows that hold every term as a substring, without case; the newest first, with snippets."""
    wanted = like_terms(query)
    if not wanted:
        return df.limit(0).withColumn("snippet", F.lit(""))
    out = df.filter(reduce(lambda a, b: a & b, [F.lower(text).contains(t) for t in wanted])).withColumn("snippet", fallback_snippet(F.col(text), wanted))
    return out if limit is None else out.orderBy(F.desc(time), F.desc(key)).limit(limit)


def cjk(df: DataFrame, query: str, limit: int | None = 50, size: int = 2, text: str = "content", time: str = "created_at", key: str = "summary_id") -> DataFrame:
    """Rows that hold one piece of each CJK segment, and every other word."""
    groups, others = cjk_groups(query, size)
    low = F.lower(text)
    tests = [reduce(lambda a, b: a | b, [low.contains(p) for p in g]) for g in groups] + [low.contains(w) for w in others]
    if not tests:
        return df.limit(0).withColumn("snippet", F.lit(""))
    out = df.filter(reduce(lambda a, b: a & b, tests)).withColumn("snippet", fallback_snippet(F.col(text), [p for g in groups for p in g] + others))
    return out if limit is None else out.orderBy(F.desc(time), F.desc(key)).limit(limit)


def regex(df: DataFrame, pattern: str, limit: int | None = 50, scanned: int | None = None, text: str = "content", time: str = "created_at", key: str = "message_id") -> DataFrame:
    """Rows that match a pattern that passes the guard, the newest first, with the match. scanned bounds how many of the newest rows are read."""
    if safe_pattern(pattern) is None or not compiles(df, pattern):
        return df.limit(0).withColumn("snippet", F.lit(""))
    if scanned is not None:
        df = df.orderBy(F.desc(time), F.desc(key)).limit(scanned)
    out = df.filter(F.col(text).rlike(pattern)).withColumn("snippet", F.regexp_extract(text, f"({pattern})", 1))
    return out if limit is None else out.orderBy(F.desc(time), F.desc(key)).limit(limit)


def _frequency(phrase: list[str]) -> Column:
    """How often the terms in column _t hold a phrase of one term or more."""
    if len(phrase) == 1:
        return F.size(F.filter("_t", lambda x: x == phrase[0]))
    n, wanted = len(phrase), F.array(*map(F.lit, phrase))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_t") - n + 1, F.lit(1)))
    return F.size(F.filter(starts, lambda j: F.slice("_t", j, F.lit(n)) == wanted))


def bm25(df: DataFrame, query: str, key: str = "message_id", text: str = "content", stem: bool = False) -> DataFrame:
    """df's rows that hold every phrase of the query, with rank: lower is better, as BM25 negated.

    Frequencies are of phrases; lengths are in terms. The corpus gives two sums and a count for each phrase, so only
    one row is broadcast back.
    """
    split = [[x for x in _fold_py(p)] for p in phrases(query)]
    split = [p for p in split if p]
    if not split:
        return df.limit(0).withColumn("rank", F.lit(0.0))
    words = terms(F.col(text))
    if stem:
        words, split = porter_terms(F.col(text)), [[porter(w) for w in p] for p in split]
    t = df.withColumn("_t", words)
    for i, p in enumerate(split):
        t = t.withColumn(f"_f{i}", _frequency(p))
    t = t.withColumn("_n", F.size("_t")).drop("_t")
    total = t.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_mean"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(split))))
    hits = t.filter(reduce(lambda a, b: a & b, [F.col(f"_f{i}") > 0 for i in range(len(split))])).join(F.broadcast(total))
    rank = F.lit(0.0)
    for i in range(len(split)):
        idf = F.greatest(F.log((F.col("_docs") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5)), F.lit(1e-6))
        f = F.col(f"_f{i}")
        rank = rank - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.col("_mean")))
    return hits.withColumn("rank", rank).select(*df.columns, "rank")


def ordered(df: DataFrame, sort: str, as_of: str, limit: int, time: str = "created_at", key: str = "message_id") -> DataFrame:
    """The best rows by recency, relevance, or hybrid: rank divided by one plus a thousandth of the age in hours."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(time)) / 3.6e9
    df = df.withColumn("hybrid", F.col("rank") / (1 + age * 0.001))
    order = {"recency": [F.desc(time)], "relevance": [F.asc("rank"), F.desc(time)], "hybrid": [F.asc("hybrid"), F.desc(time)]}[sort]
    return df.orderBy(*order, F.desc(key)).limit(limit)


def search(df: DataFrame, query: str, mode: str = "full_text", sort: str = "recency", as_of: str = "2024-02-01 00:00:00", limit: int = 50) -> DataFrame:
    """Rows by the strategy that suits the query: regular expression, CJK substrings or ranked full text."""
    if mode == "regex":
        return regex(df, query, limit)
    if has_cjk(query):
        return cjk(df, query, limit, key="message_id")
    return ordered(bm25(df, query), sort, as_of, limit)


def _fold_py(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold_text(text))


def _vowels(word: str) -> list[bool]:
    """Of each letter whether it is a vowel; y is one after a consonant."""
    out: list[bool] = []
    for c in word:
        out.append(c in "aeiou" or c == "y" and bool(out) and not out[-1])
    return out


def porter(word: str) -> str:
    """The stem of an English word by Porter's published rules; words of other letters or more than 64 stay as they are."""
    if not 3 <= len(word) <= 64 or not word.isascii():
        return word
    measure = lambda w: sum(a and not b for a, b in pairwise(_vowels(w)))
    has_vowel = lambda w: any(_vowels(w))
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and not _vowels(w)[-1]
    cvc = lambda w: len(w) > 2 and _vowels(w)[-3:] == [False, True, False] and w[-1] not in "wxy"

    def swap(w: str, rules: list[tuple[str, str]], least: int) -> str:
        for end, new in rules:
            if w.endswith(end):
                return w[: -len(end)] + new if measure(w[: -len(end)]) > least else w
        return w

    w = word
    w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1] if w.endswith("s") and not w.endswith("ss") else w
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # fixed values: the suffixes of Porter's steps 2, 3 and 4
    w = swap(w, [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")], 0)
    w = swap(w, [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")], 0)
    if w.endswith("ion") and len(w) > 3 and w[-4] in "st":
        w = w[:-3] if measure(w[:-3]) > 1 else w
    else:
        w = swap(w, [(x, "") for x in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")], 1)
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if measure(w) > 1 and double(w) and w[-1] == "l" else w


def porter_terms(text: Column) -> Column:
    """Stemmed terms of a text; stemming has no built-in function, so this is a vectorised Python function."""

    @F.pandas_udf("array<string>")
    def stems(found: pd.Series) -> pd.Series:
        memo: dict[str, str] = {}
        return found.map(lambda xs: [memo[x] if x in memo else memo.setdefault(x, porter(x)) for x in xs])

    return stems(terms(text))


def text_like(mime: Column) -> Column:
    """Whether a MIME type is of text; null counts as text."""
    low = F.lower(mime)
    tests = [low.startswith("text/")] + [low.contains(x) for x in ("json", "javascript", "xml", "yaml", "yml", "toml")]
    return mime.isNull() | reduce(lambda a, b: a | b, tests)


def index_text(content: Column, prefixes: tuple[str, ...] = ("[File:", "[Tool Output:"), hints: tuple[str, ...] = ("Use ", "Call ")) -> Column:
    """What is indexed of a message: all, but of a reference to a stored file its header and its exploration summary, without hint lines; null for blank."""
    trimmed = F.trim(content)
    lines = F.filter(F.transform(F.split(trimmed, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    at = F.array_position(lines, "Exploration Summary:")
    summary = F.filter(F.when(at > 0, F.slice(lines, at.cast("int") + 1, F.greatest(F.size(lines), F.lit(1)))).otherwise(F.array().cast("array<string>")), lambda x: ~reduce(lambda a, b: a | b, [x.startswith(h) for h in hints]) & (x != "Exploration Summary:"))
    stored = reduce(lambda a, b: a | b, [trimmed.startswith(p) for p in prefixes])
    return F.when(trimmed == "", F.lit(None)).when(stored, F.array_join(F.concat(F.slice(lines, 1, 1), summary), "\n")).otherwise(content)


def file_matches(files: DataFrame, pattern: str, prefix_bytes: int | None = None, per_file: int | None = 10, around: int = 80) -> DataFrame:
    """file_id, match, line, byte_offset, snippet: the first matches of each text file, as positions in UTF-8.

    Whole texts are searched, or their first prefix_bytes. per_file is a limit of the report;
    None gives every match.
    """
    schema = "file_id string, place long, match string, line long, byte_offset long, snippet string"
    try:
        re.compile(pattern)
    except re.error:
        return files.sparkSession.createDataFrame([], schema)
    if safe_pattern(pattern) is None:
        return files.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = re.compile(pattern)
        for batch in batches:
            out = []
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                text = content or ""
                if prefix_bytes is not None:
                    text = text.encode()[:prefix_bytes].decode("utf-8", "ignore")
                for k, m in enumerate(compiled.finditer(text)):
                    if per_file is not None and k >= per_file:
                        break
                    a, b = max(0, m.start() - around), min(len(text), m.end() + around)
                    out.append((file_id, k, m[0], text.count("\n", 0, m.start()) + 1, len(text[: m.start()].encode()), ("..." if a else "") + text[a:b] + ("..." if b < len(text) else "")))
            yield pd.DataFrame(out, columns=["file_id", "place", "match", "line", "byte_offset", "snippet"])

    return files.filter(text_like(F.col("mime_type"))).select("file_id", "content").mapInPandas(run, schema)


def capped(df: DataFrame, order: list[Column], chars: int = 40_000, text: str = "snippet") -> DataFrame:
    """The first rows of a report whose text stays within so many characters in all."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # of a report's rows, which a limit bounds
    return df.withColumn("_c", F.sum(F.length(text)).over(w)).filter(F.col("_c") <= chars).drop("_c")


def covers(summary: Column, message: Column) -> Column:
    """Whether a summary repeats a message of 24 characters or more: white space aside, as its beginning or end, or between quotes."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    s, m = flat(summary), flat(message)
    return (F.length(m) >= 24) & (s.startswith(m) | s.endswith(m) | s.contains(F.concat(F.lit('"'), m, F.lit('"'))))
