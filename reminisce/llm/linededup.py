"""Line dedup: passages that stand elsewhere before are deleted, wherever in a line they begin and end, or as whole lines.

passages() is winnowing over words. Every run of MIN_WORDS words is a window, and the smallest hash of the short runs in it is
its print, so equal windows have equal prints. Prints that occur once are dropped, by a bitmap of fixed size that may let
others through. Neighbouring windows of one print are a row; rows of the same content are later copies of the first of
them as a whole, and only the firsts of a print with several contents are compared window by window.

dedup() takes whole lines only: winnowing over line hashes. A window is a run of lines just long enough to hold MIN_WORDS words; the smallest line
hash of each window is a fingerprint, so any repeated run of that many words has a fingerprint in common with its
earlier copy, wherever it begins. Fingerprints that occur once in all texts are dropped. At the others' positions the
match is extended both ways: the windows around them, grown forwards and backwards, are compared by content, and those
that stand elsewhere before are deleted; together they cover each repeated run from its first line to its last.
An occurrence is compared with the first one of its content alone, never with all others, so a passage in every
document gives a row for each of its occurrences and not for each pair.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reminisce.llm.common import cut, fresh, mix, others

MIN_WORDS = 50
#: Bits of the bitmap of prints that occur more than once, and of each of the pieces it is made in.
BITMAP, PIECE = 26, 12

_FOUND = "doc_id long, text_hash long, print long, windows array<struct<hash:long,first:int,last:int>>"


def fingerprints(text: str, least: int = MIN_WORDS) -> dict[int, list[tuple[int, int, int]]]:
    """print -> the windows it was chosen for, as (hash of the content, first line, last line).

    Lines are compared without case and spacing, and those without words are passed over. Each window is that of its
    first line, grown forwards; with it comes the one that ends where it ends, grown backwards, if that is another.
    """
    numbers, sizes, hashes = [], [], []
    for i, line in enumerate(text.split("\n")):
        tokens = line.split()
        if tokens:
            numbers.append(i)
            sizes.append(len(tokens))
            hashes.append(xxhash.xxh64_intdigest(" ".join(tokens).lower()))
    n = len(numbers)
    until = np.r_[0, np.cumsum(sizes)]
    if not n or until[-1] < least:
        return {}
    raw = np.array(hashes, np.uint64).tobytes()
    ends = np.searchsorted(until, until[:-1] + least, "left")  # the line after each forward window
    begins = np.searchsorted(until, until[1:] - least, "right") - 1  # the first line of each backward window
    out: dict[int, list[tuple[int, int, int]]] = {}

    def add(own: int, a: int, b: int) -> None:
        content = xxhash.xxh64_intdigest(raw[a * 8 : b * 8], seed=b - a)
        out.setdefault(own, []).append((content, numbers[a], numbers[b - 1]))

    smallest: dict[int, int] = {}
    least_at = -1
    for a in range(n):
        b = int(ends[a])
        if b > n:
            break
        # the rightmost smallest hash of the window, kept while it stays inside
        if least_at < a:
            least_at = a
            for i in range(a + 1, b):
                if hashes[i] <= hashes[least_at]:
                    least_at = i
        else:
            for i in range(int(ends[a - 1]) if a else a + 1, b):
                if hashes[i] <= hashes[least_at]:
                    least_at = i
        smallest[a] = hashes[least_at]
        add(hashes[least_at], a, b)
    for b in range(1, n + 1):
        a = int(begins[b - 1])
        if a >= 0 and int(ends[a]) != b:
            add(smallest[a], a, b)
    return out


def _prints(docs: DataFrame, least: int) -> DataFrame:
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows, prints, offsets, content, first, last = [], [], [0], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    for own, windows in fingerprints(text, least).items():
                        rows.append(i)
                        prints.append(own)
                        for h, a, b in windows:
                            content.append(h)
                            first.append(a)
                            last.append(b)
                        offsets.append(len(content))
                take = pa.array(rows, pa.int64())
                structs = pa.StructArray.from_arrays([pa.array(np.array(content, np.uint64).view(np.int64)), pa.array(first, pa.int32()), pa.array(last, pa.int32())], fields=list(kind.value_type))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
                yield pa.record_batch([part.column("doc_id").take(take), part.column("text_hash").take(take), pa.array(np.array(prints, np.uint64).view(np.int64)), lists], ["doc_id", "text_hash", "print", "windows"])

    return docs.mapInArrow(run, _FOUND)


def repeated(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, spans: the lines (first, last) of each document's windows that stand elsewhere before."""
    found = _prints(docs, least)
    shared = found.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("windows")).alias("w")).filter("n > 1 or w > 1").select("print")
    windows = found.join(shared, "print").select("doc_id", "text_hash", "print", F.explode("windows").alias("x"))
    windows = windows.select("doc_id", "text_hash", "print", "x.*")
    # documents in the order of their ids, null last; equal ids by text
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("first").alias("f"), F.col("last").alias("l"))
    firsts = windows.groupBy("print", "hash").agg(F.min(place).alias("o"), F.max(place).alias("p")).filter("o != p").select("print", "hash", "o")
    later = windows.join(firsts, ["print", "hash"])
    same = F.col("doc_id").eqNullSafe(F.col("o.d")) & (F.col("text_hash") == F.col("o.t"))
    later = later.filter(~same | (F.col("first") > F.col("o.l")))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def remove(text: str, spans: Sequence[tuple[int, int]]) -> str:
    """The text without the lines of the spans."""
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, int)
    for a, b in spans:
        gone[a] += 1
        gone[b + 1] -= 1
    gone = np.cumsum(gone)[: len(lines)]
    return "\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g)


_FACTOR = 0x9E3779B97F4A7C15


class Rolling:
    """Hashes of runs of words, and of words as runs of bytes, from prefix sums; tables of powers grow with the longest input."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        if n >= len(self.up):
            power = lambda f: np.r_[np.uint64(1), np.cumprod(np.full(2 * n, f, np.uint64), dtype=np.uint64)]
            self.up, self.down = power(np.uint64(_FACTOR)), power(np.uint64(pow(_FACTOR, -1, 2**64)))
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(x * self.down[:n], dtype=np.uint64, out=out[1:])
        return out

    def __call__(self, words: np.ndarray, k: int) -> np.ndarray:
        sums = self.sums(words)
        return mix((sums[k:] - sums[:-k]) * self.up[: len(words) - k + 1])

    def words(self, letters: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int = 20_000) -> np.ndarray:
        """The hash of each word begin..end of the bytes of a text, `size` words at once."""
        out = np.empty(len(begin), np.uint64)
        for i in range(0, len(begin), size):
            a, b = begin[i : i + size], end[i : i + size]
            sums = self.sums(letters[a[0] : b[-1]].astype(np.uint64))
            out[i : i + size] = mix((sums[b - a[0]] - sums[a - a[0]]) * self.up[a - a[0]])
        return out


#: Spaces as str.split() has them: those of one byte, and the others.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts in lower case, begin and end of each word in them, and how many words each text has."""
    raw = [(x if x.isascii() else _WIDE.sub(" ", x)).lower().encode() for x in texts]
    letters = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    borders = np.flatnonzero(np.diff(_BLANK[letters]))
    begin, end = borders[::2] + 1, borders[1::2] + 1
    ends = np.cumsum([len(x) + 1 for x in raw])
    return letters, begin, end, np.diff(np.searchsorted(begin, ends, "right"), prepend=0)


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours."""
    n = len(x)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = x
    rows = rows.reshape(-1, width)
    before, after = np.minimum.accumulate(rows, 1).ravel(), np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def _windows(batches: Iterator[pa.RecordBatch], least: int, contents: bool = True, size: int = 300_000) -> Iterator[tuple]:
    """Of texts of about `size` characters together: the batch, and of each window of the texts its row, place, print and hash, or None without contents."""
    rolling, gram = Rolling(), max(1, least // 3)
    for batch in batches:
        held: list[int] = []
        texts, total = batch.column("text").to_pylist(), 0
        for i, text in enumerate(texts):
            if len(text) >= 2 * least - 1:
                held.append(i)
                total += len(text)
            if held and (total >= size or i + 1 == batch.num_rows):
                letters, begin, end, counts = split([texts[k] for k in held])
                if len(begin) >= least:
                    words = rolling.words(letters, begin, end)
                    prints = smallest(rolling(words, gram), least - gram + 1)
                    n = np.maximum(counts - least + 1, 0)
                    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    at = np.repeat(np.cumsum(counts) - counts, n) + place  # windows inside a text
                    if len(at):
                        yield batch, np.repeat(held, n), place, prints[at], rolling(words, least)[at] if contents else None
                held, total = [], 0


def _runs(row: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Where neighbouring windows of one text and print begin, and the end."""
    return np.r_[0, np.flatnonzero((row[1:] != row[:-1]) | (prints[1:] != prints[:-1])) + 1, len(row)]


def _circles(content: np.ndarray, at: int, size: int, least: int) -> Iterator[tuple[int, int, bool]]:
    """(begin, size, sure) of the parts of a run of windows: sure if each stands in the run before, ended by then."""
    _, first, same = np.unique(content[at : at + size], return_index=True, return_inverse=True)
    sure = np.arange(size) >= first[same] + least
    cuts = np.r_[0, np.flatnonzero(np.diff(sure)) + 1, size].tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield at + a, b - a, bool(sure[a])


def _bits(keys: DataFrame) -> DataFrame:
    """A bitmap of fixed size of the hashes in column key: words (64-bit, from the lowest bit on) of each piece that has any."""
    low = F.col("key").bitwiseAND(F.lit((1 << BITMAP) - 1))
    words = keys.groupBy(F.shiftright(low, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("b"))
    n = 1 << (PIECE - 6)
    held = words.groupBy(F.shiftright("w", PIECE - 6).cast("int").alias("piece")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("w").bitwiseAND(F.lit(n - 1)).cast("int"), "b"))).alias("m"))
    return cut(held.select("piece", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words")), "passages-bits")


def _among(df: DataFrame, keys: DataFrame, key: Column, name: str) -> DataFrame:
    """df with the column name: whether key is among the hashes in column key of keys; true for all that are, and for a few others."""
    piece, words, own = fresh(df, "piece", "words", "key")
    bits = _bits(keys).select(F.col("piece").alias(piece), F.col("words").alias(words))
    low = lambda bits: F.col(own).bitwiseAND(F.lit((1 << bits) - 1))
    j = df.withColumn(own, key).join(F.broadcast(bits), F.shiftright(low(BITMAP), PIECE).cast("int") == F.col(piece), "left")
    bit = F.getbit(F.element_at(words, F.shiftright(low(PIECE), 6).cast("int") + 1), low(6).cast("int"))
    return j.select(*df.columns, F.coalesce(bit == 1, F.lit(False)).alias(name))


def _shared(docs: DataFrame, least: int) -> DataFrame:
    """key: the prints that occur more than once."""
    gram = max(1, least // 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, row, _, prints, _ in _windows(batches, least, False):
            cuts = _runs(row, prints)
            # more windows than a print has room in mean that it stands there twice
            times = -(-np.diff(cuts) // (least - gram + 1))
            yield pa.record_batch([pa.array(prints[cuts[:-1]].view(np.int64)), pa.array(times)], ["key", "times"])

    return docs.select("text").mapInArrow(run, "key long, times long").groupBy("key").agg(F.sum("times").alias("n")).filter("n > 1").select("key")


def stretches(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, spans: the words (first, last) of each document's windows that stand elsewhere before."""
    held = np.zeros((1 << (BITMAP - PIECE), 1 << (PIECE - 6)), np.int64)
    for batch in _bits(_shared(docs, least)).toArrow().to_batches():  # of fixed size
        held[batch.column("piece").to_numpy()] = batch.column("words").flatten().to_numpy().reshape(batch.num_rows, -1)
    held = docs.sparkSession.sparkContext.broadcast(held.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, place, prints, content in _windows(batches, least):
            cuts = _runs(row, prints)
            at, size, own = cuts[:-1], np.diff(cuts), prints[cuts[:-1]]
            low = own & np.uint64((1 << BITMAP) - 1)
            keep = (held.value[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)).astype(np.int64)) & 1 == 1
            at, size, own = at[keep], size[keep], own[keep]
            long, sure = size > least, np.empty((0, 2), np.int64)
            if long.any():
                # a text that goes round in circles: what stands there before, without overlap, goes for sure
                parts = [(x, a, n, s) for x, a, n in zip(own[long].tolist(), at[long].tolist(), size[long].tolist(), strict=True) for a, n, s in _circles(content, a, n, least)]
                sure = np.array([(a, n) for _, a, n, s in parts if s], np.int64).reshape(-1, 2)
                own = np.r_[own[~long], np.array([x for x, _, _, s in parts if not s], np.uint64)]
                at, size = np.r_[at[~long], np.array([a for _, a, _, s in parts if not s], np.int64)], np.r_[size[~long], np.array([n for _, _, n, s in parts if not s], np.int64)]
            # a print that stands several times in a text is told apart by its place, so that a text has each content once
            _, which, times = np.unique(mix(own ^ mix(row[at].astype(np.uint64))), return_inverse=True, return_counts=True)
            salt = np.where((times[which] > 1) | (np.arange(len(at)) >= np.count_nonzero(~long)), place[at] + 1, 0).astype(np.uint64)
            ends = np.r_[0, np.cumsum(size)]
            inside = np.repeat(at - ends[:-1], size) + np.arange(ends[-1])
            shared = content[inside]
            # the sum of the windows' hashes: rows of the same windows are alike, in whatever order they stand
            digests = mix(np.add.reduceat(mix(shared), ends[:-1]) + salt * np.uint64(_FACTOR)) if len(at) else shared
            hashes = pa.ListArray.from_arrays(pa.array(np.r_[ends, np.full(len(sure), ends[-1])].astype(np.int32)), pa.array(shared.view(np.int64)))
            take, none = pa.array(row[np.r_[at, sure[:, 0]]]), np.r_[np.zeros(len(at), bool), np.ones(len(sure), bool)]
            blank = np.zeros(len(sure), np.uint64)
            yield pa.record_batch([
                batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array(np.r_[own, blank].view(np.int64), mask=none), pa.array(np.r_[digests, blank].view(np.int64), mask=none),
                pa.array(place[np.r_[at, sure[:, 0]]].astype(np.int32)), pa.array(np.r_[np.zeros(len(at)), place[sure[:, 0]] + sure[:, 1] + least - 2].astype(np.int32), mask=~none), hashes,
            ], ["doc_id", "text_hash", "print", "digest", "first", "last", "hashes"])

    both = cut(docs.mapInArrow(run, "doc_id long, text_hash long, print long, digest long, first int, last int, hashes array<long>"), "passages")
    found, sure = both.filter("last is null").drop("last"), both.filter("last is not null").select("doc_id", "text_hash", "first", "last")
    # documents in the order of their ids, null last; equal ids by text
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("first").alias("f"))
    contents = cut(found.groupBy("print", "digest").agg(F.min(place).alias("o"), F.count(F.lit(1)).alias("n")), "passages-contents")
    several = contents.groupBy("print").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("print")
    same = F.col("doc_id").eqNullSafe(F.col("o.d")) & (F.col("text_hash") == F.col("o.t"))
    copies = found.select("doc_id", "text_hash", "print", "digest", "first", F.size("hashes").alias("size")).join(contents.filter("n > 1"), ["print", "digest"]).filter(~same)
    whole = copies.select("doc_id", "text_hash", "first", (F.col("first") + F.col("size") + least - 2).alias("last"))
    # bitmaps instead of joins: what they let through besides is compared too, which changes nothing
    own = F.xxhash64("print", "digest", "doc_id", "text_hash")
    keys = contents.join(several, "print").select(F.xxhash64("print", "digest", "o.d", "o.t").alias("key"))
    firsts = cut(_among(found, keys, own, "own").filter("own").select("doc_id", "text_hash", "first", "hashes"), "passages-firsts")
    windows = firsts.select("doc_id", "text_hash", F.col("first").alias("from"), F.posexplode("hashes").alias("i", "hash")).select("doc_id", "text_hash", (F.col("from") + F.col("i")).alias("first"), "hash")
    again = windows.groupBy(F.col("hash").alias("key")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("key")
    windows = _among(windows, again, F.col("hash"), "again").filter("again").drop("again")
    before = windows.groupBy("hash").agg(F.min(place).alias("o"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    later = windows.join(before, "hash").filter(~same | (F.col("first") >= F.col("o.f") + least)).select("doc_id", "text_hash", "first", (F.col("first") + least - 1).alias("last"))
    return cut(whole.unionByName(later).unionByName(sure).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "passages-spans")


_SPACE = re.compile(r"(\s+)")


def remove_words(text: str, spans: Sequence[tuple[int, int]]) -> str:
    """The text without the words of the spans, and without the lines that lose all their words or lie between lost ones."""
    lines, pairs = text.split("\n"), np.asarray(spans, np.int64).reshape(-1, 2)
    sizes = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
    ends = np.cumsum(sizes)
    begins, n = ends - sizes, int(ends[-1])
    change = np.bincount(pairs[:, 0] + 1, minlength=n + 2) - np.bincount(pairs[:, 1] + 2, minlength=n + 2)
    gone = np.cumsum(change) > 0  # of the word before each
    gone[-1] = False
    before = np.r_[0, np.cumsum(gone)]
    lost = before[ends + 1] - before[begins + 1]
    part = (lost > 0) & (lost < sizes)
    stay = np.where(sizes > 0, lost < sizes, ~(gone[begins] & gone[begins + 1]))
    if not part.any():
        return "\n".join(x for x, s in zip(lines, stay.tolist(), strict=True) if s)
    for i in np.flatnonzero(part).tolist():
        # words at even places, the space before each at the odd ones; the first kept word takes the line's indent
        parts, size = _SPACE.split(lines[i]), int(sizes[i])
        if not parts[0]:
            parts = parts[1:]
        else:
            parts.insert(0, "")
        kept = np.flatnonzero(~gone[begins[i] + 1 : ends[i] + 1]).tolist()
        new = [x for k in kept for x in (parts[2 * k], parts[2 * k + 1])]
        new[0] = parts[0]
        if kept[-1] == size - 1 and len(parts) > 2 * size:
            new.append(parts[2 * size])
        lines[i] = "".join(new)
    return "\n".join(x for x, s in zip(lines, stay.tolist(), strict=True) if s)


def dedup(docs: DataFrame, least: int = MIN_WORDS, counted: str | None = "removed_lines") -> DataFrame:
    """docs with later copies of passages deleted from text, and removed_lines: how many lines went.

    A passage is a run of whole lines with `least` words or more, alike but for case and spacing. Its first occurrence, by
    doc_id (null last) and place, stays; within one text, a copy is later only if it begins after the first ends. Lines
    without words go with the passage around them. Rows that repeat both doc_id and text are one document, treated alike.
    A null text stays null and an empty one empty; every row and the other columns stay, but one named as `counted`, which
    is replaced; with None nothing is counted and all columns stay. An empty table gives an empty one.
    """
    return _without(docs, lambda slim: repeated(slim, least), remove, counted)


def passages(docs: DataFrame, least: int = MIN_WORDS, counted: str | None = "removed_lines") -> DataFrame:
    """docs with later copies of passages deleted from text, and removed_lines: how many lines went as a whole.

    A passage is a run of `least` words or more, alike but for case and spacing, wherever in a line it begins and ends. Its
    first occurrence, by doc_id (null last) and place, stays; within one text, a copy is later only if it begins after the
    first ends. Lines without words go with the words around them. Rows that repeat both doc_id and text are one document,
    treated alike. A null text stays null and an empty one empty; every row and the other columns stay, but one named as
    `counted`, which is replaced; with None nothing is counted and all columns stay. An empty table gives an empty one.
    """
    return _without(docs, lambda slim: stretches(slim, least), remove_words, counted, True)


def _without(docs: DataFrame, found: Callable[[DataFrame], DataFrame], remove: Callable[[str, Sequence[tuple[int, int]]], str], counted: str | None, sift: bool = False) -> DataFrame:
    """docs without the spans that found(doc_id, text_hash, text) gives. With sift, texts that no span can belong to aren't shuffled."""
    kept = others(docs, counted) if counted else docs.columns
    own, doc, which, gone, some = fresh(docs, "own", "doc", "which", "gone", "some")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    spans = found(slim).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(which), F.col("spans").alias(gone))
    marked = docs.select(*kept, F.xxhash64(text).alias(own))
    rest = None
    if sift:
        marked = _among(marked, spans.select(F.col(which).alias("key")), F.col(own), some)
        rest = marked.filter(~F.col(some)).select(*kept, *([F.lit(0).cast("long").alias(counted)] if counted else []))
        marked = marked.filter(some)
    joined = marked.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(which)), "left").select(*kept, gone)
    schema = T.StructType([*(docs.schema[c] for c in kept), *([T.StructField(counted, T.LongType())] if counted else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                texts, spans, out, counts = part.column("text").to_pylist(), part.column(gone), [], []
                pairs = np.stack([spans.values.field(k).to_numpy() for k in ("first", "last")], axis=1)
                ends = spans.offsets.to_numpy()
                for x, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    new = remove(x, pairs[a:b]) if b > a else x
                    out.append(new)
                    counts.append((x.count("\n") + 1 - (new.count("\n") + 1 if new else 0)) if b > a else 0)
                yield pa.record_batch([pa.array(out, pa.string()) if c == "text" else part.column(c) for c in kept] + ([pa.array(counts, pa.int64())] if counted else []), schema.names)

    out = joined.mapInArrow(run, schema)
    return out if rest is None else out.unionByName(rest)
