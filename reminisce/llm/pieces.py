"""SentencePiece encoding and decoding with a given model.

Method: a lattice. Each distinct word's substrings of bounded length are looked up in the piece table, the hits are edges grouped
by word, and the path through them is sought. For unigram models a Viterbi fold over positions
finds the path of the largest summed score. For BPE models the largest sum is not what the model's merges give, so an edge is allowed only
after the piece before it if merging both pieces' characters gives back those two; exactly one path is then left, and it
is the one that the merges give.

Encoding is done in two forms. encode() keeps the lattice within the task that reads the documents. encode_words() is the
relational form (explode, equi-join, group, higher-order aggregate) for a table of words; over whole documents it needs
the words of all texts shuffled twice, which is beyond the disk that encode() needs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reminisce.llm.common import others

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SHORT = (2, 1)


@dataclass
class Pieces:
    """A model's tables, small and of fixed size: they travel with the function to the executors."""

    ids: dict[str, int]  # pieces that text can match
    scores: dict[str, float]
    raw: list[bytes]  # what each id decodes to, with SPACE for a space
    byte_ids: list[int]  # of the 256 bytes; empty without byte fallback
    unknown: int
    bpe: bool
    longest: int

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        """Read on the driver alone. The kind is BPE where scores are whole numbers that fall by rank, as BPE trainers write them."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        byte_of = {i: int(names[i][3:-1], 16) for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if i not in byte_of and not model.is_control(i) and not model.is_unknown(i) and not model.is_unused(i)]
        raw = [bytes([byte_of[i]]) if i in byte_of else b"" if model.is_control(i) else names[i].encode() for i in range(n)]
        raw[model.unk_id()] = " ⁇ ".encode()
        scores = {names[i]: model.get_score(i) for i in plain}
        by_byte = {b: i for i, b in byte_of.items()}
        whole = [s for s in scores.values() if s > -1e8]
        return cls({names[i]: i for i in plain}, scores, raw, [by_byte[b] for b in range(256)] if len(by_byte) == 256 else [], model.unk_id(), all(s == int(s) for s in whole), max(map(len, scores), default=1))

    def units(self) -> re.Pattern:
        """Runs of text that no piece crosses the border of: words with the spaces before them, cut also where a letter is
        followed by no letter and around characters that no longer piece has, if the piece table allows that."""
        longer = [x for x in self.ids if len(x) > 1]
        if any(b == SPACE != a for x in longer for a, b in zip(x, x[1:], strict=False)):
            return re.compile(r"[\s\S]+")
        odd = "".join(sorted({c for x in longer for c in x if re.match(r"[^\W\d_]", c) and not c.isalpha()}))  # such as superscripts
        letter = re.compile(rf"[^\W\d_{odd}]")
        if any(letter.match(a) and not letter.match(b) for x in longer for a, b in zip(x, x[1:], strict=False)):
            return re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        inside = set().union(*longer) if longer else set()
        alone = "".join(re.escape(chr(i)) for i in range(128) if chr(i) not in inside and not letter.match(chr(i)))
        other = f"(?:(?![{SPACE}{alone}])[\\W\\d_{odd}])"
        first = f"[{alone}]|" if alone else ""
        return re.compile(f"{first}{SPACE}*{other}*[^\\W\\d_{odd}]+|{SPACE}*{other}+|{SPACE}+")

    def spell(self, char: str) -> list[int]:
        """Ids of a character that no piece has."""
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]


class Encoder:
    """Paths of words; the first that fit into `room` bytes are remembered, which holds the common ones, and `bound` pairs of pieces."""

    def __init__(self, pieces: Pieces, room: int = 64_000_000, bound: int = 150_000):
        self.pieces, self.room, self.bound = pieces, room, bound
        sizes: dict[str, set[int]] = {}
        for x in pieces.ids:
            if len(x) > 2:
                sizes.setdefault(x[:3], {1, 2}).add(len(x))
        #: Lengths of edges that can begin with these characters, the longest first.
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in sizes.items()}
        self.units = pieces.units()
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Characters merged pair by pair, the best-scored pair first and the leftmost of equals."""
        parts, scores = list(text), self.pieces.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            ok = self.merged(a + b) == [a, b]
            if len(self.pairs) < self.bound:
                self.pairs[a, b] = ok
        return ok

    def derivable(self, piece: str) -> bool:
        ok = self.whole.get(piece)
        if ok is None:
            ok = self.whole[piece] = len(self.merged(piece)) == 1
        return ok

    def path(self, word: str) -> list[str]:
        """The word's pieces along the lattice's edges."""
        return self.merge_path(word) if self.pieces.bpe else self.best_path(word)

    def best_path(self, word: str) -> list[str]:
        """Viterbi: a fold over positions that keeps the best sum of scores up to each."""
        scores, longest, n = self.pieces.scores, self.pieces.longest, len(word)
        last, best = [0] * (n + 1), [0.0] + [-np.inf] * n
        floor = min(scores.values(), default=0.0) - 10  # of a character that no piece has
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                s = scores.get(word[j:i], floor if j == i - 1 else None)
                if s is not None and best[j] + s > best[i]:
                    best[i], last[i] = best[j] + s, j
        out, i = [], n
        while i:
            out.append(word[last[i] : i])
            i = last[i]
        return out[::-1]

    def merge_path(self, word: str) -> list[str]:
        """The only path whose neighbours all follow each other, by depth and the longest edges first.

        What leads to a position is unique as well, so a position that was left in vain is never tried again.
        """
        ids, sizes, pairs, n = self.pieces.ids, self.sizes, self.pairs, len(word)
        out: list[str] = []
        tried: list[int] = []  # how many of the edges from each position on the path were tried
        dead: set[int] = set()
        i, k, before = 0, 0, ""
        while i < n:
            options = sizes.get(word[i : i + 3], _SHORT)
            while k < len(options):
                size = options[k]
                k += 1
                if i + size > n or i + size in dead:
                    continue
                piece = word[i : i + size]
                if size > 1 and piece not in ids:
                    continue
                if before:
                    ok = pairs.get((before, piece))
                    if ok is None:
                        ok = self.follows(before, piece)
                    if not ok:
                        continue
                elif size > 1 and not self.derivable(piece):
                    continue
                out.append(piece)
                tried.append(k)
                i, k, before = i + size, 0, piece
                break
            else:  # no edge leads on from here
                dead.add(i)
                i, k = i - len(out.pop()), tried.pop()
                before = out[-1] if out else ""
        return out

    def word(self, word: str) -> bytes:
        """A word's ids as 32-bit integers."""
        found = self.known.get(word)
        if found is None:
            ids: list[int] = []
            for piece in self.path(word):
                i = self.pieces.ids.get(piece)
                ids += [i] if i is not None else self.pieces.spell(piece)
            found = np.array(ids, np.int32).tobytes()
            # the entry, its key of up to four bytes a character and its value, with what the objects take besides
            size = 220 + 4 * len(word) + len(found)
            if size <= self.room:
                self.room -= size
                self.known[word] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text. Spaces are SPACE, one is put before the text, and words begin at runs of them."""
        if not text:
            return np.empty(0, np.int32)
        known, word = self.known, self.word
        return np.frombuffer(b"".join([known.get(u) or word(u) for u in self.units.findall(SPACE + text.replace(" ", SPACE))]), np.int32)


def decode_ids(ids: list[int], raw: list[bytes]) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD, and the space put before the text goes."""
    text = b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text[:1] == " " else text


def _encoder(pieces: Pieces) -> Encoder:
    """The encoder of this Python worker, kept for its later tasks: its tables only remember, and are bounded."""
    import sys
    from types import ModuleType

    # a module of the worker's own: this one travels by value, so its globals end with a task
    key, kept = (len(pieces.ids), hash(tuple(pieces.raw))), sys.modules.setdefault("_reminisce_encoders", ModuleType("_reminisce_encoders")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(pieces)
    return kept[key]


def encode(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """docs without the text, with ids, n_tokens and round_trip: whether decoding the ids gives the text back.

    A null or empty text has no ids. The character U+2581 is the model's space, so a text that holds it reads as with
    spaces; that counts as a round trip. Every row is kept, repeated ones too; other columns stay, but those named so.
    """
    new = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "round_trip": T.BooleanType()}
    kept = others(docs, text, *new)
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(k, v) for k, v in new.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(pieces)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = part.column(text).to_pylist()
                ids = [encoder.encode(x) for x in texts]
                back = [decode_ids(i.tolist(), pieces.raw) == (x or "").replace(SPACE, " ") for i, x in zip(ids, texts, strict=True)]
                sizes = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                yield pa.record_batch([*(part.column(c) for c in kept), lists, pa.array(sizes), pa.array(back)], schema.names)

    return docs.select(*kept, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, pieces: Pieces, ids: str = "ids") -> DataFrame:
    """encoded with the column text from its ids; null ids give a null text. Ids outside the vocabulary raise an error."""
    raw = pieces.raw
    kept = others(encoded, "text")
    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array([None if x is None else decode_ids(x, raw) for x in batch.column(ids).to_pylist()], pa.string())], schema.names)

    return encoded.select(*kept).mapInArrow(run, schema)


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word -> pieces (an array of strings), in relational form, of a table of distinct words (column word, begun by SPACE).

    Substrings of bounded length are exploded and joined to the piece table; the edges of a word are grouped, and an
    aggregate folds them: Viterbi over positions for unigram models, merges by best score for BPE models.
    """
    spark = words.sparkSession
    table = spark.createDataFrame([(k, float(v)) for k, v in pieces.scores.items()], "piece string, score double")
    n = F.length("word")
    starts = words.select("word").distinct().select("word", F.explode(F.sequence(F.lit(1), n)).alias("s"))
    cuts = starts.select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("s") + 1))).alias("size"))
    cuts = cuts.withColumn("piece", F.col("word").substr(F.col("s"), F.col("size")))
    edges = cuts.join(F.broadcast(table), "piece", "left").filter(F.col("score").isNotNull() | (F.col("size") == 1))
    floor = min(pieces.scores.values(), default=0.0) - 10
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(F.struct((F.col("s") + F.col("size")).alias("e"), "s", F.coalesce("score", F.lit(floor)).alias("score")))).alias("edges"))
    if pieces.bpe:
        # the state is the ascending array of begins; a step joins the neighbours whose union is the best edge
        begin = F.sequence(F.lit(1), F.length("word") + 1)

        def step(at, _):
            spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size(at) - 2, F.lit(1))), lambda i: F.struct(F.try_element_at(at, i + 2).alias("e"), F.try_element_at(at, i).alias("s"), F.try_element_at(at, i + 1).alias("m")))
            scored = F.transform(spans, lambda x: F.struct(F.try_element_at(F.transform(F.filter("edges", lambda y: (y["s"] == x["s"]) & (y["e"] == x["e"]) & (y["score"] > floor)), lambda y: y["score"]), F.lit(1)).alias("score"), (-x["s"]).alias("left"), x["m"].alias("m")))
            best = F.array_max(F.filter(scored, lambda x: x["score"].isNotNull()))
            return F.when((F.size(at) < 3) | best.isNull(), at).otherwise(F.filter(at, lambda x: x != best["m"]))

        at = F.aggregate(F.sequence(F.lit(1), F.length("word")), begin, step)
    else:
        # the state is, for each position so far, the best score and where its last edge begins
        zero = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s")))

        def step(state, e):
            into = F.filter("edges", lambda y: y["e"] == e + 1)
            options = F.transform(into, lambda y: F.struct((F.element_at(state, y["s"])["score"] + y["score"]).alias("score"), (-y["s"]).alias("s")))
            best = F.array_max(options)
            return F.concat(state, F.array(F.struct(best["score"].alias("score"), (-best["s"]).alias("s"))))

        state = F.aggregate(F.sequence(F.lit(1), F.length("word")), zero, step)
        grouped = grouped.withColumn("state", state)
        back = lambda at, _: F.when(at[0] == 1, at).otherwise(F.concat(F.array(F.element_at(F.col("state"), at[0])["s"]), at))
        at = F.aggregate(F.sequence(F.lit(1), F.length("word")), F.array(F.length("word") + 1), back)
    pieces_of = F.transform(F.sequence(F.lit(1), F.size("at") - 1), lambda i: F.col("word").substr(F.element_at("at", i), F.element_at("at", i + 1) - F.element_at("at", i)))
    return grouped.withColumn("at", at).select("word", pieces_of.alias("pieces"))
