"""Media columns: payloads stored as GIF streams, and GIF streams read into timed frames with colour histograms.

Method: LZW code streams are decoded, palettes, disposal and transparency applied, and the frames kept with
their times and histograms. Every step is a map over rows, so it needs no shuffle and a lost task is just run again.
"""

from __future__ import annotations

import hashlib
import zlib
from struct import error as struct_error
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reminisce.llm import gif
from reminisce.llm.common import others

#: Bytes of a row of pixels, and rows of a frame at most: 4 MB of payload a frame.
WIDTH, HEIGHT = 64, 65_535
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)

FRAME = "array<struct<start_ms:long,delay_ms:long,disposal:int,width:int,height:int,pixels:binary,histogram:array<long>>>"


def pad(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and those with 0 appended up to a positive multiple of WIDTH."""
    data = (text or "").encode()
    return len(data), data + b"\0" * (-len(data) % WIDTH if data else WIDTH)


def to_gif(payload: bytes) -> bytes:
    """The payload as 8-bit samples under a grey palette, in as many frames as it takes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    n = -(-len(rows) // HEIGHT)
    height = -(-len(rows) // n)
    full = np.zeros((n * height, WIDTH), np.uint8)
    full[: len(rows)] = rows
    return gif.encode(list(full.reshape(n, height, WIDTH)), GREY)


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Opaque pixels by the two high bits of red, green and blue: 64 counts."""
    seen = canvas[canvas[..., 3] > 0].astype(np.int64) >> 6
    return np.bincount(seen[:, 0] * 16 + seen[:, 1] * 4 + seen[:, 2], minlength=64)


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_bytes, payload_bytes and media (a GIF) in place of the text. A null text counts as empty.

    Columns of those names are replaced; others stay, text included in media alone.
    """
    kept = others(docs, text, "n_bytes", "payload_bytes", "media")
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                made = [pad(x) for x in part.column(text).to_pylist()]
                media = [to_gif(x) for _, x in made]
                yield pa.record_batch([*(part.column(c) for c in kept), pa.array([n for n, _ in made], pa.int64()), pa.array([len(x) for _, x in made], pa.int64()), pa.array(media, pa.binary())], [*kept, "n_bytes", "payload_bytes", "media"])

    return docs.select(*kept, text).mapInArrow(store, schema)


def media_columns(df: DataFrame, media: str = "media", pixels: bool = True) -> DataFrame:
    """df with the columns frames (timed, drawn, with histograms), duration_ms, media_error.

    A null, malformed or truncated stream has null frames and its fault in media_error; no row is lost.
    pixels=False leaves the drawn pixels out, for tables that need only times and histograms.
    """
    kept = others(df, "frames", "duration_ms", "media_error")
    frames = T._parse_datatype_string(FRAME)
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("frames", frames), T.StructField("duration_ms", T.LongType()), T.StructField("media_error", T.StringType())])
    kind = pa.list_(pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("disposal", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("histogram", pa.list_(pa.int64()))]))

    def one(data: bytes | None) -> tuple[list | None, int | None, str | None]:
        if data is None:
            return None, None, "no media"
        try:
            out, at = [], 0
            for x in gif.decode(data):
                out.append({"start_ms": at, "delay_ms": x.delay_ms, "disposal": x.disposal, "width": x.canvas.shape[1], "height": x.canvas.shape[0], "pixels": x.canvas.tobytes() if pixels else None, "histogram": histogram(x.canvas).tolist()})
                at += x.delay_ms
            return out, at, None
        except (ValueError, IndexError, struct_error) as e:
            return None, None, str(e) or type(e).__name__

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 16) for i in range(0, batch.num_rows, 16)):
                made = [one(x) for x in part.column(media).to_pylist()]
                yield pa.record_batch([*(part.column(c) for c in kept), pa.array([x[0] for x in made], kind), pa.array([x[1] for x in made], pa.int64()), pa.array([x[2] for x in made], pa.string())], schema.names)

    return df.select(*kept).mapInArrow(read, schema)


def read_payloads(stored: DataFrame) -> DataFrame:
    """What store_texts wrote, read back from the media: digests of the payload and of the stored form, and a feature.

    feature: frames, then the payload's bytes by their high four bits, as the histogram of grey levels has them.
    The columns but media stay.
    """
    new = [("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]
    kept = others(stored, "media", *dict(new))
    schema = T.StructType([*(stored.schema[c] for c in kept), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in new)])

    def one(media: bytes, size: int) -> tuple:
        frames = gif.decode(media)
        payload = b"".join(x.canvas[..., 0].tobytes() for x in frames)[:size]
        levels = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
        return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(frames)}:" + ",".join(map(str, levels.tolist()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(m, n) for m, n in zip(batch.column("media").to_pylist(), batch.column("payload_bytes").to_pylist(), strict=True)]
            columns = list(zip(*made, strict=True)) or [[]] * 5
            yield pa.record_batch([*(batch.column(c) for c in kept), *(pa.array(list(v), t) for v, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], schema.names)

    return stored.mapInArrow(read, schema)



def media(docs: DataFrame) -> DataFrame:
    """doc_id, sizes, digests and feature of every text once stored as a GIF and read back. Repeated rows give repeated rows."""
    return read_payloads(store_texts(docs.select("doc_id", F.col("text").cast("string").alias("text"))))
