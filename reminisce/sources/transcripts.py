"""Transcripts: files of JSON lines, as batch tables and as streams; and text files with heads and line ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FIELDS = "id string, parentId string, type string, role string, content string, command string, output string, message string, timestamp string"


def _entry(line: Column) -> Column:
    return F.from_json(line, _FIELDS, {"mode": "PERMISSIVE"})


def read_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """file, line_no (in a batch), value of every line. Files are split, and their lines numbered by where they stand."""
    if stream:
        return spark.readStream.format("text").load(path).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    place = Window.partitionBy("file").orderBy("_block", "_id")
    return lines.select("file", (F.row_number().over(place) - 1).alias("line_no"), "value")


def appended(lines: DataFrame, offsets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, status) of each file of lines from its byte offset (offsets: file, offset) on; lines end in one byte.

    status has file, usable and blank. What was appended isn't usable, and gives no entries, if it begins with an array or
    holds a malformed line: the file was written anew, or a line isn't finished.
    """
    before = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length("value") + 1).over(before), F.lit(0))
    new = lines.withColumn("_at", at).join(offsets, "file").filter(F.col("_at") >= F.col("offset"))
    some = new.filter(F.trim("value") != "")
    checked = some.groupBy("file").agg(F.ltrim(F.min_by("value", "line_no")).startswith("[").alias("array"), F.bool_or(F.try_parse_json("value").isNull()).alias("bad"))
    status = offsets.select("file").join(checked, "file", "left").select("file", (~F.coalesce(F.col("array") | F.col("bad"), F.lit(False))).alias("usable"), F.col("bad").isNull().alias("blank"))
    return parse(some.join(status.filter("usable").select("file"), "file", "left_semi").select(*lines.columns)), status


def headers(lines: DataFrame) -> DataFrame:
    """file, session_id, parent_session, created_at of each file's first line that isn't blank, if it is a session's header; null otherwise."""
    first = lines.filter(F.trim("value") != "").groupBy("file").agg(F.min_by("value", "line_no").alias("v"))
    own = F.get_json_object("v", "$.type") == "session"
    field = lambda name: F.when(own & (F.trim(F.get_json_object("v", f"$.{name}")) != ""), F.trim(F.get_json_object("v", f"$.{name}")))
    return first.select("file", field("id").alias("session_id"), field("parentSession").alias("parent_session"), field("timestamp").alias("created_at"))


def parse(lines: DataFrame) -> DataFrame:
    """Entries of lines: a bare {role, content}, {command, output} or an envelope with a message; blank and malformed lines go.

    accepted marks those that are messages; id and parent_id are the envelope's.
    """
    e = lines.filter(F.trim("value") != "").withColumn("e", _entry(F.col("value"))).filter(F.try_parse_json("value").isNotNull())
    role = F.coalesce(F.get_json_object("e.message", "$.role"), F.col("e.role"), F.when(F.col("e.command").isNotNull(), "tool"))
    content = F.coalesce(F.get_json_object("e.message", "$.content"), F.col("e.content"), F.when(F.col("e.command").isNotNull(), F.concat(F.lit("$ "), "e.command", F.lit("\n"), F.coalesce("e.output", F.lit("")))))
    kept = [c for c in lines.columns if c != "value"]
    return e.select(*kept, F.col("e.id").alias("id"), F.col("e.parentId").alias("parent_id"), F.col("e.timestamp").alias("timestamp"), role.alias("role"), content.alias("content"), (role.isNotNull() & content.isNotNull()).alias("accepted"))


def malformed(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor JSON."""
    return lines.filter((F.trim("value") != "") & F.try_parse_json("value").isNull())


def live_path(entries: DataFrame) -> DataFrame:
    """Entries on the way from each file's last line to its root; all of a file whose way breaks off or circles.

    A repeated id means its last line. Files are walked one by one in order, so one must fit in a task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        at = {r.id: i for i, r in enumerate(pdf.itertuples()) if isinstance(r.id, str)}
        parents = pdf["parent_id"].tolist()
        i, way, whole = len(pdf) - 1, set(), False
        while True:
            way.add(i)
            p = parents[i]
            if not isinstance(p, str):
                whole = not isinstance(pdf["id"].iloc[i], str)
                break
            if p not in at or at[p] in way:
                whole = True
                break
            i = at[p]
        return pdf if whole else pdf.iloc[sorted(way)]

    return entries.groupBy("file").applyInPandas(run, entries.schema)


def session_files(spark: SparkSession, path: str, since: str | None = None, limit: int | None = None) -> DataFrame:
    """path, modified_at, length of the files of a folder, the newest first."""
    df = spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified_at"), "length")
    if since is not None:
        df = df.filter(F.col("modified_at") >= F.lit(since).cast("timestamp"))
    df = df.orderBy(F.desc("modified_at"), "path")
    return df if limit is None else df.limit(limit)


def utf8_head(content: Column, limit: int) -> Column:
    """The longest whole characters of a text within limit bytes."""
    data = F.encode(content, "UTF-8")
    head = F.substring(data, 1, limit)
    # a cut character is at most three bytes at the end: continuation bytes, and what leads them
    whole = lambda n: F.substring(data, 1, limit - n)
    ok = lambda b: F.is_valid_utf8(b.cast("string"))
    return F.when(F.octet_length(data) <= limit, content).when(ok(head), head.cast("string")).when(ok(whole(1)), whole(1).cast("string")).when(ok(whole(2)), whole(2).cast("string")).otherwise(whole(3).cast("string"))


def line_range(content: Column, first: int, last: int) -> Column:
    """Lines first to last, counted from 1, both inclusive."""
    return F.array_join(F.slice(F.split(content, "\n"), first, last - first + 1), "\n")


def describe_files(files: DataFrame, limit: int = 32_768) -> DataFrame:
    """file_id, sizes, the head of the content within limit bytes (1,024 to 512,000), and whether it is cut."""
    limit = max(1_024, min(512_000, limit))
    return files.select("file_id", "mime_type", "byte_size", "line_count", utf8_head(F.col("content"), limit).alias("head"), (F.col("byte_size") > limit).alias("truncated"))


def file_blocks(content: Column) -> Column:
    """array<struct<name, body>> of <file name="..."> blocks in a text."""
    pattern = r"(?s)<file\s+name=\"([^\"]*)\"[^>]*>(.*?)</file>"
    return F.arrays_zip(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(content, F.lit(pattern), F.lit(2)).alias("body"))


def newest_entry(entries: DataFrame) -> DataFrame:
    """file, id and role of the last entry of each file."""
    w = Window.partitionBy("file").orderBy(F.desc("line_no"))
    return entries.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("file", "id", "role", "line_no")
