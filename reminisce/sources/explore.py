"""What a stored file holds, as columns: its kind, its size, what names stand in it and how it begins.

An exploration never fails on what a text holds: a JSON text that can't be parsed is of kind json without names. Kinds
come from the file's extension, else from its MIME type, else it is text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds by extension.
KINDS = {
    "json": ("json",), "jsonl": ("jsonl", "ndjson"), "csv": ("csv",), "tsv": ("tsv", "tab"), "xml": ("xml", "svg", "html", "xhtml"), "yaml": ("yaml", "yml"),
    "code": ("c", "cc", "cpp", "cs", "go", "h", "hpp", "java", "js", "jsx", "kt", "lua", "m", "mjs", "php", "pl", "ps1", "py", "r", "rb", "rs", "scala", "sh", "sql", "swift", "ts", "tsx"),
}
#: What a MIME type contains, in order of trial.
MIMES = (("ndjson", "jsonl"), ("json", "json"), ("csv", "csv"), ("tab-separated", "tsv"), ("xml", "xml"), ("html", "xml"), ("yaml", "yaml"), ("javascript", "code"), ("x-python", "code"))
#: Words that begin a definition, and those that begin the use of another file.
DEFINES = ("class", "def", "enum", "fn", "func", "function", "interface", "module", "namespace", "object", "record", "struct", "trait", "type")
USES = ("from", "import", "include", "require", "use", "using")
NAMES, SAMPLE = 32, 160


def kind_of(name: Column, mime: Column) -> Column:
    """json, jsonl, csv, tsv, xml, yaml, code or text."""
    extension = F.lower(F.element_at(F.split(F.coalesce(name, F.lit("")), r"\."), -1))
    known = F.when(~F.coalesce(name, F.lit("")).contains("."), F.lit(None).cast("string"))
    for kind, extensions in KINDS.items():
        known = known.when(extension.isin(*extensions), kind)
    low = F.lower(F.coalesce(mime, F.lit("")))
    told = reduce(lambda c, m: c.when(low.contains(m[0]), m[1]), MIMES[1:], F.when(low.contains(MIMES[0][0]), MIMES[0][1]))
    return F.coalesce(known, told, F.lit("text"))


def _clip(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= SAMPLE, flat).otherwise(F.concat(F.substring(flat, 1, SAMPLE - 1), F.lit("…")))


def _matches(lines: Column, pattern: str) -> Column:
    """The first group of each line that the pattern matches, in order."""
    return F.filter(F.transform(lines, lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != "")


def _fields(line: Column, mark: str) -> Column:
    return F.transform(F.split(line, mark, -1), lambda x: F.trim(F.regexp_replace(x, '^\\s*"|"\\s*$', "")))


def explore(files: DataFrame) -> DataFrame:
    """file_id, kind, characters, words, lines, items, names and sample of files (file_id, file_name, mime_type, content).

    items and names are of what the kind has: keys or elements of JSON, rows and columns of tables, tags of XML (the root
    first), keys of YAML, definitions of code, headings of text. uses are a code's imported lines. names holds each once and
    NAMES at most, as a report does; items counts all. sample is the first line that says something. A null content is empty.
    """
    c, kind = F.coalesce(F.col("content"), F.lit("")), kind_of(F.col("file_name"), F.col("mime_type"))
    some = files.select("file_id", kind.alias("kind"), c.alias("c")).withColumn("all", F.split("c", "\n")).withColumn("lines", F.filter(F.transform("all", lambda x: F.rtrim(F.regexp_replace(x, "\r$", ""))), lambda x: F.trim(x) != ""))
    first = F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit(""))
    whole = F.try_parse_json("c")
    keys = F.when(F.col("kind") == "jsonl", F.json_object_keys(first)).otherwise(F.when(whole.isNotNull(), F.json_object_keys("c")))
    elements = F.when(whole.isNotNull(), F.coalesce(F.json_array_length("c"), F.size(F.json_object_keys("c"))))
    tags = F.regexp_extract_all("c", F.lit(r"<([\p{L}_][^\s<>/]*)"), F.lit(1))
    defined = _matches(F.col("lines"), rf"^(?:[a-z]+ +)*(?:{'|'.join(DEFINES)}) +\*?([\p{{L}}_$][\w$]*)")
    heads = _matches(F.col("lines"), r"^(?:#+ +|={2,} *)(\S.*?)[ =#]*$")
    table = F.col("kind").isin("csv", "tsv")
    names = F.when(F.col("kind").isin("json", "jsonl"), keys).when(table, F.when(F.col("kind") == "tsv", _fields(first, "\t")).otherwise(_fields(first, ","))).when(F.col("kind") == "xml", tags).when(F.col("kind") == "yaml", _matches(F.col("lines"), r"^([^\s#:-][^:]*):(?:\s|$)")).when(F.col("kind") == "code", defined).otherwise(heads)
    made = some.withColumn("found", F.coalesce(F.filter(names, lambda x: x != ""), F.array().cast("array<string>")))
    items = F.when(F.col("kind") == "json", elements).when(F.col("kind") == "jsonl", F.size("lines")).when(table, F.greatest(F.lit(0), F.size("lines") - 1)).otherwise(F.size("found"))
    uses = F.when(F.col("kind") == "code", F.transform(F.filter("lines", lambda x: x.rlike(rf"^(?:{'|'.join(USES)})\b")), _clip)).otherwise(F.array().cast("array<string>"))
    return made.select(
        "file_id", "kind", F.length("c").cast("long").alias("characters"), F.regexp_count("c", F.lit(r"\S+")).cast("long").alias("words"), F.size("all").cast("long").alias("lines"),
        items.cast("long").alias("items"), F.slice(F.array_distinct("found"), 1, NAMES).alias("names"), F.slice(uses, 1, NAMES).alias("uses"), _clip(first).alias("sample"),
    )


def report(explored: DataFrame) -> DataFrame:
    """file_id and report: what explore() found, in a line."""
    noun = F.create_map(*(F.lit(x) for pair in (("json", "keys or elements"), ("jsonl", "records"), ("csv", "rows"), ("tsv", "rows"), ("xml", "tags"), ("yaml", "keys"), ("code", "definitions"), ("text", "headings")) for x in pair))
    said = F.concat_ws(" ", F.col("kind"), F.format_string("file of %d characters in %d lines,", "characters", "lines"), F.coalesce(F.col("items").cast("string"), F.lit("unreadable")), F.element_at(noun, F.col("kind")), F.when(F.size("names") > 0, F.concat(F.lit("("), F.array_join("names", ", "), F.lit(")"))), F.concat(F.lit("- begins: "), F.col("sample")))
    return explored.select("file_id", said.alias("report"))
