"""Column expressions over message text: token estimates, previews, snippets, hashes, ids and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that cost 1.5 tokens, and all beyond the basic plane that cost 2 unless they are among those.
CJK = "一-鿿㐀-䶿\\x{20000}-\\x{2a6df}\\x{2a700}-\\x{2b73f}\\x{2b740}-\\x{2b81f}\\x{2b820}-\\x{2ceaf}\\x{2ceb0}-\\x{2ebef}　-〿぀-ヿ가-힯＀-￯"
#: What search treats as a language without spaces.
CJK_SEARCH = "⺀-鿿㐀-䶿豈-﫿가-힯぀-ゟ゠-ヿ"
#: Fixed value: punctuation that search trims from the edges of terms.
EDGE = "`'\"()[]{}<>.,:;!?*_+=|\\/-"


def estimate_tokens(text: Column) -> Column:
    """Estimated tokens: 1.5 a CJK code point, 2 another beyond the basic plane, 0.25 any other; the sum rounded up. 0 for null."""
    text = F.coalesce(text, F.lit(""))
    rest = F.regexp_replace(text, f"[{CJK}]", "")
    plain = F.regexp_replace(rest, r"[\x{10000}-\x{10ffff}]", "")
    n, m, k = F.length(text), F.length(rest), F.length(plain)
    return F.ceil(((n - m) * 6 + (m - k) * 8 + k) / F.lit(4.0)).cast("long")


def one_line(text: Column, limit: int = 240) -> Column:
    """White space made single, and an ellipsis where the text is cut to limit characters."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def identity_hash(role: Column, content: Column) -> Column:
    """SHA-256 of role, NUL and content."""
    return F.sha2(F.concat(role, F.lit("\0"), F.coalesce(content, F.lit(""))), 256)


def fallback_snippet(content: Column, terms: list[str]) -> Column:
    """24 characters before to 40 after the earliest of the terms; the head of the text where none occurs."""
    low = F.lower(content)
    places = [F.when(F.instr(low, t) > 0, F.struct(F.instr(low, t).alias("at"), F.lit(i).alias("i"), F.lit(len(t)).alias("n"))) for i, t in enumerate(terms)]
    hit = (F.least(*places) if len(places) > 1 else places[0]) if places else F.lit(None).cast("struct<at:int,i:int,n:int>")
    begin = F.greatest(F.lit(0), hit["at"] - 1 - 24)
    end = F.least(F.length(content), hit["at"] - 1 + F.greatest(hit["n"], F.lit(1)) + 40)
    body = F.trim(content.substr(begin + 1, end - begin))
    head = F.trim(content)
    cut = F.when(F.length(head) <= 80, head).otherwise(F.concat(F.rtrim(F.substring(head, 1, 77)), F.lit("...")))
    return F.when(hit.isNull(), cut).otherwise(F.concat(F.when(begin > 0, "...").otherwise(""), body, F.when(end < F.length(content), "...").otherwise("")))


def parse_utc(text: Column) -> Column:
    """A timestamp of `YYYY-MM-DD HH:MM:SS` or ISO text; null for any other. No zone means UTC."""
    return F.try_to_timestamp(F.trim(text))


def format_seconds(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def xml_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def file_ids(text: Column) -> Column:
    """file_ followed by 16 hexadecimal digits, each id once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b(file_[a-f0-9]{16})\b"), F.lit(1)))


def json_first(text: Column, *paths: str) -> Column:
    """The first path of JSON text that holds a value; null for malformed text."""
    return F.coalesce(*(F.get_json_object(text, p) for p in paths))


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text without overlap; 0 for an empty part."""
    return F.when(F.length(part) == 0, 0).otherwise((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.greatest(F.length(part), F.lit(1))).cast("long")


def summary_id(*parts: Column) -> Column:
    """A deterministic id of a summary from what it covers."""
    return F.concat(F.lit("sum_"), F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 16))
