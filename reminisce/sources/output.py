"""A bounded report of a table for people and programs: JSON, indented JSON, or a table of text."""

from __future__ import annotations

import json

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows(df: DataFrame, limit: int) -> tuple[list[dict], bool]:
    """Up to limit rows as objects, and whether there are more."""
    found = [json.loads(r[0]) for r in df.limit(limit + 1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    return found[:limit], len(found) > limit


def report(df: DataFrame, form: str = "json", limit: int = 100) -> str:
    """The first rows as json, pretty or table. A query that fails gives an object with its error's class and message."""
    if form not in ("json", "pretty", "table"):
        raise ValueError("form is json, pretty or table")
    try:
        found, more = rows(df, limit)
    except PySparkException as e:
        return json.dumps({"ok": False, "error": {"code": e.getCondition() or type(e).__name__, "message": str(e).split("\n")[0]}}, ensure_ascii=False)
    if form != "table":
        return json.dumps({"ok": True, "rows": found, "more": more}, ensure_ascii=False, indent=2 if form == "pretty" else None)
    cells = [df.columns, *([("" if r.get(c) is None else r[c] if isinstance(r[c], str) else json.dumps(r[c], ensure_ascii=False)).replace("\n", " ") for c in df.columns] for r in found)]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    return "\n".join([*lines, *(["..."] if more else [])])
