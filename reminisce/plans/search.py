"""What a search becomes before it touches data: terms, phrases, segments, guarded patterns, routing of expansions."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from reminisce.functions.text import CJK_SEARCH, EDGE

#: Fixed value: words beside CJK segments keep the dots, slashes and hyphens inside them.
LATIN = r"[a-zA-Z0-9][A-Za-z0-9_./-]*"
#: Fixed value: the longest regular expression that is run.
LONGEST = 500
_CJK = re.compile(f"[{CJK_SEARCH}]")


def phrases(query: str) -> list[str]:
    """Quoted phrases as they are, other words one by one; all must match."""
    out = [a.replace('"', "").strip() or b.replace('"', "") for a, b in re.findall(r'"([^"]+)"|(\S+)', query)]
    return [x for x in out if x]


def like_terms(query: str) -> list[str]:
    """Phrases and words in lower case without punctuation at their edges, each once."""
    found = [(a or b).strip().strip(EDGE).lower() for a, b in re.findall(r'"([^"]+)"|(\S+)', query)]
    return list(dict.fromkeys(x for x in found if x)) or [x for x in [query.strip().strip(EDGE).lower()] if x]


def has_cjk(text: str) -> bool:
    return bool(_CJK.search(text))


def cjk_groups(query: str, size: int) -> tuple[list[list[str]], list[str]]:
    """(for each CJK segment its pieces of `size`, of which one must occur; other words, which all must)."""
    segments = re.findall(f"[{CJK_SEARCH}]+", query)
    groups = [[s] if len(s) <= size else list(dict.fromkeys(s[i : i + size] for i in range(len(s) - size + 1))) for s in segments]
    return groups, [x.lower() for x in re.findall(LATIN, _CJK.sub(" ", query))]


def safe_pattern(pattern: str) -> str | None:
    """The pattern, or None if it is too long, has unbalanced groups, repeats a group of alternatives, or one that ends in a repetition.

    The pattern's groups are walked, so that escapes and classes are passed over; whether it compiles is for the engine
    that runs it to say.
    """
    if len(pattern) > LONGEST:
        return None
    groups = [[False]]  # of each open group: whether it has alternatives
    i, closed = 0, None  # closed: the group that has just ended
    while i < len(pattern):
        c = pattern[i]
        if c in "*+?" or c == "{" and re.match(r"\{\d+(,\d*)?\}", pattern[i:]):
            if closed and (closed[0] or closed[1]):
                return None
            i = pattern.index("}", i) + 1 if c == "{" else i + 1
            closed = None
            continue
        closed = None
        if c == "\\":
            i += 1
        elif c == "[":
            end = _class_end(pattern, i)
            if end is None:
                return None
            i = end
        elif c == "(":
            groups.append([False])
            if pattern[i + 1 : i + 2] == "?":
                i += 1
        elif c == ")":
            if len(groups) == 1:
                return None
            last = pattern[i - 1]
            closed = [groups[-1][0], last in "*+?" and pattern[i - 2 : i - 1] != "\\" or last == "}"]
            inner = groups.pop()
            groups[-1][0] = groups[-1][0] or inner[0]
        elif c == "|":
            groups[-1][0] = True
        i += 1
    return pattern if len(groups) == 1 else None


def _class_end(pattern: str, i: int) -> int | None:
    """Where the class that begins at i ends."""
    j = i + 1
    if pattern[j : j + 1] == "^":
        j += 1
    if pattern[j : j + 1] == "]":
        j += 1
    while j < len(pattern):
        if pattern[j] == "\\":
            j += 1
        elif pattern[j] == "]":
            return j
        j += 1
    return None


def refusal(query: str, mode: str, since: str | None = None, before: str | None = None) -> str | None:
    """Why a search isn't run, or None: an unknown mode, a blank query, an unsafe pattern, times out of order, or a pattern given as words."""
    if mode not in ("full_text", "regex"):
        return "mode is full_text or regex"
    if not query.strip():
        return "the query is blank"
    if since and before and since >= before:
        return "since must be earlier than before"
    if mode == "regex":
        return None if safe_pattern(query) else "the pattern is too long, unbalanced or repeats a repetition"
    words = re.sub(r'"[^"]*"', " ", query)
    looks = {"alternatives": r"\S\|\S", "a wildcard": r"\.[*+?]", "a class of characters": r"\[[^\]\s]+\]", "an escape": r"\\[bBdDsSwW]", "a repetition": r"\)[*+?{]|\w\{\d", "an anchor": r"(?:^|\s)\^\w|\w\$(?:\s|$)"}
    found = next((name for name, p in looks.items() if re.search(p, words)), None)
    return f"the words hold {found} of a regular expression: use the mode regex" if found else None


#: Words that ask for a long time, and for several steps.
BROAD = (r"\b(last|past)\s+(month|months|quarter|quarters|year|years)\b", r"\b(over|across|throughout)\s+(time|months|quarters|years)\b", r"\b(timeline|chronology|history|long[-\s]?term)\b", r"\bbetween\s+[^.]{0,40}\s+and\s+[^.]{0,40}\b")
SEVERAL = (r"\b(root\s+cause|causal\s+chain|chain\s+of\s+events)\b", r"\b(multi[-\s]?hop|multi[-\s]?step|cross[-\s]?summary)\b", r"\bhow\s+did\b.+\blead\s+to\b")


def broad_range(query: str | None) -> bool:
    """Whether a query asks about a long time: by words, or years two apart or more."""
    text = (query or "").strip()
    years = [int(x) for x in re.findall(r"\b(?:19|20)\d{2}\b", text)]
    return any(re.search(p, text, re.I) for p in BROAD) or (len(years) > 1 and max(years) - min(years) >= 2)


#: An expansion's tokens a candidate, what messages, each further depth, a long time and several steps multiply them by,
#: and the shares of the cap at which the risk is moderate and high.
TOKENS, WITH_MESSAGES, A_DEPTH, LONG_TIME, SEVERAL_STEPS, MODERATE, HIGH = 220, 1.9, 0.65, 1.35, 1.25, 0.35, 0.7


@dataclass
class Route:
    action: str
    depth: int
    tokens: int
    ratio: float
    risk: str
    reasons: list[str] = field(default_factory=list)


def route(query: str | None, candidates: int, cap: float, depth: int | None = None, include_messages: bool = False, probe: bool = False) -> Route:
    """Whether to answer directly, expand here or delegate, from the estimated tokens of an expansion."""
    depth = 3 if depth is None else max(1, min(10, int(depth)))
    candidates, cap = max(0, int(candidates)), max(1, int(cap)) if math.isfinite(cap) else 2**53 - 1
    broad = broad_range(query)
    several = depth >= 3 or candidates >= 5 or any(re.search(p, (query or "").strip(), re.I) for p in SEVERAL)
    tokens = math.ceil(TOKENS * (WITH_MESSAGES if include_messages else 1) * (1 + (depth - 1) * A_DEPTH) * (LONG_TIME if broad else 1) * (SEVERAL_STEPS if several else 1) * candidates)
    ratio = tokens / cap
    risk = "high" if ratio >= HIGH else "moderate" if ratio >= MODERATE else "low"
    if not candidates:
        return Route("answer_directly", depth, tokens, ratio, risk, ["no candidates"])
    if probe and depth <= 2 and candidates <= 1 and risk == "low" and not broad and not several:
        return Route("answer_directly", depth, tokens, ratio, risk, ["a simple probe"])
    if risk == "high" or broad and several:
        return Route("delegate_traversal", depth, tokens, ratio, risk, [x for x, y in (("token risk", risk == "high"), ("long time and several steps", broad and several)) if y])
    return Route("expand_shallow", depth, tokens, ratio, risk, ["bounded"])
