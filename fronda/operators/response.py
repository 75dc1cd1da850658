"""Small forms of requests and answers: coerced arguments, digests, bounded JSON, counts of what was selected."""

from __future__ import annotations

import json
import math
import re

from fronda.sources.aliases import parse_jsonc

BUDGET_BYTES = 16 << 10


def positive_int(value, fallback: int | None = None) -> int | None:
    """The whole part of a number of 1 or more; else the fallback."""
    try:
        n = float(value) if value not in (None, "") and not isinstance(value, (list, dict)) else math.nan
    except (TypeError, ValueError):
        n = math.nan
    return math.floor(n) if math.isfinite(n) and n >= 1 else fallback


def string_list(value) -> list[str] | None:
    """Trimmed, non-empty items of a list or of a text with commas; None if there are none."""
    parts = value.split(",") if isinstance(value, str) else value if isinstance(value, (list, tuple)) else []
    return [s for p in parts if (s := str(p).strip())] or None


def alias_map(value) -> dict[str, str] | None:
    """Aliases from a mapping, a JSON object or a text of prefix=path pairs."""
    if isinstance(value, str):
        text = value.strip()
        found = parse_jsonc(text) if text.startswith("{") and text.endswith("}") else None
        value = found if isinstance(found, dict) else dict(p.split("=", 1) for p in text.split(",") if p.find("=") > 0)
    if not isinstance(value, dict):
        return None
    return {k.strip(): v.strip() for k, v in value.items() if k.strip() and isinstance(v, str) and v.strip()} or None


def output_digest(text: str, most: int = 300) -> dict[str, str]:
    """A preview of at most `most` characters: head and tail with a note of what is left out between them."""
    flat, most = " ".join(text.split()), max(0, min(300, most))
    if not flat:
        return {"summary": "empty_output"}
    if len(flat) <= most:
        return {"sample_preview": flat}
    # the note names how much is left out, so its length depends on the digits of that number
    notes = (f" ... [{len(flat) - room} chars omitted] ... " for digits in range(1, 20) if len(str(len(flat) - (room := max(0, most - 26 - digits)))) == digits)
    note = next(notes)
    if len(note) >= most:
        return {"sample_preview": note[:most]}
    tail = (most - len(note)) // 2
    return {"sample_preview": flat[: most - len(note) - tail] + note + (flat[-tail:] if tail else "")}


def bounded_json(build, count: int, most: int = BUDGET_BYTES) -> str:
    """JSON of build(limit), the limit shrunk by three tenths until it fits."""
    while True:
        text = json.dumps(build(count), indent=2, ensure_ascii=False)
        if count <= 0 or len(text.encode()) <= most:
            return text
        count = count * 7 // 10


def fit_collection(build, rows: list, most: int = BUDGET_BYTES) -> tuple[str, int]:
    """JSON of build(prefix of rows) with the longest prefix that fits, by bisection, and its length; sizes grow with the prefix."""
    low, high = 0, len(rows)
    size = lambda n: len(json.dumps(build(rows[:n]), ensure_ascii=False).encode())
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if size(mid) <= most else (low, mid - 1)
    return json.dumps(build(rows[:low]), ensure_ascii=False), low


def selected_count(data: dict, collections: list[str]) -> int | None:
    """How many items the named collections (dotted paths) hold; None if one is no list."""
    total = 0
    for path in collections:
        value = data
        for key in path.split("."):
            value = value.get(key) if isinstance(value, dict) else None
        if not isinstance(value, list):
            return None
        total += len(value)
    return total if collections else None


def preview(data: dict, collection: str, items: int = 3) -> dict:
    """Count and first items of a collection."""
    rows = data.get(collection)
    return {"count": len(rows), "items": rows[:items], "more": max(0, len(rows) - items)} if isinstance(rows, list) else {"count": None, "items": [], "more": 0}


def dynamic_warnings(text: str, resolved: set[str]) -> list[dict[str, str]]:
    """Components that only run time knows: an unresolved :is, and delegates by asChild."""
    out = []
    for tag in re.finditer(r"<([A-Za-z][\w.]*)\s([^>]*)>", text):
        bound = re.search(r"(?:^|\s)(?::|v-bind:)is=(\"[^\"]*\"|'[^']*')", tag[2])
        if tag[1] == "component" and bound and (name := bound[1][1:-1].strip()) and name not in resolved:
            out.append({"component": f'<component :is="{name}">', "warning": f'Dynamic/polymorphic component (:is="{name}") cannot be statically resolved'})
        if tag[1][0].isupper() and re.search(r"\basChild\b", tag[2]):
            out.append({"component": f"<{tag[1]} asChild>", "warning": f"Polymorphic delegate component (<{tag[1]} asChild>) cannot be statically resolved"})
    return out
