"""Identity hashes, continuation tokens, budgets of ordered results, and freshness."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN_VERSION = 1
RESERVE = 256


def identity(value) -> str:
    """sha256 of the value as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def encode_token(offset: int, total: int, **context) -> str:
    payload = {"version": TOKEN_VERSION, "offset": offset, "totalItems": total, **context}
    return base64.urlsafe_b64encode(json.dumps(payload, separators=(",", ":")).encode()).decode().rstrip("=")


def verify_token(token: str, **expected) -> int:
    """Offset of a token that fits the expected context; ValueError tells what does not.

    tool and queryId must fit; anything else that differs (source, generation,
    configuration, revision, selection) makes the token stale.
    """
    try:
        payload = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        offset, total = payload["offset"], payload["totalItems"]
    except (ValueError, KeyError, TypeError):
        raise ValueError("invalid token: it cannot be read") from None
    if not (isinstance(offset, int) and isinstance(total, int) and 0 <= offset <= total):
        raise ValueError("invalid token: offset or total")
    if payload.get("version") != TOKEN_VERSION:
        raise ValueError(f"unsupported token version {payload.get('version')}")
    for key, value in expected.items():
        if payload.get(key) != value:
            raise ValueError(f"{'invalid' if key in ('tool', 'queryId') else 'stale'} token: {key} differs")
    return offset


def take_budget(items: list, max_bytes: int = 16384, max_items: int | None = None, offset: int = 0) -> tuple[list, int | None]:
    """The longest run of ordered items from `offset` whose JSON fits, and the next offset (None at the end)."""
    used, out = RESERVE, []
    for item in items[offset:]:
        size = len(json.dumps(item, separators=(",", ":"), ensure_ascii=False).encode()) + 1
        if used + size > max_bytes or (max_items is not None and len(out) >= max_items):
            break
        used += size
        out.append(item)
    if not out and offset < len(items) and max_items != 0:
        raise ValueError("the first item alone is larger than the budget")
    following = offset + len(out)
    return out, following if following < len(items) else None


def in_order(rows: DataFrame, **columns: str) -> DataFrame:
    """Rows by depth, pages first, path, line, column and name, whichever there are."""
    order: list[Column] = []
    for key in ("depth", "is_page", "path", "line", "column", "name"):
        name = columns.get(key, key)
        if name in rows.columns:
            order.append(F.col(name).desc() if key == "is_page" else F.col(name).asc_nulls_first())
    return rows.orderBy(*order, *[c for c in rows.columns if c not in order])


def freshness(sources: DataFrame, scan: DataFrame) -> DataFrame:
    """(path, state) of result sources (path, hash) against a scan: current, stale or missing."""
    now = scan.select("path", F.col("hash").alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("hash"), "current").otherwise("stale")
    return sources.join(now, "path", "left").select("path", state.alias("state"))


def effective_segment(chain: Column) -> Column:
    """Fold of layout segments, outermost first: array<struct<runtime, region, max_duration, revalidate: double, unknown: array<string>>>.

    The last runtime, region and duration win; an unknown one clears them.
    Revalidate is the least number, no number at all if one is unknown, the
    runtime is unknown, or the runtime is edge.
    """
    zero = "named_struct('runtime', CAST(NULL AS STRING), 'region', CAST(NULL AS STRING), 'max_duration', CAST(NULL AS DOUBLE), 'revalidate', CAST(NULL AS DOUBLE), 'open', false, 'open_runtime', false)"
    return _fold(chain, F.expr(zero))


def _fold(chain: Column, zero: Column) -> Column:
    def merge(a: Column, s: Column) -> Column:
        unknown = lambda f: F.coalesce(F.array_contains(s["unknown"], f), F.lit(False))
        last = lambda f: F.when(s[f].isNotNull(), s[f]).when(~unknown(f), a[f])
        return F.struct(
            last("runtime").alias("runtime"),
            last("region").alias("region"),
            last("max_duration").alias("max_duration"),
            F.least(a["revalidate"], s["revalidate"]).alias("revalidate"),
            (a["open"] | (s["revalidate"].isNull() & unknown("revalidate"))).alias("open"),
            F.when(s["runtime"].isNotNull(), F.lit(False)).otherwise(a["open_runtime"] | unknown("runtime")).alias("open_runtime"),
        )

    def finish(a: Column) -> Column:
        keep = ~a["open"] & ~a["open_runtime"] & (F.coalesce(a["runtime"], F.lit("")) != "edge")
        return F.struct(a["runtime"].alias("runtime"), a["region"].alias("region"), a["max_duration"].alias("max_duration"), F.when(keep, a["revalidate"]).alias("revalidate"))

    return F.aggregate(chain, zero, merge, finish)
