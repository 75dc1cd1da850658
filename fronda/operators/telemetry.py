"""Roll-ups of tool calls."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOW_MS = 250


def percent(part: Column, whole: Column) -> Column:
    """One decimal, halves up."""
    return F.when(whole > 0, F.floor(part * 1000.0 / whole + 0.5) / 10).otherwise(F.lit(0.0))


def measures() -> list[Column]:
    n = F.count("*")
    return [
        n.alias("calls"),
        F.count_if(F.col("status") == "error").alias("errors"),
        percent(F.count_if(F.col("status") == "error"), n).alias("error_rate"),
        percent(F.count_if(F.col("cache_hit")), n).alias("cache_hit_rate"),
        F.count_if(F.col("empty_result")).alias("empty"),
        F.count_if(F.col("duration_ms") >= SLOW_MS).alias("slow"),
        F.floor(F.avg("duration_ms") + 0.5).cast("long").alias("avg_ms"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY duration_ms)").alias("p50_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)").alias("p95_ms"),
        F.sum("items_found").alias("items"),
        F.sum("bytes_out").alias("bytes"),
    ]


def overall(log: DataFrame) -> DataFrame:
    """One row; the saving compares bytes out with source bytes, over calls that have them."""
    known = F.col("source_bytes") > 0
    out, source = F.sum(F.when(known, F.col("bytes_out"))), F.sum(F.when(known, F.col("source_bytes")))
    return log.agg(*measures(), percent(source - out, source).alias("saving"))


def by(log: DataFrame, *keys: str) -> DataFrame:
    return log.groupBy(*keys).agg(*measures())


def recent_errors(log: DataFrame, n: int = 10) -> DataFrame:
    return log.filter("status = 'error'").orderBy(F.col("seq").desc()).limit(n)


def tail(log: DataFrame, n: int = 500, tool: str | None = None) -> DataFrame:
    """The last n calls; a tool filter applies after the tail."""
    last = log.orderBy(F.col("seq").desc()).limit(n)
    return last if tool is None else last.filter(F.col("tool") == tool)


#: Size at which a log is put aside, and the longest line.
LOG_BYTES = 2 << 20
LINE_BYTES = 4095


def append(path: str, record: dict) -> bool:
    """Adds one record to a JSON-lines log; a full log becomes `.1` first. Never raises: False if the line is too long or cannot be written."""
    try:
        line = json.dumps(record, ensure_ascii=False, separators=(",", ":")).encode() + b"\n"
        if len(line) > LINE_BYTES:
            return False
        if os.path.exists(path) and os.path.getsize(path) + len(line) > LOG_BYTES:
            os.replace(path, path + ".1")
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        # one write of one short line: writers in other processes do not mix theirs in
        with open(path, "ab", buffering=0) as log:
            log.write(line)
        return True
    except (OSError, TypeError, ValueError):
        return False
