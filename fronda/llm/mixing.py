"""Mixing sources to target weights (operator 3) by Sainte-Laguë apportionment.

Sizes are words.  Targets share `share` times all words by weight, each capped
at `cap` times its source's words with the excess dealt again.  Blocks of
`block` words are then apportioned by highest quotients target / (2k + 1): first
to sources, then within a source to its shards by their words.  A shard's
documents stand in a seeded order; of its A blocks every one is taken
quota // A times and quota % A of them, spread evenly from a seeded start, once
more.  A document's `taken` is the overlap of its words with those blocks, in
closed form, so no block is ever a row.

A hot source is cut into shards (at most SHARD_LIMIT), so no window holds one.
Only one row per source reaches the driver.

Edge cases: null text has size 0 and takes nothing; null sources are one source,
ordered last; null doc_ids order first; repeated rows count each; extra columns
are ignored; an empty table, or one without words, takes nothing.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fronda.llm.common import Scratch

BLOCK = 32
SHARE = 1.5
CAP = 2.0
WEIGHTS = (5.0, 2.0, 1.0)
SEED = 20240229
SHARD_WORDS = 1 << 21
SHARD_ROWS = 20_000
SHARD_LIMIT = 4096
WORD = r"[^\x20\x09-\x0D]+"


def capped_targets(sizes: list[float], weights: list[float], total: float, cap: float = CAP) -> list[float]:
    """Shares of `total` by weight, none above cap * size; the excess goes to the others by weight."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * unit > cap * sizes[i]}
        for i in over or free:
            target[i] = cap * sizes[i] if over else weights[i] * unit
        if not over:
            break
        free -= over
        left = max(0.0, total - sum(target[i] for i in range(len(sizes)) if i not in free))
    return target


def sainte_lague(targets, seats: int, caps) -> np.ndarray:
    """Seats by highest quotient target / (2k + 1), ties to the earlier; none above its cap.

    A bisection on the divisor finds all but the last few seats, which are dealt one by one.
    """
    t, c = np.asarray(targets, float), np.asarray(caps, np.int64)
    seats = int(min(seats, c[t > 0].sum()))
    if seats <= 0:
        return np.zeros(len(t), np.int64)
    given = lambda x: np.where(t > 0, np.minimum(c, np.floor(np.minimum(t * x + 0.5, 2.0**62)).astype(np.int64)), 0)
    low, high = 0.0, 1.0
    while given(high).sum() < seats:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if given(mid).sum() <= seats else (low, mid)
    n = given(low)
    heap = [(-t[i] / (2 * int(n[i]) + 1), i) for i in range(len(t)) if t[i] > 0 and n[i] < c[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(n.sum())):
        _, i = heapq.heappop(heap)
        n[i] += 1
        if n[i] < c[i]:
            heapq.heappush(heap, (-t[i] / (2 * int(n[i]) + 1), i))
    return n


def plan_sources(rows: list[tuple[str | None, int, int]], weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK) -> list[tuple]:
    """For (source, words, rows) of each source: (source, words, target, blocks, shards), in order of code points."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [float(r[1]) for r in rows]
    w = [weights[i % len(weights)] for i in range(len(rows))]
    targets = capped_targets(sizes, w, share * sum(sizes), cap) if rows else []
    quota = sainte_lague(targets, round(sum(targets) / block), [int(cap) * -(-r[1] // block) for r in rows]) if rows else []
    out = []
    for r, t, q in zip(rows, targets, quota, strict=True):
        shards = max(1, min(SHARD_LIMIT, max(-(-r[1] // SHARD_WORDS), -(-r[2] // SHARD_ROWS))))
        out.append((r[0], int(r[1]), float(t), int(q), int(shards)))
    return out


def _upto(p: str) -> str:
    """SQL for the words taken from the first `p` words of a shard."""
    more = f"((({p}) div {{b}}) * extra + start) div blocks"
    nxt = f"((({p}) div {{b}} + 1) * extra + start) div blocks"
    return f"(base * ({p}) + {{b}} * ({more}) + (({p}) % {{b}}) * (({nxt}) - ({more})))"


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = scratch.save(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc")),
        "sizes",
    )
    totals = [tuple(r) for r in sizes.groupBy("source").agg(F.sum("size"), F.count("*")).collect()]
    plan = spark.createDataFrame(plan_sources(totals, weights, share, cap, block), "p_source string, source_size long, target double, quota long, shards long")
    seeded = F.xxhash64(F.lit(seed), "doc_id", "crc")
    dealt = sizes.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "crc"), F.col("shards")))
    cells = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))

    def apportion(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        blocks = -(-pdf.words // block)
        quota = sainte_lague(pdf.words.to_numpy(), int(pdf.quota.iloc[0]), (int(cap) * blocks).to_numpy())
        a = np.maximum(blocks.to_numpy(), 1)
        start = np.array([(int(s) * 0x9E3779B97F4A7C15 + seed) % (1 << 64) % int(n) for s, n in zip(pdf.shard, a, strict=True)], np.int64)
        return pd.DataFrame({"q_source": pdf.source, "q_shard": pdf.shard, "blocks": a, "base": quota // a, "extra": quota % a, "start": start})

    quotas = cells.groupBy("source").applyInPandas(apportion, "q_source string, q_shard long, blocks long, base long, extra long, start long")
    order = Window.partitionBy("source", "shard").orderBy(seeded, "doc_id", "crc", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("upto", F.sum("size").over(order)).join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    taken = F.expr(f"{_upto('upto')} - {_upto('upto - size')}".replace("{b}", str(block))).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_copies(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """`docs` with each row whole, kept 0, 1 or 2 times: its taken share of itself, rounded by a seeded draw."""
    columns, mark = docs.columns, "mix_"
    while any(c.startswith(mark) for c in columns):
        mark += "_"
    sums = [F.sum("size").alias(f"{mark}size"), F.sum("taken").alias(f"{mark}taken")]
    share = mix_sources(docs.select("doc_id", "text", "source"), seed=seed).groupBy(F.col("doc_id").alias(f"{mark}id")).agg(*sums)
    draw = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("doc_id").cast("long")), F.lit(1 << 30)) / float(1 << 30)
    ratio = F.when(F.col(f"{mark}size") > 0, F.col(f"{mark}taken") / F.col(f"{mark}size")).otherwise(F.lit(0.0))
    joined = docs.join(share, F.col("doc_id").eqNullSafe(F.col(f"{mark}id")))
    copies = F.least(F.floor(ratio) + (draw < ratio - F.floor(ratio)).cast("long"), F.lit(int(CAP)))
    return joined.withColumn(f"{mark}copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*columns)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
