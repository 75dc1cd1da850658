"""Approximate nearest neighbours (operator 5): multiprobe p-stable hashing.

Each of TABLES hash tables keys a vector by HASHES values floor((a.x + b) / w)
with Gaussian a.  A query visits its own bucket and then those one step up or
down in some hashes, in the order of their estimated success: the product over
hashes of the chance that a neighbour at the usual distance falls there.  The
candidates of all visited buckets are merged and ranked by exact Euclidean
distance in double precision on the original vectors.

The usual distance, hence w and the number of probes, is fitted on at most
SAMPLE vectors (smallest hashes of vec_id) so that TARGET of the sample's own
neighbours are found; every vector is indexed.  Of equal vectors only the
k + 1 smallest ids can be an answer, so no more are indexed.  A bucket of more
than HOT rows is dealt to several slots and its probes visit all of them.  A
query that finds fewer than k is answered exactly, by blocks of BLOCK queries
against all rows, and so are queries of another length than the fitted one, and
all of them if no number of probes reaches TARGET.

Edge cases: vectors that are null, zero, or hold null or non-finite components
take no part, as queries or answers; only vectors of one length are compared;
equal distances go to the smaller vec_id; rows that repeat a vec_id and its
vector are one, and no row answers a query of its own vec_id; null vec_ids take
no part; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fronda.llm.common import Scratch, mix, partitions

K = 10
QUERY_EVERY = 100
TABLES = 8
HASHES = 8
WIDTH = 1.85  # of the usual distance
SAMPLE = 4096
TARGET = 0.96
PROBES = (8, 12, 18, 27, 40, 60, 90, 135, 200, 300, 450, 675, 1000)
HOT = 16_384
SLOT_ROWS = 200_000
BLOCK = 1024
SEED = 99

_STEPS = np.array(list(itertools.product((0, 1, 2), repeat=HASHES)), np.int64)
_CHOICE = np.zeros((len(_STEPS), 3 * HASHES), np.float32)
for _h in range(HASHES):
    _CHOICE[np.arange(len(_STEPS)), 3 * _h + _STEPS[:, _h]] = 1


def _normal(z: np.ndarray) -> np.ndarray:
    """Standard normal distribution function (to 1e-7; only ranks probes)."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, 1 - tail, tail)


@dataclass
class Index:
    distance: float
    probes: int
    length: int | None = None  # of the vectors that it was fitted on
    reached: bool = True  # whether TARGET was
    seed: int = SEED

    def hashed(self, x: np.ndarray) -> np.ndarray:
        """(rows, TABLES, HASHES): place in units of the bucket width."""
        rng = np.random.default_rng([self.seed, x.shape[1]])
        a = rng.normal(size=(x.shape[1], TABLES * HASHES))
        w = WIDTH * self.distance
        return ((x @ a + rng.uniform(0, w, TABLES * HASHES)) / w).reshape(len(x), TABLES, HASHES)

    def keys(self, cells: np.ndarray, table: int, length: int) -> np.ndarray:
        """Bucket keys of integer cells (..., HASHES)."""
        out = np.full(cells.shape[:-1], np.uint64(table * 1_000_003 + length))
        for h in range(HASHES):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cells[..., h].astype(np.int64).view(np.uint64))
        return out.view(np.int64)

    def own(self, x: np.ndarray) -> np.ndarray:
        """(rows, TABLES) bucket keys."""
        cells = np.floor(self.hashed(x)).astype(np.int64)
        return np.stack([self.keys(cells[:, t], t, x.shape[1]) for t in range(TABLES)], axis=1)

    def probed(self, x: np.ndarray, probes: int | None = None) -> np.ndarray:
        """(rows, TABLES, probes) keys of the buckets to visit, likeliest first."""
        n = min(probes or self.probes, len(_STEPS))
        place = self.hashed(x)
        cells = np.floor(place).astype(np.int64)
        left = (place - cells) * WIDTH  # in usual distances
        edges = _normal(np.stack([-left - WIDTH, -left, WIDTH - left, 2 * WIDTH - left]))
        chance = np.log(np.maximum(np.diff(edges, axis=0), 1e-9)).transpose(1, 2, 3, 0)  # rows, tables, hashes, steps
        out = np.empty((len(x), TABLES, n), np.int64)
        for t in range(TABLES):
            score = chance[:, t].reshape(len(x), -1).astype(np.float32) @ _CHOICE.T
            best = np.argpartition(-score, n - 1, axis=1)[:, :n]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), axis=1, kind="stable"), 1)
            out[:, t] = self.keys(cells[:, t, None, :] + _STEPS[best] - 1, t, x.shape[1])
        return out


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def fit(sample: list[np.ndarray], k: int = K) -> Index:
    """Bucket width and number of probes from a bounded sample of one length."""
    if len(sample) < 3:
        return Index(1.0, PROBES[0], len(sample[0]) if sample else None)
    x = np.vstack(sample)
    ask = np.arange(0, len(x), max(1, len(x) // 128))
    far = np.stack([distances(x[i], x) for i in ask])
    far[np.arange(len(ask)), ask] = np.inf
    kk = min(k, len(x) - 1)
    near = np.argpartition(far, kk - 1, axis=1)[:, :kk]
    usual = float(np.median(np.take_along_axis(far, near, 1).max(axis=1)))
    index = Index(usual if usual > 0 else 1.0, PROBES[0], x.shape[1])
    own, asked = index.own(x), index.probed(x[ask], PROBES[-1])
    for n in PROBES:
        hit = [np.mean([any(own[j, t] in seen[t] for t in range(TABLES)) for j in near[i]]) for i, seen in ((i, [set(asked[i, t, :n].tolist()) for t in range(TABLES)]) for i in range(len(ask)))]
        index.probes = n
        index.reached = bool(np.mean(hit) >= TARGET)
        if index.reached:
            break
    return index


def _usable(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.filter(finite & F.exists("vec", lambda v: v != 0.0))


def _best(frame: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return frame.select("query_id", "vec_id", "score").distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _matrices(column: pa.Array):
    """(rows, matrix) for each vector length in a batch."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, flat[offsets[rows][:, None] + np.arange(n)]


def _top(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d = distances(q, x)
    if len(d) > k:
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        d, ids = d[near], ids[near]
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


def nearest(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    usable = scratch.save(_usable(vectors).dropDuplicates(["vec_id", "vec"]), "usable")
    low = Window.partitionBy("vec").orderBy("vec_id")
    indexed = usable.withColumn("copy", F.row_number().over(low)).filter(F.col("copy") <= k + 1).drop("copy")
    queries = usable.filter(F.col("vec_id") % every == 0)
    sample = [np.asarray(r.vec) for r in usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas().itertuples()]
    lengths = pd.Series([len(v) for v in sample], dtype="int64")
    index = fit([v for v in sample if len(v) == lengths.mode().iloc[0]] if len(sample) else [], k)

    def keyed(batches):
        for batch in batches:
            for rows, x in _matrices(batch.column("vec")):
                at = np.repeat(rows, TABLES)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(index.own(x).ravel()), part.column("vec_id"), part.column("vec")], ["key", "vec_id", "vec"])

    cells = indexed.mapInArrow(keyed, "key long, vec_id long, vec array<double>")
    # at most rows * TABLES / HOT keys
    hot = {r["key"]: -(-r["count"] // HOT) for r in cells.groupBy("key").count().filter(F.col("count") > HOT).collect()}
    n_rows = usable.count()
    slots = max(partitions(spark), n_rows * TABLES // SLOT_ROWS + 1)

    def slot_of(key: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (mix(key.view(np.uint64) + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(slots)).astype(np.int64)

    def dealt(batches):
        for batch in keyed(batches):
            key, ids = batch.column("key").to_numpy(), batch.column("vec_id").to_numpy()
            parts = np.array([hot.get(v, 1) for v in key.tolist()], np.int64) if hot else np.ones(len(key), np.int64)
            part = (mix(ids.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot_of(key, part)), *batch.columns], ["slot", "key", "vec_id", "vec"])

    def probes(batches):
        for batch in batches:
            for rows, x in _matrices(batch.column("vec")):
                for i in range(0, len(rows), 64):
                    some = batch.take(pa.array(rows[i : i + 64]))
                    key = index.probed(x[i : i + 64]).reshape(some.num_rows, -1)
                    who = np.repeat(np.arange(some.num_rows), key.shape[1])
                    key, part = key.ravel(), np.zeros(key.size, np.int64)
                    if hot:
                        times = np.array([hot.get(v, 1) for v in key.tolist()], np.int64)
                        who, key = np.repeat(who, times), np.repeat(key, times)
                        part = np.arange(len(key)) - np.repeat(np.cumsum(times) - times, times)
                    slot = slot_of(key, part)
                    order = np.lexsort((slot, who))
                    who, slot, key = who[order], slot[order], key[order]
                    first = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (slot[1:] != slot[:-1])))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(key))
                    each = some.take(pa.array(who[first]))
                    yield pa.RecordBatch.from_arrays([pa.array(slot[first]), each.column("vec_id"), each.column("vec"), lists], ["slot", "query_id", "vec", "keys"])

    def search(cands: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(cands) and len(asked):
            lengths = cands.vec.map(len).to_numpy()
            for n in np.unique(lengths):
                own = cands[lengths == n].sort_values(["key", "vec_id"])
                key, ids, x = own.key.to_numpy(), own.vec_id.to_numpy(), np.vstack(own.vec.to_numpy())
                for query_id, q, keys in zip(asked.query_id, asked.vec, asked["keys"], strict=True):
                    if len(q) != n:
                        continue
                    a, b = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
                    rows = np.concatenate([np.arange(i, j) for i, j in zip(a, b, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
                    rows = rows[ids[rows] != query_id]
                    rows = rows[np.unique(ids[rows], return_index=True)[1]]
                    if len(rows):
                        found, d = _top(np.asarray(q), x[rows], ids[rows], k)
                        out += [(query_id, i, s) for i, s in zip(found, d, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    cands = indexed.mapInArrow(dealt, "slot long, key long, vec_id long, vec array<double>")
    asked = queries.mapInArrow(probes, "slot long, query_id long, vec array<double>, keys array<long>")
    met = cands.groupBy("slot").cogroup(asked.groupBy("slot")).applyInPandas(search, "query_id long, vec_id long, score double")
    found = scratch.save(_best(met, k), "found")

    counts = found.groupBy("query_id").count()
    # nothing is known of the recall for vectors of another length than the fitted one, or if no number of probes reached TARGET
    unsure = (F.size("vec") != index.length) | F.lit(not index.reached) if index.length is not None else F.lit(False)
    short = queries.join(counts, queries.vec_id == counts.query_id, "left").filter((F.coalesce("count", F.lit(0)) < min(k, max(0, n_rows - 1))) | unsure).select("vec_id", "vec")
    out, after = [found], None
    while True:  # exact answers, BLOCK queries at a time
        block = (short if after is None else short.filter(F.col("vec_id") > after)).orderBy("vec_id").limit(BLOCK).collect()
        if not block:
            break
        after = block[-1]["vec_id"]
        asks = [(r["vec_id"], np.asarray(r["vec"])) for r in block]

        def scan(batches, asks=asks):
            for batch in batches:
                ids, rows = batch.column("vec_id").to_numpy(), []
                for at, x in _matrices(batch.column("vec")):
                    for query_id, q in asks:
                        if len(q) == x.shape[1]:
                            other = ids[at] != query_id
                            best, d = _top(q, x[other], ids[at][other], k)
                            rows += [(query_id, i, s) for i, s in zip(best, d, strict=True)]
                if rows:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]), preserve_index=False)

        name = f"exact{len(out)}"
        out.append(scratch.save(_best(indexed.mapInArrow(scan, "query_id long, vec_id long, score double"), k), name))
    result = out[0]
    if len(out) > 1:
        exact = out[1]
        for o in out[2:]:
            exact = exact.unionByName(o)
        result = found.join(exact.select("query_id").distinct(), "query_id", "left_anti").select(*found.columns).unionByName(exact.select(*found.columns))
    return result.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
