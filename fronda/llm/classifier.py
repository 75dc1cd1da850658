"""Quality classifier (operator 4): histogram gradient-boosted trees over text statistics.

Statistics are computed from whole Arrow buffers.  Training takes at most
SAMPLE labelled documents (the smallest hashes of doc_id among rows in the
training fold), bins each statistic into at most BINS quantile bins and grows
complete trees level by level from gradient histograms.  The trees are
flattened into arrays, feature and threshold of every inner node and value of
every leaf, that numpy walks for a whole batch at once.

Labels, lang, source and doc_id are never inputs of a score.

Edge cases: a null or empty text has all-zero statistics and gets the score
they lead to; labels that are null or not 0/1 are ignored; several labels of
one document are averaged; of rows that repeat a doc_id the least text teaches;
without labels every score is 0.5; splits of equal gain go to the first statistic
and the lowest bin; repeated rows score alike; a null doc_id is in the fold of the
empty text; extra columns are ignored; an empty table gives no rows; of a very
long text a few numbers a word are held, and nothing else beside it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fronda.llm import common as C
from fronda.llm.quality_rules import _shared, _sums

SAMPLE = 16_384
FOLDS = 5
THRESHOLD = 0.3
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.15
LEAST = 20  # training rows a leaf
PENALTY = 1.0

_CLASSES = {
    "symbol": "#*$%&|<>",
    "digit": "0123456789",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "shout": "!",
    "stop": ".",
    "comma": ",",
    "line": "\n",
    "bracket": "()[]{}",
    "other": "\"'-_=+/\\:;?@^`~",
    "pipe": "|",
    "hash": "#",
    "dollar": "$",
    "percent": "%",
    "star": "*",
}
_LUT = {k: np.isin(np.arange(256), [ord(c) for c in v]) for k, v in _CLASSES.items()}
_LUT["wide"] = np.arange(256) >= 128
FEATURES = (*_LUT, "log_bytes", "log_words", "word_bytes", "long_words", "short_words", "distinct", "repeated", "words_a_line", "words_a_stop", "capital_words", "same_next")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """len(offsets) - 1 rows of FEATURES."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, at = C.words(data, offsets)
    n_words = np.diff(at).astype(float)
    some, total = np.maximum(n_words, 1), np.maximum(size, 1)
    sums = {k: _sums(lambda a, b, flags=flags: flags[data[a:b]], offsets).astype(float) for k, flags in _LUT.items()}
    length = ends - starts
    hashes = C.word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(at))
    keyed = C.mix(hashes ^ C.mix(doc.astype(np.uint64)))
    order = np.argsort(keyed, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = keyed[order][1:] != keyed[order][:-1]
    windows, w_at = C.window_hashes(hashes, at, 3)
    w_doc = np.repeat(np.arange(n), np.diff(w_at))
    again = _shared(C.mix(windows ^ C.mix(w_doc.astype(np.uint64))))
    nxt = np.zeros(len(hashes), bool)
    if len(hashes):
        nxt[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    capital = _LUT["upper"][data[starts]] if len(starts) else np.zeros(0, bool)
    columns = [sums[k] / total for k in _LUT]
    columns += [
        np.log1p(size),
        np.log1p(n_words),
        _sums(length, at) / some,
        _sums(length > 12, at) / some,
        _sums(length < 3, at) / some,
        np.bincount(doc[order[fresh]], minlength=n) / some,
        _sums(again, w_at) / some,
        n_words / (sums["line"] + 1),
        n_words / (sums["stop"] + 1),
        _sums(capital, at) / some,
        _sums(nxt, at) / some,
    ]
    return np.column_stack(columns) if n else np.zeros((0, len(FEATURES)))


class Trees:
    """Complete trees of one depth, as arrays: feature and threshold (trees, 2^depth - 1), value (trees, 2^depth)."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (len(value) - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Boosting of the logistic loss; y in 0..1."""
    inner, n_leaves = (1 << depth) - 1, 1 << depth
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, n_leaves)), float(np.log(p / (1 - p))))
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    cell = binned + np.arange(m) * bins
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw, features, thresholds, values = np.full(n, base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width = 1 << level
            at = node - (width - 1)
            key = (at[:, None] * (m * bins) + cell).ravel()
            sums = [np.bincount(key, np.repeat(v, m), width * m * bins).reshape(width, m, bins) for v in (g, h, np.ones(n))]
            left_g, left_h, left_n = (np.cumsum(s, axis=2) for s in sums)
            all_g, all_h, all_n = (s[:, :, -1:] for s in (left_g, left_h, left_n))
            gain = left_g**2 / (left_h + PENALTY) + (all_g - left_g) ** 2 / (all_h - left_h + PENALTY) - all_g**2 / (all_h + PENALTY)
            gain[(left_n < LEAST) | (all_n - left_n < LEAST)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            cut_bin = np.full(width, bins)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[width - 1 + k], threshold[width - 1 + k], cut_bin[k] = f, cuts[f][b], b
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut_bin[at])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, n_leaves) / (np.bincount(leaf, h, n_leaves) + PENALTY)
        raw += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Trees:
    """Fit on at most `sample` labelled documents of the training fold."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter(F.col("y").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & (C.fold("doc_id", FOLDS) != 0))
    chosen = marked.groupBy("doc_id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    schema = "y double, " + ", ".join(f"{f} double" for f in FEATURES)

    def run(batches):
        for batch in batches:
            data, offsets = C.text_buffer(batch.column("text"))
            for i, j in C.slices(offsets):
                x = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(i, j - i), *(pa.array(c) for c in x.T)], ["y", *FEATURES])

    # `chosen` has at most `sample` rows of 16 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text").mapInArrow(run, schema).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable").to_numpy(float)
    return fit(rows[:, 1:], rows[:, 0])


def quality_scores(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches):
        for batch in batches:
            data, offsets = C.text_buffer(batch.column("text"))
            for i, j in C.slices(offsets):
                x = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(model.score(x))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score `threshold` or more, with all their columns."""

    def run(batches):
        for batch in batches:
            data, offsets = C.text_buffer(batch.column("text"))
            for i, j in C.slices(offsets):
                x = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield batch.slice(i, j - i).filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_scores(docs, model)
    return scored.select("doc_id", (C.fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
