"""Language ID (operator 10) by error-correcting output codes over byte n-grams.

Every language has a codeword of +-1 bits (all distinct dichotomies for up to
five languages, otherwise the widest of many seeded random codes).  One binary
logistic classifier a bit is fitted on frequencies of hashed 2-, 3- and 4-grams
of the lower-cased UTF-8 bytes.  A text's bits are decoded to the language with
the smallest loss, log(1 + exp(-bit * margin)) weighted by how well the bit was
learned; `ambiguous` tells that the runner-up is within AMBIGUOUS of it.  Weights
are fixed-point numbers, so sums do not depend on how a text is cut into blocks.

Training takes at most SAMPLE documents, spread evenly over the languages, with
the smallest hashes of doc_id among rows of the training fold; of rows that repeat
a doc_id the least text teaches.

Edge cases: a text that is null or has no letter is `und` with score 0; null
langs teach nothing; without any lang every text is `und`; one lang is always
predicted, with score 1; equal losses go to the language first by code point;
repeated rows get equal answers; null doc_ids are in the fold of the empty text
and may teach as one document; extra columns are ignored; an empty table gives no
rows; very long texts are read in blocks of BLOCK bytes, n-grams across their
edges included.
"""

from __future__ import annotations

import codecs

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fronda.llm import common as C
from fronda.llm.quality_rules import _sums

SAMPLE = 2048
FOLDS, HELD_OUT = 4, 2
DIMS_LOG2 = 13
GRAMS = (2, 3, 4)
EPOCHS = 30
AMBIGUOUS = 0.5
SCALE = 30.0
BLOCK = 1 << 16
FIXED = 1 << 20  # steps of a weight
SEED = 7

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CLEAN = C.LOWER.copy()
_CLEAN[[b for b in range(128) if not _LETTER[b]]] = 0x20


def codewords(n: int, seed: int = SEED) -> np.ndarray:
    """n codewords of +-1."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = (1 << (n - 1)) - 1
        return np.array([[1.0 if i == 0 else 1 - 2.0 * ((b + 1) >> (i - 1) & 1) for b in range(bits)] for i in range(n)])
    rng, best, width = np.random.default_rng(seed), None, int(np.ceil(10 * np.log2(n)))
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (n, width))
        code[0, np.abs(code.sum(axis=0)) == n] *= -1
        apart = (width - code @ code.T) / 2
        np.fill_diagonal(apart, width)
        if best is None or apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


def grams(data: np.ndarray, ends: np.ndarray, low: int, high: int):
    """For each n-gram length: hashed feature of every position in [low, high), and which n-grams lie within a text; ends: end of each of these positions' texts."""
    reach, size = max(GRAMS) - 1, high - low
    b = np.zeros(size + reach, np.uint32)
    part = _CLEAN[data[low : high + reach]]
    b[: len(part)] = part
    left = ends - np.arange(low, high)
    code = b[:size].copy()
    for n in range(2, max(GRAMS) + 1):
        code |= b[n - 1 : size + n - 1] << np.uint32(8 * (n - 1))
        if n in GRAMS:
            with np.errstate(over="ignore"):
                h = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
                h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            yield h >> np.uint32(32 - DIMS_LOG2), left >= n


def _any_letter(raw: np.ndarray) -> bool:
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    return any(c.isalpha() for i in range(0, len(raw), BLOCK) for c in decoder.decode(raw[i : i + BLOCK].tobytes()))


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = _sums(lambda a, b: _LETTER[data[a:b]], offsets) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = _any_letter(data[offsets[i] : offsets[i + 1]])
    return found


class Model:
    def __init__(self, langs: list[str], code: np.ndarray, weight: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.weight, self.bias, self.trust = langs, code, weight, bias, trust

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, bits = len(offsets) - 1, self.weight.shape[1]
        steps = np.rint(self.weight * FIXED).astype(np.int32)
        total, count = np.zeros((n, bits), np.int64), np.zeros(n, np.int64)
        for low in range(0, len(data), BLOCK):
            high = min(len(data), low + BLOCK)
            doc = np.searchsorted(offsets, np.arange(low, high), "right") - 1
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            for feature, inside in grams(data, offsets[doc + 1], low, high):
                value = steps[feature]
                value[~inside] = 0
                total[doc[first]] += np.add.reduceat(value, first, axis=0, dtype=np.int64)
                count += np.bincount(doc[inside], minlength=n)
        return SCALE / FIXED * total / np.maximum(count, 1)[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score and whether another is nearly as good."""
        loss = np.stack([(np.logaddexp(0, -margins * word) * self.trust).sum(axis=1) for word in self.code], axis=1)
        best = loss.argmin(axis=1)
        odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
        score = 1 / odds.sum(axis=1)
        second = np.partition(loss, 1, axis=1)[:, 1] - loss.min(axis=1) if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, score, second < AMBIGUOUS


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = SEED) -> Model:
    """rows: language, features and frequencies of each training text."""
    langs = sorted({r[0] for r in rows})
    code, dims = codewords(len(langs)), 1 << DIMS_LOG2
    weight, bias = np.zeros((dims, code.shape[1])), np.zeros(code.shape[1])
    if len(langs) < 2:
        return Model(langs, code, weight.astype(np.float32), bias, np.ones(code.shape[1]))
    rng = np.random.default_rng(seed)
    target = code[[langs.index(r[0]) for r in rows]]

    def dense(at):
        x = np.zeros((len(at), dims), np.float32)
        for k, i in enumerate(at):
            x[k, rows[i][1]] = rows[i][2]
        return x * np.float32(SCALE)

    m, v, step = np.zeros_like(weight), np.zeros_like(weight), 0
    mb, vb = np.zeros_like(bias), np.zeros_like(bias)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 256):
            at = order[i : i + 256]
            x, y, step = dense(at), target[at], step + 1
            g = -y / (1 + np.exp(np.clip(y * (x @ weight + bias), -50, 50))) / len(at)
            gw, gb = x.T @ g + 1e-6 * weight, g.sum(axis=0)
            m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
            rate = 0.05 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            weight -= rate * m / (np.sqrt(v) + 1e-8)
            bias -= rate * mb / (np.sqrt(vb) + 1e-8)
    right = np.zeros(code.shape[1])
    for i in range(0, len(rows), 256):
        at = np.arange(i, min(i + 256, len(rows)))
        right += ((dense(at) @ weight + bias) * target[at] > 0).sum(axis=0)
    wrong = np.clip(1 - right / len(rows), 1e-3, 0.499)
    trust = np.log((1 - wrong) / wrong)
    return Model(langs, code, weight.astype(np.float32), bias, trust / trust.mean())


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (C.fold("doc_id", FOLDS) != HELD_OUT))
    counts = taught.groupBy("lang").agg(F.count("*").alias("n"))
    each = max(1, sample // max(1, counts.count()))
    # ids first, so that the sort carries no texts; of a language only hashes low enough for about 4 * each rows are ranked
    place = F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5
    low = taught.select("doc_id", "lang").join(F.broadcast(counts), "lang").filter(place * F.col("n") <= 4 * each)  # one row a language
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = low.select("doc_id", "lang").distinct().withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= each).select(F.col("doc_id").alias("c_id"), "lang")

    def run(batches):
        for batch in batches:
            data, offsets = C.text_buffer(batch.column("text"))
            features, values = [], []
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                total = np.zeros(1 << DIMS_LOG2, np.int64)
                for a in range(i, j, BLOCK):
                    b = min(a + BLOCK, j)
                    for feature, inside in grams(data, np.full(b - a, j), a, b):
                        total += np.bincount(feature[inside], minlength=len(total))
                at = np.flatnonzero(total)
                features.append(at.astype(np.uint16).tobytes())
                values.append((total[at] / max(1, total.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(features, pa.binary()), pa.array(values, pa.binary())], ["lang", "features", "counts"])

    # at most `sample` ids go to every executor, and at most `sample` sparse rows to the driver
    chosen = taught.join(F.broadcast(ids.withColumnRenamed("lang", "c_lang")), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("lang") == F.col("c_lang")))
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = chosen.select("lang", "text").mapInArrow(run, "lang string, features binary, counts binary")
    # six bytes a feature of `sample` texts
    found = sorted((r["lang"], bytes(r["features"]), bytes(r["counts"])) for r in rows.collect())
    return fit([(lang, np.frombuffer(f, np.uint16), np.frombuffer(v, np.float32)) for lang, f, v in found])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row."""

    def run(batches):
        for batch in batches:
            data, offsets = C.text_buffer(batch.column("text"))
            for i, j in C.slices(offsets, C.SCAN_BYTES):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                known = has_letter(part, at)
                if model.langs:
                    best, score, ambiguous = model.decode(model.margins(part, at))
                    pred = np.where(known, np.array(model.langs, object)[best], "und")
                else:
                    pred, score, ambiguous = np.full(j - i, "und", object), np.zeros(j - i), np.zeros(j - i, bool)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(ambiguous & known)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs))
    return found.select("doc_id", (C.fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "ambiguous")
