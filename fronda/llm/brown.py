"""LM scoring (operator 1): Brown class-based bigrams.

P(w | v) = (1 - u) * P(class(w) | class(v)) * count(w) / count(class(w)) for words
seen in training, and u, the Good-Turing mass of single words, for any other.
Transitions are smoothed towards the class's share of tokens; every text starts
and ends with the end token, a class of its own.

Classes come from exchange clustering.  All training bigrams, counted over the
whole corpus, are stored by their second word.  In each round a worker tries
every class for each of its words, with the word's own counts taken out of the
class it is in, and moves the word to the class of the largest likelihood; half
of the words may move in a round, since all workers move at once.  Every training
word has a class of its own: words are numbered without gaps in the order of their
hashes (place in the hash range, plus the words of the ranges before), and the class
map, one byte a distinct training word, grows with the vocabulary.

Texts are read once, into packed chunks of word codes.  Counts of a chunk's
distinct words are exchanged by hash range: no words, hashes or counts are ever
broadcast or collected, only the classes.  Words are known by a 64-bit hash of
their bytes, and there may be fewer than 2 ** 32 of them.

Edge cases: a null or empty text is one end token; null doc_ids belong to the
fold of the empty text; ties between classes go to the lower number; repeated
rows count each and score alike; without training tokens both scores are 0;
extra columns are ignored; an empty table gives no rows; very long texts make
larger chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fronda.llm import common as C
from fronda.llm.common import U64, Scratch, partitions

FOLDS = 10
CLASSES = 64
ROUNDS = 6
CHUNK_WORDS = 1 << 20
SMOOTH = 50.0
END, UNKNOWN, N_CLASSES = CLASSES, CLASSES + 1, CLASSES + 2
TREE = 16
END_SLOT = 1 << 22  # the end in class maps made by hand; score_texts numbers it after the words


def _zip(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unzip(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind) if b else np.zeros(0, kind)


def _delta(keys: np.ndarray) -> bytes:
    """Sorted keys as zipped differences."""
    return _zip(np.diff(keys, prepend=U64(0)))


def _keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unzip(b, U64), dtype=U64)


_CHUNK = "chunk long, ids binary, nulls binary, train binary, at binary, words binary, codes binary, counts binary"


def encode(docs: DataFrame) -> DataFrame:
    """Packed chunks: ids and word offsets of the texts, sorted distinct word hashes, codes into them, training counts."""
    ids = F.col("doc_id").cast("long")
    rows = docs.select(ids.alias("doc_id"), F.col("text").cast("string").alias("text"), (C.fold(ids, FOLDS) != 0).alias("train"))

    def run(batches):
        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal seq, held, n
            hashes = np.concatenate([h[3] for h in held])
            sizes = np.concatenate([h[4] for h in held])
            train = np.concatenate([h[2] for h in held])
            words, codes = np.unique(hashes, return_inverse=True)
            counts = np.bincount(codes[np.repeat(train, sizes)], minlength=len(words))
            row = {
                "chunk": pa.array([(part << 20) + seq], pa.int64()),
                "ids": [np.concatenate([h[0] for h in held]).astype(np.int64).tobytes()],
                "nulls": [np.concatenate([h[1] for h in held]).astype(np.uint8).tobytes()],
                "train": [train.astype(np.uint8).tobytes()],
                "at": [_zip(np.append(0, np.cumsum(sizes)).astype(np.int64))],
                "words": [_delta(words)],
                "codes": [_zip(codes.astype(np.uint32))],
                "counts": [_zip(counts.astype(np.int64))],
            }
            seq, held, n = seq + 1, [], 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            data, offsets = C.text_buffer(batch.column("text"))
            doc_ids = batch.column("doc_id")
            values, nulls = doc_ids.fill_null(0).to_numpy(zero_copy_only=False), doc_ids.is_null().to_numpy(zero_copy_only=False)
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for i, j in C.slices(offsets):
                part_data = data[offsets[i] : offsets[j]]
                starts, ends, at = C.words(part_data, offsets[i : j + 1] - offsets[i])
                held.append((values[i:j], nulls[i:j], train[i:j], C.word_hashes(part_data, starts, ends), np.diff(at)))
                n += len(starts) + (j - i)
                if n >= CHUNK_WORDS:
                    yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(run, _CHUNK)


def _range_of(words: np.ndarray, buckets: int) -> np.ndarray:
    """Offsets of the hash ranges in sorted word hashes."""
    edge = (np.arange(buckets + 1, dtype=object) << 64) // buckets
    return np.append(np.searchsorted(words, np.array([int(e) for e in edge[:-1]], U64)), len(words))


def count_words(chunks: DataFrame, buckets: int, n: int) -> DataFrame:
    """For each chunk and hash range, the corpus counts of the chunk's words and their places among the range's training words; for each range (chunk null) its totals and the places of its most frequent words."""

    def ask(batches):
        for batch in batches:
            for chunk, words, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "counts")), strict=True):
                words, counts = _keys(words), _unzip(counts, np.int64)
                at = _range_of(words, buckets)
                some = [b for b in range(buckets) if at[b] < at[b + 1]]
                for i in range(0, len(some), 256):
                    own = some[i : i + 256]
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array(own, pa.int64()), "chunk": pa.array([chunk] * len(own), pa.int64()), "words": [_delta(words[at[b] : at[b + 1]]) for b in own], "counts": [_zip(counts[at[b] : at[b + 1]]) for b in own]})

    def answer(batches):
        met: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                met.setdefault(r["bucket"], []).append((r["chunk"], r["words"], r["counts"]))
        none = pa.nulls(1, pa.int64())
        while met:
            bucket, parts = met.popitem()
            keys = [_keys(p[1]) for p in parts]
            words, where = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(where, np.concatenate([_unzip(p[2], np.int64) for p in parts]).astype(float), len(words)).astype(np.int64)
            place = np.cumsum(total > 0) - (total > 0)
            top = np.argsort(-total, kind="stable")[:CLASSES]
            top = top[total[top] > 0]
            yield pa.RecordBatch.from_arrays([none, pa.array([bucket]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([int(total.sum())]), pa.array([int((total > 0).sum())]), pa.array([int((total == 1).sum())]), pa.array([place[top].astype(U64).tobytes()], pa.binary()), pa.array([total[top].tobytes()], pa.binary())], _COUNTED)
            at = 0
            for (chunk, _, _), own in zip(parts, keys, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([bucket]), pa.array([_zip(total[where[at : at + len(own)]])], pa.binary()), pa.array([_delta(place[where[at : at + len(own)]].astype(U64))], pa.binary()), none, none, none, pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], _COUNTED)
                at += len(own)

    asked = chunks.select("chunk", "words", "counts").mapInArrow(ask, "bucket long, chunk long, words binary, counts binary")
    return asked.repartition(n, "bucket").mapInArrow(answer, "chunk long, bucket long, counts binary, places binary, tokens long, types long, single long, top_places binary, top_counts binary")


_COUNTED = ["chunk", "bucket", "counts", "places", "tokens", "types", "single", "top_places", "top_counts"]


def _answers(rows: list[dict], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts and numbers of a chunk's words, in their order; first: number of each range's first word."""
    rows = sorted(rows, key=lambda r: r["bucket"])
    known = np.concatenate([_unzip(r["counts"], np.int64) for r in rows] or [np.zeros(0, np.int64)])
    numbers = np.concatenate([_keys(r["places"]).astype(np.int64) + first[r["bucket"]] for r in rows] or [np.zeros(0, np.int64)])
    return known, numbers


def count_bigrams(chunks: DataFrame, answers: DataFrame, first: np.ndarray, buckets: int, n: int) -> DataFrame:
    """Training bigrams by number of the second word: keys second << 32 | first, and counts, for each range of numbers; the end comes after the words."""
    end = int(first[-1])

    def merged(keys, counts):
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], (np.add.reduceat(counts, first) if len(first) else counts)

    bounds = [(b * (end + 1) + buckets - 1) // buckets << 32 for b in range(buckets)]

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        numbers = _answers(right.to_pylist(), first)[1].astype(U64)
        for r in left.to_pylist():
            at, train = _unzip(r["at"], np.int64), np.frombuffer(r["train"], np.uint8).astype(bool)
            sizes = np.diff(at)
            # every text with an end before and after it
            line = np.full(at[-1] + 2 * len(sizes), U64(end))
            place = np.arange(at[-1]) + 2 * np.repeat(np.arange(len(sizes)), sizes) + 1
            line[place] = numbers[_unzip(r["codes"], np.uint32)]
            use = np.ones(len(line), bool)
            begin = at[:-1] + 2 * np.arange(len(sizes))
            use[begin] = False
            use &= np.repeat(train, sizes + 2)
            second = np.flatnonzero(use)
            keys, counts = np.unique((line[second] << U64(32)) | line[second - 1], return_counts=True)
            edge = np.append(np.searchsorted(keys, np.array(bounds, U64)), len(keys))
            own = [b for b in range(buckets) if edge[b] < edge[b + 1]]
            out.append(pa.table({"bucket": pa.array(own, pa.int64()), "keys": pa.array([_delta(keys[edge[b] : edge[b + 1]]) for b in own], pa.binary()), "counts": pa.array([_zip(counts[edge[b] : edge[b + 1]].astype(np.int64)) for b in own], pa.binary())}))
        return pa.concat_tables(out) if out else pa.table({"bucket": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})

    def join(batches):
        met: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                met.setdefault(r["bucket"], []).append((r["keys"], r["counts"]))
        while met:
            bucket, parts = met.popitem()
            keys, counts = merged(np.concatenate([_keys(p[0]) for p in parts]), np.concatenate([_unzip(p[1], np.int64) for p in parts]))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "keys": [_delta(keys)], "counts": [_zip(counts)]})

    asked = chunks.select("chunk", "train", "at", "codes").groupBy("chunk").cogroup(answers.select("chunk", "bucket", "counts", "places").groupBy("chunk")).applyInArrow(ask, "bucket long, keys binary, counts binary")
    return asked.repartition(n, "bucket").mapInArrow(join, "bucket long, keys binary, counts binary")


def contexts(keys: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second words, and how often each class precedes each of them."""
    second, first = keys >> U64(32), keys & U64((1 << 32) - 1)
    words, row = np.unique(second, return_inverse=True)
    cell = row * N_CLASSES + classes[first.astype(np.int64)]
    return words.astype(np.int64), np.bincount(cell, counts.astype(float), len(words) * N_CLASSES).reshape(-1, N_CLASSES)


def exchange(words: np.ndarray, seen: np.ndarray, classes: np.ndarray, table: np.ndarray, turn: int) -> np.ndarray:
    """Best class of each word; seen: its class contexts; table[c, b]: how often class b follows class c."""
    now = classes[words].astype(np.int64)
    own = seen.sum(axis=1)
    size = table.sum(axis=0)
    score = seen @ np.log(table[:, :CLASSES] + 0.5) - own[:, None] * np.log(size[:CLASSES] + 0.5 * N_CLASSES)
    rows = np.flatnonzero(now < CLASSES)
    # its own class without it
    without = np.maximum(table[:, now[rows]].T - seen[rows], 0)
    score[rows, now[rows]] = (seen[rows] * np.log(without + 0.5)).sum(axis=1) - own[rows] * np.log(np.maximum(size[now[rows]] - own[rows], 0) + 0.5 * N_CLASSES)
    best = score.argmax(axis=1)
    stay = (now >= CLASSES) | ((words * 0x9E3779B1 >> 7) % 2 != turn % 2)
    return np.where(stay, now, best).astype(np.uint8)


def cluster(bigrams: DataFrame, end: int, top: list[int], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of every training word and of the end, and the table of class transitions; end: how many words; top: numbers of the most frequent."""
    context = bigrams.sparkSession.sparkContext
    classes = (C.mix(np.arange(end + 1, dtype=U64)) % U64(CLASSES)).astype(np.uint8)
    classes[top[:CLASSES]] = np.arange(min(len(top), CLASSES))
    classes[end] = END

    def count(shared) -> np.ndarray:
        def run(batches):
            total, part = np.zeros((N_CLASSES, N_CLASSES)), TaskContext.get().partitionId()
            for batch in batches:
                for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    words, seen = contexts(_keys(keys), _unzip(counts, np.int64), shared.value)
                    for k in np.unique(shared.value[words]):
                        total[:, k] += seen[shared.value[words] == k].sum(axis=0)
            yield pa.RecordBatch.from_pydict({"at": pa.array([part % TREE], pa.int64()), "table": pa.array([total.ravel()], pa.list_(pa.float64()))})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"table": [np.sum(np.stack(pdf.table.to_numpy()), axis=0)]})

        # TREE tables of N_CLASSES ** 2 numbers reach the driver
        parts = bigrams.select("keys", "counts").mapInArrow(run, "at long, table array<double>").groupBy("at").applyInPandas(add, "table array<double>").collect()
        return np.sum([np.array(p["table"]) for p in parts], axis=0).reshape(N_CLASSES, N_CLASSES) if parts else np.zeros((N_CLASSES, N_CLASSES))

    def move(shared, table, turn) -> None:
        def run(batches):
            for batch in batches:
                for bucket, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "counts")), strict=True):
                    words, seen = contexts(_keys(keys), _unzip(counts, np.int64), shared.value)
                    # every word is the second of some bigram, so a range has no gaps
                    yield pa.RecordBatch.from_pydict({"first": pa.array([words[0]], pa.int64()), "classes": [_zip(exchange(words, seen, shared.value, table, turn))]})

        # at most a byte a word reaches the driver
        for r in bigrams.mapInArrow(run, "first long, classes binary").collect():
            new = _unzip(r["classes"], np.uint8)
            classes[r["first"] : r["first"] + len(new)] = new

    for turn in range(rounds):
        shared = context.broadcast(classes.copy())
        move(shared, count(shared), turn)
        shared.unpersist()
    shared = context.broadcast(classes.copy())
    table = count(shared)
    shared.unpersist()
    return classes, table


def transitions(table: np.ndarray) -> np.ndarray:
    """log10 P(class b | class c); an unknown word before leaves the class's share of all tokens."""
    share = table.sum(axis=0) + 0.5
    share[UNKNOWN] = 0
    share /= share.sum()
    rows = (table + SMOOTH * share) / (table.sum(axis=1, keepdims=True) + SMOOTH)
    rows[UNKNOWN] = share
    rows[:, UNKNOWN] = 1
    return np.log10(rows)


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score_texts(docs: DataFrame) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score (log10 probability of the text) of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    n = partitions(spark)
    chunks = scratch.save(encode(docs), "chunks")
    buckets = 2 * n
    counted = scratch.save(count_words(chunks, buckets, n), "counted")
    totals = counted.filter(F.col("chunk").isNull()).agg(F.sum("tokens"), F.sum("types"), F.sum("single")).first()
    tops = counted.filter(F.col("chunk").isNull()).select("bucket", "types", "top_places", "top_counts").collect()  # CLASSES words a hash range
    in_range = np.zeros(buckets + 1, np.int64)
    for r in tops:
        in_range[r["bucket"] + 1] = r["types"]
    first = np.cumsum(in_range)
    if first[-1] >= 1 << 32:
        raise ValueError("more distinct words than 32 bits can number")
    best: list[tuple[int, int]] = []
    for r in tops:
        best += [(-int(c), int(w) + int(first[r["bucket"]])) for w, c in zip(np.frombuffer(r["top_places"], U64), np.frombuffer(r["top_counts"], np.int64), strict=True)]
        best = sorted(best)[:CLASSES]
    ends = docs.select((C.fold(F.col("doc_id").cast("long"), FOLDS) != 0).cast("long").alias("t")).agg(F.sum("t")).first()[0] or 0
    tokens, types, single = (int(v or 0) for v in totals)
    tokens, types = tokens + ends, types + (ends > 0)
    answers = counted.filter(F.col("chunk").isNotNull()).select("chunk", "bucket", "counts", "places")
    bigrams = scratch.save(count_bigrams(chunks, answers, first, max(64, 2 * n), n), "bigrams")
    classes, table = cluster(bigrams, int(first[-1]), [w for _, w in best])
    scratch.drop("bigrams")
    unknown = (single + 0.5) / (tokens + 1) if tokens else 1.0
    step = transitions(table)
    size = table.sum(axis=0)
    shared = spark.sparkContext.broadcast(classes)  # one byte a distinct training word
    below = tokens + 0.1 * (types + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        known, numbers = _answers(right.to_pylist(), first)
        for r in left.to_pylist():
            codes, at = _unzip(r["codes"], np.uint32), _unzip(r["at"], np.int64)
            kind = np.where(known > 0, shared.value[numbers], UNKNOWN).astype(np.int64)
            with np.errstate(divide="ignore"):
                emit = np.where(known > 0, np.log10((1 - unknown) * np.maximum(known, 1) / np.maximum(size[kind], 1)), np.log10(unknown))
            base = np.log10((known + 0.1) / below)
            sizes = np.diff(at)
            line = np.full(at[-1] + 2 * len(sizes), END)
            line[np.arange(at[-1]) + 2 * np.repeat(np.arange(len(sizes)), sizes) + 1] = kind[codes]
            begin = at[:-1] + 2 * np.arange(len(sizes))
            way = np.zeros(len(line))
            way[1:] = step[line[:-1], line[1:]]
            way[begin] = 0
            way[line == END] += np.log10(1 - unknown) if unknown < 1 else 0.0
            way[begin] = 0
            total = np.add.reduceat(way, begin) if len(begin) else np.zeros(0)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            sums = lambda v: np.bincount(doc, v, len(sizes))
            scores = total + sums(emit[codes]) if tokens else np.zeros(len(sizes))
            ids = pa.array(np.frombuffer(r["ids"], np.int64), mask=np.frombuffer(r["nulls"], np.uint8).astype(bool))
            own = (sums((known > 0)[codes]) + (ends > 0)).astype(np.int64)
            out.append(pa.table([ids, pa.array(sizes + 1), pa.array(own), pa.array(sums(base[codes]) + np.log10((ends + 0.1) / below)), pa.array(scores)], ["doc_id", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})

    scored = chunks.select("chunk", "ids", "nulls", "at", "codes").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, SCORED)
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return scored.select("doc_id", (C.fold("doc_id", FOLDS) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", perplexity.alias("perplexity"))
