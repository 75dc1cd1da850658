"""Shared pieces: the scratch folder and the vectorised word scanner.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, so a word never
splits a UTF-8 character.  All scanning is done on whole Arrow buffers; byte
work arrays are bounded by SCAN_BYTES, not by the length of a text; what is kept
of a long text are arrays of a few numbers a word.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCAN_BYTES = 1 << 20
SLICE_BYTES = 4 << 20

# ---------------------------------------------------------------- scratch


class Scratch:
    """Written tables in the folder that driver and executors share."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/fronda-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` as Parquet and read it back: a lineage cut that survives lost executors."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where that is unset and everything runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark.sparkContext, "_fronda_scratch", None) or f"file://{tempfile.mkdtemp(prefix='fronda')}"
        spark.sparkContext._fronda_scratch = found
    return found.rstrip("/")


def partitions(spark: SparkSession) -> int:
    """Buckets to deal work into: the session's shuffle partitions, which a cluster sizes to its data."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod `modulus`; null ids count as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


# ---------------------------------------------------------------- Arrow text


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary()).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `limit` bytes each (a longer text comes alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n + 1 word offsets of the texts."""
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, len(data), SCAN_BYTES):
        high = min(len(data), low + SCAN_BYTES)
        # one byte more on each side tells whether a word goes on
        solid = np.zeros(high - low + 2, bool)
        a, b = max(low - 1, 0), min(high + 1, len(data))
        np.logical_not(WHITE[data[a:b]], out=solid[a - low + 1 : b - low + 1])
        edge = np.zeros(high - low + 1, bool)
        edge[offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high, "right")] - low] = True
        own = solid[1:-1]
        starts.append(np.flatnonzero(own & (~solid[:-2] | edge[:-1])) + low)
        ends.append(np.flatnonzero(own & (~solid[2:] | edge[1:])) + low + 1)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.searchsorted(starts, offsets)


# ---------------------------------------------------------------- hashing

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, SCAN_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, U64(base))
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z lower-cased), computed with prefix sums."""
    out = np.empty(len(starts), U64)
    table = _TABLE[LOWER] if lower else _TABLE
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + SCAN_BYTES, "right"))
        if j <= i:  # a word longer than a block: the same sum, block by block
            total, scale, power = 0, 1, _powers(SCAN_BYTES)[0][:SCAN_BYTES]
            for low in range(int(starts[i]), int(ends[i]), SCAN_BYTES):
                part = table[data[low : min(low + SCAN_BYTES, int(ends[i]))]]
                total += int((part * power[: len(part)]).sum()) * scale
                scale = scale * pow(_BASE, SCAN_BYTES, 1 << 64) % (1 << 64)
            out[i] = mix(np.array([(total + int(ends[i] - starts[i]) * 0xD6E8FEB86659FD93) % (1 << 64)], U64))[0]
            i += 1
            continue
        low, high = int(starts[i]), int(ends[j - 1])
        power, inverse = _powers(high - low)
        sums = np.empty(high - low + 1, U64)
        sums[0] = 0
        np.cumsum(table[data[low:high]] * power[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (ends[i:j] - starts[i:j]).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def window_hashes(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `width`-word windows within texts, and their n + 1 offsets.

    A text with fewer words (but at least one) has one window: all its words.
    """
    counts = np.diff(offsets)
    whole = np.maximum(counts - width + 1, (counts > 0).astype(counts.dtype))
    ends = np.zeros(len(offsets), np.int64)
    np.cumsum(whole, out=ends[1:])
    if not ends[-1]:
        return np.zeros(0, U64), ends
    first = np.repeat(offsets[:-1] - ends[:-1], whole) + np.arange(ends[-1])
    last = np.repeat(offsets[1:], whole)
    out = np.full(ends[-1], U64(width))
    for k in range(width):
        at = first + k
        inside = at < last
        out = mix(out * U64(0x9E3779B97F4A7C15) + np.where(inside, hashes[np.minimum(at, len(hashes) - 1)], U64(0)))
    return out, ends


def crc32_fold(doc_id, modulus: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus
