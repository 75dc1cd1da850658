"""N-gram Jaccard join (operator 6) by PartEnum signatures.

A document's set is its distinct shingles of WIDTH words (hashed to 64 bits).
Sizes fall into bands that grow by 1 / 0.8, so partners lie in one band or the
next; a set carries the signatures of its own band and of the band below.  Sets
a and b of one band's pairs with Jaccard similarity of 0.8 or more differ in at
most K = (|a| + |b|) / 9 shingles.  Shingles are dealt by hash to N1 first-level
parts; K + 1 <= 2 N1 makes some part differ in at most one shingle.  Each part
has three second-level parts, and every subset of two is a signature: at most one
is touched by that shingle, so the sets share one.  A signature tells something if
it holds a shingle that is not common (COMMON_ROWS or more of a bounded sample
of SAMPLE documents; any list would give the same links).  Others are left out:
if w parts of a set have a signature that tells nothing, 2 (N1 - w) > K keeps
some telling one shared, whatever the partner.  Sets for which that fails also
carry the shingles of their prefix, |a| - ceil(0.8 |a|) + 1 of them with the
uncommon first, of which two such sets within the threshold share one.

Signatures travel as packed arrays, dealt by hash.  Equal ones give all pairs of
at most RUN documents, else a star.  A pair is dropped if the parity bitmaps of
its sets differ in more places than the sets may (a proof, never a guess).  Each
connected group of what is left is then resolved exactly on the sets themselves
(groups beyond BLOCK sets by pairs of blocks), so no link is lost and none is
assumed.  Equal sets are one node throughout.

Edge cases: a null or empty text has no shingles and links with nothing; a text
with fewer words is one shingle; repeated rows are linked as equal sets; rows
with a null doc_id join equal sets only, and never name a group that has an id;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fronda.llm import common as C
from fronda.llm.common import U64, Scratch, mix, partitions
from fronda.llm.components import components

WIDTH = 5
NUMERATOR, DENOMINATOR = 80, 100
PARTS = 3  # second-level parts; signatures cover PARTS - 1 of them
SLACK = 0.12  # first-level parts beyond the least number
FLUSH = 500_000  # signatures a task packs at once
BLOCK = 1536  # sets resolved together
FILTER_BITS = 1 << 24
RUN = 16  # documents of one signature that are paired with each other
SAMPLE = 16_384
COMMON_ROWS = 3
COMMON = 200_000  # most common shingles that are told apart

_EDGES = np.array([(DENOMINATOR / NUMERATOR) ** i for i in range(120)])


def _limits() -> tuple[np.ndarray, np.ndarray]:
    """For each band: the largest difference of a pair whose smaller set is in it, and its number of first-level parts."""
    top = np.ceil(_EDGES[1:]) - 1
    partner = np.floor(top * DENOMINATOR / NUMERATOR)
    # |a| + |b| - 2 o with o / (|a| + |b| - o) >= t
    t = NUMERATOR / DENOMINATOR
    most = np.floor((top + partner) * (1 - t) / (1 + t) + 1e-9)
    least = np.floor(most / 2) + 1
    parts = least + np.ceil(SLACK * least)
    return np.minimum(most, 2**40).astype(np.int64), np.minimum(parts, 2**40).astype(np.int64)


MOST, FIRST = _limits()


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts and their n + 1 offsets."""
    starts, ends, at = C.words(data, offsets)
    shingles, s_at = C.window_hashes(C.word_hashes(data, starts, ends), at, WIDTH)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(s_at))
    keyed = mix(shingles ^ mix(doc.astype(U64)))
    order = np.argsort(keyed, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = keyed[order][1:] != keyed[order][:-1]
    keep = np.zeros(len(order), bool)
    keep[order[first]] = True
    counts = np.bincount(doc[keep], minlength=len(offsets) - 1)
    return shingles[keep], np.append(0, np.cumsum(counts))


def digests(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit digest a set."""
    sums = np.zeros(len(at), U64)
    total = np.append(U64(0), np.cumsum(mix(sets)))
    sums = total[at[1:]] - total[at[:-1]]
    return mix(sums + np.diff(at).astype(U64) * U64(0x9E3779B97F4A7C15))


def signatures(sets: np.ndarray, at: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of the set and 64-bit key of every signature; common: sorted hashes of common shingles."""
    size = np.diff(at)
    band = np.searchsorted(_EDGES, size, "right") - 1
    telling = np.ones(len(sets), bool)
    if common is not None and len(common):
        telling = common[np.minimum(np.searchsorted(common, sets), len(common) - 1)] != sets
    unsure = np.zeros(len(size), bool)
    who_all, key_all = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for below in (0, 1):
        tag = band - below
        use = (size > 0) & (tag >= 0)
        tag = np.where(use, tag, 0)
        use &= MOST[tag] > 0  # without any difference the sets are equal, and one node
        if not use.any():
            continue
        n1 = np.where(use, FIRST[tag], 0)
        cell_at = np.append(0, np.cumsum(n1 * PARTS))
        doc = np.repeat(np.arange(len(size)), size)
        member = use[doc]
        doc, h = doc[member], mix(sets[member] + U64(0x1234567))
        first = ((h >> U64(33)) * n1[doc].astype(U64)) >> U64(31)
        second = (h & U64(0xFFFF)) * U64(PARTS) >> U64(16)
        cell = cell_at[doc] + (first * U64(PARTS) + second).astype(np.int64)
        g = mix(h ^ U64(0x5DEECE66D))
        n_cells = int(cell_at[-1])
        low = np.bincount(cell, (g & U64(0xFFFFFFFF)).astype(np.float64), n_cells).astype(U64)
        high = np.bincount(cell, (g >> U64(32)).astype(np.float64), n_cells).astype(U64)
        sums = (low + (high << U64(32))).reshape(-1, PARTS)
        count = np.bincount(cell, telling[member], n_cells).reshape(-1, PARTS)
        part_doc = np.repeat(np.arange(len(size)), n1)
        part_no = np.arange(len(part_doc)) - np.repeat(np.append(0, np.cumsum(n1))[:-1], n1)
        mute = np.stack([count.sum(axis=1) - count[:, j] == 0 for j in range(PARTS)], axis=1)
        weak = np.bincount(part_doc, mute.any(axis=1), len(size))
        unsure |= use & (2 * (n1 - weak) <= MOST[tag])
        for j in range(PARTS):
            keep = ~mute[:, j]
            rest = [i for i in range(PARTS) if i != j]
            key = mix(sums[:, rest[0]] + U64(0x9E3779B97F4A7C15)) + mix(sums[:, rest[1]] + U64(0x7F4A7C159E3779B9))
            name = (tag[part_doc] << 40).astype(U64) + (part_no.astype(U64) << U64(2)) + U64(j)
            key_all.append(mix(key ^ mix(name))[keep])
            who_all.append(part_doc[keep])
    for i in np.flatnonzero(unsure):
        own, plain = sets[at[i] : at[i + 1]], ~telling[at[i] : at[i + 1]]
        n = len(own)
        prefix = own[np.lexsort((own, plain))][: n - -(-NUMERATOR * n // DENOMINATOR) + 1]
        key_all.append(mix(prefix ^ U64(0xC0FFEE1234567)))
        who_all.append(np.full(len(prefix), i))
    return np.concatenate(who_all), np.concatenate(key_all)


def _bits(size: np.ndarray) -> np.ndarray:
    """Length of the parity bitmap of a set: a power of two, 2 to 4 bits a shingle, 64 at least."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1) * 2)).astype(np.int64))


def parities(sets: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set, which bits an odd number of its shingles fall on."""
    size = np.diff(at)
    bits = _bits(size)
    begin = np.append(0, np.cumsum(bits))
    doc = np.repeat(np.arange(len(size)), size)
    place = begin[doc] + (mix(sets ^ U64(0xABCDEF0123)) & (bits[doc] - 1).astype(U64)).astype(np.int64)
    odd = (np.bincount(place, minlength=int(begin[-1])) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little")
    return [packed[a // 8 : b // 8].tobytes() for a, b in itertools.pairwise(begin.tolist())]


def may_link(n_a: int, n_b: int, a: bytes, b: bytes) -> bool:
    """False only if sets of these sizes and parity bitmaps differ too much: every differing bit is a differing shingle."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    most = (n_a + n_b) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
    return abs(n_a - n_b) <= most and int(np.bitwise_count(x ^ y).sum()) <= most


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of at most COMMON shingles that occur in COMMON_ROWS or more of SAMPLE documents with different sets."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def run(batches):
        for batch in batches:
            data, offsets = C.text_buffer(batch.column("text"))
            for i, j in C.slices(offsets):
                sets, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                digest = digests(sets, at)
                yield pa.RecordBatch.from_pydict({"digest": pa.array(np.repeat(digest, np.diff(at)).view(np.int64)), "shingle": pa.array(sets.view(np.int64))})

    # at most SAMPLE ids of 8 bytes
    found = rows.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(run, "digest long, shingle long")
    often = found.distinct().groupBy("shingle").count().filter(F.col("count") >= COMMON_ROWS).orderBy(F.col("count").desc(), "shingle").limit(COMMON).select("shingle").toPandas()
    return np.sort(often["shingle"].to_numpy(np.int64).view(U64))


def meetings(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, node) rows, each once: all pairs of at most RUN nodes with one key; else a star round the one of least mixed number."""
    order = np.lexsort((mix(nodes.astype(U64)), keys))
    keys, nodes = keys[order], nodes[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    run = np.diff(np.append(begin, len(keys)))
    pairs, stars = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    for m in range(2, RUN + 1):
        members = nodes[begin[run == m][:, None] + np.arange(m)]
        a, b = np.triu_indices(m, 1)
        pairs.append(np.stack([members[:, a].ravel(), members[:, b].ravel()], axis=1))
    for i in np.flatnonzero(run > RUN):
        own = nodes[begin[i] : begin[i] + run[i]]
        stars.append(np.stack([np.full(len(own) - 1, own[0]), own[1:]], axis=1))
    each = lambda rows: (lambda x: x[x[:, 0] != x[:, 1]])(np.unique(np.sort(np.concatenate(rows), axis=1), axis=0))
    return each(pairs), each(stars)


def linked(sets: list[np.ndarray]) -> list[int]:
    """For each set the number of the first set of its group, by exact links."""
    n = len(sets)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if n < 2:
        return root
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    _, feature = np.unique(np.concatenate(sets), return_inverse=True)
    by_feature = np.argsort(feature, kind="stable")
    owners = owner[by_feature]
    at = np.append(0, np.cumsum(np.bincount(feature)))
    own_at = np.append(0, np.cumsum(size))

    def partners(i: int) -> np.ndarray:
        own = feature[own_at[i] : own_at[i + 1]]
        counts = at[own + 1] - at[own]
        flat = np.repeat(at[own] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
        common = np.bincount(owners[flat], minlength=n)
        return np.flatnonzero(DENOMINATOR * common >= NUMERATOR * (size + size[i] - common))

    # The first set settles its own group's inner links; every other set is asked for all of its links.
    centre = int(np.argmax(np.bincount(owners[np.repeat(np.diff(at) > 1, np.diff(at))], minlength=n)))
    settled = np.zeros(n, bool)
    for j in partners(centre):
        root[find(int(j))] = find(centre)
        settled[j] = True
    settled[centre] = True
    if settled.all():
        return [find(i) for i in range(n)]
    for i in np.flatnonzero(~settled):
        for j in partners(int(i)):
            a, b = find(int(i)), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


_PACKED = "bucket long, kind int, chunk long, a binary, b binary, c binary, d binary, e binary"
_FOUND = "kind int, doc_id long, n_shingles long, digest long, node long, parity binary, shard long, a binary, b binary"


def _pack(docs: DataFrame, buckets: int, common) -> DataFrame:
    """Signatures by bucket and document rows, as packed arrays (one row a task, chunk and bucket)."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        rows: dict[str, list] = {k: [] for k in ("id", "null", "n", "digest", "idx", "parity")}
        keys, who, n_keys = [], [], 0
        nodes: dict[int, int] = {}

        def flush():
            nonlocal seq, n_keys
            chunk = (part << 12) + seq
            cat = lambda k, t: np.concatenate(rows[k]).astype(t).tobytes() if rows[k] else b""
            out = [(chunk % buckets, 0, chunk, cat("id", np.int64), cat("null", np.uint8), cat("n", np.int64), cat("digest", U64) + cat("idx", np.uint16), b"".join(rows["parity"]))]
            if keys:
                key, own = np.concatenate(keys), np.concatenate(who).astype(np.uint16)
                bucket = (key >> U64(32)) % U64(buckets)
                order = np.argsort(bucket, kind="stable")
                key, own, bucket = key[order].astype(np.uint32), own[order], bucket[order]
                at = np.searchsorted(bucket, np.arange(buckets + 1).astype(U64))
                out += [(b, 1, chunk, key[at[b] : at[b + 1]].tobytes(), own[at[b] : at[b + 1]].tobytes(), b"", b"", b"") for b in range(buckets) if at[b] < at[b + 1]]
            for v in (*rows.values(), keys, who):
                v.clear()
            nodes.clear()
            seq, n_keys = seq + 1, 0
            for i in range(0, len(out), 64):
                names = ["bucket", "kind", "chunk", "a", "b", "c", "d", "e"]
                types = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[i : i + 64], strict=True), types, strict=True)], names)

        for batch in batches:
            data, offsets = C.text_buffer(batch.column("text"))
            ids = batch.column("doc_id")
            id_values, id_null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            for i, j in C.slices(offsets):
                if n_keys >= FLUSH or len(nodes) + (j - i) > 65_000:
                    yield from flush()
                # a slice of many short texts is halved until its nodes can be numbered
                for lo in range(i, j, 60_000):
                    hi = min(j, lo + 60_000)
                    if len(nodes) + (hi - lo) > 65_000:
                        yield from flush()
                    sets, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    digest = digests(sets, at)
                    known = len(nodes)
                    idx = np.array([nodes.setdefault(d, len(nodes)) for d in digest.tolist()], np.int64)
                    numbers, first = np.unique(idx, return_index=True)
                    fresh = np.zeros(hi - lo, bool)
                    fresh[first[numbers >= known]] = True
                    own, key = signatures(*_some(sets, at, fresh), common.value)
                    keys.append(key)
                    who.append(idx[np.flatnonzero(fresh)][own])
                    n_keys += len(key)
                    for name, v in (("id", id_values[lo:hi]), ("null", id_null[lo:hi]), ("n", np.diff(at)), ("digest", digest), ("idx", idx)):
                        rows[name].append(v)
                    rows["parity"] += parities(sets, at)
        if rows["id"]:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PACKED)


def _some(sets: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sets[np.repeat(which, np.diff(at))], np.append(0, np.cumsum(np.diff(at)[which]))


def _unpack(shards: int):
    """Document rows (kind 0), and the pairs (1) and stars (2) of a task's equal signatures, packed by shard."""
    names = ["kind", "doc_id", "n_shingles", "digest", "node", "parity", "shard", "a", "b"]
    types = [pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.int64(), pa.binary(), pa.binary()]

    def rows(n: int, **columns):
        full = [columns.get(c, pa.nulls(n, t)) for c, t in zip(names, types, strict=True)]
        for i in range(0, n, 50_000):
            yield pa.RecordBatch.from_arrays([c.slice(i, 50_000) for c in full], names)

    def run(batches):
        met: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 1:
                    nodes = (r["chunk"] << 16) + np.frombuffer(r["b"], np.uint16).astype(np.int64)
                    met.setdefault(r["bucket"], []).append((np.frombuffer(r["a"], np.uint32), nodes))
                    continue
                ids, null, n = np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.uint8).astype(bool), np.frombuffer(r["c"], np.int64)
                digest, idx = np.frombuffer(r["d"][: 8 * len(ids)], np.int64), np.frombuffer(r["d"][8 * len(ids) :], np.uint16).astype(np.int64)
                at = np.append(0, np.cumsum(_bits(n) // 8)).tolist()
                parity = pa.array([r["e"][x:y] for x, y in itertools.pairwise(at)], pa.binary())
                kind = pa.array(np.zeros(len(ids), np.int32))
                yield from rows(len(ids), kind=kind, doc_id=pa.array(ids, mask=null), n_shingles=pa.array(n), digest=pa.array(digest), node=pa.array((r["chunk"] << 16) + idx), parity=parity)
        all_found: list[list[np.ndarray]] = [[], []]
        while met:
            _, parts = met.popitem()
            for k, found in enumerate(meetings(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))):
                all_found[k].append(found)
        for k, found in enumerate(all_found):
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            shard = (mix(pairs[:, 0].astype(U64)) % U64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            pairs, at = pairs[order], np.searchsorted(shard[order], np.arange(shards + 1))
            some = [i for i in range(shards) if at[i] < at[i + 1]]
            blob = lambda c, some=some, pairs=pairs, at=at: pa.array([pairs[at[i] : at[i + 1], c].tobytes() for i in some], pa.binary())
            if some:
                yield from rows(len(some), kind=pa.array(np.full(len(some), k + 1, np.int32)), shard=pa.array(some, pa.int64()), a=blob(0), b=blob(1))

    return run


def _each_once(batches):
    """The distinct pairs of the shards in a task, and whether a star made them."""
    parts: list[tuple[int, np.ndarray]] = [(0, np.zeros((0, 2), np.int64))]
    for batch in batches:
        for r in batch.to_pylist():
            parts.append((r["kind"], np.stack([np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int64)], axis=1)))
    pairs, where = np.unique(np.concatenate([p for _, p in parts]), axis=0, return_inverse=True)
    star = np.zeros(len(pairs), bool)
    star[where.ravel()[np.repeat([k == 2 for k, _ in parts], [len(p) for _, p in parts])]] = True
    for i in range(0, len(pairs), 50_000):
        own = pairs[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy()), pa.array(star[i : i + 50_000])], ["a", "b", "star"])


def _possible(batches):
    """Pairs of digests that the parity bitmaps do not rule out."""
    for batch in batches:
        keep = [star or may_link(*r) for star, *r in zip(*(batch.column(c).to_pylist() for c in ("star", "na", "nb", "pa", "pb")), strict=True)]
        yield batch.select(["da", "db"]).filter(pa.array(keep, pa.bool_()))


def _sets_of(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(digest, set) for the documents in `wanted` (doc_id, digest); texts of others are skipped by a bounded bitmap of ids."""
    word = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = wanted.groupBy(F.floor(word / 64).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (word % 64).cast("int"))).alias("bits")).toPandas()
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[bits["at"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # FILTER_BITS / 8 bytes

    def run(batches):
        for batch in batches:
            at = batch.column("at").to_numpy()
            hit = (shared.value[at // 64] >> (at % 64)) & 1 == 1
            batch = batch.filter(pa.array(hit))
            if not batch.num_rows:
                continue
            data, offsets = C.text_buffer(batch.column("text"))
            for i, j in C.slices(offsets):
                sets, ends = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                blobs = [sets[a:b].tobytes() for a, b in itertools.pairwise(ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(digests(sets, ends).view(np.int64)), pa.array(blobs, pa.binary())], ["doc_id", "digest", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS)).alias("at"))
    return rows.mapInArrow(run, "doc_id long, digest long, shingles binary")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and the digest that names the group, of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    n = partitions(spark)
    buckets = 4 * n
    common = spark.sparkContext.broadcast(common_shingles(docs))  # 8 * COMMON bytes at most
    found = scratch.save(_pack(docs, buckets, common).repartition(n, "bucket").mapInArrow(_unpack(n), _FOUND), "found")
    rows = found.filter("kind = 0").select("doc_id", "n_shingles", "digest", "node")
    names = found.filter("kind = 0").groupBy("node").agg(*(F.first(c).alias(c) for c in ("digest", "n_shingles", "parity")))
    pairs = found.filter("kind > 0").select("shard", "kind", "a", "b").repartition(n, "shard").mapInArrow(_each_once, "a long, b long, star boolean")
    for x in "ab":
        pairs = pairs.join(names.select(F.col("node").alias(x), F.col("digest").alias(f"d{x}"), F.col("n_shingles").alias(f"n{x}"), F.col("parity").alias(f"p{x}")), x)
    possible = pairs.filter("da <> db").select("star", "na", "nb", "pa", "pb", "da", "db").mapInArrow(_possible, "da long, db long")
    edges = scratch.save(possible.select(F.col("da").alias("a"), F.col("db").alias("b")).distinct(), "edges")
    met = scratch.save(components(edges, scratch, "stars"), "met")

    wanted = scratch.save(rows.filter(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(met.select(F.col("node").alias("digest"), "root"), "digest"), "wanted")
    counts = wanted.groupBy("root").agg(F.count("*").alias("size"))
    dealt = wanted.join(counts, "root").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("long")).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "digest"), F.col("blocks")))
    # one task a group, or a pair of blocks of it
    pairs = F.expr("transform(sequence(0L, blocks - 1), x -> struct(least(block, x) AS i, greatest(block, x) AS j))")
    tasks = dealt.withColumn("pair", F.explode(pairs)).select("doc_id", "digest", "root", "pair.i", "pair.j")
    sets = _sets_of(docs, wanted, scratch)

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("digest").sort_values("digest")
        first = linked([np.frombuffer(s, U64) for s in pdf.shingles])
        own = pdf.digest.to_numpy()
        return pd.DataFrame({"root": pdf.root, "a": own, "b": own[first]})

    joined = tasks.join(sets, ["doc_id", "digest"]).select("root", "i", "j", "digest", "shingles")
    links = scratch.save(joined.groupBy("root", "i", "j").applyInPandas(resolve, "root long, a long, b long"), "links")
    whole = links.join(counts.filter(F.col("size") <= BLOCK).select("root"), "root", "left_semi").select(F.col("a").alias("digest"), F.col("b").alias("label"))
    split = links.join(counts.filter(F.col("size") > BLOCK).select("root"), "root", "left_semi").select("a", "b")
    joined_up = components(split, scratch, "blocks").select(F.col("node").alias("digest"), F.col("root").alias("label"))
    labels = whole.unionByName(joined_up)
    labelled = scratch.save(rows.join(labels, "digest", "left").select("doc_id", "n_shingles", "digest", F.coalesce("label", "digest").alias("label")), "labelled")
    # written first, so that a hot group's rows can be split in the join
    least = scratch.save(labelled.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    scratch.drop("found", "edges", "met", "wanted")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return labelled.join(least, "label").select("doc_id", "n_shingles", own.alias("component_id"), F.col("label").alias("group_digest"))


KEY = "__fronda_row"


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group, that of its least doc_id (a null id comes last); rows without shingles all stay.

    Groups are those of distinct (doc_id, text), so rows with one id and other texts, or without an id, are rows of their own.
    """
    scratch = Scratch(docs.sparkSession)
    keyed = docs.withColumn(KEY, F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text")))
    found = near_groups(keyed.select(F.col(KEY).alias("doc_id"), "text"))
    groups = scratch.save(found.filter("n_shingles > 0").groupBy(F.col("doc_id").alias(KEY), F.col("group_digest").alias("label")).count(), "groups")
    many = groups.groupBy("label").count().filter("count > 1").select("label")
    ids = keyed.select(KEY, "doc_id").distinct()
    # written first, so that a hot group's rows can be split in the join
    members = scratch.save(groups.select(KEY, "label").join(many, "label", "left_semi").join(ids, KEY), "members")
    least = scratch.save(members.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", KEY))[KEY].alias("stays")), "stays")
    gone = members.join(least, "label").filter(F.col(KEY) != F.col("stays")).select(KEY)
    twice = groups.filter("count > 1").select(KEY)
    single = keyed.join(gone.unionByName(twice).distinct(), KEY, "left_anti")
    repeated = keyed.join(twice.join(gone, KEY, "left_anti"), KEY, "left_semi").dropDuplicates([KEY])
    return single.select(*docs.columns).unionByName(repeated.select(*docs.columns))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


#: The same rows by all pairs that share a shingle, for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * met >= 80 * (x.n + y.n - met)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, s.b FROM reach r JOIN steps s ON s.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
