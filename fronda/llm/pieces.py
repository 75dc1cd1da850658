"""SentencePiece encoding and decoding (operator 2) by a max-plus parallel scan.

Pieces come from a public model file (a parameter).  The file at hand holds a
BPE model, which ranks its pieces without probabilities, so each gets a Zipf
log-probability from its rank unless `weights` (piece -> log-probability) are
given; a text's encoding is the piece sequence with the largest sum (unigram
Viterbi), with byte pieces, far below all others, for characters that no piece
has.  The ids are those of this unigram model, not of the file's own merges.
White space follows the file: a space is part of the piece it starts, one is
put before the text and removed on decoding, so decoding gives back every text
exactly (a literal U+2581 is spelled in bytes).

Places that no piece can cross (before a space run, around a line break) split a
text into segments.  The distinct segments of a slice of at most SLICE bytes are
encoded together: all pieces at all places are found by rolling hash along the
prefixes of pieces, and the best path is found position by position for all
segments at once.  Nothing is kept from one slice to the next.

A text of CHUNK characters or more is cut into chunks.  The state at a chunk's
edge is how far the piece across it reaches in, so a chunk is a max-plus matrix
entry state x exit state.  Products of runs of RUN chunks are combined, a scan
over those gives each run's states, a scan within runs each chunk's, and chunks
are then backtraced independently.  With segment edges inside, the matrix is
head + middle + tail; the middle's path does not depend on the states, so its
ids leave with the matrix and only head and tail are traced.  A chunk without
an edge gets the full matrix and is traced whole.

Edge cases: a null or empty text has no ids and decodes to ''; ties go to the
longer first piece found in a backward pass, so equal texts get equal ids;
repeated rows and null doc_ids keep one output row each; extra columns are
ignored; an empty table gives no rows; very long texts only grow the number of
chunks, and work arrays are bounded by SLICE.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fronda.llm import common as C
from fronda.llm.common import Scratch, partitions

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 16_384
RUN = 256
SLICE = 2 << 20  # bytes of text encoded at once
GROUP = 1 << 16  # bytes of distinct segments whose paths are found at once
LOW = -1e300
U64 = np.uint64
_BASE, _MULTIPLIER, _BITS = U64(0x5851F42D4C957F2D), U64(0x9E3779B97F4A7C15), 20


class Chunk(NamedTuple):
    """What a chunk keeps of itself: its matrix, the ids between its first and last segment edge, and the text on both sides."""

    matrix: np.ndarray
    head: str
    middle: np.ndarray
    tail: str | None  # None: no edge, all of it is head
    inner: int  # characters of the tail (or of the head without one) that are the chunk's own


class Vocabulary:
    """Pieces with spaces for U+2581: id, score, bytes."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int], byte_score: float):
        self.pieces = {p: (i, s) for p, i, s in pieces}
        self.byte_ids, self.byte_score = byte_ids, byte_score
        self.longest = max((len(p) for p in self.pieces), default=1)
        # score of every piece, LOW for what only starts one
        self.table = {p[:k]: LOW for p in self.pieces for k in range(1, len(p) + 1)} | {p: s for p, (_, s) in self.pieces.items()}
        self.bytes = {i: p.encode() for p, i, _ in pieces} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.cut_space = not any(re.search(r"[^ ] ", p) for p in self.pieces)
        self.cut_line = not any("\n" in p and len(p) > 1 for p in self.pieces)
        self._flat: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self._hashed: dict | None = None

    @staticmethod
    def load(path: str = MODEL, weights: dict[str, float] | None = None) -> Vocabulary:
        """The pieces of a model file; weights: log-probability of each piece (with U+2581 for spaces), Zipf by rank if None."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = [], [0] * 256
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append((model.id_to_piece(i), i, -model.get_score(i)))
        if weights is None:
            norm = math.log(sum(1 / (rank + 2) for _, _, rank in pieces))
            scored = [(p.replace("▁", " "), i, -math.log(rank + 2) - norm) for p, i, rank in pieces]
        else:
            scored = [(p.replace("▁", " "), i, weights[p]) for p, i, _ in pieces if p in weights]
        return Vocabulary(scored, byte_ids, min(s for _, _, s in scored) - 10)

    # ------------------------------------------------------------ one text at a time

    def edges(self, s: str, i: int, end: int):
        """(end, score) of every piece of `s` that starts at i and ends by `end`; a character without one is spelled."""
        alone, k = True, i + 1
        while k <= end:
            v = self.table.get(s[i:k])
            if v is None:
                break
            if v > LOW:
                alone &= k > i + 1
                yield k, v
            k += 1
        if alone and i < end:
            yield i + 1, self.byte_score * len(s[i].encode("utf-8", "surrogatepass"))

    def suffixes(self, s: str, end: int, inner: int) -> tuple[list[float], list[int]]:
        """Best score from each position to `end` and the next position, with no piece starting in [inner, end)."""
        score, to = [LOW] * (end + 1), [-1] * (end + 1)
        score[end] = 0.0
        for i in range(min(inner, end) - 1, -1, -1):
            best, at = LOW, -1
            for k, v in self.edges(s, i, end):
                if score[k] > LOW / 2 and (v + score[k] > best or v + score[k] == best and k > at):
                    best, at = v + score[k], k
            score[i], to[i] = best, at
        return score, to

    def forward(self, s: str, inner: int) -> list[float]:
        """Best score from the start to each position, by pieces that start before `inner`."""
        score = [LOW] * (len(s) + 1)
        score[0] = 0.0
        for i in range(inner):
            if score[i] > LOW:
                for k, v in self.edges(s, i, len(s)):
                    score[k] = max(score[k], score[i] + v)
        return score

    def spell(self, s: str, i: int, k: int) -> list[int]:
        found = self.pieces.get(s[i:k])
        return [found[0]] if found else [self.byte_ids[b] for b in s[i:k].encode("utf-8", "surrogatepass")]

    def path(self, s: str, inner: int | None = None) -> tuple[float, list[int]]:
        """Best score and ids of `s`, with no piece starting at or after `inner`."""
        score, to = self.suffixes(s, len(s), len(s) if inner is None else inner)
        ids, i = [], 0
        while i < len(s):
            ids += self.spell(s, i, to[i])
            i = to[i]
        return score[0], ids

    # ------------------------------------------------------------ many segments at a time

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where a segment starts: at a text's start and wherever no piece can cross."""
        edge = np.zeros(len(data) + 1, bool)
        if self.cut_space:
            space = data == 0x20
            edge[1:-1] |= space[1:] & ~space[:-1]
            if self.cut_line:
                line = data == 0x0A
                edge[:-1] |= line
                edge[1:] |= line
        edge[offsets] = True
        return np.flatnonzero(edge[:-1])

    def _lookup(self) -> dict:
        """Open-addressed table of the hashes of all prefixes of pieces: keys, scores (LOW: no piece) and ids; and those of single bytes."""
        if self._hashed is None:
            known = {p.encode(): (s, i) for p, (i, s) in self.pieces.items()}
            prefixes = sorted({p[:k] for p in known for k in range(1, len(p) + 1)}, key=len)
            hashes, h = np.zeros(len(prefixes), U64), {b"": 0}
            for n, p in enumerate(prefixes):
                h[p] = (h[p[:-1]] * int(_BASE) + p[-1] + 1) % (1 << 64)
                hashes[n] = h[p]
            keys, scores, ids = np.zeros(1 << _BITS, U64), np.full(1 << _BITS, LOW), np.zeros(1 << _BITS, np.int32)
            own = np.array([known.get(p, (LOW, 0))[0] for p in prefixes])
            own_id = np.array([known.get(p, (LOW, 0))[1] for p in prefixes], np.int32)
            left, probe = np.arange(len(prefixes)), 0
            while len(left):
                slot = (((hashes[left] * _MULTIPLIER) >> U64(64 - _BITS)) + U64(probe)) & U64((1 << _BITS) - 1)
                free = np.flatnonzero(keys[slot] == 0)
                _, one = np.unique(slot[free], return_index=True)
                put = free[one]
                keys[slot[put]], scores[slot[put]], ids[slot[put]] = hashes[left[put]], own[left[put]], own_id[left[put]]
                left, probe = np.delete(left, put), probe + 1
            single = [known.get(bytes([b]), (self.byte_score, self.byte_ids[b])) for b in range(256)]
            self._hashed = {
                "keys": keys, "scores": scores, "ids": ids, "probe": probe, "width": max(map(len, known), default=1),
                "one": np.array([s for s, _ in single]), "one_id": np.array([i for _, i in single], np.int32), "begins": np.array([bytes([b]) in h for b in range(256)]),
            }
        return self._hashed

    def best(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Score of every segment's best path, all ids, and where a segment's ids begin and how many there are."""
        n = len(starts)
        order = np.argsort(starts - ends, kind="stable")  # longest first
        total = np.append(0, np.cumsum((ends - starts)[order]))
        score, begin, count = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        ids, i, done = [np.zeros(0, np.int32)], 0, 0
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(total, total[i] + GROUP, "right")) - 1))
            own = order[i:j]
            score[own], found, count[own] = self._paths(data, starts[own], ends[own])
            begin[own] = done + np.cumsum(count[own]) - count[own]
            ids.append(found)
            done, i = done + len(found), j
        return score, np.concatenate(ids), begin, count

    def _paths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = self._lookup()
        width, mask = t["width"], U64((1 << _BITS) - 1)
        length = ends - starts
        stop = np.cumsum(length)
        first, size = stop - length, int(stop[-1])
        flat = data[np.repeat(starts - first, length) + np.arange(size)]
        rest = np.repeat(stop, length) - np.arange(size)
        # what a piece of each length scores at each place, longest first
        gain, own = np.full((size, width), LOW), np.zeros((size, width), np.int32)
        gain[:, -1], own[:, -1] = t["one"][flat], t["one_id"][flat]
        at = np.flatnonzero(t["begins"][flat] & (rest > 1))
        h = flat[at].astype(U64) + U64(1)
        for k in range(2, width + 1):
            if not len(at):
                break
            h = h * _BASE + flat[at + k - 1].astype(U64) + U64(1)
            slot = (h * _MULTIPLIER) >> U64(64 - _BITS)
            key = t["keys"][slot]
            for p in range(1, t["probe"]):
                again = np.flatnonzero((key != h) & (key != 0))
                if not len(again):
                    break
                slot[again] = (slot[again] + U64(1)) & mask
                key[again] = t["keys"][slot[again]]
            hit = key == h
            at, h, slot = at[hit], h[hit], slot[hit]
            value = t["scores"][slot]
            piece = value > LOW
            gain[at[piece], width - k] = value[piece]
            own[at[piece], width - k] = t["ids"][slot[piece]]
            more = rest[at] > k
            at, h = at[more], h[more]
        # best[:, width + j]: from j bytes before the end of each segment
        n, top = len(starts), int(length[0])
        best, step = np.full((n, width + top + 1), LOW), np.zeros(size, np.int64)
        best[:, width] = 0.0
        longer = np.searchsorted(-length, -np.arange(top + 1), "right")
        rows = np.arange(n)
        for j in range(1, top + 1):
            m = longer[j]
            place = stop[:m] - j
            c = min(j, width)
            total = gain[place, width - c :]
            total += best[:m, j + width - c : j + width]
            to = total.argmax(axis=1)
            best[:m, width + j] = total[rows[:m], to]
            step[place] = c - to
        on = np.zeros(size, bool)
        now, last = first[length > 0], stop[length > 0]
        while len(now):
            on[now] = True
            now = now + step[now]
            going = now < last
            now, last = now[going], last[going]
        visited = np.flatnonzero(on)
        before = np.append(0, np.cumsum(on))
        return best[rows, width + length], own[visited, width - step[visited]], before[stop] - before[first]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts that start and end where no piece can cross, their n + 1 offsets, and scores."""
        starts = self.starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        _, one, which = np.unique(C.word_hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        score, ids, begin, count = self.best(data, starts[one], ends[one])
        counts = count[which]
        after = np.append(0, np.cumsum(counts))
        flat = ids[np.repeat(begin[which] - after[:-1], counts) + np.arange(after[-1])]
        at = np.searchsorted(starts, offsets)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
        return flat, after[at], np.bincount(text, score[which], len(offsets) - 1)

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`encode` of whole texts: a space is put before each that is not empty."""
        full = np.diff(offsets) > 0
        spaced = np.insert(data, offsets[:-1][full], 0x20)
        return self.encode(spaced, offsets + np.append(0, np.cumsum(full)))

    # ------------------------------------------------------------ chunks

    def chunks(self, rows: list[tuple[str, int, bool]]) -> list[Chunk]:
        """Chunks from (text, size, last); a text also has what follows its `size` characters, up to longest - 1 of them."""
        bodies = [s[:size].encode("utf-8", "surrogatepass") for s, size, _ in rows]
        data = np.frombuffer(b"".join(bodies), np.uint8)
        offsets = np.append(0, np.cumsum([len(b) for b in bodies]))
        starts = self.starts(data, offsets)
        at = np.searchsorted(starts, offsets)
        inside = at[1:] - at[:-1] > 1
        # without an edge inside, both cuts are the chunk's start
        a = np.where(inside, starts[np.minimum(at[:-1] + 1, len(starts) - 1)], offsets[:-1])
        b = np.where(inside, starts[at[1:] - 1], offsets[:-1])
        middle = np.append(0, np.cumsum(b - a))
        flat = data[np.repeat(a - middle[:-1], b - a) + np.arange(middle[-1])]
        ids, ends, score = self.encode(flat, middle)
        out = []
        for k, (s, size, last) in enumerate(rows):
            own = ids[ends[k] : ends[k + 1]]
            exits = 1 if last else min(self.longest, len(s) - size + 1)
            if not inside[k]:
                out.append(Chunk(self._whole(s, size, exits), s, own, None, size))
                continue
            head = bodies[k][: a[k] - offsets[k]].decode("utf-8", "surrogatepass")
            tail = bodies[k][b[k] - offsets[k] :].decode("utf-8", "surrogatepass")
            out.append(Chunk(self._cut(head, tail + s[size:], len(tail), size, exits, score[k]), head, own, tail + s[size:], len(tail)))
        return out

    def _over(self, size: int) -> np.ndarray:
        """A matrix with only the pieces that reach over a whole chunk of `size` characters."""
        out = np.full((self.longest, self.longest), LOW)
        for e in range(size, self.longest):
            out[e, e - size] = 0.0
        return out

    def _cut(self, head: str, tail: str, inner: int, size: int, exits: int, middle: float) -> np.ndarray:
        out = self._over(size)
        first, _ = self.suffixes(head, len(head), len(head))
        last = np.array(self.forward(tail, inner)[inner : inner + exits])
        for e in range(min(self.longest, len(head) + 1)):
            if first[e] > LOW:
                out[e, : len(last)] = np.where(last > LOW, first[e] + middle + last, LOW)
        return out

    def _whole(self, s: str, size: int, exits: int) -> np.ndarray:
        out = self._over(size)
        end = size + exits - 1
        best = np.full((end + 1, exits), LOW)
        best[range(size, end + 1), range(exits)] = 0.0
        for i in range(size - 1, -1, -1):
            to = list(self.edges(s, i, end))
            if to:
                best[i] = np.maximum((best[[k for k, _ in to]] + np.array([v for _, v in to])[:, None]).max(axis=0), LOW)
        out[: min(self.longest, size), :exits] = best[: min(self.longest, size)]
        return out

    def trace(self, head: str, tail: str | None, inner: int, entry: int, leave: int) -> tuple[list[int], list[int]]:
        """Ids before and after a chunk's middle, between its states."""
        if tail is None:
            return ([] if entry >= inner else self.path(head[entry : inner + leave], inner - entry)[1]), []
        return self.path(head[entry:])[1], self.path(tail[: inner + leave], inner)[1]

    # ------------------------------------------------------------ decoding

    def decode(self, ids) -> str:
        """The text of a whole id sequence."""
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")[1:]

    def decode_ids(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of id sequences without the space put before each, and their n + 1 offsets."""
        if self._flat is None:
            top = max(self.bytes, default=-1) + 1
            sizes = np.array([len(self.bytes.get(i, b"")) for i in range(top)], np.int64)
            self._flat = (np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(top)), np.uint8), np.cumsum(sizes) - sizes, sizes)
        data, begin, sizes = self._flat
        ends = np.append(0, np.cumsum(sizes[ids]))
        flat = np.empty(ends[-1], np.uint8)
        for i in range(0, len(ids), SLICE // 8):
            part = ids[i : i + SLICE // 8]
            low, high = ends[i], ends[i + len(part)]
            flat[low:high] = data[np.repeat(begin[part] - ends[i : i + len(part)], sizes[part]) + np.arange(low, high)]
        at = ends[offsets]
        full = np.diff(at) > 0
        return np.delete(flat, at[:-1][full]), at - np.append(0, np.cumsum(full))

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """The texts of many id sequences, copied piece by piece from one buffer."""
        offsets = lists.offsets.to_numpy()
        ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        flat, at = self.decode_ids(ids, offsets - offsets[0])
        texts = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes()))
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # not the ids of a text
            texts = pa.array([self.decode(i) for i in lists.to_pylist()], pa.large_string())
        return texts.cast(pa.string())


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), LOW)


def states(matrices: list[np.ndarray], entry: int, leave: int | None) -> list[tuple[int, int]]:
    """Entry and exit state of each matrix on the best way from `entry` to `leave`."""
    at = np.full(len(matrices[0]), LOW)
    at[entry] = 0.0
    back = []
    for m in matrices:
        way = at[:, None] + m
        back.append(way.argmax(axis=0))
        at = np.maximum(way.max(axis=0), LOW)
    out, x = [], leave
    for frm in reversed(back):
        e = int(frm[x])
        out.append((e, x))
        x = e
    return out[::-1]


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))


ENCODED = "doc_id long, text_crc32 long, ids array<int>, n_chunks long, score double"
_CHUNK = "key long, chunk long, matrix array<double>, head string, middle array<int>, tail string, inner int"


def encode_documents(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, weights: dict[str, float] | None = None, check: bool = False) -> DataFrame:
    """doc_id, text_crc32, ids, n_chunks and score of every row; check: also round_trip, whether decoding gives back the text."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(model, weights))  # the pieces of one model file
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    wide = F.length("text") >= chunk

    def short(batches):
        v = vocabulary.value
        for batch in batches:
            data, offsets = C.text_buffer(batch.column("text"))
            for i, j in C.slices(offsets, SLICE):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                ids, ends, score = v.encode_texts(own, at)
                parts = [own[a:b] for a, b in itertools.pairwise(at.tolist())]
                columns = [batch.column("doc_id").slice(i, j - i), pa.array([zlib.crc32(p) for p in parts], pa.int64()), _lists(ids, ends), pa.array(np.ones(j - i, np.int64)), pa.array(score)]
                names = ["doc_id", "text_crc32", "ids", "n_chunks", "score"]
                if check:
                    back, to = v.decode_ids(ids, ends)
                    columns.append(pa.array([np.array_equal(p, back[a:b]) for p, (a, b) in zip(parts, itertools.pairwise(to.tolist()), strict=True)], pa.bool_()))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(columns, names)

    def split(batches):
        ahead = vocabulary.value.longest - 1
        for batch in batches:
            for key, doc_id, t in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
                crc, t = zlib.crc32(t.encode("utf-8", "surrogatepass")), " " + t
                n = -(-len(t) // chunk)
                for k in range(0, n, RUN):
                    at = range(k, min(n, k + RUN))
                    yield pa.RecordBatch.from_pydict({"key": [key] * len(at), "doc_id": pa.array([doc_id] * len(at), pa.int64()), "text_crc32": [crc] * len(at), "chunk": list(at), "last": [c == n - 1 for c in at], "text": [t[c * chunk : (c + 1) * chunk + ahead] for c in at], "size": [min(chunk, len(t) - c * chunk) for c in at]})

    def matrices(batches):
        v = vocabulary.value
        some = max(1, SLICE // (2 * chunk))
        for batch in batches:
            for i in range(0, batch.num_rows, some):
                part = batch.slice(i, some)
                found = v.chunks(list(zip(*(part.column(c).to_pylist() for c in ("text", "size", "last")), strict=True)))
                middle = _lists(np.concatenate([c.middle for c in found]), np.append(0, np.cumsum([len(c.middle) for c in found])))
                matrix = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * v.longest**2), pa.array(np.concatenate([c.matrix.ravel() for c in found])))
                columns = [part.column("key"), part.column("doc_id"), part.column("text_crc32"), part.column("chunk"), matrix, pa.array([c.head for c in found], pa.string()), middle, pa.array([c.tail for c in found], pa.string()), pa.array([c.inner for c in found], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "text_crc32", "chunk", "matrix", "head", "middle", "tail", "inner"])

    def square(rows: pd.Series) -> list[np.ndarray]:
        return [np.asarray(r).reshape(vocabulary.value.longest, -1) for r in rows]

    def run_product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        total = None
        for m in square(pdf["matrix"]):
            total = m if total is None else product(total, m)
        return pd.DataFrame({"key": pdf.key.iloc[:1], "run": pdf.chunk.iloc[:1] // RUN, "matrix": [total.ravel()]})

    def run_states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run")
        found = states(square(pdf["matrix"]), 0, 0)
        return pd.DataFrame({"key": pdf.key, "run": pdf.run, "entry": [e for e, _ in found], "leave": [x for _, x in found]})

    def chunk_ends(pdf: pd.DataFrame) -> pd.DataFrame:
        """Ids before (0) and after (2) the middle of each chunk of a run, between its states."""
        pdf = pdf.sort_values("chunk")
        all_m, v = square(pdf["matrix"]), vocabulary.value
        found = states(all_m, int(pdf.entry.iloc[0]), int(pdf.leave.iloc[0]))
        ends = [v.trace(h, t, i, e, x) for h, t, i, (e, x) in zip(pdf["head"], pdf["tail"].astype(object).where(pdf["tail"].notna(), None), pdf["inner"], found, strict=True)]
        score = [m[e, x] for m, (e, x) in zip(all_m, found, strict=True)]
        one = pd.DataFrame({"key": pdf.key, "chunk": pdf.chunk, "part": 0, "ids": [h for h, _ in ends], "score": score})
        two = pd.DataFrame({"key": pdf.key, "chunk": pdf.chunk, "part": 2, "ids": [t for _, t in ends], "score": 0.0})
        return pd.concat([one, two])

    scratch, tasks = Scratch(spark), partitions(spark)
    # a stated number of partitions: by bytes alone few tasks would get all of this work
    dealt = rows.filter(wide).withColumn("key", F.monotonically_increasing_id()).mapInArrow(split, "key long, doc_id long, text_crc32 long, chunk long, last boolean, text string, size long").repartition(tasks, "key", "chunk")
    found = scratch.save(dealt.mapInArrow(matrices, _CHUNK.replace("chunk long", "doc_id long, text_crc32 long, chunk long")), "matrices").withColumn("run", F.floor(F.col("chunk") / RUN).cast("long"))
    runs = found.select("key", "run", "chunk", "matrix").groupBy("key", "run").applyInPandas(run_product, "key long, run long, matrix array<double>")
    at_runs = runs.groupBy("key").applyInPandas(run_states, "key long, run long, entry long, leave long")
    traced = found.select("key", "run", "chunk", "matrix", "head", "tail", "inner").join(at_runs, ["key", "run"]).groupBy("key", "run").applyInPandas(chunk_ends, "key long, chunk long, part int, ids array<int>, score double")
    middle = found.select("key", "chunk", F.lit(1).alias("part"), F.col("middle").alias("ids"), F.lit(0.0).alias("score"), "doc_id", "text_crc32")
    parts = traced.withColumns({"doc_id": F.lit(None).cast("long"), "text_crc32": F.lit(None).cast("long")}).unionByName(middle)
    joined = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "part", "ids", "score"))).alias("parts"), F.max("doc_id").alias("doc_id"), F.max("text_crc32").alias("text_crc32"))
    long = joined.select("doc_id", "text_crc32", F.flatten(F.col("parts.ids")).alias("ids"), (F.size("parts") / 3).cast("long").alias("n_chunks"), F.aggregate("parts.score", F.lit(0.0), lambda a, x: a + x).alias("score"))
    if check:
        same = F.crc32(F.col("text").cast("binary")) == F.col("text_crc32")
        long = _decoded(long, vocabulary).withColumn("round_trip", same).drop("text")
    return rows.filter(~wide).mapInArrow(short, ENCODED + (", round_trip boolean" if check else "")).unionByName(long)


def _decoded(encoded: DataFrame, vocabulary) -> DataFrame:
    names = encoded.columns

    def run(batches):
        v = vocabulary.value
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            offsets = lists.offsets.to_numpy().astype(np.int64)
            for i, j in C.slices(offsets, SLICE // 4):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, v.decode_lists(lists.slice(i, j - i))], [*names, "text"])

    return encoded.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema) + ", text string")


def decode_documents(encoded: DataFrame, model: str = MODEL, weights: dict[str, float] | None = None) -> DataFrame:
    """`encoded` with the decoded text of each row's ids."""
    return _decoded(encoded, encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model, weights)))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives back the text."""
    found = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), check=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "n_chunks", "score", "round_trip", "ids")
