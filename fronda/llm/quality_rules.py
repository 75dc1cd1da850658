"""Quality rules with suffix-array repetition (operator 8).

Per text, a suffix array over its words is built by prefix doubling (only
suffixes whose rank is still shared are sorted again).  Neighbouring suffixes
with a common prefix give each word the longest repeat that starts there; all
counts of repetition come from that.  Repeats of 3 words or more make up the
windows of 3 words found twice, hence `n_repeat_words` of the base rule; those
of `min_repeat` words or more form LCP intervals, the maximal repeated
substrings: the union of their occurrences gives the covered words, the largest
the longest repeat.  A text is kept if the base rules pass,
`covered <= max_covered * n_words` and `longest <= max_longest` hold.  All texts
of an Arrow slice share one array: a text's number is part of every key, so no
repeat joins two texts.

Covered words are repeat words too (from `min_repeat` 3 on), so `max_covered`
rejects further texts only below MAX_REPEAT_WORDS; by default it is equal, and
beyond the base rules only `max_longest` does.

Edge cases: a null or empty text has zero counts and fails the base rules; ties
cannot arise; repeated rows are scored alike, one output row per input row;
a null doc_id stays null; extra columns are ignored; an empty table gives none;
of a very long text some twenty bytes are held for each of its bytes at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fronda.llm import common as C

MIN_WORDS = 50
MAX_REPEAT_WORDS = 0.5
WINDOW = 3  # words of the base rule's repeated windows
MIN_REPEAT = 8
MAX_COVERED = 0.5
MAX_LONGEST = 200

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, spans array<struct<start:long,end:long>>"
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _sums(flags, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between offsets; flags: an array, or a function that gives those of a range."""
    n = int(offsets[-1])
    get = flags if callable(flags) else lambda low, high: flags[low:high]
    at, before = np.zeros(len(offsets), np.int64), 0
    for low in range(0, n, C.SCAN_BYTES):
        high = min(n, low + C.SCAN_BYTES)
        total = np.append(0, np.cumsum(get(low, high), dtype=np.int64)) + before
        i, j = np.searchsorted(offsets, low), np.searchsorted(offsets, high, "right")
        at[i:j] = total[offsets[i:j] - low]
        before = total[-1]
    return at[1:] - at[:-1]


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the runs."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + lengths, -1)
    return np.cumsum(depth[:-1]) > 0


def _shared(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _group_heads(sorted_keys: np.ndarray) -> np.ndarray:
    """For each sorted key the index of the first equal one."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(sorted_keys)), 0))


def suffix_array(keys: np.ndarray, ends: np.ndarray, doc: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray | None, np.ndarray]]]:
    """Suffix array of word keys and the rank of each window of 1, 2, 4, ... words.

    ends: for each word the first position after its text; doc: its text, needed if
    texts share keys (each then ends in a mark of its own).  From the second level
    on only places whose rank was still shared are kept (place, rank); at all
    others the window occurs once.
    """
    n = len(keys)
    number = np.int32 if n < 2**31 - 1 else np.int64
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, number)
    rank[order] = _group_heads(keys[order])
    del order
    levels, step = [(None, rank.copy())], 1
    active = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1).astype(number)
    while len(active):
        after = active.astype(np.int64) + step
        following = np.where(after < ends[active], rank[np.minimum(after, n - 1)] + 1, 0 if doc is None else -doc[active]).astype(number)
        del after
        by = np.lexsort((following, rank[active]))
        moved = active[by]
        old, nxt = rank[moved], following[by]
        first = _group_heads(old)
        fine = np.ones(len(by), bool)
        fine[1:] = (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])
        own = np.maximum.accumulate(np.where(fine, np.arange(len(by)), 0))
        rank[moved] = old + own - first
        levels.append((active, rank[active]))
        alone = fine & np.append(fine[1:], True)
        active = np.sort(moved[~alone])
        step *= 2
    array = np.empty(n, number)
    array[rank] = np.arange(n, dtype=number)
    return array, levels


def _equal(level: tuple[np.ndarray | None, np.ndarray], a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Whether the windows of a level at places a and b (a != b) of n are equal."""
    places, ranks = level
    if places is None:
        return ranks[a] == ranks[b]
    if not len(places):
        return np.zeros(len(a), bool)
    own = np.full(n, -1, ranks.dtype)
    own[places] = ranks
    found = own[a]
    return (found >= 0) & (found == own[b])


def common_prefixes(array: np.ndarray, levels: list[tuple[np.ndarray | None, np.ndarray]], ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours of the suffix array that share `least` words or more, and how many they share."""
    low = 0
    while 2 << low <= least and low + 1 < len(levels):
        low += 1
    n = len(array)
    near = np.flatnonzero(_equal(levels[low], array[:-1], array[1:], n)) if 1 << low <= least else np.arange(n - 1)
    a, b = array[near].astype(np.int64), array[near + 1].astype(np.int64)
    size = np.zeros(len(a), np.int64)
    # no window of the last level occurs twice, so each level adds its width once at most
    for k in range(len(levels) - 1, -1, -1):
        at, to = a + size, b + size
        ok = (at + (1 << k) <= ends[a]) & (to + (1 << k) <= ends[b])
        ok &= _equal(levels[k], np.minimum(at, n - 1), np.minimum(to, n - 1), n)
        size += np.where(ok, 1 << k, 0)
    long = size >= least
    return a[long], b[long], size[long]


def repeats(hashes: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Per word: the longest repeated substring of its text that starts there, 0 if that has fewer than `least` words."""
    n = len(hashes)
    longest = np.zeros(n, np.int64)
    if n:
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        ends = offsets[1:][doc]
        array, levels = suffix_array(C.mix(hashes ^ C.mix(doc.astype(np.uint64))), ends)
        a, b, size = common_prefixes(array, levels, ends, least)
        np.maximum.at(longest, a, size)
        np.maximum.at(longest, b, size)
    return longest


def measure(data: np.ndarray, offsets: np.ndarray, least: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    starts, ends, at = C.words(data, offsets)
    n, n_words = len(offsets) - 1, np.diff(at)
    out = {"n_words": n_words, "word_chars": _sums(lambda a, b: ~C.WHITE[data[a:b]] & ((data[a:b] & 0xC0) != 0x80), offsets), "n_symbols": _sums(lambda a, b: _SYMBOL[data[a:b]], offsets)}

    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    breaks = np.flatnonzero(data == 10)
    first[breaks + 1] = True
    line = np.flatnonzero(first[:-1])
    stop = np.append(line[1:], len(data))
    stop = stop - ((stop > line) & (data[np.maximum(stop, 1) - 1] == 10)) if len(line) else stop
    full = np.searchsorted(starts, stop) > np.searchsorted(starts, line)
    line, stop = line[full], stop[full]
    of = np.searchsorted(offsets, line, "right") - 1
    keys = C.mix(C.word_hashes(data, line, stop, lower=False) ^ C.mix(of.astype(np.uint64)))
    by = np.argsort(keys, kind="stable")
    again = by[1:][keys[by[1:]] == keys[by[:-1]]]
    out["n_dup_lines"] = np.bincount(of[again], minlength=n).astype(np.int64)

    hashes = C.word_hashes(data, starts, ends, lower=False)
    longest = repeats(hashes, at, min(WINDOW, least))
    begin = np.flatnonzero(longest >= WINDOW)
    out["n_repeat_words"] = _sums(_covered(begin, longest[begin], len(hashes)), at)

    longest[longest < least] = 0
    begin = np.flatnonzero(longest)
    covered = _covered(begin, longest[begin], len(hashes))
    out["covered_words"] = _sums(covered, at)
    out["longest_repeat"] = np.zeros(n, np.int64)
    np.maximum.at(out["longest_repeat"], np.repeat(np.arange(n), n_words), longest)
    edge = np.zeros(len(hashes) + 1, bool)
    edge[at] = True
    begins = np.flatnonzero(covered & (edge[:-1] | ~np.append(False, covered[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    finishes = np.flatnonzero(covered & (edge[1:] | ~np.append(covered[1:], False))) + 1 if len(hashes) else begins
    out["_spans"] = (begins, finishes, at)
    return out


def _spans(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Array:
    begins, finishes, at = found
    counts = np.searchsorted(begins, at)
    base = np.repeat(at[:-1], np.diff(counts))
    rows = pa.StructArray.from_arrays([pa.array(begins - base), pa.array(finishes - base)], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), rows)


def quality_signals(docs: DataFrame, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """One row per text with its base counts, covered words, longest repeat and repeated spans (word positions)."""

    def run(batches):
        for batch in batches:
            data, offsets = C.text_buffer(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in C.slices(offsets):
                m = measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], min_repeat)
                spans = _spans(m.pop("_spans"))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *(pa.array(v) for v in m.values()), spans], ["doc_id", *m, "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def quality_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Signals, `base_failed` and the verdict `kept` for every text."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT_WORDS) * F.col("n_words"))
    kept = ~failed & (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return quality_signals(docs, min_repeat).withColumns({"base_failed": failed, "kept": kept})


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns (one judgement per row)."""
    columns = docs.columns

    def run(batches):
        for batch in batches:
            data, offsets = C.text_buffer(batch.column("text"))
            for i, j in C.slices(offsets):
                m = measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ok = (m["n_words"] >= MIN_WORDS) & (100 * m["n_repeat_words"] <= int(100 * MAX_REPEAT_WORDS) * m["n_words"])
                ok &= (m["covered_words"] <= MAX_COVERED * m["n_words"]) & (m["longest_repeat"] <= MAX_LONGEST)
                yield batch.slice(i, j - i).filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema).select(*columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).drop("spans")


#: The same rows from windows of words instead of a suffix array, for small tables.
ORACLE_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
base AS (
    SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines
    FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts)),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
grams AS (SELECT doc_id, i, i + 2 <= len(w) AS has3, i + {MIN_REPEAT - 1} <= len(w) AS has, md5(array_to_string(w[i : i + 2], ' ')) AS g3, md5(array_to_string(w[i : i + {MIN_REPEAT - 1}], ' ')) AS g FROM places),
twice3 AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g3) AS n FROM grams WHERE has3) WHERE n > 1),
repeat3 AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice3) GROUP BY doc_id),
twice AS (SELECT doc_id, i, g FROM (SELECT doc_id, i, g, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams WHERE has) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS covered_words FROM (SELECT doc_id, unnest(range(i, i + {MIN_REPEAT})) AS p FROM twice) GROUP BY doc_id),
pairs AS (SELECT a.doc_id, b.i - a.i AS gap, a.i FROM twice a JOIN twice b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i),
runs AS (SELECT doc_id, count(*) + {MIN_REPEAT - 1} AS n FROM (SELECT doc_id, gap, i - row_number() OVER (PARTITION BY doc_id, gap ORDER BY i) AS island FROM pairs) GROUP BY doc_id, gap, island),
longest AS (SELECT doc_id, max(n) AS longest_repeat FROM runs GROUP BY doc_id),
joined AS (
    SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(covered_words, 0) AS covered_words, coalesce(longest_repeat, 0) AS longest_repeat
    FROM base LEFT JOIN repeat3 USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN longest USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {int(100 * MAX_REPEAT_WORDS)} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {int(100 * MAX_REPEAT_WORDS)} * n_words) AND covered_words <= {MAX_COVERED} * n_words AND longest_repeat <= {MAX_LONGEST} AS kept
FROM joined
"""
