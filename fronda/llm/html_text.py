"""HTML extraction (operator 7): host suffix array over page streams, then page structure.

A page is read tag by tag into blocks; scripts, styles, head and other text that
is no prose are left out.  Structure tells two streams of words apart: the main
one, and the rest (menus, headers, footers, sidebars, notices, adverts, forms and
reader comments, by element or by words of class, id and role; on a page with an
article or main element that is not itself unwanted, all text outside such).

The streams of a host's distinct pages are concatenated, main and rest each on
their own, and sorted into a suffix array.  Neighbouring suffixes with a longest
common prefix of MIN_RUN words or more form LCP intervals: runs repeated across
pages.  Pages of equal main words are one text, so copies of a page do not delete
each other.  A run is boilerplate if its interval holds suffixes of MIN_TEXTS of
the host's texts and of one in SHARE of them, at least: fewer pages cannot tell a
notice from a quotation, a near copy of an article or a common phrase.  Covered
words go; of what is left, the main stream is the text, and structure drops the
rest.  `run_words` and `rule_words` tell what each of the two took.  The rest is
no evidence against the main stream: sidebars name other pages' headings.

The texts of a large host are dealt to groups with a suffix array each; a run in
a share of all texts is in that share of some group's, so groups name candidates
(by the hash of a run's windows of MIN_RUN words), which are counted over all.

Edge cases: null or empty html gives empty text; a null url is a host of its
own; character references without a meaning stay as they are; unclosed elements
end with their parent or the page; repeated rows are one page and give equal
rows; null page_ids stay null; extra columns are ignored; an empty table gives
no rows; very long pages are read whole.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fronda.llm import common as C
from fronda.llm.common import Scratch
from fronda.llm.quality_rules import common_prefixes, suffix_array

MIN_RUN = 6
MIN_TEXTS, SHARE = 3, 3  # a boilerplate run is in three of a host's distinct texts and in a third of them, at least
GROUP = 512

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "svg", "canvas", "object", "menu", "dialog"}
BLOCK = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4",
    "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
MAIN = {"article", "main"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer",
    "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "related", "respond", "share", "sharing",
    "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "complementary", "contentinfo", "search",
}


def _unwanted(attributes: str) -> bool:
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        if NAMES.intersection(re.split(r"[^a-z0-9]+", (a or b or c).lower())):
            return True
    return False


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, in an article, unwanted) of every non-empty block, in page order."""
    out: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, opens an article, opens something unwanted
    main = bad = 0

    def flush() -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                out.append((joined, main > 0, bad > 0))
            text.clear()

    def pop() -> None:
        nonlocal main, bad
        _, m, b = stack.pop()
        main -= m
        bad -= b

    at, n = 0, len(page)
    while at < n:
        found = TAG.search(page, at)
        if not found:
            text.append(page[at:] if not re.match(r"</?[a-zA-Z]", page[at:]) else "")
            break
        if found.start() > at:
            text.append(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag in RAW and not found[1]:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else n
            continue
        edge = tag in BLOCK or tag in DROPPED
        if found[1]:
            if edge:
                flush()
            if any(s[0] == tag for s in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag == "br":
            text.append(" ")
        if tag in VOID or found[3].rstrip().endswith("/") and not edge:
            if edge:
                flush()
            continue
        unwanted = tag in DROPPED or _unwanted(found[3])
        if edge or unwanted:
            flush()
        if tag in BLOCK:
            while stack and stack[-1][0] == "p":  # a new block ends a paragraph
                pop()
        if edge or unwanted:
            stack.append((tag, tag in MAIN, unwanted))
            main += tag in MAIN
            bad += unwanted
    flush()
    return out


def host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def _words(texts: list[str]) -> np.ndarray:
    """Hashes of the words of a stream."""
    data = np.frombuffer(" ".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, _ = C.words(data, np.array([0, len(data)]))
    return C.word_hashes(data, starts, ends)


def stream_windows(words: np.ndarray, part: int, run: int) -> np.ndarray:
    """Hashes of `run` words at every place of a stream; part: 0 main, 1 rest."""
    if len(words) < run:
        return np.zeros(0, np.int64)
    return C.mix(C.window_hashes(words, np.array([0, len(words)]), run)[0] + C.U64(part)).view(np.int64)


def _content(words: np.ndarray, host: str) -> int:
    """Hash of a page's host and main words in their order."""
    own = np.frombuffer(host.encode() or b"\0", np.uint8)
    seed = C.word_hashes(own, np.array([0]), np.array([len(own)]))
    placed = C.mix(words + np.arange(len(words), dtype=C.U64) * C.U64(0x9E3779B97F4A7C15))
    return int(C.mix(seed + placed.sum(dtype=C.U64) + C.U64(len(words))).view(np.int64)[0])


def _pack(main: list[str], rest: list[str]) -> bytes:
    """Blocks, which hold no line ends, zipped: two thirds of what a shuffle makes of them."""
    return zstandard.ZstdCompressor(level=3).compress("\n".join([*main, "", *rest]).encode())


def _unpack(data: bytes) -> tuple[list[str], list[str]]:
    found = zstandard.ZstdDecompressor().decompress(data).decode().split("\n")
    at = found.index("")  # a block is never empty
    return found[:at], found[at + 1 :]


def covered_words(words: np.ndarray, part: int, repeated: np.ndarray, run: int) -> np.ndarray:
    """Which words of a stream lie in one of the repeated windows."""
    covered = np.zeros(len(words), bool)
    at = np.flatnonzero(np.isin(stream_windows(words, part, run), repeated))
    for k in range(run):
        covered[at + k] = True
    return covered


def unique_runs(texts: list[str], covered: np.ndarray) -> list[str]:
    """`texts` without covered words; emptied blocks go."""
    words = [[w for w in re.split(r"[ \t-\r]+", t) if w] for t in texts]
    out, at = [], 0
    for own in words:
        kept = [w for w, c in zip(own, covered[at : at + len(own)], strict=True) if not c]
        at += len(own)
        if kept:
            out.append(" ".join(kept))
    return out


def repeated_runs(streams: list[np.ndarray], run: int, least: int) -> list[tuple[int, int, int]]:
    """(stream, place, texts) of one suffix of every LCP interval of `run` words or more that `least` streams or more are in."""
    keys = np.concatenate([np.zeros(0, C.U64), *streams])
    if not len(keys):
        return []
    sizes = np.array([len(x) for x in streams])
    doc, stop = np.repeat(np.arange(len(streams)), sizes), np.cumsum(sizes)
    ends = stop[doc]
    array, levels = suffix_array(keys, ends, doc)
    a, b, _ = common_prefixes(array, levels, ends, run)
    # suffixes in order; a neighbour that shares too little begins a new interval
    place = np.empty(len(keys), np.int64)
    place[array] = np.arange(len(keys))
    joined = np.zeros(len(keys), bool)
    joined[place[b]] = True
    interval = np.cumsum(~joined) - 1
    inside = np.flatnonzero(joined | np.append(joined[1:], False))
    pairs = np.unique(np.stack([interval[inside], doc[array[inside]]], axis=1), axis=0)
    number, texts = np.unique(pairs[:, 0], return_counts=True)
    wide = texts >= least
    at = array[np.searchsorted(interval, number[wide])]
    return list(zip(doc[at].tolist(), (at - (stop - sizes)[doc[at]]).tolist(), texts[wide].tolist(), strict=True))


def need(texts: int) -> int:
    """How many of a host's distinct texts a window of a boilerplate run is in, at least."""
    return max(MIN_TEXTS, -(-texts // SHARE))


def _by_key(batches, *keys: str):
    """Runs of rows with equal keys, from batches sorted by them."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != now:
                yield now, held
                held = []
            now = key
            held.append(row)
    if held:
        yield now, held


def _streams(rows: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Main and rest words of each distinct text of a group."""
    return [tuple(map(_words, _unpack(packed))) for packed in {r["content"]: r["packed"] for r in rows}.values()]


def _named(rows: list[dict], run: int, alone: bool) -> tuple[int, np.ndarray]:
    """How many distinct texts a group has, and the windows of runs that may be boilerplate by the group's suffix arrays."""
    streams = _streams(rows)
    n = len(streams)
    least = need(n) if alone else max(1, -(-n // SHARE))
    found = [np.zeros(0, np.int64)]
    for part in (0, 1):
        own = [s[part] for s in streams]
        for k, at, _ in repeated_runs(own, run, least) if n > 1 else []:
            found.append(stream_windows(own[k][at : at + run], part, run))
        if least == 1:  # then a run need not be repeated inside the group
            found += [stream_windows(x, part, run) for x in own]
    return n, np.unique(np.concatenate(found))


def _counts(rows: list[dict], run: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct texts of a group hold each of the asked windows."""
    own = [np.unique(np.concatenate([stream_windows(x, part, run) for part, x in enumerate(s)])) for s in _streams(rows)]
    windows = np.concatenate([np.zeros(0, np.int64), *(w[np.isin(w, asked)] for w in own)])
    return np.unique(windows, return_counts=True)


def boilerplate(texts: DataFrame, run: int = MIN_RUN, group: int = GROUP) -> DataFrame:
    """host and the windows of its boilerplate runs; texts: host, content (hash of a page's main words) and packed blocks, repeats allowed.

    The texts of a host are dealt to groups of about `group` by content.
    """
    scratch = Scratch(texts.sparkSession)
    big = texts.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") > group)
    big = scratch.save(big.select("host", F.ceil(F.col("n") / group).cast("long").alias("groups")), "big")
    # one row for each `group` texts of the table at most
    dealt = texts.join(F.broadcast(big), "host", "left").withColumn("groups", F.coalesce("groups", F.lit(1))).withColumn("group", F.pmod("content", "groups"))

    def name(batches):
        for (host, _), rows in _by_key(batches, "host", "group"):
            alone = rows[0]["groups"] == 1
            n, windows = _named(rows, run, alone)
            yield pa.RecordBatch.from_pydict({"host": [host], "alone": [alone], "texts": pa.array([n], pa.int64()), "windows": pa.array([windows], pa.list_(pa.int64()))})

    def sort(df: DataFrame) -> DataFrame:
        return df.repartition("host", "group").sortWithinPartitions("host", "group")

    named = scratch.save(sort(dealt).mapInArrow(name, "host string, alone boolean, texts long, windows array<long>"), "named")
    asked = scratch.save(named.filter("NOT alone").select("host", F.explode("windows").alias("w")).groupBy("host").agg(F.collect_set("w").alias("asked")), "asked")
    # texts are dealt again only for hosts with candidates
    again = dealt.filter("groups > 1").join(F.broadcast(asked.select("host")), "host", "left_semi")
    sizes = named.filter("NOT alone").groupBy("host").agg(F.sum("texts").alias("texts"))
    # one copy of a host's candidates for each of its groups
    asked = big.select("host", "groups").join(asked, "host").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"), "asked")

    def count(key, left: pa.Table, right: pa.Table) -> pa.Table:
        host, wanted = key[0].as_py(), right.column("asked").to_pylist()
        windows, counts = _counts(left.to_pylist() if wanted else [], run, np.array(wanted[0] if wanted else [], np.int64))
        return pa.table({"host": pa.array([host] * len(windows), pa.string()), "w": pa.array(windows, pa.int64()), "n": pa.array(counts, pa.int64())})

    met = again.groupBy("host", "group").cogroup(asked.groupBy("host", "group")).applyInArrow(count, "host string, w long, n long")
    least = F.greatest(F.lit(MIN_TEXTS), F.ceil(F.col("texts") / SHARE))
    summed = met.groupBy("host", "w").agg(F.sum("n").alias("n")).join(sizes, "host").filter(F.col("n") >= least).groupBy("host").agg(F.collect_list("w").alias("windows"))
    return named.filter("alone AND size(windows) > 0").select("host", "windows").unionByName(summed)


def main_texts(pages: DataFrame, run: int = MIN_RUN, group: int = GROUP) -> DataFrame:
    """page_id, url, main text, and the words that host runs and then structure took, of every row."""
    spark = pages.sparkSession
    scratch = Scratch(spark)

    def parse(batches):
        met: set[int] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                hosts, kept, contents, first = [], [], [], []
                for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                    found = blocks(page or "")
                    sure = any(m and not b for _, m, b in found)  # an article in comments or a sidebar is not the page's
                    hosts.append(host_of(url))
                    main = [t for t, m, b in found if not b and (m or not sure)]
                    rest = [t for t, m, b in found if b or (sure and not m)]
                    kept.append(_pack(main, rest))
                    contents.append(_content(_words(main), hosts[-1]))
                    # a task sends a text that it meets many times to be counted once
                    first.append(bool(found) and contents[-1] not in met)
                    met.add(contents[-1])
                yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "host": pa.array(hosts, pa.string()), "packed": pa.array(kept, pa.binary()), "content": pa.array(contents, pa.int64()), "first": pa.array(first, pa.bool_())})

    def finish(batches):
        for batch in batches:
            out, by_run, by_rule = [], [], []
            for packed, windows in zip(*(batch.column(c).to_pylist() for c in ("packed", "windows")), strict=True):
                texts = _unpack(packed)
                if not windows:  # a host without boilerplate runs
                    out.append("\n\n".join(texts[0]))
                    by_run.append(0)
                    by_rule.append(sum(len(re.findall(r"[^ \t-\r]+", t)) for t in texts[1]))
                    continue
                repeated = np.array(windows, np.int64)
                main, rest = (covered_words(_words(t), part, repeated, run) for part, t in enumerate(texts))
                out.append("\n\n".join(unique_runs(texts[0], main) if main.any() else texts[0]))
                by_run.append(int(main.sum() + rest.sum()))
                by_rule.append(int((~rest).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(by_run, pa.int64()), pa.array(by_rule, pa.int64())], ["page_id", "url", "text", "run_words", "rule_words"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = scratch.save(rows.mapInArrow(parse, "page_id long, url string, host string, packed binary, content long, first boolean"), "parsed")
    found = scratch.save(boilerplate(parsed.filter("first").select("host", "content", "packed"), run, group), "boilerplate")
    return parsed.join(found, "host", "left").select("page_id", "url", "packed", "windows").mapInArrow(finish, "page_id long, url string, text string, run_words long, rule_words long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "run_words", "rule_words")
