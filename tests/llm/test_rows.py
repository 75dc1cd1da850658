"""Operators that judge each text: scanner, rules, classifier, languages, pieces, pages."""

import collections
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from fronda.llm import brown, classifier, common, html_text, language, pieces, quality_rules
from tests.llm import data
from tests.llm.conftest import same


def test_words_and_windows_match_split(rows):
    texts = [r[1] for r in rows]
    buffer, offsets = common.text_buffer(pa.array(texts, pa.string()))
    starts, ends, at = common.words(buffer, offsets)
    hashes = common.word_hashes(buffer, starts, ends)
    names = {}
    for k, text in enumerate(texts):
        own = [buffer[s:e].tobytes() for s, e in zip(starts[at[k] : at[k + 1]], ends[at[k] : at[k + 1]], strict=True)]
        assert own == data.words(text, lower=False)
        for w, h in zip(own, hashes[at[k] : at[k + 1]], strict=True):
            assert names.setdefault(w.lower(), h) == h
    assert len(set(names.values())) == len(names)
    _, w_at = common.window_hashes(hashes, at, 5)
    assert [int(x) for x in np.diff(w_at)] == [max(len(data.words(t)) - 4, 1 if data.words(t) else 0) for t in texts]


def test_long_words_cross_scan_blocks():
    text = ("x" * 700_000 + " ") * 3 + "y"
    buffer, offsets = common.text_buffer(pa.array([text]))
    starts, ends, _ = common.words(buffer, offsets)
    hashes = common.word_hashes(buffer, starts, ends)
    assert len(hashes) == 4 and len(set(hashes.tolist())) == 2


def test_hash_of_a_word_beyond_a_block():
    size = 2 * common.SCAN_BYTES + 12345
    data_ = np.frombuffer(np.random.default_rng(1).integers(97, 123, size, dtype=np.uint8).tobytes() + b" xy", np.uint8)
    total = 0
    for k, b in enumerate(common._TABLE[data_[:size]].tolist()):
        if k == 0:
            power = 1
        total = (total + b * power) % (1 << 64)
        power = power * common._BASE % (1 << 64)
    want = common.mix(np.array([(total + size * 0xD6E8FEB86659FD93) % (1 << 64)], np.uint64))[0]
    starts, ends, _ = common.words(data_, np.array([0, len(data_)]))
    assert starts.tolist() == [0, size + 1] and common.word_hashes(data_, starts, ends)[0] == want


LONG = """
import resource, sys
import numpy as np
from fronda.llm import classifier, jaccard, language, quality_rules
rng = np.random.default_rng(2)
words = np.array(["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(5000)])
text = " ".join(rng.choice(words, 2_300_000)).encode()
data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if sys.argv[1] == "rules":
    quality_rules.measure(data, at)
elif sys.argv[1] == "classifier":
    classifier.statistics(data, at)
elif sys.argv[1] == "sets":
    jaccard.shingle_sets(data, at)
else:
    weight = np.ones((1 << language.DIMS_LOG2, 7), np.float32)
    language.Model(["a"] * 4, language.codewords(4), weight, np.zeros(7), np.ones(7)).margins(data, at)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 / (len(text) / 2**20))
"""


@pytest.mark.parametrize(("what", "most"), [("rules", 25), ("classifier", 25), ("sets", 25), ("languages", 4)])
def test_one_long_text_takes_bounded_memory(what, most):
    """Megabytes for each megabyte of one text of 16 MB."""
    found = subprocess.run([sys.executable, "-c", LONG, what], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(found.stdout) < most


def test_grams_across_blocks(monkeypatch):
    text = np.frombuffer(b"the quick brown fox jumps over the lazy dog" * 5, np.uint8)
    at = np.array([0, 70, 71, len(text)])
    weight = np.random.default_rng(3).normal(size=(1 << language.DIMS_LOG2, 3)).astype(np.float32)
    model = language.Model(["a", "b", "c"], language.codewords(3), weight, np.zeros(3), np.ones(3))
    whole = model.margins(text, at)
    monkeypatch.setattr(language, "BLOCK", 7)
    assert (model.margins(text, at) == whole).all()
    # every n-gram of every text, by brute force
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        seen = []
        for lo in range(a, b):
            for f, ok in language.grams(text[a:b], np.full(1, b - a), lo - a, lo - a + 1):
                seen += f[ok].tolist()
        assert len(seen) == sum(max(0, b - a - n + 1) for n in language.GRAMS)
        want = language.SCALE * weight[seen].sum(axis=0, dtype=float) / max(1, len(seen)) if seen else np.zeros(3)
        assert whole[i] == pytest.approx(want, abs=1e-3)


def brute_rules(text):
    w = data.words(text, lower=False)
    chars = (text or "").encode()
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    repeat = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in chars.split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + d for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for d in range(8)}
    longest = 0
    for i in range(len(w)):
        for j in range(i):
            n = 0
            while i + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            longest = max(longest, n)
    return len(w), sum(len(x.decode()) for x in w), sum(chars.count(c) for c in b"#*$%&|<>"), dup, len(repeat), len(covered), longest if longest >= 8 else 0


def test_quality_signals_match_brute_force(spark, docs, rows):
    extra = [(900, "a b c d e f g h i j " * 9), (901, "x " * 60), (902, "same line\nsame line\n\nsame line \n"), (903, None)]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    found = quality_rules.quality_signals(frame).collect()
    texts = [(r[0], r[1]) for r in rows if r[0] != 10] + extra
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_words, r.longest_repeat) for r in found if r.doc_id != 10], [(i, *brute_rules(t)) for i, t in texts])
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in found}
    assert spans[900] == [(0, 90)] and spans[903] == []


def test_quality_rules_verdicts(spark, empty):
    clean = " ".join(f"w{k}" for k in range(120))
    texts = [(1, clean), (2, "too short"), (3, "a b c " * 40), (4, clean + " " + clean), (5, None), (6, " ".join(f"v{k}" for k in range(300)) * 1 + " " + " ".join(f"v{k}" for k in range(250)))]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(frame).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    assert [r.doc_id for r in quality_rules.keep_good(frame).collect()] == [1]
    assert quality_rules.quality_rules(empty).count() == 0


def measured(texts, least=quality_rules.MIN_REPEAT):
    found = quality_rules.measure(*common.text_buffer(pa.array(texts, pa.string())), least)
    return [tuple(int(found[k][i]) for k in ("n_repeat_words", "covered_words", "longest_repeat")) for i in range(len(texts))]


def test_suffix_array_decides_the_base_rule(monkeypatch):
    texts = ["a b c " * 40, " ".join(f"w{k}" for k in range(120))]
    assert [x[0] for x in measured(texts)] == [120, 0]
    # without the array's intervals no text fails by repetition: nothing beside them counts repeats
    monkeypatch.setattr(quality_rules, "common_prefixes", lambda *_: (np.zeros(0, np.int64),) * 3)
    assert measured(texts) == [(0, 0, 0)] * 2


def test_repeats_of_few_words_match_brute_force():
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(list("abcdefgh")[: 1 + i % 8], rng.integers(0, 70))) for i in range(150)]
    texts += [" ".join(list("abc") * 9 + list("xyz") + list("abc") * 9), "a a", "a a a", "a b a b", "a b c a b c", None]
    assert measured(texts) == [brute_rules(t)[4:] for t in texts]
    assert [x[0] for x in measured(texts, 2)] == [brute_rules(t)[4] for t in texts]
    assert all(covered <= repeated for repeated, covered, _ in measured(texts))


def test_longest_repeat_rejects_what_the_base_rules_pass(spark):
    one, two = ([f"{x}{k}" for k in range(size)] for x, size in (("v", 201), ("u", 700)))
    texts = [(1, " ".join(one + two + one)), (2, " ".join(one[1:] + two + one[1:]))]
    found = quality_rules.quality_rules(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.longest_repeat, r.base_failed, r.kept) for r in found} == {(1, 201, False, False), (2, 200, False, True)}


def test_classifier_learns_from_text_only(spark, docs, rows, empty):
    labels = [(r[0], int(not (r[0] % 10 == 4 and "#" in (r[1] or "#"))), 0, "x") for r in rows if r[0] is not None and r[0] not in (5, 6, 7)]
    frame = spark.createDataFrame([*labels, (3, None, 1, "x"), (None, 1, 0, "x"), (20, 7, 0, "x")], "doc_id long, quality int, toxic int, text string")
    model = classifier.train(docs, frame)
    found = classifier.quality_scores(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    held = {r.doc_id: r.score for r in found if r.doc_id is not None and data.fold(r.doc_id, 5) == 0}
    truth = dict((i, q) for i, q, _, _ in labels)
    right = [(held[i] >= classifier.THRESHOLD) == bool(q) for i, q in truth.items() if i in held]
    assert np.mean(right) > 0.8
    again = {r.doc_id: r.score for r in classifier.quality_scores(docs.drop("lang", "source"), model).collect()}
    assert again == {r.doc_id: r.score for r in found}
    kept = classifier.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= classifier.THRESHOLD for r in found)
    assert classifier.quality_scores(empty, model).count() == 0
    none = classifier.train(docs, frame.limit(0))
    assert {r.score for r in classifier.quality_scores(docs, none).collect()} == {0.5}


def test_flat_trees_equal_nested_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = classifier.fit(x, y, trees=12)
    scores = model.score(x)
    for i in range(50):
        raw = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if x[i, f[node]] > t[node] else 1)
            raw += v[node - len(f)]
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-raw)))
    assert np.mean((scores > 0.5) == y) > 0.9


def test_languages(spark, docs, rows, empty):
    model = language.train(docs)
    assert model.langs == ["de", "en", "fr"]
    found = language.identify(docs, model).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    for i in (5, 6, 7, 11):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[9].lang_pred != "und"
    held = [r for r in rows if r[0] is not None and data.fold(r[0], 4) == 2 and len(data.words(r[1])) > 10 and r[0] % 9 not in (1, 2) and r[2]]
    assert np.mean([by[r[0]].lang_pred == r[2] for r in held]) > 0.9
    assert language.identify(empty, model).count() == 0
    blank = language.train(docs.filter("lang is null"))
    assert {r.lang_pred for r in language.identify(docs, blank).collect()} == {"und"}
    one = language.train(docs.filter("lang = 'en'"))
    assert {(r.lang_pred, r.score) for r in language.identify(docs, one).collect()} == {("und", 0.0), ("en", 1.0)}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
    assert min(apart) >= (1 if n < 4 else 2) and set(np.unique(code)) <= {-1.0, 1.0}


def toy_vocabulary():
    names = [" ", "a", "b", "c", "ab", "bc", "abc", " a", " ab", "aa", "aaaa", "cab", " c", "  "]
    return pieces.Vocabulary([(p, k + 256, -1.0 - 0.37 * k) for k, p in enumerate(names)], list(range(256)), -20.0)


def best_score(v, s):
    score = [0.0] + [-1e300] * len(s)
    for i in range(len(s)):
        for k in range(i + 1, len(s) + 1):
            own = v.pieces[s[i:k]][1] if s[i:k] in v.pieces else v.byte_score * len(s[i:k].encode()) if k == i + 1 else None
            if own is not None:
                score[k] = max(score[k], score[i] + own)
    return score[-1]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 40])
def test_max_plus_scan_equals_viterbi(size):
    v, rng = toy_vocabulary(), np.random.default_rng(size)
    for text in [" ", " a", " aaaaaaaaaaaaaaaaaaaa", *("".join(rng.choice(list("aabc  \né"), rng.integers(1, 60))) for _ in range(60))]:
        chunks = [(text[i : i + size + v.longest - 1], min(size, len(text) - i), i + size >= len(text)) for i in range(0, len(text), size)]
        found = v.chunks(chunks)
        matrices = [c.matrix for c in found]
        total = matrices[0]
        for m in matrices[1:]:
            total = pieces.product(total, m)
        assert total[0, 0] == pytest.approx(best_score(v, text))
        ids = []
        for c, (e, x) in zip(found, pieces.states(matrices, 0, 0), strict=True):
            head, tail = v.trace(c.head, c.tail, c.inner, e, x)
            ids += [*head, *c.middle.tolist(), *tail]
        assert b"".join(v.bytes[i] for i in ids).decode() == text
        score = {i: s for i, s in v.pieces.values()}
        assert sum(score.get(i, v.byte_score) for i in ids) == pytest.approx(total[0, 0])


def test_segments_at_once_equal_single_texts():
    rng = np.random.default_rng(5)
    for v in (toy_vocabulary(), pieces.Vocabulary.load()):
        texts = ["".join(rng.choice(list("aabcdethe réé\u4e00🙂\n"), rng.integers(0, 90))) for _ in range(300)] + [" ", "a", "\n", " the", " " * 30, "", "x" * 3000, "▁ the"]
        data, offsets = common.text_buffer(pa.array(texts))
        ids, ends, score = v.encode_texts(data, offsets)
        back, at = v.decode_ids(ids, ends)
        for k, text in enumerate(texts):
            raw = np.frombuffer((" " + text).encode() if text else b"", np.uint8)
            cuts = [*v.starts(raw, np.array([0, len(raw)])).tolist(), len(raw)]
            want = [v.path(raw[a:b].tobytes().decode()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            assert score[k] == pytest.approx(sum(w for w, _ in want)) == pytest.approx(best_score(v, " " + text) if text else 0.0)
            assert ids[ends[k] : ends[k + 1]].tolist() == [i for _, own in want for i in own]
            assert back[at[k] : at[k + 1]].tobytes().decode() == text


def test_given_weights_decide():
    v = pieces.Vocabulary.load(weights={"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -5.0})
    assert v.path(" ab")[0] == -3.0 and len(v.path(" ab")[1]) == 3


def test_encode_documents_round_trip(spark, docs, rows, empty):
    encoded = pieces.encode_documents(docs, chunk=512).persist()
    found = {r.doc_id: r for r in pieces.decode_documents(encoded).collect()}
    assert encoded.count() == len(rows)
    v = pieces.Vocabulary.load()
    for i, text, *_ in rows:
        assert found[i].text == (text or "")
        assert found[i].score == pytest.approx(v.path(" " + text)[0] if text else 0.0)
    assert found[10].n_chunks > RUN_CHUNKS and list(found[5].ids) == []
    checked = pieces.encode_documents(docs, chunk=512, check=True).collect()
    assert len(checked) == len(rows) and all(r.round_trip for r in checked)
    one = {r.doc_id: list(r.ids) for r in pieces.encode_documents(docs).collect()}
    assert {i: sum(1 for _ in x) for i, x in one.items()}.keys() == found.keys()
    assert pieces.encode_documents(empty).count() == 0


RUN_CHUNKS = 60


def test_two_level_scan(spark, monkeypatch):
    monkeypatch.setattr(pieces, "RUN", 3)
    text = "abc aab " * 400 + "z" * 700
    found = pieces.encode_documents(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"), chunk=100).collect()
    whole = pieces.Vocabulary.load().path(" " + text)
    assert [r.score for r in found] == pytest.approx([whole[0]] * 2) and found[0].n_chunks == 40


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/x>y">Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad top">Buy</div><article><h1>Head &amp; line</h1><p><b>One\n\ttwo&nbsp;three<br><p>Four <i>fi</i>ve &am</p>
<div id="comments"><p>Reader</p></div><form><p>Mail</p></form></article><footer>&copy; foot</footer></body>"""


def test_html_structure(spark):
    rows = [(1, "http://a.b/x", PAGE, 1), (2, None, None, 1), (3, "http://a.b/y", "", 1), (4, "//a.b/z", "<p>plain</p> tail <p", 1), (1, "http://a.b/x", PAGE, 1)]
    found = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, page int")).collect()
    same([(r.page_id, r.url, r.text) for r in found], [(1, "http://a.b/x", "Head & line\n\nOne two three\n\nFour five &am")] * 2 + [(2, None, ""), (3, "http://a.b/y", ""), (4, "//a.b/z", "plain\n\ntail")])


def test_host_runs_without_article(spark):
    notice = "All rights reserved by the owners of this site since long ago"
    other = [(k, f"https://H.org:80/{k}", f"<div><p>{notice}</p><p>story{k} " + " ".join(f"w{k}x{i}" for i in range(30)) + f" {notice}</p></div>") for k in range(4)]
    alone = (9, "https://else.org/", f"<p>{notice}</p>")
    article = [(20 + k, "https://h.org/", "<article><p>" + "a whole article that is copied on the same host again and again" + "</p></article>") for k in range(2)]
    found = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame([*other, alone, *article], "page_id long, url string, html string")).collect()}
    for k in range(4):
        assert found[k] == f"story{k} " + " ".join(f"w{k}x{i}" for i in range(30))
    assert found[9] == notice and found[20] == found[21] != ""


def test_unwanted_articles_do_not_stand_for_the_page(spark):
    story = "<div><p>The main text of this page stands in a div</p></div>"
    rows = [(1, "http://c.d/1", story + '<section class="comments"><article><p>Reader one</p></article></section>'), (2, "http://c.e/2", "<aside><article>Teaser</article></aside>" + story)]
    found = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in found} == {"The main text of this page stands in a div"}


def own_words(k, n=20):
    return " ".join(f"w{k}x{i}" for i in range(n))


@pytest.mark.parametrize("group", [2, 512])
def test_host_runs_in_articles(spark, group):
    notice = "Follow us on all the networks for more of this"
    pages = [(k, "http://i.j/", f"<article><p>{own_words(k)}</p><p>{notice}</p></article>") for k in range(7)]
    copies = [(10 + k, "http://i.j/", f"<article><p>{own_words(99)}</p></article>") for k in range(5)]
    found = html_text.main_texts(spark.createDataFrame([*pages, *copies], "page_id long, url string, html string"), group=group).collect()
    same([(r.page_id, r.text) for r in found], [(k, own_words(k)) for k in range(7)] + [(10 + k, own_words(99)) for k in range(5)])


def test_host_runs_keep_copies_and_quotations(spark):
    quote = "all that is gold does not glitter said the old song"
    rows = [(k, "http://k.l/", f"<div><p>{own_words(k)} {quote if k < 2 else ''} {own_words(50 + k)}</p></div>") for k in range(8)]
    rows += [(20 + k, "http://m.n/", f"<p>{own_words(77)}</p>") for k in range(2)]
    found = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[20] == found[21] == own_words(77)
    for k in range(8):
        assert found[k] == " ".join(f"{own_words(k)} {quote if k < 2 else ''} {own_words(50 + k)}".split())


def test_repeated_runs_match_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(30):
        streams = [rng.integers(0, 4, rng.integers(0, 40)).astype(np.uint64) for _ in range(rng.integers(1, 7))]
        streams.append(streams[0].copy())
        for run, least in ((2, 2), (3, 3), (5, 2)):
            seen = collections.defaultdict(set)
            for k, s in enumerate(streams):
                for i in range(len(s) - run + 1):
                    seen[tuple(s[i : i + run].tolist())].add(k)
            want = {w: len(k) for w, k in seen.items() if len(k) >= least}
            found = html_text.repeated_runs(streams, run, least)
            assert {tuple(streams[k][i : i + run].tolist()): n for k, i, n in found} == want and len(found) == len(want)


@pytest.mark.parametrize("group", [3, 512])
def test_hosts_match_brute_force(spark, group):
    """Words that stand in a run of six words or more in a third of a host's distinct texts, and in three, go; all else stays."""
    rng = np.random.default_rng(4)
    phrases = [" ".join(f"p{k}q{i}" for i in range(rng.integers(4, 12))) for k in range(8)]
    rows = []
    for k in range(40):
        host = ["a.x", "b.x", "c.x"][min(2, k // 18)]
        some = [phrases[i] for i in rng.permutation(8)[: rng.integers(1, 5)]]
        body = [f"<p>{own_words(k, int(rng.integers(1, 9)))} {s}</p>" for s in some]
        rows.append((k, f"http://{host}/{k}", f"<nav>{phrases[0]} {phrases[1]}</nav><article>{''.join(body)}</article>"))
    rows.append((99, rows[0][1], rows[0][2]))
    texts = {i: [" ".join(t.split()) for t, m, b in html_text.blocks(h) if m] for i, _, h in rows}
    found = {r.page_id: r for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"), group=group).collect()}
    changed = 0
    for host in ("a.x", "b.x", "c.x"):
        own = {i: texts[i] for i, url, _ in rows if host in url}
        distinct = {" ".join(t).lower() for t in own.values()}
        seen = collections.Counter()
        for t in distinct:
            w = t.split()
            seen.update({tuple(w[k : k + 6]) for k in range(len(w) - 5)})
        least = max(3, -(-len(distinct) // 3))
        for i, t in own.items():
            w = " ".join(t).lower().split()
            gone = {k + d for k in range(len(w) - 5) if seen[tuple(w[k : k + 6])] >= least for d in range(6)}
            want = " ".join(x for k, x in enumerate(" ".join(t).split()) if k not in gone)
            assert " ".join(found[i].text.split()) == want
            changed += bool(gone)
            assert found[i].run_words >= len(gone)
    assert changed > 5 and max(r.run_words for r in found.values()) > 6


def test_pages_of_an_empty_table_and_clashing_columns(spark):
    schema = "page_id long, url string, html string, text string, windows string, rest string, host string"
    assert html_text.main_texts(spark.createDataFrame([], schema)).count() == 0
    r = html_text.main_texts(spark.createDataFrame([(1, "http://a.b/", "<p>own text</p>", "x", "y", "z", "h")], schema)).first()
    assert r.text == "own text" and r.run_words == 0


def brute_base(rows):
    counts = collections.Counter()
    for i, text, *_ in rows:
        if data.fold(i, 10):
            counts.update(data.words(text))
            counts["end"] += 1
    total, types = sum(counts.values()), len(counts)
    out = []
    for i, text, *_ in rows:
        own = [*data.words(text), "end"]
        out.append((i, len(own), sum(counts[w] > 0 for w in own), sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (types + 1))) for w in own)))
    return total, out


def test_language_model(spark, docs, rows, empty):
    found = brown.score_texts(docs).collect()
    total, expected = brute_base(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[3], 3))
    got = sorted([(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in found], key=key)
    for a, b in zip(got, sorted(expected, key=key), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-6)
    assert {r.train_tokens for r in found} == {total}
    held = [r for r in found if data.fold(r.doc_id, 10) == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert brown.score_texts(empty).count() == 0


def test_language_model_score_by_brute_force(spark, docs, rows, monkeypatch):
    """The score of every text from its classes, with counts, transitions and emissions worked out one by one."""
    cluster, kept = brown.cluster, {}

    def capture(*args):
        kept["classes"], table = cluster(*args)
        return kept["classes"], table

    monkeypatch.setattr(brown, "cluster", capture)
    found = brown.score_texts(docs).collect()
    train = [data.words(text) for i, text, *_ in rows if data.fold(i, 10)]
    counts = collections.Counter(w for t in train for w in t)
    distinct = sorted(counts)
    buffer, at = common.text_buffer(pa.array([w.decode() for w in distinct]))
    hashes = common.word_hashes(buffer, at[:-1], at[1:])
    number = {distinct[k]: n for n, k in enumerate(np.argsort(hashes))}
    kind = lambda w: int(kept["classes"][number[w]]) if w in counts else brown.UNKNOWN
    pairs, size = collections.Counter(), collections.Counter()
    for t in train:
        line = [brown.END, *map(kind, t), brown.END]
        pairs.update(zip(line[:-1], line[1:], strict=True))
        size.update(line[1:])
    tokens = sum(size.values())
    unknown = (sum(c == 1 for c in counts.values()) + 0.5) / (tokens + 1)
    smooth = sum(size[c] + 0.5 for c in range(brown.N_CLASSES) if c != brown.UNKNOWN)
    share = lambda c: (size[c] + 0.5) / smooth
    after = collections.Counter()
    for (a, _), n in pairs.items():
        after[a] += n

    def score(words):
        total, before = 0.0, brown.END
        for w in [*words, None]:
            own = brown.END if w is None else kind(w)
            if own == brown.UNKNOWN:
                total += np.log10(unknown)
            else:
                step = share(own) if before == brown.UNKNOWN else (pairs[before, own] + brown.SMOOTH * share(own)) / (after[before] + brown.SMOOTH)
                total += np.log10(step) + np.log10(1 - unknown) + (0 if w is None else np.log10(counts[w] / size[own]))
            before = own
        return total

    want = sorted((str(i), round(score(data.words(text)), 6)) for i, text, *_ in rows)
    got = sorted((str(r.doc_id), round(r.score, 6)) for r in found)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-5)


def test_language_model_is_a_distribution(spark):
    texts = [(k, " ".join(np.random.default_rng(k).choice(list("abcdefgh"), 30))) for k in range(40)]
    known = sorted({w for i, t in texts if data.fold(i, 10) for w in t.split()})
    # probe texts of one word after 'a', all in the held-out fold
    held = [i for i in range(1000, 3000) if data.fold(i, 10) == 0][: len(known) + 2]
    probe = [(i, f"a {w}") for i, w in zip(held, [*known, "unseen"], strict=False)] + [(held[-1], "a")]
    scores = {r.doc_id: r.score for r in brown.score_texts(spark.createDataFrame(texts + probe, "doc_id long, text string")).collect()}
    # P(a w end) / P(end | w) sums to P(a) over w; with one class context for all words the end's share cancels only roughly
    assert all(s < 0 for s in scores.values())
    assert sum(10 ** scores[i] for i, _ in probe) < 1


def test_exchange_separates_contexts():
    classes = np.full(brown.END_SLOT + 1, 0, np.uint8)
    classes[brown.END_SLOT] = brown.END
    slots = np.arange(40)
    classes[slots] = slots % 2
    # words 0-19 follow class 0, words 20-39 follow class 1
    seen = np.zeros((40, brown.N_CLASSES))
    seen[:20, 0], seen[20:, 1] = 30, 30
    for turn in range(8):
        table = np.zeros((brown.N_CLASSES, brown.N_CLASSES))
        for s in slots:
            table[:, classes[s]] += seen[s]
        classes[slots] = brown.exchange(slots, seen, classes, table, turn)
    assert len(set(classes[:20].tolist()) & set(classes[20:40].tolist())) == 0


def test_chunks_are_whole(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(brown, "CHUNK_WORDS", 200)
    found = {r.doc_id: r.n_tokens for r in brown.score_texts(docs).collect()}
    assert found == {r[0]: len(data.words(r[1])) + 1 for r in rows}


def test_crc_is_of_the_utf8_text(spark):
    r = pieces.encode_documents(spark.createDataFrame([(1, "é x")], "doc_id long, text string")).first()
    assert r.text_crc32 == zlib.crc32("é x".encode())


def test_words_of_near_hashes_have_classes_of_their_own(spark, monkeypatch):
    cluster = brown.cluster
    # without rounds each of the most frequent words keeps the class it starts in
    monkeypatch.setattr(brown, "cluster", lambda *args: cluster(*args, rounds=0))
    names = [f"n{i}" for i in range(20000)]
    blob, ends = "".join(names).encode(), np.cumsum([len(w) for w in names])
    top = common.word_hashes(np.frombuffer(blob, np.uint8), ends - [len(w) for w in names], ends) >> np.uint64(42)
    order = np.argsort(top, kind="stable")
    twin = int(np.flatnonzero(top[order][1:] == top[order][:-1])[0])
    x, y = names[order[twin]], names[order[twin + 1]]
    pairs = [(f"p{k % 5}", x) if k % 2 else (f"q{k % 5}", y) for k in range(600)]
    train = [i for i in range(2000) if data.fold(i, 10)][:600]
    held = [i for i in range(2000) if not data.fold(i, 10)][:2]
    rows = [(i, " ".join(pair)) for i, pair in zip(train, pairs, strict=True)] + [(held[0], f"p1 {x}"), (held[1], f"p1 {y}")]
    scores = {r.doc_id: r.score for r in brown.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert scores[held[0]] > scores[held[1]]
