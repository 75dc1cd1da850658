"""Operators on whole tables: mixing, sharding, neighbours, near duplicates, pipeline."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from fronda.llm import components, jaccard, mixing, neighbours, registry, sharding
from fronda.llm.common import Scratch
from tests.llm import data
from tests.llm.conftest import same


def highest_quotients(targets, seats, caps):
    given = [0] * len(targets)
    for _ in range(seats):
        free = [i for i in range(len(targets)) if given[i] < caps[i] and targets[i] > 0]
        if not free:
            break
        best = max(free, key=lambda i: (targets[i] / (2 * given[i] + 1), -i))
        given[best] += 1
    return given


def test_sainte_lague_is_by_highest_quotients():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 8)
        targets = [rng.choice([0, 1, 5, 5, rng.random() * 100]) for _ in range(n)]
        caps = [rng.randint(0, 40) for _ in range(n)]
        seats = rng.randint(0, 90)
        assert mixing.sainte_lague(targets, seats, caps).tolist() == highest_quotients(targets, seats, caps)


def test_targets_are_capped_and_shared():
    got = mixing.capped_targets([10, 100, 100], [5, 2, 1], 315)
    assert got == pytest.approx([20, 590 / 3, 295 / 3])
    assert mixing.capped_targets([0, 0], [5, 2], 0) == [0, 0]


def test_mix(spark, docs, rows, empty):
    found = mixing.mix_sources(docs, block=4).collect()
    assert len(found) == len(rows)
    size = {r[0]: len(data.words(r[1])) for r in rows}
    total = sum(len(data.words(r[1])) for r in rows)
    per, taken, target = collections.Counter(), collections.Counter(), {}
    for r in found:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        per[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted(target, key=lambda s: (s is None, s or ""))
    expected = mixing.capped_targets([per[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * total)
    assert [target[s] for s in names] == pytest.approx(expected)
    for s in names:
        assert abs(taken[s] - target[s]) <= 8 and target[s] <= 2 * per[s] + 1e-6
    again = mixing.mix_sources(docs.repartition(5), block=4).collect()
    same([(r.doc_id, r.taken) for r in found], [(r.doc_id, r.taken) for r in again])
    assert mixing.mix_sources(empty).count() == 0
    copies = mixing.mixed_copies(docs)
    assert copies.columns == docs.columns
    assert mixing.mixed_copies(empty).count() == 0


def test_hot_source_is_sharded(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 10)
    frame = spark.createDataFrame([(k, "a b c " * (k % 7), "hot" if k % 3 else "cold") for k in range(200)], "doc_id long, text string, source string")
    found = mixing.mix_sources(frame, block=2).collect()
    for s in ("hot", "cold"):
        own = [r for r in found if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * 2 * 20
        assert all(r.taken <= 2 * r["size"] for r in own)


def test_shards(spark, docs, rows, empty):
    found = sharding.kd_shards(docs, 6).collect()
    assert len(found) == len(rows)
    slots, texts = collections.defaultdict(list), collections.defaultdict(set)
    weight = collections.Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        weight[r.shard] += r["size"]
        texts[(r.text_crc32, r["size"])].add(r.shard)
    assert set(slots) <= set(range(6)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sum(weight.values()) == sum(len((r[1] or "").encode()) + 8 for r in rows)
    assert all(len(v) == 1 for v in texts.values())
    assert sharding.kd_shards(empty, 6).count() == 0
    same(found, sharding.kd_shards(docs.repartition(7), 6).collect())


def test_shard_balance_with_a_hot_text(spark):
    rows = [(k, "hot text", "s", "en") for k in range(900)] + [(1000 + k, f"text {k} " * 3, f"s{k % 4}", "en") for k in range(900)]
    found = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), 8).collect()
    weight = collections.Counter()
    for r in found:
        weight[r.shard] += r["size"]
    assert len(weight) == 8 and max(weight.values()) < 1.15 * sum(weight.values()) / 8
    asked = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), target_bytes=10_000)
    assert asked.select("shard").distinct().count() == -(-sum(weight.values()) // 10_000)


def exact_neighbours(rows, k=10, every=100):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    for q in ok:
        if q % every == 0:
            far = sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            yield q, far[:k]


def plain_kd(points, shards, first=0):
    """Shard of each point (weight, *coordinates) by a K-d tree in memory."""
    if shards == 1 or not points:
        return dict.fromkeys(points, first)
    total = sum(p[0] for p in points)
    scale = float(1 << sharding.BITS)
    mean = [sum(p[0] * p[1 + d] / scale for p in points) / total for d in range(3)]
    spread = [sum(p[0] * (p[1 + d] / scale) ** 2 for p in points) / total - mean[d] ** 2 for d in range(3)]
    dim = max(range(3), key=lambda d: (spread[d], -d))
    weight = collections.Counter()
    for p in points:
        weight[p[1 + dim]] += p[0]
    upto, right = 0, None
    for key, w in sorted(weight.items()):
        upto += w
        if upto - w / 2 > total * (shards // 2) / shards:
            right = key
            break
    left = [p for p in points if right is None or p[1 + dim] < right]
    rest = [p for p in points if not (right is None or p[1 + dim] < right)]
    return plain_kd(left, shards // 2, first) | plain_kd(rest, shards - shards // 2, first + shards // 2)


@pytest.mark.parametrize(("n", "shards"), [(300, 7), (300, 24), (40, 5), (3, 6), (1, 2)])
def test_kd_rules_equal_a_plain_tree(spark, n, shards):
    rng = random.Random(n + shards)
    coarse = lambda most: (rng.randrange(most) << 28) + rng.randrange(1 << 13)
    points = list({(rng.randint(1, 500), coarse(32), coarse(5), coarse(3)) for _ in range(n)})
    frame = spark.createDataFrame(points, "size long, " + ", ".join(f"{d} long" for d in sharding.DIMS))
    whole, shard_of, _ = sharding.kd_tree(frame, shards, Scratch(spark))
    found = {tuple(r[c] for c in ("size", *sharding.DIMS)): shard_of[r.node] for r in whole.collect()}
    assert found == plain_kd(points, shards)


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 16))
    base[300:360] = base[300]  # equal vectors
    base[400:440] = base[400] + rng.normal(size=(40, 16)) * 0.01
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(base)]
    rows += [(700, None), (701, [0.0] * 16), (800, [float("nan")] * 16), (801, [None] + [1.0] * 15), (802, [float("inf")] * 16), rows[3], (None, [1.0] * 16)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    found = collections.defaultdict(list)
    for r in neighbours.nearest(frame, every=20).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.score, r.vec_id))
    hit = total = 0
    expected = dict(exact_neighbours([(i, v) for i, v in rows[:600]], every=20))
    assert found.keys() == expected.keys()
    for q, near in expected.items():
        assert found[q] == sorted(found[q]) and len(found[q]) == 10
        hit += len({i for _, i in found[q]} & {i for _, i in near})
        total += len(near)
    assert hit / total >= 0.9
    assert [i for _, i in found[300]] == list(range(301, 311))


def test_few_vectors_are_answered_exactly(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 1)
    rows = [(k * 100, [float(k), 1.0, -2.0]) for k in range(5)] + [(1, [9.0, 9.0])]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    same([(r.query_id, r.rank, r.vec_id, r.score) for r in found], [(q, n + 1, i, d) for q, near in exact_neighbours(rows) for n, (d, i) in enumerate(near)])
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_hot_buckets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "HOT", 20)
    rng = np.random.default_rng(2)
    rows = [(k, (np.ones(8) + rng.normal(size=8) * 0.02).tolist()) for k in range(300)]
    found = collections.defaultdict(set)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        found[r.query_id].add(r.vec_id)
    expected = dict(exact_neighbours(rows))
    assert sum(len(found[q] & {i for _, i in near}) for q, near in expected.items()) >= 0.9 * 30


def expected_groups(rows):
    sets = [data.shingles(r[1]) for r in rows]
    root = groups_ids = data.groups(sets)
    least = collections.defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root[k]].append(r[0])
    return [(r[0], len(sets[k]), (min(least[groups_ids[k]]) if least[groups_ids[k]] else None) if sets[k] else r[0]) for k, r in enumerate(rows)]


def test_near_duplicates(spark, docs, rows, empty):
    same([tuple(r) for r in jaccard.near_groups(docs).select("doc_id", "n_shingles", "component_id").collect()], expected_groups(rows))
    assert jaccard.near_groups(empty).count() == 0
    kept = jaccard.keep_one(docs)
    expected = {c for i, n, c in expected_groups(rows)}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == expected and kept.count() == len(expected)


@pytest.mark.parametrize("block", [4, 1536])
def test_chains_and_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(block)
    rows, text = [], [f"w{k}" for k in range(60)]
    for k in range(40):  # a chain: neighbours are near, ends are not
        rows.append((100 + k, " ".join(text)))
        text[rng.randrange(60)] = f"n{k}"
    common = " ".join(f"c{k}" for k in range(40))
    for k in range(40):  # a shared passage does not link
        rows.append((300 + k, common + " " + " ".join(f"u{k}x{i}" for i in range(40))))
    for k in range(30):  # sizes around the band edges
        rows.append((500 + k, " ".join(f"b{i}" for i in range(k + 1))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    same([tuple(r) for r in jaccard.near_groups(frame).select("doc_id", "n_shingles", "component_id").collect()], expected_groups(rows))


def test_signatures_are_shared_by_every_near_pair():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = a.copy()
        change = rng.integers(0, n // 9 + 1)
        b[:change] = rng.integers(0, 2**63, change).astype(np.uint64)
        b = b[: len(b) - int(rng.integers(0, 3))]
        both = len(np.intersect1d(a, b))
        if len(b) == 0 or 100 * both < 80 * (len(a) + len(b) - both) or set(a.tolist()) == set(b.tolist()):
            continue
        common = np.unique(a[rng.random(len(a)) < rng.choice([0, 0.3, 0.9, 1])])
        both_at = np.array([0, len(a), len(a) + len(b)])
        who, key = jaccard.signatures(np.concatenate([a, b]), both_at, common)
        assert np.intersect1d(key[who == 0], key[who == 1]).size
        assert jaccard.may_link(len(a), len(b), *jaccard.parities(np.concatenate([a, b]), both_at))


def test_parity_bitmaps_rule_out_strangers():
    rng = np.random.default_rng(8)
    sets = rng.integers(0, 2**63, 1000).astype(np.uint64)
    one, two = jaccard.parities(sets, np.array([0, 450, 1000]))
    assert not jaccard.may_link(450, 550, one, two)
    assert jaccard.parities(sets[:0], np.array([0, 0])) == [bytes(8)]


def test_meetings_pair_small_runs_and_star_large_ones():
    keys, nodes = np.array([1, 1, 1, 2, 2, *[3] * 20], np.uint32), np.array([5, 6, 7, 8, 8, *range(100, 120)])
    pairs, stars = jaccard.meetings(keys, nodes)
    assert pairs.tolist() == [[5, 6], [5, 7], [6, 7]] and len(stars) == 19 and len({x for r in stars.tolist() for x in r}) == 20


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 200), (200, 300), (7, 7), (300, 100)] + [(1000, 1000 + k) for k in range(1, 40)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), "t").collect()}
    assert found == {k: 0 for k in range(51)} | {100: 100, 200: 100, 300: 100} | {k: 1000 for k in range(1000, 1040)}


def test_pipeline_stages(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 10 != 4), 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "near_duplicates", "source_mix", "sentencepiece"]
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == at.columns
            assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in at.collect()}
        seen.append(after.count())
        at = after
    assert seen[0] < len(rows) and seen[1] < seen[0] and seen[2] < seen[1] and seen[4] == seen[3]
    assert at.filter("not round_trip").count() == 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    same([(r.doc_id, list(r.ids)) for r in whole.collect()], [(r.doc_id, list(r.ids)) for r in at.collect()])


def test_registry_names():
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))


def test_keep_one_by_row(spark):
    text = [" ".join(f"t{k}w{i}" for i in range(40)) for k in range(6)]
    rows = [(1, text[0]), (2, text[0]), (2, text[1]), (3, text[2]), (3, text[3]), (None, text[4]), (None, text[4]), (None, text[4] + " more"), (7, text[5]), (7, text[5]), (None, text[5]), (None, "")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.text for r in kept].count(text[4]) + [r.text for r in kept].count(text[4] + " more") == 1
    same([tuple(r) for r in kept if not (r.text or "").startswith(text[4])], [(1, text[0]), (2, text[1]), (3, text[2]), (3, text[3]), (7, text[5]), (None, "")])


def plain_neighbours(rows, k, every):
    out = []
    for q, x in rows:
        if q % every == 0:
            found = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), i) for i, y in rows if i != q and len(y) == len(x))[:k]
            out += [(q, n + 1, i, round(d, 9)) for n, (d, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("case", ["lengths", "missed"])
def test_unmeasured_queries_are_answered_exactly(spark, monkeypatch, case):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=7 if case == "lengths" and i % 5 == 0 else 12).tolist()) for i in range(300)]
    if case == "missed":
        monkeypatch.setattr(neighbours, "PROBES", (1,))
        monkeypatch.setattr(neighbours, "TARGET", 1.01)
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3, 10).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found) == plain_neighbours(rows, 3, 10)
