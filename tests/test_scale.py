"""Whole-table forms of operators, against brute force on small tables."""

import itertools
import random

import pytest

from fronda.operators import graph, index, outline, search, state
from fronda.sources import workspace


@pytest.mark.parametrize(("n", "least", "most"), [(300, 0, 1000), (300, 3, 90), (5, 1, 10), (40, 0, 10**6), (0, 1, 100)])
def test_budget_prefix_equals_a_running_total(spark, n, least, most):
    rng = random.Random(n + most)
    rows = [(i % 7, i, rng.randint(least, least + 5)) for i in range(n)]
    found = search.budget_prefix(spark.createDataFrame(rows, "a int, b int, size int"), ["a", "b"], "size", most, 20).collect()
    want, total = [], 0
    for r in sorted(rows):
        total += r[2]
        if total + 20 <= most:
            want.append((*r, total))
    assert sorted((r.a, r.b, r.size, r.running) for r in found) == want


def test_budget_prefix_has_no_row_limit(spark):
    rows = spark.range(120_000).selectExpr("id", "1 AS size")
    assert search.budget_prefix(rows, ["id"], "size", 100_256).count() == 100_000


def test_unique_candidates_equal_brute_force(spark):
    rng = random.Random(3)
    paths = [f"p{i}" for i in range(12)]
    uses = list({(rng.choice(paths), f"k{rng.randrange(6)}") for _ in range(40)})
    catalog = list({(f"k{rng.randrange(6)}", rng.choice(paths)) for _ in range(14)})
    taken = list({(rng.choice(paths), rng.choice(paths)) for _ in range(40)})
    want = set()
    for path, key in uses:
        left = {t for k, t in catalog if k == key and t != path and (path, t) not in taken}
        if len(left) == 1:
            want.add((path, key, left.pop()))
    found = graph.unique_candidates(spark.createDataFrame(uses, "path string, key string"), spark.createDataFrame(catalog, "key string, target string"), spark.createDataFrame(taken, "path string, target string"))
    assert want and {tuple(r) for r in found.collect()} == want


def test_dead_state_is_declared_and_used_by_no_other(spark):
    declared = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "identifier string, path string")
    used = spark.createDataFrame([("a", "z"), ("b", "x")], "identifier string, path string")
    assert {(r.identifier, r.path) for r in state.dead_state(declared, used).collect()} == {("b", "x"), ("c", "y")}


def test_barrels_are_followed_to_the_end(spark):
    links = spark.createDataFrame([(1, "app", "Card", "b0"), (2, "app", "Loop", "c0"), (3, "app", "None", "b9")], "link long, path string, exported string, target string")
    chain = [(f"b{i}", "*" if i % 2 else "Card", "*" if i % 2 else "Card", f"b{i + 1}") for i in range(7)] + [("b7", "Card", "Inner", "end")]
    circle = [("c0", "*", "*", "c1"), ("c1", "*", "*", "c0")]
    found = {r.link: (r.exported, r.target) for r in index.chase_barrels(links, spark.createDataFrame(chain + circle, "path string, name string, local string, target string")).collect()}
    assert found == {1: ("Inner", "end"), 2: ("Loop", "c1"), 3: ("None", "b9")}


def test_pointers_are_never_gone(spark, tmp_path):
    store = index.Store(spark, str(tmp_path / "store"))
    assert store.current() is None
    assert store.publish({"t": spark.range(1)}) == 1 and store.publish({"t": spark.range(2)}, 1) == 2
    assert store.table("t").count() == 2
    with pytest.raises(RuntimeError):
        store.publish({"t": spark.range(3)}, 1)


def test_exclusions_name_the_outermost_folder(spark, tmp_path, monkeypatch):
    for name in ("src/node_modules/x/a.js", "packages/ui/dist/y.js", "src/A.vue", "gen/deep/b.ts", "src/odd.gen.ts", "big.ts"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * (50 if name == "big.ts" else 1))
    (tmp_path / ".gitignore").write_text("gen/\n*.gen.ts\n")
    monkeypatch.setattr(workspace, "MAX_BYTES", 20)
    found = [tuple(r) for r in workspace.exclusions(spark, str(tmp_path)).collect()]
    assert found == [("big.ts", "too-large"), ("gen", "ignore-file"), ("packages/ui/dist", "default-ignore"), ("src/node_modules", "default-ignore"), ("src/odd.gen.ts", "ignore-file")]


def test_layout_tokens():
    yes = "flex md:flex 2xl:hidden visible invisible collapse flow-root w-[32px] gap-x-4 items-center justify-between place-items-center hover:relative space-y-2 mt-auto"
    no = "opacity-50 float-left object-cover text-lg items-left bg-red -mt-2 flexible rounded w-(x) justify-left"
    assert outline.layout_tokens(yes, 99) == yes.split() and outline.layout_tokens(no) == []
    assert len(outline.layout_tokens(" ".join(f"w-{i}" for i in range(40)))) == 15


def test_data_dependencies_by_call():
    text = """
import { saveUser as save, dropUser } from '@/server/users'
// fetch('/commented')
async function send(data) { 'use server'; await store(data) }
const a = useQuery({ enabled: on(1, 2), queryKey: ['users',   id], queryFn: () => fetch('/api/users') })
const b = useQuery(['old', 1])
const c = useSWR<User[]>('/api/swr', get), d = useSWR('plain', get)
const e = await $fetch<Map<string, User>>('https://x.y/z'), f = axios.get('api/rel'), g = other.get('/not')
const h = useFetch(() => `/api/lazy`), i = useLazyAsyncData('page', load)
form.post(route('users.store')); form.delete('/users/1'); thing.patch('name')
router.reload({ preserve: true, only: ['users', "stats"] })
submitAction(1); notaction(2); fetch(url); fetch('relative')
"""
    found = outline.data_dependencies(text)
    assert found["server_actions"] == ["saveUser", "dropUser", "send", "submitAction"]
    assert found["query_keys"] == ["['users', id]", "['old', 1]", '"/api/swr"', '"plain"', '"page"']
    assert sorted(found["endpoints"]) == sorted(["/api/users", "/api/swr", "https://x.y/z", "api/rel", "/api/lazy", "/users/1"])
    assert found["mutations"] == ["POST route('users.store')", "DELETE /users/1", "PATCH name", "RELOAD prop:users", "RELOAD prop:stats"]
    assert "submitAction" not in outline.data_dependencies("submitAction(1)")["server_actions"]
    assert outline.data_dependencies("submitAction(1)", "next")["server_actions"] == ["submitAction"]


def test_nearest_depths_and_closure_agree(spark):
    rng = random.Random(9)
    edges = [(f"n{a}", f"n{b}") for a, b in itertools.product(range(15), repeat=2) if rng.random() < 0.08]
    seen = {"n0"}
    while more := {p for p, d in edges if d in seen} - seen:
        seen |= more
    found = graph.reverse_closure(spark.createDataFrame(edges, "path string, dependency_path string"), spark.createDataFrame([("n0",)], "path string"))
    assert sorted(r.path for r in found.collect()) == sorted(seen)
