"""Patterns over tokens, rules, template expressions, variants, declarations, backend targets."""

import pytest
from pyspark.sql import functions as F

from fronda.functions import targets
from fronda.operators import graph, index, outline, parse, refactor, routing, structure, telemetry

CODE = """const a = console.log(x + 1, y); // console.log(z)
foo.console.log(b)
const props = defineProps<{ a: Array<string>; b?: { c: number } }>()
const B = defineAsyncComponent(() => import('./b.vue'))
const load = () => axios.post(`/x`, { key: 1 })
axios.get('/y')
if (a === a) swap(q.r, q.r); swap(q, r)
useFoo(useFoo(1))
"""


@pytest.mark.parametrize(
    ("pattern", "found"),
    [
        ("console.log($$$)", ["console.log(x + 1, y)"]),
        ("console.log($A)", []),
        ("console.log($A, $B)", ["console.log(x + 1, y)"]),
        ("defineProps<$$$>()", ["defineProps<{ a: Array<string>; b?: { c: number } }>()"]),
        ("defineAsyncComponent($$$)", ["defineAsyncComponent(() => import('./b.vue'))"]),
        ("$C.$M($URL, $$$REST)", ["console.log(x + 1, y)", "axios.post(`/x`, { key: 1 })"]),
        ("axios.$M($URL)", ["axios.get('/y')"]),
        ("swap($A, $A)", ["swap(q.r, q.r)"]),
        ("$A === $A", ["a === a"]),
        ("const a = $V", ["const a = console.log(x + 1, y);"]),
        ("useFoo($X)", ["useFoo(useFoo(1))", "useFoo(1)"]),
        ("import($P)", ["import('./b.vue')"]),
    ],
)
def test_patterns(pattern, found):
    assert [CODE[a:b] for a, b in structure.Pattern(pattern).spans(CODE)] == found


def test_tags_and_bad_patterns():
    html = "<div><OldButton>it's <b>x</b></OldButton> <OldButton a='1 > 0' /></div>"
    assert [html[a:b] for a, b in structure.Pattern("<OldButton>$$$</OldButton>").spans(html)] == ["<OldButton>it's <b>x</b></OldButton>"]
    assert [html[a:b] for a, b in structure.Pattern("<OldButton $$$ />").spans(html)] == ["<OldButton a='1 > 0' />"]
    for bad in ("", "$$$", "f($A"):
        with pytest.raises(ValueError):
            structure.Pattern(bad)
    assert structure.Pattern("f($A)").spans("") == []


def test_rules():
    take = lambda rule: [CODE[a:b] for a, b in structure.by_rule(rule, CODE)]
    assert take({"pattern": "$F($$$)", "inside": {"pattern": "useFoo($$$)"}}) == ["useFoo(1)"]
    assert take({"any": [{"pattern": "axios.get($$$)"}, {"pattern": "axios.post($$$)"}], "has": {"pattern": "`/x`"}}) == ["axios.post(`/x`, { key: 1 })"]
    assert take({"pattern": "axios.$M($$$)", "not": {"pattern": "axios.get($$$)"}}) == ["axios.post(`/x`, { key: 1 })"]
    assert take({"all": [{"pattern": "swap($A, $B)"}, {"pattern": "swap($A, $A)"}]}) == ["swap(q.r, q.r)"]
    assert take({"pattern": "swap($$$)", "regex": r"\(q,"}) == ["swap(q, r)"]
    for bad in ({}, {"regex": "x"}, {"pattern": "f()", "kind": "call"}):
        with pytest.raises(ValueError):
            structure.by_rule(bad, CODE)


VUE = """<script setup>
track('a')
</script>
<template>
  <li v-for="(row, i) in rows.filter(keep)" :key="row.id" @click="track(row.id)">{{ label(row) }}</li>
</template>
"""


def test_template_expressions_and_files(spark):
    found = structure.template_expressions("A.vue", VUE)
    assert [(e["kind"], e["source"].strip(), e["bindings"]) for e in found] == [("v-for", "rows.filter(keep)", ["row", "i"]), (":key", "row.id", []), ("@click", "track(row.id)", []), ("interpolation", "label(row)", [])]
    assert all(VUE[e["start"] : e["start"] + len(e["source"])] == e["source"] for e in found)
    files = spark.createDataFrame([("A.vue", VUE), ("b.ts", "// track(1)\n"), ("c.ts", None), ("d.tsx", "😀; track(2)")], "path string, content string")
    rows = structure.find(files, "track($X)").collect()
    assert [(r.path, r.line, r.column, r.end_column, r.text) for r in rows] == [("A.vue", 2, 1, 11, "track('a')"), ("A.vue", 5, 67, 80, "track(row.id)"), ("d.tsx", 1, 5, 13, "track(2)")]
    assert [r.path for r in structure.find(files, rule={"pattern": "track($X)", "regex": r"\d"}, limit=1).collect()] == ["d.tsx"]
    assert structure.find(files.limit(0), "track($X)").count() == 0
    with pytest.raises(ValueError):
        structure.find(files)


def test_variants():
    code = "const b = cva('base', { variants: { size: { sm: 'x', 'extra-lg': 'y' }, tone: { red: ['r', { z: 1 }] }, none: {} }, defaultVariants: { size: 'sm' } })"
    assert outline.variants(code, []) == {"variants": {"size": ["sm", "extra-lg"], "tone": ["red"]}, "defaults": {"size": "sm"}}
    props = [{"name": "variant", "type": "'a' | 'b' | undefined"}, {"name": "size", "type": "'a' | string"}, {"name": "other", "type": "'a' | 'b'"}]
    assert outline.variants("", props) == {"variants": {"variant": ["a", "b"]}, "defaults": {}}
    assert outline.variants("cva('x')", []) is None


def test_declarations_and_coverage(spark):
    text = "<script setup>\nconst p = defineProps({ userName: String })\n  const e = defineEmits(['save'])\n</script>\n<template><slot name=\"top\" /></template>\n"
    found = refactor.declarations("A.vue", text, [("rename_prop", "user-name"), ("rename_event", "save"), ("rename_slot", "top"), ("rename_slot", "none")])
    assert [(f["symbol"], f["found"], f.get("line")) for f in found] == [("userName", True, 2), ("save", True, 3), ("top", True, 5), ("none", False, None)]
    assert found[1]["snippet"] == text[found[1]["start"] : found[1]["end"]] == "const e = defineEmits(['save'])"
    files = spark.createDataFrame([("a.vue", "<user-card/>"), ("b.ts", "UserCard"), ("c.tsx", None), ("d.vue", "x")], "path string, content string")
    assert tuple(refactor.coverage(files, "UserCard").first()) == (3, 1, 1, 1)


def test_backend_targets(spark):
    rows = [
        ("POST", "/api/v1/checkout"), ("get", "https://x.y/api/blog-posts/:id?z=1"), ("", "route('orders.store')"), ("PATCH", "/orders/{id}/approve/"),
        ("DELETE", "/boxes"), ("GET", "/"), (None, "categories.index"),
    ]
    df = spark.createDataFrame(rows, "m string, e string").select(targets.backend_target(F.col("m"), F.col("e")).alias("t")).select("t.*")
    got = [(r.intent, r.route_name, r.symbols) for r in df.collect()]
    assert got[0] == ("POST api/v1/checkout", None, ["CheckoutController", "CheckoutController@checkout", "CheckoutAction", "CheckoutService", "CheckoutHandler"])
    assert got[1][0] == "GET api/blog-posts/:id" and got[1][2][:2] == ["Blog-postController", "Blog-postController@show"] and got[1][2][-1] == "BlogPostHandler"
    assert got[2][:2] == ("GET orders.store", "orders.store") and "OrderController@store" in got[2][2]
    assert got[3][2] == ["ApproveController", "ApproveController@approve", "ApproveAction", "ApproveService", "OrderController", "OrderController@approve", "OrderService", "OrderHandler", "ApproveHandler"]
    assert got[4][2][1] == "BoxController@destroy" and got[5][:2] == ("GET /", None) and got[5][2][0] == "DefaultController"
    assert got[6][2][0] == "CategoryController"


def test_first_nodes(spark):
    edges = spark.createDataFrame([("a", f"c{i}") for i in range(5)] + [("c0", "d")], "parent string, child string")
    tree = graph.tree_paths(edges, spark.createDataFrame([("a",)], "path string"), 2, down=True)
    some = graph.first_nodes(tree, 3).collect()
    assert sorted(r.node for r in some) == ["a", "c0", "c1", "c2"] and all(r.has_more for r in some)
    assert {(r.node, r.has_more) for r in graph.first_nodes(tree, 6).collect()} == {(n, False) for n in ("a", "c0", "c1", "c2", "c3", "c4", "d")}


def test_app_routes(spark):
    names = ["app/layout.tsx", "app/page.tsx", "app/(shop)/cart/page.tsx", "app/(shop)/layout.jsx", "app/@modal/(..)photo/[id]/page.tsx", "app/api/x/route.ts", "app/api/x/help.ts", "lib/page.tsx", "web/app/(shop)/cart/layout.js"]
    found = {r.path: r for r in routing.app_routes(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert set(found) == set(names) - {"app/api/x/help.ts", "lib/page.tsx"}
    cart = found["app/(shop)/cart/page.tsx"]
    assert (cart.url_path, cart.type, cart.groups, cart.slot, cart.layouts) == ("/cart", "page", ["(shop)"], None, ["app/layout.tsx", "app/(shop)/layout.jsx"])
    photo = found["app/@modal/(..)photo/[id]/page.tsx"]
    assert (photo.url_path, photo.slot, photo.intercepting, photo.layouts, photo.params[0].name) == ("/photo/[id]", "@modal", "(..)photo", ["app/layout.tsx"], "id")
    assert (found["app/page.tsx"].url_path, found["app/api/x/route.ts"].type) == ("/", "api")
    assert found["web/app/(shop)/cart/layout.js"].layouts == ["web/app/(shop)/cart/layout.js"]


def test_contexts(spark):
    assert parse.contexts("A.vue", "<script setup>\n// inject('no')\nprovide('theme', x)\nconst t = inject<Theme>(KEY, null)\n</script>\n<template><Cart.Provider><b>inject('text')</b></Cart.Provider></template>") == [
        {"role": "provider", "key": "theme", "line": 3}, {"role": "consumer", "key": "KEY", "line": 4}, {"role": "provider", "key": "Cart", "line": 6},
    ]
    assert parse.contexts("a.tsx", "const x = React.useContext(Cart)\nreturn <Theme.Provider value={1}><A /></Theme.Provider>") == [{"role": "consumer", "key": "Cart", "line": 1}, {"role": "provider", "key": "Theme", "line": 2}]
    files = spark.createDataFrame([("App.vue", "h", "<script setup>\nimport B from './B.vue'\nprovide('a', 1)\n</script>\n<template><B /></template>"), ("B.vue", "h", "<script setup>\ninject('a')\ninject('b')\n</script>")], "path string, hash string, content string")
    parsed = parse.parsed(files)
    rows = index.context_audit(parsed, index.graph_tables(parsed)["edges"], "App.vue").collect()
    assert sorted((r.node, r.key, r.branch, r.provider) for r in rows if r.key == "a") == [("B.vue", "a", "App.vue>B.vue", "App.vue")]
    assert [(r.node, r.provider) for r in rows if r.key == "b"] == [("B.vue", None)]


def test_symbol_callers(spark):
    texts = {
        "lib/a.ts": "export const run = () => 1\nexport { run as go }\n", "lib/index.ts": "export { run as start } from './a'\nexport * from './b'\n", "lib/b.ts": "export const other = 1\n",
        "u1.ts": "import { start as s } from './lib'\ns()\n", "u2.ts": "import { go } from './lib/a'\n// go()\nconst x = go\n", "u3.ts": "import * as all from './lib/a'\nall.run(1)\n", "u4.ts": "import { other } from './lib'\nother()\n",
    }
    files = spark.createDataFrame([(p, "h", t) for p, t in texts.items()], "path string, hash string, content string")
    rows = index.symbol_callers(files, parse.parsed(files), "lib/a.ts", "run").collect()
    found = {(r.path, r.name): r.verdict for r in rows}
    assert found[("u1.ts", "s")] == "caller" and found[("u3.ts", "all.run")] == "caller" and ("u4.ts", "other") not in found and found[("u2.ts", "go")] == "importer"


def test_log_and_nearest_index(tmp_path):
    log = tmp_path / "x" / "log.jsonl"
    assert telemetry.append(str(log), {"a": "é"}) and not telemetry.append(str(log), {"a": "x" * 5000}) and not telemetry.append(str(log), {"a": object()})
    assert log.read_text(encoding="utf-8") == '{"a":"é"}\n'
    log.write_bytes(b"x" * telemetry.LOG_BYTES)
    assert telemetry.append(str(log), {"b": 1}) and log.read_text() == '{"b":1}\n' and (tmp_path / "x" / "log.jsonl.1").stat().st_size == telemetry.LOG_BYTES
    (tmp_path / "p" / "q").mkdir(parents=True)
    (tmp_path / "p" / ".store").mkdir()
    assert index.nearest_index(str(tmp_path / "p" / "q"), ".store") == str(tmp_path / "p") and index.nearest_index(str(tmp_path / "x"), ".no-store") is None
