"""Questions about one text, refactoring proposals, tokens and folds."""

import pytest
from pyspark.sql import functions as F

from fronda.functions import layers
from fronda.operators import evidence, outline, refactor
from fronda.operators.patches import apply, drop_overlaps

CODE = """import { a } from './a'
export interface Shape { x: number; y: { z: string } }
type Alias = 'one' | 'two'
/* function ghost() {} */
export async function load(id: string): Promise<void> {
  const inner = () => { return helper(id) }
  return inner()
}
const double = (n: number) => n * 2
const limit = 3
export default class Box { open() {} }
"""


def test_symbols_and_slices():
    found = outline.symbols(CODE)
    assert [(s["name"], s["kind"], s["exported"], s["start_line"], s["end_line"]) for s in found] == [
        ("Shape", "interface", True, 2, 2), ("Alias", "type", False, 3, 3), ("load", "function", True, 5, 8), ("double", "function", False, 9, 9), ("limit", "variable", False, 10, 10), ("Box", "class", True, 11, 11),
    ]
    s = outline.slice_symbol(CODE, "load")
    assert s["source"].startswith("export async function load") and s["source"].endswith("}") and s["calls"] == ["helper", "inner"]
    assert outline.slice_symbol(CODE, "ghost") is None


VUE = """<script setup>
import { outer } from './o'
const count = ref(0)
function save() {}
function never() {}
const { close } = useModal()
</script>
<template>
  <div class="flex p-2 text-red" :class="{ hidden: !open }" v-if="ready">
    <b @click="save" @close="close()" @x="() => outer(1)" @y="missing" @z="count++" />
  </div>
</template>
"""


def test_event_audit_and_layout():
    found = {e["event"]: (e["handler"], e["state"]) for e in outline.event_handlers("A.vue", VUE)}
    assert found == {"click": ("save", "valid"), "close": ("close", "valid"), "x": ("outer", "valid"), "y": ("missing", "broken"), "z": ("count", "inline")}
    assert [e["line"] for e in outline.event_handlers("A.vue", VUE)] == [10] * 5  # of the file, not of its block
    assert outline.unused_functions("A.vue", VUE) == ["never"]
    shape = outline.layout("A.vue", VUE)
    assert (shape["root"], shape["tokens"]) == ("div", ["flex", "p-2"])
    assert shape["classes"] == [{"condition": "!open", "tokens": ["hidden"]}] and shape["visibility"][0]["condition"] == "ready"
    assert [(r["kind"], r["name"]) for r in outline.regions("A.vue", VUE) if r["parent"] is not None] == [("variable", "count"), ("function", "save"), ("function", "never")]


def test_boundaries_and_configs():
    assert outline.render_boundary("app/x.tsx", "// c\n'use client'\n", "next")["boundary"] == "client-component"
    server = outline.render_boundary("app/page.tsx", "const s = useState(0)\nreturn <b onClick={f}/>", "next")
    assert server["boundary"] == "server-component" and len(server["violations"]) == 2
    assert outline.render_boundary("a.astro", "<X client:load/>", "astro")["directive"] == "client:load"
    assert outline.literal_config("definePageMeta({ layout: 'admin', keep: true, title: name })", "definePageMeta") == {"fields": {"layout": "admin", "keep": "true"}, "unresolved": ["title"]}
    assert outline.segment_config("export const runtime = 'edge'\nexport const revalidate = 60") == {"runtime": "edge", "revalidate": "60"}
    deps = outline.data_dependencies("const q = useQuery({ queryKey: ['a',  1] }); router.post(route('x.y')); useSWR('/api/s')")
    assert deps == {"server_actions": [], "query_keys": ["['a', 1]", '"/api/s"'], "endpoints": ["/api/s"], "mutations": ["POST route('x.y')"]}
    assert outline.dynamic_imports("import.meta.glob('./p/*.vue'); const L = lazy(() => import('./L'))")["lazy"] == ["./L"]


CONSUMER = """<template>
  <UserCard title="a" :title="b" v-bind:title.sync="c" @save-all="f" v-model:open="o">
    <template #head>x</template>
  </UserCard>
  <user-card :first-name="n" v-bind="rest"/>
  <!-- <UserCard title="no" /> -->
  <Other title="no" />
</template>
"""


def patched(spark, kind, old, new=""):
    rows = [(("f"), p["start"], p["end"], p["replacement"]) for p in refactor.propose(CONSUMER, "UserCard", kind, old, new) if p["state"] == "ready"]
    plans = drop_overlaps(spark.createDataFrame(rows, "file string, start long, end long, replacement string"))
    return apply(spark.createDataFrame([("f", CONSUMER)], "file string, content string"), plans).first().content


def test_proposals(spark):
    assert patched(spark, "rename_prop", "title", "label") == CONSUMER.replace('title="a"', 'label="a"').replace(':title="b"', ':label="b"').replace("v-bind:title.sync", "v-bind:label.sync")
    assert patched(spark, "rename_prop", "firstName", "givenName") == CONSUMER.replace("first-name", "given-name")
    assert patched(spark, "rename_event", "saveAll", "storeAll") == CONSUMER.replace("save-all", "store-all")
    assert patched(spark, "rename_model", "open", "shown") == CONSUMER.replace("v-model:open", "v-model:shown")
    assert patched(spark, "rename_slot", "head", "top") == CONSUMER.replace("#head", "#top")
    assert patched(spark, "remove_prop", "firstName") == CONSUMER.replace(' :first-name="n"', "")
    assert [p["state"] for p in refactor.propose(CONSUMER, "UserCard", "rename_prop", "none", "x")] == ["by-hand"]
    assert all(CONSUMER[p["start"] : p["end"]] == p["old_snippet"] for p in refactor.propose(CONSUMER, "UserCard", "rename_component", "", "Person"))


def test_tokens():
    token = evidence.encode_token(12, 50, tool="find", queryId="q", selectionHash="h")
    assert evidence.verify_token(token, tool="find", queryId="q", selectionHash="h") == 12
    for wrong, word in (({"tool": "other"}, "invalid"), ({"selectionHash": "x"}, "stale")):
        with pytest.raises(ValueError, match=word):
            evidence.verify_token(token, **wrong)
    with pytest.raises(ValueError, match="read"):
        evidence.verify_token("%%%")


def test_budget_pages_every_item_once():
    items, at, seen = [{"n": i, "t": "x" * (i % 7)} for i in range(50)], 0, []
    while at is not None:
        some, at = evidence.take_budget(items, 512, 12, at)
        seen += some
    assert seen == items
    with pytest.raises(ValueError, match="larger"):
        evidence.take_budget([{"t": "x" * 600}], 512)
    assert evidence.identity({"b": 1, "a": "é"}) == evidence.identity({"a": "é", "b": 1})


def test_effective_segment(spark):
    schema = "id int, chain array<struct<runtime:string,region:string,max_duration:double,revalidate:double,unknown:array<string>>>"
    rows = [(1, [("nodejs", "a", 10.0, 60.0, []), (None, "b", None, 30.0, [])]), (2, [("edge", None, None, 60.0, [])]), (3, [(None, "a", None, 60.0, ["revalidate"]), (None, None, None, None, ["region", "revalidate"])]), (4, [])]
    found = {r.id: tuple(r.e) for r in spark.createDataFrame(rows, schema).select("id", evidence.effective_segment(F.col("chain")).alias("e")).collect()}
    assert found == {1: ("nodejs", "b", 10.0, 30.0), 2: ("edge", None, None, None), 3: (None, None, None, None), 4: (None, None, None, None)}


@pytest.mark.parametrize(
    ("path", "expected"),
    [
        ("src/App.vue", (None, "root", None, "component")),
        ("src/domains/billing/components/Invoice.vue", (None, "billing", None, "component")),
        ("apps/web/src/stores/cart.ts", ("web", "stores", None, "state")),
        ("src/shared/api/client.ts", (None, "shared", "api", "service")),
        ("app/(dash)/layout.tsx", (None, "app", "(dash)", "layout")),
        ("src/a.test.ts", None),
    ],
)
def test_layers(spark, path, expected):
    r = spark.createDataFrame([(path,)], "p string").select(layers.domain(F.col("p")).alias("d")).first().d
    assert (tuple(r) if r else None) == expected
