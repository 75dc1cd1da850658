"""A small workspace from files to answers."""

import json

import pytest
from pyspark.sql import functions as F

from fronda.operators import graph, index, parse, state
from fronda.sources import workspace
from fronda.streaming import telemetry as stream

FILES = {
    "package.json": "{}",
    ".gitignore": "gen/\n*.gen.ts\n!keep.gen.ts\n",
    "src/App.vue": """<script setup lang="ts">
import Dashboard from './Dashboard.vue'
import { StatCard as Card } from '@/ui'
import type { T } from './types'
// import Ghost from './Ghost.vue'
const Lazy = defineAsyncComponent(() => import('./Lazy.vue'))
const cart = useCartStore()
</script>
<template>
  <Dashboard title="hi" :count="cart.total" @done="cart.checkout" />
  <Card v-bind="$attrs" />
  <auto-thing/>
  <!-- <Ghost /> -->
</template>
""",
    "src/Dashboard.vue": """<script setup lang="ts">
interface Props { title: string; count?: number; tags: Array<{ a: string }> }
const props = withDefaults(defineProps<Props>(), { count: 0 })
const emit = defineEmits<{ (e: 'done', id: number): void; (e: 'close'): void }>()
const open = defineModel<boolean>('open')
defineExpose({ reset, focus })
const cart = useCartStore()
cart.add(1)
watch(() => cart.total, () => {})
const { data } = await useFetch('/api/users//7')
fetch(`/api/items/${props.item.id}`, { method: 'POST', body: JSON.stringify({ name: 1, qty: 2 }) })
</script>
<template><slot/><slot name="foot"/></template>
""",
    "src/ui/index.ts": "export { default as StatCard } from './StatCard.vue'\nexport * from './more'\n",
    "src/ui/more.ts": "export const x = 1\n",
    "src/ui/StatCard.vue": "<script>export default { props: ['a', 'b'] }</script><template><p/></template>",
    "src/Lazy.vue": "<template><p>lazy</p></template>",
    "src/AutoThing.vue": "<template><p>auto</p></template>",
    "src/Orphan.vue": "<template><p>orphan</p></template>",
    "src/stores/cart.ts": "export const useCartStore = defineStore('cart', {})\nexport function useDead() {}\n",
    "src/pages/users/[id].vue": "<template><p/></template>",
    "server/api/users/[id].get.ts": "export default defineEventHandler(() => 1)\n",
    "src/Panel.tsx": "'use client'\nimport React from 'react'\ninterface PanelProps { title: string; onClose?: () => void; children: Node }\nexport function Panel({ title }: PanelProps) { return <Card.Item a={1} {...rest} /> }\n",
    "src/S.svelte": "<script lang=\"ts\">\nlet { name, on = 1, children }: { name: string; on?: number; children: Snippet } = $props();\n</script>\n<p>{name}</p>\n",
    "src/Old.svelte": "<script>export let id; export let size = 3; dispatch('pick')</script><slot name=\"x\"/>",
    "src/P.astro": "---\ninterface Props { href: string; label?: string }\nconst { href } = Astro.props\n---\n<a href={href}><slot /></a>\n",
    "src/gen/a.ts": "export const g = 1\n",
    "src/b.gen.ts": "export const g = 1\n",
    "src/keep.gen.ts": "export const g = 1\n",
    "node_modules/x/index.js": "export const n = 1\n",
    ".hidden/h.ts": "export const h = 1\n",
    "docs/readme.ts": "export const d = 1\n",
    "src/notes.md": "# no\n",
    "src/pages/_app.tsx": "export const a = 1\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("workspace")
    for name, text in FILES.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(base)


@pytest.fixture(scope="module")
def files(spark, root):
    return workspace.scan(spark, root).cache()


@pytest.fixture(scope="module")
def parsed(files):
    return parse.parsed(files).cache()


@pytest.fixture(scope="module")
def tables(parsed):
    return {k: v.cache() for k, v in index.graph_tables(parsed).items()}


def test_scan(spark, root, files):
    found = {r.path for r in files.collect()}
    left_out = {"src/gen/a.ts", "src/b.gen.ts", "node_modules/x/index.js", ".hidden/h.ts", "docs/readme.ts", "src/notes.md", "package.json", ".gitignore"}
    assert found == set(FILES) - left_out
    assert "package.json" in {r.path for r in workspace.scan(spark, root, configs=True).collect()}
    assert "src/ui/more.ts" not in {r.path for r in workspace.scan(spark, root, exclude=["src/ui"]).collect()}
    assert {r.path: r.reason for r in workspace.exclusions(spark, root).collect()}["node_modules"] == "default-ignore"
    counts = {r.extension: r.files for r in workspace.extension_counts(files).collect()}
    assert counts[".astro"] == 1 and counts[".mjs"] == 0


def test_edges(tables):
    found = {(r.parent, r.child): (r.import_type, r.is_rendered) for r in tables["edges"].collect()}
    assert found == {
        ("src/App.vue", "src/Dashboard.vue"): ("static", True),
        ("src/App.vue", "src/ui/StatCard.vue"): ("static", True),
        ("src/App.vue", "src/Lazy.vue"): ("dynamic", False),
        ("src/App.vue", "src/AutoThing.vue"): ("auto", True),
    }


def test_contracts(parsed):
    found = {r.path: r.contract for r in parsed.collect()}
    dash = found["src/Dashboard.vue"]
    assert [(p.name, p.type, p.required) for p in dash.props] == [("title", "string", True), ("count", "number", False), ("tags", "Array<{ a: string }>", True), ("open", "boolean", False)]
    assert (dash.emits, dash.slots, dash.models, dash.exposed) == (["done", "close", "update:open"], ["default", "foot"], ["open"], ["reset", "focus"])
    assert [(p.name, p.required) for p in found["src/Panel.tsx"].props] == [("title", True), ("onClose", False), ("children", True)]
    assert found["src/Panel.tsx"].slots == ["default"]
    assert [(p.name, p.type, p.required) for p in found["src/S.svelte"].props] == [("name", "string", True), ("on", "number", False), ("children", "Snippet", True)]
    assert [(p.name, p.required) for p in found["src/Old.svelte"].props] == [("id", True), ("size", False)] and found["src/Old.svelte"].emits == ["pick"] and found["src/Old.svelte"].slots == ["x"]
    assert [(p.name, p.required) for p in found["src/P.astro"].props] == [("href", True), ("label", False)] and found["src/P.astro"].slots == ["default"]


def test_state(tables, parsed):
    deps = tables["state_deps"].filter("path = 'src/Dashboard.vue' AND identifier = 'useCartStore'").orderBy("line_number").collect()
    assert [(r.access_mode, r.usage_snippet) for r in deps] == [("read", "const cart = useCartStore()"), ("write", "cart.add()"), ("watch", "watch(() => cart.total, () => {})")]
    app = tables["state_deps"].filter("path = 'src/App.vue' AND access_mode = 'write'").collect()
    assert [r.usage_snippet for r in app] == ["cart.checkout"]
    with_id = tables["state_deps"].withColumn("id", F.monotonically_increasing_id())
    impact = {r.path: r.role for r in state.state_impact(with_id, tables["files"], "useCartStore").collect()}
    assert impact == {"src/App.vue": "mutator", "src/Dashboard.vue": "mutator"}
    assert [r.identifier for r in state.dead_state(tables["declared"], tables["state_deps"]).collect()] == ["useDead"]


def test_calls_and_routes(parsed, tables):
    found = {r.endpoint: (list(r.methods), r.callers) for r in index.endpoint_summary(parsed).collect()}
    assert found == {"/api/users/7": (["GET"], 1), "/api/items/:id": (["POST"], 1)}
    assert [r.url_path for r in index.match_route(tables["routes"], "/users/7").collect()] == ["/users/[id]"]
    call = parse.table(parsed, "calls").filter("method = 'POST'").first()
    assert list(call.payload) == ["name", "qty"] and call.line == 11


def test_unused_and_props(parsed, tables):
    unused = {r.path for r in index.unused_components(parsed, tables).collect()}
    assert "src/Orphan.vue" in unused and not unused & {"src/Dashboard.vue", "src/Lazy.vue", "src/AutoThing.vue", "src/ui/StatCard.vue"}
    impact = {r.name: (r.usages, r.omissions, r.indeterminate) for r in index.prop_impact(parsed, tables, "src/Dashboard.vue").collect()}
    assert impact == {"title": (1, 0, 0), "count": (1, 0, 0), "tags": (0, 1, 0), "open": (0, 1, 0)}


def test_search(files, parsed):
    assert [(r.path, r.line, r.column) for r in index.find_literal(files, "cart.add").collect()] == [("src/Dashboard.vue", 8, 1)]
    assert [(r.path, r.tag) for r in index.find_component(parsed, "Dashboard").collect()] == [("src/App.vue", "Dashboard")]
    assert [r.expression for r in index.find_prop(parsed, "dashboard", "count").collect()] == ["cart.total"]


def test_store_generations(spark, tables, tmp_path):
    store = index.Store(spark, f"{tmp_path}/store")
    assert store.current() is None
    with pytest.raises(LookupError):
        store.table("files")
    assert store.publish({"files": tables["files"]}) == 1
    assert store.publish({"files": tables["files"].limit(1)}, expected=1) == 2
    assert store.table("files").count() == 1
    with pytest.raises(RuntimeError):
        store.publish({"files": tables["files"]}, expected=1)


def test_blast_radius_of_a_file(spark, tables):
    target = spark.createDataFrame([("src/ui/StatCard.vue",)], "path string")
    assert [(r.path, r.depth) for r in graph.blast_radius(tables["edges"], target, 5).collect()] == [("src/App.vue", 1)]


def test_positions_count_utf16():
    assert parse.position("a\n\U0001f600x", 3) == (2, 3)
    assert parse.blank_comments("a // b\n'//c' /* d */e") == "a     \n'//c'        e"


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"timestamp": f"2024-01-01T00:{m:02d}:00Z", "tool": "a" if m % 2 else "b", "duration_ms": m * 20.0, "status": "error" if m % 5 == 0 else "ok", "metrics": {"items_found": m}} for m in range(30)]
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "one.json").write_text("\n".join([json.dumps(r) for r in rows] + ["not json"]))
    batch = stream.rollup(stream.read_log(spark, str(folder))).collect()
    stream.run(stream.read_stream(spark, str(folder)), f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.parquet(f"{tmp_path}/out").filter("tool IS NOT NULL").collect()
    last, closed = max(r.end for r in batch), max(r.end for r in got)
    # windows that the watermark has not passed are still open; of the others none is lost
    measures = lambda rows: sorted((r.start, r.tool, r.calls, r.errors, r.slow) for r in rows)
    assert measures(got) == measures(r for r in batch if r.tool is not None and r.end <= closed)
    assert got and closed < last


def test_underscore_folders_and_deep_folders(spark, tmp_path):
    deep = "/".join(f"f{k}" for k in range(10))
    wanted = ["app/_components/Button.vue", "app/_components/_inner/Icon.vue", "app/_[id]/a/Page.vue", f"{deep}/_deep.ts", f"{deep}/kept.ts", "app/plain.ts"]
    for name in [*wanted, f"{deep}/left.ts", "_build/no.ts"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("export const x = 1\n")
    (tmp_path / deep / ".gitignore").write_text("left.ts\n")
    assert sorted(r.path for r in workspace.scan(spark, str(tmp_path)).select("path").collect()) == sorted(wanted)
