"""Aliases of configs and packages, owners, and small forms of requests and answers."""

import json

import pytest
from pyspark.sql import functions as F

from fronda.functions import paths
from fronda.operators import index, response, sync
from fronda.plans import engine
from fronda.sources import aliases, workspace

CONFIGS = {
    "tsconfig.json": '{ // root\n "extends": ["./base", "@org/conf"], "compilerOptions": { "baseUrl": "./src", "paths": { "@/*": ["*"], "~lib/*": ["lib/*", "legacy/*",], }, }, /* end */ }',
    "base.json": '{"extends": "./tsconfig.json", "compilerOptions": {"paths": {"@/*": ["wrong/*"], "url": ["http//x"], "#one": ["only/one"]}}}',
    "node_modules/@org/conf/package.json": '{"tsconfig": "cfg/t.json"}',
    "node_modules/@org/conf/cfg/t.json": '{"compilerOptions": {"paths": {"conf/*": ["../../../../conf/*"]}}}',
    "apps/web/tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["./own/*"]}}}',
    "apps/empty/tsconfig.json": "{}",
    "apps/empty/jsconfig.json": "{ broken",
    "package.json": '{"workspaces": ["tools/kit", "packages/*"]}',
    "packages/ui/package.json": '{"name": "@org/ui", "exports": {".": {"import": "./dist/index.mjs"}, "./theme": "./src/theme.ts"}}',
    "packages/plain/package.json": '{"name": "plain", "main": "lib/main.js"}',
    "packages/bare/package.json": '{"name": "bare"}',
    "packages/deep/inner/package.json": '{"name": "hidden"}',
    "tools/kit/package.json": '{"name": "kit", "exports": "./k.ts"}',
}


def test_json_with_comments():
    assert aliases.parse_jsonc('{"a": "// no", /* x */ "b": [1, 2, /* y */ ], // z\n}') == {"a": "// no", "b": [1, 2]}
    assert aliases.parse_jsonc("{") is None and aliases.parse_jsonc('{"u": "http://x/*y*/"}') == {"u": "http://x/*y*/"}


def test_chains_end_and_later_configs_win():
    merged, seen = aliases.config_chain(CONFIGS, "tsconfig.json")
    assert merged["@/*"] == ("src/*",) and merged["~lib/*"] == ("src/lib/*", "src/legacy/*") and merged["#one"] == ("only/one",) and merged["conf/*"] == ("conf/*",)
    assert sorted(seen) == ["base.json", "node_modules/@org/conf/cfg/t.json", "tsconfig.json"]


@pytest.mark.parametrize(
    ("path", "source", "first"),
    [
        ("src/a.ts", "@/x", "src/x"),
        ("apps/web/a.ts", "@/x", "apps/web/own/x"),
        ("apps/webby/a.ts", "@/x", "src/x"),
        ("src/a.ts", "#one", "only/one"),
        ("src/a.ts", "~lib/y", "src/lib/y"),
        ("src/a.ts", "@org/ui", "packages/ui/dist/index.mjs"),
        ("src/a.ts", "@org/ui/theme", "packages/ui/src/theme.ts"),
        ("src/a.ts", "@org/ui/Button", "packages/ui/src/Button"),
        ("src/a.ts", "plain", "packages/plain/lib/main.js"),
        ("src/a.ts", "bare", "packages/bare/src/index.ts"),
        ("src/a.ts", "kit", "tools/kit/k.ts"),
        ("src/a.ts", "hidden", None),
        ("src/a.ts", "react", None),
    ],
)
def test_targets(path, source, first):
    assert next(iter(aliases.targets(aliases.load(CONFIGS), path, source)), None) == first


def test_imports_through_packages(spark):
    rows = spark.createDataFrame([("src/a.ts", "@org/ui"), ("src/a.ts", "@org/ui/Button"), ("src/a.ts", "@/b"), ("src/a.ts", "react")], "path string, source string")
    files = spark.createDataFrame([("packages/ui/src/index.ts",), ("packages/ui/src/Button.vue",), ("src/b/index.ts",)], "path string")
    found = {r.source: r.target for r in index.resolve(rows, files, aliases.load(CONFIGS)).collect()}
    assert found == {"@org/ui": "packages/ui/src/index.ts", "@org/ui/Button": "packages/ui/src/Button.vue", "@/b": "src/b/index.ts", "react": None}


def test_a_config_change_and_a_childs_edit(spark, tmp_path):
    tree = tmp_path / "tree"
    for name, text in {"tsconfig.json": '{"compilerOptions": {"paths": {"#/*": ["./one/*"]}}}', "one/C.vue": "<template><p/></template>", "two/C.vue": "<template><b/></template>", "App.vue": "<script setup>\nimport C from '#/C.vue'\n</script><template><C/></template>"}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(text)
    work = engine.Workspace(spark, str(tree), str(tmp_path / "store"))
    edges = lambda: {(r.parent, r.child) for r in work.store.table("edges").collect()}
    assert work.sync()["parsed"] == 3 and edges() == {("App.vue", "one/C.vue")}
    (tree / "one/C.vue").write_text("<template><i/></template>")
    assert work.sync()["parsed"] == 2  # the file, and what imports it
    (tree / "tsconfig.json").write_text('{"compilerOptions": {"paths": {"#/*": ["./two/*"]}}}')
    work.sync()
    assert edges() == {("App.vue", "two/C.vue")}


def test_manifest_hashes(spark):
    files = spark.createDataFrame([("b/é.ts", "2"), ("a.ts", "1")], "path string, hash string")
    import hashlib

    want = hashlib.sha256(('["a.ts","1"]\n["b/é.ts","2"]\n').encode()).hexdigest()
    assert tuple(sync.manifest_hash(files).first()) == (want, 2)
    assert sync.manifest_hash(files.unionByName(spark.createDataFrame([("c", None)], files.schema))).first()[0] is None
    many = spark.range(400).selectExpr("concat('p', id) AS path", "cast(id AS string) AS hash")
    one, two = (sync.manifest_tree_hash(many.repartition(n), 20).first() for n in (2, 5))
    assert one == two and one.files == 400 and sync.manifest_tree_hash(many.filter("path <> 'p7'"), 20).first() != one


def test_owners_types_and_versions(spark):
    files = spark.createDataFrame([("a/b/c.ts",), ("a/x.ts",), ("z.ts",), ("q/r.ts",)], "path string")
    found = {r.path: r.owner for r in workspace.owners(files, spark.createDataFrame([("a/b/package.json",), ("a/tsconfig.json",)], "path string")).collect()}
    assert found == {"a/b/c.ts": "a/b", "a/x.ts": "a", "z.ts": None, "q/r.ts": None}
    names = ["app/page.tsx", "app/route.ts", "app/route.tsx", "app/global-error.js", "app/page.vue", "app/x/default.jsx"]
    kinds = spark.createDataFrame([(n,) for n in names], "p string").select(paths.app_file_type(F.col("p"))).collect()
    assert [k[0] for k in kinds] == ["page", "api", None, "error", None, "default"]
    v = spark.createDataFrame([("^3.5.13",), ("~18.2",), ("next",), (None,)], "v string").select(paths.semver(F.col("v")).alias("s")).collect()
    assert [tuple(r.s) if r.s else None for r in v] == [(3, 5, 13), (18, 2, 0), None, None]


def test_requests_and_answers():
    assert [response.positive_int(v, 7) for v in (3, "4.9", 0, "x", None, float("inf"), True)] == [3, 4, 7, 7, 7, 7, 1]
    assert response.string_list(" a, ,b") == ["a", "b"] and response.string_list([1, " "]) == ["1"] and response.string_list("") is None
    assert response.alias_map("@=src, ~ = app,=x") == {"@": "src", "~": "app"} == response.alias_map('{"@": "src", "~": " app "}') and response.alias_map([]) is None
    for size in (5, 300, 301, 1000, 123456):
        found = response.output_digest("x " * size)
        text = found["sample_preview"]
        assert len(text) <= 300 and ("omitted" in text) == (2 * size - 1 > 300)
        if "omitted" in text:
            left = int(text.split("[")[1].split(" ")[0])
            assert left == 2 * size - 1 - (len(text) - len(f" ... [{left} chars omitted] ... "))
    assert response.output_digest("  ") == {"summary": "empty_output"}
    text = response.bounded_json(lambda n: {"rows": list(range(n))}, 10_000)
    assert len(text.encode()) <= response.BUDGET_BYTES and len(json.loads(text)["rows"]) > 500
    body, n = response.fit_collection(lambda rows: {"rows": rows}, ["é" * 10] * 1000, 1000)
    assert len(body.encode()) <= 1000 < len(json.dumps({"rows": ["é" * 10] * (n + 1)}, ensure_ascii=False).encode())
    assert response.selected_count({"a": {"b": [1, 2]}, "c": [3]}, ["a.b", "c"]) == 3 and response.selected_count({"a": 1}, ["a"]) is None
    assert response.preview({"a": [1, 2, 3, 4]}, "a") == {"count": 4, "items": [1, 2, 3], "more": 1}
    found = response.dynamic_warnings('<component :is="view" x/><component v-bind:is="Known"/><Dialog.Trigger asChild><b/></Dialog.Trigger>', {"Known"})
    assert [w["component"] for w in found] == ['<component :is="view">', "<Dialog.Trigger asChild>"]
