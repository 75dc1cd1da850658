"""Operators on small frames with hand-made expectations."""

import pytest
from pyspark.sql import functions as F

from fronda.functions import names, paths
from fronda.operators import graph, patches, search, state, sync, telemetry


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "search_form", "patch_form"), [("HTMLView", "html-view", "htmlview"), ("userIDCard", "user-id-card", "user-idcard"), ("two words_x", "two words_x", "two-words-x"), ("", "", "")])
def test_kebab(spark, name, search_form, patch_form):
    assert one(spark, names.kebab(F.col("n")), n=name) == search_form
    assert one(spark, names.kebab_attribute(F.col("n")), n=name) == patch_form


def test_candidates_and_keys(spark):
    assert one(spark, names.candidates(F.col("n")), n="api-card") == ["api-card", "ApiCard", "APICard"]
    assert one(spark, names.tag_keys(F.col("n")), n="Ui.DataTable") == ["case:ui.datatable", "kebab:ui.data-table", "case:datatable", "kebab:data-table"]
    assert one(spark, names.clean_identifier(F.col("n")), n="v-bind:title.sync") == "title"
    assert one(spark, names.matches(F.col("a"), F.col("b")), a="user-card", b="UserCard")


@pytest.mark.parametrize(("glob", "path", "hit"), [("**/*.test.ts", "src/a.test.ts", True), ("src/*.vue", "src/x/A.vue", False), ("SRC/?.vue", "src/a.vue", True), ("a.b", "axb", False)])
def test_glob(spark, glob, path, hit):
    assert one(spark, paths.matches_glob(F.col("p"), glob), p=path) is hit


def test_boundaries(spark):
    same = paths.same_boundary(F.col("a"), F.col("b"))
    assert one(spark, same, a="apps/web/x.vue", b="apps/web/y.vue")
    assert not one(spark, same, a="/r/apps/web/x.vue", b="/r/packages/ui/y.vue")
    assert one(spark, same, a="src/x.vue", b="packages/ui/y.vue")


@pytest.mark.parametrize(("raw", "normal"), [("catalog", "/catalog"), ("/catalog/", "/catalog"), ("///catalog///", "/catalog"), ("/", "/"), ("", "/")])
def test_normal_route(spark, raw, normal):
    assert one(spark, paths.normal_route(F.col("p")), p=raw) == normal


@pytest.mark.parametrize(("pattern", "path", "hit"), [("/products/[id]", "/products/7", True), ("/products/[id]", "/products/7/x", False), ("/blog/[...slug]", "/blog/a/b", True), ("/d/[[...x]]", "/d", True), ("/u/:name", "/u/bo", True), ("/a.b", "/axb", False)])
def test_route_regex(spark, pattern, path, hit):
    frame = spark.createDataFrame([(pattern, path)], "pattern string, path string").withColumn("regex", paths.route_regex(F.col("pattern")))
    assert frame.select(F.expr("path RLIKE regex")).first()[0] is hit


@pytest.mark.parametrize(("file", "route"), [("Products/[id].vue", "/Products/[id]"), ("(group)/@slot/(.)photo/page.tsx", "/photo"), ("users/[id].get.ts", "/users/[id]"), ("(app)/items/+page.svelte", "/items"), ("index.vue", "/")])
def test_route_from_file(spark, file, route):
    assert one(spark, paths.route_from_file(F.col("f")), f=file) == route


def test_route_params(spark):
    found = one(spark, paths.route_params(F.col("p")), p="/a/[id]/[...rest]/[[...opt]]")
    assert [(r["name"], r["type"]) for r in found] == [("id", "dynamic"), ("rest", "catch-all"), ("opt", "optional-catch-all")]


@pytest.mark.parametrize(("raw", "form"), [("`/api/users/${props.user.id}`", "/api/users/:id"), ('"/api/x/" + item.key', "/api/x/:key"), ("'http://h//a//b'", "http://h/a/b"), ("`/p/${id.value}/q`", "/p/:id/q")])
def test_endpoint(spark, raw, form):
    assert one(spark, paths.endpoint(F.col("p")), p=raw) == form


def edges(spark, *pairs):
    return spark.createDataFrame(pairs, "parent string, child string")


def test_blast_radius_repeats_nodes_by_depth(spark):
    diamond = edges(spark, ("a", "b"), ("b", "d"), ("a", "d"), ("r", "a"))
    target = spark.createDataFrame([("d",)], "path string")
    assert sorted((r.path, r.depth) for r in graph.blast_radius(diamond, target, 3).collect()) == [("a", 1), ("a", 2), ("b", 1), ("r", 2), ("r", 3)]
    cycle = edges(spark, ("a", "b"), ("b", "a"))
    assert sorted((r.path, r.depth) for r in graph.blast_radius(cycle, spark.createDataFrame([("a",)], "path string"), 3).collect()) == [("a", 2), ("b", 1), ("b", 3)]
    assert sorted((r.path, r.depth) for r in graph.nearest_depths(diamond, target, 4).collect()) == [("a", 2), ("b", 2), ("d", 1), ("r", 3)]


def test_tree_flags_cycles(spark):
    cycle = edges(spark, ("a", "b"), ("b", "a"))
    found = graph.tree_paths(cycle, spark.createDataFrame([("a",)], "path string"), 5, down=True).collect()
    assert [(r.depth, r.node, r.circular) for r in sorted(found, key=lambda r: r.depth)] == [(0, "a", False), (1, "b", False), (2, "a", True)]


def test_unused_components(spark):
    rows = [(p, False, False) for p in ("orphan", "imported", "lazy", "shown")] + [("page", True, False)]
    links = spark.createDataFrame([("x", "imported", "static", False), ("x", "lazy", "dynamic", False), ("x", "shown", "static", True)], "parent string, child string, import_type string, is_rendered boolean")
    found = graph.unused_components(spark.createDataFrame(rows, "path string, is_page boolean, is_layout boolean"), links)
    assert sorted(r.path for r in found.collect()) == ["imported", "orphan"]


def test_closure_stops(spark):
    deps = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("z", "y")], "path string, dependency_path string")
    assert sorted(r.path for r in graph.reverse_closure(deps, spark.createDataFrame([("a",)], "path string")).collect()) == ["a", "b", "c"]


def test_state_summary_order(spark):
    rows = [
        (1, "f", "store", "cart", "read", 0, "late", ["x"]),
        (2, "f", "store", "cart", "read", 9, "nine", ["y", "x"]),
        (3, "f", "context", "cart", "write", 7, "w7", ["z"]),
        (4, "f", "store", "cart", "write", 8, "w7", []),
        (5, "f", "store", "cart", "write", 10, "w10", None),
    ]
    schema = "id long, path string, kind string, identifier string, access_mode string, line_number long, usage_snippet string, accessed_properties array<string>"
    r = state.summarize(spark.createDataFrame(rows, schema), ["path"]).first()
    assert (r.state_kind, r.access, r.line, r.snippet, r.actions, r.properties, r.role) == ("context", "write", 7, "w7", "w7|w10", "z|y|x", "mutator")


def test_stale_dependents(spark):
    deps = spark.createDataFrame([("same", "a", "1"), ("changed", "b", "1"), ("gone", "c", "1"), ("still_absent", "d", ""), ("appeared", "a", "")], "path string, dependency_path string, content_hash string")
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    assert sorted(r.path for r in sync.stale_dependents(deps, now).collect()) == ["appeared", "changed", "gone"]


def test_sync_merge_equals_rebuild(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    change = {r.path: r.change for r in sync.classify(old, new).collect()}
    assert change == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "added"}
    touched = new.filter(F.col("path").isin([p for p, c in change.items() if c in ("added", "modified")]))
    kept = old.filter(~F.col("path").isin([p for p, c in change.items() if c == "deleted"]))
    assert sorted(map(tuple, sync.merge(kept, touched).collect())) == sorted(map(tuple, new.collect()))


def test_patches(spark):
    rows = spark.createDataFrame([("f", 0, 3, "AAA"), ("f", 2, 5, "no"), ("f", 4, 6, "b"), ("f", 5, 9, "no")], "file string, start long, end long, replacement string")
    kept = patches.drop_overlaps(rows)
    assert sorted(tuple(r) for r in kept.collect()) == [("f", 0, 3, "AAA"), ("f", 4, 6, "b")]
    text = spark.createDataFrame([("f", "0123456789"), ("g", "same")], "file string, content string")
    assert {r.file: r.content for r in patches.apply(text, kept).collect()} == {"f": "AAA3b6789", "g": "same"}
    asked = spark.createDataFrame([("f", 0, 2, "h", "01"), ("f", 0, 2, "h", "xx"), ("f", 5, 99, "h", ""), ("f", 0, 2, "old", "01"), ("q", 0, 1, "h", "0")], "file string, start long, end long, sha256 string, old_snippet string")
    snap = spark.createDataFrame([("f", "h", "0123456789")], "file string, sha256 string, content string")
    assert sorted(r.problem for r in patches.preconditions(asked, snap).collect()) == ["bad-span", "missing-file", "snippet-mismatch", "stale-hash"]


def test_pages_do_not_lose_rows(spark):
    rows = spark.createDataFrame([(i, 10) for i in range(50)], "id long, size long")
    seen = [r.id for k in range(5) for r in search.page(rows, ["id"], 12 * k, 12).collect()]
    assert seen == list(range(50))
    assert search.budget_prefix(rows, ["id"], "size", 356).count() == 10
    assert search.budget_prefix(rows.limit(0), ["id"], "size", 356).count() == 0


def test_telemetry(spark):
    rows = [(1, "a", 100.0, "ok", True, False, 10, 1000, 2000), (2, "a", 300.0, "error", False, False, 5, 700, 0), (3, "b", 0.0, "ok", False, True, 0, 0, 0), (4, "b", 50.0, "ok", False, False, 10, 3000, 4000)]
    log = spark.createDataFrame(rows, "seq long, tool string, duration_ms double, status string, cache_hit boolean, empty_result boolean, items_found long, bytes_out long, source_bytes long")
    r = telemetry.overall(log).first()
    assert (r.calls, r.errors, r.error_rate, r.slow, r["items"], r.bytes, r.p50_ms, r.saving) == (4, 1, 25.0, 1, 25, 4700, 50.0, 33.3)
    assert [x.seq for x in telemetry.tail(log, 2, "a").collect()] == []
