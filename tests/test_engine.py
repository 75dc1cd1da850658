"""Operations on a workspace through a few generations."""

import pytest

from fronda.plans import engine
from tests.test_workspace import FILES


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("engine")
    for name, text in FILES.items():
        path = base / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return engine.Workspace(spark, str(base / "tree"), str(base / "store")), base / "tree"


def test_generations_and_operations(space):
    work, tree = space
    first = work.sync()
    assert first["generation"] == 1 and first["parsed"] == first["added"] > 10
    assert work.sync() == {"added": 0, "modified": 0, "deleted": 0, "unchanged": first["added"], "parsed": 0, "generation": 1}
    assert engine.as_text(work.component_tree("src/App.vue")).split("\n")[0] == "src/App.vue"
    assert "-->" in engine.as_mermaid(work.component_tree("src/App.vue"))
    assert [r.path for r in work.find_code(component="Dashboard").collect()] == ["src/App.vue"]
    assert {r.path for r in work.trace_state("useCartStore").collect()} == {"src/App.vue", "src/Dashboard.vue"}
    assert {r.identifier for r in work.audit("dead-state").collect()} == {"useDead"}
    assert work.inspect("src/Dashboard.vue")["emits"][0] == "done"

    plan = work.patch_plan("Dashboard", "rename_prop", "title", "label")
    done = {r.file: r.content for r in work.apply_patches(plan).collect()}
    assert list(done) == ["src/App.vue"] and '<Dashboard label="hi"' in done["src/App.vue"]

    (tree / "src/App.vue").write_text(done["src/App.vue"], encoding="utf-8")
    (tree / "src/Orphan.vue").unlink()
    again = work.sync()
    assert (again["modified"], again["deleted"], again["parsed"], again["generation"]) == (1, 1, 1, 2)
    delta = {tuple(r) for r in work.store.table("edges").collect()}
    work.sync(rebuild=True)
    assert {tuple(r) for r in work.store.table("edges").collect()} == delta
    with pytest.raises(LookupError):
        work.inspect("src/Orphan.vue")
