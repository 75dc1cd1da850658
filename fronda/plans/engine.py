"""One workspace and its public operations: index, find, inspect, tree, state, audit, patches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fronda.operators import evidence, graph, index, outline, parse, patches, refactor, routing, state, structure, sync
from fronda.sources import aliases, workspace


class Workspace:
    """A source tree and, below `store`, its published graph.

    `sync` compares hashes, parses only what changed and what depends on it, and
    publishes the next generation; every other operation reads the last one.
    """

    def __init__(self, spark: SparkSession, root: str, store: str, known: dict[str, str] | None = None):
        self.spark, self.root, self.aliases = spark, root, known
        self.store = index.Store(spark, store)

    # ------------------------------------------------------------ index

    def files(self) -> DataFrame:
        return workspace.scan(self.spark, self.root)

    def sync(self, rebuild: bool = False) -> dict:
        """Counts of added, modified, deleted, unchanged and parsed files, and the generation."""
        scan, meta = self.files(), self.store.current()
        config = self.configs()
        fingerprint = sync.config_fingerprint(config)
        # other aliases may resolve every import in another way
        if meta is None or rebuild or meta.get("config") != fingerprint:
            parsed, counts, n = parse.parsed(scan), None, None
        else:
            old, links = self.store.table("parsed"), self.store.table("file_dependencies")
            change = graph.saved(sync.classify(old, scan))
            counts = {r["change"]: r["count"] for r in change.groupBy("change").count().collect()}
            if not counts.keys() - {"unchanged"}:
                return {**dict.fromkeys(("added", "modified", "deleted"), 0), **counts, "parsed": 0, "generation": meta["generation"]}
            moved = change.filter("change <> 'unchanged'").select("path")
            # what depends on a change, over any number of steps, is parsed again with it
            stale = graph.reverse_closure(links, moved.unionByName(sync.stale_dependents(links, scan)))
            todo = scan.join(stale, "path", "left_semi")
            n = todo.count()
            kept = old.join(stale, "path", "left_anti")
            parsed = kept.unionByName(parse.parsed(todo).select(*kept.columns))
        # a lineage cut: the graph is built from what is written
        staged = f"{graph.shared_folder(self.spark)}/fronda-parsed-{evidence.identity([self.root, (meta or {}).get('generation')])[:16]}"
        parsed.write.mode("overwrite").parquet(staged)
        parsed = self.spark.read.parquet(staged)
        known = aliases.load(config) if self.aliases is None else self.aliases
        tables = index.graph_tables(parsed, known)
        generation = self.store.publish({"parsed": parsed, **tables}, meta["generation"] if meta else None, config=fingerprint)
        total = parsed.count()
        counts = counts or {"added": total}
        return {**dict.fromkeys(("added", "modified", "deleted", "unchanged"), 0), **counts, "parsed": total if n is None else n, "generation": generation}

    def configs(self) -> dict[str, str]:
        """Text of every configuration file, by path; they are few."""
        found = workspace.scan(self.spark, self.root, configs=True).filter("config").select("path", "content")
        return {r["path"]: r["content"] for r in found.collect()}

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.store.table(name) for name in self.store.current()["tables"]}

    # ------------------------------------------------------------ operations

    def find_code(self, pattern: str = "", component: str = "", prop: str = "", limit: int = 200, mode: str = "auto", rule: dict | None = None) -> DataFrame:
        """Places of a literal, a pattern with placeholders, a rule, a component or a prop of it; auto takes tags and placeholders for a pattern."""
        if component and prop:
            return index.find_prop(self.store.table("parsed"), component, prop, limit)
        if component:
            return index.find_component(self.store.table("parsed"), component, limit)
        if rule is not None:
            return structure.find(self.files(), rule=rule, limit=limit)
        if mode not in ("auto", "literal", "pattern"):
            raise ValueError("mode is one of auto, literal, pattern")
        if mode == "pattern" or (mode == "auto" and re.search(r"\$[A-Z_$]|^\s*<[A-Za-z].*>\s*$", pattern)):
            return structure.find(self.files(), pattern, limit=limit)
        if not pattern or "\n" in pattern:
            raise ValueError("a literal pattern is one line that is not empty")
        return index.find_literal(self.files(), pattern, limit)

    def _text(self, path: str) -> str:
        row = self.files().filter(F.col("path") == path).select("content").first()
        if row is None:
            raise LookupError(path)
        return row[0]

    def inspect(self, path: str, mode: str = "contract", name: str = ""):
        """contract, outline, symbol, events, map, layout, data, impact of one file."""
        if mode == "impact":
            return index.prop_impact(self.store.table("parsed"), self.tables(), path)
        text = self._text(path)
        found = {
            "contract": lambda: parse.contract(path, text),
            "outline": lambda: outline.symbols(parse.script_of(path, text)),
            "symbol": lambda: outline.slice_symbol(text, name),
            "events": lambda: {"handlers": outline.event_handlers(path, text), "unused": outline.unused_functions(path, text)},
            "map": lambda: outline.regions(path, text),
            "layout": lambda: outline.layout(path, text),
            "data": lambda: outline.data_dependencies(text, parse.framework(path, text)),
            "variants": lambda: outline.variants(text, parse.contract(path, text)["props"]),
            "expressions": lambda: structure.template_expressions(path, text),
            "boundary": lambda: outline.render_boundary(path, text, parse.framework(path, text)),
        }
        if mode not in found:
            raise ValueError(f"mode is one of impact, {', '.join(found)}")
        return found[mode]()

    def component_tree(self, path: str, direction: str = "down", max_depth: int = 3, limit: int | None = None) -> DataFrame:
        """Branches below or above a file; with a limit those to the nearest nodes, and has_more."""
        edges = self.store.table("edges")
        if direction == "down":
            edges = edges.filter("is_rendered")
        roots = self.spark.createDataFrame([(path,)], "path string")
        found = graph.tree_paths(edges, roots, max_depth, direction == "down")
        return found if limit is None else graph.first_nodes(found, limit)

    def blast_radius(self, path: str, max_depth: int = 5) -> DataFrame:
        found = graph.blast_radius(self.store.table("edges"), self.spark.createDataFrame([(path,)], "path string"), max_depth)
        return found.join(self.store.table("files").select("path", "framework", "is_page"), "path", "left").orderBy("depth", F.col("is_page").desc(), "path")

    def trace_state(self, identifier: str, mode: str = "impact", max_depth: int = 3, role: str = "all") -> DataFrame:
        t = self.tables()
        observed = t["state_deps"].withColumn("id", F.xxhash64("path", "identifier", "line_number", "usage_snippet"))
        if mode == "impact":
            return state.state_impact(observed, t["files"], identifier, role).orderBy(F.col("is_page").desc(), "path", F.col("line").isNotNull().desc(), "line")
        if mode == "consumers":
            return state.state_chain(observed, t["edges"], identifier, max_depth, role)
        declares = t["declared"].groupBy("identifier").agg(F.min("path").alias("path"))
        return state.state_chain_dependencies(observed, declares, identifier, max_depth)

    def audit(self, kind: str) -> DataFrame:
        t = self.tables()
        if kind == "dead-components":
            return index.unused_components(t["parsed"], t)
        if kind == "dead-state":
            return state.dead_state(t["declared"], t["state_deps"])
        if kind == "api-contracts":
            return index.endpoint_summary(t["parsed"])
        if kind == "routes":
            return t["routes"].orderBy("url_path", "path")
        if kind == "app-routes":
            return routing.app_routes(t["files"]).orderBy("url_path", "path")
        raise ValueError(kind)

    def callers(self, path: str, symbol: str) -> DataFrame:
        known = aliases.load(self.configs()) if self.aliases is None else self.aliases
        return index.symbol_callers(self.files(), self.store.table("parsed"), path, symbol, known)

    def contexts(self, path: str, max_depth: int = 5) -> DataFrame:
        """Who provides what the components below a file consume."""
        return index.context_audit(self.store.table("parsed"), self.store.table("edges"), path, max_depth)

    def patch_plan(self, component: str, kind: str, old: str, new: str = "") -> DataFrame:
        return refactor.plan(self.files(), component, kind, old, new)

    def apply_patches(self, plan: DataFrame) -> DataFrame:
        """(file, content) of the files after the ready patches; stale ones raise."""
        files = self.files().select(F.col("path").alias("file"), F.col("hash").alias("sha256"), "content")
        ready = plan.filter("state = 'ready'")
        problems = patches.preconditions(ready, files).limit(5).collect()
        if problems:
            raise RuntimeError(f"patches do not fit: {[(p.file, p.problem) for p in problems]}")
        touched = files.join(ready.select("file").distinct(), "file", "left_semi")
        return patches.apply(touched.select("file", "content"), patches.drop_overlaps(ready.select("file", "start", "end", "replacement")))


# ---------------------------------------------------------------- rendering


def as_text(tree: DataFrame) -> str:
    """Branches as an indented list; a tree is bounded by its depth."""
    rows = sorted(tree.collect(), key=lambda r: list(r["path"]))
    return "\n".join("  " * r["depth"] + r["node"] + (" (circular)" if r["circular"] else "") for r in rows)


def as_mermaid(tree: DataFrame) -> str:
    rows = sorted({(r["parent"], r["node"]) for r in tree.filter("depth > 0").collect()})
    names = {n: f"n{i}" for i, n in enumerate(sorted({x for r in rows for x in r}))}
    lines = [f'  {i}["{n}"]' for n, i in names.items()] + [f"  {names[a]} --> {names[b]}" for a, b in rows]
    return "\n".join(["graph TD", *lines])
