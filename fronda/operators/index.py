"""From parsed files to the graph tables, their versioned store and the questions that need them.

Imports are resolved by a ranked lookup join, barrels by as many more as they
take, tags without an import by unique component name.  A store keeps one folder
and one pointer a generation, the pointer being written last.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fronda.functions import names, paths
from fronda.operators import graph, parse
from fronda.operators.graph import first_writer_wins, saved
from fronda.sources.aliases import Alias, load, targets

#: Suffixes tried for an import, in order.
SUFFIXES = ("", ".vue", ".tsx", ".ts", ".jsx", ".js", ".astro", ".svelte", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.vue")
SCHEMA_VERSION = 1


def import_candidates(path: str, source: str, known: list[Alias]) -> list[str]:
    """Workspace paths an import may mean, best first; none for a package from elsewhere."""
    if source.startswith("."):
        base = posixpath.normpath(posixpath.join(posixpath.dirname(path), source))
        return [] if base.startswith("..") else [base + s for s in SUFFIXES]
    return [base + s for base in targets(known, path, source) for s in SUFFIXES]


def resolve(rows: DataFrame, files: DataFrame, aliases: list[Alias] | dict[str, str] | None = None) -> DataFrame:
    """`rows` (path, source, ...) with `target`, the first candidate that exists; null if none does. A mapping names prefixes and folders."""
    known = [Alias("", f"{k}*", (f"{v}/*".lstrip("/"),)) for k, v in aliases.items()] if isinstance(aliases, dict) else list(aliases) if aliases is not None else load({})

    @F.pandas_udf("array<string>")
    def candidates(path: pd.Series, source: pd.Series) -> pd.Series:
        return pd.Series([import_candidates(p, s, known) for p, s in zip(path, source, strict=True)])

    pairs = rows.select("path", "source").distinct()
    tried = pairs.select("path", "source", F.posexplode(candidates("path", "source")).alias("rank", "candidate"))
    found = tried.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("path", "source").agg(F.min_by("candidate", "rank").alias("target"))
    return rows.join(found, ["path", "source"], "left")


def chase_barrels(links: DataFrame, reexports: DataFrame) -> DataFrame:
    """`links` (path, exported, target, ...) with the target behind re-exporting files, however many; a circle ends where it closes.

    reexports: (path, name, local, target); a name wins over '*'.  Each round is
    written to the shared folder; rounds end when no link moves.
    """
    step = saved(reexports.select(F.col("path").alias("at"), F.col("name").alias("r_name"), F.col("local").alias("r_local"), F.col("target").alias("r_target")).filter("r_target IS NOT NULL"))
    links = links.withColumn("via", F.array("target")).withColumn("moved", F.lit(True))
    rank = Window.partitionBy("link").orderBy((F.col("r_name") == "*").cast("int"), "r_target")
    while True:
        going = links.filter("moved").drop("moved")
        met = going.join(step, (F.col("target") == F.col("at")) & ((F.col("exported") == F.col("r_name")) | (F.col("r_name") == "*")) & ~F.array_contains("via", F.col("r_target")), "left")
        best = met.withColumn("n", F.row_number().over(rank)).filter("n = 1").withColumn("moved", F.col("r_target").isNotNull())
        named = best.withColumn("exported", F.when(F.col("r_target").isNull() | (F.col("r_name") == "*"), F.col("exported")).otherwise(F.col("r_local")))
        nxt = named.withColumn("via", F.when(F.col("moved"), F.concat("via", F.array("r_target"))).otherwise(F.col("via"))).withColumn("target", F.coalesce("r_target", "target"))
        links = saved(links.filter("NOT moved").unionByName(nxt.select(*links.columns)))
        if links.filter("moved").isEmpty():
            return links.drop("via", "moved")


def import_links(parsed: DataFrame, aliases: list[Alias] | dict[str, str] | None = None) -> DataFrame:
    """Imports (path, name, exported, source, link) with the file and the name behind re-exports that each reaches."""
    links = resolve(parse.table(parsed, "imports").withColumn("link", F.xxhash64("path", "name", "exported", "source")), parsed, aliases)
    reexports = resolve(parse.table(parsed, "exports").filter("source <> ''"), parsed, aliases)
    return chase_barrels(links.filter("target IS NOT NULL"), reexports)


def symbol_callers(files: DataFrame, parsed: DataFrame, path: str, symbol: str, aliases: list[Alias] | dict[str, str] | None = None) -> DataFrame:
    """(path, name, verdict) of the files that import a symbol of a file, through re-exports too: caller if a call or a tag names it there, else importer."""
    own = parse.table(parsed.filter(F.col("path") == path), "exports").filter(F.col("local") == symbol).select("name")
    wanted = own.union(parsed.sparkSession.createDataFrame([(symbol,), ("*",)], "name string")).distinct().withColumnRenamed("name", "exported")
    links = import_links(parsed, aliases).filter((F.col("target") == path) & (F.col("path") != path)).join(F.broadcast(wanted), "exported")
    # a namespace reaches the symbol behind a dot
    name = F.when(F.col("exported") == "*", F.concat("name", F.lit("."), F.lit(symbol))).otherwise(F.col("name"))
    used = F.concat(F.lit(r"((?<![\w$.])\Q"), name, F.lit(r"\E\s*(<[^()]*>)?\()|(<\Q"), name, F.lit(r"\E(?![\w$.]))"))
    found = links.select("path", name.alias("name"), used.alias("used")).distinct().join(files.select("path", "content"), "path")

    @F.pandas_udf("string")
    def code(text: pd.Series) -> pd.Series:
        return text.map(lambda t: parse.blank_comments(t or ""))

    return found.withColumn("code", code("content")).withColumn("hit", F.expr("code RLIKE used")).groupBy("path", "name").agg(F.when(F.max("hit"), "caller").otherwise("importer").alias("verdict"))


def tag_matches(tag: Column, name: Column) -> Column:
    return names.matches(F.element_at(F.split(tag, r"\."), 1), name)


def graph_tables(parsed: DataFrame, aliases: list[Alias] | dict[str, str] | None = None) -> dict[str, DataFrame]:
    """files, components, edges, state_deps, routes and file_dependencies of a parsed scan."""
    files = parsed.select("path", "framework", "hash", "line_count", paths.is_page(F.col("path")).alias("is_page"), paths.is_layout(F.col("path")).alias("is_layout"))
    component = F.col("path").rlike(r"\.(vue|svelte|astro|tsx|jsx)$")
    components = parsed.filter(component).select("path", "name", F.to_json("contract").alias("contract_json"))

    links = import_links(parsed, aliases)
    tags = parse.table(parsed, "rendered")
    used = tags.select(F.col("path").alias("t_path"), "tag").distinct()
    rendered = links.join(used, (F.col("path") == F.col("t_path")) & tag_matches(F.col("tag"), F.col("name")), "left_semi").select("link").distinct().withColumn("is_rendered", F.lit(True))
    explicit = links.join(rendered, "link", "left").select(F.col("path").alias("parent"), F.col("target").alias("child"), F.when(F.col("is_dynamic"), "dynamic").otherwise("static").alias("import_type"), F.coalesce("is_rendered", F.lit(False)).alias("is_rendered"), F.col("link").alias("seq"))

    catalog = components.select(F.col("path").alias("target"), F.explode(F.array_distinct(F.array(F.lower("name"), names.kebab(F.col("name"))))).alias("key"))
    free = tags.select("path", "tag").distinct().join(links.select(F.col("path").alias("l_path"), F.col("name").alias("l_name")), (F.col("path") == F.col("l_path")) & tag_matches(F.col("tag"), F.col("l_name")), "left_anti")
    keyed = free.select("path", "tag", F.explode(F.array_distinct(F.array(F.lower("tag"), names.kebab(F.col("tag"))))).alias("key"))
    guess = keyed.join(catalog, "key").filter("path <> target").filter(paths.same_boundary(F.col("path"), F.col("target"))).select("path", "tag", "target").distinct()
    unique = guess.groupBy("path", "tag").agg(F.count("*").alias("n"), F.min("target").alias("target")).filter("n = 1")
    auto = unique.select(F.col("path").alias("parent"), F.col("target").alias("child"), F.lit("auto").alias("import_type"), F.lit(True).alias("is_rendered"), F.xxhash64("path", "tag").alias("seq"))
    edges = first_writer_wins(explicit.unionByName(auto).filter("parent <> child")).drop("seq")

    state = parse.table(parsed, "state")
    deps = links.select("path", F.col("target").alias("dependency_path")).distinct().join(files.select(F.col("path").alias("dependency_path"), F.col("hash").alias("content_hash")), "dependency_path")
    found = parsed.filter(F.col("path").rlike(r"(^|/)(pages|routes|app|server/api|src/pages|src/routes)/"))
    inner = F.regexp_replace("path", r"^.*?(?:pages|routes|app|server(?=/api))/", "")
    routes = found.select(paths.route_from_file(inner).alias("url_path"), "path", F.when(F.size("handlers") > 0, F.array_join("handlers", "|")).alias("handlers"), "framework")
    routes = routes.withColumn("params", paths.route_params(F.col("url_path")))
    return {"files": files, "components": components, "edges": edges, "state_deps": state, "routes": routes, "file_dependencies": deps.select("path", "dependency_path", "content_hash"), "declared": parse.table(parsed, "declared")}


# ---------------------------------------------------------------- store


def nearest_index(folder: str, name: str) -> str | None:
    """The folder itself or the nearest one above it that holds a store of that name."""
    at = os.path.abspath(folder)
    while not os.path.isdir(os.path.join(at, name)):
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)
    return at


class Store:
    """Generations of tables under a root; `current` names the one that is read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        folder, fs = self._path("")
        if not fs.exists(folder):
            return []
        return sorted(n for s in fs.listStatus(folder) if (n := s.getPath().getName()).startswith("current-"))

    def current(self) -> dict | None:
        """The highest pointer: pointers are never moved or deleted, so a reader always finds one."""
        names = self._pointers()
        if not names:
            return None
        meta = json.loads(self.spark.read.text(f"{self.root}/{names[-1]}").first()[0])
        if meta["schema"] > SCHEMA_VERSION:
            raise ValueError(f"store has schema {meta['schema']}, newer than {SCHEMA_VERSION}")
        return meta

    def publish(self, tables: dict[str, DataFrame], expected: int | None = None, **notes: str) -> int:
        """Write the next generation, then its pointer; `expected` must be the generation it was made from. Of two publishers of one generation the second fails."""
        now = self.current()
        generation = now["generation"] if now else 0
        if expected is not None and expected != generation:
            raise RuntimeError(f"generation is {generation}, not {expected}")
        folder = f"generation-{generation + 1}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        meta = {"schema": SCHEMA_VERSION, "generation": generation + 1, "folder": folder, "tables": sorted(tables), **notes}
        staged, fs = self._path(f"pointer-{uuid.uuid4().hex}")
        stream = fs.create(staged)
        stream.write(bytearray((json.dumps(meta) + "\n").encode()))
        stream.close()
        final, _ = self._path(f"current-{generation + 1:012d}")
        if fs.exists(final) or not fs.rename(staged, final):
            fs.delete(staged, False)
            raise RuntimeError(f"generation {generation + 1} has been published by another")
        return generation + 1

    def table(self, name: str) -> DataFrame:
        meta = self.current()
        if meta is None:
            raise LookupError("nothing has been indexed here")
        return self.spark.read.parquet(f"{self.root}/{meta['folder']}/{name}")


# ---------------------------------------------------------------- questions


def endpoint_summary(parsed: DataFrame) -> DataFrame:
    """Per normal endpoint: methods and clients in order, and the number of calling files."""
    calls = parse.table(parsed, "calls").withColumn("endpoint", paths.endpoint(F.col("endpoint")))
    seen = calls.groupBy("endpoint", "method").agg(F.min(F.struct("path", "line")).alias("at")).groupBy("endpoint").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "method"))), lambda x: x["method"]).alias("methods"))
    return seen.join(calls.groupBy("endpoint").agg(F.countDistinct("path").alias("callers"), F.count("*").alias("calls")), "endpoint")


def unused_components(parsed: DataFrame, tables: dict[str, DataFrame], ignore_globs: list[str] | None = None) -> DataFrame:
    """Components that no other file renders, imports on demand or names in a tag; the source-scan answer."""
    out = tables["components"].select("path", "name").filter(~paths.is_page(F.col("path")) & ~paths.is_layout(F.col("path")))
    for g in ignore_globs or []:
        out = out.filter(~paths.matches_glob(F.col("path"), g))
    edges = tables["edges"].filter("is_rendered OR import_type = 'dynamic'").select(F.col("child").alias("path"))
    tags = parse.table(parsed, "rendered").select(F.col("path").alias("by"), F.lower(F.element_at(F.split("tag", r"\."), -1)).alias("key")).distinct()
    named = out.select("path", F.explode(F.array_distinct(F.array(F.lower("name"), names.kebab(F.col("name"))))).alias("key")).join(tags, "key").filter("path <> by").select("path")
    return out.join(edges, "path", "left_anti").join(named, "path", "left_anti")


def prop_impact(parsed: DataFrame, tables: dict[str, DataFrame], target: str) -> DataFrame:
    """Per declared prop of a component: usages, files and omissions by its renders; a spread makes an omission uncertain."""
    own = parsed.filter(F.col("path") == target)
    consumers = tables["edges"].filter((F.col("child") == target) & F.col("is_rendered")).select(F.col("parent").alias("path")).distinct()
    name = own.select(F.col("name").alias("component"))
    uses = parse.table(parsed, "rendered").join(consumers, "path", "left_semi").join(name, names.matches(F.element_at(F.split("tag", r"\."), -1), F.col("component")))
    uses = uses.withColumn("use", F.xxhash64("path", "line", "tag", F.to_json("props"))).withColumn("spread", F.exists("props", lambda p: p["is_spread"]))
    given = uses.select("use", "path", F.explode("props").alias("p")).select("use", "path", names.kebab_attribute(F.col("p.prop")).alias("key")).distinct()
    # every render carries the component's own props, which stand in one row
    declared = own.select(F.col("path").alias("component_path"), F.transform("contract.props", lambda p: F.struct(p["name"].alias("name"), p["required"].alias("required"), names.kebab_attribute(p["name"]).alias("key"))).alias("props"))
    grid = uses.select("use", "path", "spread", F.lit(target).alias("component_path")).distinct().join(F.broadcast(declared), "component_path").select("use", "path", "spread", F.explode("props").alias("p")).select("use", "path", "spread", "p.*")
    joined = grid.join(given.withColumn("given", F.lit(True)), ["use", "path", "key"], "left")
    return joined.groupBy("name", "required").agg(
        F.count_if(F.col("given").isNotNull()).alias("usages"),
        F.countDistinct(F.when(F.col("given").isNotNull(), F.col("path"))).alias("files"),
        F.count_if(F.col("given").isNull() & ~F.col("spread")).alias("omissions"),
        F.count_if(F.col("given").isNull() & F.col("spread")).alias("indeterminate"),
    )


def context_audit(parsed: DataFrame, edges: DataFrame, path: str, max_depth: int = 5) -> DataFrame:
    """(node, key, branch, provider) of what the components below a file consume: the provider on its branch, or null."""
    found = parse.table(parsed, "contexts")
    tree = graph.tree_paths(edges.filter("is_rendered"), parsed.sparkSession.createDataFrame([(path,)], "path string"), max_depth, down=True)
    return graph.nearest_provider(tree, found.filter("role = 'consumer'").select("path", "key"), found.filter("role = 'provider'").select("path", "key")).drop("root")


def find_literal(files: DataFrame, pattern: str, limit: int = 200) -> DataFrame:
    """(path, line, column, snippet): first place of a literal in each line, files in order; files without it are never split."""
    lines = files.filter(F.col("content").contains(pattern)).select("path", F.posexplode(F.split("content", "\r?\n")).alias("pos", "text"))
    hits = lines.filter(F.col("text").contains(pattern)).select("path", (F.col("pos") + 1).alias("line"), F.locate(pattern, "text").alias("column"), F.trim("text").alias("snippet"))
    return hits.orderBy("path", "line").limit(limit)


def find_component(parsed: DataFrame, name: str, limit: int = 200) -> DataFrame:
    """Places that render a component, under any form of its name."""
    hits = parse.table(parsed, "rendered").filter(names.matches(F.element_at(F.split("tag", r"\."), -1), F.lit(name)))
    return hits.select("path", "line", "tag").orderBy("path", "line").limit(limit)


def find_prop(parsed: DataFrame, name: str, prop: str, limit: int = 200) -> DataFrame:
    """Places that pass a prop to a component, with the expression."""
    hits = parse.table(parsed, "rendered").filter(names.matches(F.element_at(F.split("tag", r"\."), -1), F.lit(name))).select("path", "line", "tag", F.explode("props").alias("p"))
    return hits.filter(names.kebab_attribute(F.col("p.prop")) == names.kebab_attribute(F.lit(prop))).select("path", "line", "tag", F.col("p.expression").alias("expression")).orderBy("path", "line").limit(limit)


def match_route(routes: DataFrame, url: str) -> DataFrame:
    """The routes that match a URL path, best first: exact, then fewer parameters, then longer."""
    wanted = F.lit("/" + "/".join(p for p in url.split("/") if p))
    hits = routes.withColumn("regex", paths.route_regex(F.col("url_path"))).withColumn("url", wanted).filter((F.col("url_path") == F.col("url")) | F.expr("url RLIKE regex"))
    return hits.orderBy((F.col("url_path") != F.col("url")).cast("int"), F.size("params"), -F.length("url_path"), "url_path").drop("regex", "url")
