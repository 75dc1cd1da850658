"""Published queries of the source parsers: a tree of components is written from the star-schema tables and parsed.

Each row of a table is one file, its references the imports and tags of that
file, so SQL knows what the parsers must find without parsing anything.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fronda.functions import paths, targets
from fronda.operators import graph, index, parse, refactor, routing, structure
from fronda.plans.catalog import query
from fronda.sources import graph_views as V
from fronda.sources.graph_views import with_views

TARGET = 7  # number of the component that single-component questions ask for

REGION = """<script setup lang="ts">
defineProps<{ title: string; size?: number }>()
</script>
<template>
  <div><slot /><slot name="foot" /></div>
</template>
"""
NATION = """<script setup lang="ts">
import Region from '../regions/Region@up@.vue'
defineProps<{ id: number; name?: string }>()
defineEmits<{ (e: 'pick', id: number): void }>()
</script>
<template>
  <Region title="n@own@" :size="@own@" />
</template>
"""
SUPPLIER = """<script setup lang="ts">
import Nation@up@ from '@/nations/Nation@up@.vue'
const store = useNationStore()
const load = () => axios.post(`/api/nations/${nation.id}/suppliers`, { key: @own@ })
store.select(@own@)
const label = store.title
</script>
<template>
  <Nation@up@@given@ name="s@own@" @pick="load" />
</template>
"""
CUSTOMER = """import { Nation@up@ } from '../../nations'
export default function Customer@own@({ id, label }: { id: number; label?: string }) {
  fetch('/api/customers/@own@')
  return <Nation@up@ id={id} {...rest@own@} />
}
"""
PART = """<script lang="ts">
export let size: number
export let label: string = 'p@own@'
</script>
<Supplier@up@ size={size} />
"""
EXPORT = "export { default as Nation@own@ } from './Nation@own@.vue'\n"

#: table, own key, key above, path, content
FILES = (
    ("region", "r_regionkey", "0", "src/regions/Region@own@.vue", REGION),
    ("nation", "n_nationkey", "n_regionkey", "src/nations/Nation@own@.vue", NATION),
    ("supplier", "s_suppkey", "s_nationkey", "src/suppliers/Supplier@own@.vue", SUPPLIER),
    ("customer", "c_custkey", "c_nationkey", "src/pages/customers/Customer@own@.tsx", CUSTOMER),
    ("part", "p_partkey", "p_partkey % 37 + 1", "src/parts/Part@own@.svelte", PART),
)



_MARK = re.compile(r"@(own|up|given)@")


def _given(own: Column) -> Column:
    return F.when(own % 2 == 0, F.concat(F.lit(' :id="'), own.cast("string"), F.lit('"'))).otherwise("")


def _filled(template: str, own: Column, up: Column | None = None) -> Column:
    """A template with its marks replaced."""
    values = {"own": own.cast("string"), "up": up.cast("string") if up is not None else None, "given": _given(own)}
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(_MARK.split(template)) if p])


def source_tree(spark, d: str) -> DataFrame:
    """(path, hash, content) of the files."""
    out = None
    for table, own, up, path, content in FILES:
        keys = F.expr(own), F.expr(up)
        rows = V.table(spark, d, table).select(_filled(path, *keys).alias("path"), _filled(content, *keys).alias("content"))
        out = rows if out is None else out.unionByName(rows)
    # the nations are a table of fixed size
    lines = V.table(spark, d, "nation").select("n_nationkey", _filled(EXPORT, F.col("n_nationkey")).alias("line"))
    barrel = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))), lambda x: x["line"]), "").alias("content"))
    out = out.unionByName(barrel.select(F.lit("src/nations/index.ts").alias("path"), "content"))
    return out.select("path", F.sha2("content", 256).alias("hash"), "content")


def _parsed(spark, d: str) -> DataFrame:
    return graph.saved(parse.parsed(source_tree(spark, d)))


def _filled_sql(template: str, own: str, up: str = "") -> str:
    values = {"own": f"CAST({own} AS VARCHAR)", "up": f"CAST({up} AS VARCHAR)", "given": f"CASE WHEN {own} % 2 = 0 THEN ' :id=\"' || {own} || '\"' ELSE '' END"}
    return " || ".join(values[p] if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(_MARK.split(template)) if p)


def _tree_sql() -> str:
    parts = [f"SELECT '{table}' AS kind, CAST({own} AS BIGINT) AS own, CAST({up} AS BIGINT) AS up, {_filled_sql(path, own, up)} AS path, {_filled_sql(content, own, up)} AS content FROM {table}" for table, own, up, path, content in FILES]
    parts.append(f"SELECT 'barrel', -1, -1, 'src/nations/index.ts', string_agg({_filled_sql(EXPORT, 'n_nationkey')}, '' ORDER BY n_nationkey) FROM nation")
    return f"tree AS ({' UNION ALL '.join(parts)})"


_EDGES = """edges AS (SELECT a.path AS parent, b.path AS child, CASE a.kind WHEN 'part' THEN 'auto' ELSE 'static' END AS import_type, true AS is_rendered
    FROM tree a JOIN tree b ON a.up = b.own AND b.kind = CASE a.kind WHEN 'nation' THEN 'region' WHEN 'supplier' THEN 'nation' WHEN 'customer' THEN 'nation' WHEN 'part' THEN 'supplier' END)"""


def over_tree(sql: str, edges: bool = False) -> str:
    return f"WITH {_tree_sql()}{', ' + _EDGES if edges else ''} {sql}"


# ---------------------------------------------------------------- files and imports


@query(
    over_tree(
        """SELECT path, sha256(content) AS hash, CASE kind WHEN 'customer' THEN 'react' WHEN 'part' THEN 'svelte' WHEN 'barrel' THEN 'unknown' ELSE 'vue' END AS framework,
        CASE kind WHEN 'barrel' THEN 'Nations' ELSE upper(kind[1]) || kind[2:] || own END AS name, len(content) - len(replace(content, chr(10), '')) + 1 AS line_count, kind = 'customer' AS is_page, false AS is_layout
        FROM tree"""
    )
)
def source_files(spark, d):
    """Framework, component name, line count and roles of every file."""
    parsed = _parsed(spark, d)
    return index.graph_tables(parsed)["files"].join(parsed.select("path", "name"), "path").withColumn("line_count", F.col("line_count").cast("long"))


@query(
    over_tree(
        """SELECT path, CASE kind WHEN 'nation' THEN 'Region' ELSE 'Nation' || up END AS name, CASE kind WHEN 'customer' THEN 'Nation' || up ELSE 'default' END AS exported,
        CASE kind WHEN 'nation' THEN '../regions/Region' || up || '.vue' WHEN 'supplier' THEN '@/nations/Nation' || up || '.vue' ELSE '../../nations' END AS source,
        CASE kind WHEN 'nation' THEN 'src/regions/Region' || up || '.vue' WHEN 'supplier' THEN 'src/nations/Nation' || up || '.vue' ELSE 'src/nations/index.ts' END AS target
        FROM tree WHERE kind IN ('nation', 'supplier', 'customer')"""
    )
)
def source_imports(spark, d):
    """Imports with the file that each resolves to: relative, by alias, and an index file."""
    parsed = _parsed(spark, d)
    return index.resolve(parse.table(parsed, "imports"), parsed).select("path", "name", "exported", "source", "target")


@query(over_tree("SELECT path, 'Nation' || n_nationkey AS name, 'default' AS local, './Nation' || n_nationkey || '.vue' AS source FROM tree, nation WHERE kind = 'barrel' UNION ALL SELECT path, 'default', 'Customer' || own, '' FROM tree WHERE kind = 'customer'"))
def source_exports(spark, d):
    return parse.table(_parsed(spark, d).filter("path NOT LIKE '%.svelte'"), "exports").select("path", "name", "local", "source")


@query(over_tree("SELECT * FROM edges", edges=True))
def source_edges(spark, d):
    """Edges of imports behind re-exports and of tags that name one component only."""
    return index.graph_tables(_parsed(spark, d))["edges"].select("parent", "child", "import_type", "is_rendered")


@query(over_tree("SELECT e.parent AS path, e.child AS dependency_path, sha256(t.content) AS content_hash FROM edges e JOIN tree t ON t.path = e.child WHERE import_type = 'static'", edges=True))
def source_dependencies(spark, d):
    return index.graph_tables(_parsed(spark, d))["file_dependencies"].distinct()


# ---------------------------------------------------------------- tags, contracts, state, calls


@query(
    over_tree(
        """SELECT path, CAST(line AS BIGINT) AS line, tag, prop, expression, is_spread FROM (
        SELECT path, 7 AS line, 'Region' AS tag, 'title' AS prop, 'n' || own AS expression, false AS is_spread FROM tree WHERE kind = 'nation' UNION ALL SELECT path, 7, 'Region', 'size', '' || own, false FROM tree WHERE kind = 'nation'
        UNION ALL SELECT path, 9, 'Nation' || up, 'id', '' || own, false FROM tree WHERE kind = 'supplier' AND own % 2 = 0 UNION ALL SELECT path, 9, 'Nation' || up, 'name', 's' || own, false FROM tree WHERE kind = 'supplier'
        UNION ALL SELECT path, 9, 'Nation' || up, 'pick', 'load', false FROM tree WHERE kind = 'supplier'
        UNION ALL SELECT path, 4, 'Nation' || up, 'id', 'id', false FROM tree WHERE kind = 'customer' UNION ALL SELECT path, 4, 'Nation' || up, '', 'rest' || own, true FROM tree WHERE kind = 'customer'
        UNION ALL SELECT path, 5, 'Supplier' || up, 'size', 'size', false FROM tree WHERE kind = 'part')"""
    )
)
def source_passed_props(spark, d):
    """What each custom tag passes, with its line in the file."""
    tags = parse.table(_parsed(spark, d), "rendered").select("path", "line", "tag", F.explode("props").alias("p"))
    return tags.select("path", F.col("line").cast("long").alias("line"), "tag", "p.prop", "p.expression", "p.is_spread")


@query(
    over_tree(
        """SELECT path, name, type, required FROM tree JOIN (VALUES ('region', 'title', 'string', true), ('region', 'size', 'number', false), ('nation', 'id', 'number', true), ('nation', 'name', 'string', false),
        ('customer', 'id', 'number', true), ('customer', 'label', 'string', false), ('part', 'size', 'number', true), ('part', 'label', 'string', false)) p(kind, name, type, required) USING (kind)"""
    )
)
def source_contract_props(spark, d):
    return _parsed(spark, d).select("path", F.explode("contract.props").alias("p")).select("path", "p.name", "p.type", "p.required")


@query(over_tree("SELECT path, what, name FROM tree JOIN (VALUES ('region', 'slot', 'default'), ('region', 'slot', 'foot'), ('nation', 'emit', 'pick')) p(kind, what, name) USING (kind)"))
def source_contract_events(spark, d):
    """Emits and slots of the components."""
    contract = _parsed(spark, d).select("path", F.explode(F.map_from_arrays(F.array(F.lit("slot"), F.lit("emit")), F.array("contract.slots", "contract.emits"))).alias("what", "names"))
    return contract.select("path", "what", F.explode("names").alias("name"))


@query(
    over_tree(
        """SELECT path, 'store' AS kind, 'useNationStore' AS identifier, access_mode, CAST(line_number AS BIGINT) AS line_number, usage_snippet, properties FROM tree,
        (VALUES ('read', 3, 'const store = useNationStore()', ''), ('write', 5, 'store.select()', 'select'), ('read', 6, 'const label = store.title', 'title')) o(access_mode, line_number, usage_snippet, properties) WHERE tree.kind = 'supplier'"""
    )
)
def source_state(spark, d):
    """Observations of a store: how, where and which of its properties."""
    rows = parse.table(_parsed(spark, d), "state")
    return rows.select("path", "kind", "identifier", "access_mode", F.col("line_number").cast("long").alias("line_number"), "usage_snippet", F.array_join("accessed_properties", ",").alias("properties"))


@query(
    over_tree(
        """SELECT path, CASE kind WHEN 'supplier' THEN 'axios' ELSE 'fetch' END AS client, CASE kind WHEN 'supplier' THEN 'POST' ELSE 'GET' END AS method, CASE kind WHEN 'supplier' THEN '/api/nations/:id/suppliers' ELSE '/api/customers/' || own END AS endpoint,
        CASE kind WHEN 'supplier' THEN 'key' ELSE '' END AS payload, CAST(CASE kind WHEN 'supplier' THEN 4 ELSE 3 END AS BIGINT) AS line FROM tree WHERE kind IN ('supplier', 'customer')"""
    )
)
def source_calls(spark, d):
    """Outbound calls with the normal form of their endpoints."""
    rows = parse.table(_parsed(spark, d), "calls")
    return rows.select("path", "client", "method", paths.endpoint(F.col("endpoint")).alias("endpoint"), F.array_join("payload", ",").alias("payload"), F.col("line").cast("long").alias("line"))


@query(over_tree("SELECT CASE kind WHEN 'supplier' THEN '/api/nations/:id/suppliers' ELSE '/api/customers/' || own END AS endpoint, CASE kind WHEN 'supplier' THEN 'POST' ELSE 'GET' END AS methods, count(DISTINCT path) AS callers, count(*) AS calls FROM tree WHERE kind IN ('supplier', 'customer') GROUP BY 1, 2"))
def source_endpoints(spark, d):
    return index.endpoint_summary(_parsed(spark, d)).select("endpoint", F.array_join("methods", "|").alias("methods"), "callers", "calls")


@query(over_tree("SELECT '/customers/Customer' || own AS url_path, path, 'react' AS framework FROM tree WHERE kind = 'customer'"))
def source_routes(spark, d):
    return index.graph_tables(_parsed(spark, d))["routes"].select("url_path", "path", "framework")


# ---------------------------------------------------------------- questions


@query(over_tree("SELECT path, upper(kind[1]) || kind[2:] || own AS name FROM tree WHERE kind NOT IN ('customer', 'barrel') AND path NOT IN (SELECT child FROM edges)", edges=True))
def source_unused_components(spark, d):
    parsed = _parsed(spark, d)
    return index.unused_components(parsed, index.graph_tables(parsed))


@query(
    over_tree(
        f""", uses AS (SELECT path, kind = 'customer' AS spread, kind = 'customer' OR own % 2 = 0 AS has_id, kind = 'supplier' AS has_name FROM tree WHERE kind IN ('supplier', 'customer') AND up = {TARGET}),
        grid AS (SELECT path, 'id' AS name, true AS required, has_id AS given, spread FROM uses UNION ALL SELECT path, 'name', false, has_name, spread FROM uses)
        SELECT name, required, count(*) FILTER (given) AS usages, count(DISTINCT CASE WHEN given THEN path END) AS files, count(*) FILTER (NOT given AND NOT spread) AS omissions, count(*) FILTER (NOT given AND spread) AS indeterminate FROM grid GROUP BY 1, 2"""
    )
)
def source_prop_impact(spark, d):
    """Uses and omissions of each prop of one component."""
    parsed = _parsed(spark, d)
    return index.prop_impact(parsed, index.graph_tables(parsed), f"src/nations/Nation{TARGET}.vue")


@query(over_tree(f"SELECT path, CAST(CASE kind WHEN 'supplier' THEN 9 ELSE 4 END AS BIGINT) AS line, 'Nation{TARGET}' AS tag FROM tree WHERE kind IN ('supplier', 'customer') AND up = {TARGET} ORDER BY path LIMIT 200"))
def source_find_component(spark, d):
    """The first 200 places that render a component, asked for by its name in lower case."""
    return index.find_component(_parsed(spark, d), f"nation{TARGET}").withColumn("line", F.col("line").cast("long"))


@query(over_tree(f"SELECT path, CAST(CASE kind WHEN 'supplier' THEN 9 ELSE 4 END AS BIGINT) AS line, 'Nation{TARGET}' AS tag, CASE kind WHEN 'supplier' THEN '' || own ELSE 'id' END AS expression FROM tree WHERE up = {TARGET} AND (kind = 'customer' OR (kind = 'supplier' AND own % 2 = 0)) ORDER BY path LIMIT 200"))
def source_find_prop(spark, d):
    return index.find_prop(_parsed(spark, d), f"Nation{TARGET}", "id").withColumn("line", F.col("line").cast("long"))


@query(over_tree("SELECT path, CAST(3 AS BIGINT) AS line, CAST(strpos(l, 'fetch(') AS BIGINT) AS \"column\", trim(l) AS snippet FROM (SELECT path, string_split(content, chr(10))[3] AS l FROM tree WHERE kind = 'customer') ORDER BY path LIMIT 200"))
def source_find_literal(spark, d):
    """The first 200 lines that hold a literal."""
    return index.find_literal(source_tree(spark, d), "fetch(").select("path", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"), "snippet")


@query(
    over_tree(
        f"""SELECT path AS file, CAST(strpos(content, ' name="s') AS BIGINT) AS "start", CAST(strpos(content, ' name="s') + 4 AS BIGINT) AS "end", 'name' AS old_snippet, 'label' AS replacement, sha256(content) AS sha256, 'ready' AS state
        FROM tree WHERE kind = 'supplier' AND up = {TARGET} UNION ALL SELECT path, strpos(content, '<Nation') - 1, strpos(content, '<Nation') - 1 + len('<Nation{TARGET}'), '<Nation{TARGET}', '', sha256(content), 'by-hand' FROM tree WHERE kind = 'customer' AND up = {TARGET}"""
    )
)
def source_patch_plan(spark, d):
    """Patches that rename a prop of one component, and the spreads that must be looked at."""
    found = refactor.plan(source_tree(spark, d), f"Nation{TARGET}", "rename_prop", "name", "label")
    return found.select("file", "start", "end", "old_snippet", "replacement", "sha256", "state")


@query(
    over_tree(
        """SELECT path, CAST(4 AS BIGINT) AS line, CAST(20 AS BIGINT) AS "column", CAST(4 AS BIGINT) AS end_line, CAST(20 + len(text) AS BIGINT) AS end_column, text
        FROM (SELECT path, 'axios.post(`/api/nations/${nation.id}/suppliers`, { key: ' || own || ' })' AS text FROM tree WHERE kind = 'supplier')"""
    )
)
def source_structure_call(spark, d):
    """Calls by a pattern with placeholders, wherever they stand."""
    found = structure.find(source_tree(spark, d), "$CLIENT.post($URL, { key: $KEY })", limit=None)
    return found.select("path", *[F.col(c).cast("long").alias(c) for c in ("line", "column", "end_line", "end_column")], "text")


@query(over_tree("SELECT path, CAST(CASE kind WHEN 'region' THEN 2 ELSE 3 END AS BIGINT) AS line, string_split(content, chr(10))[CASE kind WHEN 'region' THEN 2 ELSE 3 END] AS text FROM tree WHERE kind IN ('region', 'nation')"))
def source_structure_types(spark, d):
    """A pattern whose run of tokens stands between angle brackets."""
    return structure.find(source_tree(spark, d), "defineProps<$$$>()", limit=None).select("path", F.col("line").cast("long").alias("line"), "text")


@query(over_tree("SELECT path, CAST(7 AS BIGINT) AS line, trim(string_split(content, chr(10))[7]) AS text FROM tree WHERE kind = 'nation'"))
def source_structure_tags(spark, d):
    """A pattern of a tag with any attributes."""
    return structure.find(source_tree(spark, d), "<Region $$$ />", limit=None).select("path", F.col("line").cast("long").alias("line"), "text")


@query(over_tree("SELECT path, CAST(5 AS BIGINT) AS line, 'store.select(' || own || ')' AS text FROM tree WHERE kind = 'supplier' UNION ALL SELECT path, 3, 'fetch(' || chr(39) || '/api/customers/' || own || chr(39) || ')' FROM tree WHERE kind = 'customer'"))
def source_structure_rule(spark, d):
    """Either of two patterns, those with an expression left out."""
    rule = {"any": [{"pattern": "store.$M($X)"}, {"pattern": "fetch($X)"}], "not": {"pattern": "store.title($X)"}, "regex": "[0-9]"}
    return structure.find(source_tree(spark, d), rule=rule, limit=None).select("path", F.col("line").cast("long").alias("line"), "text")


@query(
    over_tree(
        """SELECT path, what, source, CAST(strpos(content, mark) + len(mark) - 1 AS BIGINT) AS "start" FROM (
        SELECT path, ':size' AS what, '' || own AS source, content, ' :size="' AS mark FROM tree WHERE kind = 'nation'
        UNION ALL SELECT path, ':id', '' || own, content, ' :id="' FROM tree WHERE kind = 'supplier' AND own % 2 = 0 UNION ALL SELECT path, '@pick', 'load', content, ' @pick="' FROM tree WHERE kind = 'supplier'
        UNION ALL SELECT path, 'expression', 'size', content, ' size={' FROM tree WHERE kind = 'part')"""
    )
)
def source_template_expressions(spark, d):
    """Expressions in templates with their places in the file."""

    @F.pandas_udf("array<struct<kind:string,source:string,start:long>>")
    def found(path: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([[{k: e[k] for k in ("kind", "source", "start")} for e in structure.template_expressions(p, t)] for p, t in zip(path, text, strict=True)])

    return source_tree(spark, d).select("path", F.explode(found("path", "content")).alias("e")).select("path", F.col("e.kind").alias("what"), "e.source", "e.start")


@query(
    over_tree(
        """SELECT path, CASE kind WHEN 'supplier' THEN 'POST api/nations/:id/suppliers' ELSE 'GET api/customers/' || own END AS intent,
        array_to_string(CASE kind WHEN 'supplier' THEN ['SupplierController', 'SupplierController@store', 'SupplierAction', 'SupplierService', 'SupplierHandler']
        ELSE [own || 'Controller', own || 'Controller@index', own || 'Action', own || 'Service', own || 'Handler'] END, '|') AS symbols FROM tree WHERE kind IN ('supplier', 'customer')"""
    )
)
def source_backend_targets(spark, d):
    """Names under which a backend may serve each call."""
    calls = parse.table(_parsed(spark, d), "calls").withColumn("t", targets.backend_target(F.col("method"), paths.endpoint(F.col("endpoint"))))
    return calls.select("path", "t.intent", F.array_join("t.symbols", "|").alias("symbols"))


@query(over_tree(f"SELECT count(*) AS candidates, count(*) FILTER (kind <> 'barrel') AS analyzed, CAST(0 AS BIGINT) AS failed, count(*) FILTER (kind = 'barrel') AS unsupported FROM tree WHERE contains(content, 'Nation{TARGET}') OR contains(content, 'nation{TARGET}')"))
def source_patch_coverage(spark, d):
    return refactor.coverage(source_tree(spark, d), f"Nation{TARGET}")


@query(
    over_tree(
        f""", near AS (SELECT DISTINCT parent AS node FROM edges WHERE child = 'src/nations/Nation{TARGET}.vue'), ranked AS (SELECT node, row_number() OVER (ORDER BY node) AS r FROM near)
        SELECT 'src/nations/Nation{TARGET}.vue' AS node, CAST(0 AS BIGINT) AS depth, (SELECT count(*) > 20 FROM near) AS has_more UNION ALL SELECT node, 1, (SELECT count(*) > 20 FROM near) FROM ranked WHERE r <= 20""",
        edges=True,
    )
)
def source_nearest_parents(spark, d):
    """The first 20 files above a component, and whether there are more."""
    edges = index.graph_tables(_parsed(spark, d))["edges"]
    found = graph.tree_paths(edges, spark.createDataFrame([(f"src/nations/Nation{TARGET}.vue",)], "path string"), 1)
    return graph.first_nodes(found, 20).select("node", F.col("depth").cast("long").alias("depth"), "has_more")


@query(over_tree(f"SELECT path, 'Nation{TARGET}' AS name, 'caller' AS verdict FROM tree WHERE kind IN ('supplier', 'customer') AND up = {TARGET}"))
def source_symbol_callers(spark, d):
    """Files that use a component, by its own file or through the file that exports it again."""
    files = source_tree(spark, d)
    return index.symbol_callers(files, _parsed(spark, d), f"src/nations/Nation{TARGET}.vue", "default")


@query(
    with_views(
        """SELECT DISTINCT 'src/app/(site)' || rtrim(url_path, '/') || '/page.tsx' AS path, '/' || trim(regexp_replace(url_path, '^/', ''), '/') AS url_path, 'page' AS type, '(site)' AS groups,
        'src/app/layout.tsx' || CASE WHEN regexp_matches(url_path, '^/[^/]+') THEN '>src/app/(site)' || regexp_extract(url_path, '^/[^/]+') || '/layout.tsx' ELSE '' END AS layouts FROM routes""",
        "routes",
    )
)
def source_app_routes(spark, d):
    """Pages of an app folder below a group, with the layouts around them: one of all and one of each first segment."""
    url = V.routes(spark, d).select(F.regexp_replace("url_path", "/$", "").alias("u")).distinct()
    pages = url.select(F.concat(F.lit("src/app/(site)"), "u", F.lit("/page.tsx")).alias("path"))
    layouts = url.filter("u <> ''").select(F.concat(F.lit("src/app/(site)"), F.regexp_extract("u", "^/[^/]+", 0), F.lit("/layout.tsx")).alias("path")).distinct()
    found = routing.app_routes(pages.unionByName(layouts).union(spark.sql("SELECT 'src/app/layout.tsx' AS path")))
    return found.filter("type = 'page'").select("path", "url_path", "type", F.array_join("groups", ">").alias("groups"), F.array_join("layouts", ">").alias("layouts"))
