"""All published queries of the graph engine with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fronda.functions import names, paths
from fronda.operators import graph, patches, search, state, sync, telemetry
from fronda.sources import graph_views as V
from fronda.sources import workspace
from fronda.sources.graph_views import with_views

FLAGSHIP = "blast_radius"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
IDENTIFIER = "k3"
LITERAL = "the "


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---------------------------------------------------------------- graph


def _busiest(edges: DataFrame) -> DataFrame:
    """The child with most parents, the first by name of several."""
    return edges.groupBy("child").count().orderBy(F.col("count").desc(), "child").limit(1).select(F.col("child").alias("path"))


_BUSIEST = "(SELECT child FROM edges_events GROUP BY child ORDER BY count(*) DESC, child LIMIT 1)"


@query(
    with_views(
        f"""+walk(path, depth) AS (SELECT parent, 1 FROM edges_events WHERE child = {_BUSIEST} UNION SELECT e.parent, w.depth + 1 FROM walk w JOIN edges_events e ON e.child = w.path WHERE w.depth < 4)
        SELECT w.path, f.framework, f.is_page, CAST(w.depth AS BIGINT) AS depth FROM walk w JOIN user_files f ON f.path = w.path""",
        "edges_events", "user_files", recursive=True,
    )
)
def blast_radius(spark, d):
    edges = graph.saved(V.edges_events(spark, d))
    found = graph.blast_radius(edges, _busiest(edges), 4)
    return found.join(V.user_files(spark, d), "path").select("path", "framework", "is_page", F.col("depth").cast("long").alias("depth"))


@query(
    with_views(
        """+walk(path, depth) AS (SELECT parent, 1 FROM edges_tpch WHERE child = 'region/0' UNION SELECT e.parent, w.depth + 1 FROM walk w JOIN edges_tpch e ON e.child = w.path WHERE w.depth < 5)
        SELECT w.path, f.framework, f.is_page, CAST(w.depth AS BIGINT) AS depth FROM walk w JOIN files_tpch f ON f.path = w.path""",
        "edges_tpch", "files_tpch", recursive=True,
    )
)
def blast_radius_tpch(spark, d):
    target = spark.sql("SELECT 'region/0' AS path")
    found = graph.blast_radius(V.edges_tpch(spark, d), target, 5)
    return found.join(V.files_tpch(spark, d), "path").select("path", "framework", "is_page", F.col("depth").cast("long").alias("depth"))


@query(
    with_views(
        """SELECT f.path, f.framework FROM files_tpch f WHERE NOT is_page AND NOT is_layout AND NOT EXISTS (SELECT 1 FROM edges_tpch e WHERE e.child = f.path AND
        (NOT starts_with(e.parent, 'orders/') OR CAST(substr(e.parent, 8) AS BIGINT) % 20 = 0))""",
        "files_tpch", "edges_tpch",
    )
)
def unused_components(spark, d):
    edges = V.edges_tpch(spark, d)
    order = F.when(F.col("parent").startswith("orders/"), F.substring_index("parent", "/", -1).cast("long"))
    kept = edges.withColumn("is_rendered", F.coalesce(order % 20 == 0, F.lit(True))).withColumn("import_type", F.lit("static"))
    return graph.unused_components(V.files_tpch(spark, d), kept).select("path", "framework")


@query(
    with_views(
        """SELECT parent, child, import_type, is_rendered, seq FROM (SELECT *, row_number() OVER (PARTITION BY parent, child, import_type ORDER BY is_rendered DESC, seq) AS rn FROM typed_edges) WHERE rn = 1""",
        "typed_edges",
    )
)
def edge_first_writer_wins(spark, d):
    return graph.first_writer_wins(V.typed_edges(spark, d))


@query(
    with_views(
        """+best AS (SELECT *, row_number() OVER (PARTITION BY child, parent ORDER BY is_rendered DESC, CASE import_type WHEN 'static' THEN 0 WHEN 'dynamic' THEN 1 ELSE 2 END, seq) AS rn FROM typed_edges)
        SELECT b.child, b.parent, f.framework, f.is_page, CASE WHEN b.import_type = 'dynamic' THEN 'dynamic-import' WHEN b.is_rendered THEN 'render' ELSE 'import' END AS relation,
        row_number() OVER (PARTITION BY b.child ORDER BY b.parent) AS position FROM best b JOIN user_files f ON f.path = b.parent WHERE rn = 1""",
        "typed_edges", "user_files",
    )
)
def parents_ranked(spark, d):
    return graph.parents_ranked(V.typed_edges(spark, d), V.user_files(spark, d)).withColumn("position", F.col("position").cast("long"))


def _tree_sql(frm: str, to: str) -> str:
    return with_views(
        f"""+walk(node, parent, depth, path, circular) AS (SELECT {_BUSIEST}, CAST(NULL AS VARCHAR), 0, [{_BUSIEST}], false UNION ALL
        SELECT e.{to}, w.node, w.depth + 1, list_append(w.path, e.{to}), list_contains(w.path, e.{to}) FROM walk w JOIN edges_events e ON e.{frm} = w.node WHERE NOT w.circular AND w.depth < 3)
        SELECT node, parent, CAST(depth AS BIGINT) AS depth, array_to_string(path, '>') AS branch, circular FROM walk""",
        "edges_events", recursive=True,
    )


def _tree(spark, d, down):
    edges = graph.saved(V.edges_events(spark, d))
    found = graph.tree_paths(edges, _busiest(edges), 3, down)
    return found.select("node", "parent", F.col("depth").cast("long").alias("depth"), F.concat_ws(">", "path").alias("branch"), "circular")


@query(_tree_sql("child", "parent"))
def upward_tree_paths(spark, d):
    return _tree(spark, d, False)


@query(_tree_sql("parent", "child"))
def downward_tree_paths(spark, d):
    return _tree(spark, d, True)


@query(
    with_views(
        f"""+walk(node, depth, path, circular) AS (SELECT {_BUSIEST}, 0, [{_BUSIEST}], false UNION ALL
        SELECT e.child, w.depth + 1, list_append(w.path, e.child), list_contains(w.path, e.child) FROM walk w JOIN edges_events e ON e.parent = w.node WHERE NOT w.circular AND w.depth < 3)
        SELECT node, array_to_string(path, '>') AS branch, EXISTS (SELECT 1 FROM user_files f WHERE f.framework = 'react' AND list_contains(w.path, f.path)) AS is_client FROM walk w""",
        "edges_events", "user_files", recursive=True,
    )
)
def client_boundaries(spark, d):
    edges = V.edges_events(spark, d)
    own = V.user_files(spark, d).select("path", (F.col("framework") == "react").alias("is_client"))
    return graph.inherit_flag(graph.tree_paths(edges, _busiest(edges), 3, True), own).select("node", F.concat_ws(">", "path").alias("branch"), "is_client")


@query(
    with_views(
        f"""+walk(node, depth, path, circular) AS (SELECT {_BUSIEST}, 0, [{_BUSIEST}], false UNION ALL
        SELECT e.child, w.depth + 1, list_append(w.path, e.child), list_contains(w.path, e.child) FROM walk w JOIN edges_events e ON e.parent = w.node WHERE NOT w.circular AND w.depth < 3),
        wants AS (SELECT DISTINCT path AS node, identifier AS key FROM state_deps WHERE access_mode = 'watch'), gives AS (SELECT DISTINCT path, identifier AS key FROM state_deps WHERE access_mode = 'write'),
        above AS (SELECT w.node, n.key, w.path, w.path[i] AS up, i FROM (SELECT node, path, unnest(range(1, len(path))) AS i FROM walk WHERE NOT circular) w JOIN wants n ON n.node = w.node)
        SELECT w.node, n.key, array_to_string(w.path, '>') AS branch, (SELECT min_by(a.up, a.i) FROM above a JOIN gives g ON g.path = a.up AND g.key = a.key WHERE a.node = w.node AND a.key = n.key AND a.path = w.path) AS provider
        FROM walk w JOIN wants n ON n.node = w.node WHERE NOT w.circular""",
        "edges_events", "state_deps", recursive=True,
    )
)
def context_coverage(spark, d):
    edges, deps = V.edges_events(spark, d), V.state_deps(spark, d).withColumnRenamed("identifier", "key")
    found = graph.nearest_provider(graph.tree_paths(edges, _busiest(edges), 3, True), deps.filter("access_mode = 'watch'"), deps.filter("access_mode = 'write'"))
    return found.select("node", "key", "branch", "provider")


@query(
    with_views(
        """+steps AS (SELECT DISTINCT parent, child, 'p' || (seq % 50) AS prop FROM typed_edges WHERE is_rendered),
        chain(origin, target, prop, hops, via) AS (SELECT parent, child, prop, 1, [parent, child] FROM steps UNION ALL
        SELECT c.origin, s.child, c.prop, c.hops + 1, list_append(c.via, s.child) FROM chain c JOIN steps s ON s.parent = c.target AND s.prop = c.prop WHERE c.hops < 3 AND NOT list_contains(c.via, s.child))
        SELECT origin, target, prop, CAST(hops AS BIGINT) AS hops, array_to_string(via, '>') AS via FROM chain WHERE hops > 1""",
        "typed_edges", recursive=True,
    )
)
def props_drilling(spark, d):
    passes = V.typed_edges(spark, d).filter("is_rendered").select("parent", "child", F.concat(F.lit("p"), F.col("seq") % 50).alias("prop"))
    return graph.passed_chains(passes, 3).select("origin", "target", "prop", F.col("hops").cast("long").alias("hops"), F.concat_ws(">", "via").alias("via"))


# ---------------------------------------------------------------- state

_SUMMARY = """SELECT {keys}, head.state_kind, head.state_identifier, ev.access_mode AS access, CASE WHEN ev.line_number > 0 THEN ev.line_number END AS line, ev.usage_snippet AS snippet,
    coalesce(wr.actions, '') AS actions, coalesce(pr.properties, '') AS properties, head.observations, CASE WHEN ev.access_mode = 'write' THEN 'mutator' ELSE 'reader' END AS role
    FROM (SELECT {keys}, arg_min(kind, (line_number <= 0, line_number, id)) AS state_kind, arg_min(identifier, (line_number <= 0, line_number, id)) AS state_identifier, count(*) AS observations FROM obs GROUP BY ALL) head
    JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY CASE access_mode WHEN 'write' THEN 3 WHEN 'watch' THEN 2 ELSE 1 END DESC, line_number <= 0, line_number, id) AS rn FROM obs) WHERE rn = 1) ev USING ({keys})
    LEFT JOIN (SELECT {keys}, string_agg(usage_snippet, '|' ORDER BY ord) AS actions FROM (SELECT {keys}, usage_snippet, min((line_number <= 0, line_number, id)) AS ord FROM obs WHERE access_mode = 'write' GROUP BY ALL) GROUP BY ALL) wr USING ({keys})
    LEFT JOIN (SELECT {keys}, string_agg(property, '|' ORDER BY ord) AS properties FROM (SELECT {keys}, property, min((line_number <= 0, line_number, id, pos)) AS ord FROM
        (SELECT {keys}, line_number, id, unnest(accessed_properties) AS property, unnest(range(len(accessed_properties))) AS pos FROM obs) GROUP BY ALL) GROUP BY ALL) pr USING ({keys})"""


def _impact_sql(where: str) -> str:
    return with_views(
        f"""+obs AS (SELECT * FROM state_deps WHERE identifier = '{IDENTIFIER}'), summary AS ({_SUMMARY.format(keys="path")}),
        counted AS (SELECT s.*, f.is_page, count(*) FILTER (WHERE role = 'mutator') OVER () AS mutators, count(*) FILTER (WHERE role = 'reader') OVER () AS readers FROM summary s JOIN user_files f USING (path))
        SELECT * FROM counted {where}""",
        "state_deps", "user_files",
    )


@query(_impact_sql(""))
def state_impact(spark, d):
    return state.state_impact(V.state_deps(spark, d), V.user_files(spark, d), IDENTIFIER)


@query(_impact_sql("WHERE role = 'mutator'"))
def state_impact_mutators(spark, d):
    return state.state_impact(V.state_deps(spark, d), V.user_files(spark, d), IDENTIFIER, "mutators")


@query(with_views(f"+obs AS (SELECT * FROM state_deps WHERE path = 'u/8') {_SUMMARY.format(keys='path, kind, identifier').replace('arg_min(kind', 'min(kind').replace('min(kind, (line_number <= 0, line_number, id))', 'min(kind)').replace('arg_min(identifier, (line_number <= 0, line_number, id))', 'min(identifier)')}", "state_deps"))
def file_state_deps(spark, d):
    return state.file_state(V.state_deps(spark, d), "u/8")


@query(
    with_views(
        f"SELECT path, CASE WHEN bool_or(access_mode = 'write') THEN 'mutator' ELSE 'reader' END AS role, arg_min(kind, id) AS first_kind FROM state_deps WHERE identifier = '{IDENTIFIER}' GROUP BY path",
        "state_deps",
    )
)
def direct_role_map(spark, d):
    return state.direct_roles(V.state_deps(spark, d), IDENTIFIER)


@query(
    with_views(
        f"""+walk(path, depth) AS (SELECT DISTINCT path, 1 FROM state_deps WHERE identifier = '{IDENTIFIER}' AND access_mode = 'write' UNION SELECT e.parent, w.depth + 1 FROM walk w JOIN edges_events e ON e.child = w.path WHERE w.depth < 3)
        SELECT path, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY path""",
        "state_deps", "edges_events", recursive=True,
    )
)
def state_chain_consumers(spark, d):
    found = state.state_chain(V.state_deps(spark, d), V.edges_events(spark, d), IDENTIFIER, 3, "mutators")
    return found.select("path", F.col("depth").cast("long").alias("depth"))


def _declares(spark, d):
    return V.state_deps(spark, d).filter("access_mode = 'write'").groupBy("identifier").agg(F.min_by("path", "id").alias("path"))


@query(
    with_views(
        f"""+declares AS (SELECT identifier, arg_min(path, id) AS path FROM state_deps WHERE access_mode = 'write' GROUP BY identifier),
        walk(identifier, path, depth) AS (SELECT identifier, path, 0 FROM declares WHERE identifier = '{IDENTIFIER}' UNION
        SELECT dd.identifier, dd.path, w.depth + 1 FROM walk w JOIN (SELECT DISTINCT path, identifier FROM state_deps) s ON s.path = w.path JOIN declares dd ON dd.identifier = s.identifier WHERE w.depth < 2)
        SELECT identifier, any_value(path) AS path, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY identifier HAVING min(depth) > 0""",
        "state_deps", recursive=True,
    )
)
def state_chain_dependencies(spark, d):
    found = state.state_chain_dependencies(V.state_deps(spark, d), _declares(spark, d), IDENTIFIER, 2)
    return found.select("identifier", "path", F.col("depth").cast("long").alias("depth"))


@query(
    with_views(
        """+declared AS (SELECT DISTINCT identifier, path FROM state_deps WHERE access_mode = 'write'), used AS (SELECT * FROM state_deps WHERE access_mode = 'watch')
        SELECT identifier, path FROM declared x WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.identifier = x.identifier AND u.path <> x.path)""",
        "state_deps",
    )
)
def dead_state(spark, d):
    deps = V.state_deps(spark, d)
    declared = deps.filter("access_mode = 'write'").select("identifier", "path").distinct()
    return state.dead_state(declared, deps.filter("access_mode = 'watch'"))


@query(
    with_views(
        f"SELECT DISTINCT e.child AS path FROM edges_events e WHERE e.parent IN (SELECT path FROM state_deps WHERE identifier = '{IDENTIFIER}')",
        "edges_events", "state_deps",
    )
)
def imported_by_consumers(spark, d):
    return state.consumers_of_importers(V.state_deps(spark, d), V.edges_events(spark, d), IDENTIFIER)


# ---------------------------------------------------------------- sync

_CHANGES = """SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.hash IS DISTINCT FROM b.hash THEN 'modified' ELSE 'unchanged' END AS change
    FROM snap_a a FULL JOIN snap_b b ON a.path = b.path"""


@query(with_views(f"+c AS ({_CHANGES}) SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'modified') AS modified, count(*) FILTER (WHERE change = 'deleted') AS deleted, count(*) FILTER (WHERE change = 'unchanged') AS unchanged, count(*) AS total FROM c", "snap_a", "snap_b"))
def change_counts(spark, d):
    return sync.change_counts(*V.snapshots(spark, d))


@query(with_views(f"SELECT * FROM ({_CHANGES}) WHERE change <> 'unchanged'", "snap_a", "snap_b"))
def added_modified_deleted(spark, d):
    return sync.classify(*V.snapshots(spark, d)).filter("change <> 'unchanged'")


@query(with_views("(SELECT *, 'a' AS side FROM (SELECT * FROM snap_a EXCEPT ALL SELECT * FROM snap_b)) UNION ALL (SELECT *, 'b' AS side FROM (SELECT * FROM snap_b EXCEPT ALL SELECT * FROM snap_a))", "snap_a", "snap_b"))
def snapshot_symmetric_diff(spark, d):
    return sync.symmetric_difference(*V.snapshots(spark, d))


_STALE = "SELECT DISTINCT f.path FROM file_dependencies f LEFT JOIN snap_b b ON b.path = f.dependency_path WHERE CASE WHEN b.path IS NULL THEN f.content_hash <> '' ELSE b.hash <> f.content_hash END"


@query(with_views(_STALE, "file_dependencies", "snap_b"))
def stale_dependents(spark, d):
    return sync.stale_dependents(V.file_dependencies(spark, d), V.snapshots(spark, d)[1])


@query(
    with_views(
        f"+changed AS (SELECT path FROM ({_CHANGES}) WHERE change IN ('modified', 'deleted')), walk(path) AS (SELECT path FROM changed UNION SELECT f.path FROM walk w JOIN file_dependencies f ON f.dependency_path = w.path) SELECT path FROM walk",
        "snap_a", "snap_b", "file_dependencies", recursive=True,
    )
)
def reverse_impact_closure(spark, d):
    changed = sync.classify(*V.snapshots(spark, d)).filter("change IN ('modified', 'deleted')")
    return graph.reverse_closure(V.file_dependencies(spark, d), changed)


@query(with_views("SELECT * FROM snap_b UNION ALL SELECT a.path, a.hash FROM snap_a a WHERE NOT EXISTS (SELECT 1 FROM snap_b b WHERE b.path = a.path)", "snap_a", "snap_b"))
def snapshot_merge(spark, d):
    a, b = V.snapshots(spark, d)
    return sync.merge(a, b)


@query(with_views("SELECT sha256(string_agg(CAST(to_json([path, hash]) AS VARCHAR) || chr(10), '' ORDER BY path)) AS manifest_hash, count(*) AS files FROM snap_b", "snap_b"))
def manifest_hash(spark, d):
    return sync.manifest_hash(V.snapshots(spark, d)[1])


# ---------------------------------------------------------------- routes


@query(with_views("SELECT CASE WHEN split_part(pattern, '/', 2) = '' THEN '/' ELSE '/' || split_part(pattern, '/', 2) END AS prefix, count(*) AS routes FROM routes GROUP BY 1", "routes"))
def route_summaries(spark, d):
    return V.routes(spark, d).groupBy(paths.top_segment(F.col("pattern")).alias("prefix")).agg(F.count("*").alias("routes"))


@query(with_views("SELECT page_id, url_path FROM routes WHERE url_path = '/en' OR starts_with(url_path, '/en/')", "routes"))
def route_prefix_filter(spark, d):
    return V.routes(spark, d).filter(paths.within(F.col("url_path"), "/en")).select("page_id", "url_path")


@query(with_views("SELECT DISTINCT pattern, CAST(len(regexp_extract_all(pattern, '\\[[^]]*\\]')) AS BIGINT) AS n_params, regexp_replace(array_to_string(regexp_extract_all(pattern, '\\[[^]]*\\]'), '|'), '[\\[\\]]', '', 'g') AS params FROM routes", "routes"))
def route_params(spark, d):
    p = paths.route_params(F.col("pattern"))
    return V.routes(spark, d).select("pattern").distinct().select("pattern", F.size(p).cast("long").alias("n_params"), F.array_join(F.transform(p, lambda x: x["name"]), "|").alias("params"))


@query(
    with_views(
        """+patterns AS (SELECT DISTINCT pattern FROM routes UNION SELECT DISTINCT '/' || split_part(pattern, '/', 2) || '/[...rest]' FROM routes),
        best AS (SELECT r.page_id, r.url_path, p.pattern, row_number() OVER (PARTITION BY r.page_id, r.url_path ORDER BY len(regexp_extract_all(p.pattern, '\\[[^]]*\\]')), length(p.pattern) DESC, p.pattern) AS rn
        FROM routes r JOIN patterns p ON split_part(r.url_path, '/', 2) = split_part(p.pattern, '/', 2)
        AND regexp_full_match(r.url_path, replace(replace(regexp_replace(p.pattern, '\\.html', 'html', 'g'), '[...rest]', '.+'), '[id]', '[^/]+')))
        SELECT page_id, url_path, pattern FROM best WHERE rn = 1""",
        "routes",
    )
)
def route_best_match(spark, d):
    """Patterns meet URLs of their first segment and depth; those that take the rest of a path meet every depth."""
    r = V.routes(spark, d)
    first = lambda c: F.split(c, "/").getItem(1)
    patterns = r.select("pattern").union(r.select(F.concat(F.lit("/"), first(F.col("pattern")), F.lit("/[...rest]")))).distinct()
    depth = F.when(F.col("pattern").contains("[..."), -1).otherwise(F.size(F.split("pattern", "/")))
    ranked = patterns.select("pattern", first(F.col("pattern")).alias("top"), depth.alias("depth"), paths.route_regex(F.col("pattern")).alias("regex"), F.size(paths.route_params(F.col("pattern"))).alias("n"))
    urls = r.select("url_path").distinct().select("url_path", first(F.col("url_path")).alias("top"), F.explode(F.array(F.lit(-1), F.size(F.split("url_path", "/")))).alias("depth"))
    met = urls.join(ranked, ["top", "depth"]).filter(F.expr("url_path RLIKE regex"))
    best = met.groupBy("url_path").agg(F.min_by("pattern", F.struct("n", -F.length("pattern"), "pattern")).alias("pattern"))
    return r.select("page_id", "url_path").join(best, "url_path").select("page_id", "url_path", "pattern").distinct()


@query(
    with_views(
        """+dirs AS (SELECT page_id, url_path, i, array_to_string(string_split(url_path, '/')[1:i], '/') AS dir FROM (SELECT page_id, url_path, unnest(range(1, len(string_split(url_path, '/')) + 1)) AS i FROM routes)),
        layouts AS (SELECT DISTINCT '/' || split_part(url_path, '/', 2) AS dir FROM routes WHERE page_id % 2 = 0 UNION SELECT '')
        SELECT page_id, url_path, string_agg(CASE WHEN l.dir = '' THEN '/' ELSE l.dir END, '>' ORDER BY i DESC) AS layouts FROM dirs JOIN layouts l USING (dir) GROUP BY page_id, url_path""",
        "routes",
    )
)
def layout_chain(spark, d):
    """Layouts above a route, nearest first."""
    r = V.routes(spark, d)
    layouts = r.filter("page_id % 2 = 0").select(F.concat(F.lit("/"), F.split("url_path", "/").getItem(1)).alias("dir")).union(spark.sql("SELECT '' AS dir")).distinct()
    parts = F.split("url_path", "/")
    dirs = r.select("page_id", "url_path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("i", "dir"))
    named = F.when(F.col("dir") == "", "/").otherwise(F.col("dir"))
    chain = F.sort_array(F.collect_list(F.struct("i", named.alias("dir"))), asc=False)
    return dirs.join(layouts, "dir").groupBy("page_id", "url_path").agg(F.array_join(F.transform(chain, lambda x: x["dir"]), ">").alias("layouts"))


@query(
    with_views(
        """SELECT endpoint, string_agg(method, '|' ORDER BY first_seen) AS methods, any_value(callers) AS callers FROM (SELECT endpoint, method, min((file, pos)) AS first_seen FROM hrefs GROUP BY ALL)
        JOIN (SELECT endpoint, count(DISTINCT file) AS callers FROM hrefs GROUP BY endpoint) USING (endpoint) GROUP BY endpoint""",
        "hrefs",
    )
)
def endpoint_summary(spark, d):
    calls = V.hrefs(spark, d)
    seen = calls.groupBy("endpoint", "method").agg(F.min(F.struct("file", "pos")).alias("at")).groupBy("endpoint").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "method"))), lambda x: x["method"]), "|").alias("methods"))
    return seen.join(calls.groupBy("endpoint").agg(F.countDistinct("file").alias("callers")), "endpoint")


# ---------------------------------------------------------------- telemetry

_PERCENT = "CASE WHEN {b} > 0 THEN floor(({a}) * 1000.0 / ({b}) + 0.5) / 10 ELSE 0.0 END"
_MEASURES = f"""count(*) AS calls, count(*) FILTER (WHERE status = 'error') AS errors, {_PERCENT.format(a="count(*) FILTER (WHERE status = 'error')", b="count(*)")} AS error_rate,
    {_PERCENT.format(a="count(*) FILTER (WHERE cache_hit)", b="count(*)")} AS cache_hit_rate, count(*) FILTER (WHERE empty_result) AS empty, count(*) FILTER (WHERE duration_ms >= 250) AS slow,
    CAST(floor(avg(duration_ms) + 0.5) AS BIGINT) AS avg_ms, quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms, CAST(sum(items_found) AS BIGINT) AS items, CAST(sum(bytes_out) AS BIGINT) AS bytes"""


@query(
    with_views(
        f"SELECT {_MEASURES}, {_PERCENT.format(a='sum(source_bytes) FILTER (WHERE source_bytes > 0) - sum(bytes_out) FILTER (WHERE source_bytes > 0)', b='sum(source_bytes) FILTER (WHERE source_bytes > 0)')} AS saving FROM tool_log",
        "tool_log",
    )
)
def telemetry_overall(spark, d):
    return telemetry.overall(V.tool_log(spark, d))


@query(with_views(f"SELECT tool, {_MEASURES} FROM tool_log GROUP BY tool", "tool_log"))
def telemetry_by_tool(spark, d):
    return telemetry.by(V.tool_log(spark, d), "tool")


@query(with_views(f"SELECT tool, action, {_MEASURES} FROM tool_log GROUP BY tool, action", "tool_log"))
def telemetry_by_action(spark, d):
    return telemetry.by(V.tool_log(spark, d), "tool", "action")


@query(with_views("SELECT seq, tool, action, duration_ms FROM tool_log WHERE status = 'error' ORDER BY seq DESC LIMIT 10", "tool_log"))
def telemetry_recent_errors(spark, d):
    return telemetry.recent_errors(V.tool_log(spark, d)).select("seq", "tool", "action", "duration_ms")


@query(with_views("SELECT tool, count(*) AS calls FROM (SELECT * FROM tool_log ORDER BY seq DESC LIMIT 500) WHERE tool = 'click' GROUP BY tool", "tool_log"))
def telemetry_tail(spark, d):
    return telemetry.tail(V.tool_log(spark, d), 500, "click").groupBy("tool").agg(F.count("*").alias("calls"))


# ---------------------------------------------------------------- search and text


@query(with_views(f"SELECT doc_id, line_number, CAST(strpos(line, '{LITERAL}') AS BIGINT) AS \"column\", trim(line) AS snippet FROM lines WHERE contains(line, '{LITERAL}')", "lines"))
def literal_search(spark, d):
    found = search.literal_matches(V.lines(spark, d), LITERAL, limit=None)
    return found.withColumn("line_number", F.col("line_number").cast("long")).withColumn("column", F.col("column").cast("long"))


@query("SELECT doc_id, contains(text, 'idiot') AND contains(text, 'the') AS every, contains(text, 'idiot') OR contains(text, 'des') AS some FROM documents")
def keyword_pruning(spark, d):
    text = F.col("text")
    return V.table(spark, d, "documents").select("doc_id", search.has_keywords(text, ["idiot", "the"]).alias("every"), search.has_keywords(text, ["idiot", "des"], every=False).alias("some"))


@query(with_views("SELECT tag, count(*) AS uses, count(DISTINCT page_id) AS files FROM tags GROUP BY tag", "tags"))
def tag_inventory(spark, d):
    return V.tags(spark, d).groupBy("tag").agg(F.count("*").alias("uses"), F.countDistinct("page_id").alias("files"))


@query(
    with_views(
        """+catalog AS (SELECT 'u/' || user_id AS path, 'k' || (user_id // 2) AS key FROM (SELECT DISTINCT user_id FROM events)), uses AS (SELECT DISTINCT path, identifier FROM state_deps),
        met AS (SELECT u.path, u.identifier, c.path AS target, count(*) OVER (PARTITION BY u.path, u.identifier) AS n FROM uses u JOIN catalog c ON c.key = u.identifier AND c.path <> u.path
        WHERE NOT EXISTS (SELECT 1 FROM edges_events e WHERE e.parent = u.path AND e.child = c.path)) SELECT path, identifier, target FROM met WHERE n = 1""",
        "state_deps", "edges_events",
    )
)
def auto_import_unique(spark, d):
    """Names that resolve to exactly one candidate that is not the file itself and not imported already."""
    users = V.table(spark, d, "events").select("user_id").distinct()
    catalog = users.select(F.concat(F.lit("u/"), "user_id").alias("target"), F.concat(F.lit("k"), F.floor(F.col("user_id") / 2)).alias("key"))
    uses = V.state_deps(spark, d).select("path", F.col("identifier").alias("key")).distinct()
    imported = V.edges_events(spark, d).select(F.col("parent").alias("path"), F.col("child").alias("target"))
    return graph.unique_candidates(uses, catalog, imported).withColumnRenamed("key", "identifier")


@query(
    r"""WITH named AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'UIPart' || upper(substr(p_brand, 1, 1)) || substr(p_brand, 2) WHEN 1 THEN 'partName' || p_size ELSE 'HTTPUrl_View' || p_size END AS name FROM part)
    SELECT p_partkey, name, lower(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z0-9])', '\1-\2', 'g'), '([a-z0-9])([A-Z])', '\1-\2', 'g')) AS kebab,
    lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1-\2', 'g'), '[\s_]+', '-', 'g')) AS attribute FROM named"""
)
def kebab_names(spark, d):
    brand = F.concat(F.upper(F.substring("p_brand", 1, 1)), F.expr("substring(p_brand, 2)"))
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("UIPart"), brand)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("partName"), "p_size")).otherwise(F.concat(F.lit("HTTPUrl_View"), "p_size"))
    named = V.table(spark, d, "part").select("p_partkey", name.alias("name"))
    return named.select("p_partkey", "name", names.kebab(F.col("name")).alias("kebab"), names.kebab_attribute(F.col("name")).alias("attribute"))


@query(with_views("SELECT path FROM files_tpch WHERE regexp_matches(path, '(^|/)order[^/]*/[^/]1[^/]*$', 'i')", "files_tpch"))
def glob_filter(spark, d):
    return V.files_tpch(spark, d).filter(paths.matches_glob(F.col("path"), "Order*/?1*")).select("path")


@query("SELECT regexp_extract(url, '(\\.[A-Za-z0-9]+)$', 1) AS extension, count(*) AS files FROM pages GROUP BY 1")
def extension_counts(spark, d):
    return V.table(spark, d, "pages").groupBy(paths.extension(F.col("url")).alias("extension")).agg(F.count("*").alias("files"))


@query("SELECT doc_id, n_chars, CAST(running AS BIGINT) AS running FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY lang, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running + 256 <= 65536")
def budget_prefix(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return search.budget_prefix(docs, ["lang", "doc_id"], "n_chars", 65536).select("doc_id", "n_chars", "running")


@query(with_views("SELECT path, framework, is_page FROM files_tpch ORDER BY is_page DESC, path LIMIT 50 OFFSET 100", "files_tpch"))
def deterministic_page(spark, d):
    return search.page(V.files_tpch(spark, d), [F.col("is_page").desc(), "path"], 100, 50).select("path", "framework", "is_page")


@query("SELECT (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS pages, (SELECT count(DISTINCT event_type) FROM events) AS event_types")
def table_counts(spark, d):
    counts = [V.table(spark, d, t).agg(F.count("*").alias(t)) for t in ("events", "documents", "pages")]
    kinds = V.table(spark, d, "events").agg(F.countDistinct("event_type").alias("event_types"))
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).crossJoin(kinds)


# ---------------------------------------------------------------- patches


def _patches(spark, d):
    docs = V.table(spark, d, "documents").filter("n_chars >= 12").select("doc_id", "n_chars")
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: ((F.col("doc_id") * 7 + i * 13) % (F.col("n_chars") - 10)).cast("long")))
    return docs.select(F.col("doc_id").alias("file"), at.alias("start")).select("file", "start", (F.col("start") + 4 + F.col("start") % 5).alias("end"), F.concat(F.lit("<"), F.col("start"), F.lit(">")).alias("replacement")).distinct()


_PATCHES = """all_p AS (SELECT DISTINCT file, s AS "start", s + 4 + s % 5 AS "end", '<' || s || '>' AS replacement FROM (SELECT doc_id AS file, (doc_id * 7 + i * 13) % (n_chars - 10) AS s FROM documents, range(6) r(i) WHERE n_chars >= 12)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY "start", "end") AS rn FROM all_p),
    walk(file, rn, "start", "end", replacement, last_end, kept) AS (SELECT file, rn, "start", "end", replacement, "end", true FROM ranked WHERE rn = 1 UNION ALL
        SELECT r.file, r.rn, r."start", r."end", r.replacement, CASE WHEN r."start" < w.last_end THEN w.last_end ELSE r."end" END, r."start" >= w.last_end FROM walk w JOIN ranked r ON r.file = w.file AND r.rn = w.rn + 1)"""


@query(f'WITH RECURSIVE {_PATCHES} SELECT file, "start", "end", replacement FROM walk WHERE kept')
def patch_overlap_filter(spark, d):
    return patches.drop_overlaps(_patches(spark, d))


@query(
    f"""WITH RECURSIVE {_PATCHES}, kept AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY "start" DESC) AS k FROM walk WHERE kept),
    splice(file, k, content) AS (SELECT doc_id, 0, text FROM documents UNION ALL
        SELECT s.file, s.k + 1, substr(s.content, 1, CAST(p."start" AS INTEGER)) || p.replacement || substr(s.content, CAST(p."end" AS INTEGER) + 1) FROM splice s JOIN kept p ON p.file = s.file AND p.k = s.k + 1)
    SELECT file, sha256(arg_max(content, k)) AS content_hash FROM splice GROUP BY file"""
)
def patch_apply(spark, d):
    contents = V.table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content"))
    applied = patches.apply(contents, patches.drop_overlaps(_patches(spark, d)))
    return applied.select("file", F.sha2("content", 256).alias("content_hash"))


# ---------------------------------------------------------------- names and owners


@query(
    with_views(
        """SELECT path, CASE WHEN regexp_matches('/' || path, '/order[^/]*/1\\.') THEN 0 WHEN regexp_matches('/' || lower(path), '/nation\\.') THEN 1 WHEN regexp_matches('/' || lower(path), '/nation/index\\.') THEN 2 ELSE 3 END AS place
        FROM files_tpch WHERE contains(lower(path), 'nation')""".replace("\\\\", "\\"),
        "files_tpch",
    )
)
def candidate_order(spark, d):
    files = V.files_tpch(spark, d)
    return files.select("path", paths.name_rank(F.col("path"), "Nation").alias("place")).filter("place IS NOT NULL")


@query(
    """WITH named AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '^' || p_size || '.' || (p_partkey % 7) WHEN 1 THEN '~' || p_size || '.' || (p_partkey % 7) || '.' || (p_partkey % 100) ELSE 'latest' END AS version FROM part)
    SELECT p_partkey, version, CAST(nullif(regexp_extract(version, '([0-9]+)\\.([0-9]+)(\\.([0-9]+))?', 1), '') AS BIGINT) AS major, CAST(nullif(regexp_extract(version, '([0-9]+)\\.([0-9]+)(\\.([0-9]+))?', 2), '') AS BIGINT) AS minor,
    CASE WHEN version = 'latest' THEN NULL ELSE coalesce(CAST(nullif(regexp_extract(version, '([0-9]+)\\.([0-9]+)(\\.([0-9]+))?', 4), '') AS BIGINT), 0) END AS patch FROM named""".replace("\\\\", "\\")
)
def version_parts(spark, d):
    k = F.col("p_partkey")
    version = F.when(k % 3 == 0, F.concat(F.lit("^"), "p_size", F.lit("."), k % 7)).when(k % 3 == 1, F.concat(F.lit("~"), "p_size", F.lit("."), k % 7, F.lit("."), k % 100)).otherwise("latest")
    named = V.table(spark, d, "part").select("p_partkey", version.alias("version"))
    return named.withColumn("v", paths.semver(F.col("version"))).select("p_partkey", "version", "v.major", "v.minor", "v.patch")


@query(
    with_views(
        """+folders AS (SELECT DISTINCT '/' || split_part(url_path, '/', 2) AS owner FROM routes WHERE regexp_matches(url_path, '[02468]$') UNION SELECT ''),
        above AS (SELECT DISTINCT url_path, array_to_string(string_split(url_path, '/')[1:i], '/') AS owner, i FROM (SELECT url_path, unnest(range(0, len(string_split(url_path, '/')))) AS i FROM routes))
        SELECT url_path AS path, arg_max(owner, i) AS owner FROM above JOIN folders USING (owner) GROUP BY url_path""",
        "routes",
    )
)
def nearest_owner(spark, d):
    r = V.routes(spark, d)
    configs = r.filter(F.col("url_path").rlike("[02468]$")).select(F.concat(F.lit("/"), F.split("url_path", "/").getItem(1), F.lit("/package.json")).alias("path")).union(spark.sql("SELECT 'package.json' AS path"))
    return workspace.owners(r.select(F.col("url_path").alias("path")).distinct(), configs)


@query(
    with_views(
        f"""+near AS (SELECT DISTINCT e.child AS path FROM edges_events e WHERE e.parent IN (SELECT path FROM state_deps WHERE identifier = '{IDENTIFIER}')),
        own AS (SELECT DISTINCT s.path, CASE WHEN s.path IN (SELECT path FROM near) THEN 2 ELSE 3 END AS step FROM state_deps s WHERE identifier = '{IDENTIFIER}' AND access_mode = 'write')
        SELECT path, step FROM own ORDER BY step, path LIMIT 1""",
        "edges_events", "state_deps",
    )
)
def declaring_file(spark, d):
    deps = V.state_deps(spark, d)
    declares = deps.filter("access_mode = 'write'").select("path", "identifier").distinct()
    return state.declaring_file(V.user_files(spark, d), declares, V.edges_events(spark, d), deps, IDENTIFIER)
