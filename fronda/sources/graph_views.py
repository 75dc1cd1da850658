"""Graph tables derived from the star-schema Parquet files, one function a view.

`SQL` holds the same views as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cyclic edges: a user consumes the user of the previous event of the same type and hour."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    w = Window.partitionBy("event_type", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    pairs = e.withColumn("parent", F.lag("user_id").over(w)).filter("parent <> user_id")
    return pairs.select(F.concat(F.lit("u/"), "parent").alias("parent"), F.concat(F.lit("u/"), "user_id").alias("child")).distinct()


def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with import type and rendered flag, before first-writer-wins; seq is the write order."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    w = Window.partitionBy("event_type", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "click", "dynamic").when(F.col("event_type") == "view", "static").otherwise("auto")
    rows = e.withColumn("parent", F.lag("user_id").over(w)).filter("parent <> user_id")
    return rows.select(
        F.concat(F.lit("u/"), "parent").alias("parent"),
        F.concat(F.lit("u/"), "user_id").alias("child"),
        kind.alias("import_type"),
        (F.col("event_id") % 3 == 0).alias("is_rendered"),
        F.col("event_id").alias("seq"),
    )


def user_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        F.concat(F.lit("u/"), "user_id").alias("path"),
        F.when(F.col("user_id") % 3 == 0, "vue").when(F.col("user_id") % 3 == 1, "react").otherwise("svelte").alias("framework"),
        (F.col("user_id") % 10 == 0).alias("is_page"),
        (F.col("user_id") % 17 == 0).alias("is_layout"),
    )


def edges_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acyclic edges, parent consumes child: nation-region, customer-nation, supplier-nation, order-customer."""

    def pair(name: str, parent: str, parent_key: str, child: str, child_key: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(f"{parent}/"), parent_key).alias("parent"), F.concat(F.lit(f"{child}/"), child_key).alias("child"))

    out = pair("nation", "nation", "n_nationkey", "region", "n_regionkey")
    for args in (("customer", "customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"), ("orders", "orders", "o_orderkey", "customer", "o_custkey")):
        out = out.unionByName(pair(*args))
    return out


def files_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey"}
    out = None
    for name, key in keys.items():
        own = table(spark, sf_dir, name).select(F.concat(F.lit(f"{name}/"), key).alias("path"), F.lit(name).alias("framework"), F.lit(name == "orders").alias("is_page"), F.lit(name == "region").alias("is_layout"))
        out = own if out is None else out.unionByName(own)
    return out


def state_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State observations of users."""
    k = F.get_json_object("props", "$.k").cast("int")
    mode = F.when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "signup", "watch").otherwise("read")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u/"), "user_id").alias("path"),
        F.when(F.col("user_id") % 2 == 0, "store").otherwise("composable").alias("kind"),
        F.concat(F.lit("k"), k % 20).alias("identifier"),
        mode.alias("access_mode"),
        F.when(F.col("event_id") % 10 == 0, 0).otherwise(F.col("event_id")).cast("long").alias("line_number"),
        F.concat("event_type", F.lit("("), k % 7, F.lit(")")).alias("usage_snippet"),
        F.array(F.concat(F.lit("p"), k % 5), F.col("event_type")).alias("accessed_properties"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the documents as (path, hash)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = F.concat(F.lit("d/"), "doc_id").alias("path")
    a = d.filter("doc_id % 10 <> 0").select(path, F.sha2("text", 256).alias("hash"))
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    b = d.filter("doc_id % 7 <> 0").select(path, F.sha2(changed, 256).alias("hash"))
    return a, b


def file_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document depends on the one of a third of its number; '' as hash means: was absent."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    on = F.floor(F.col("doc_id") / 3).cast("long")
    old = d.select(F.col("doc_id").alias("dep_id"), F.sha2("text", 256).alias("dep_hash"))
    rows = d.filter("doc_id > 0").select("doc_id", on.alias("dep_id")).join(old, "dep_id", "left")
    return rows.select(
        F.concat(F.lit("d/"), "doc_id").alias("path"), F.concat(F.lit("d/"), "dep_id").alias("dependency_path"), F.when(F.col("dep_id") % 10 == 0, "").otherwise(F.coalesce("dep_hash", F.lit(""))).alias("content_hash")
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs as routes: path without scheme, host, query, fragment and suffix; numbers become parameters."""
    raw = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    clean = F.regexp_replace(F.regexp_replace(raw, r"\.[a-z]+$", ""), r"/+$", "")
    path = F.when(clean == "", "/").otherwise(clean)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("url_path"), F.regexp_replace(path, r"/[0-9]+", "/[id]").alias("pattern"))


def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages as outbound calls: endpoint, method by place, caller file."""
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("pos", "endpoint"))
    method = F.when(F.col("pos") % 3 == 0, "GET").when(F.col("pos") % 3 == 1, "POST").otherwise("PUT")
    return p.select(F.concat(F.lit("p/"), "page_id").alias("file"), "pos", "endpoint", method.alias("method"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1)).alias("tag"))


def tool_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        "ts",
        F.col("event_type").alias("tool"),
        F.concat(F.lit("a"), k % 3).alias("action"),
        F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        k.alias("items_found"),
        (k * 10).alias("bytes_out"),
        F.when(k % 4 == 0, 0).otherwise(k * 25).alias("source_bytes"),
        (k % 2 == 0).alias("cache_hit"),
        (k == 0).alias("empty_result"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-based lines of the documents."""
    parts = F.posexplode(F.split("text", "\r?\n")).alias("pos", "line")
    return table(spark, sf_dir, "documents").select("doc_id", parts).select("doc_id", (F.col("pos") + 1).alias("line_number"), "line")


SQL = {
    "edges_events": """SELECT DISTINCT 'u/' || parent AS parent, 'u/' || user_id AS child FROM (SELECT event_id, user_id, lag(user_id) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS parent FROM events)
        WHERE parent <> user_id""",
    "typed_edges": """SELECT 'u/' || parent AS parent, 'u/' || user_id AS child, CASE event_type WHEN 'click' THEN 'dynamic' WHEN 'view' THEN 'static' ELSE 'auto' END AS import_type, event_id % 3 = 0 AS is_rendered, event_id AS seq
        FROM (SELECT *, lag(user_id) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS parent FROM events) WHERE parent <> user_id""",
    "user_files": """SELECT DISTINCT 'u/' || user_id AS path, CASE user_id % 3 WHEN 0 THEN 'vue' WHEN 1 THEN 'react' ELSE 'svelte' END AS framework, user_id % 10 = 0 AS is_page, user_id % 17 = 0 AS is_layout FROM events""",
    "edges_tpch": """SELECT 'nation/' || n_nationkey AS parent, 'region/' || n_regionkey AS child FROM nation UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer
        UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier UNION ALL SELECT 'orders/' || o_orderkey, 'customer/' || o_custkey FROM orders""",
    "files_tpch": """SELECT 'region/' || r_regionkey AS path, 'region' AS framework, false AS is_page, true AS is_layout FROM region UNION ALL SELECT 'nation/' || n_nationkey, 'nation', false, false FROM nation
        UNION ALL SELECT 'customer/' || c_custkey, 'customer', false, false FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, 'supplier', false, false FROM supplier UNION ALL SELECT 'orders/' || o_orderkey, 'orders', true, false FROM orders""",
    "state_deps": """SELECT event_id AS id, 'u/' || user_id AS path, CASE WHEN user_id % 2 = 0 THEN 'store' ELSE 'composable' END AS kind, 'k' || (k % 20) AS identifier,
        CASE event_type WHEN 'purchase' THEN 'write' WHEN 'signup' THEN 'watch' ELSE 'read' END AS access_mode, CASE WHEN event_id % 10 = 0 THEN 0 ELSE event_id END AS line_number,
        event_type || '(' || (k % 7) || ')' AS usage_snippet, ['p' || (k % 5), event_type] AS accessed_properties FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "snap_a": "SELECT 'd/' || doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 0",
    "snap_b": "SELECT 'd/' || doc_id AS path, sha256(CASE WHEN doc_id % 11 = 0 THEN text || 'x' ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 0",
    "file_dependencies": """SELECT 'd/' || a.doc_id AS path, 'd/' || (a.doc_id // 3) AS dependency_path, CASE WHEN (a.doc_id // 3) % 10 = 0 THEN '' ELSE coalesce(sha256(b.text), '') END AS content_hash
        FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id // 3 WHERE a.doc_id > 0""",
    "routes": r"""SELECT page_id, url_path, regexp_replace(url_path, '/[0-9]+', '/[id]', 'g') AS pattern FROM (SELECT page_id, CASE WHEN clean = '' THEN '/' ELSE clean END AS url_path FROM (SELECT page_id,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '\.[a-z]+$', ''), '/+$', '') AS clean FROM pages))""",
    "hrefs": """SELECT 'p/' || page_id AS file, i - 1 AS pos, found[i] AS endpoint, CASE (i - 1) % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method
        FROM (SELECT page_id, found, unnest(range(1, len(found) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS found FROM pages))""",
    "tags": "SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages",
    "tool_log": """SELECT event_id AS seq, ts, event_type AS tool, 'a' || (k % 3) AS action, value AS duration_ms, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, k AS items_found, k * 10 AS bytes_out,
        CASE WHEN k % 4 = 0 THEN 0 ELSE k * 25 END AS source_bytes, k % 2 = 0 AS cache_hit, k = 0 AS empty_result FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "lines": """SELECT doc_id, i AS line_number, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS parts FROM documents))""".replace("\\\\", "\\"),
}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """`sql` over the named views; use it without a WITH clause of its own."""
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}"
