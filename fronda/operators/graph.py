"""Bounded graph walks over (parent, child) edges.

Every walk is a loop of joins on the edge table, so depth, not data, bounds the
plan.  A walk of unknown depth stops on an empty frontier and writes its
frontier to the shared folder each round.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where that is unset and everything runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='fronda')}"
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """`df` written to the shared folder and read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/fronda-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _up(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("from"), F.col("parent").alias("to")).distinct()


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("from"), F.col("child").alias("to")).distinct()


def blast_radius(edges: DataFrame, targets: DataFrame, max_depth: int = 5) -> DataFrame:
    """(target, path, depth): consumers of each target, once for every depth at which they are reached.

    Duplicates of a node and depth go; a cycle brings a node, the target
    included, back at larger depths until `max_depth`.
    """
    step = _up(edges)
    frontier = targets.select(F.col("path").alias("target"), F.col("path").alias("from")).distinct()
    out = None
    for depth in range(1, max_depth + 1):
        frontier = frontier.join(step, "from").select("target", F.col("to").alias("from")).distinct()
        level = frontier.select("target", F.col("from").alias("path"), F.lit(depth).alias("depth"))
        out = level if out is None else out.unionByName(level)
    return out


def nearest_depths(edges: DataFrame, sources: DataFrame, max_depth: int, keep=None) -> DataFrame:
    """(path, depth): least depth of every node, level 1 being the sources; keep(from, to) may refuse a step."""
    step = _up(edges)
    if keep is not None:
        step = step.filter(keep(F.col("from"), F.col("to")))
    frontier = sources.select("path").distinct()
    seen = frontier.withColumn("depth", F.lit(1))
    for depth in range(2, max_depth + 1):
        reached = frontier.join(step, frontier.path == step["from"]).select(F.col("to").alias("path")).distinct()
        frontier = reached.join(seen, "path", "left_anti")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return seen


def reverse_closure(dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """All paths that depend, over any number of steps, on a changed path; the changed ones included.

    dependencies: (path, dependency_path).  Rounds stop when nothing new is found.
    """
    spark = dependencies.sparkSession
    root, n = f"{shared_folder(spark)}/fronda-closure-{uuid.uuid4().hex}", 0
    step = saved(dependencies.select("path", "dependency_path").distinct(), f"{root}/step")
    frontier = saved(changed.select("path").distinct(), f"{root}/seen/0")
    everything = lambda: spark.read.schema(frontier.schema).option("recursiveFileLookup", True).parquet(f"{root}/seen")
    while not frontier.isEmpty():
        n += 1
        new = frontier.select(F.col("path").alias("dependency_path")).join(step, "dependency_path").select("path").distinct()
        frontier = saved(new.join(everything(), "path", "left_anti"), f"{root}/seen/{n}")
    delete(spark, f"{root}/step")
    return everything()


def tree_paths(edges: DataFrame, roots: DataFrame, max_depth: int = 3, down: bool = False) -> DataFrame:
    """(root, node, parent, depth, path, circular): every branch from each root.

    A node that is already on its branch is a leaf flagged circular.
    """
    step = _down(edges) if down else _up(edges)
    rows = roots.select(F.col("path").alias("root"), F.col("path").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.array("path").alias("path"), F.lit(False).alias("circular"))
    out, frontier = rows, rows
    for depth in range(1, max_depth + 1):
        grown = frontier.filter(~F.col("circular")).join(step, F.col("node") == F.col("from"))
        frontier = grown.select("root", F.col("to").alias("node"), F.col("node").alias("parent"), F.lit(depth).alias("depth"), F.concat("path", F.array("to")).alias("path"), F.array_contains("path", F.col("to")).alias("circular"))
        out = out.unionByName(frontier)
    return out


def first_nodes(paths: DataFrame, limit: int = 20) -> DataFrame:
    """Branches to the `limit` nearest nodes of a tree (by least depth, then name), the roots apart, and whether there are more."""
    found = paths.filter("depth > 0").groupBy("node").agg(F.min("depth").alias("near")).orderBy("near", "node").limit(limit + 1)
    # limit + 1 rows, ranked in one task
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy("near", "node")))
    more = F.broadcast(ranked.agg((F.count("*") > limit).alias("has_more")))
    kept = ranked.filter(F.col("rank") <= limit).select("node")
    return paths.join(F.broadcast(kept.withColumn("kept", F.lit(True))), "node", "left").filter("kept OR depth = 0").drop("kept").join(more)


def inherit_flag(paths: DataFrame, own: DataFrame, flag: str = "is_client") -> DataFrame:
    """`paths` with whether the node or one before it on its branch is flagged in `own` (path, flag)."""
    marked = own.filter(F.col(flag)).select(F.col("path").alias("on"))
    key = F.xxhash64("root", "path")
    hits = paths.select(key.alias("key"), F.explode("path").alias("on")).join(marked, "on", "left_semi").select("key").distinct()
    return paths.withColumn("key", key).join(hits.withColumn("hit", F.lit(True)), "key", "left").withColumn(flag, F.coalesce("hit", F.lit(False))).drop("key", "hit")


def nearest_provider(paths: DataFrame, consumers: DataFrame, providers: DataFrame) -> DataFrame:
    """(root, node, key, provider): nearest provider of a consumed key among the node's ancestors on its branch; null if dangling.

    Both tables are (path, key).  The first provider in branch order wins.
    """
    branch = paths.filter(~F.col("circular")).select("root", "node", F.col("path").alias("branch"))
    wanted = branch.join(consumers.select(F.col("path").alias("node"), "key").distinct(), "node")
    above = wanted.select("root", "node", "key", "branch", F.posexplode(F.slice("branch", 1, F.greatest(F.size("branch") - 1, F.lit(0)))).alias("pos", "above"))
    found = above.join(providers.select(F.col("path").alias("above"), "key").distinct(), ["above", "key"]).groupBy("root", "node", "key", "branch").agg(F.min_by("above", F.col("pos")).alias("provider"))
    return wanted.join(found, ["root", "node", "key", "branch"], "left").select("root", "node", "key", F.concat_ws(">", "branch").alias("branch"), "provider")


def first_writer_wins(edges: DataFrame) -> DataFrame:
    """One edge a (parent, child, import_type): rendered before not, then write order."""
    order = F.struct((~F.col("is_rendered")).cast("int"), F.col("seq"))
    return edges.groupBy("parent", "child", "import_type").agg(F.min_by(F.struct("is_rendered", "seq"), order).alias("r")).select("parent", "child", "import_type", "r.is_rendered", "r.seq")


def import_rank(import_type):
    return F.when(import_type == "static", 0).when(import_type == "dynamic", 1).otherwise(2)


def parents_ranked(edges: DataFrame, files: DataFrame) -> DataFrame:
    """First edge of each (child, parent): rendered first, then static, dynamic, auto; with its relation and rank by path."""
    best = edges.groupBy("child", "parent").agg(F.min_by(F.struct("import_type", "is_rendered"), F.struct((~F.col("is_rendered")).cast("int"), import_rank(F.col("import_type")), F.col("seq"))).alias("e"))
    relation = F.when(F.col("e.import_type") == "dynamic", "dynamic-import").when(F.col("e.is_rendered"), "render").otherwise("import")
    joined = best.join(files.select(F.col("path").alias("parent"), "framework", "is_page"), "parent")
    return joined.select("child", "parent", "framework", "is_page", relation.alias("relation"), F.row_number().over(Window.partitionBy("child").orderBy("parent")).alias("position"))


def unused_components(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Components that are no page or layout and that no rendered or dynamic edge reaches."""
    used = edges.filter(F.col("is_rendered") | (F.col("import_type") == "dynamic")).select(F.col("child").alias("path"))
    return components.filter(~F.col("is_page") & ~F.col("is_layout")).join(used, "path", "left_anti")


def passed_chains(passes: DataFrame, max_hops: int = 3) -> DataFrame:
    """Props handed on unchanged over two or more steps of a branch: (origin, target, prop, hops, via).

    passes: (parent, child, prop).  A chain is a run of edges of a branch that all pass the prop.
    """
    step = passes.select("parent", "child", "prop").distinct()
    chain = step.select(F.col("parent").alias("origin"), F.col("child").alias("target"), "prop", F.lit(1).alias("hops"), F.array("parent", "child").alias("via"))
    out = None
    for hops in range(2, max_hops + 1):
        grown = chain.join(step.select(F.col("parent").alias("target"), F.col("child").alias("next"), "prop"), ["target", "prop"]).filter(~F.array_contains("via", F.col("next")))
        chain = grown.select("origin", F.col("next").alias("target"), "prop", F.lit(hops).alias("hops"), F.concat("via", F.array("next")).alias("via"))
        out = chain if out is None else out.unionByName(chain)
    return out


def unique_candidates(uses: DataFrame, catalog: DataFrame, taken: DataFrame) -> DataFrame:
    """(path, key, target) where a used key (path, key) has one candidate (key, target) that is neither the path itself nor taken (path, target).

    Candidates are counted by key first; only uses with exactly one left are
    joined with the catalog, and then a use meets at most one candidate more than it has taken.
    """
    catalog = catalog.select("key", "target").distinct()
    counts = catalog.groupBy("key").agg(F.count("*").alias("n"))
    gone = taken.select("path", "target").unionByName(uses.select("path", F.col("path").alias("target"))).distinct().join(catalog, "target").select("path", "key", "target")
    used_up = gone.groupBy("path", "key").agg(F.count("*").alias("gone"))
    one = uses.select("path", "key").distinct().join(counts, "key").join(used_up, ["path", "key"], "left").filter(F.col("n") - F.coalesce("gone", F.lit(0)) == 1)
    return one.select("path", "key").join(catalog, "key").join(gone, ["path", "key", "target"], "left_anti").select("path", "key", "target")
