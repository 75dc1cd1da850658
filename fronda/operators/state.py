"""State observations: (id, path, kind, identifier, access_mode, line_number, usage_snippet, accessed_properties)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fronda.functions.paths import name_rank

from fronda.functions.paths import same_boundary
from fronda.operators.graph import nearest_depths


def place() -> Column:
    """Order of observations: located lines first."""
    return F.struct((F.col("line_number") <= 0).cast("int").alias("unlocated"), F.col("line_number"), F.col("id"))


def priority(mode: Column) -> Column:
    return F.when(mode == "write", 3).when(mode == "watch", 2).otherwise(1)


def summarize(observations: DataFrame, keys: list[str]) -> DataFrame:
    """One row a group: kind and identifier of its first observation, evidence of its strongest, writes and properties in order.

    Lists hold distinct values, so they are first reduced to one row a value:
    a group with many observations is never gathered.
    """
    at = observations.withColumn("at", place()).withColumn("rank", F.struct(-priority(F.col("access_mode")), F.col("at")))
    head = at.groupBy(*keys).agg(
        F.min_by(F.struct("kind", "identifier"), "at").alias("first"),
        F.min_by(F.struct("access_mode", "line_number", "usage_snippet"), "rank").alias("evidence"),
        F.count("*").alias("observations"),
    )
    writes = at.filter("access_mode = 'write'").groupBy(*keys, "usage_snippet").agg(F.min("at").alias("at")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "usage_snippet"))).alias("writes"))
    spread = at.select(*keys, "at", F.posexplode("accessed_properties").alias("pos", "property"))
    props = spread.groupBy(*keys, "property").agg(F.min(F.struct("at", "pos")).alias("at")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "property"))).alias("props"))
    joined = head.join(writes, keys, "left").join(props, keys, "left")
    line = F.col("evidence.line_number")
    out = joined.select(
        *keys,
        F.col("first.kind").alias("state_kind"),
        F.col("first.identifier").alias("state_identifier"),
        F.col("evidence.access_mode").alias("access"),
        F.when(line > 0, line).alias("line"),
        F.col("evidence.usage_snippet").alias("snippet"),
        F.array_join(F.coalesce(F.col("writes.usage_snippet"), F.array().cast("array<string>")), "|").alias("actions"),
        F.array_join(F.coalesce(F.col("props.property"), F.array().cast("array<string>")), "|").alias("properties"),
        F.col("observations"),
    )
    return out.withColumn("role", F.when(F.col("access") == "write", "mutator").otherwise("reader"))


def state_impact(observations: DataFrame, files: DataFrame, identifier: str, role: str = "all") -> DataFrame:
    """Consumers of one identifier; a role limits the rows, not the counts of mutators and readers."""
    rows = summarize(observations.filter(F.col("identifier") == identifier), ["path"]).join(files.select("path", "is_page"), "path")
    # one row for the identifier
    counts = rows.groupBy("state_identifier").agg(F.count_if(F.col("role") == "mutator").alias("mutators"), F.count_if(F.col("role") == "reader").alias("readers"))
    rows = rows.join(F.broadcast(counts), "state_identifier")
    return rows if role == "all" else rows.filter(F.col("role") == {"mutators": "mutator", "readers": "reader"}[role])


def file_state(observations: DataFrame, path: str) -> DataFrame:
    return summarize(observations.filter(F.col("path") == path), ["path", "kind", "identifier"])


def direct_roles(observations: DataFrame, identifier: str) -> DataFrame:
    """Role of every file that touches the identifier, with the kind met first."""
    rows = observations.filter(F.col("identifier") == identifier)
    return rows.groupBy("path").agg(F.when(F.max((F.col("access_mode") == "write").cast("int")) == 1, "mutator").otherwise("reader").alias("role"), F.min_by("kind", "id").alias("first_kind"))


def state_chain(observations: DataFrame, edges: DataFrame, identifier: str, max_depth: int = 3, role: str = "all") -> DataFrame:
    """(path, depth): direct users (the role applies to them only), then their consumers at their least depth."""
    direct = direct_roles(observations, identifier)
    if role != "all":
        direct = direct.filter(F.col("role") == {"mutators": "mutator", "readers": "reader"}[role])
    return nearest_depths(edges, direct, max_depth or 3, same_boundary)


def state_chain_dependencies(observations: DataFrame, declares: DataFrame, identifier: str, max_depth: int = 3) -> DataFrame:
    """(identifier, path, depth): what the declaring file of an identifier uses, and so on; each identifier at its least depth.

    declares: (identifier, path) with one declaring file an identifier.
    """
    frontier = declares.filter(F.col("identifier") == identifier).withColumn("depth", F.lit(0))
    seen = frontier
    uses = observations.select(F.col("path").alias("from"), F.col("identifier").alias("used")).distinct()
    for depth in range(1, (max_depth or 3) + 1):
        found = frontier.join(uses, F.col("path") == F.col("from")).select(F.col("used").alias("identifier")).distinct()
        frontier = found.join(seen, "identifier", "left_anti").join(declares, "identifier").withColumn("depth", F.lit(depth)).select(*seen.columns)
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def dead_state(declared: DataFrame, observations: DataFrame) -> DataFrame:
    """Declared (identifier, path) that no other file touches."""
    users = observations.select(F.col("identifier").alias("used"), F.col("path").alias("by")).distinct()
    return declared.join(users, (F.col("identifier") == F.col("used")) & (F.col("path") != F.col("by")), "left_anti")


def consumers_of_importers(observations: DataFrame, edges: DataFrame, identifier: str) -> DataFrame:
    """Files that are imported by users of an identifier."""
    users = observations.filter(F.col("identifier") == identifier).select(F.col("path").alias("parent"))
    return edges.join(users, "parent", "left_semi").select(F.col("child").alias("path")).distinct()


ACCESS_MODES = ("read", "write", "watch")


def refused_modes(observations: DataFrame) -> DataFrame:
    """Observations whose access mode a store refuses."""
    return observations.filter(~F.coalesce(F.col("access_mode").isin(*ACCESS_MODES), F.lit(False)))


def declaring_file(files: DataFrame, declares: DataFrame, edges: DataFrame, observations: DataFrame, identifier: str) -> DataFrame:
    """(path, step) of the file that declares an identifier (declares: path, identifier): first of files named like it, then of files that its consumers import, then of all."""
    own = files.select("path").join(declares.filter(F.col("identifier") == identifier).select("path"), "path", "left_semi")
    near = edges.join(observations.filter(F.col("identifier") == identifier).select(F.col("path").alias("parent")).distinct(), "parent", "left_semi").select(F.col("child").alias("path")).distinct()
    named = own.join(near.withColumn("near", F.lit(True)), "path", "left")
    step = F.when(name_rank(F.col("path"), identifier) < 3, 1).when(F.col("near"), 2).otherwise(3)
    return named.select("path", step.alias("step")).orderBy("step", "path").limit(1)
