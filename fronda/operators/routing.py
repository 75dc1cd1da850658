"""Routes of an app folder: URL paths, groups, slots, intercepted segments, kinds and the layouts around each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fronda.functions import paths


def app_routes(files: DataFrame) -> DataFrame:
    """(path, url_path, type, groups, slot, intercepting, params, layouts) of the files (path) below an app folder that have a part in routing.

    A folder in brackets groups and one after @ is a slot; neither is in the
    URL; marks of interception are cut off.  layouts: files, outermost first,
    a layout file's own included.
    """
    at = r"^((?:.*?/)?app)/((?:.*/)?)[^/]*$"
    known = files.select("path", paths.app_file_type(F.col("path")).alias("type"), F.regexp_extract("path", at, 1).alias("base"), F.regexp_replace(F.regexp_extract("path", at, 2), "/$", "").alias("folder"))
    known = known.filter("type IS NOT NULL AND base <> ''")
    parts = F.filter(F.split("folder", "/"), lambda s: s != "")
    is_group = lambda s: s.startswith("(") & s.endswith(")")
    is_slot = lambda s: ~is_group(s) & s.startswith("@")
    mark = r"^\(\.{1,3}\)"
    url = F.filter(F.transform(F.filter(parts, lambda s: ~is_group(s) & ~is_slot(s)), lambda s: F.regexp_replace(s, mark, "")), lambda s: s != "")
    rows = known.select(
        "path", "type", "base", "folder",
        F.concat(F.lit("/"), F.array_join(url, "/")).alias("url_path"),
        F.filter(parts, is_group).alias("groups"),
        F.try_element_at(F.filter(parts, is_slot), F.lit(-1)).alias("slot"),
        F.try_element_at(F.filter(parts, lambda s: ~is_group(s) & s.rlike(mark)), F.lit(-1)).alias("intercepting"),
    )
    around = known.filter("type = 'layout'").groupBy("base", F.col("folder").alias("above")).agg(F.min("path").alias("layout"))
    # folders are shared by many files: each folder's chain is worked out once
    chains = known.select("base", "folder").distinct().select("base", "folder", F.explode(F.concat(F.array("folder"), F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(paths.ancestors(F.col("folder"))))).alias("above"))
    chain = chains.join(around, ["base", "above"]).groupBy("base", "folder").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.length("above").alias("depth"), "layout"))), lambda x: x["layout"]).alias("layouts"))
    found = rows.join(chain, ["base", "folder"], "left").withColumn("layouts", F.coalesce("layouts", F.array().cast("array<string>")))
    return found.withColumn("params", paths.route_params(F.col("url_path"))).drop("base", "folder")
