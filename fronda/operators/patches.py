"""Text patches: (file, start, end, replacement), offsets in characters from 0, half-open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PATCH = "struct<start:bigint,end:bigint,replacement:string>"


def drop_overlaps(patches: DataFrame) -> DataFrame:
    """Patches by offset, each that starts before the end of the last one kept is dropped."""
    grouped = patches.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("all"))
    kept = F.expr(f"""aggregate(all, CAST(array() AS array<{_PATCH}>),
        (kept, p) -> CASE WHEN size(kept) > 0 AND p.start < element_at(kept, -1).end THEN kept ELSE concat(kept, array(p)) END)""")
    return grouped.select("file", F.explode(kept).alias("p")).select("file", "p.*")


def apply(contents: DataFrame, patches: DataFrame) -> DataFrame:
    """(file, content) with non-overlapping patches applied, from the last to the first."""
    grouped = patches.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement")), asc=False).alias("all"))
    spliced = F.expr("aggregate(all, content, (text, p) -> concat(substring(text, 1, CAST(p.start AS INT)), p.replacement, substring(text, CAST(p.end AS INT) + 1)))")
    return contents.join(grouped, "file", "left").select("file", F.when(F.col("all").isNull(), F.col("content")).otherwise(spliced).alias("content"))


def preconditions(patches: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(file, start, end, problem) of patches (with sha256 and old_snippet) that do not fit their file's snapshot (file, sha256, content)."""
    own = snapshots.select("file", F.col("sha256").alias("now"), "content")
    found = F.expr("substring(content, CAST(start AS INT) + 1, CAST(end - start AS INT))")
    problem = (
        F.when(F.col("now").isNull(), "missing-file")
        .when((F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.length("content")), "bad-span")
        .when(F.col("now") != F.col("sha256"), "stale-hash")
        .when(found != F.col("old_snippet"), "snippet-mismatch")
    )
    return patches.join(own, "file", "left").select("file", "start", "end", problem.alias("problem")).filter(F.col("problem").isNotNull())
