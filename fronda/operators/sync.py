"""Delta synchronisation of file snapshots: (path, hash)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(previous: DataFrame, scan: DataFrame) -> DataFrame:
    """(path, change): added, modified, deleted or unchanged."""
    joined = previous.select("path", F.col("hash").alias("old")).join(scan.select("path", F.col("hash").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull() & F.col("new").isNotNull(), "added").when(F.col("new").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified").otherwise("unchanged")
    return joined.select("path", change.alias("change"))


def change_counts(previous: DataFrame, scan: DataFrame) -> DataFrame:
    c = classify(previous, scan)
    return c.agg(*(F.count_if(F.col("change") == k).alias(k) for k in ("added", "modified", "deleted", "unchanged")), F.count("*").alias("total"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionAll(b.exceptAll(a).withColumn("side", F.lit("b")))


def stale_dependents(dependencies: DataFrame, scan: DataFrame) -> DataFrame:
    """Paths with a dependency whose hash differs from the stored one.

    A stored '' means the candidate was absent: its appearance makes the
    dependent stale, its continued absence does not.
    """
    now = scan.select(F.col("path").alias("dependency_path"), F.col("hash").alias("now"))
    joined = dependencies.join(now, "dependency_path", "left")
    stale = F.when(F.col("now").isNull(), F.col("content_hash") != "").otherwise(F.col("now") != F.col("content_hash"))
    return joined.filter(stale).select("path").distinct()


def merge(previous: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """Rows of `changed` in place of those with the same key; deletions have been left out of both before."""
    return previous.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)


def last_write_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(*keys, "r.*")


def config_fingerprint(configs: dict[str, str]) -> str:
    """One hash over the configuration files, in path order."""
    whole = hashlib.sha256()
    for path, content in sorted(configs.items()):
        own = hashlib.sha256(content.encode()).hexdigest()
        whole.update((json.dumps([path, own], ensure_ascii=False, separators=(",", ":")) + "\n").encode())
    return whole.hexdigest()


def manifest_hash(files: DataFrame) -> DataFrame:
    """SHA-256 over the JSON lines [path, hash] in path order; null if any hash is missing.

    The hash is of one sequence, so the sorted lines pass through the driver, a
    partition at a time; `manifest_tree_hash` is the parallel form.
    """
    whole, n, missing = hashlib.sha256(), 0, False
    for r in files.orderBy("path").select(F.to_json(F.array("path", "hash")).alias("line"), F.col("hash").isNull().alias("missing")).toLocalIterator():
        whole.update((r["line"] + "\n").encode())
        n, missing = n + 1, missing or r["missing"]
    return files.sparkSession.createDataFrame([(None if missing else whole.hexdigest(), n)], "manifest_hash string, files long")


def manifest_tree_hash(files: DataFrame, leaf: int = 4096) -> DataFrame:
    """One hash over all (path, hash), by levels of at most about `leaf` lines a row; null if any hash is missing."""
    level = files.select(F.sha2(F.col("path"), 256).alias("part"), F.concat_ws("\t", "path", "hash").alias("line"), F.col("hash").isNull().alias("missing"), F.lit(1).cast("long").alias("n"))
    digits = 0
    while 16**digits * leaf < files.count():
        digits += 1
    for d in range(digits, -1, -1):
        level = level.groupBy(F.substring("part", 1, d).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"), F.max("missing").alias("missing"), F.sum("n").alias("n"))
        level = level.select("part", F.concat_ws(":", "part", "h").alias("line"), "missing", "n", "h")
    return level.select(F.when(~F.col("missing"), F.col("h")).alias("manifest_hash"), F.col("n").alias("files"))
