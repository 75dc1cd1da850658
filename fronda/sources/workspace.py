"""Workspace scan: source files of a tree as a DataFrame.

Files are listed and read by Spark, so a workspace may lie in any store Spark
reads.  Folder rules are column conditions; only ignore files, which are small
and few, reach the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fronda.functions.paths import ancestors, is_config

MAX_BYTES = 8 << 20

#: File kinds that are collected.
EXTENSIONS = (".vue", ".astro", ".svelte", ".ts", ".js", ".tsx", ".jsx", ".mjs", ".cjs")

#: Folders that are never entered (those that start with a dot are left out anyway).
IGNORED_DIRS = (
    ".git", ".svn", ".hg", ".idea", ".vscode", ".fleet", "node_modules", "vendor", ".bundle", "deps", "dist", "build", ".output", ".nuxt", ".next", ".astro", ".svelte-kit", "out", ".open-next",
    "storage", "public", "target", "__pycache__", ".venv", "venv", "env", "_build", "bin", "pkg", "coverage", ".nyc_output", ".bun", ".turbo", ".cache", ".parcel-cache", "playwright-report",
    "test-results", ".playwright", "storybook-static", "opencode", "docs", "doc", "documentation", "scripts", "tests", "test", "__tests__", "spec", "specs", "e2e", "cypress", "fixtures", "mocks",
    "logs", "tmp", "temp", "artifacts", "benchmarks", "benchmark",
)

def relative(root: str) -> Column:
    """Path below `root`, with forward slashes."""
    bare = re.sub(r"^file:/*", "/", root.rstrip("/"))
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), r"\\", "/")
    return F.when(path.startswith(bare + "/"), path.substr(F.lit(len(bare) + 2), F.length(path))).otherwise(path)


def _rule(line: str, folder: str) -> tuple[str, bool] | None:
    """Regex of an ignore rule over relative paths, and whether it takes files back in."""
    line = line.rstrip("\r\n").rstrip()
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line.lstrip("!").removeprefix("\\")
    below = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    out, i, line = "", 0, line.lstrip("/")
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    prefix = re.escape(folder + "/") if folder else ""
    return f"^{prefix}{'' if anchored else '(?:.*/)?'}{out}{'/' if below else '(?:/|$)'}", back


def _walk(spark: SparkSession, root: str, keep: tuple[str, ...] = ()) -> tuple[list[tuple[str, object]], list[str]]:
    """What Spark's own listing passes over, at any depth: (relative path, status) of files whose names start with . or _, and folders whose names start with _.

    Folders that a scan never enters are not entered here.
    """
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(root))
    size = len(top.toString().rstrip("/")) + 1
    files, folders, todo = [], [], [top.toString()]
    while todo:
        for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(todo.pop())):
            # one call for both
            path, folder = re.search(r"\{path=(.+?); isDirectory=(true|false); ", status.toString(), re.S).groups()
            name = path.rpartition("/")[2]
            if folder == "true":
                if not name.startswith(".") and (name in keep or name not in IGNORED_DIRS):
                    todo.append(path)
                    folders += [path] if name.startswith("_") else []
            elif name[0] in "._":
                files.append((path[size:], status))
    return sorted(files, key=lambda f: f[0]), sorted(folders)


def _read(spark: SparkSession, status) -> bytes:
    fs = status.getPath().getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.open(status.getPath())
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def ignore_rules(spark: SparkSession, root: str, names: tuple[str, ...] = (".gitignore",)) -> list[tuple[str, bool]]:
    """Rules of the ignore files in the tree, outer folders first."""
    found = []
    for path, status in _walk(spark, root)[0]:
        folder, _, name = path.rpartition("/")
        if name in names:
            found += [((folder.count("/") + bool(folder), folder, k), rule) for k, line in enumerate(_read(spark, status).decode("utf-8", "replace").split("\n")) if (rule := _rule(line, folder))]
    return [rule for _, rule in sorted(found)]


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that matches leaves the path out."""
    out = F.lit(False)
    for pattern, back in rules:
        out = F.when(path.rlike(pattern), F.lit(not back)).otherwise(out)
    return out


def exclusion(path: Column, exclude: list[str] | None = None, rules: list[tuple[str, bool]] | None = None, keep: tuple[str, ...] = ()) -> Column:
    """Why a path is left out: default-ignore, hidden, custom-exclude or ignore-file; null if it is not."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    out = F.when(F.arrays_overlap(folders, F.array(*[F.lit(d) for d in IGNORED_DIRS if d not in keep])), "default-ignore")
    out = out.when(F.exists(folders, lambda s: s.startswith(".")), "hidden")
    for e in exclude or []:
        e = e.strip("/")
        out = out.when((path == e) | path.startswith(e + "/") | F.array_contains(folders, e), "custom-exclude")
    return out.when(ignored(path, rules or []), "ignore-file")


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None, respect_ignore_files: bool = True, keep: tuple[str, ...] = (), configs: bool = False) -> DataFrame:
    """(path, hash, mtime, size, config, content) of every collected file, contents up to MAX_BYTES."""
    rules = ignore_rules(spark, root) if respect_ignore_files else []
    wanted = "(" + "|".join(re.escape(e) for e in EXTENSIONS) + ")$"
    hidden, folders = _walk(spark, root, keep)
    # Spark enters a folder with a leading underscore only if it is named, and takes names for patterns
    named = [re.sub(r"([\\*?\[\]{}])", r"\\\1", f) for f in folders]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([root, *named]).filter(F.col("length") <= MAX_BYTES)
    rows = files.select(relative(root).alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    # files with a leading underscore or dot are few and are read by the driver
    odd = [(path, status) for path, status in hidden if re.search(wanted, path) and status.getLen() <= MAX_BYTES]
    if odd:
        extra = spark.createDataFrame([(p, s.getModificationTime() / 1000.0, s.getLen(), bytearray(_read(spark, s))) for p, s in odd], "path string, mtime double, size long, content binary")
        rows = rows.unionByName(extra.withColumn("mtime", F.timestamp_seconds("mtime")))
    kept = F.col("path").rlike(wanted) | (is_config(F.col("path")) if configs else F.lit(False))
    rows = rows.filter(kept & exclusion(F.col("path"), exclude, rules, keep).isNull())
    return rows.select("path", F.sha2("content", 256).alias("hash"), "mtime", "size", is_config(F.col("path")).alias("config"), F.decode("content", "UTF-8").alias("content"))


def exclusions(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """(path, reason) of the outermost folder or file that is left out, each once; too-large: a source file that is refused for its size."""
    rules = ignore_rules(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(relative(root).alias("path"), "length")
    parts = F.split("path", "/")
    last = F.size(parts)
    # every folder above a file, with a slash at its end, then the file
    above = F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i < last, "/").otherwise("")))
    marked = F.transform(above, lambda p: F.struct(F.regexp_replace(p, "/$", "").alias("path"), exclusion(p, exclude, rules).alias("reason")))
    first = F.element_at(F.filter(marked, lambda m: m["reason"].isNotNull()), 1)
    wanted = "(" + "|".join(re.escape(e) for e in EXTENSIONS) + ")$"
    large = F.when(F.col("path").rlike(wanted) & (F.col("length") > MAX_BYTES), F.struct("path", F.lit("too-large").alias("reason")))
    found = files.filter(first_exists(marked) | large.isNotNull()).select(F.coalesce(F.when(first_exists(marked), first), large).alias("x"))
    return found.select("x.path", "x.reason").distinct().orderBy("path")


def first_exists(marked: Column) -> Column:
    return F.exists(marked, lambda m: m["reason"].isNotNull())


def page(files: DataFrame, offset: int = 0, limit: int = 500) -> DataFrame:
    return files.orderBy("path").offset(offset).limit(min(limit, 500))


def extension_counts(files: DataFrame) -> DataFrame:
    """Files of every known extension, zero included."""
    known = files.sparkSession.createDataFrame([(e,) for e in EXTENSIONS], "extension string")
    own = files.groupBy(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1).alias("extension")).agg(F.count("*").alias("n"))
    return known.join(own, "extension", "left").select("extension", F.coalesce("n", F.lit(0)).alias("files"))


def line_count(content: Column) -> Column:
    return F.size(F.split(content, "\r\n|\r|\n"))


def owners(files: DataFrame, configs: DataFrame) -> DataFrame:
    """`files` (path) with `owner`, the nearest folder above that has a configuration file (configs: path); null without one."""
    folders = configs.select(F.regexp_replace("path", "/?[^/]*$", "").alias("owner")).distinct()
    above = files.select("path", F.posexplode(ancestors(F.col("path"))).alias("rank", "owner"))
    found = above.join(folders, "owner").groupBy("path").agg(F.min_by("owner", "rank").alias("owner"))
    return files.join(found, "path", "left")
