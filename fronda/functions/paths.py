"""Path predicates, roles and route forms as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File kinds that are indexed.
INDEXED = (".vue", ".astro", ".svelte", ".tsx", ".jsx", ".ts", ".js")


def within(path: Column, scope: str) -> Column:
    """The scope itself or anything below it."""
    scope = scope.rstrip("/")
    return (path == scope) | path.startswith(scope + "/")


def contains_any(path: Column, filters: list[str]) -> Column:
    """Any filter as a substring; no filter means every path."""
    out = F.lit(not filters)
    for f in filters:
        out = out | path.contains(f)
    return out


def boundary(path: Column) -> Column:
    """The apps/x or packages/x part that owns a path, '' without one (the last one counts)."""
    deep = F.regexp_extract(path, r"^(.*/(?:apps|packages)/[^/]+)/", 1)
    return F.when(deep != "", deep).otherwise(F.regexp_extract(path, r"^((?:apps|packages)/[^/]+)/", 1))


def same_boundary(a: Column, b: Column) -> Column:
    return (boundary(a) == "") | (boundary(b) == "") | (boundary(a) == boundary(b))


def glob_regex(glob: str) -> str:
    """Regex of a glob with **, * and ?, anchored at path segments, without regard to case."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"(?i)(?:^|/){out}$"


def matches_glob(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)


def is_page(path: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    return path.rlike(r"(^|/)(pages|Pages|views|Views)/") | base.rlike(r"^(page|\+page)\.[a-z]+$")


def is_layout(path: Column) -> Column:
    """The file name counts in any case, the folder only as written."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    return path.rlike(r"(^|/)(layouts|Layouts)/") | base.contains("layout")


def is_test(path: Column) -> Column:
    return path.rlike(r"(^|/)(tests?|__tests__|spec)/") | path.rlike(r"\.(test|spec)\.[cm]?[jt]sx?$")


#: File names that count as configuration.
CONFIG_FILES = ("package.json", "tsconfig.json", "jsconfig.json", ".gitignore", "nuxt.config.mjs", "next.config.mjs", "astro.config.mjs")
CONFIG_PATTERNS = (r"(?i)^(tsconfig|jsconfig)(\..+)?\.json$", r"(?i)^(nuxt|next|astro|svelte|vite)\.config\.(ts|js|mjs|cjs|mts)$")


def is_config(path: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    out = base.isin(*CONFIG_FILES)
    for p in CONFIG_PATTERNS:
        out = out | base.rlike(p)
    return out


def normal_route(path: Column) -> Column:
    """One leading slash, none at the end, none doubled."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(path), "/+", "/"), "^/|/$", "")
    return F.concat(F.lit("/"), inner)


def top_segment(path: Column) -> Column:
    first = F.split(path, "/").getItem(1)
    return F.when(F.coalesce(first, F.lit("")) == "", F.lit("/")).otherwise(F.concat(F.lit("/"), first))


def route_params(path: Column) -> Column:
    """Ordered (name, type) of the parameters in a route: [[...x]], [...x], [x], :x and _x."""
    parts = F.filter(F.split(path, "/"), lambda s: s.rlike(r"^\[.*\]$|^:.+|^_[A-Za-z]"))
    kind = lambda s: F.when(s.startswith("[[..."), "optional-catch-all").when(s.startswith("[..."), "catch-all").when(s.startswith("[["), "optional").otherwise("dynamic")
    return F.transform(parts, lambda s: F.struct(F.regexp_replace(s, r"^\[+(\.\.\.)?|\]+$|^:|^_|\(.*\)|[*+?]$", "").alias("name"), kind(s).alias("type")))


def route_regex(path: Column) -> Column:
    """Regex text of a route pattern, for a match against a URL path."""
    quoted = F.regexp_replace(path, r"([.+^$|(){}\\])", r"\\$1")
    steps = [(r"/\[\[\\\.\\\.\\\.[^/\]]+\]\]", "(?:/.*)?"), (r"\[\\\.\\\.\\\.[^/\]]+\]", ".+"), (r"\[[^/\]]+\]", "[^/]+"), (r"(?<=/):[^/]+", "[^/]+")]
    for pattern, put in steps:
        quoted = F.regexp_replace(quoted, pattern, put)
    return F.concat(F.lit("^"), quoted, F.lit("$"))


def route_from_file(path: Column) -> Column:
    """URL path of a file below a routes folder: groups, slots and intercepting parts go, index and page names too."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.(get|post|put|patch|delete|head|options)(\.[a-z]+)$", "$2"), r"\.[A-Za-z]+$", "")
    parts = F.filter(F.split(bare, "/"), lambda s: ~s.rlike(r"^\([^.)][^)]*\)$|^@") & (s != ""))
    parts = F.transform(parts, lambda s: F.regexp_replace(s, r"^(\(\.{1,3}\))+", ""))
    parts = F.filter(parts, lambda s: ~s.isin("index", "page", "+page", "route", "+server"))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def endpoint(raw: Column) -> Column:
    """Normal form of an endpoint literal: quotes off, interpolations and concatenations as :name, doubled slashes once."""
    x = F.regexp_replace(F.trim(raw), r"^['\"`]|['\"`]$", "")
    x = F.regexp_replace(x, r"\.value\s*\}", "}")
    x = F.regexp_replace(x, r"\$\{\s*(?:[A-Za-z_$][\w$]*\s*\??\.\s*)*([A-Za-z_$][\w$]*)\s*\}", ":$1")
    x = F.regexp_replace(x, r"['\"`]\s*\+\s*(?:[A-Za-z_$][\w$]*\.)*([A-Za-z_$][\w$]*)(?:\s*\+\s*['\"`])?", ":$1")
    return F.regexp_replace(x, r"(?<!:)/{2,}", "/")


#: What a file of an app folder is, by its name without suffix.
APP_FILES = {"page": "page", "layout": "layout", "loading": "loading", "error": "error", "global-error": "error", "not-found": "not-found", "template": "template", "default": "default"}


def app_file_type(path: Column) -> Column:
    """page, layout, api and so on of a file of an app folder; null for others."""
    base = F.element_at(F.split(path, "/"), -1)
    name, suffix = F.regexp_extract(base, r"^(.*)(\.[^.]+)$", 1), F.regexp_extract(base, r"^(.*)(\.[^.]+)$", 2)
    kind = F.when((name == "route") & suffix.isin(".ts", ".js"), "api")
    for own, title in APP_FILES.items():
        kind = kind.when(name == own, title)
    return F.when(suffix.isin(".tsx", ".jsx", ".js", ".ts"), kind)


def name_rank(path: Column, identifier: str) -> Column:
    """1 for a file named like the identifier, 2 for an index file below a folder of its name, 3 for a path that holds it; null for others. ASCII case does not count."""
    low, name = F.concat(F.lit("/"), F.lower(path)), identifier.lower()
    quoted = "\\Q" + name + "\\E"
    return F.when(low.rlike(f"/{quoted}\\."), 1).when(low.rlike(f"/{quoted}/index\\."), 2).when(low.contains(name), 3)


def semver(version: Column) -> Column:
    """(major, minor, patch) of the first version number in a text; null without one."""
    part = lambda i: F.regexp_extract(version, r"(\d+)\.(\d+)(?:\.(\d+))?", i)
    number = lambda i: F.coalesce(F.try_to_number(part(i), F.lit("9999999999")).cast("long"), F.lit(0).cast("long"))
    return F.when(part(1) != "", F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch")))


def ancestors(path: Column) -> Column:
    """Every folder above a path, nearest first, the root as ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
