"""Domain and layer of a source path as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder names of each layer.
FOLDERS = {
    "component": "components?|ui|sections?",
    "widget": "widgets?",
    "route-or-page": "pages?|app|routes?|views?",
    "reusable-logic": "composables?|hooks?",
    "state": "stores?|state|context|contexts?",
    "service": "services?|api|endpoints?|clients?|server",
    "layout": "layouts?",
    "middleware": "middleware",
    "plugin": "plugins?",
    "action": "actions?",
    "content": "content|contents?",
    "utility": "utils?|helpers?|lib|shared",
    "type": "types?|typings?|interfaces?|models?",
    "domain-module": "domains?|features?|modules?|entities?|processes?",
}

#: File names of each layer, first match wins.
FILES = (
    (r"^\+(page|error)", "route-or-page"),
    (r"^\+layout", "layout"),
    (r"^\+server", "service"),
    (r"^hooks\.(server|client)", "middleware"),
    (r"^(page|loading|error|not-found|template)\.[jt]sx?$", "route-or-page"),
    (r"^layout\.[jt]sx?$", "layout"),
    (r"^route\.[jt]sx?$", "service"),
    (r"^middleware\.[jt]sx?$", "middleware"),
    (r"^actions?\.[jt]sx?$", "action"),
    (r"(?i)layout.*\.(vue|astro|svelte)$", "layout"),
    (r"(?i)(view|page).*\.(vue|astro|svelte)$", "route-or-page"),
    (r"(?i)\.(vue|astro|svelte)$", "component"),
    (r"use[A-Z]", "reusable-logic"),
    (r"(?i)store|pinia", "state"),
    (r"(?i)service|client|api", "service"),
    (r"(?i)types?|models?", "type"),
    (r"(?i)\.(tsx|jsx)$", "component"),
)


def layer_of_folder(name: Column) -> Column:
    out = F.when(F.lit(False), "")
    for layer, pattern in FOLDERS.items():
        out = out.when(F.lower(name).rlike(f"^({pattern})$"), layer)
    return out.otherwise("unknown")


def is_fixture(file: Column) -> Column:
    return file.rlike(r"\.(test|spec|stories|mock)\.[A-Za-z]+$")


def layer_of_file(file: Column) -> Column:
    out = F.when(is_fixture(file), "unknown")
    for pattern, layer in FILES:
        out = out.when(file.rlike(pattern), layer)
    return out.otherwise("utility")


def domain(path: Column) -> Column:
    """Struct of package, domain, subdomain and layer of a path below the root."""
    parts = F.split(path, "/")
    file = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    at = lambda a, i: F.coalesce(F.get(a, F.lit(i)), F.lit(""))
    packaged = F.lower(at(folders, 0)).isin("apps", "packages", "libs") & (F.size(folders) >= 2)
    package = F.when(packaged, at(folders, 1))
    inner = F.when(packaged, F.slice(folders, F.lit(3), F.size(folders))).otherwise(folders)
    wrapped = F.when(at(inner, 0) == "src", 1).when((at(inner, 0) == "resources") & at(inner, 1).isin("js", "ts"), 2).otherwise(0)
    inner = F.slice(inner, wrapped + 1, F.size(inner) + 1)
    n = F.size(inner)
    module = F.lower(at(inner, 0)).isin("domains", "features", "modules", "entities", "widgets") & (n >= 2)
    shared = (F.lower(at(inner, 0)) == "shared") & (n >= 2)
    name = F.when(n == 0, "root").when(module, at(inner, 1)).when(shared, "shared").otherwise(at(inner, 0))
    sub = F.when(module & (n >= 4), at(inner, 3)).when(module, F.lit(None)).when(n >= 2, at(inner, 1))
    by_folder = F.when(n == 0, "unknown").when(module & (n >= 3), layer_of_folder(at(inner, 2))).when(shared, layer_of_folder(at(inner, 1))).otherwise(layer_of_folder(at(inner, 0)))
    by_file = layer_of_file(file)
    layer = F.when((by_folder == "unknown") | ~by_file.isin("unknown", "utility", "component"), by_file).otherwise(by_folder)
    return F.when(~is_fixture(file), F.struct(package.alias("package"), name.alias("domain"), sub.alias("subdomain"), layer.alias("layer")))
