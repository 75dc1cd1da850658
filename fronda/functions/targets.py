"""Where a request may be served: names that a backend would use for an endpoint, as column expressions (a guess by naming alone)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that end in s and stay, and last parts of an endpoint that are actions of their own.
KEPT = ("checkout", "status", "news", "business", "process")
ACTIONS = (
    "checkout", "login", "logout", "register", "verify", "upload", "search", "export", "import", "cancel",
    "process", "sync", "approve", "reject", "activate", "deactivate", "archive", "restore", "publish", "submit",
)
#: Action of a method on a collection or, after the colon, on one row.
BY_METHOD = {"GET": "index:show", "POST": "store:store", "PUT": "update:update", "PATCH": "update:update", "DELETE": "destroy:destroy"}


def singular(word: Column) -> Column:
    low, n = F.lower(word), F.length(word)
    cut = lambda k: word.substr(F.lit(1), n - k)
    return (
        F.when(low.isin(*KEPT), word)
        .when(low.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(low.rlike("(x|sh|ch)es$"), cut(2))
        .when(low.rlike("[^s]s$") & (n > 2), cut(1))
        .otherwise(word)
    )


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), word.substr(F.lit(2), F.length(word)))


def _let(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _names(word: Column) -> Column:
    """An entity as written and in Pascal form; nulls for null."""
    form = lambda one: F.struct(_capital(one).alias("written"), F.array_join(F.transform(F.filter(F.split(one, r"[-_.\s]+"), lambda p: p != ""), _capital), "").alias("pascal"))
    return _let(singular(word), form)


def _symbols(entity: Column, action: Column, endings: tuple[str, ...]) -> list[Column]:
    out = []
    for e in endings:
        out.append(F.concat(entity, F.lit(e)))
        if e == "Controller":
            out.append(F.concat(entity, F.lit("Controller@"), action))
    return out


def backend_target(method: Column, endpoint: Column) -> Column:
    """Struct of intent, pattern, route name (null for paths) and likely symbols of a request, best first."""
    verb = F.upper(F.coalesce(F.nullif(F.trim(method), F.lit("")), F.lit("GET")))
    raw = F.trim(endpoint)
    written = F.regexp_extract(raw, r"^(?:route\s*\(\s*)?['\"]?([A-Za-z0-9_.-]+)['\"]?\s*\)?$", 1)
    path = F.regexp_replace(F.element_at(F.split(F.regexp_replace(raw, r"(?i)^https?://[^/]+", ""), r"\?"), 1), r"^/+|/+$", "")
    read = F.struct(verb.alias("verb"), raw.alias("raw"), F.when(written.contains(".") & ~raw.startswith("http"), written).alias("route"), path.alias("path"))
    return _let(read, lambda r: _let(_resource(r), lambda q: _target(r, q)))


def _resource(r: Column) -> Column:
    """The resource of a request, the one above an action, and the action."""
    is_value = lambda p: p.startswith(":") | p.startswith("{")

    def of_path(parts: Column) -> Column:
        resources = F.filter(parts, lambda p: ~is_value(p))
        name = F.coalesce(F.try_element_at(resources, F.lit(-1)), F.lit("Default"))
        acts = F.lower(name).isin(*ACTIONS)
        one_row = F.coalesce(is_value(F.try_element_at(parts, F.lit(-1))), F.lit(False))
        action = F.lit("handle")
        for method, pair in BY_METHOD.items():
            many, one = pair.split(":")
            action = F.when(r["verb"] == method, F.when(one_row, one).otherwise(many)).otherwise(action)
        return F.struct(name.alias("name"), F.when(acts, F.try_element_at(resources, F.lit(-2))).alias("above"), F.when(acts, F.lower(name)).otherwise(action).alias("action"))

    parts = F.filter(F.split(F.regexp_replace(r["path"], r"(?i)^api/(v[0-9]+/)?", ""), "/"), lambda p: p != "")
    of_name = F.struct(F.element_at(F.split(r["route"], r"\."), 1).alias("name"), F.lit(None).cast("string").alias("above"), F.element_at(F.split(r["route"], r"\."), -1).alias("action"))
    return F.when(r["route"].isNotNull(), of_name).otherwise(_let(parts, of_path))


def _target(r: Column, q: Column) -> Column:
    def named(n: Column) -> Column:
        other, parent = n["own"]["pascal"] != "", n["above"]["pascal"] != n["own"]["pascal"]
        symbols = _symbols(n["own"]["written"], q["action"], ("Controller", "Action", "Service"))
        symbols += [F.when(other, s) for s in _symbols(n["own"]["pascal"], q["action"], ("Controller", "Action", "Service"))]
        symbols += [F.when(parent, s) for s in _symbols(n["above"]["pascal"], q["action"], ("Controller", "Service", "Handler"))]
        symbols.append(F.concat(F.when(other, n["own"]["pascal"]).otherwise(n["own"]["written"]), F.lit("Handler")))
        return F.array_distinct(F.filter(F.array(*symbols), lambda s: s.isNotNull()))

    pattern = F.coalesce(r["route"], F.when(r["path"] != "", r["path"]), r["raw"])
    names = F.struct(_names(q["name"]).alias("own"), _names(q["above"]).alias("above"))
    return F.struct(F.concat(r["verb"], F.lit(" "), pattern).alias("intent"), pattern.alias("pattern"), r["route"].alias("route_name"), _let(names, named).alias("symbols"))
