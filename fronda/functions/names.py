"""Name forms as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of names that are written in capitals.
ACRONYMS = ("ui", "url", "svg", "xml", "html", "css", "api", "id", "json", "http", "sdk", "db", "io", "cta", "seo", "pdf", "qr", "ai")


def kebab(name: Column) -> Column:
    """Search form: an acronym ends before its last capital."""
    split = F.regexp_replace(F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z0-9])", "$1-$2"), r"([a-z0-9])([A-Z])", "$1-$2")
    return F.lower(split)


def kebab_attribute(name: Column) -> Column:
    """Patch form: camel splits and separators only, without the acronym rule."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1-$2"), r"[\s_]+", "-"))


def pascal(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "[-_]"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))), "")


def camel(name: Column) -> Column:
    p = pascal(name)
    return F.concat(F.lower(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))


def acronym(name: Column) -> Column:
    """Pascal form of a name in parts, known acronyms in capitals; '' for a name of one part."""
    parts = F.filter(F.split(name, "[-_]"), lambda x: x != "")
    form = lambda x: F.when(F.lower(x).isin(*ACRONYMS), F.upper(x)).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.length(x)))))
    return F.when(F.size(parts) > 1, F.array_join(F.transform(parts, form), "")).otherwise(F.lit(""))


def candidates(name: Column) -> Column:
    """The distinct forms under which a component may be written."""
    return F.filter(F.array_distinct(F.array(name, pascal(name), kebab(name), pascal(kebab(name)), acronym(name))), lambda x: x != "")


def tag_keys(tag: Column) -> Column:
    """Keys by which a tag meets a component: exact and kebab, whole and after the last dot."""
    last = F.element_at(F.split(tag, r"\."), -1)
    keys = [F.concat(F.lit(kind), form) for x in (tag, last) for kind, form in (("case:", F.lower(x)), ("kebab:", kebab(x)))]
    return F.array_distinct(F.array(*keys))


def matches(tag: Column, target: Column) -> Column:
    return (tag == target) | (F.lower(tag) == F.lower(target)) | (kebab(tag) == kebab(target))


def clean_identifier(name: Column) -> Column:
    """Without bind, event and model prefixes and modifiers."""
    return F.regexp_replace(F.regexp_replace(name, r"^(v-bind:|v-on:|v-model:|:|@|#)", ""), r"\..*$", "")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False)) if conditions else F.lit(True)
