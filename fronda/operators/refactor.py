"""Refactoring proposals: hash-bound patches for one prop, event, model or slot of a component."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fronda.functions import names
from fronda.operators.parse import _TAG, blank_comments, contract, position

KINDS = ("rename_prop", "add_prop", "remove_prop", "rename_event", "rename_model", "rename_slot", "rename_component")
_NAME = re.compile(r"(?P<lead>\s)(?P<form>v-bind:|v-on:|v-model:|v-slot:|:|@|#)?(?P<name>[\w$-]+)(?P<mods>(?:\.[\w-]+)*)(?P<value>\s*=\s*(?:\"[^\"]*\"|'[^']*'|\{(?:[^{}]|\{[^{}]*\})*\}))?")


def kebab(s: str) -> str:
    return re.sub(r"[\s_]+", "-", re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", s)).lower()


def like(old: str, written: str, new: str) -> str:
    """`new` in the form in which `old` was written."""
    return kebab(new) if "-" in written or (written == kebab(written) and old != written) else new


def same_name(a: str, b: str) -> bool:
    return kebab(a) == kebab(b)


def propose(text: str, component: str, kind: str, old: str, new: str = "") -> list[dict]:
    """Patches of a consumer's text (character offsets, half-open) and uses that must be looked at by hand.

    Spreads and bound arguments with computed names are reported, never changed.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    code, out = blank_comments(text), []
    digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def add(start: int, end: int, replacement: str, state: str = "ready") -> None:
        line, column = position(text, start)
        out.append({"start": start, "end": end, "line": line, "column": column, "old_snippet": text[start:end], "replacement": replacement, "sha256": digest, "state": state})

    for m in _TAG.finditer(code):
        tag = m[1].rpartition(".")[2]
        if not same_name(tag, component):
            continue
        begin, attributes = m.start(2), m[2]
        if kind == "rename_component":
            add(m.start(1), m.end(1), kebab(new) if "-" in tag else new)
            close = re.search(rf"</{re.escape(m[1])}\s*>", code[m.end() :])
            if close and not m[0].endswith("/>"):
                at = m.end() + close.start() + 2
                add(at, at + len(m[1]), kebab(new) if "-" in tag else new)
            continue
        if re.search(r"\{\s*\.\.\.|(?<![\w:])v-bind\s*=|[:@#]\[|v-\w+:\[", attributes):
            add(m.start(), m.start() + 1 + len(m[1]), "", "by-hand")
        hit = False
        for a in _NAME.finditer(" " + attributes):
            form, name = a["form"] or "", a["name"]
            start = begin - 1 + a.start("form" if form else "name")
            place, end = begin - 1 + a.start("name"), begin - 1 + a.end("name")
            if kind in ("rename_prop", "remove_prop", "add_prop") and form in ("", ":", "v-bind:") and same_name(name, old) and not name.startswith("v-"):
                hit = True
                if kind == "remove_prop":
                    add(start - 1, begin - 1 + a.end(), "")
                elif kind == "rename_prop":
                    short = form in (":", "v-bind:") and not a["value"]
                    put = like(old, name, new)
                    add(place, end, f'{put}="{name}"' if short else put)
            elif kind == "rename_event" and ((form in ("@", "v-on:") and same_name(name, old)) or (not form and name == "on" + old[:1].upper() + old[1:])):
                add(place, end, "on" + new[:1].upper() + new[1:] if not form else like(old, name, new))
            elif kind == "rename_model" and form == "v-model:" and same_name(name, old):
                add(place, end, like(old, name, new))
        if kind == "add_prop" and not hit:
            add(m.end(1), m.end(1), f" {new}")
        if kind == "rename_slot":
            tail = code[m.end() :]
            stop = re.search(rf"</{re.escape(m[1])}\s*>", tail)
            inner = tail[: stop.start()] if stop else ""
            for s in re.finditer(rf"<template\b[^>]*?\s(?:#|v-slot:)({re.escape(old)})(?![\w-])", inner):
                add(m.end() + s.start(1), m.end() + s.end(1), new)
    return sorted(out, key=lambda p: (p["start"], p["end"]))


def declarations(path: str, text: str, asked: list[tuple[str, str]]) -> list[dict]:
    """Where a component declares what each (kind, name) changes: kind, symbol, found and, if a line names it, its place bound to the text's hash."""
    known = contract(path, text)
    props = [p["name"] for p in known["props"]]
    by_kind = {"prop": props, "event": known["emits"], "model": [*known["models"], *props], "slot": known["slots"]}
    out, digest = [], hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    for change, name in asked:
        kind = change.rpartition("_")[2]
        symbol = next((n for n in by_kind.get(kind, []) if same_name(n, name)), None)
        row = {"change": change, "kind": kind, "symbol": symbol or name, "found": symbol is not None}
        place = re.search(rf"^.*\b(?:{'|'.join(re.escape(f) for f in dict.fromkeys((symbol, name, kebab(symbol))))})\b.*$", text, re.M) if symbol else None
        if place:
            start = place.end() - len(place[0].lstrip())
            end = place.start() + len(place[0].rstrip())
            row |= {"line": position(text, start)[0], "start": start, "end": end, "snippet": text[start:end], "sha256": digest}
        out.append(row)
    return out


def coverage(files: DataFrame, component: str) -> DataFrame:
    """One row: candidates (files that hold a form of the name), and how many of them are analyzed, failed (no text) and unsupported (no markup).

    A file without a text may hold the name, so it is a candidate.
    """
    forms = files.sparkSession.createDataFrame([(component,)], "n string").select(names.candidates(F.col("n"))).first()[0]
    named = F.lit(False)
    for f in {*forms, component}:
        named = named | F.col("content").contains(f)
    failed, readable = F.col("content").isNull(), F.col("path").rlike(r"\.(vue|svelte|astro|tsx|jsx|js)$")
    wanted = files.filter(failed | named)
    return wanted.agg(F.count("*").alias("candidates"), F.count_if(~failed & readable).alias("analyzed"), F.count_if(failed).alias("failed"), F.count_if(~failed & ~readable).alias("unsupported"))


PATCHES = "file string, start long, end long, line int, column int, old_snippet string, replacement string, sha256 string, state string"


def plan(files: DataFrame, component: str, kind: str, old: str, new: str = "") -> DataFrame:
    """Patches over all files of a scan that could render the component."""
    forms = files.sparkSession.createDataFrame([(component,)], "n string").select(names.candidates(F.col("n"))).first()[0]
    likely = F.lit(False)
    for f in {*forms, component}:
        likely = likely | F.col("content").contains("<" + f)

    def run(batches):
        for pdf in batches:
            rows = [{"file": p, **r} for p, t in zip(pdf["path"], pdf["content"], strict=True) for r in propose(t, component, kind, old, new)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PATCHES.split(", ")])

    return files.select("path", "content").filter(likely | F.col("content").rlike(r"<\w+\.")).mapInPandas(run, PATCHES)
