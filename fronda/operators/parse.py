"""Extraction from source texts: one vectorised pass a file, then exploded tables.

Every extractor is a plain function of a text, so it is tested alone; `parsed`
runs them all over a scan in one Arrow pass.  Coordinates count from 1; columns
and offsets are in UTF-16 units.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDENT = r"[A-Za-z_$][\w$]*"


# ---------------------------------------------------------------- texts


_QUIET = re.compile(r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?|(?P<comment>(?<!:)//[^\n]*|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z))", re.S)
_VISIBLE = re.compile(r"[^\r\n]")


def blank_comments(text: str) -> str:
    """The text with script and markup comments as blanks; line breaks and strings stay."""
    return _QUIET.sub(lambda m: _VISIBLE.sub(" ", m[0]) if m["comment"] else m[0], text)


def utf16(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def position(text: str, offset: int) -> tuple[int, int]:
    """Line and column (UTF-16 units, from 1) of a character offset."""
    line = text.count("\n", 0, offset) + 1
    return line, utf16(text[text.rfind("\n", 0, offset) + 1 : offset]) + 1


def balanced(text: str, at: int) -> str:
    """The bracketed part that starts at `at`, brackets included; '' if it never closes."""
    pairs, depth, i, quote = {"(": ")", "{": "}", "[": "]", "<": ">"}, [], at, ""
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif c in "({[" or (c == "<" and not depth):
            depth.append(pairs[c])
        elif depth and c == depth[-1] and not (c == ">" and text[i - 1] == "="):
            depth.pop()
            if not depth:
                return text[at : i + 1]
        i += 1
    return ""


def split_top(text: str, by: str = ",;\n") -> list[str]:
    """Parts between separators that are not inside brackets or strings."""
    out, depth, quote, last = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "'\"`":
            quote = c
        elif c in "({[<":
            depth += 1
        elif c in ")}]" or (c == ">" and text[i - 1 : i] != "="):
            depth -= 1
        elif c in by and depth <= 0:
            out.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*out, text[last:]] if p.strip()]


def sections(path: str, text: str) -> list[dict]:
    """Blocks of a single-file component: kind, attributes, content and character span."""
    if path.endswith(".astro"):
        found = re.match(r"﻿?---[ \t]*\r?\n(.*?)(?:^---[ \t]*(?:\r?\n|\Z))", text, re.S | re.M)
        if found:
            return [{"kind": "frontmatter", "attributes": "", "start": found.start(1), "end": found.end(1)}, {"kind": "template", "attributes": "", "start": found.end(), "end": len(text)}]
        return [{"kind": "template", "attributes": "", "start": 0, "end": len(text)}]
    if not path.endswith((".vue", ".svelte")):
        return [{"kind": "script", "attributes": "", "start": 0, "end": len(text)}]
    out, spans = [], []
    for m in re.finditer(r"<(script|style)\b([^>]*)>(.*?)</\1\s*>", text, re.S):
        out.append({"kind": m[1], "attributes": m[2].strip(), "start": m.start(3), "end": m.end(3)})
        spans.append(m.span())
    if path.endswith(".vue"):
        m = re.search(r"<template\b([^>]*)>(.*)</template\s*>", text, re.S)
        if m:
            out.append({"kind": "template", "attributes": m[1].strip(), "start": m.start(2), "end": m.end(2)})
    else:
        at = 0
        for a, b in [*spans, (len(text), len(text))]:
            if text[at:a].strip():
                out.append({"kind": "template", "attributes": "", "start": at, "end": a})
            at = b
    return sorted(out, key=lambda s: s["start"])


def script_of(path: str, text: str) -> str:
    return "\n".join(text[s["start"] : s["end"]] for s in sections(path, text) if s["kind"] in ("script", "frontmatter"))


def _markup(path: str, text: str) -> list[dict]:
    return [s for s in sections(path, text) if s["kind"] == "template" or (s["kind"] == "script" and path.endswith((".tsx", ".jsx", ".js")))]


def markup_of(path: str, text: str) -> str:
    return "\n".join(text[s["start"] : s["end"]] for s in _markup(path, text))


def markup_in_place(path: str, text: str) -> str:
    """The markup where it stands in the text, blanks for the rest, so that places are those of the file."""
    out, at = [], 0
    for s in _markup(path, text):
        out += [re.sub(r"[^\r\n]", " ", text[at : s["start"]]), text[s["start"] : s["end"]]]
        at = s["end"]
    return "".join(out)


# ---------------------------------------------------------------- imports and tags


def imports(text: str) -> list[dict]:
    """Local name, exported name, source and whether it is loaded on demand; type-only imports are left out."""
    code, out, seen = blank_comments(text), [], set()

    def add(name: str, exported: str, source: str, dynamic: bool = False) -> None:
        if (name, exported, source) not in seen:
            seen.add((name, exported, source))
            out.append({"name": name, "exported": exported, "source": source, "is_dynamic": dynamic})

    for m in re.finditer(rf"\bimport\s+(?!type\b(?!\s*,|\s+from))((?:[\w$*\s{{}},]|\bas\b)+?)\s+from\s*(['\"])([^'\"]+)\2", code):
        clause, source = m[1].strip(), m[3]
        named = re.search(r"\{([^}]*)\}", clause)
        for part in named[1].split(",") if named else []:
            words = part.split()
            if words and words[0] != "type":
                add(words[-1], words[0], source)
        rest = re.sub(r"\{[^}]*\}", "", clause)
        for part in filter(None, (p.strip() for p in rest.split(","))):
            star = re.match(rf"\*\s+as\s+({IDENT})", part)
            add(star[1] if star else part, "*" if star else "default", source)
    for m in re.finditer(rf"(?:\b(?:const|let|var)\s+({IDENT})\s*=[^;\n]*?)?\bimport\s*\(\s*(['\"`])([^'\"`]+)\2\s*\)", code):
        add(m[1] or "", "default", m[3], True)
    return out


def exports(text: str) -> list[dict]:
    """Exported name, local name and source of a re-export ('' for own)."""
    code, out = blank_comments(text), []
    for m in re.finditer(rf"\bexport\s+(?:async\s+)?(?:default\s+)?(?:function\*?|const|let|var|class|interface|type|enum)\s+({IDENT})", code):
        out.append({"name": "default" if re.match(r"export\s+default", m[0]) else m[1], "local": m[1], "source": ""})
    for m in re.finditer(r"\bexport\s*\{([^}]*)\}(?:\s*from\s*['\"]([^'\"]+)['\"])?", code):
        for part in m[1].split(","):
            words = part.split()
            if words:
                out.append({"name": words[-1], "local": words[0], "source": m[2] or ""})
    for m in re.finditer(r"\bexport\s*\*\s*from\s*['\"]([^'\"]+)['\"]", code):
        out.append({"name": "*", "local": "*", "source": m[1]})
    return out


_TAG = re.compile(r"<([A-Z][\w.]*|[a-z][a-z0-9]*(?:-[\w-]+)+)((?:[^<>\"'`{}]|\"[^\"]*\"|'[^']*'|`[^`]*`|=>|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*)/?>")
_ATTRIBUTE = re.compile(r"(\{\s*\.\.\.\s*([^}]*)\}|[@:#]?[\w.:\-\[\]]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}))?")


def rendered(path: str, text: str) -> list[dict]:
    """Custom tags with the props each passes: name, expression and whether it is spread."""
    markup, out = blank_comments(markup_in_place(path, text)), []
    for m in _TAG.finditer(markup):
        props, seen = [], set()
        for a in _ATTRIBUTE.finditer(m[2]):
            spread = a[2] is not None or a[1] in ("v-bind",)
            name = "" if spread else re.sub(r"^(v-bind:|v-on:|v-model:|:|@|#)", "", a[1]).split(".")[0]
            value = (a[2] or "").strip() if a[2] is not None else (a[3] or "")[1:-1].strip() if a[3] else "true"
            if name not in seen or spread:
                seen.add(name)
                props.append({"prop": name, "expression": value, "is_spread": spread, "form": a[1] if not spread else "spread"})
        out.append({"tag": m[1], "line": position(markup, m.start())[0], "props": props})
    for m in re.finditer(r"\bcreateElement\(\s*([A-Z][\w.]*)", markup):
        out.append({"tag": m[1], "line": position(markup, m.start())[0], "props": []})
    for m in re.finditer(r":is=\"\s*'?([A-Z][\w]*)'?\s*\"", markup):
        out.append({"tag": m[1], "line": position(markup, m.start())[0], "props": []})
    return out


# ---------------------------------------------------------------- state, calls, contracts

_GETTER = re.compile(r"^(get|is|has|can|should|to|find|filter|map|includes|some|every|computed)([A-Z_]|$)")


def declared_state(path: str, text: str) -> list[dict]:
    """Exported state identifiers of files that may hold state: hooks, stores and contexts."""
    low = f"/{path.lower()}"
    own = low.rpartition("/")[2]
    likely = any(d in low for d in ("/composables/", "/hooks/", "/stores/", "/store/", "/utils/state", "/utils/composables")) or own.startswith("use") or own.endswith(("store.ts", "store.js"))
    if not likely or not own.endswith((".ts", ".js", ".vue", ".tsx", ".jsx")):
        return []
    base = re.sub(r"\.[^.]+$", "", path.rpartition("/")[2])
    found = list(dict.fromkeys(m for m in re.findall(rf"export\s+(?:async\s+)?(?:function|const)\s+({IDENT})", text) if m.startswith("use") or m.endswith(("Store", "Context")) or m == base))
    if not found and (base.startswith("use") or base.endswith("Store")):
        found = [base]
    kind = lambda n: "store" if n.endswith("Store") or "/stores/" in f"/{path.lower()}" else "context" if n.endswith("Context") else "composable"
    return [{"identifier": n, "kind": kind(n)} for n in found]


def state_uses(path: str, text: str) -> list[dict]:
    """Observations of state hooks line by line: watch, else write, else read; every dependency has at least one."""
    code = blank_comments(text)
    tracked: dict[str, dict] = {}
    for m in re.finditer(rf"(?:\b(?:const|let|var)\s+({IDENT}|\{{[^}}]*\}}|\[[^\]]*\])\s*=\s*)?(?:await\s+)?\b(use[A-Z]\w*|{IDENT}Store)\s*\(", code):
        kind = "store" if m[2].endswith("Store") else "context" if m[2].endswith("Context") else "composable"
        dep = tracked.setdefault(m[2], {"kind": kind, "instances": [], "reads": [], "actions": []})
        target = m[1] or ""
        if target[:1] in "{[" and target:
            for part in target[1:-1].split(","):
                name = part.split(":")[-1].split("=")[0].strip().lstrip(".")
                if re.fullmatch(IDENT, name):
                    dep["actions" if re.match(r"(set|add|remove|update|toggle|reset|clear|fetch|login|logout|dispatch|save|delete|create)([A-Z_]|$)", name) else "reads"].append(name)
        elif target:
            dep["instances"].append(target)
    out = []
    for number, line in enumerate(code.split("\n"), 1):
        if not line.strip() or re.match(r"\s*import\b", line):
            continue
        short = line.strip() if len(line.strip()) <= 80 else line.strip()[:77] + "..."
        for name, dep in tracked.items():
            mention = any(re.search(rf"\b{re.escape(v)}\b", line) for v in (name, *dep["instances"], *dep["reads"], *dep["actions"]))
            if not mention:
                continue
            mode, snippet = "read", short
            call = next((c for v in dep["instances"] for c in re.finditer(rf"\b{re.escape(v)}\.({IDENT})\s*\(", line) if not _GETTER.match(c[1])), None)
            chained = re.search(rf"\b{re.escape(name)}\s*\([^)]*\)\.({IDENT})\s*\(", line)
            changed = any(re.search(rf"\b{re.escape(v)}(?:\.[\w$]+)+\s*(?:\+\+|--|(?:[+\-*/%&|^?]{{0,2}})=(?![=>]))", line) for v in dep["instances"])
            model = re.search(r"v-model(?::[\w-]+)?(?:\.\w+)*=[\"']([^\"']+)[\"']", line)
            act = next((v for v in dep["actions"] if re.search(rf"\b{re.escape(v)}\s*\(", line) and not re.search(rf"\b{re.escape(name)}\s*\(", line)), None)
            bound = re.search(r"(?:@|v-on:)[\w:.-]+=[\"']([^\"'()]+)[\"']", line)
            if re.search(r"\bwatch(?:Effect|PostEffect)?\s*\(", line):
                mode = "watch"
            elif call:
                mode, snippet = "write", f"{call[0].split('.')[0].strip()}.{call[1]}()"
            elif changed:
                mode = "write"
            elif act:
                mode, snippet = "write", f"{act}()"
            elif chained and not _GETTER.match(chained[1]):
                mode, snippet = "write", f"{name}().{chained[1]}()"
            elif model and model[1].split(".")[0] in (*dep["instances"], *dep["reads"]):
                mode, snippet = "write", model[1]
            elif bound and (bound[1].split(".")[0] in dep["instances"] or bound[1] in dep["actions"]):
                mode, snippet = "write", bound[1].strip()
            properties = list(dict.fromkeys(p for v in dep["instances"] for p in re.findall(rf"\b{re.escape(v)}\.({IDENT})", line)))
            out.append({"kind": dep["kind"], "identifier": name, "access_mode": mode, "line_number": number, "usage_snippet": snippet, "accessed_properties": properties})
    for name, dep in tracked.items():
        if not any(o["identifier"] == name for o in out):
            out.append({"kind": dep["kind"], "identifier": name, "access_mode": "read", "line_number": 1, "usage_snippet": name, "accessed_properties": []})
    return out


_CONTEXT = re.compile(r"(?<![\w$.])(?:Vue\.|React\.)?(provide|inject|setContext|getContext|useContext)\s*(?:<[^()]*>)?\s*\(")


def contexts(path: str, text: str) -> list[dict]:
    """Keys that a component provides to those below it, or consumes: role, key, line; the key as it is written, quotes off.

    A key is the first argument of a call, or the name before `.Provider` of a tag.
    """
    code, out = blank_comments(text), []
    for s in sections(path, text):
        if s["kind"] in ("script", "frontmatter"):
            for m in _CONTEXT.finditer(code, s["start"], s["end"]):
                args = split_top(balanced(code, m.end() - 1)[1:-1], ",")
                if args and args[0].strip():
                    role = "provider" if m[1] in ("provide", "setContext") else "consumer"
                    out.append({"role": role, "key": args[0].strip().strip("'\"`"), "line": position(text, m.start())[0]})
    for t in rendered(path, text):
        if t["tag"].endswith(".Provider"):
            out.append({"role": "provider", "key": t["tag"].removesuffix(".Provider"), "line": t["line"]})
    return sorted(out, key=lambda c: c["line"])


_CALL = re.compile(r"(?<![\w$.])(?:(\$?fetch|useFetch|useLazyFetch|useSWR)|(axios|api|http|router|form|client)\.(get|post|put|patch|delete|head))\s*(?:<[^>()]*>)?\s*\(\s*(?:\(\)\s*=>\s*)?(\"[^\"]*\"|'[^']*'|`[^`]*`)")


def http_calls(text: str) -> list[dict]:
    """Outbound calls: client, method, literal endpoint as written, payload keys, place."""
    code, out = blank_comments(text), []
    for m in _CALL.finditer(code):
        whole = balanced(code, code.index("(", m.start()))
        method = (m[3] or "").upper()
        if not method:
            found = re.search(r"\bmethod\s*:\s*['\"](\w+)['\"]", whole)
            method = found[1].upper() if found else "GET"
        body = re.search(r"\bbody\s*:\s*(?:JSON\.stringify\(\s*)?\{([^{}]*)\}", whole) or (re.search(r",\s*\{([^{}]*)\}", whole) if m[2] else None)
        keys = [re.split(r"[:\s]", p, maxsplit=1)[0].strip("'\"") for p in split_top(body[1], ",")] if body else []
        line, column = position(code, m.start())
        out.append({"client": m[1] or m[2], "method": method, "endpoint": m[4], "payload": [k for k in keys if re.fullmatch(IDENT, k)], "line": line, "column": column})
    return out


def _typed(body: str) -> list[dict]:
    out = []
    for part in split_top(body.strip()[1:-1]):
        m = re.match(rf"(?:readonly\s+)?(?:['\"]([^'\"]+)['\"]|({IDENT}))(\?)?\s*:\s*(.+)", part, re.S)
        if m:
            out.append({"name": m[1] or m[2], "type": " ".join(m[4].split()), "required": not m[3]})
    return out


def _shape(code: str, name: str) -> str:
    """Body of a named interface or object type in the same text."""
    m = re.search(rf"\b(?:interface\s+{re.escape(name)}\b[^{{]*|type\s+{re.escape(name)}\s*=\s*)(?=\{{)", code)
    return balanced(code, m.end()) if m else ""


def contract(path: str, text: str) -> dict:
    """Props, emits, slots, models and exposed names of a component."""
    code, markup = blank_comments(script_of(path, text)), blank_comments(markup_of(path, text))
    props, emits, slots, models, exposed = [], [], [], [], []
    if path.endswith(".vue"):
        m = re.search(r"\bdefineProps\s*<", code)
        if m:
            inner = balanced(code, m.end() - 1)[1:-1].strip()
            props = _typed(inner if inner.startswith("{") else _shape(code, inner) or "{}")
        elif m := re.search(r"\bdefineProps\s*\(\s*([\[{])", code):
            body = balanced(code, m.end() - 1)
            if m[1] == "[":
                props = [{"name": n, "type": "any", "required": False} for n in re.findall(r"['\"]([^'\"]+)['\"]", body)]
            else:
                for part in split_top(body[1:-1], ","):
                    if p := re.match(rf"['\"]?({IDENT})['\"]?\s*:\s*(.*)", part, re.S):
                        kind = re.search(r"type\s*:\s*(\w+)", p[2]) or re.match(r"(\w+)", p[2])
                        props.append({"name": p[1], "type": kind[1] if kind else "any", "required": bool(re.search(r"required\s*:\s*true", p[2]))})
        m = re.search(r"\bdefineEmits\s*([<(])", code)
        if m:
            body = balanced(code, m.end() - 1)
            emits = list(dict.fromkeys(re.findall(r"\(\s*e(?:vent)?\s*:\s*['\"]([^'\"]+)['\"]", body) or ([p["name"] for p in _typed(body[1:-1].strip())] if "{" in body else []) or re.findall(r"['\"]([^'\"]+)['\"]", body)))
        for m in re.finditer(r"\bdefineModel\s*(?:<([^>]*)>)?\s*\(\s*(?:['\"]([^'\"]+)['\"])?", code):
            name = m[2] or "modelValue"
            models.append(name)
            emits.append(f"update:{name}")
            if name not in [p["name"] for p in props]:
                props.append({"name": name, "type": m[1] or "any", "required": False})
        if m := re.search(r"\bdefineExpose\s*\(\s*\{", code):
            exposed = [re.match(rf"({IDENT})", p)[1] for p in split_top(balanced(code, m.end() - 1)[1:-1], ",") if re.match(IDENT, p)]
        slots = list(dict.fromkeys((re.search(r"(?<![:\w-])name=['\"]([^'\"]+)['\"]", a) or ["", "default"])[1] for a in re.findall(r"<slot\b([^>]*)>", markup)))
    elif path.endswith(".svelte"):
        for m in re.finditer(rf"\bexport\s+let\s+({IDENT})\s*(?::\s*([^=;\n]+))?\s*(=)?", code):
            kind = (m[2] or "any").strip()
            props.append({"name": m[1], "type": kind, "required": not m[3] and "undefined" not in kind})
        if m := re.search(r"\b(?:let|const)\s+(\{.*?\})\s*(?::\s*(\{.*?\}|\w+))?\s*=\s*\$props\(", code, re.S):
            kinds = {p["name"]: p for p in _typed(m[2] if (m[2] or "").startswith("{") else _shape(code, m[2] or "") or "{}")}
            for part in split_top(m[1][1:-1], ","):
                name = re.match(rf"({IDENT})", part)
                if name:
                    own = kinds.get(name[1], {"type": "any", "required": "=" not in part})
                    props.append({"name": name[1], "type": own["type"], "required": own["required"] and "=" not in part})
                    if "$bindable" in part:
                        models.append(name[1])
        emits = list(dict.fromkeys(re.findall(r"\bdispatch\(\s*['\"]([^'\"]+)['\"]", code) + [p["name"] for p in props if re.match(r"on[A-Z]", p["name"])]))
        slots = list(dict.fromkeys([(re.search(r"name=['\"]([^'\"]+)['\"]", a) or ["", "default"])[1] for a in re.findall(r"<slot\b([^>]*)>", markup)] + ["default" if p["name"] == "children" else p["name"] for p in props if "Snippet" in p["type"]]))
    elif path.endswith(".astro"):
        props = _typed(_shape(code, "Props") or "{}")
        slots = list(dict.fromkeys((re.search(r"name=['\"]([^'\"]+)['\"]", a) or ["", "default"])[1] for a in re.findall(r"<slot\b([^>]*)>", markup)))
    else:
        m = re.search(rf"(?:function\s+[A-Z]\w*|const\s+[A-Z]\w*\s*(?::[^=]+)?=\s*(?:(?:React\.)?(?:memo|forwardRef)(?:<[^>]*>)?\()?(?:function\s*\w*)?)\s*\(\s*(\{{[^}}]*\}}|{IDENT})\s*:\s*(\w+|\{{)", code)
        if m:
            body = balanced(code, m.end() - 1) if m[2] == "{" else _shape(code, m[2])
            props = _typed(body or "{}")
        else:
            fc = re.search(r":\s*(?:React\.)?(?:FC|FunctionComponent)<\s*(\w+)\s*>", code)
            name = fc[1] if fc else next((n for n in re.findall(r"\b(?:interface|type)\s+(\w*Props)\b", code)), "")
            props = _typed(_shape(code, name) or "{}") if name else []
        emits = [p["name"] for p in props if re.match(r"on[A-Z]", p["name"])]
        slots = ["default"] if any(p["name"] == "children" for p in props) else []
        if m := re.search(r"useImperativeHandle\([^{]*?=>\s*\(?\s*\{", code):
            exposed = [re.match(rf"({IDENT})", p)[1] for p in split_top(balanced(code, m.end() - 1)[1:-1], ",") if re.match(IDENT, p)]
    return {"props": props, "emits": list(dict.fromkeys(emits)), "slots": slots, "models": models, "exposed": exposed}


def api_handlers(path: str, text: str) -> list[str]:
    """Exported HTTP verbs of a route module; ALL without any."""
    named = re.search(r"\.(get|post|put|patch|delete|head|options)\.[a-z]+$", path)
    if named:
        return [named[1].upper()]
    verbs = re.findall(r"\bexport\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b", blank_comments(text))
    return list(dict.fromkeys(verbs)) or ["ALL"]


def framework(path: str, text: str) -> str:
    """By extension, then by imports and directives, then by convention."""
    for end, name in ((".svelte", "svelte"), (".astro", "astro"), (".vue", "vue")):
        if path.endswith(end):
            return name
    sources = {i["source"] for i in imports(text)}
    has = lambda *names: any(s == n or s.startswith(n + "/") for s in sources for n in names)
    if has("solid-js"):
        return "solid"
    if has("next"):
        return "next"
    if has("#app", "#imports", "nuxt") or re.search(r"\bdefineNuxt\w+\(", text):
        return "nuxt"
    if has("react", "react-dom") or re.match(r"\s*['\"]use client['\"]", text):
        return "react"
    if has("vue"):
        base = path.rpartition("/")[2]
        return "vue-composable" if re.match(r"use[A-Z0-9_]", base) or "/composables/" in f"/{path}" else "vue"
    return "vue-composable" if "/composables/" in f"/{path}" else "react" if path.endswith((".tsx", ".jsx")) or "/hooks/" in f"/{path}" else "unknown"


PARSED = """path string, hash string, framework string, name string, line_count int,
    imports array<struct<name:string,exported:string,source:string,is_dynamic:boolean>>, exports array<struct<name:string,local:string,source:string>>,
    rendered array<struct<tag:string,line:int,props:array<struct<prop:string,expression:string,is_spread:boolean,form:string>>>>,
    declared array<struct<identifier:string,kind:string>>,
    state array<struct<kind:string,identifier:string,access_mode:string,line_number:int,usage_snippet:string,accessed_properties:array<string>>>,
    calls array<struct<client:string,method:string,endpoint:string,payload:array<string>,line:int,column:int>>,
    contract struct<props:array<struct<name:string,type:string,required:boolean>>,emits:array<string>,slots:array<string>,models:array<string>,exposed:array<string>>,
    handlers array<string>, contexts array<struct<role:string,key:string,line:int>>"""


def component_name(path: str) -> str:
    """Base name; for index and page files the folder's, in Pascal case."""
    parts = path.split("/")
    base = re.sub(r"\.[^.]+$", "", parts[-1])
    if base.lower() in ("index", "page", "+page", "layout", "+layout") and len(parts) > 1:
        base = re.sub(r"(?:^|[-_\s])(\w)", lambda m: m[1].upper(), re.sub(r"[\[\]().@]", "", parts[-2])) + ("Page" if "page" in base.lower() else "Layout" if "layout" in base.lower() else "")
    return base


def parsed(files: DataFrame) -> DataFrame:
    """One row a scanned file (path, hash, content) with everything extracted from it."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, digest, text in zip(pdf["path"], pdf["hash"], pdf["content"], strict=True):
                text = text or ""
                rows.append(
                    {
                        "path": path, "hash": digest, "framework": framework(path, text), "name": component_name(path), "line_count": len(re.split(r"\r\n|\r|\n", text)),
                        "imports": imports(script_of(path, text)), "exports": exports(script_of(path, text)), "rendered": rendered(path, text), "declared": declared_state(path, text),
                        "state": state_uses(path, text), "calls": http_calls(text), "contract": contract(path, text), "handlers": api_handlers(path, text), "contexts": contexts(path, text),
                    }
                )
            yield pd.DataFrame(rows, columns=["path", "hash", "framework", "name", "line_count", "imports", "exports", "rendered", "declared", "state", "calls", "contract", "handlers", "contexts"])

    return files.select("path", "hash", "content").mapInPandas(run, PARSED)


def table(rows: DataFrame, column: str) -> DataFrame:
    """One of the nested columns as rows beside their path."""
    return rows.select("path", F.explode(column).alias("r")).select("path", "r.*")
