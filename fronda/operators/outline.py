"""Finer questions about one source text: symbols, slices, event handlers, data dependencies, boundaries, layout."""

from __future__ import annotations

import hashlib
import re

from fronda.operators.parse import IDENT, balanced, blank_comments, imports, markup_in_place, position, script_of, sections, split_top

#: Client-only calls that a server component must not make.
CLIENT_CALLS = ("useState", "useEffect", "useReducer", "useRef", "useLayoutEffect", "useTransition", "useDeferredValue", "useActionState", "useOptimistic", "createContext", "useContext")

VERBS = ("get", "post", "put", "patch", "delete")

_SYMBOL = re.compile(
    rf"^[ \t]*(export\s+)?(default\s+)?(?:async\s+)?(?:(function)\*?\s+({IDENT})|(class)\s+({IDENT})|(interface)\s+({IDENT})|(type)\s+({IDENT})\s*(?:<[^=]*>)?\s*=|(enum)\s+({IDENT})|(const|let|var)\s+({IDENT})\s*(?::[^=\n]+)?=)",
    re.M,
)


def symbols(text: str) -> list[dict]:
    """Top-level declarations in order: name, kind, exported, lines and character span."""
    code, out = blank_comments(text), []
    for m in _SYMBOL.finditer(code):
        if code.count("{", 0, m.start()) - code.count("}", 0, m.start()) > 0:
            continue
        found = [(m[i], m[i + 1]) for i in (3, 5, 7, 9, 11, 13) if m[i]]
        kind, name = found[0]
        if kind in ("const", "let", "var"):
            kind = "function" if re.match(r"\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)", code[m.end() :]) else "variable"
        end = _end(code, m.end(), kind)
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        out.append({"name": name, "kind": kind, "exported": bool(m[1]), "start_line": position(code, start)[0], "end_line": position(code, max(start, end - 1))[0], "start": start, "end": end})
    return out


def _end(code: str, at: int, kind: str) -> int:
    """Where a declaration whose head ends at `at` ends."""
    i, quote = at, ""
    while i < len(code):
        c = code[i]
        if quote:
            quote = "" if c == quote and code[i - 1] != "\\" else quote
        elif c in "'\"`":
            quote = c
        elif c in "({[":
            body = balanced(code, i)
            if not body:
                return len(code)
            i += len(body)
            if c == "{" and kind in ("function", "class", "interface", "enum") and not code[i:].lstrip().startswith("=>"):
                return i
            continue
        elif c == ";":
            return i + 1
        elif c == "\n" and kind in ("variable", "type", "function") and not re.match(r"\s*(?:[.?:&|+]|=>)", code[i:]) and not re.search(r"(?:[=,(&|?:+]|=>)\s*$", code[at:i]):
            return i
        i += 1
    return len(code)


def slice_symbol(text: str, name: str, head: int = 10, tail: int = 5, most: int = 50) -> dict | None:
    """A symbol's source with the hash of its file; long ones are shortened for display only."""
    for s in symbols(text):
        if s["name"] == name:
            body = text[s["start"] : s["end"]]
            lines = body.split("\n")
            shown = lines if len(lines) <= most else [*lines[:head], f"… {len(lines) - head - tail} lines …", *lines[-tail:]]
            calls = [c for c in dict.fromkeys(re.findall(rf"(?<![\w$.])({IDENT})\s*\(", blank_comments(body))) if c not in ("if", "for", "while", "switch", "return", "function", "catch", name)]
            return {**s, "sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), "source": body, "shown": "\n".join(shown), "signature": body.split("{")[0].split("\n")[0].strip(), "calls": calls}
    return None


def event_handlers(path: str, text: str) -> list[dict]:
    """Template event bindings: event, expression, handler and whether it is inline, valid or broken."""
    script = blank_comments(script_of(path, text))
    known = set(re.findall(rf"\b(?:function|const|let|var)\s+({IDENT})", script)) | {i["name"] for i in imports(script)}
    for m in re.finditer(r"\b(?:const|let|var)\s*[\[{]([^\]}]*)[\]}]\s*=", script):
        known |= {re.split(r"[:=]", p)[-1].strip() if ":" in p else p.split("=")[0].strip() for p in m[1].split(",")}
    methods = re.search(r"\bmethods\s*:\s*\{", script)
    if methods:
        known |= set(re.findall(rf"^\s*(?:async\s+)?({IDENT})\s*\(", balanced(script, methods.end() - 1), re.M))
    out, markup = [], blank_comments(markup_in_place(path, text))
    for m in re.finditer(r"(?:@|v-on:)([\w:-]+)(?:\.[\w-]+)*=(\"[^\"]*\"|'[^']*')", markup):
        handler, inline = event_expression(m[2][1:-1])
        scoped = handler.startswith("$") or handler in ("emit", "props")
        out.append({"event": m[1], "expression": m[2][1:-1].strip(), "handler": handler, "line": position(markup, m.start())[0], "state": "inline" if inline else "valid" if handler in known or scoped else "broken" if handler else "empty"})
    return out


def event_expression(text: str) -> tuple[str, bool]:
    """Identifier that an event expression starts from, and whether it is an inline change."""
    text = text.strip()
    arrow = re.match(r"^(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>\s*", text)
    if arrow:
        return event_expression(text[arrow.end() :])
    first = re.match(rf"({IDENT})", text)
    if re.search(r"\+\+|--|(?<![=!<>])=(?![=>])", text):
        return (first[1] if first else text), True
    return (first[1] if first else text), False


def unused_functions(path: str, text: str) -> list[str]:
    """Functions of a component's script that are named nowhere else in it."""
    code = blank_comments(text)
    return [s["name"] for s in symbols(script_of(path, text)) if s["kind"] == "function" and not s["exported"] and len(re.findall(rf"(?<![\w$]){re.escape(s['name'])}(?![\w$])", code)) <= 1]


_CALLEE = re.compile(rf"{IDENT}(?:\s*\??\.\s*{IDENT})*")
_SPACE = re.compile(r"\s*")
_TYPES = re.compile(r"<[^()<>;]*(?:<[^()<>;]*>[^()<>;]*)*>")
_STRING = re.compile(r"(['\"`])((?:(?!\1).)*)\1", re.S)


def calls(text: str) -> list[tuple[str, list[str]]]:
    """(callee, arguments) of every call, outer before inner; type arguments and comments are passed over."""
    code, out = blank_comments(text), []
    for m in _CALLEE.finditer(code):
        at = _SPACE.match(code, m.end()).end()
        types = _TYPES.match(code, at)
        at = _SPACE.match(code, types.end()).end() if types else at
        if code.startswith("(", at) and (body := balanced(code, at)):
            out.append((re.sub(r"[\s?]", "", m[0]), split_top(body[1:-1], ",")))
    return out


#: Props whose union of literals counts as a set of variants, and members of a union that are no literals.
VARIANT_PROPS = ("variant", "size", "intent", "color")
NO_LITERALS = ("undefined", "null", "string", "boolean", "number", "any")


def _entries(literal: str) -> dict[str, str]:
    """Keys and source of the values of an object literal."""
    pairs = (re.match(rf"\s*(?:['\"]([^'\"]+)['\"]|({IDENT}))\s*:\s*(.*)", part, re.S) for part in split_top(literal.strip()[1:-1], ","))
    return {m[1] or m[2]: m[3].strip() for m in pairs if m}


def variants(text: str, props: list[dict]) -> dict | None:
    """Groups of variants with their options and defaults: of the first cva call, else of props that are unions of literals."""
    for callee, args in calls(text):
        if callee == "cva" and len(args) > 1 and args[1].strip().startswith("{"):
            config = _entries(args[1])
            groups = {g: list(_entries(body)) for g, body in _entries(config.get("variants", "{}")).items() if body.startswith("{")}
            groups = {g: options for g, options in groups.items() if options}
            if groups:
                return {"variants": groups, "defaults": {k: v.strip("'\"`") for k, v in _entries(config.get("defaultVariants", "{}")).items()}}
    unions = {p["name"]: [m for part in p["type"].split("|") if (m := part.strip().strip("'\"`")) and m not in NO_LITERALS] for p in props if p["name"] in VARIANT_PROPS and "|" in p["type"]}
    unions = {name: members for name, members in unions.items() if len(members) > 1}
    return {"variants": unions, "defaults": {}} if unions else None


def _string(args: list[str]) -> str | None:
    """The first argument, if it is one literal."""
    found = _STRING.fullmatch(args[0]) if args else None
    return found[2].strip() if found else None


def _field(args: list[str], name: str) -> str | None:
    """Text of a field of the object that is the first argument."""
    if args and args[0].startswith("{"):
        for part in split_top(args[0][1:-1], ",\n"):
            key, _, value = part.partition(":")
            if key.strip().strip("'\"") == name:
                return value.strip()
    return None


def _absolute(url: str, *more: str) -> bool:
    return url.startswith(("/", "http", *more))


def _query_call(call: str, args: list[str], out: dict[str, dict]) -> None:
    """Keys of the query libraries: a list, or the literal that names the request."""
    name = _string(args)
    if call == "useQuery":
        key = _field(args, "queryKey") or (args[0] if args else "")
        if key.startswith("["):
            out["query_keys"][" ".join(key.split())] = True
    elif name and call in ("useSWR", "useAsyncData", "useLazyAsyncData"):
        out["query_keys"][f'"{name}"'] = True
        if call == "useSWR" and _absolute(name):
            out["endpoints"][name] = True


def _request_call(path: list[str], args: list[str], out: dict[str, dict]) -> None:
    """Requests by literal address, and mutations by verb."""
    call, owner = path[-1], path[-2] if len(path) > 1 else ""
    address = _string(args)
    if call in ("useFetch", "useLazyFetch") and address is None and args:
        address = _string([re.sub(r"^\(\)\s*=>\s*", "", args[0])])
    reads = call in ("fetch", "$fetch", "useFetch", "useLazyFetch") or owner in ("axios", "api") and call in VERBS
    if reads and address and _absolute(address, "api/"):
        out["endpoints"][address] = True
    if owner and call in VERBS[1:]:
        route = _string(inner[0][1]) if args and (inner := calls(args[0])) and inner[0][0] == "route" and args[0].startswith("route") else None
        target = f"route('{route}')" if route else address
        if target:
            out["mutations"][f"{call.upper()} {target}"] = True
            if _absolute(target):
                out["endpoints"][target] = True
    if path[-2:] == ["router", "reload"] and (only := _field(args, "only")):
        for prop in split_top(only[1:-1], ","):
            out["mutations"]["RELOAD prop:" + prop.strip("'\"")] = True


def data_dependencies(text: str, framework: str = "") -> dict[str, list[str]]:
    """Server actions, query keys, endpoints and mutations that a text names, each in order of appearance."""
    code = blank_comments(text)
    out: dict[str, dict] = {"server_actions": {}, "query_keys": {}, "endpoints": {}, "mutations": {}}
    for i in imports(text):
        if i["exported"] not in ("default", "*") and any(part in i["source"] for part in ("actions", "server", "mutations")):
            out["server_actions"][i["exported"]] = True
    for head in re.finditer(rf"\basync\s+function\s+({IDENT})\s*(?=\()", code):
        at = _SPACE.match(code, head.end() + len(balanced(code, head.end()))).end()
        if code.startswith("{", at) and _STRING.match(code, _SPACE.match(code, at + 1).end()) and code[at + 1 :].lstrip()[1:].startswith("use server"):
            out["server_actions"][head[1]] = True
    server = framework == "next" or any(m[2] == "use server" for m in _STRING.finditer(code))
    for callee, args in calls(text):
        path = callee.split(".")
        if server and re.fullmatch(r"[a-z][\w$]*Action", path[-1]):
            out["server_actions"][path[-1]] = True
        _query_call(path[-1], args, out)
        _request_call(path, args, out)
    return {k: list(v) for k, v in out.items()}


def dynamic_imports(text: str) -> dict[str, list[str]]:
    """Glob patterns, components loaded on demand and components registered for a whole app."""
    code = blank_comments(text)
    return {
        "globs": list(dict.fromkeys(re.findall(r"import\.meta\.glob(?:Eager)?\s*(?:<[^>]*>)?\s*\(\s*['\"`]([^'\"`]+)['\"`]", code))),
        "lazy": list(dict.fromkeys(re.findall(r"\b(?:defineAsyncComponent|lazy|dynamic)\s*\(\s*(?:async\s*)?\(\)\s*=>\s*import\(\s*['\"`]([^'\"`]+)['\"`]", code))),
        "registered": list(dict.fromkeys(re.findall(r"\.component\s*\(\s*['\"]([\w-]+)['\"]", code))),
        "roots": list(dict.fromkeys(re.findall(rf"\bcreateApp\s*\(\s*({IDENT})", code))),
    }


def render_boundary(path: str, text: str, framework: str) -> dict:
    """Where a component is rendered, the directive that says so, and what breaks that rule."""
    lead = re.match(r"\s*(?:/\*[\s\S]*?\*/\s*|//[^\n]*\n\s*)*['\"]use (client|server)['\"]", text)
    if framework in ("react", "next"):
        if lead:
            return {"boundary": "client-component" if lead[1] == "client" else "server-action", "directive": f"use {lead[1]}", "hydrated": lead[1] == "client", "violations": []}
        if framework == "next" and ("/app/" in f"/{path}"):
            code = blank_comments(text)
            hooks = [h for h in CLIENT_CALLS if re.search(rf"(?<![\w$]){h}\s*(?:<[^>]*>)?\(", code)]
            events = list(dict.fromkeys(re.findall(r"<[a-z][\w]*\b[^<>]*?\s(on[A-Z]\w*)=", code)))
            broken = ([f"client-hook: {', '.join(hooks)}"] if hooks else []) + ([f"event-handler: {', '.join(events)}"] if events else [])
            return {"boundary": "server-component", "directive": "", "hydrated": False, "violations": broken}
        return {"boundary": "isomorphic", "directive": "", "hydrated": True, "violations": []}
    if framework == "astro":
        islands = re.findall(r"\bclient:(load|visible|idle|media|only)", text)
        return {"boundary": "island-host" if islands else "static", "directive": "|".join(f"client:{i}" for i in dict.fromkeys(islands)), "hydrated": bool(islands), "violations": []}
    if path.endswith((".client.vue", ".server.vue")):
        side = "client" if ".client." in path else "server"
        return {"boundary": f"{side}-component", "directive": "", "hydrated": side == "client", "violations": []}
    return {"boundary": "isomorphic", "directive": "", "hydrated": True, "violations": []}


def literal_config(text: str, call: str) -> dict:
    """Literal fields of an object passed to a macro; a spread or computed key, or a second call, leaves it unresolved."""
    code = blank_comments(text)
    found = list(re.finditer(rf"\b{re.escape(call)}\s*\(\s*\{{", code))
    if len(found) != 1:
        return {"fields": {}, "unresolved": [call] if found else []}
    fields, open_fields = {}, []
    for part in split_top(balanced(code, found[0].end() - 1)[1:-1], ",\n"):
        m = re.match(rf"(?:['\"]([^'\"]+)['\"]|({IDENT}))\s*:\s*(.+)$", part, re.S)
        if not m:
            fields, open_fields = {}, [*open_fields, part]
            continue
        value = m[3].strip()
        if re.fullmatch(r"'[^']*'|\"[^\"]*\"|-?\d+(?:\.\d+)?|true|false|null", value):
            fields[m[1] or m[2]] = value.strip("'\"")
        else:
            open_fields.append(m[1] or m[2])
    return {"fields": fields, "unresolved": open_fields}


def segment_config(text: str) -> dict[str, str]:
    """Literal route segment exports."""
    names = "runtime|preferredRegion|maxDuration|revalidate|dynamic|dynamicParams|fetchCache"
    return {m[1]: m[2].strip("'\"") for m in re.finditer(rf"\bexport\s+const\s+({names})\s*(?::[^=]+)?=\s*('[^']*'|\"[^\"]*\"|-?\d+|true|false)", blank_comments(text))}


#: Utility classes that count as layout.
LAYOUT_WORDS = (
    "flex", "inline-flex", "grid", "inline-grid", "block", "inline-block", "inline", "hidden", "contents", "table", "flow-root", "flex-col", "flex-row", "flex-wrap", "flex-nowrap", "flex-1",
    "flex-auto", "flex-initial", "flex-none", "grow", "grow-0", "shrink", "shrink-0", "static", "fixed", "absolute", "relative", "sticky", "container", "visible", "invisible", "collapse",
)
#: Families with a closed list of values, and families that take any value.
LAYOUT_CHOICES = {
    "items": "start end center baseline stretch", "justify": "normal start end center between around evenly stretch", "content": "normal start end center between around evenly baseline stretch",
    "self": "auto start end center stretch baseline",
}
LAYOUT_FAMILIES = (
    "basis", "grid-cols", "grid-rows", "col", "row", "gap", "order", "inset", "top", "bottom", "left", "right", "z", "w", "min-w", "max-w", "h", "min-h", "max-h", "size", "overflow",
    "p", "px", "py", "pt", "pb", "pl", "pr", "m", "mx", "my", "mt", "mb", "ml", "mr", "space-x", "space-y", "place-content", "place-items", "place-self",
)


def _is_layout(token: str) -> bool:
    variants, _, name = token.lower().rpartition(":")
    if variants and not re.fullmatch(r"[a-z0-9_-]+(?::[a-z0-9_-]+)*", variants):
        return False
    if name in LAYOUT_WORDS:
        return True
    family, _, value = name.partition("-")
    if family in LAYOUT_CHOICES:
        return value in LAYOUT_CHOICES[family].split()
    return any(name.startswith(f + "-") and re.fullmatch(r"[a-z0-9_\-]+" if f.startswith("place") else r"[a-z0-9_\-\[\]]+", name[len(f) + 1 :]) for f in LAYOUT_FAMILIES)


def layout_tokens(classes: str, most: int = 15) -> list[str]:
    """The first distinct layout classes of a class list."""
    return list(dict.fromkeys(t for t in classes.split() if _is_layout(t)))[:most]


def layout(path: str, text: str) -> dict:
    """Root element with its layout classes, conditional classes and visibility directives of a template."""
    markup = blank_comments(markup_in_place(path, text))
    root = re.search(r"<([A-Za-z][\w.-]*)\b([^>]*)>", markup)
    own = re.search(r"(?<![:\w])class(?:Name)?=[\"']([^\"']*)[\"']", root[2]) if root else None
    shown = [{"directive": m[1], "condition": (m[2] or "").strip("\"'"), "line": position(markup, m.start())[0]} for m in re.finditer(r"\b(v-show|v-if|v-else-if|v-else)\b(?:=(\"[^\"]*\"|'[^']*'))?", markup)]
    classes = []
    for m in re.finditer(r":class=(\"[^\"]*\"|'[^']*')", markup):
        body = m[1][1:-1].strip()
        if body.startswith("{"):
            for part in split_top(body[1:-1], ","):
                key, _, condition = part.partition(":")
                classes.append({"condition": condition.strip(), "tokens": key.strip().strip("'\"`").split()})
        elif t := re.match(r"(.+?)\?\s*(['\"`])(.*?)\2\s*:\s*(['\"`])(.*?)\4$", body):
            classes += [{"condition": t[1].strip(), "tokens": t[3].split()}, {"condition": f"!({t[1].strip()})", "tokens": t[5].split()}]
    return {"root": root[1] if root else "", "tokens": layout_tokens(own[1]) if own else [], "classes": classes, "visibility": shown}


def regions(path: str, text: str) -> list[dict]:
    """Flat region tree of a file: blocks, and the symbols inside scripts, with line spans and parent."""
    out = []
    for s in sections(path, text):
        body = text[s["start"] : s["end"]]
        own = {"id": len(out), "parent": None, "kind": s["kind"], "name": s["attributes"], "start_line": position(text, s["start"])[0], "end_line": position(text, s["end"])[0]}
        out.append(own)
        if s["kind"] in ("script", "frontmatter"):
            for y in symbols(body):
                out.append({"id": len(out), "parent": own["id"], "kind": y["kind"], "name": y["name"], "start_line": own["start_line"] + y["start_line"] - 1, "end_line": own["start_line"] + y["end_line"] - 1})
    return out


def remap(line: int, column: int, block_line: int, block_column: int) -> tuple[int, int]:
    """File coordinates of a place given in coordinates of a block."""
    return block_line + line - 1, column + block_column - 1 if line <= 1 else column
