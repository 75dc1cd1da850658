"""Path aliases of a workspace: compiler configs with their bases, and the names of its packages.

Works on configuration files as a mapping from workspace path to text; these are
few and are the only files that reach the driver.  An alias has ranked targets:
resolution takes the first that exists, so no file is looked for here.
"""

from __future__ import annotations

import json
import posixpath
from typing import NamedTuple

#: Compiler configs, and folders whose children are packages.
CONFIG_NAMES = ("jsconfig.json", "tsconfig.json")
PACKAGE_FOLDERS = ("packages", "apps", "libs", "modules", "shared")
DEFAULTS = {"@/": "src", "~/": ""}


class Alias(NamedTuple):
    folder: str  # files below it see the alias
    pattern: str  # with at most one *
    targets: tuple[str, ...]  # workspace paths, best first, with the same *


def parse_jsonc(text: str):
    """JSON with comments and trailing commas; None if it is none."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            i = n if (j := text.find("\n", i)) < 0 else j
        elif text.startswith("/*", i):
            i = n if (j := text.find("*/", i + 2)) < 0 else j + 2
        elif c == ",":
            rest = _after_blanks(text, i + 1)
            out.append("" if rest < n and text[rest] in "]}" else c)
            i += 1
        else:
            out.append(c)
            i += 1
    try:
        return json.loads("".join(out))
    except ValueError:
        return None


def _after_blanks(text: str, i: int) -> int:
    """The next place that is neither white space nor comment."""
    while i < len(text):
        if text[i].isspace():
            i += 1
        elif text.startswith("//", i):
            i = len(text) if (j := text.find("\n", i)) < 0 else j
        elif text.startswith("/*", i):
            i = len(text) if (j := text.find("*/", i + 2)) < 0 else j + 2
        else:
            break
    return i


def _join(folder: str, path: str) -> str:
    found = posixpath.normpath(posixpath.join("/", folder, path)).lstrip("/")
    return "" if found == "." else found


def _config_file(configs: dict[str, str], folder: str, name: str) -> str | None:
    """The config that a name in `extends` or `references` of a config in `folder` means."""
    bases = [_join(folder, name)]
    if not name.startswith((".", "/")):
        above = [folder]
        while above[-1]:
            above.append(posixpath.dirname(above[-1]))
        bases = [_join(a, f"node_modules/{name}") for a in above]
    for base in bases:
        for path in (base, f"{base}.json", *(_join(base, c) for c in reversed(CONFIG_NAMES))):
            if path in configs:
                return path
        package = parse_jsonc(configs.get(_join(base, "package.json"), "")) or {}
        if isinstance(package.get("tsconfig"), str) and (own := _join(base, package["tsconfig"])) in configs:
            return own
    return None


def config_chain(configs: dict[str, str], path: str) -> tuple[dict[str, tuple[str, ...]], list[str]]:
    """Aliases of a config, bases first and overridden by what extends them, and every config that has been read; circles are read once."""
    merged: dict[str, tuple[str, ...]] = {}
    seen: list[str] = []
    todo = [(path, False)]
    while todo:
        at, read = todo.pop()
        node = parse_jsonc(configs.get(at, ""))
        if not isinstance(node, dict):
            if not read and at not in seen:
                seen.append(at)
            continue
        folder = posixpath.dirname(at)
        if not read:
            if at in seen:
                continue
            seen.append(at)
            above = node.get("extends") or []
            names = [above] if isinstance(above, str) else list(above) if isinstance(above, list) else []
            names += [r["path"] for r in node.get("references") or [] if isinstance(r, dict) and isinstance(r.get("path"), str)]
            bases = [b for n in names if isinstance(n, str) and n.strip() and (b := _config_file(configs, folder, n.strip()))]
            todo.append((at, True))
            todo += [(b, False) for b in reversed(bases)]
            continue
        options = node.get("compilerOptions") or {}
        base = _join(folder, options["baseUrl"]) if isinstance(options.get("baseUrl"), str) else folder
        for pattern, targets in (options.get("paths") or {}).items():
            if isinstance(targets, list) and targets:
                merged[pattern] = tuple(_join(base, str(t)) for t in targets)
    return merged, seen


def compiler_aliases(configs: dict[str, str]) -> list[Alias]:
    """Aliases of every folder that has a config with paths; of two configs in a folder the first name with paths counts."""
    out = []
    for folder in sorted({posixpath.dirname(p) for p in configs if posixpath.basename(p) in CONFIG_NAMES}):
        for name in CONFIG_NAMES:
            own = _join(folder, name)
            found = config_chain(configs, own)[0] if own in configs else {}
            if found:
                out += [Alias(folder, pattern, targets) for pattern, targets in found.items()]
                break
    return out


def _entry(exports) -> str | None:
    """The file that an exports value names for an import."""
    if isinstance(exports, dict):
        exports = exports.get("import") or exports.get("default")
    return exports if isinstance(exports, str) else None


def package_aliases(configs: dict[str, str]) -> list[Alias]:
    """Names of the workspace's packages, their subpath exports and everything below them."""
    root = parse_jsonc(configs.get("package.json", "")) or {}
    spaces = root.get("workspaces") or []
    spaces = spaces.get("packages") or [] if isinstance(spaces, dict) else spaces
    listed = [s.strip("/") for s in spaces if isinstance(s, str) and "*" not in s]
    out = []
    for path in sorted(configs):
        folder, name = posixpath.split(path)
        if name != "package.json" or not (posixpath.dirname(folder) in PACKAGE_FOLDERS or folder in listed):
            continue
        package = parse_jsonc(configs[path])
        if not isinstance(package, dict) or not isinstance(package.get("name"), str):
            continue
        exports, title = package.get("exports"), package["name"]
        own = exports if isinstance(exports, str) else _entry(exports.get(".")) if isinstance(exports, dict) else None
        own = own or next((package[k] for k in ("source", "main", "module") if isinstance(package.get(k), str)), None)
        usual = ["src/index.ts", "src/index.tsx", "index.ts"]
        out.append(Alias("", title, tuple(_join(folder, f) for f in ([own, *usual[:2]] if own else usual))))
        for sub, target in exports.items() if isinstance(exports, dict) else ():
            if sub != "." and (file := _entry(target)):
                out.append(Alias("", f"{title}/{sub.removeprefix('.').lstrip('/')}", (_join(folder, file),)))
        out.append(Alias("", f"{title}/*", (_join(folder, "src/*"), _join(folder, "*"))))
    return out


def load(configs: dict[str, str]) -> list[Alias]:
    """All aliases: of compiler configs, of packages, and the usual ones of the frameworks."""
    usual = [Alias("", f"{k}*", (_join(v, "*"),)) for k, v in DEFAULTS.items()]
    return [*compiler_aliases(configs), *package_aliases(configs), *usual]


def targets(aliases: list[Alias], path: str, source: str) -> list[str]:
    """Workspace paths that `source`, imported in `path`, may mean: nearest folder first, exact names before patterns, longer patterns before shorter."""
    found = []
    for n, a in enumerate(aliases):
        if a.folder and not path.startswith(a.folder + "/"):
            continue
        before, star, after = a.pattern.partition("*")
        if not star and source == a.pattern:
            found.append(((-len(a.folder), 0, 0, n), a, ""))
        elif star and len(source) >= len(before) + len(after) and source.startswith(before) and source.endswith(after):
            found.append(((-len(a.folder), 1, -len(before), n), a, source[len(before) : len(source) - len(after)]))
    return list(dict.fromkeys(_join("", t.replace("*", rest)) for _, a, rest in sorted(found, key=lambda f: f[0]) for t in a.targets))
