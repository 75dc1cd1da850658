"""Structural search: patterns with placeholders over the tokens of a text, and the expressions and elements of templates.

`$X` stands for one operand or expression, `$$$` or `$$$X` for any run of tokens
within its brackets; the same name stands for the same tokens.  White space and
comments do not count.  There is no grammar behind it: precedence of operators
is not known, so `a + b` is also found in `a + b * c`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fronda.operators.parse import IDENT, markup_in_place, position, sections
from fronda.operators.search import has_keywords

CLOSERS = {"(": ")", "[": "]", "{": "}"}
STATEMENTS = ("const", "let", "var", "import", "export", "return", "throw")
RESERVED = ("if", "for", "while", "switch", "return", "catch", "function", "const", "let", "var", "export", "else", "throw", "case")
PREFIXES = ("!", "-", "+", "~", "...", "++", "--", "new", "await", "async", "typeof", "void", "delete")
OPERATORS = ("+", "-", "*", "/", "%", "**", "===", "!==", "==", "!=", "<", ">", "&&", "||", "??", "&", "|", "^", "=>", "?", ":")
_TOKEN = re.compile(
    r"(?P<blank>\s+|//[^\n]*|/\*.*?\*/|<!--.*?-->)|(?P<many>\$\$\$[A-Z_0-9]*)|(?P<one>\$[A-Z_][A-Z_0-9]*)(?![\w$])|(?P<text>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"
    r"|(?P<word>[\w$#@]+(?:-[A-Za-z]\w*(?=[-\s=>]))*)|(?P<sign>\.\.\.|===|!==|=>|\?\.|\?\?|&&|\|\||[=!]=|\+\+|--|\*\*|[+\-*/%]=|</|/>|.)",
    re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


_ELEMENT = re.compile(r"(<[A-Za-z/](?:\"[^\"]*\"|'[^']*'|[^\"'<>])*>)")


def tokens(text: str, pattern: bool = False, markup: bool = False) -> list[Token]:
    """Tokens without blanks and comments; placeholders only in patterns; in markup a quote between tags opens no string."""
    out = []
    if markup:
        text = "".join(p if i % 2 else re.sub("[\"'`]", "_", p) for i, p in enumerate(_ELEMENT.split(text)))
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind != "blank":
            out.append(Token("word" if kind in ("one", "many") and not pattern else kind, m[0], m.start(), m.end()))
    return out


def _partners(code: list[Token]) -> list[int]:
    """For each opening bracket the place after its closing one; 0 for others."""
    out, open_ = [0] * len(code), []
    for i, t in enumerate(code):
        if t.kind == "sign" and t.text in CLOSERS:
            open_.append(i)
        elif t.kind == "sign" and open_ and t.text == CLOSERS[code[open_[-1]].text]:
            out[open_.pop()] = i + 1
    return out


class Pattern:
    def __init__(self, text: str):
        self.markup = text.lstrip().startswith("<")
        self.parts = tokens(text.strip(), True, self.markup)
        if not self.parts or all(p.kind == "many" for p in self.parts):
            raise ValueError("a pattern needs a token of its own")
        if any(p.text in CLOSERS and not e for p, e in zip(self.parts, _partners(self.parts), strict=True)):
            raise ValueError(f"brackets of the pattern do not close: {text}")
        # runs that stand among the attributes of a tag
        self.in_tag, inside = set(), False
        for k, p in enumerate(self.parts):
            inside = p.text == "<" or (inside and p.text not in (">", "/>"))
            if self.markup and inside and p.kind == "many":
                self.in_tag.add(k)

    def keywords(self) -> list[str]:
        """Words that every text with a match holds."""
        return list(dict.fromkeys(p.text for p in self.parts if p.kind == "word"))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Character spans of the matches by start, nested ones included."""
        code = tokens(text, markup=self.markup)
        after, out, first = _partners(code), [], self.parts[0]
        for i, t in enumerate(code):
            if first.kind in ("word", "text", "sign") and t.text != first.text:
                continue
            if i and code[i - 1].text in (".", "?.") and first.kind in ("word", "one"):
                continue  # a name behind a dot is no operand of its own
            end = self._match(code, after, i, 0, {})
            if end is not None and end > i:
                if first.text in STATEMENTS and end < len(code) and code[end].text == ";":
                    end += 1
                out.append((t.start, code[end - 1].end))
        return out

    def _match(self, code: list[Token], after: list[int], i: int, k: int, bound: dict) -> int | None:
        while k < len(self.parts) and self.parts[k].kind not in ("one", "many"):
            if i >= len(code) or code[i].text != self.parts[k].text:
                return None
            i, k = i + 1, k + 1
        if k == len(self.parts):
            return i
        part = self.parts[k]
        name = part.text.lstrip("$")
        ends = list(_runs(code, after, i, k in self.in_tag)) if part.kind == "many" else _expressions(code, after, i, self.parts[k + 1].text if k + 1 < len(self.parts) else "")
        if part.kind == "many" and k == len(self.parts) - 1:
            ends = ends[-1:]  # a run at the end goes as far as it can
        for j in ends:
            words = tuple(t.text for t in code[i:j])
            if name and name != "_" and bound.get((part.kind, name), words) != words:
                continue
            end = self._match(code, after, j, k + 1, {**bound, (part.kind, name): words})
            if end is not None:
                return end
        return None


def _runs(code: list[Token], after: list[int], i: int, in_tag: bool = False):
    """Ends of runs from i, shortest first, up to the bracket that closes around them or, among attributes, the end of the tag."""
    yield i
    while i < len(code) and not (code[i].kind == "sign" and code[i].text in (("<", ">", "/>") if in_tag else ")]}")):
        i = after[i] or i + 1
        yield i


def _operand(code: list[Token], after: list[int], i: int) -> list[int]:
    """Ends of the operand at i, with ever more of its members, calls and indexes; none if no operand starts there."""
    while i < len(code) and (code[i].text in PREFIXES) and code[i].kind != "text":
        i += 1
    if i >= len(code) or code[i].text in RESERVED or (code[i].kind == "sign" and not after[i]):
        return []
    out = [after[i] or i + 1]
    while (j := out[-1]) < len(code):
        if code[j].text in (".", "?.") and j + 1 < len(code) and code[j + 1].kind == "word":
            out.append(j + 2)
        elif code[j].text in ("(", "[") and after[j]:
            out.append(after[j])
        else:
            break
    return out


def _expressions(code: list[Token], after: list[int], i: int, then: str) -> list[int]:
    """Ends of what one placeholder may stand for at i: operands joined by operators, the longest first; one bare operand before a dot or an opening bracket."""
    out = _operand(code, after, i)
    if then in (".", "?.", "(", "["):
        return out[::-1] if code[i : i + 1] and code[i].text not in PREFIXES else []
    while out and out[-1] < len(code) and code[out[-1]].kind == "sign" and code[out[-1]].text in OPERATORS:
        more = _operand(code, after, out[-1] + 1)
        if not more:
            break
        out += more
    return out[::-1]


def by_rule(rule: dict, text: str) -> list[tuple[int, int]]:
    """Spans that fulfil every clause of a rule: pattern, regex, any, all, not, inside, has."""
    known = {"pattern", "regex", "any", "all", "not", "inside", "has"}
    if not rule or set(rule) - known or not set(rule) & {"pattern", "any", "all"}:
        raise ValueError(f"a rule has a pattern, any or all, and clauses of {', '.join(sorted(known))}")
    sets = []
    if "pattern" in rule:
        sets.append(Pattern(rule["pattern"]).spans(text))
    if "any" in rule:
        sets.append([s for r in rule["any"] for s in by_rule(r, text)])
    sets += [by_rule(r, text) for r in rule.get("all", [])]
    found = sorted(set(sets[0]).intersection(*sets[1:]))
    if "regex" in rule:
        found = [s for s in found if re.search(rule["regex"], text[s[0] : s[1]])]
    if "not" in rule:
        out = set(by_rule(rule["not"], text))
        found = [s for s in found if s not in out]
    if "inside" in rule:
        around = by_rule(rule["inside"], text)
        found = [s for s in found if any(a <= s[0] and s[1] <= b and (a, b) != s for a, b in around)]
    if "has" in rule:
        within = by_rule(rule["has"], text)
        found = [s for s in found if any(s[0] <= a and b <= s[1] and (a, b) != s for a, b in within)]
    return found


# ---------------------------------------------------------------- templates


_DIRECTIVE = re.compile(r"(?<=[\s\"'])(v-[\w-]+(?::[\w.\-\[\]]+)?(?:\.\w+)*|[:@#][\w.:\-\[\]]+)\s*=\s*(\"[^\"]*\"|'[^']*')")


def template_expressions(path: str, text: str) -> list[dict]:
    """Expressions of a template with their places: kind, source, start and the names that a loop around the value binds."""
    markup, out = markup_in_place(path, text), []
    if path.endswith(".vue"):
        for m in re.finditer(r"\{\{(.*?)\}\}", markup, re.S):
            out.append({"kind": "interpolation", "start": m.start(1), "source": m[1], "bindings": []})
        for m in _DIRECTIVE.finditer(markup):
            start, source, bindings = m.start(2) + 1, m[2][1:-1], []
            loop = re.match(r"\s*\(?([^()]*?)\)?\s+(?:in|of)\s+", source) if m[1] == "v-for" else None
            if loop:
                bindings, start, source = re.findall(IDENT, loop[1]), start + loop.end(), source[loop.end() :]
            out.append({"kind": m[1], "start": start, "source": source, "bindings": bindings})
    elif path.endswith((".svelte", ".astro")):
        for m in re.finditer(r"\{(?![#:/@])((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}", markup):
            out.append({"kind": "expression", "start": m.start(1), "source": m[1], "bindings": []})
    return sorted(out, key=lambda e: e["start"])


def matches(path: str, text: str, find) -> list[dict]:
    """Matches of `find` (text to spans) in scripts and in template expressions, or in markup for tags, by their place in the file."""
    spans = []
    for s in sections(path, text):
        if s["kind"] in ("script", "frontmatter"):
            spans += [(a + s["start"], b + s["start"]) for a, b in find(text[s["start"] : s["end"]])]
    for e in template_expressions(path, text):
        spans += [(a + e["start"], b + e["start"]) for a, b in find(e["source"])]
    return _placed(text, spans)


def tag_matches(path: str, text: str, find) -> list[dict]:
    return _placed(text, find(markup_in_place(path, text)))


def _placed(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    out = []
    for a, b in sorted(set(spans)):
        (line, column), (end_line, end_column) = position(text, a), position(text, b)
        out.append({"line": line, "column": column, "end_line": end_line, "end_column": end_column, "text": text[a:b]})
    return out


FOUND = "path string, line int, column int, end_line int, end_column int, text string"


def find(files: DataFrame, pattern: str | None = None, rule: dict | None = None, limit: int | None = 200) -> DataFrame:
    """Places of a pattern or a rule in files (path, content), in order; files without the words of a pattern are not parsed."""
    if (pattern is None) == (rule is None):
        raise ValueError("either a pattern or a rule")
    if pattern is not None:
        files = files.filter(has_keywords(F.col("content"), Pattern(pattern).keywords()))
    else:
        by_rule(rule, "")
    spans = Pattern(pattern).spans if pattern is not None else lambda text: by_rule(rule, text)
    look = tag_matches if pattern is not None and pattern.lstrip().startswith("<") else matches

    def run(batches):
        for pdf in batches:
            rows = [{"path": p, **r} for p, t in zip(pdf["path"], pdf["content"], strict=True) for r in look(p, t or "", spans)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    out = files.select("path", "content").mapInPandas(run, FOUND)
    return out if limit is None else out.orderBy("path", "line", "column").limit(limit)
