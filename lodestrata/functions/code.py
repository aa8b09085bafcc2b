"""Structure of source files by bracket matching and patterns over text whose comments and strings are blanked.

Python goes through its own parser. Offsets are bytes: a file is read as Latin-1 of its UTF-8, so an index is a byte.
Files that a pattern can't read give less, never an error. Languages without an entry give nothing.
"""

from __future__ import annotations

import ast
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

_C, _H = r"//[^\n]*|/\*.*?(?:\*/|\Z)", r"(?<![^\s;(])#[^\n]*"
_DQ, _SQ, _BT = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'", r"`(?:\\.|[^`\\])*`"
#: Extension to (comments, strings); the first that matches at a place wins.
_MARKS: dict[str, tuple[str, str]] = {}
for _exts, _comments, _strings in (
    ("rs", _C, r'r(#*)".*?"\1|' + _DQ + r"|'(?:\\[^\n]{1,8}?|[^'\\\n])'"), ("go", _C, f"{_DQ}|{_BT}|{_SQ}"), ("js mjs cjs jsx ts mts cts tsx", _C, f"{_DQ}|{_SQ}|{_BT}"),
    ("java kt kts swift", _C, rf'""".*?"""|{_DQ}|{_SQ}'), ("c h cpp cc cxx hpp hxx hh cs css", _C, f"{_DQ}|{_SQ}"), ("php", f"{_C}|{_H}", f"{_DQ}|{_SQ}"),
    ("py pyi", "#[^\n]*", rf'""".*?(?:"""|\Z)|' + r"'''.*?(?:'''|\Z)|" + f"{_DQ}|{_SQ}"), ("rb sh bash zsh ex exs yml yaml toml dockerfile makefile mk", _H, f"{_DQ}|{_SQ}"),
    ("tf hcl", f"{_C}|{_H}", _DQ), ("html htm md markdown", "<!--.*?(?:-->|\\Z)", "(?!)"), ("sql", r"--[^\n]*|/\*.*?(?:\*/|\Z)", _SQ), ("json", "(?!)", _DQ),
):
    _MARKS |= dict.fromkeys(_exts.split(), (_comments, _strings))
#: Extensions that are chunked by structure.
BLOCKS = frozenset(e for e, (c, _) in _MARKS.items() if c.startswith(_C) or e in ("py", "pyi", "json", "tf", "hcl", "css"))
CONTAINERS = frozenset(["class", "struct", "trait", "interface", "module"])


def raw(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").decode("latin-1")


def cooked(text: str) -> str:
    return text.encode("latin-1").decode("utf-8", "replace")


@lru_cache(64)
def _marks(ext: str) -> re.Pattern | None:
    found = _MARKS.get(ext)
    return re.compile(f"(?P<comment>{found[0]})|(?P<string>{found[1].replace(chr(92) + '1', '(?P=hashes)').replace('(#*)', '(?P<hashes>#*)')})", re.S) if found else None


def blanked(src: str, ext: str, strings: bool = True) -> tuple[str, list[tuple[int, int]]]:
    """src with comments, and with strings what they hold, made blanks; and where the comments are."""
    marks, comments = _marks(ext), []
    if marks is None:
        return src, comments

    def fill(m: re.Match) -> str:
        text = m.group()
        if m.lastgroup == "comment" or m.group("comment") is not None:
            comments.append(m.span())
        elif not strings or len(text) < 2:
            return text
        else:
            return text[0] + re.sub(r"[^\n]", " ", text[1:-1]) + text[-1]
        return re.sub(r"[^\n]", " ", text)

    return marks.sub(fill, src), comments


def pairs(text: str, kinds: str = "{}") -> dict[int, int]:
    """Opening to closing bracket; those without a partner are left out."""
    opened, out = [], {}
    for m in re.finditer(f"[{re.escape(kinds)}]", text):
        if m.group() in kinds[::2]:
            opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.start()
    return out


@dataclass
class Symbol:
    kind: str
    name: str
    start: int
    end: int
    start_line: int = 0
    end_line: int = 0
    signature: str = ""
    parent: int = -1
    node: str = field(default="", repr=False)


_MOD = r"(?:(?:pub(?:\([^)]*\))?|async|unsafe|extern(?:\s+\"[^\"]*\")?|const)\s+)*"
_JMOD = r"(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|virtual|async|partial|readonly|data|inner|suspend|inline|synchronized|default|native|fileprivate|mutating|class(?=\s+func))\s+)*"
_TYPED = _JMOD + r"(?!(?:return|new|else|throw|case|await|yield)\b)[\w.<>\[\],?]+(?:\s*<[^;{}()]*>)?(?:\[\])*\s+(?P<n>\w+)\s*(?:<[^;{}()]*>)?\([^;{}()]*(?:\([^)]*\)[^;{}()]*)*\)\s*(?:throws\s[\w,.\s]+|where\s[^{;]+)?(?=[{;]|=>)"
#: Per language: kind, pattern with the name as group n and the start as group s (else the match), what it must be within
#: ("" anything, "class" directly in a container), and whether a body is needed.
_RULES: dict[str, list[tuple[str, str, str, bool]]] = {
    "rs": [("function", _MOD + r"\bfn\s+(?P<n>\w+)", "", True), *[(k, _MOD + rf"\b{k}\s+(?P<n>\w+)", "", False) for k in ("struct", "enum", "trait")], ("type", _MOD + r"\btype\s+(?P<n>\w+)[^;={]*(?==)", "", False), ("const", r"(?:pub(?:\([^)]*\))?\s+)?\bconst\s+(?P<n>\w+)\s*:", "", False), ("module", _MOD + r"\bmod\s+(?P<n>\w+)", "", False)],
    "js": [("function", r"(?:\basync\s+)?\bfunction\s*\*?\s*(?P<n>[\w$]+)", "", True), ("class", r"(?<!abstract )\bclass\s+(?P<n>[\w$]+)", "", True), ("function", r"\b(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=\n]+)?=\s*(?P<s>(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::[^=\n]+)?=>)", "", False), ("method", r"^[ \t]*(?P<s>(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?\s*(?P<n>(?!(?:if|for|while|switch|catch|function|return)\b)[\w$#]+)\s*(?:<[^(){}]*>)?\([^;{}]*\)\s*(?::[^{;]+)?)(?=\{)", "class", True)],
    "go": [("function", r"^func\s+(?P<n>\w+)", "", False), ("method", r"^func\s*\([^)]*\)\s*(?P<n>\w+)", "", False)],
    "java": [("class", _JMOD + r"\bclass\s+(?P<n>\w+)", "", True), ("interface", _JMOD + r"(?<!@)\binterface\s+(?P<n>\w+)", "", True), ("enum", _JMOD + r"\benum\s+(?P<n>\w+)", "", True), ("method", _TYPED, "class", False)],
    "kt": [("class", _JMOD + r"\b(?:class|interface)\s+(?P<n>\w+)", "", False), ("class", _JMOD + r"\bobject\s+(?P<n>\w+)", "", False), ("function", _JMOD + r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(?P<n>\w+)", "", False)],
    "swift": [("class", _JMOD + r"\b(?:class|struct|enum|actor|extension)\s+(?P<n>\w+)", "", True), ("interface", _JMOD + r"\bprotocol\s+(?P<n>\w+)", "", True), ("function", _JMOD + r"\bfunc\s+(?P<n>\w+)", "", True)],
    "cs": [("module", r"\bnamespace\s+(?P<n>[\w.]+)(?=\s*\{)", "", True), *[(k, _JMOD + rf"\b{k}\s+(?P<n>\w+)", "", True) for k in ("class", "struct", "interface", "enum")], ("method", _TYPED, "class", False)],
    "php": [*[(k, rf"(?:(?:abstract|final)\s+)*\b{k}\s+(?P<n>\w+)", "", True) for k in ("class", "interface", "trait", "enum")], ("method", r"(?:(?:public|private|protected|static|abstract|final)\s+)*\bfunction\s+&?(?P<n>\w+)", "class", False), ("function", r"\bfunction\s+&?(?P<n>\w+)", "", True)],
    "c": [("struct", r"\bstruct\s+(?P<n>\w+)", "", False), ("enum", r"\benum\s+(?:class\s+)?(?P<n>\w+)", "", False)],
    "sh": [("function", r"^[ \t]*(?P<s>(?:function\s+)?(?P<n>[\w:.-]+)\s*\(\))(?=\s*\{)|^[ \t]*(?P<s2>function\s+(?P<n2>[\w:.-]+))(?=\s*\{)", "", True)],
    "tf": [("module", r"^[ \t]*(?P<s>(?P<n>\w+)(?P<labels>(?:[ \t]+\"[^\"\n]*\")*))[ \t]*(?=\{)", "", True)],
}
_RULES["ts"] = [*_RULES["js"], ("interface", r"\binterface\s+(?P<n>\w+)", "", True), ("enum", r"(?:\bconst\s+)?\benum\s+(?P<n>\w+)", "", True), ("type", r"\btype\s+(?P<n>\w+)[^=;\n(]*(?==)", "", False)]
for _ext, _like in {"mjs": "js", "cjs": "js", "jsx": "js", "mts": "ts", "cts": "ts", "tsx": "ts", "kts": "kt", "h": "c", "cpp": "c", "cc": "c", "cxx": "c", "hpp": "c", "hxx": "c", "hh": "c", "bash": "sh", "zsh": "sh", "hcl": "tf"}.items():
    _RULES[_ext] = _RULES[_like]
#: Languages in which a declaration without a body ends with its line.
_LINED = frozenset("go kt kts swift sh bash zsh".split())
#: What the tree of a language calls a kind, where a span is described.
_NODES = {("rs", "function"): "function_item", ("rs", "struct"): "struct_item", ("rs", "enum"): "enum_item", ("rs", "trait"): "trait_item", ("py", "function"): "function_definition", ("py", "class"): "class_definition", ("sh", "function"): "function_definition", ("php", "function"): "function_definition", ("js", "method"): "method_definition", ("ts", "method"): "method_definition", ("c", "struct"): "struct_specifier", ("c", "enum"): "enum_specifier"}


class Source:
    """A file's text, its lines, and what is found in it."""

    def __init__(self, text: str, ext: str | None) -> None:
        self.text, self.ext = raw(text), ext or ""
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.text))]
        self.code, self.comments = blanked(self.text, self.ext)
        self.braces = pairs(self.code)
        self.lines = text.split("\n")

    def line_of(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def close(self, symbol: Symbol) -> Symbol:
        symbol.start_line, symbol.end_line = self.line_of(symbol.start), self.line_of(max(symbol.start, symbol.end - (self.ext not in ("mk", "makefile"))))
        symbol.signature = self.lines[symbol.start_line - 1].strip()
        symbol.name = cooked(symbol.name)
        return symbol

    def extent(self, at: int, body: bool) -> tuple[int, int] | None:
        """End of a declaration whose head ends at ``at``, and its opening brace (-1: none)."""
        depth = 0
        for m in re.finditer(r"[{;()\[\]\n]", self.code[at:]):
            c, i = m.group(), at + m.start()
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
                if depth < 0:
                    return None if body else (i, -1)
            elif depth > 0:
                continue
            elif c == "{":
                return (self.braces[i] + 1, i) if i in self.braces else None
            elif c == ";":
                return None if body else (i + 1, -1)
            elif self.ext in _LINED and not re.match(r"\s*[{:=]", self.code[i:]):
                return None if body else (i, -1)
        return None if body else (len(self.code), -1)

    def found(self) -> Iterator[tuple[Symbol, str, int]]:
        rules = _RULES.get(self.ext, [])
        for kind, pattern, within, body in rules:
            for m in re.finditer(pattern, self.text if self.ext in ("tf", "hcl") else self.code, re.M):
                groups = m.groupdict()
                name = groups.get("n") or groups.get("n2")
                start = next((m.start(g) for g in ("s", "s2") if groups.get(g)), m.start())
                start += len(m.group()) - len(m.group().lstrip()) if start == m.start() else 0
                if kind in ("struct", "enum") and _RULES["c"] is rules:
                    brace = re.match(r"\s*\{", self.code[m.end() :])
                    end = self.braces.get(m.end() + brace.end() - 1, m.end()) + 1 if brace else m.end()
                    yield Symbol(kind, name, start, end), within, -1
                    continue
                ended = self.extent(m.end(), body)
                if ended is None:
                    continue
                if self.ext in ("tf", "hcl"):
                    kind = "const" if name in ("variable", "output", "locals") else "module"
                    name = " ".join([name, *re.findall(r'"([^"]*)"', groups["labels"])])
                    yield Symbol(kind, name, start, ended[0]), within, ended[1]
                    kind = "module"
                    continue
                yield Symbol(kind, name, start, ended[0]), within, ended[1]

    def inner(self, at: int) -> int:
        """The innermost brace that is open at a place; -1: none."""
        return max((o for o, c in self.braces.items() if o < at <= c), default=-1)

    def symbols(self) -> list[Symbol]:
        """In order of place, outer before inner; ``parent`` is an index into the list. Only containers are looked into."""
        if self.ext in ("py", "pyi"):
            return self._python()
        if self.ext in ("rb", "ex", "exs"):
            return self._ended()
        if self.ext in ("mk", "makefile"):
            return self._rules()
        out, stack, bodies, taken = [], [], {}, set()
        for symbol, within, brace in sorted(self.found(), key=lambda f: (f[0].start, -f[0].end, f[1] == "")):
            while stack and out[stack[-1]].end <= symbol.start:
                stack.pop()
            if (symbol.start, symbol.name) in taken or (stack and out[stack[-1]].kind not in CONTAINERS):
                continue
            if within and not (stack and bodies[stack[-1]] == self.inner(symbol.start)):
                continue
            taken.add((symbol.start, symbol.name))
            symbol.parent = stack[-1] if stack else -1
            symbol.node = _NODES.get((self.ext, symbol.kind), f"{symbol.kind}_declaration")
            bodies[len(out)] = brace
            stack.append(len(out))
            out.append(self.close(symbol))
        return out

    def tree(self) -> ast.Module | None:
        try:
            return ast.parse(cooked(self.text))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None

    def place(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column

    def _python(self) -> list[Symbol]:
        out: list[Symbol] = []

        def visit(body: Iterable[ast.AST], parent: int) -> None:
            for node in body:
                kind = {"FunctionDef": "function", "AsyncFunctionDef": "function", "ClassDef": "class"}.get(type(node).__name__)
                if kind:
                    out.append(self.close(Symbol(kind, raw(node.name), self.place(node.lineno, node.col_offset), self.place(node.end_lineno, node.end_col_offset), parent=parent, node=_NODES["py", kind])))
                    if kind == "class":
                        visit(node.body, len(out) - 1)
                else:
                    visit([c for c in ast.iter_child_nodes(node) if isinstance(c, ast.stmt | ast.excepthandler | ast.match_case)], parent)

        tree = self.tree()
        if tree is not None:
            visit(tree.body, -1)
            return out
        # Not whole Python: heads by pattern, each as far as deeper lines go.
        for m in re.finditer(r"^([ \t]*)(async\s+def|def|class)\s+(\w+)", self.code, re.M):
            rest = re.search(rf"^(?![ \t]*$)(?!{m.group(1)}[ \t])", self.code[(e := self.code.find("\n", m.end()) + 1 or len(self.code)) :], re.M)
            end = e + rest.start() if rest else len(self.code)
            symbol = Symbol("class" if m.group(2) == "class" else "function", m.group(3), m.end(1), len(self.code[:end].rstrip()))
            outer = next((i for i in range(len(out) - 1, -1, -1) if out[i].start < symbol.start < out[i].end), -1)
            if outer < 0 or out[outer].kind == "class":
                symbol.parent, symbol.node = outer, _NODES["py", symbol.kind]
                out.append(self.close(symbol))
        return out

    def _ended(self) -> list[Symbol]:
        """Ruby modules, and Elixir modules and functions without arguments: from the head to the ``end`` of its indentation."""
        heads = {"rb": {"module": "module"}}.get(self.ext, {"defmodule": "module", "defprotocol": "interface", "def": "function", "defp": "function"})
        out: list[Symbol] = []
        for m in re.finditer(rf"^([ \t]*)({'|'.join(heads)})\s+([\w.:]+)(?=\s*(?:do\b|,|$))", self.code, re.M):
            end = re.compile(rf"^{m.group(1)}end\b", re.M).search(self.code, m.end())
            symbol = Symbol(heads[m.group(2)], m.group(3), m.end(1), end.end() if end else m.end())
            outer = next((i for i in range(len(out) - 1, -1, -1) if out[i].start < symbol.start < out[i].end), -1)
            if outer < 0 or out[outer].kind in CONTAINERS:
                symbol.parent = outer
                out.append(self.close(symbol))
        return out

    def _rules(self) -> list[Symbol]:
        out = []
        for m in re.finditer(r"^(?P<v>\w+)[ \t]*(?:[:?+]{0,2}=)[^\n]*|^(?P<r>[^\s:#=][^:=#\n]*):(?!=)[^\n]*(?:\n\t[^\n]*)*", self.code, re.M):
            name = m.group("v") or m.group("r")
            out.append(self.close(Symbol("const" if m.group("v") else "function", name.strip(), m.start(), m.end())))
        return out

    def spans(self, target: str) -> list[tuple[int, int, str, str | None]]:
        """(start, end, what, name) of everything that a line can be snapped to."""
        own = [(s.start, s.end, s.node, s.name, s.kind) for s in self._all()]
        functions = [o[:4] for o in own if o[4] in ("function", "method")]
        classes = [o[:4] for o in own if o[4] in ("class", "struct", "trait", "interface", "enum")]
        if target == "function":
            return functions
        if target == "class":
            return classes + [(m.start(), self.braces[m.end() - 1] + 1, "impl_item", None) for m in re.finditer(r"\bimpl\b[^;{}]*\{", self.code) if self.ext == "rs" and m.end() - 1 in self.braces]
        if self.ext in ("py", "pyi"):
            tree, more = self.tree(), []
            for node in ast.walk(tree) if tree else ():
                name = {"If": "if_statement", "For": "for_statement", "While": "while_statement"}.get(type(node).__name__)
                if name:
                    more.append((self.place(node.lineno, node.col_offset), self.place(node.end_lineno, node.end_col_offset), name, None))
                for body in (getattr(node, f, None) for f in ("body", "orelse", "finalbody")):
                    if isinstance(body, list) and body and not isinstance(node, ast.Module):
                        more.append((self.place(body[0].lineno, body[0].col_offset), self.place(body[-1].end_lineno, body[-1].end_col_offset), "block", None))
            return functions + classes + more
        heads = [(m.start(), self.extent(m.end(), True), f"{m.group(1)}_{'expression' if self.ext == 'rs' else 'statement'}") for m in re.finditer(r"\b(if|for|while|match|switch)\b", self.code)]
        return functions + [c for c in classes if c[2].startswith("class")] + [(o, c + 1, "block", None) for o, c in self.braces.items()] + [(a, e[0], n, None) for a, e, n in heads if e]

    def _all(self) -> list[Symbol]:
        """Symbols, those within functions too."""
        if self.ext in ("py", "pyi") and (tree := self.tree()):
            kinds = {"FunctionDef": "function", "AsyncFunctionDef": "function", "ClassDef": "class"}
            return [Symbol(kinds[type(n).__name__], n.name, self.place(n.lineno, n.col_offset), self.place(n.end_lineno, n.end_col_offset), node=_NODES["py", kinds[type(n).__name__]]) for n in ast.walk(tree) if type(n).__name__ in kinds]
        if self.ext in ("py", "pyi", "rb", "ex", "exs", "mk", "makefile"):
            return self.symbols()
        return [Symbol(s.kind, cooked(s.name), s.start, s.end, node=_NODES.get((self.ext, s.kind), f"{s.kind}_declaration")) for s, _, _ in self.found()]

    def snap(self, line: int, target: str) -> tuple[int, int, str, str | None] | None:
        """First and last line, kind and name of the narrowest structure that holds the start of a line."""
        if not 1 <= line <= len(self.starts):
            return None
        at = self.starts[line - 1]
        held = [s for s in self.spans(target) if s[0] <= at < s[1]]
        if not held:
            return None
        start, end, kind, name = min(held, key=lambda s: (s[1] - s[0], -s[0]))
        return self.line_of(start), self.line_of(max(start, end - 1)), kind, name


def symbols(text: str, ext: str | None) -> list[Symbol]:
    return Source(text, ext).symbols() if ext in _MARKS else []


_STRING = r"""['"`]([^'"`\n]*)['"`]"""
#: Patterns of imports; the first group that is set is the import.
_IMPORTS = {
    "rs": r"\buse\s+([^;]+?)\s*;|\bextern\s+crate\s+(\w+)|\bmod\s+(\w+)", "py": r"^[ \t]*from[ \t]+([.\w]+)[ \t]+import\b|^[ \t]*import[ \t]+([^\n;]+)",
    "js": rf"\bimport\s+(?:[\w*$\s{{}},]+?\s*from\s*)?{_STRING}|\bexport\s+[\w*$\s{{}},]+?\s*from\s*{_STRING}|\brequire\s*\(\s*{_STRING}|\bimport\s*\(\s*{_STRING}",
    "go": r'(?:^import\s+(?:[\w.]+\s+)?|^[ \t]+(?:[\w.]+[ \t]+)?)"([^"\n]+)"', "java": r"^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;", "c": r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]",
    "rb": rf"\brequire(?:_relative)?[ \t(]+{_STRING}", "sh": r"(?:^|[;&|])[ \t]*(?:source|\.)[ \t]+([^\s;&|]+)", "css": r"@import\s+(?:['\"]([^'\"]+)['\"]|(url\([^)]*\)))",
    "html": r"<(?:script|style|link)\b[^>]*?\b(?:src|href)\s*=\s*(?:\"([^\"]+)\"|'([^']+)'|([^\s>\"']+))", "kt": r"^[ \t]*import[ \t]+([\w.]+)", "swift": r"^[ \t]*(?:@\w+[ \t]+)?import[ \t]+(?:(?:class|struct|func|enum|protocol)[ \t]+)?([\w.]+)",
    "cs": r"^[ \t]*using\s+(?:static\s+)?([\w.]+)\s*;", "php": rf"^[ \t]*use\s+(?:function\s+|const\s+)?([\w\\]+)|\b(?:require|include)(?:_once)?[ \t(]+{_STRING}", "ex": r"^[ \t]*(?:import|alias|use|require)[ \t(]+([\w.]+)",
}
_LIKE = {"pyi": "py", **dict.fromkeys(["jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts"], "js"), **dict.fromkeys(["h", "cpp", "hpp", "cc", "hxx", "cxx", "hh"], "c"), "bash": "sh", "zsh": "sh", "htm": "html", "kts": "kt", "exs": "ex"}


def imports(text: str, ext: str | None) -> list[str]:
    """What a file imports, as written, in order."""
    kind = _LIKE.get(ext or "", ext or "")
    if kind not in _IMPORTS:
        return []
    code = blanked(text, ext, strings=False)[0]
    # What lies in a string is no import, though an import may be a string: it has to begin outside.
    outside, out = blanked(text, ext)[0], []
    for m in re.finditer(_IMPORTS[kind], code, re.M | (re.I if kind == "html" else 0)):
        head = re.match(r"\s*", m.group()).end() + m.start()
        if kind not in ("html", "go") and outside[head] != code[head]:
            continue
        if kind == "go" and not m.group().startswith("import") and not re.search(r"^import\s*\([^)]*\Z", code[: m.start()], re.M):
            continue
        found = next((g for g in m.groups() if g), "")
        if kind == "py" and m.group(2):
            out += [p.split()[0] for p in found.split(",") if p.split()]
        elif found:
            out.append(found)
    return out


def strip_comments(text: str, ext: str | None) -> str:
    """Without comments; then one empty line for each run of blank lines and none at either end."""
    src, at, out = raw(text), 0, []
    for a, b in blanked(src, ext or "")[1]:
        out.append(src[at:a])
        at = b
    kept: list[str] = []
    for line in cooked("".join([*out, src[at:]])).split("\n"):
        if line.strip() or (kept and kept[-1]):
            kept.append(line.removesuffix("\r") if line.strip() else "")
    return "\n".join(kept).removesuffix("\n") + "\n"


def syntax_error(text: str, ext: str | None) -> str | None:
    """What is wrong with a file, as far as that shows; null if nothing."""
    if ext not in _MARKS or ext in ("md", "markdown", "html", "htm"):
        return None
    if ext in ("py", "pyi"):
        ok = Source(text, ext).tree() is not None
    elif ext == "json":
        try:
            ok = json.loads(text) is not None or True
        except ValueError:
            ok = False
    else:
        code, opened, ok = blanked(raw(text), ext)[0], [], True
        for c in re.findall(r"[()\[\]{}]", code):
            if c in "([{":
                opened.append(c)
            elif not opened or opened.pop() + c not in ("()", "[]", "{}"):
                ok = False
        ok = ok and not opened
    return None if ok else "syntax error detected after edit"


def _items(code: str, start: int, end: int, braces: dict[int, int]) -> list[tuple[int, int]]:
    """Neighbouring statements of a region: each ends with a closing brace, a semicolon or a line."""
    out, at, i = [], start, start
    while i < end:
        c = code[i]
        if c == "{" and i in braces and braces[i] < end:
            i = braces[i]
            c = "}"
        i += 1
        if c in "};\n" and code[at:i].strip():
            out.append((at + len(code[at:i]) - len(code[at:i].lstrip()), at + len(code[at:i].rstrip())))
            at = i
    if code[at:end].strip():
        out.append((at + len(code[at:end]) - len(code[at:end].lstrip()), at + len(code[at:end].rstrip())))
    return out


def _runs(source: Source, parts: list[tuple[int, int]], target: int) -> Iterator[tuple[int, int]]:
    """Neighbours together up to the target; a larger part is cut into its own parts."""
    held: list[tuple[int, int]] = []
    for a, b in parts:
        if held and sum(y - x for x, y in held) + b - a > target or b - a > target:
            if held:
                yield held[0][0], held[-1][1]
            held = []
        if b - a <= target:
            held.append((a, b))
            continue
        brace = next((i for i in range(a, b) if i in source.braces and source.braces[i] < b), None)
        if brace is None:
            lines = [m.span() for m in re.finditer(r"[^\n]*\S[^\n]*", source.text[a:b])]
            if len(lines) < 2:
                yield a, b
            else:
                yield from _runs(source, [(a + x, a + y) for x, y in lines], target)
            continue
        close = source.braces[brace]
        inner = _items(source.code, brace + 1, close, source.braces)
        yield from _runs(source, [p for p in ((a, brace + 1), *inner, (close, b)) if p != (a, b)], target)
    if held:
        yield held[0][0], held[-1][1]


def boundaries(source: Source, target: int) -> list[tuple[int, int]]:
    """Chunks that cover the whole file, cut between neighbouring structures."""
    if source.ext in ("py", "pyi"):
        tree = source.tree()
        parts = [(min([source.place(n.lineno, n.col_offset), *[source.place(d.lineno, d.col_offset) - 1 for d in getattr(n, "decorator_list", [])]]), source.place(n.end_lineno, n.end_col_offset)) for n in tree.body] if tree else []
    else:
        parts = []
    found = list(_runs(source, parts or _items(source.code, 0, len(source.code), source.braces), target))
    merged: list[list[int]] = []
    for a, b in found:
        if merged and b - merged[-1][0] <= target:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    ends = [b for _, b in merged[:-1]] + [len(source.text)]
    return list(zip([0, *ends[:-1]], ends, strict=True))


def chunk_spans(text: str, ext: str | None, target: int, overlap: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(content, first line, last line, first byte, end) of each chunk; all but the first begin up to ``overlap`` bytes earlier, after a line's end."""
    source = Source(text, ext)
    spans = boundaries(source, target) if text else []
    for i, (a, b) in enumerate(spans):
        if i and overlap:
            back = max(a - overlap, spans[i - 1][0])
            while back < len(source.text) and "\x80" <= source.text[back] < "\xc0":
                back += 1
            k = bisect_right(source.starts, back)
            a = min(source.starts[k] if k < len(source.starts) else back, b)
        yield cooked(source.text[a:b]), bisect_left(source.starts[1:], a + 1) + 1, bisect_left(source.starts[1:], b + 1) + 1, a, b


_TOKEN = re.compile(r"\$\$\$\w*|\$[A-Z_]\w*|[A-Za-z_\u0080-\uffff$][\w\u0080-\uffff$]*|\d[\w.]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|::|->|=>|[=!<>]=|&&|\|\||\S")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


def _unit(tokens: list[str], i: int, j: int) -> Iterator[int]:
    """Ends of what a single variable may stand for from token i on: a token or bracket group, and what hangs on it."""
    at = i
    while at < j:
        if tokens[at] in _CLOSE or tokens[at] in (",", ";"):
            return
        if tokens[at] in _OPEN:
            depth = 0
            while at < j:
                depth += (tokens[at] in _OPEN) - (tokens[at] in _CLOSE)
                at += 1
                if not depth:
                    break
        else:
            at += 1
        yield at
        if at < j and tokens[at] in (".", "::"):
            at += 1
        elif not (at < j and tokens[at] in ("(", "[")):
            return


def _match(pattern: list[str], p: int, tokens: list[str], i: int, bound: dict[str, list[str]]) -> int | None:
    """End of the tokens that the pattern takes from i on; the shortest choice of a variable that works."""
    while p < len(pattern):
        want = pattern[p]
        if want.startswith("$$$"):
            at = i
            while True:
                end = _match(pattern, p + 1, tokens, at, bound)
                if end is not None:
                    return end
                if at >= len(tokens) or tokens[at] in _CLOSE:
                    return None
                if tokens[at] in _OPEN:
                    at = next(iter(_unit(tokens[: len(tokens)], at, len(tokens))), len(tokens))
                else:
                    at += 1
        if re.fullmatch(r"\$[A-Z_]\w*", want):
            for end in reversed(list(_unit(tokens, i, len(tokens)))):
                got = tokens[i:end]
                if want in bound and bound[want] != got:
                    continue
                whole = _match(pattern, p + 1, tokens, end, bound | ({} if want == "$_" else {want: got}))
                if whole is not None:
                    return whole
            return None
        if i >= len(tokens) or tokens[i] != want:
            return None
        p, i = p + 1, i + 1
    return i


def structural(text: str, ext: str | None, pattern: str) -> list[tuple[int, str, str]]:
    """(line, matched text, snippet from a line before to two after) wherever the pattern's tokens occur: ``$X`` stands for one
    expression, the same one each time, ``$$$`` for any run with whole brackets."""
    wanted = _TOKEN.findall(pattern)
    if not wanted or ext not in _MARKS:
        return []
    code = blanked(text, ext, strings=False)[0]
    found = list(_TOKEN.finditer(code))
    tokens, lines, out, until = [m.group() for m in found], text.split("\n"), [], 0
    for i, m in enumerate(found):
        if i < until or (not wanted[0].startswith("$") and tokens[i] != wanted[0]):
            continue
        end = _match(wanted, 0, tokens, i, {})
        if end is None or end == i:
            continue
        until = end
        line = text.count("\n", 0, m.start())
        out.append((line + 1, text[m.start() : found[end - 1].end()], "\n".join(lines[max(0, line - 1) : line + 3]).rstrip("\n")))
    return out


def compiles(pattern: str) -> bool:
    """Whether a pattern's brackets are whole."""
    opened = []
    for t in _TOKEN.findall(pattern):
        if t in _OPEN:
            opened.append(_OPEN[t])
        elif t in _CLOSE and (not opened or opened.pop() != t):
            return False
    return bool(pattern.strip()) and not opened


def line_diff(old: str, new: str) -> list[tuple[str, int, str]]:
    """("deletion" or "addition", 1-based line in its own version, the line) of a shortest edit, in order.

    Shared ends are set aside; between them the furthest reach of each diagonal is followed for growing numbers of edits.
    """
    a, b = old.splitlines(keepends=True), new.splitlines(keepends=True)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    names: dict[str, int] = {}
    x_, y_ = ([names.setdefault(t, len(names)) for t in s[head : len(s) - tail]] for s in (a, b))
    n, m, reach, trace = len(x_), len(y_), {1: 0}, []
    for d in range(n + m + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while x < n and x - k < m and x_[x] == y_[x - k]:
                x += 1
            reach[k] = x
        if reach.get(n - m, -1) >= n:
            break
    out, x, y = [], n, m
    for d in range(len(trace) - 1, 0, -1):
        k, before = x - y, trace[d]
        down = k == -d or (k != d and before[k - 1] < before[k + 1])
        px = before[k + 1 if down else k - 1]
        py = px - (k + 1 if down else k - 1)
        out.append(("addition", head + py + 1, b[head + py]) if down else ("deletion", head + px + 1, a[head + px]))
        x, y = px, py
    return [(t, i, s.rstrip()) for t, i, s in reversed(out)]
