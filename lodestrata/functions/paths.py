"""Scalar functions on paths, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import text as fn

# Languages by extension; the second table holds only where files are listed.
LANGUAGES = {
    "rust": ["rs"], "python": ["py", "pyi"], "javascript": ["js", "mjs", "cjs", "jsx"], "typescript": ["ts", "mts", "cts"], "tsx": ["tsx"], "go": ["go"], "java": ["java"],
    "c": ["c", "h"], "cpp": ["cpp", "cc", "cxx", "hpp", "hxx", "hh"], "ruby": ["rb"], "bash": ["sh", "bash", "zsh"], "json": ["json"], "html": ["html", "htm"], "css": ["css"],
    "kotlin": ["kt", "kts"], "swift": ["swift"], "csharp": ["cs"], "php": ["php"], "elixir": ["ex", "exs"], "yaml": ["yml", "yaml"], "toml": ["toml"], "markdown": ["md", "markdown"],
    "dockerfile": ["dockerfile"], "hcl": ["tf", "hcl"], "sql": ["sql"], "makefile": ["makefile", "mk"],
}
LISTED = {"erlang": ["erl", "hrl"], "haskell": ["hs"], "lua": ["lua"], "r": ["r", "R"], "scala": ["scala", "sc"], "zig": ["zig"]}
# File names and folders that ranking treats as tests, shims, samples and re-exports.
TEST = r"((^|/)test_[^/]*\.py$|_test\.(py|go|rs)$|\.test\.(ts|js|tsx|jsx)$|\.spec\.(ts|js)$|/(tests|test|__tests__|spec|testing)/)"
COMPAT = "/(compat|_compat|legacy)/"
EXAMPLES = "/(examples|example|docs_src)/"
REEXPORT = r"(^|/)(__init__\.py|package-info\.java)$"
# What a workspace takes for a test.
WORKSPACE_TEST = r"((^|/)tests/|__tests__/|(^|/)test_[^/]*$|(_test\.|\.test\.|\.spec\.)[^/]*$)"


def by_extension(*tables: dict[str, list[str]]) -> dict[str, str]:
    return {e: name for t in tables for name, es in t.items() for e in es}


def name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, unless that dot leads it; null if there is none."""
    n = name(path)
    return F.when(n.rlike(r"^.+\.[^.]*$") & (n != ".."), F.regexp_extract(n, r"^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    n = name(path)
    return F.when(n.rlike(r"^.+\.[^.]*$") & (n != ".."), F.regexp_extract(n, r"^(.+)\.[^.]*$", 1)).otherwise(n)


def folder(path: Column) -> Column:
    """The path before its last slash; empty if there is none."""
    return F.regexp_extract(path, "^(.*)/", 1)


def language(path: Column, listed: bool = False) -> Column:
    table = by_extension(LANGUAGES, LISTED) if listed else by_extension(LANGUAGES)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), extension(path))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def glob_matches(path: Column, pattern: str) -> Column:
    """``*.x`` asks for names that end in .x; anything else for names that have it, asterisks too."""
    return name(path).endswith(pattern[1:]) if pattern.startswith("*.") else name(path).contains(pattern)


def is_workspace_test(path: Column) -> Column:
    return path.rlike(WORKSPACE_TEST)


def under(path: Column, root: str) -> Column:
    """The path from root on, with forward slashes; null if it is not below root."""
    p, root = F.regexp_replace(path, r"\\", "/"), root.replace("\\", "/").rstrip("/")
    return F.when(p.startswith(root + "/"), F.substring(p, len(root) + 2, 1 << 30))


def penalty(path: Column) -> Column:
    """Product of the ranking penalties of a path."""
    p = F.regexp_replace(path, r"\\", "/")
    factors = [(p.rlike(TEST), 0.3), (p.rlike(COMPAT), 0.3), (p.rlike(EXAMPLES), 0.3), (p.rlike(REEXPORT), 0.5), (p.endswith(".d.ts"), 0.7)]
    out = F.lit(1.0)
    for holds, factor in factors:
        out = out * F.when(holds, F.lit(factor)).otherwise(1.0)
    return out


def enrich(content: Column, path: Column) -> Column:
    """A chunk's text with its language, path, stem and up to three folders, nearest first."""
    header = F.concat_ws(" ", F.concat(F.lit("["), language(path), F.lit("]")), path, F.array_join(fn.split_identifier(stem(path)), " "))
    near = F.slice(F.reverse(F.filter(F.split(folder(path), "/"), lambda d: d != "")), 1, 3)
    return F.concat(header, F.lit("\n"), content, F.lit(" "), stem(path), F.lit(" "), F.array_join(near, " "))


def path_parts(path: Column) -> Column:
    """Identifier parts of the stem and of the nearest folder."""
    near = name(folder(path))
    return F.concat(fn.split_identifier(stem(path)), F.when(near == "", F.array().cast("array<string>")).otherwise(fn.split_identifier(near)))


def normalize_import(raw: Column) -> Column:
    """An import as a path: separators become slashes, relative and crate prefixes go."""
    s = F.replace(raw, F.lit("::"), F.lit("/"))
    bare = F.regexp_replace(F.regexp_replace(s, r"^(\.\./)+", ""), r"^(\./)+", "")
    s = F.when(s.rlike(r"^\.\.?/"), bare).otherwise(F.replace(s, F.lit("."), F.lit("/")))
    return F.regexp_replace(s, "^(crate|self|super)/", "")


def without_extension(path: Column) -> Column:
    """Up to the last dot, if that is neither first nor followed by a slash."""
    return F.when(path.rlike(r"^.+\.[^./]*$"), F.regexp_extract(path, r"^(.+)\.[^./]*$", 1)).otherwise(path)


def suffixes(path: Column) -> Column:
    """All tails of the path without its extension, in whole components, longest first."""
    parts = F.split(without_extension(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading components two folders share."""
    same = F.array_join(F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.when(x.eqNullSafe(y), "1").otherwise("0")), "")
    return F.length(F.regexp_extract(same, "^(1*)", 1))
