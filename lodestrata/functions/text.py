"""Scalar functions on text and queries, as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, within a character class.
BLANK = r"\s\p{Z}\x{85}"
# Abbreviations and what a query that has them is extended by, in this order.
SYNONYMS = {
    "auth": "authentication", "authn": "authentication", "authz": "authorization", "db": "database", "k8s": "kubernetes", "config": "configuration",
    "deps": "dependencies", "env": "environment", "impl": "implementation", "repo": "repository", "msg": "message", "req": "request",
    "res": "response", "err": "error", "fn": "function", "ctx": "context", "cb": "callback", "infra": "infrastructure",
}
# Words that begin a definition, and openings of import lines.
DEFINERS = ["class", "module", "def", "interface", "struct", "enum", "trait", "type", "func", "function", "fn", "fun", "object", "record", "protocol", "typedef", "namespace", "package"]
IMPORTERS = ["import ", "from ", "use ", "require(", "require_relative", "#include", "extern crate", "pub use ", "pub(crate) use ", "export {", "export *"]
# Weights of the lexical list.
ALPHA_SYMBOL, ALPHA_SYNONYM, ALPHA_OTHER = 0.1, 0.5, 0.6
# Rank of a kind of symbol among entry points.
KIND_PRIORITY = {"class": 5, "struct": 4, "trait": 4, "interface": 4, "function": 3, "method": 2, "const": 1}


def quoted(text: str) -> str:
    """A pattern for the text itself, for Java and RE2 alike."""
    return "".join(c if c.isalnum() or c in " _#/" else "\\" + c for c in text)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def lines(content: Column) -> Column:
    """Lines of a text: split at LF, one CR before it dropped, no empty line after a final LF."""
    parts = F.split(content, "\r?\n")
    return F.when(content == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")


def count_fast(text: Column) -> Column:
    """Tokens as a quarter of the bytes."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def tokens(text: Column) -> Column:
    """Identifier-like words, lower-cased, each followed by its snake or camel parts.

    The places where a word's case breaks are marked in the whole text at once, so that most words need no pattern.
    """
    marked = F.regexp_replace(F.translate(text, "\x01", " "), r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "\x01")
    found = F.regexp_extract_all(marked, F.lit("[a-zA-Z_][a-zA-Z0-9_\x01]*"), F.lit(0))

    def parts(w: Column) -> Column:
        whole = F.array(F.lower(F.translate(w, "\x01", "")))
        snake = F.filter(F.split(F.get(whole, F.lit(0)), "_"), lambda p: p != "")
        own = F.when(w.contains("_"), snake).otherwise(F.split(F.lower(w), "\x01"))
        return F.when(F.size(own) >= 2, F.concat(whole, own)).otherwise(whole)

    return F.flatten(F.transform(found, lambda w: F.when(w.rlike("[_\x01]"), parts(w)).otherwise(F.array(F.lower(w)))))


def split_identifier(word: Column) -> Column:
    """The word in lower case, and its parts if there are several: between underscores, else where a
    capital follows a small letter or begins a capitalised word after capitals."""
    broken = F.regexp_replace(F.regexp_replace(word, r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2"), r"(\p{Ll})(\p{Lu})", "$1 $2")
    snake = F.filter(F.split(word, "_"), lambda p: p != "")
    parts = F.transform(F.when(word.contains("_"), snake).otherwise(F.split(broken, " ")), F.lower)
    return F.when(F.size(parts) >= 2, F.concat(F.array(F.lower(word)), parts)).otherwise(F.array(F.lower(word)))


def is_symbol_query(q: Column) -> Column:
    """Scoped, underscored, or one word with an inner capital, a leading capital, or snake case."""
    t = strip(q)
    named = t.rlike(r"^.+\p{Lu}") | t.rlike(r"^\p{Lu}\p{Ll}") | (t.contains("_") & t.rlike(r"^[\p{L}\p{N}_]+$"))
    return t.contains("::") | (t.startswith("_") & (F.octet_length(t) > 1)) | (~t.rlike(f"[{BLANK}]") & named)


def detect_mode(q: Column, literal: bool = False, semantic: bool = False, structural: bool = False) -> Column:
    """How a query is answered; a forced mode wins, in this order."""
    for forced, mode in ((literal, "literal"), (semantic, "semantic"), (structural, "structural")):
        if forced:
            return F.lit(mode)
    return (
        F.when(q.contains("$"), "structural").when(is_symbol_query(q), "hybrid")
        .when((F.size(words(q)) < 3) | q.rlike(r"[\[({|\\]"), "literal").otherwise("hybrid")
    )


def expand_synonyms(q: Column) -> Column:
    """The query, and after it the long form of each abbreviation among its words."""
    own = F.transform(words(q), F.lower)
    out = [q]
    for short, full in SYNONYMS.items():
        out.append(F.when(F.array_contains(own, short), F.lit(" " + full)).otherwise(""))
    return F.concat(*out)


def resolve_alpha(q: Column, override: Column | None = None) -> Column:
    """The weight of dense ranks; an override is held within 0 and 1."""
    own = F.when(is_symbol_query(q), ALPHA_SYMBOL).when(expand_synonyms(q) != q, ALPHA_SYNONYM).otherwise(ALPHA_OTHER)
    return own if override is None else F.when(override.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), override))).otherwise(own)


def defines_symbol(text: Column, names: Column) -> Column:
    """A line of the text begins with a defining word and has one of the names, in any case."""
    opening = f"^({'|'.join(DEFINERS)})[ (]"
    heads = F.transform(F.filter(F.transform(lines(text), strip), lambda x: x.rlike(opening)), F.lower)
    return F.exists(heads, lambda x: F.exists(names, lambda n: x.contains(n)))


def mostly_imports(text: Column) -> Column:
    """Three lines or more that are not blank, over 60 % of them imports."""
    full = F.filter(F.transform(lines(text), strip), lambda x: x != "")
    found = F.filter(full, lambda x: x.rlike(f"^({'|'.join(map(quoted, IMPORTERS))})"))
    return (F.size(full) >= 3) & (F.size(found) / F.greatest(F.size(full), F.lit(1)) > 0.6)


def query_names(q: Column) -> Column:
    """Tokens of a query that are longer than two bytes."""
    return F.filter(tokens(q), lambda t: F.octet_length(t) > 2)


def query_stems(q: Column) -> Column:
    return F.transform(F.filter(words(q), lambda w: F.octet_length(w) > 2), F.lower)


def middle(text: Column, budget: Column | int) -> Column:
    """The middle of a text that is over budget tokens, in whole characters: of its characters as large a share as the budget has of its bytes."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    size, n = F.octet_length(text), F.char_length(text)
    keep = F.floor(n * (budget * 4) / F.greatest(size, F.lit(1))).cast("int")
    start = F.greatest(F.floor(n / 2).cast("int") - F.floor(keep / 2).cast("int"), F.lit(0))
    return F.when(size <= budget * 4, text).otherwise(F.substring(text, start + 1, keep))


def doc_block(text: Column, most: int = 400) -> Column:
    """struct(text, tokens, truncated): a text over ``most`` tokens is cut to as many, at a whole character."""
    # A prefix of 4 x most bytes may end within a character: what is then left of it decodes to U+FFFD.
    head = F.regexp_replace(F.make_valid_utf8(F.substring(text.cast("binary"), 1, 4 * most).cast("string")), "\\x{FFFD}+$", "")
    cut = count_fast(text) > most
    kept = F.when(cut, head).otherwise(text)
    return F.struct(kept.alias("text"), count_fast(kept).alias("tokens"), cut.alias("truncated"))


def first_doc_comment(content: Column) -> Column:
    """The block of //! and /// lines that opens a file, after blank lines and attributes; null if none."""
    ls = F.transform(lines(content), lambda x: F.regexp_replace(x, f"^[{BLANK}]+", ""))
    # What comes before is skipped, what is neither skipped nor a comment ends the block.
    shape = F.array_join(F.transform(ls, lambda x: F.when(x.rlike("^(//!|///)"), "d").when((x == "") | x.rlike(r"^#!?\["), "s").otherwise("x")), "")
    before, block = F.length(F.regexp_extract(shape, "^(s*)d", 1)), F.length(F.regexp_extract(shape, "^s*(d+)", 1))
    body = F.transform(F.slice(ls, before + 1, block), lambda x: strip(F.substring(x, 4, 1 << 30)))
    return F.when(block > 0, F.nullif(strip(F.array_join(body, "\n")), F.lit("")))


def kind_priority(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in KIND_PRIORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(0))


def byte_offset(content: Column, line: Column) -> Column:
    """Bytes before a 1-based line; null for line 0 and beyond the line after the last LF."""
    parts = F.split(content, "\n")
    before = F.aggregate(F.slice(parts, F.lit(1), F.greatest(line - 1, F.lit(0))), F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 1)
    return F.when((line >= 1) & (line <= F.size(parts)), before)


def page_token(skip: Column) -> Column:
    """What resumes a listing after ``skip`` rows."""
    return F.base64(skip.cast("string").cast("binary"))


def page_skip(token: Column) -> Column:
    """Rows to skip for a token; 0 if it is none."""
    return F.coalesce(F.try_validate_utf8(F.try_to_binary(token, F.lit("base64")).cast("string")).try_cast("int"), F.lit(0))


def summary_of_diff(files: Column, added: Column, deleted: Column, functions: Column) -> Column:
    n = F.size(functions)
    part = F.when(n == 0, "").when(n <= 3, F.concat(F.lit(". Functions: "), F.array_join(functions, ", "))).otherwise(F.concat(F.lit(". "), n, F.lit(" functions changed")))
    return F.concat(files, F.lit(" file(s) changed, +"), added, F.lit(" -"), deleted, part)
