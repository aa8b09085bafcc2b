"""Operators on source files: symbols, imports, references, structural matches, stripping and snapping.

Whole files go through Arrow batches once; what they give are flat rows. Other columns of files stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import code, paths
from lodestrata.functions import text as fn
from lodestrata.operators import lines

_SYMBOL = "array<struct<symbol:int,parent:int,depth:int,name:string,kind:string,start_line:int,end_line:int,signature:string>>"


def _each(f: Callable, schema: str, *columns: Column) -> Column:
    """f of the columns' values, row by row within Arrow batches; nulls give null."""

    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*batch, strict=True)], dtype=object)

    return run(*columns)


def _extension(path: Column) -> Column:
    return F.coalesce(paths.extension(path), F.lit(""))


def symbol_list(content: Column, path: Column) -> Column:
    """The file's symbols in order, outer before inner, with their place in the list and their parent's (-1: none)."""

    def run(text: str, ext: str) -> list[tuple]:
        found, depth = code.symbols(text, ext), {-1: -1}
        for i, s in enumerate(found):
            depth[i] = depth[s.parent] + 1
        return [(i, s.parent, depth[i], s.name, s.kind, s.start_line, s.end_line, s.signature) for i, s in enumerate(found)]

    return _each(run, _SYMBOL, content, _extension(path))


def symbols(files: DataFrame, kind: str | None = None) -> DataFrame:
    """file_id, path, symbol, parent, depth, name, kind, start_line, end_line, signature: flat rows; files without a symbol have none."""
    rows = files.select("file_id", "path", F.explode(symbol_list(F.col("content"), F.col("path"))).alias("s")).select("file_id", "path", "s.*")
    return rows if kind is None else rows.where(F.col("kind") == kind)


def imports(files: DataFrame) -> DataFrame:
    """file_id, path, position, raw: what each file imports, as written."""
    found = _each(lambda text, ext: code.imports(text, ext), "array<string>", F.col("content"), _extension(F.col("path")))
    return files.select("file_id", "path", F.posexplode(found).alias("position", "raw"))


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, position, href of every quoted link of pages(page_id, html). An addition: imports of HTML read no anchors."""
    found = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("position", "href"))


def references(symbols_: DataFrame, chunks: DataFrame, least: int = 3) -> DataFrame:
    """(name, ref_count): chunks whose words have the name; names under ``least`` bytes are left out.

    Each chunk gives its distinct words once; they meet the names before they are counted, so only
    words that are names are shuffled on.
    """
    names = symbols_.where(F.octet_length("name") >= least).select("name").distinct()
    words = chunks.select(F.explode(F.array_distinct(F.split("content", r"[^\p{L}\p{N}_]"))).alias("name"))
    counted = words.join(names, "name").groupBy("name").agg(F.count("*").alias("ref_count"))
    return names.join(counted, "name", "left").select("name", F.coalesce("ref_count", F.lit(0).cast("long")).alias("ref_count"))


def lookup(symbols_: DataFrame, wanted: DataFrame) -> DataFrame:
    """Definitions of wanted(query_id, name): of that name, else of that name in any case, by place."""
    exact = wanted.join(symbols_, "name")
    none = wanted.join(exact.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lower("name").alias("_lower"))
    near = symbols_.withColumn("_lower", F.lower("name")).join(none, "_lower").drop("_lower")
    return exact.unionByName(near.select(*exact.columns))


def by_name(symbols_: DataFrame) -> DataFrame:
    """(name, defs): all definitions of a name, by place."""
    return symbols_.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("path", F.col("start_line").alias("line"), "kind"))).alias("defs"))


def entry_points(symbols_: DataFrame, refs: DataFrame | None = None, most: int = 10) -> DataFrame:
    """The foremost symbols: by references, kind, path and line. Without reference counts all have 0."""
    counted = symbols_.withColumn("ref_count", F.lit(0).cast("long")) if refs is None else symbols_.join(refs, "name", "left").withColumn("ref_count", F.coalesce("ref_count", F.lit(0).cast("long")))
    order = [F.desc("ref_count"), F.desc(fn.kind_priority(F.col("kind"))), "path", "start_line", "symbol"]
    return counted.orderBy(*order).limit(most).select("name", "kind", "path", F.col("start_line").alias("line"), "signature", "ref_count")


def skeletons(files: DataFrame) -> DataFrame:
    """file_id, path, text: the top symbols' signatures with their lines."""
    top = F.filter(symbol_list(F.col("content"), F.col("path")), lambda s: s["parent"] < 0)
    text = F.array_join(F.transform(top, lambda s: F.concat(s["signature"], F.lit("  // L"), s["start_line"])), "\n")
    return files.select("file_id", "path", text.alias("text"))


def stripped(content: Column, path: Column) -> Column:
    """Without comments, and blank lines collapsed."""
    return _each(lambda text, ext: code.strip_comments(text, ext), "string", content, _extension(path))


def snapped(content: Column, path: Column, line: Column, target: str) -> Column:
    """struct(start_line, end_line, kind, name) of the narrowest function, class or block around a line's start; null if none."""
    if target not in ("function", "fn", "class", "block"):
        raise ValueError(f"expected function|class|block, got `{target}`")
    kind = "function" if target == "fn" else target
    found = _each(lambda text, ext, n: [s for s in [code.Source(text, ext).snap(int(n), kind)] if s], "array<struct<start_line:int,end_line:int,kind:string,name:string>>", content, _extension(path), line)
    return F.get(found, F.lit(0))


def body(content: Column, path: Column, line: Column) -> Column:
    """The lines of the function, else class, else block around a line; null if none."""

    def run(text: str, ext: str, n: int) -> str | None:
        source = code.Source(text, ext)
        found = next((s for t in ("function", "class", "block") if (s := source.snap(int(n), t))), None)
        return "\n".join(text.split("\n")[found[0] - 1 : found[1]]) if found else None

    return _each(run, "string", content, _extension(path), line)


def syntax_error(content: Column, path: Column) -> Column:
    return _each(lambda text, ext: code.syntax_error(text, ext), "string", content, _extension(path))


def structural(files: DataFrame, pattern: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The first k matches in order of path, line: file_id, path, line, column (1), match, snippet; and one row with a warning, null if there is none.

    A plain word of the pattern is looked for in the text first, so most files never reach Python.
    """
    import re

    known = files.where(paths.language(F.col("path")).isNotNull())
    words = [t for t in re.findall(r"(?<![\w$])[A-Za-z_]\w*", pattern)]
    asked = known.where(F.col("content").contains(max(words, key=len))) if words else known
    found = _each(lambda text, ext: code.structural(text, ext, pattern), "array<struct<line:int,match:string,snippet:string>>", F.col("content"), _extension(F.col("path")))
    rows = asked.select("file_id", "path", F.explode(found).alias("m")).select("file_id", "path", "m.line", F.lit(1).alias("column"), "m.match", "m.snippet")
    rows = rows.orderBy("path", "line").limit(k) if code.compiles(pattern) else rows.limit(0)
    if not code.compiles(pattern):
        said = known.agg(F.lit(f"pattern `{pattern}` did not compile for any language in the search path").alias("warning"))
    else:
        text = F.concat(F.lit(f"pattern `{pattern}` compiled but matched 0 of "), F.count("*"), F.lit(" files searched"))
        said = known.agg(text.alias("said"), F.count("*").alias("n")).crossJoin(rows.agg(F.count("*").alias("hits")))
        none = F.lit(f"pattern `{pattern}` did not compile for any language in the search path")
        said = said.select(F.when(F.col("n") == 0, none).when(F.col("hits") == 0, F.col("said")).alias("warning"))
    return rows, said


def outline(files: DataFrame, depth: int | None = None, kind: str | None = None) -> DataFrame:
    return symbols(files if depth is None else files.where(paths.depth(F.col("path")) < depth), kind)


def find(files: DataFrame, outline_: bool = False, relevance: DataFrame | None = None, **filters) -> DataFrame:
    """path, lines, bytes, language, symbols, relevance of the files that the filters leave, by relevance and path; cost is path bytes / 4 + 2."""
    kept = lines.matching(files, **filters)
    count = F.size(F.filter(symbol_list(F.col("content"), F.col("path")), lambda s: s["parent"] < 0)) if outline_ else F.lit(None).cast("int")
    rows = kept.select("file_id", "path", F.size(fn.lines(F.col("content"))).alias("lines"), F.octet_length("content").cast("long").alias("bytes"), paths.language(F.col("path")).alias("language"), count.alias("symbols"))
    rows = rows.withColumn("relevance", F.lit(None).cast("double")) if relevance is None else rows.join(relevance, "file_id", "left")
    return rows.orderBy(F.desc(F.coalesce("relevance", F.lit(0.0))), "path")


def find_cost(path: Column) -> Column:
    return (fn.count_fast(path) + 2).cast("long")


def find_stats(rows: DataFrame, budget: int | None = None) -> DataFrame:
    """One row: total_files, returned, budget_used."""
    kept = rows if budget is None else lines.retain(rows, [], [F.desc(F.coalesce("relevance", F.lit(0.0))), F.col("path")], find_cost(F.col("path")), budget)
    used = kept.agg(F.count("*").alias("returned"), F.coalesce(F.sum(find_cost(F.col("path"))), F.lit(0).cast("long")).alias("budget_used"))
    return rows.agg(F.count("*").alias("total_files")).crossJoin(used)


def relevance(similar: DataFrame) -> DataFrame:
    """(file_id, relevance): the greatest score of a file's chunks. similar(chunk_id, score)."""
    return similar.groupBy(F.floor(F.col("chunk_id") / 1_000_000).cast("long").alias("file_id")).agg(F.max("score").alias("relevance"))


def tree(rows: list) -> dict:
    """Listed files as nested folders, whose names end in a slash; for a page of rows on the driver."""
    root: dict = {}
    for r in sorted(rows, key=lambda r: r["path"]):
        at, (*folders, name) = root, r["path"].split("/")
        for f in folders:
            at = at.setdefault(f"{f}/", {})
        at[name] = {k: r[k] for k in ("lines", "bytes", "language", "symbols") if r[k] is not None}
    return root


def read(files: DataFrame, old: DataFrame | None = None, if_changed: str | None = None, only_hash: bool = False, outlined: bool = False, skeleton: bool = False, span: str | None = None, snap: str | None = None, mode: str | None = None, budget: int | None = None) -> DataFrame:
    """path, cached, language, lines, bytes, hash, start_line, end_line, snap_reason, text, tokens, truncated, outline.

    In this order: a hash that still holds gives a stub; then hash alone, outline, skeleton; else the lines (snapped to a
    structure), the mode (aggressive, entropy, or diff against old(path, content)) and the budget.
    """
    content, path, null = F.col("content"), F.col("path"), F.lit(None)
    if if_changed is not None and (len(if_changed) != 32 or any(c not in "0123456789abcdef" for c in if_changed.lower())):
        raise ValueError(f"expected 32-char hex hash, got `{if_changed}`")
    if mode not in (None, "aggressive", "entropy", "diff"):
        raise ValueError(f"expected aggressive|diff|entropy, got `{mode}`")
    n, hash_ = F.size(fn.lines(content)), F.md5(content)
    rows = files.withColumn("outline", symbol_list(content, path)).withColumn("hash", hash_).withColumn("cached", F.lit(False) if if_changed is None else hash_ == if_changed.lower())
    reason = null.cast("string")
    start, end, text = F.lit(1), n, content
    if outlined and not skeleton or only_hash:
        text = start = end = null
    elif skeleton:
        top = F.filter("outline", lambda s: s["parent"] < 0)
        text = F.array_join(F.transform(top, lambda s: F.concat(s["signature"], F.lit("  // L"), s["start_line"])), "\n")
    else:
        if span is not None:
            a, b = lines.parse_range(span)
            start, end = F.lit(a), F.lit(b)
            if snap is not None:
                rows = rows.withColumn("at", snapped(content, path, F.lit(a), snap))
                start, end = F.coalesce("at.start_line", start), F.coalesce("at.end_line", end)
                reason = F.when(F.col("at").isNotNull(), F.concat(F.lit("expanded to enclosing "), "at.kind", F.lit(" `"), F.coalesce("at.name", F.lit("anonymous")), F.lit("`")))
            text = lines.line_range(content, start, end)
        if mode == "aggressive":
            text = stripped(text, path)
        elif mode == "entropy":
            text = lines.entropy(text)
        elif mode == "diff" and old is not None:
            from lodestrata.operators import changes

            rows = rows.join(old.select("path", F.col("content").alias("_old")), "path", "left")
            text = F.when(F.col("_old").isNull(), text).otherwise(changes.against(F.col("_old"), text))
    text = text.cast("string")
    short = fn.middle(text, budget) if budget is not None and not skeleton else text
    shown = ~F.col("cached")
    return rows.select(
        "path", "cached", paths.language(path).alias("language"), n.alias("lines"), F.octet_length(content).cast("long").alias("bytes"), "hash", F.when(shown, start).cast("int").alias("start_line"), F.when(shown, end).cast("int").alias("end_line"),
        F.when(shown, reason).alias("snap_reason"), F.when(shown, short).alias("text"), F.when(shown, fn.count_fast(short)).alias("tokens"),
        F.when(shown, F.lit(False) if budget is None else F.coalesce(fn.count_fast(text) > budget, F.lit(False))).alias("truncated"), F.when(shown & ~F.lit(only_hash), F.col("outline")).alias("outline"),
    )
