"""Packages about a folder, a file or a symbol: context, impact and explanation.

Each part is a DataFrame. A package for a caller is a dictionary of rows that are few by then (a page of each part), cut to a
token budget on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import paths
from lodestrata.functions import text as fn
from lodestrata.operators import code, graph, lines

# Budgets and limits of the packages.
BUDGET, DOC_TOKENS, ENTRY_POINTS, EDGES, DEPTH, MAX_HOPS, FAN_IN = 4000, 400, 10, 10, 3, 5, 50
README, MODULES = ("README.md", "README", "readme.md"), ("mod.rs", "lib.rs")


def tokens_of(data: dict) -> int:
    """A quarter of the JSON's bytes."""
    return len(json.dumps(data, ensure_ascii=False, separators=(",", ":")).encode()) // 4


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def fit(data: dict, budget: int, steps: list[Callable[[dict], bool]]) -> bool:
    """Takes each step again and again, one after the other, until the package fits or no step has more to take; whether any did."""
    cut = False
    for step in steps:
        while tokens_of(data) > budget and step(data):
            cut = True
    return cut


def popper(key: str, least: int = 0) -> Callable[[dict], bool]:
    def pop(data: dict) -> bool:
        return len(data[key]) > least and data[key].pop() is not None

    return pop


# ---- context

def scope(files: DataFrame, target: str, depth: int = DEPTH, include_tests: bool = False) -> DataFrame:
    """Files of a folder that lie less than ``depth`` below it and have an extension, tests only if asked; or the file itself.
    ``rel`` is the path below the target."""
    whole = files.withColumn("rel", F.when(F.col("path") == target, paths.name(F.col("path"))).otherwise(paths.under(F.col("path"), target) if target else F.col("path")))
    inside = whole.where(F.col("rel").isNotNull())
    kept = (paths.depth(F.col("rel")) < depth) & paths.extension(F.col("path")).isNotNull()
    if not include_tests:
        kept = kept & ~paths.is_workspace_test(F.col("rel"))
    return inside.where((F.col("path") == target) | kept)


def totals(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row (files, lines, symbols), and (language, files)."""
    n = F.size(fn.lines(F.col("content"))).cast("long")
    rows = files.select(paths.language(F.col("path")).alias("language"), n.alias("lines"), F.size(code.symbol_list(F.col("content"), F.col("path"))).cast("long").alias("symbols"))
    zero = F.lit(0).cast("long")
    one = rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), zero).alias("lines"), F.coalesce(F.sum("symbols"), zero).alias("symbols"))
    return one, rows.where("language is not null").groupBy("language").agg(F.count("*").alias("files"))


def file_list(files: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """path, lines, language, symbols of the files: changed ones first, then by depth, by symbols, by path."""
    rows = files.select("path", F.size(fn.lines(F.col("content"))).alias("lines"), paths.language(F.col("path")).alias("language"), code.symbol_list(F.col("content"), F.col("path")).alias("symbols"))
    if changed is not None:
        rows = rows.join(F.broadcast(changed.select("path", F.lit(True).alias("_c")).distinct()), "path", "left")
    order = ([F.desc(F.coalesce("_c", F.lit(False)))] if changed is not None else []) + [paths.depth(F.col("path")), F.desc(F.size("symbols")), "path"]
    return rows.orderBy(*order).select("path", "lines", "language", "symbols")


def doc(files: DataFrame, target: str) -> DataFrame:
    """source, doc (text, tokens, truncated) of a file's opening comment; of a folder its readme, else the opening comment of its module file."""
    named = {n: i for i, n in enumerate(README + MODULES)}
    rank = F.try_element_at(F.create_map(*[F.lit(x) for p in named.items() for x in p]), F.col("rel"))
    rows = files.withColumn("rank", F.when(F.col("path") == target, F.lit(-1)).otherwise(rank)).where("rank is not null")
    text = F.when(F.col("rank").between(0, len(README) - 1), F.col("content")).otherwise(fn.first_doc_comment(F.col("content")))
    found = rows.withColumn("text", text).where("text is not null").orderBy("rank").limit(1)
    return found.select(F.col("path").alias("source"), fn.doc_block(F.col("text"), DOC_TOKENS).alias("doc"))


def context(files: DataFrame, target: str = "", refs: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None, changed: DataFrame | None = None, budget: int = BUDGET, depth: int = DEPTH, include_tests: bool = False, with_doc: bool = True) -> dict:
    """A folder's or file's package; over the budget edges go first, then files but for one, entry points, and half the doc at a time.

    Of the listed files at most as many come to the driver as a budget of tokens could name.
    """
    own = scope(files, target, depth, include_tests)
    whole = files.withColumn("rel", F.when(F.col("path") == target, paths.name(F.col("path"))).otherwise(paths.under(F.col("path"), target) if target else F.col("path"))).where("rel is not null")
    stats, languages = totals(own)
    data: dict = {"target": target, "kind": "file" if files.where(F.col("path") == target).limit(1).count() else "directory", "stats": _rows(stats)[0] | {"languages": {r["language"]: r["files"] for r in languages.collect()}}}
    found = _rows(doc(whole, target)) if with_doc else []
    data["doc"] = {"source": found[0]["source"], **found[0]["doc"]} if found else None
    data["entrypoints"] = _rows(code.entry_points(code.symbols(own), refs, ENTRY_POINTS))
    data["files"] = _rows(file_list(own, changed).limit(max(1, budget)))
    data["edges"] = None
    if nodes is not None:
        into, out = graph.boundary(nodes, edges, target, EDGES)
        data["edges"] = {"imports_in": _rows(into), "imports_out": _rows(out)}

    def no_edges(d: dict) -> bool:
        had, d["edges"] = d["edges"] is not None, None
        return had

    def half_doc(d: dict) -> bool:
        text = (d["doc"] or {}).get("text", "")
        if len(text.encode()) <= 50:
            return False
        cut = text.encode()[: len(text.encode()) // 2].decode("utf-8", "ignore")
        d["doc"] |= {"text": cut, "tokens": len(cut.encode()) // 4, "truncated": True}
        return True

    data["truncated"] = fit(data, budget, [no_edges, popper("files", 1), popper("entrypoints"), half_doc])
    data["warnings"] = ([] if refs is not None else ["index not built; ref counts unavailable"]) + ([f"output truncated to {budget} tokens"] if data["truncated"] else [])
    return data


# ---- impact

def uses(importers: DataFrame, exports: DataFrame) -> DataFrame:
    """(node, uses): exported names among the parts of a file's imports, sorted. importers(file_id, path, content), exports(name)."""
    parts = F.split("raw", r"[:./{},\s]+")
    met = code.imports(importers).select(F.col("file_id").alias("node"), F.explode(parts).alias("name")).join(exports.select("name").distinct(), "name")
    return met.groupBy("node").agg(F.array_sort(F.collect_set("name")).alias("uses"))


def dependents(files: DataFrame, nodes: DataFrame, edges: DataFrame, target: int, exports: DataFrame, hops: int = 2) -> DataFrame:
    """node, path, hops, uses (at one step), via (further on: the least numbered file one step from the target that it imports), is_test."""
    found = graph.reach(edges, [target], min(hops, MAX_HOPS)).withColumnRenamed("hop", "hops")
    near = found.where("hops = 1").select("node")
    named = uses(files.join(near.select(F.col("node").alias("file_id")), "file_id", "left_semi"), exports)
    first = edges.join(near.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("via_node"))
    rows = found.join(nodes, "node").join(named, "node", "left").join(first, "node", "left")
    rows = rows.join(nodes.select(F.col("node").alias("via_node"), F.col("path").alias("_via")), "via_node", "left")
    none = F.array().cast("array<string>")
    return rows.select("node", "path", "hops", F.when(F.col("hops") == 1, F.coalesce("uses", none)).otherwise(none).alias("uses"), F.when(F.col("hops") > 1, F.col("_via")).alias("via"), paths.is_workspace_test(F.col("path")).alias("is_test"))


def narrowed(rows: DataFrame, symbol: str | None = None, no_tests: bool = False, fan_in: int = FAN_IN) -> DataFrame:
    """In this order: tests go if asked; with over ``fan_in`` direct dependents only those stay; then those of a symbol: direct ones that use it and others that come by these."""
    if no_tests:
        rows = rows.where("not is_test")
    direct = rows.agg(F.count_if(F.col("hops") == 1).alias("_direct"))
    rows = rows.crossJoin(F.broadcast(direct)).where((F.col("_direct") <= fan_in) | (F.col("hops") == 1)).drop("_direct")
    if symbol is not None:
        using = rows.where((F.col("hops") == 1) & F.array_contains("uses", symbol)).select(F.col("path").alias("_p"))
        direct, further = rows.where("hops = 1").where(F.array_contains("uses", symbol)), rows.where("hops > 1")
        rows = direct.unionByName(further.join(using, F.col("via") == F.col("_p"), "left_semi"))
    return rows.orderBy("hops", F.desc(F.size("uses")), "path")


def impact_stats(rows: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("hops") == 1).alias("direct"), F.count_if(F.col("hops") > 1).alias("transitive"), F.count_if(F.col("is_test")).alias("test_files"), F.count("*").alias("total")]
    return rows.agg(*counts, F.coalesce(F.max("hops"), F.lit(0)).alias("max_hops_reached"))


def impact(files: DataFrame, nodes: DataFrame, edges: DataFrame, path: str, symbol: str | None = None, hops: int = 2, budget: int | None = None, no_tests: bool = False) -> dict:
    """A file's package: what depends on it. Over the budget the last dependents go; the statistics stay."""
    found = nodes.where(F.col("path") == path).limit(1).collect()
    if not found:
        raise FileNotFoundError(path)
    exports = code.symbols(files.where(F.col("path") == path)).select("name", "kind", F.col("start_line").alias("line"))
    if symbol is not None and not exports.where(F.col("name") == symbol).limit(1).count():
        raise ValueError(f"symbol '{symbol}' not found in {path}")
    all_ = dependents(files, nodes, edges, found[0]["node"], exports, hops).cache()
    rows = narrowed(all_, symbol, no_tests)
    warnings = [f"hops capped from {hops} to {MAX_HOPS}"] if hops > MAX_HOPS else []
    direct = (all_.where("not is_test") if no_tests else all_).where("hops = 1").count()
    if direct > FAN_IN and hops > 1:
        warnings.append(f"high fan-in ({direct} direct dependents); hops capped to 1")
    listed = rows.drop("node") if budget is None else rows.drop("node").limit(max(1, budget))
    data = {"target": {"file": path, "symbol": symbol, "exports": _rows(exports if symbol is None else exports.where(F.col("name") == symbol))}, "dependents": _rows(listed), "stats": _rows(impact_stats(rows))[0], "truncated": False}
    if budget is not None and fit(data, budget, [popper("dependents")]):
        data["truncated"] = True
        warnings.append(f"output truncated to {budget} tokens")
    all_.unpersist()
    return data | {"warnings": warnings}


# ---- explanation

def definitions(files: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """path, line, kind, body of a name's definitions; of the name in any case if it has none."""
    wanted = files.sparkSession.createDataFrame([(0, name)], "query_id int, name string")
    found = code.lookup(symbols, wanted).select("path", F.col("start_line").alias("line"), "kind", "symbol")
    rows = found.join(files.select("path", "content"), "path")
    return rows.select("path", "line", "kind", code.body(F.col("content"), F.col("path"), F.col("line")).alias("body")).orderBy("path", "line")


def mentions(files: DataFrame, defined: DataFrame, name: str) -> DataFrame:
    """path, line, context, is_test: the first mention in each file that has no definition."""
    others = lines.first_reference(files, name).join(defined.select("path").distinct(), "path", "left_anti")
    return others.select("path", "line", "context", paths.is_workspace_test(F.col("path")).alias("is_test")).orderBy("path")


def explain(files: DataFrame, symbols: DataFrame, name: str, budget: int | None = None) -> dict:
    """A symbol's package; over the budget the last references go, then tests, then bodies from the last definition on."""
    defs = definitions(files, symbols, name).cache()
    rows = _rows(defs)
    if not rows:
        raise ValueError(f"symbol '{name}' not found")
    found = mentions(files, defs, name)
    side = lambda test: _rows((found.where("is_test") if test else found.where("not is_test")).drop("is_test") if budget is None else (found.where("is_test") if test else found.where("not is_test")).drop("is_test").limit(max(1, budget)))
    data = {"symbol": name, "definitions": rows, "references": side(False), "tests": side(True)}
    defs.unpersist()

    def last_body(d: dict) -> bool:
        had, d["definitions"][-1]["body"] = d["definitions"][-1]["body"] is not None, None
        return had

    if budget is not None:
        fit(data, budget, [popper("references"), popper("tests"), last_body])
    return data
