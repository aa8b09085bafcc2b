"""Edits, renames and differences between versions of files, as expressions over lines and rows of changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import code, paths
from lodestrata.functions import text as fn
from lodestrata.operators import code as structure
from lodestrata.operators import lines

_CHANGE = "array<struct<line:int,before:string,after:string>>"


def replaced(content: Column, find: str, replace: str, regex: bool = False, every: bool = False, first: Column | None = None, last: Column | None = None) -> Column:
    """struct(text, changes): literal, once in the first line that has it, or with ``every`` each time; by regex the first time
    on each line, or each time. Lines outside first to last stay."""
    ls = fn.lines(content)
    pattern = find if regex else "(?s)\\Q" + find.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    java = replace if regex else replace.replace("\\", "\\\\").replace("$", "\\$")

    def new(x: Column) -> Column:
        if every:
            return F.regexp_replace(x, pattern, java) if regex else F.replace(x, F.lit(find), F.lit(replace))
        head = F.regexp_extract(x, f"(?s)^(.*?)({pattern})", 1)
        hit = F.regexp_extract(x, pattern, 0)
        return F.concat(head, F.regexp_replace(hit, f"^(?:{pattern})$" if regex else pattern, java), F.substring(x, F.length(head) + F.length(hit) + 1, F.lit(1 << 30)))

    within = lambda i: F.lit(True) if first is None else F.coalesce((i + 1).between(first, last), F.lit(True))
    has = lambda x: x.rlike(pattern) if regex else x.contains(find)
    change = lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("before"), F.when(has(x) & within(i), new(x)).alias("after"))
    if regex or every:
        all_ = F.transform(ls, change)
        lines_, changed = F.transform(all_, lambda c: F.coalesce(c["after"], c["before"])), F.filter(all_, lambda c: c["after"].isNotNull())
    else:
        # Only the first line that has it: what lies before and after is left as it is.
        at = F.array_position(F.transform(ls, lambda x, i: has(x) & within(i)), True).cast("int")
        one = F.get(ls, at - 1)
        lines_ = F.when(at > 0, F.concat(F.slice(ls, F.lit(1), F.greatest(at - 1, F.lit(0))), F.array(new(one)), F.slice(ls, at + 1, F.size(ls)))).otherwise(ls)
        changed = F.when(at > 0, F.array(F.struct(at.alias("line"), one.alias("before"), new(one).alias("after")))).otherwise(F.array())
    text = F.array_join(lines_, "\n")
    text = F.concat(text, F.when(content.endswith("\n") & ~text.endswith("\n"), "\n").otherwise(""))
    return F.struct(text.alias("text"), changed.cast(_CHANGE).alias("changes"))


def edit(files: DataFrame, pairs: list[tuple[str, str]], regex: bool = False, every: bool = False, scope: str | None = None) -> DataFrame:
    """file_id, path, text, changes, total_replacements, syntax_valid, syntax_error, hash_before, hash_after.

    Pairs are applied one after the other to what the one before left; a scope (the name of a symbol) keeps
    them within its lines, as they were before the first. Only ``apply`` writes.
    """
    if not pairs:
        raise ValueError("at least one find value required")
    rows = files.select("file_id", "path", "content", F.col("content").alias("text"), F.array().cast(_CHANGE).alias("changes"))
    first = last = None
    if scope is not None:
        named = F.get(F.filter(structure.symbol_list(F.col("content"), F.col("path")), lambda s: s["name"] == scope), F.lit(0))
        rows = rows.withColumn("scope", named)
        first, last = F.col("scope.start_line"), F.col("scope.end_line")
    for find, replace in pairs:
        rows = rows.withColumn("_r", replaced(F.col("text"), find, replace, regex, every, first, last)).withColumn("changes", F.concat("changes", "_r.changes")).withColumn("text", F.col("_r.text")).drop("_r")
    total = F.size("changes")
    rows = rows.withColumn("syntax_error", F.when(total > 0, structure.syntax_error(F.col("text"), F.col("path"))))
    return rows.select("file_id", "path", "text", "changes", total.alias("total_replacements"), F.col("syntax_error").isNull().alias("syntax_valid"), "syntax_error", F.md5("content").alias("hash_before"), F.md5("text").alias("hash_after"))


def to_apply(edited: DataFrame) -> DataFrame:
    """The rows of an edit that may be written."""
    return edited.where((F.col("total_replacements") > 0) & F.col("syntax_valid"))


def rename(files: DataFrame, old: str, new: str, include_tests: bool = False) -> DataFrame:
    """file_id, path, replacements, lines(line, before, after): every occurrence, within longer names too."""
    if old == new:
        raise ValueError("new name must differ from old name")
    kept = files.where(F.col("content").contains(old))
    kept = kept if include_tests else kept.where(~paths.is_workspace_test(F.col("path")))
    times = lambda x: F.floor((F.octet_length(x) - F.octet_length(F.replace(x, F.lit(old), F.lit("")))) / len(old.encode())).cast("long")
    spots = F.filter(F.transform(fn.lines(F.col("content")), lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("before"), F.replace(x, F.lit(old), F.lit(new)).alias("after"))), lambda s: s["before"].contains(old))
    rows = kept.select("file_id", "path", spots.alias("lines")).withColumn("replacements", F.aggregate("lines", F.lit(0).cast("long"), lambda n, s: n + times(s["before"])))
    return rows.where("replacements > 0").select("file_id", "path", "replacements", "lines")


def renamed(files: DataFrame, old: str, new: str, include_tests: bool = False) -> DataFrame:
    """Files with the name replaced, where it occurs."""
    found = rename(files, old, new, include_tests).select("file_id")
    return files.join(found, "file_id", "left_semi").withColumn("content", F.replace("content", F.lit(old), F.lit(new)))


def defined(files: DataFrame, name: str) -> bool:
    """Whether a file defines the name; a name in any case counts if none has it as written."""
    asked = files.where(F.lower("content").contains(name.lower()))
    return structure.symbols(asked).where(F.lower("name") == name.lower()).limit(1).count() > 0


def against(old: Column, new: Column) -> Column:
    """Changed lines as ±L<n>: text, in order; a note if there are none."""

    def run(a: str, b: str) -> str:
        marks = {"deletion": "-", "addition": "+"}
        return "\n".join([f"{marks[t]}L{n}: {x}" for t, n, x in code.line_diff(a, b)] or ["[no changes vs HEAD]"]) + "\n"

    return structure._each(run, "string", old, new)


_DIFF = "path string, position int, type string, line int, old string, new string"


def diff(pairs: DataFrame) -> DataFrame:
    """path, position, type (addition or deletion), line, old, new of pairs(path, old, new): a shortest edit of each file's lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, t, n, x if t == "deletion" else None, x if t == "addition" else None) for p, a, b in zip(batch["path"], batch["old"], batch["new"], strict=True) for i, (t, n, x) in enumerate(code.line_diff(a or "", b or ""))]
            yield pd.DataFrame(rows, columns=["path", "position", "type", "line", "old", "new"])

    return pairs.where(~F.col("old").eqNullSafe(F.col("new"))).select("path", "old", "new").mapInPandas(run, _DIFF)


def versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """pairs(path, old, new) of two snapshots(path, content); a side that lacks a file is empty. Equal files are left out by their hashes."""
    a, b = old.select("path", F.col("content").alias("old")), new.select("path", F.col("content").alias("new"))
    return a.join(b, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("path", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"))


def changed_functions(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, name, position): top symbols of the new version that hold an added line, each once, by the first such line."""
    own = structure.symbols(pairs.select(F.lit(0).cast("long").alias("file_id"), "path", F.col("new").alias("content"))).where("parent < 0").select("path", "symbol", "name", "start_line", "end_line")
    added = changes.where("type = 'addition'").select("path", "line")
    hits = own.join(added, "path").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return hits.groupBy("path", "name").agg(F.min(F.struct("line", "symbol")).alias("at")).withColumn("position", F.row_number().over(Window.partitionBy("path").orderBy("at"))).drop("at")


def notes(pairs: DataFrame) -> DataFrame:
    """(path, note): top symbols that are new, gone, or have another signature. A name that is there twice counts by its first."""

    def first(side: str) -> DataFrame:
        rows = structure.symbols(pairs.select(F.lit(0).cast("long").alias("file_id"), "path", F.col(side).alias("content"))).where("parent < 0")
        return rows.groupBy("path", "name").agg(F.min_by("signature", "symbol").alias(f"_{side}"))

    both = first("old").join(first("new"), ["path", "name"], "full_outer")
    what = F.when(F.col("_old").isNull(), "new symbol").when(F.col("_new").isNull(), "removed symbol").when(F.col("_old") != F.col("_new"), "signature changed")
    return both.withColumn("what", what).where("what is not null").select("path", F.concat("path", F.lit(": "), "what", F.lit(" `"), "name", F.lit("`")).alias("note"))


def stats(pairs: DataFrame, changes: DataFrame, functions: DataFrame) -> DataFrame:
    """One row: additions, deletions, files_changed, functions_changed, summary."""
    lines_ = changes.agg(F.count_if(F.col("type") == "addition").alias("additions"), F.count_if(F.col("type") == "deletion").alias("deletions"))
    named = functions.agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "position", "name"))), lambda f: F.concat(f["path"], F.lit(":"), f["name"])).alias("functions_changed"))
    row = pairs.agg(F.count("*").alias("files_changed")).crossJoin(lines_).crossJoin(named)
    said = fn.summary_of_diff(F.col("files_changed"), F.col("additions"), F.col("deletions"), F.col("functions_changed"))
    return row.withColumn("summary", F.when(F.col("files_changed") == 0, "no changes").otherwise(said))


def hunks(changes: DataFrame, functions: DataFrame, budget: int | None = None) -> DataFrame:
    """path, function, changes, cost: one for each file; with a budget those that fit when they come, by path."""
    size = F.sum(F.coalesce(F.octet_length("old"), F.lit(0)) + F.coalesce(F.octet_length("new"), F.lit(0)))
    own = changes.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("position", "type", "old", "new"))).alias("changes"), F.floor(size / 4).cast("long").alias("cost"))
    rows = own.join(functions.where("position = 1").select("path", F.col("name").alias("function")), "path", "left").select("path", "function", "changes", "cost")
    return rows if budget is None else lines.retain(rows, [], ["path"], F.col("cost"), budget)
