"""Line operators. Those on files are expressions over the array of lines, so they shuffle nothing;
those on rows of lines are windows within a file.

``files``: file_id, path, content. Line rows: file_id, path, line (from 1), text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import paths
from lodestrata.functions import text as fn

LEVEL = r"(?i)\b(ERROR|WARN(?:ING)?|FATAL|DEBUG|INFO|TRACE)\b"


def snippet(lines: Column, at: Column, around: int = 2) -> Column:
    """The line at a 0-based index with ``around`` lines on either side."""
    first = F.greatest(F.lit(1), at + 1 - around)
    return F.array_join(F.slice(lines, first, at + 1 + around - first + 1), "\n")


def scan(files: DataFrame, pattern: str) -> DataFrame:
    """One row per matching line: file_id, path, hash, line, column (byte offset + 1), match, snippet, relevance.

    Lines are matched within the array; only hits are exploded, each with its snippet.
    """
    held = files.select("file_id", "path", "content", fn.lines(F.col("content")).alias("ls"))
    spots = F.filter(F.transform("ls", lambda x, i: F.struct(i.alias("i"), x.alias("text"))), lambda x: x["text"].rlike(pattern))
    hits = held.select("file_id", "path", F.md5("content").alias("hash"), "ls", F.explode(spots).alias("hit"))
    text = F.col("hit.text")
    before = F.octet_length(F.regexp_extract(text, f"^(.*?)(?:{pattern})", 1))
    return hits.select("file_id", "path", "hash", (F.col("hit.i") + 1).alias("line"), (before + 1).alias("column"), F.regexp_extract(text, pattern, 0).alias("match"), snippet(F.col("ls"), F.col("hit.i")).alias("snippet"), F.lit(1.0).alias("relevance"))


def page(rows: DataFrame, order: list, k: int, skip: int = 0, budget: int | None = None, cost: Column | None = None) -> DataFrame:
    """Rows ``skip`` to ``skip + k`` in order, with rank (from 1) and token (what resumes after the page; null on the last).

    With a budget, rows in order from skip on are kept while they fit, others are skipped; the token resumes
    after the last one that was looked at, so no row comes twice.
    """
    w = Window.orderBy(*order)
    if budget is None:
        # Bounded before it meets in one task.
        ranked = rows.orderBy(*order).limit(skip + k + 1).withColumn("rank", F.row_number().over(w)).where(F.col("rank") > skip)
        more = F.max("rank").over(Window.partitionBy()) > skip + k
        return ranked.withColumn("token", F.when(more, fn.page_token(F.lit(skip + k)))).where(F.col("rank") <= skip + k)
    ranked = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") > skip)
    kept = retain(ranked.where(cost <= budget), [], [F.col("rank")], cost, budget).withColumn("_n", F.row_number().over(Window.orderBy("rank"))).where(F.col("_n") <= k)
    last = F.max("rank").over(Window.partitionBy())
    total = ranked.agg(F.max("rank").alias("_total"))
    return kept.crossJoin(F.broadcast(total)).withColumn("token", F.when(F.col("_total") > last, fn.page_token(last))).drop("_n", "_total")


def exists(vocabulary: DataFrame, patterns: DataFrame) -> DataFrame:
    """Of patterns(query_id, query) whether all its tokens are in vocabulary(term); no token: false."""
    wanted = patterns.select("query_id", F.explode_outer(fn.tokens(F.col("query"))).alias("term")).distinct()
    # Only the patterns' terms leave the vocabulary's tasks.
    found = wanted.join(vocabulary.select("term").distinct().withColumn("found", F.lit(True)), "term", "left")
    all_ = F.bool_and(F.coalesce("found", F.lit(False)))
    return found.groupBy("query_id").agg(all_.alias("exists")).withColumn("confidence", F.when(F.col("exists"), "probable").otherwise("exact"))


def entropy(content: Column, most: int = 3, least: int = 10) -> Column:
    """The text without the fourth and later line of a shape (trimmed, digits made N) and a note of how many
    are gone. Unchanged if none is, or under ten lines. Lines are sorted by shape and place, a line goes whose
    third predecessor in that order has its shape, and the others are sorted back."""
    ls = fn.lines(content)
    ordered = F.array_sort(F.transform(ls, lambda x, i: F.struct(F.regexp_replace(fn.strip(x), "[0-9]", "N").alias("shape"), i.alias("i"), x.alias("text"))))
    # zip_with pads the shorter list with nulls at its end: those are no lines.
    shifted = F.zip_with(ordered, F.concat(F.array_repeat(F.lit(None).cast("string"), most), ordered["shape"]), lambda x, y: F.struct(x["i"].alias("i"), x["text"].alias("text"), x["shape"].eqNullSafe(y).alias("gone")))
    kept = F.array_sort(F.filter(shifted, lambda x: x["i"].isNotNull() & ~x["gone"]))
    gone = F.size(ls) - F.size(kept)
    note = F.concat(F.array_join(F.transform(kept, lambda x: x["text"]), "\n"), F.lit("\n\n... ("), gone, F.lit(" repetitive lines filtered)\n"))
    return F.when((F.size(ls) < least) | (gone == 0), content).otherwise(note)


def level(text: Column) -> Column:
    """ERROR, FATAL or WARN by the first level word of a line; null for others and none."""
    found = F.upper(F.regexp_extract(text, LEVEL, 1))
    return F.when(found.isin("ERROR", "FATAL"), found).when(found.isin("WARN", "WARNING"), "WARN")


def collapse(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal values: (group, run from 1, value, times)."""
    w = Window.partitionBy(group).orderBy(*order)
    changed = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    runs = rows.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w))
    return runs.groupBy(group, "run", value).agg(F.count("*").alias("times"))


def log_runs(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Runs of equal ERROR, FATAL and WARN lines of ``text``: (group, run, level, display), a repeated line with how often it comes."""
    runs = collapse(rows, group, order, "text").withColumn("level", level(F.col("text"))).where("level is not null")
    times = F.when(F.col("times") > 1, F.concat(F.lit(" [repeated "), "times", F.lit(" times]"))).otherwise("")
    return runs.select(group, "run", "level", F.concat("text", times).alias("display"))


def sections(rows: DataFrame, header: str, key: str = "file_id") -> DataFrame:
    """Line rows with ``section``: how many lines that match the header came so far; 0 before the first."""
    w = Window.partitionBy(key).orderBy("line")
    return rows.withColumn("section", F.sum(F.col("text").rlike(header).cast("int")).over(w))


def next_line(rows: DataFrame, key: str = "file_id") -> DataFrame:
    return rows.withColumn("next", F.lead("text").over(Window.partitionBy(key).orderBy("line")))


def carry(rows: DataFrame, value: Column, name: str, key: str = "file_id") -> DataFrame:
    """The latest value that is not null, up to and with the line."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy("line")))


def tail(rows: DataFrame, n: int | Column, key: str = "file_id") -> DataFrame:
    """The last n lines of each; n may be a column, such as ``tail_length``."""
    w = Window.partitionBy(key).orderBy(F.desc("line"))
    return rows.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n).drop("back")


def tail_length(exit_code: Column) -> Column:
    return F.when(exit_code == 0, 10).otherwise(20)


def collapse_blanks(content: Column) -> Column:
    """One empty line for each run of blank lines, none at either end, a final LF."""
    ls = F.transform(fn.lines(content), lambda x: F.when(fn.strip(x) == "", "").otherwise(x))
    pairs = F.zip_with(ls, F.concat(F.array(F.lit("")), ls), lambda x, y: F.struct(x.alias("x"), y.alias("before")))
    kept = F.filter(pairs, lambda p: (p["x"] != "") | (p["before"] != ""))
    return F.concat(F.regexp_replace(F.array_join(F.transform(kept, lambda p: p["x"]), "\n"), "\n$", ""), F.lit("\n"))


def first_reference(files: DataFrame, symbol: str) -> DataFrame:
    """file_id, path, line, context of the first line that has the symbol; files without it are dropped before their lines are split."""
    spot = F.filter(F.transform(fn.lines(F.col("content")), lambda x, i: F.struct((i + 1).alias("line"), fn.strip(x).alias("context"), x.contains(symbol).alias("has"))), lambda x: x["has"])
    return files.where(F.col("content").contains(symbol)).select("file_id", "path", F.get(spot, F.lit(0)).alias("s")).select("file_id", "path", "s.line", "s.context").where("line is not null")


def line_range(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end, from 1 and both included."""
    first = F.greatest(start, F.lit(1))
    return F.when(end >= first, F.array_join(F.slice(fn.lines(content), first, end - first + 1), "\n")).otherwise("")


def parse_range(spec: str) -> tuple[int, int]:
    """START-END; anything else is an error."""
    parts = spec.split("-")
    if len(parts) != 2 or not all(p.isascii() and p.isdigit() for p in parts):
        raise ValueError(f"expected START-END, got `{spec}`")
    return int(parts[0]), int(parts[1])


def retain_within(costs: Column, budget: int) -> Column:
    """Of an array of costs in order, the places (from 0) of those that still fit when they come; others are skipped."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("at"))

    def step(state, cost):
        fits = state["used"] + cost["c"] <= budget
        used = F.when(fits, state["used"] + cost["c"]).otherwise(state["used"])
        return F.struct(used.alias("used"), F.when(fits & (cost["c"] >= 0), F.array_append(state["at"], cost["i"])).otherwise(state["at"]).alias("at"))

    return F.aggregate(F.transform(costs, lambda c, i: F.struct(c.cast("long").alias("c"), i.alias("i"))), start, step)["at"]


def retain(rows: DataFrame, by: list[str], order: list, cost: Column, budget: int) -> DataFrame:
    """The rows of each group that still fit the budget when they come, in order; others are skipped.

    The fold runs over Arrow batches sorted by group, so it holds a number a group and no group's rows.
    """
    columns = rows.columns

    def fold(batches):
        import pyarrow as pa

        key, used = None, 0
        for batch in batches:
            own = list(zip(*[batch.column(f"_k{i}").to_pylist() for i in range(len(by))], strict=True)) if by else [()] * batch.num_rows
            keep = []
            for k, c in zip(own, batch.column("_cost").to_pylist(), strict=True):
                if k != key:
                    key, used = k, 0
                fits = used + c <= budget
                used += c if fits else 0
                keep.append(fits)
            yield batch.filter(pa.array(keep, pa.bool_())).select(columns)

    keyed = rows.select("*", *[F.concat_ws(":", F.col(b).isNull(), F.col(b).cast("string")).alias(f"_k{i}") for i, b in enumerate(by)], cost.cast("long").alias("_cost"))
    keys = [f"_k{i}" for i in range(len(by))]
    dealt = (keyed.repartition(*keys) if by else keyed.coalesce(1)).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(fold, rows.schema)


def matching(files: DataFrame, pattern: str | None = None, depth: int | None = None, changed: DataFrame | None = None) -> DataFrame:
    """Files by name, depth and changed(path): either path may be a tail of the other."""
    if pattern is not None:
        files = files.where(paths.glob_matches(F.col("path"), pattern))
    if depth is not None:
        files = files.where(paths.depth(F.col("path")) < depth)
    if changed is None:
        return files
    # A tail of equal length is equality; so each side's tails meet the other side's whole path by equi joins.
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.length(c)))
    named = changed.select(F.col("path").alias("c")).where("c <> ''").distinct()
    by_tail = files.select("file_id", F.explode(tails(F.col("path"))).alias("c")).join(named, "c").select("file_id")
    by_whole = named.select(F.explode(tails(F.col("c"))).alias("path")).join(files.select("file_id", "path"), "path").select("file_id")
    return files.join(by_tail.unionByName(by_whole).distinct(), "file_id", "left_semi")
