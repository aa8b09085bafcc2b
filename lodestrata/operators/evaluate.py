"""Relevance and telemetry: NDCG over labelled queries, bootstrap intervals, savings of commands against baselines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lodestrata.functions import text as fn

# Resamples, seed and steps of the generator, places of the interval's ends.
RESAMPLES, SEED, TIMES, PLUS, LOW, HIGH = 2000, 0x517CC1B727220A95, 6364136223846793005, 1442695040888963407, 50, 1950


def round4(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000


def _inner(passage: str) -> tuple[str, ...]:
    """The words of a passage's first 13 but for the first and last, which may be parts of words where the passage stands."""
    return tuple(re.split("[ \n]+", passage)[:13][1:-1])


def _standing(passages: list[tuple[int, str]]):
    """From rows (doc_id, text) those of (item_id, doc_id) whose text has the passage. A passage is looked for where its longest inner
    word stands amid the other inner ones, so a text is split once; one without inner words is looked for in each text."""
    anchors: dict[str, dict[tuple[int, int], dict[tuple[str, ...], list[tuple[int, str]]]]] = {}
    bare = []
    for item, passage in passages:
        inner = _inner(passage)
        if not inner:
            bare.append((item, passage))
            continue
        at = max(range(len(inner)), key=lambda i: len(inner[i]))
        anchors.setdefault(inner[at], {}).setdefault((at, len(inner)), {}).setdefault(inner, []).append((item, passage))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                if text is None:
                    continue
                words = [w for w in text.replace("\n", " ").split(" ") if w]
                near = {}
                for i in [i for i, w in enumerate(words) if w in anchors]:
                    for (at, n), by in anchors[words[i]].items():
                        if i >= at and (key := tuple(words[i - at : i - at + n])) in by:
                            near[key] = by[key]
                out += [(item, doc) for item, passage in [*(x for xs in near.values() for x in xs), *bare] if passage in text]
            yield pd.DataFrame(out, columns=["item_id", "doc_id"])

    return run


def containing(docs: DataFrame, passages: DataFrame, few: int = 20_000) -> DataFrame:
    """(item_id, doc_id) of docs(doc_id, text) whose text has the passage of passages(item_id, passage), both whole; null has and is none.

    Up to ``few`` passages of 32 MB are sent to the tasks, which read the texts once and return only what is found. More are met by a
    shuffle: the hash of a passage's inner words is the key of an equi join with every such window of the texts.
    """
    docs, passages = docs.where("doc_id is not null and text is not null"), passages.where("item_id is not null and passage is not null")
    size = passages.agg(F.count("*").alias("n"), F.sum(F.octet_length("passage")).alias("bytes")).first()
    if size["n"] <= few and (size["bytes"] or 0) <= 32 << 20:
        found = _standing([(r["item_id"], r["passage"]) for r in passages.collect()])
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(found, "item_id long, doc_id long")
    words = lambda c: F.split(c, r"[ \n]+")
    b = passages.withColumn("k", F.least(F.size(words("passage")), F.lit(13)))
    # The last of the k words may go on in the document, so only the words before it are the key.
    keys = b.where("k > 2").withColumn("key", F.xxhash64(F.array_join(F.slice(words("passage"), F.lit(2), F.greatest(F.col("k") - 2, F.lit(0))), " ")))
    sizes = [r["k"] for r in keys.select("k").distinct().collect()]  # at most eleven
    ws = F.col("ws")

    def windows(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(ws) - (k - 3), F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(ws, i, k - 2), " "))))

    # The words are a column of their own, so that a text is split once.
    split = docs.select("doc_id", "text", words("text").alias("ws"))
    found = docs.join(b.where("k <= 2"), F.col("text").contains(F.col("passage"))).select("item_id", "doc_id")
    for k in sizes:
        hit = split.select("doc_id", F.explode(windows(k)).alias("key"), F.lit(k).alias("k")).join(keys.select("item_id", "key", "k"), ["key", "k"]).select("item_id", "doc_id").distinct()
        found = found.unionByName(hit.join(docs, "doc_id").join(b.select("item_id", "passage"), "item_id").where(F.col("text").contains(F.col("passage"))).select("item_id", "doc_id"))
    return found


def judge(results: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, path, rank, relevance: each file once, at its best rank; its relevance is that of the first label (by
    position) whose file is a tail of it or has it as a tail; 0 without one. results(query_id, path, rank)."""
    own = results.groupBy("query_id", "path").agg(F.min("rank").alias("r"))
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("r"))).drop("r")
    met = own.join(labels, "query_id").where(F.col("path").endswith(F.col("file")) | F.col("file").endswith(F.col("path")))
    first = met.groupBy("query_id", "path").agg(F.min_by("relevance", "position").alias("relevance"))
    return own.join(first, ["query_id", "path"], "left").select("query_id", "path", "rank", F.coalesce("relevance", F.lit(0)).alias("relevance"))


def ndcg(results: DataFrame, labels: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, category, ndcg5, ndcg10 of queries(query_id, category, negative): gain 2^rel - 1, ideal from all labels, 0
    without an ideal; a negative query has 1 if nothing is returned, else 0. labels(query_id, position, file, relevance)."""
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1

    def dcg(rows: DataFrame, name: str) -> DataFrame:
        part = gain / F.log2(F.col("rank") + 1)
        return rows.groupBy("query_id").agg(*[F.sum(F.when(F.col("rank") <= k, part).otherwise(0.0)).alias(f"{name}{k}") for k in (5, 10)], F.count("*").alias(f"{name}_n"))

    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "position")
    ideal = dcg(labels.withColumn("rank", F.row_number().over(w)), "ideal")
    rows = queries.join(dcg(judge(results, labels), "got"), "query_id", "left").join(ideal, "query_id", "left")
    score = lambda k: F.when(F.col("negative"), F.col("got_n").isNull().cast("double")).otherwise(F.coalesce(F.col(f"got{k}") / F.nullif(F.col(f"ideal{k}"), F.lit(0.0)), F.lit(0.0)))
    return rows.select("query_id", "category", score(5).alias("ndcg5"), score(10).alias("ndcg10"))


def interval(values: list[float]) -> tuple[float, float]:
    """Ends of the middle 95 % of resampled means; under three values the mean twice. The generator's whole
    sequence is one array: its k-th state is TIMES^k seed + PLUS (1 + TIMES + … + TIMES^(k-1)) modulo 2^64."""
    n = len(values)
    if n < 3:
        mean = sum(values) / n if n else 0.0
        return (np.floor(mean * 10000 + 0.5) / 10000,) * 2
    powers = np.full(RESAMPLES * n + 1, TIMES, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    states = powers[1:] * np.uint64(SEED) + np.cumsum(powers[:-1]) * np.uint64(PLUS)
    drawn = np.array(values)[((states >> np.uint64(33)) % np.uint64(n)).astype(np.int64)].reshape(RESAMPLES, n)
    means = np.sort(np.add.accumulate(drawn, axis=1)[:, -1] / n)
    return tuple(np.floor(means[[LOW, HIGH]] * 10000 + 0.5) / 10000)


@F.pandas_udf(ArrayType(DoubleType()))
def interval_of(values: pd.Series) -> pd.Series:
    """The interval of each list of values."""
    return pd.Series([list(interval(list(v))) for v in values], dtype=object)


def by_category(scores: DataFrame) -> DataFrame:
    """category (null: all), ndcg5, ndcg10, low, high, count, misses (queries with 0). The scores are read once."""
    sums = [F.avg("ndcg5").alias("ndcg5"), F.avg("ndcg10").alias("ndcg10"), F.count("*").alias("count"), F.count_if(F.col("ndcg10") == 0).alias("misses")]
    marked = scores.select(F.explode(F.array(F.col("category"), F.lit(None).cast("string"))).alias("category"), "query_id", "ndcg5", "ndcg10")
    rows = marked.groupBy("category").agg(*sums, F.array_sort(F.collect_list(F.struct("query_id", "ndcg10"))).alias("all"))
    rows = rows.withColumn("ends", interval_of(F.transform("all", lambda x: x["ndcg10"])))
    return rows.select("category", round4(F.col("ndcg5")).alias("ndcg5"), round4(F.col("ndcg10")).alias("ndcg10"), F.get("ends", F.lit(0)).alias("low"), F.get("ends", F.lit(1)).alias("high"), "count", "misses")


def percent(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def savings(actual: Column, baseline: Column) -> Column:
    """Share of the baseline that is saved, in per cent to one place; 0 without a baseline, and never below 0."""
    return percent(F.coalesce((baseline - F.least(actual, baseline)) / F.nullif(baseline, baseline * 0) * 100, F.lit(0.0)))


def roll_up(telemetry: DataFrame) -> DataFrame:
    """command, calls, actual_tokens, baseline_tokens, savings_pct of telemetry(command, actual_bytes, baseline_bytes), most calls first."""
    zero = F.lit(0).cast("long")
    sums = telemetry.groupBy(F.coalesce("command", F.lit("unknown")).alias("command")).agg(
        F.count("*").alias("calls"), F.coalesce(F.sum("actual_bytes"), zero).cast("long").alias("a"), F.coalesce(F.sum("baseline_bytes"), zero).cast("long").alias("b")
    )
    quarter = lambda c: F.floor(F.col(c) / 4).cast("long")
    return sums.select("command", "calls", quarter("a").alias("actual_tokens"), quarter("b").alias("baseline_tokens"), savings(F.col("a").cast("double"), F.col("b").cast("double")).alias("savings_pct")).orderBy(F.desc("calls"), "command")


def totals(telemetry: DataFrame) -> DataFrame:
    return telemetry.agg(F.count("*").alias("calls"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).cast("long").alias("tokens_saved"))


# What a command would have cost without the engine.
STRATEGY = {"search": "grep_rn_all_matches", "read": "cat_full_file", "run": "raw_command_output", "outline": "cat_files_for_symbols", "exists": "grep_rl", "find": "find_ls"}


def baseline_bytes(command: Column, actual: Column, facts: Column) -> Column:
    """Modelled bytes of calls; facts: struct(total_matches, unique_files, bytes, output_tokens_saved, total_files, additions, deletions, symbols), nulls where a call has none."""
    n = lambda c: F.coalesce(facts[c], F.lit(0)).cast("long")
    known = lambda c: facts[c].cast("long")
    cases = {
        "search": n("total_matches") * 120 + F.coalesce(known("unique_files"), F.lit(1)) * 3000, "read": F.coalesce(known("bytes"), actual), "run": actual + n("output_tokens_saved") * 4, "find": n("total_files") * 120,
        "exists": F.greatest(F.lit(500).cast("long"), actual), "diff": (n("additions") + n("deletions")) * 100 + 200, "outline": F.coalesce(known("symbols") * 500, actual),
    }
    out = None
    for name, value in cases.items():
        out = F.when(command == name, value) if out is None else out.when(command == name, value)
    return out.otherwise(actual).cast("long")


def strategy(command: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in STRATEGY.items() for x in p]), command), F.lit("parity"))


def side_by_side(results: DataFrame) -> DataFrame:
    """One row of results(name, bytes, baseline_bytes, ms, baseline_ms): tasks, mean savings, sums of tokens and times."""
    t, b = F.floor(F.col("bytes") / 4).cast("long"), F.floor(F.col("baseline_bytes") / 4).cast("long")
    saved = savings(t.cast("double"), b.cast("double"))
    rows = results.select(t.alias("t"), b.alias("b"), saved.alias("s"), "ms", "baseline_ms")
    return rows.agg(F.count("*").alias("total_tasks"), percent(F.coalesce(F.avg("s"), F.lit(0.0))).alias("avg_savings_pct"), F.sum("t").alias("tokens"), F.sum("b").alias("baseline_tokens"), F.sum("ms").alias("ms"), F.sum("baseline_ms").alias("baseline_ms"))


def entry(command: Column, actual: Column, baseline: Column, wall_ms: Column, ts: Column) -> list[Column]:
    """Columns of a telemetry row."""
    saved = F.floor(F.greatest(baseline - actual, F.lit(0).cast("long")) / 4).cast("long")
    return [ts.alias("ts"), command.alias("command"), actual.alias("actual_bytes"), baseline.alias("baseline_bytes"), strategy(command).alias("baseline_strategy"), wall_ms.alias("wall_ms"), saved.alias("tokens_saved")]


def envelope(command: str, data: Column, version: str, fallback: bool = False) -> Column:
    """JSON of a command's result with its size in tokens."""
    body = F.to_json(data)
    flag = [F.lit(True).alias("fallback")] if fallback else []
    head = F.to_json(F.struct(F.lit(version).alias("version"), F.lit(command).alias("command"), F.lit("ok").alias("status"), *flag, fn.count_fast(body).alias("tokens")))
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"data":'), body, F.lit("}"))
