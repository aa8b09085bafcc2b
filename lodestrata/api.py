"""One door to the operators for a caller with a folder or table of files: every command gives a dictionary or rows.

``run`` answers a command as a JSON envelope. Where a command fails from within, a plainer answer takes its place and says so.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata import __version__
from lodestrata.functions import code as structure
from lodestrata.functions import text as fn
from lodestrata.operators import changes, code, evaluate, lines, logs, packages, retrieval
from lodestrata.sources import stores

SUGGESTIONS = {"file_not_found": "Check the file path. List files with the find command.", "index_corrupted": "Rebuild the index."}


class Workspace:
    """Files, and their index if there is one. files(file_id, path, content); vocabulary(token, vec) enables dense search."""

    def __init__(self, files: DataFrame, folder: str | None = None, vocabulary: DataFrame | None = None) -> None:
        self.spark, self.files, self.folder, self.vocabulary = files.sparkSession, files, folder, vocabulary
        self._tables: dict[str, DataFrame] | None = None

    @classmethod
    def of(cls, spark: SparkSession, root: str, **more) -> Workspace:
        return cls(stores.walk(spark, root), **more)

    def tables(self) -> dict[str, DataFrame]:
        """The kept index if it is valid, else one that is made on the way."""
        if self._tables is None:
            kept = stores.load(self.spark, self.folder) if self.folder else None
            self._tables = kept if kept is not None and stores.is_valid(self.files, kept["files"]) else stores.build(self.files)
        return self._tables

    def index_stats(self) -> dict:
        """Whether the kept index holds, and its meta row."""
        kept = stores.load(self.spark, self.folder)
        meta = {} if kept is None else stores.latest(self.spark, self.folder)
        return {"valid": kept is not None and stores.is_valid(self.files, kept["files"]), **meta}

    def index(self, rebuild: bool = False) -> str:
        state, self._tables = stores.index(self.files, self.folder, rebuild)
        return state

    def cards(self) -> DataFrame:
        c = self.tables()["chunks"]
        return c.select(retrieval.chunk_id(F.col("file_id"), F.col("chunk")).alias("chunk_id"), "path", "content", "start_line", "end_line")

    def dense(self, queries: DataFrame, k: int) -> DataFrame | None:
        if self.vocabulary is None:
            return None
        texts = retrieval.enriched(self.tables()["chunks"])
        return retrieval.nearest(retrieval.embed(texts, self.vocabulary, "chunk_id"), retrieval.embed(queries.withColumnRenamed("query", "text"), self.vocabulary, "query_id"), k)

    def search(self, query: str, top_k: int = 5, budget: int | None = None, token: str | None = None, mode: str | None = None, alpha: float | None = None) -> dict:
        asked = self.spark.createDataFrame([(0, query, token)], "query_id long, query string, token string")
        picked = asked.select(fn.detect_mode(F.col("query")).alias("m"), fn.page_skip(F.col("token")).alias("s")).first()
        mode, skip = mode or picked["m"], picked["s"]
        if mode == "literal":
            rows = lines.scan(self.files, query)
            page = lines.page(rows, ["path", "line"], top_k, skip, budget, fn.count_fast(F.col("snippet"))).drop("file_id").collect()
            return self._page([r.asDict() for r in page], rows.count())
        if mode == "structural":
            rows, said = code.structural(self.files, query, 5 * top_k)
            found = [r.asDict() | {"relevance": 1.0} for r in rows.drop("file_id").collect()]
            return self._page(found[:top_k], len(found), said.first()["warning"])
        t, queries = self.tables(), asked.select("query_id", "query")
        override = None if alpha is None else F.lit(float(alpha))
        ranked = retrieval.hybrid(queries, self.cards(), t["postings"], self.dense(queries, 5 * top_k), t["symbols"], t["nodes"], t["edges"], top_k, override).cache()
        page = retrieval.search(ranked, self.cards(), queries, top_k, skip, budget).orderBy("rank").drop("query_id").collect()
        out = self._page([r.asDict() for r in page], ranked.count())
        ranked.unpersist()
        return out

    @staticmethod
    def _page(rows: list[dict], total: int, warning: str | None = None) -> dict:
        token = rows[-1].get("token") if rows else None
        matches = [{k: v for k, v in r.items() if k not in ("token", "rank")} for r in rows]
        return {"matches": matches, "total_matches": total, "returned": len(rows), "budget_used": sum(len(r["snippet"].encode()) // 4 for r in rows), "continuation_token": token, "warning": warning}

    def read(self, file: str, **options) -> dict:
        found = code.read(self.files.where(F.col("path") == file), **options).collect()
        if not found:
            raise FileNotFoundError(file)
        return found[0].asDict(recursive=True)

    def find(self, pattern: str | None = None, depth: int | None = None, changed: DataFrame | None = None, related_to: str | None = None, outline: bool = False, budget: int | None = None, flat: bool = True) -> dict:
        score = None
        if related_to is not None and self.vocabulary is not None:
            near = self.dense(self.spark.createDataFrame([(0, related_to)], "query_id long, query string"), 1 << 30)
            score = code.relevance(near)
        rows = code.find(self.files, outline, score, pattern=pattern, depth=depth, changed=changed)
        stats = code.find_stats(rows, budget).first().asDict()
        kept = rows if budget is None else lines.retain(rows, [], [F.desc(F.coalesce("relevance", F.lit(0.0))), F.col("path")], code.find_cost(F.col("path")), budget)
        listed = kept.drop("file_id").collect()
        return {"stats": stats, **({"flat": [r.asDict() for r in listed]} if flat else {"tree": code.tree(listed)})}

    def exists(self, pattern: str) -> dict:
        asked = self.spark.createDataFrame([(0, pattern)], "query_id long, query string")
        row = lines.exists(self.files.select(F.explode(fn.tokens(F.col("content"))).alias("term")), asked).first()
        return {"exists": row["exists"], "confidence": row["confidence"], "pattern": pattern}

    def outline(self, path: str = "", depth: int | None = None, kind: str | None = None) -> dict:
        own = self.files.where((F.col("path") == path) | F.col("path").startswith(f"{path}/") | F.lit(path in ("", ".")))
        return {"symbols": [r.asDict() for r in code.outline(own, depth, kind).drop("file_id").orderBy("path", "symbol").collect()]}

    def context(self, target: str = "", **options) -> dict:
        t = self.tables()
        return packages.context(self.files, target, t["refs"], t["nodes"], t["edges"], **options)

    def impact(self, path: str, **options) -> dict:
        t = self.tables()
        return packages.impact(self.files, t["nodes"], t["edges"], path, **options)

    def explain(self, name: str, budget: int | None = None) -> dict:
        return packages.explain(self.files, self.tables()["symbols"], name, budget)

    def edit(self, file: str, pairs: list[tuple[str, str]], **options) -> dict:
        found = changes.edit(self.files.where(F.col("path") == file), pairs, **options).collect()
        if not found:
            raise FileNotFoundError(file)
        return found[0].asDict(recursive=True)

    def rename(self, old: str, new: str, include_tests: bool = False) -> dict:
        if not changes.defined(self.files, old):
            raise ValueError(f"symbol '{old}' not found in codebase")
        found = [r.asDict(recursive=True) for r in changes.rename(self.files, old, new, include_tests).drop("file_id").orderBy("path").collect()]
        return {"old_name": old, "new_name": new, "files_changed": len(found), "total_replacements": sum(r["replacements"] for r in found), "changes": found}

    def diff(self, old: DataFrame, budget: int | None = None, stat_only: bool = False) -> dict:
        """Against an older snapshot(path, content)."""
        pairs = changes.versions(old, self.files.select("path", "content"))
        rows = changes.diff(pairs)
        named = changes.changed_functions(pairs, rows)
        row = changes.stats(pairs, rows, named).first().asDict()
        notes = [r["note"] for r in changes.notes(pairs).orderBy("path", "note").collect()]
        hunks = None if stat_only or not row["files_changed"] else [r.asDict(recursive=True) for r in changes.hunks(rows, named, budget).orderBy("path").collect()]
        return {"summary": row.pop("summary"), "stats": row, "semantic_notes": notes, "hunks": hunks}

    def run(self, command: list[str], auto_json: bool = False, raw: bool = False, full: bool = False) -> dict:
        if auto_json:
            row = self.spark.createDataFrame([(command,)], "c array<string>").select(logs.inject_json(F.col("c")).alias("c")).first()
            command = row["c"]
        return logs.parse(stores.execute(self.spark, command), raw=raw, full=full).first().asDict(recursive=True)


# Commands that have a plainer answer.
FALLBACKS = ("search", "read", "find", "exists", "outline", "diff", "run")


def code_of(error: Exception) -> str:
    kinds = {FileNotFoundError: "file_not_found", ValueError: "invalid_argument", SyntaxError: "parse_error", OSError: "io_error"}
    return next((c for k, c in kinds.items() if isinstance(error, k)), "internal_error")


def plainer(space: Workspace, command: str, options: dict) -> dict | None:
    """An answer without index, structure or parsing."""
    files = space.files
    if command == "search":
        return {"raw": [r.asDict() for r in lines.scan(files, fn.quoted(options["query"])).drop("file_id").orderBy("path", "line").collect()], "source": f"scan {options['query']}"}
    if command == "read":
        row = files.where(F.col("path") == options["file"]).first()
        return row and {"raw": row["content"], "source": f"read {options['file']}"}
    if command in ("find", "exists", "outline", "diff"):
        return {"raw": [r["path"] for r in files.select("path").orderBy("path").collect()], "source": "list"}
    return None


def run(space: Workspace, command: str, /, telemetry: str | None = None, errors: str | None = None, **options) -> str:
    """The envelope of a command: its data; or with ``fallback`` a plainer answer where the engine failed; or an error.

    Telemetry and errors are appended as JSON lines to the folders that are given.
    """
    began, fallback = time.monotonic(), False
    try:
        data = getattr(space, command)(**options)
    except (ValueError, FileNotFoundError) as e:
        return _error(command, e)
    except Exception as e:  # the engine's own fault: a plainer answer is better than none
        data, fallback = (plainer(space, command, options) if command in FALLBACKS else None), True
        if data is None:
            return _error(command, e)
        if errors:
            size = len(json.dumps(data, ensure_ascii=False, default=str).encode())
            stores.append_json(space.spark.createDataFrame([(int(time.time()), command, str(e)[:2000], data["source"], size)], stores.ERRORS), errors)
    body = json.dumps(data, ensure_ascii=False, default=str, separators=(",", ":"))
    if telemetry:
        _log(space, command, data, len(body.encode()), int(1000 * (time.monotonic() - began)), telemetry)
    head = {"version": __version__, "command": command, "status": "ok", **({"fallback": True} if fallback else {}), "tokens": len(body.encode()) // 4}
    return json.dumps(head)[:-1] + f', "data": {body}}}'


def _error(command: str, e: Exception) -> str:
    kind = code_of(e)
    detail = {"code": kind, "message": str(e)} | ({"suggestion": SUGGESTIONS[kind]} if kind in SUGGESTIONS else {})
    return json.dumps({"version": __version__, "command": command, "status": "error", "error": detail}, ensure_ascii=False)


def _log(space: Workspace, command: str, data: dict, size: int, ms: int, folder: str) -> None:
    stats = data.get("stats") or {}
    matches = data.get("matches")
    facts = (data.get("total_matches"), None if matches is None else len({m["path"] for m in matches}), data.get("bytes"), data.get("output_tokens_saved"), stats.get("total_files"), stats.get("additions"), stats.get("deletions"), len(data["symbols"]) if "symbols" in data else None)
    names = "total_matches unique_files bytes output_tokens_saved total_files additions deletions symbols".split()
    row = space.spark.createDataFrame([(int(time.time()), command, size, ms, facts)], f"ts long, command string, actual long, wall_ms long, facts struct<{','.join(f'{n}:long' for n in names)}>")
    c = {n: F.col(n) for n in row.columns}
    stores.append_json(row.select(*evaluate.entry(c["command"], c["actual"], evaluate.baseline_bytes(c["command"], c["actual"], c["facts"]), c["wall_ms"], c["ts"])), folder)


def batch(space: Workspace, commands: DataFrame) -> list[dict]:
    """Results of stores.commands rows, one after the other: id, status, data or error."""
    names = {"search": ("query", "top_k", "budget"), "read": ("file", "skeleton", "only_hash", "outlined", "budget", "if_changed", "mode"), "exists": ("query",), "find": ("pattern", "depth", "budget"), "outline": ("path",)}
    out = []
    for r in commands.collect():
        if r["error"]:
            out.append({"id": r["id"], "status": "error", "error": r["error"]})
            continue
        given = r["command"].asDict()
        given |= {"only_hash": given["hash"], "outlined": given["outline"]}
        options = {k: given[k] for k in names[r["cmd"]] if given[k] is not None}
        if r["cmd"] == "exists":
            options = {"pattern": given["pattern"] or ""}
        answer = json.loads(run(space, r["cmd"], **options))
        out.append({"id": r["id"], "status": answer["status"]} | ({"data": answer["data"]} if answer["status"] == "ok" else {"error": answer["error"]["message"]}))
    return out


def supported(ext: str) -> bool:
    """Whether the engine knows a language's structure."""
    return ext in structure._MARKS


def compare(space: Workspace, root: str) -> dict:
    """Six tasks of the engine beside plain commands over the same folder: bytes, times and what is saved."""
    first = next((p for p in ("src/main.rs",) if os.path.exists(os.path.join(root, p))), None) or space.files.select("path").orderBy("path").first()["path"]
    said = "test result: ok. 50 passed; 0 failed; 0 ignored"
    tasks = [
        ("search_literal", "search", {"query": "fn main", "mode": "literal", "top_k": 1000}, ["grep", "-rn", "fn main", root]), ("search_top_k", "search", {"query": "hash", "mode": "literal", "top_k": 5}, ["grep", "-rn", "hash", root]),
        ("read_skeleton", "read", {"file": first, "skeleton": True}, ["cat", os.path.join(root, first)]), ("read_full_file", "read", {"file": first}, ["cat", os.path.join(root, first)]),
        ("find_files", "find", {}, ["find", root, "-type", "f"]), ("run_parsed", "run", {"command": ["echo", said]}, ["echo", said]),
    ]
    rows = []
    for name, command, options, plain in tasks:
        began = time.monotonic()
        size = len(run(space, command, **options).encode())
        ms, began = int(1000 * (time.monotonic() - began)), time.monotonic()
        base = stores.execute(space.spark, plain).select(F.octet_length("stdout")).first()[0]
        rows.append((name, size, base, ms, int(1000 * (time.monotonic() - began))))
    results = space.spark.createDataFrame(rows, "name string, bytes long, baseline_bytes long, ms long, baseline_ms long")
    each = results.select("name", F.floor(F.col("bytes") / 4).alias("tokens"), F.floor(F.col("baseline_bytes") / 4).alias("baseline_tokens"), "ms", "baseline_ms")
    return {"summary": evaluate.side_by_side(results).first().asDict(), "tasks": [r.asDict() for r in each.collect()]}


def judge(space: Workspace, path: str, k: int = 10) -> dict:
    """NDCG of the engine's own search over a labelled set: all queries in one job."""
    queries, labels = stores.dataset(space.spark, path)
    t = space.tables()
    ranked = retrieval.hybrid(queries.select("query_id", "query"), space.cards(), t["postings"], space.dense(queries.select("query_id", "query"), 5 * k), t["symbols"], t["nodes"], t["edges"], k)
    found = ranked.where(F.col("rank") <= k).join(space.cards().select("chunk_id", "path"), "chunk_id").select("query_id", "path", "rank")
    scores = evaluate.ndcg(found, labels, queries).cache()
    rows = {r["category"]: r.asDict() for r in evaluate.by_category(scores).collect()}
    missed = [r["query"] for r in scores.where("ndcg10 = 0").join(queries.select("query_id", "query"), "query_id").orderBy("query_id").collect()]
    whole = rows.pop(None, None)
    return {"all": whole, "by_category": rows, "misses": missed}


def plain(rows: list[dict]) -> str:
    """Rows as a table of text, columns in the order of the first row."""
    names = list(rows[0]) if rows else []
    shown = [[f"{r[n]:.3f}" if isinstance(r[n], float) else "" if r[n] is None else str(r[n]) for n in names] for r in rows]
    wide = [max([len(n), *(len(s[i]) for s in shown)]) for i, n in enumerate(names)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(line, wide, strict=True)).rstrip() for line in [names, *shown])
