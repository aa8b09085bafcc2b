"""Where queries are registered, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import paths
from lodestrata.sources import adapters as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return src.table(spark, d, name)


def files(spark: SparkSession, d: str) -> DataFrame:
    return src.files(table(spark, d, "documents"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    return src.sources(table(spark, d, "documents"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return src.queries(table(spark, d, "conversations"))


def passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def text(value: str) -> str:
    """A string literal; line feeds and tabs spelt so that the SQL is one line."""
    return "'" + value.replace("'", "''") + "'"


def case(value: str, table_: dict, other: str = "NULL") -> str:
    return f"CASE {value} " + " ".join(f"WHEN {text(k) if isinstance(k, str) else k} THEN {text(v) if isinstance(v, str) else v}" for k, v in table_.items()) + f" ELSE {other} END"


DIRS = case("doc_id % 10", dict(enumerate(src.DIRS)))
ENDS = case("doc_id % 7", dict(enumerate(src.ENDS)))
FILES = f"files AS (SELECT doc_id AS file_id, {DIRS} || '/' || source || '/' || lang || '_' || doc_id || {ENDS} AS path, strlen(text) AS size, lang AS language, text AS content FROM documents)"
LINES = "lined AS (SELECT doc_id AS file_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text <> '')"
WORDS = "regexp_extract_all({0}, '[a-zA-Z_][a-zA-Z0-9_]*')"
NAME = "regexp_extract({0}, '([^/]*)$', 1)"


def stem_sql(path: str) -> str:
    n = NAME.format(path)
    return f"CASE WHEN regexp_matches({n}, '^.+\\.[^.]*$') THEN regexp_extract({n}, '^(.+)\\.[^.]*$', 1) ELSE {n} END"


def ext_sql(path: str) -> str:
    n = NAME.format(path)
    return f"CASE WHEN regexp_matches({n}, '^.+\\.[^.]*$') THEN regexp_extract({n}, '^.+\\.([^.]*)$', 1) END"


def split_sql(w: str) -> str:
    """Identifier parts: letters are looked at one by one, a part begins where the rule says."""
    snake = f"list_filter(string_split({w}, '_'), lambda p: p <> '')"
    camel = f"string_split(regexp_replace(regexp_replace({w}, '(\\p{{Lu}}+)(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'), '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), ' ')"
    parts = f"CASE WHEN contains({w}, '_') THEN {snake} ELSE {camel} END"
    return f"CASE WHEN len({parts}) >= 2 THEN list_prepend(lower({w}), list_transform({parts}, lambda p: lower(p))) ELSE [lower({w})] END"


def terms_sql(source: str, key: str, column: str) -> str:
    """(key, term) of a table's texts."""
    return f"SELECT {key}, unnest({split_sql('w')}) AS term FROM (SELECT {key}, unnest({WORDS.format(column)}) AS w FROM {source})"


def bm25_sql(source: str, key: str) -> str:
    """CTEs up to ``post(term, key, score)`` over source(key, content)."""
    return f"""terms AS ({terms_sql(source, key, "content")}), tf AS (SELECT {key}, term, count(*) AS tf FROM terms GROUP BY ALL),
 dl AS (SELECT s.{key}, coalesce(x.n, 0) AS dl FROM {source} s LEFT JOIN (SELECT {key}, count(*) AS n FROM terms GROUP BY ALL) x USING ({key})),
 st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
 post AS (SELECT term, {key}, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS score FROM tf JOIN dl USING ({key}) JOIN df USING (term) CROSS JOIN st)"""


PENALTY = f"""round((CASE WHEN regexp_matches(path, '{paths.TEST}') THEN 0.3 ELSE 1 END)::DOUBLE * (CASE WHEN contains(path, '/compat/') OR contains(path, '/_compat/') OR contains(path, '/legacy/') THEN 0.3 ELSE 1 END)::DOUBLE
 * (CASE WHEN contains(path, '/examples/') OR contains(path, '/example/') OR contains(path, '/docs_src/') THEN 0.3 ELSE 1 END)::DOUBLE
 * (CASE WHEN regexp_matches(path, '(^|/)(__init__\\.py|package-info\\.java)$') THEN 0.5 ELSE 1 END)::DOUBLE * (CASE WHEN path LIKE '%.d.ts' THEN 0.7 ELSE 1 END)::DOUBLE, 6)"""
PART_EDGES = "edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey)"
DOT = "round(list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6)"
_A, _B = "coalesce(string_split(text, ' ')[1], '')", "coalesce(string_split(text, ' ')[2], '')"
ASKED = f"""asked AS (SELECT query_id, CASE query_id % 8 WHEN 1 THEN {_A} || ' ' || {_B} WHEN 2 THEN {_A} || '_' || {_B} WHEN 3 THEN {_A} || '::' || {_B} WHEN 4 THEN 'Auth of db ' || {_A} || ' ' || {_B}
 WHEN 5 THEN '$' || {_A} || ' in ' || {_B} WHEN 6 THEN upper(left({_A} || {_B}, 1)) || lower(substr({_A} || {_B}, 2)) WHEN 7 THEN {_A} || ' [x] or ' || {_B} ELSE text END AS query
 FROM (SELECT conv_id * 100 + turn AS query_id, text FROM conversations))"""
_T, _U = "((doc_id * 13 + 5) % 199)", "((doc_id * 4 + 1) % 200)"


def filled(template: str) -> str:
    """A template of ``sources`` with its numbers, over documents."""
    made = text(template)
    made = " || chr(10) || ".join(f"'{p}'" for p in made[1:-1].split("\n"))
    made = made.replace("\t", "' || chr(9) || '")
    return f"replace(replace(replace({made}, '{{i}}', doc_id::VARCHAR), '{{t}}', {_T}::VARCHAR), '{{u}}', {_U}::VARCHAR)"


_EXT = case("doc_id % 4", dict(enumerate(src.SOURCES)))
SOURCES = f"sources AS (SELECT doc_id AS file_id, 'pkg' || (doc_id % 10) || (CASE WHEN doc_id % 9 = 0 THEN '/tests' ELSE '' END) || '/m' || doc_id || '.' || {_EXT} AS path, CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN {filled(t)}" for i, t in enumerate(src.SOURCES.values())) + f" END AS content, {_T} AS t, {_U} AS u FROM documents)"
# What the sources define, written down by hand: doc_id % 4, symbol, parent, depth, name, kind, first and last line, signature.
_DEFINED = [
    (0, 0, -1, 0, "Thing{i}", "struct", 5, 7, "pub struct Thing{i} {"), (0, 1, -1, 0, "build{i}", "function", 10, 13, "pub fn build{i}() -> i32 {"), (1, 0, -1, 0, "Box{i}", "class", 5, 7, "class Box{i}:"), (1, 1, 0, 1, "open{i}", "function", 6, 7, "def open{i}(self):"),
    (1, 2, -1, 0, "helper{i}", "function", 10, 11, "def helper{i}(a):"), (2, 0, -1, 0, "View{i}", "class", 4, 8, "class View{i} {"), (2, 1, 0, 1, "draw{i}", "method", 5, 7, "draw{i}(x) {"), (2, 2, -1, 0, "helper{i}", "function", 10, 12, "export function helper{i}(a) {"),
    (3, 0, -1, 0, "Start{i}", "function", 8, 10, "func Start{i}() {"), (3, 1, -1, 0, "Stop{i}", "method", 12, 13, "func (s *S) Stop{i}() {"),
]
SYMBOLS = (
    "made(r, symbol, parent, depth, name, kind, start_line, end_line, signature) AS (VALUES " + ", ".join(f"({', '.join(text(v) if isinstance(v, str) else str(v) for v in row)})" for row in _DEFINED) + "), "
    "symbols AS (SELECT file_id, path, symbol, parent, depth, replace(name, '{i}', file_id::VARCHAR) AS name, kind, start_line, end_line, replace(signature, '{i}', file_id::VARCHAR) AS signature FROM sources JOIN made ON file_id % 4 = r)"
)
_IMPORTED = [(0, 0, "crate::m{t}"), (1, 0, "m{t}"), (1, 1, "m{u}"), (2, 0, "./m{t}"), (2, 1, "fs"), (3, 0, "fmt"), (3, 1, "m{t}")]
IMPORTS = (
    "used(r, position, raw) AS (VALUES " + ", ".join(f"({r}, {p}, {text(w)})" for r, p, w in _IMPORTED) + "), "
    "imports AS (SELECT file_id, path, position, replace(replace(raw, '{t}', t::VARCHAR), '{u}', u::VARCHAR) AS raw FROM sources JOIN used ON file_id % 4 = r)"
)
# A file imports the file of the number it names, if there is one and it isn't the file itself.
CODE_EDGES = "code_edges AS (SELECT DISTINCT s.file_id AS src, d.file_id AS dst FROM (SELECT file_id, t AS n FROM sources UNION ALL SELECT file_id, u FROM sources WHERE file_id % 4 = 1) s JOIN sources d ON d.file_id = s.n AND d.file_id <> s.file_id)"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
