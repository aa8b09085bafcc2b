"""Queries on source files: symbols, imports, references, edits and differences. What the sources hold is written down by hand in ``base``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as fn
from lodestrata.operators import changes, code
from lodestrata.plans.base import IMPORTS, SOURCES, SYMBOLS, query, sources, table, with_

C = F.col


@query("r21_symbols", with_(SOURCES, SYMBOLS) + "SELECT file_id, symbol, parent, depth, name, kind, start_line, end_line, signature FROM symbols")
def symbols(spark, d):
    return code.symbols(sources(spark, d)).drop("path")


@query("p13_kind", with_(SOURCES, SYMBOLS) + "SELECT path, name, start_line FROM symbols WHERE kind = 'method'")
def by_kind(spark, d):
    return code.outline(sources(spark, d), kind="method").select("path", "name", "start_line")


@query("r29_outline", with_(SOURCES, SYMBOLS) + "SELECT path, count(*) AS n, string_agg(kind || ' ' || name, ';' ORDER BY symbol) AS symbols FROM symbols WHERE file_id % 9 <> 0 GROUP BY path")
def outline(spark, d):
    rows = code.outline(sources(spark, d), depth=2)
    one = F.transform(F.array_sort(F.collect_list(F.struct("symbol", "kind", "name"))), lambda s: F.concat(s["kind"], F.lit(" "), s["name"]))
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.array_join(one, ";").alias("symbols"))


@query("r22_imports", with_(SOURCES, IMPORTS) + "SELECT file_id, position::INT AS position, raw FROM imports")
def imports(spark, d):
    return code.imports(sources(spark, d)).select("file_id", "position", "raw")


@query("anchor_links", """SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY n) - 1)::INT AS position, href FROM (SELECT page_id, generate_subscripts(l, 1) AS n, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS l FROM pages))""")
def anchor_links(spark, d):
    return code.anchors(table(spark, d, "pages"))


@query("r25_skeleton", with_(SOURCES, SYMBOLS) + "SELECT file_id, string_agg(signature || '  // L' || start_line, chr(10) ORDER BY symbol) AS text FROM symbols WHERE parent < 0 GROUP BY file_id")
def skeleton(spark, d):
    return code.skeletons(sources(spark, d)).select("file_id", "text")


@query("r24_strip", with_(SOURCES) + """SELECT file_id, md5(CASE file_id % 4 WHEN 0 THEN 'use crate::m' || t || ';' || chr(10) || chr(10) || 'pub struct Thing' || file_id || ' {' || chr(10) || '    x: i32,' || chr(10) || '}' || chr(10) || chr(10) || 'impl Thing' || file_id || ' {' || chr(10) || '    pub fn build' || file_id || '() -> i32 {' || chr(10) || chr(10) || '        ' || file_id || chr(10) || '    }' || chr(10) || '}' || chr(10)
 WHEN 1 THEN replace(replace(content, chr(10) || chr(10) || chr(10), chr(10) || chr(10)), '  # open', '  ') ELSE content END) AS hash FROM sources""")
def strip(spark, d):
    return sources(spark, d).select("file_id", F.md5(code.stripped(C("content"), C("path"))).alias("hash"))


@query("r23_snap", with_(SOURCES) + "SELECT file_id, CASE file_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 6 WHEN 2 THEN 5 ELSE 8 END::INT AS start_line, CASE file_id % 4 WHEN 0 THEN 13 WHEN 1 THEN 7 WHEN 2 THEN 7 ELSE 10 END::INT AS end_line, CASE file_id % 4 WHEN 0 THEN 'build' WHEN 1 THEN 'open' WHEN 2 THEN 'draw' ELSE 'Start' END || file_id AS name FROM sources")
def snap(spark, d):
    line = F.array(*map(F.lit, (12, 7, 6, 9)))[(C("file_id") % 4).cast("int")]
    s = sources(spark, d).withColumn("line", line)
    return s.withColumn("s", code.snapped(C("content"), C("path"), C("line"), "function")).select("file_id", "s.start_line", "s.end_line", "s.name")


@query("r40_body", with_(SOURCES) + "SELECT file_id, 'def helper' || file_id || '(a):' || chr(10) || '    return m' || t || '.run(a)' AS body FROM sources WHERE file_id % 4 = 1")
def body(spark, d):
    return sources(spark, d).where("file_id % 4 = 1").select("file_id", code.body(C("content"), C("path"), F.lit(11)).alias("body"))


@query("r20_structural", with_(SOURCES) + """SELECT path, line, match FROM (SELECT path, 9 AS line, 'fmt.Println(' || file_id || ')' AS match FROM sources WHERE file_id % 4 = 3 UNION ALL SELECT path, 11, 'm' || t || '.run(a)' FROM sources WHERE file_id % 4 = 1) ORDER BY path, line LIMIT 50""")
def structural(spark, d):
    return code.structural(sources(spark, d), "$M.$F($X)", 1 << 20)[0].where(~C("match").startswith("(")).orderBy("path", "line").limit(50).select("path", "line", "match")


@query("a7_references", with_(SOURCES, SYMBOLS, "names AS (SELECT DISTINCT name FROM symbols WHERE strlen(name) >= 3)", "words AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '[\\p{L}\\p{N}_]+')) AS name FROM sources)") + "SELECT name, count(file_id) AS ref_count FROM names LEFT JOIN words USING (name) GROUP BY name")
def references(spark, d):
    s = sources(spark, d)
    return code.references(code.symbols(s), s)


@query("j13_entry_points", with_(SOURCES, SYMBOLS, "words AS (SELECT DISTINCT file_id AS f, unnest(regexp_extract_all(content, '[\\p{L}\\p{N}_]+')) AS name FROM sources)", "refs AS (SELECT name, count(*) AS ref_count FROM words GROUP BY name)")
       + "SELECT name, kind, path, start_line AS line, ref_count FROM symbols JOIN refs USING (name) ORDER BY ref_count DESC, CASE kind WHEN 'class' THEN 5 WHEN 'struct' THEN 4 WHEN 'function' THEN 3 WHEN 'method' THEN 2 ELSE 0 END DESC, path, start_line LIMIT 10")
def entry_points(spark, d):
    s = sources(spark, d)
    found = code.symbols(s)
    return code.entry_points(found, code.references(found, s)).drop("signature")


@query("f17_kind_priority", with_(SOURCES, SYMBOLS) + "SELECT kind, CASE kind WHEN 'class' THEN 5 WHEN 'struct' THEN 4 WHEN 'function' THEN 3 ELSE 2 END AS priority, count(*) AS n FROM symbols GROUP BY kind")
def kind_priority(spark, d):
    rows = code.symbols(sources(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))
    return rows.select("kind", fn.kind_priority(C("kind")).alias("priority"), "n")


@query("r41_definitions", with_(SOURCES, SYMBOLS) + "SELECT name, string_agg(path || ':' || start_line || ':' || kind, ';' ORDER BY path, start_line) AS defs FROM symbols GROUP BY name")
def definitions(spark, d):
    text = F.array_join(F.transform("defs", lambda x: F.concat_ws(":", x["path"], x["line"], x["kind"])), ";")
    return code.by_name(code.symbols(sources(spark, d))).select("name", text.alias("defs"))


# Of the scripts the two lines of the function are changed; the others lack it, so they are changed as a whole, and have two such lines.
@query("r28_scoped_edit", with_(SOURCES) + "SELECT file_id, 2 AS n FROM sources WHERE file_id % 2 = 0")
def scoped_edit(spark, d):
    s = sources(spark, d).where("file_id % 2 = 0").withColumn("content", F.regexp_replace("content", r"(View|draw|helper|Thing|build)\d+", "$1"))
    return changes.edit(s, [("a", "b")], every=True, scope="helper").select("file_id", C("total_replacements").alias("n"))


@query("j14_lookup", with_(SOURCES, SYMBOLS, "w AS (SELECT file_id AS query_id, CASE file_id % 3 WHEN 0 THEN 'Box' || file_id WHEN 1 THEN 'BOX' || file_id ELSE 'helper' || (file_id + 1) END AS name FROM sources)")
       + "SELECT query_id, path, start_line, symbols.name FROM w JOIN symbols ON w.name = symbols.name UNION ALL SELECT query_id, path, start_line, symbols.name FROM w JOIN symbols ON lower(w.name) = lower(symbols.name) WHERE w.name NOT IN (SELECT name FROM symbols)")
def lookup(spark, d):
    i = C("file_id")
    s = sources(spark, d)
    wanted = s.select(i.alias("query_id"), F.when(i % 3 == 0, F.concat(F.lit("Box"), i)).when(i % 3 == 1, F.concat(F.lit("BOX"), i)).otherwise(F.concat(F.lit("helper"), i + 1)).alias("name"))
    return code.lookup(code.symbols(s), wanted).select("query_id", "path", "start_line", "name")


# ---- versions: in the older one every fifth file lacks its last line, every seventh has another number, every eleventh is not there yet
_PAIRS = "pairs AS (SELECT *, file_id % 11 = 0 AS fresh, file_id % 5 = 0 AS longer, file_id % 7 = 0 AS other FROM sources)"


def pairs(spark, d):
    s = sources(spark, d)
    i = C("file_id")
    text = F.when(i % 5 == 0, F.regexp_replace("content", "[^\n]*\n$", "")).otherwise(C("content"))
    text = F.when(i % 7 == 0, F.replace(text, F.concat(F.lit("Start"), i), F.lit("Begin"))).otherwise(text)
    return changes.versions(s.where(i % 11 != 0).select("path", text.alias("content")), s.select("path", "content"))


@query("r26_diff", with_(SOURCES, _PAIRS) + """SELECT path, type, line, coalesce(o, n) AS text FROM (SELECT path, 'addition' AS type, line, NULL AS o, n FROM (SELECT path, generate_subscripts(l, 1)::INT AS line, unnest(l) AS n FROM (SELECT path, string_split(regexp_replace(content, chr(10) || '$', ''), chr(10)) AS l FROM pairs WHERE fresh))
 UNION ALL SELECT path, 'addition', len(string_split(content, chr(10)))::INT - 1, NULL, string_split(content, chr(10))[-2] FROM pairs WHERE NOT fresh AND longer
 UNION ALL SELECT path, 'addition', 8, NULL, 'func Start' || file_id || '() {' FROM pairs WHERE NOT fresh AND other AND file_id % 4 = 3 UNION ALL SELECT path, 'deletion', 8, 'func Begin() {', NULL FROM pairs WHERE NOT fresh AND other AND file_id % 4 = 3)""")
def diff(spark, d):
    return changes.diff(pairs(spark, d)).select("path", "type", "line", F.coalesce("old", "new").alias("text"))


@query("a14_diff_stats", with_(SOURCES, _PAIRS) + """SELECT sum(a)::BIGINT AS additions, sum(x)::BIGINT AS deletions, count(*) AS files_changed FROM (SELECT CASE WHEN fresh THEN len(string_split(content, chr(10))) - 1 ELSE longer::INT + (other AND file_id % 4 = 3)::INT END AS a, CASE WHEN fresh THEN 0 ELSE (other AND file_id % 4 = 3)::INT END AS x FROM pairs) WHERE a + x > 0""")
def diff_stats(spark, d):
    p = pairs(spark, d)
    rows = changes.diff(p)
    return changes.stats(p, rows, changes.changed_functions(p, rows)).select("additions", "deletions", "files_changed")


@query("j8_symbol_notes", with_(SOURCES, _PAIRS, SYMBOLS) + """SELECT path, path || ': new symbol `' || name || '`' AS note FROM symbols JOIN pairs USING (path) WHERE fresh AND parent < 0 UNION ALL SELECT path, path || ': new symbol `Start' || file_id || '`' FROM pairs WHERE NOT fresh AND NOT longer AND other AND file_id % 4 = 3 UNION ALL SELECT path, path || ': removed symbol `Begin`' FROM pairs WHERE NOT fresh AND NOT longer AND other AND file_id % 4 = 3""")
def notes(spark, d):
    # Without its last line a function's end is missing, so such files are left to the line diff.
    return changes.notes(pairs(spark, d).where(~(F.regexp_extract("path", r"m(\d+)\.", 1).cast("long") % 5 == 0) | (C("old") == "")))


@query("j5_changed_functions", with_(SOURCES, _PAIRS, SYMBOLS) + """SELECT path, name FROM symbols JOIN pairs USING (path) WHERE parent < 0 AND (fresh OR (NOT fresh AND ((longer AND end_line = len(string_split(content, chr(10))) - 1) OR (other AND symbols.file_id % 4 = 3 AND start_line = 8))))""")
def changed_functions(spark, d):
    p = pairs(spark, d)
    return changes.changed_functions(p, changes.diff(p)).select("path", "name")


@query("r27_syntax", with_(SOURCES) + "SELECT file_id, file_id % 2 = 0 AS valid FROM sources")
def syntax(spark, d):
    s = sources(spark, d)
    made = F.when(C("file_id") % 2 == 1, F.concat("content", F.lit("(\n"))).otherwise(C("content"))
    return s.select("file_id", code.syntax_error(made, C("path")).isNull().alias("valid"))


@query("r38_edit", with_(SOURCES) + """SELECT file_id, CASE WHEN file_id % 4 IN (1, 2) THEN (CASE WHEN file_id % 4 = 1 THEN (2 + (u % 1)) ELSE 1 END) ELSE 0 END::INT AS total_replacements, md5(CASE WHEN file_id % 4 IN (1, 2) THEN replace(content, 'helper', 'aide') ELSE content END) AS hash_after FROM sources""")
def edit(spark, d):
    rows = changes.edit(sources(spark, d), [("helper", "aide")], every=True)
    return rows.select("file_id", "total_replacements", "hash_after")


@query("r39_rename", with_(SOURCES) + "SELECT path, CASE file_id % 4 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS replacements FROM sources WHERE file_id % 4 IN (1, 2) AND file_id % 9 <> 0")
def rename(spark, d):
    return changes.rename(sources(spark, d), "helper", "aide").select("path", "replacements")


@query("r36_read", with_(SOURCES, SYMBOLS) + """SELECT path, file_id % 2 = 0 AS cached, (SELECT count(*) FROM made WHERE r = file_id % 4)::INT AS symbols, CASE WHEN file_id % 2 <> 0 THEN string_split(content, chr(10))[2] || chr(10) || string_split(content, chr(10))[3] END AS text FROM sources""")
def read(spark, d):
    s = sources(spark, d)
    whole = code.read(s, span="2-3").select("path", C("text"), "outline")
    seen = s.select("path", (C("file_id") % 2 == 0).alias("cached"))
    return whole.join(seen, "path").select("path", "cached", F.size("outline").alias("symbols"), F.when(~C("cached"), C("text")).alias("text"))
