"""Queries of scalar functions on texts, queries and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import paths
from lodestrata.functions import text as fn
from lodestrata.operators import lines, logs
from lodestrata.plans.base import ASKED, FILES, LINES, NAME, PENALTY, SOURCES, asked, case, ext_sql, files, query, sources, split_sql, stem_sql, table, terms_sql, with_

C = F.col
_SYMBOL = r"""(contains(q, '::') OR (starts_with(q, '_') AND strlen(q) > 1) OR (NOT regexp_matches(q, '\s') AND (regexp_matches(q, '^.+\p{Lu}') OR regexp_matches(q, '^\p{Lu}\p{Ll}') OR (contains(q, '_') AND regexp_matches(q, '^[\p{L}\p{N}_]+$')))))"""
_TRIMMED = r"trimmed AS (SELECT query_id, query, regexp_replace(query, '^\s+|\s+$', '', 'g') AS q, list_filter(regexp_split_to_array(query, '\s+'), lambda w: w <> '') AS ws FROM asked)"
_LONGER = " || ".join(["query", *[f"(CASE WHEN list_contains(list_transform(ws, lambda w: lower(w)), '{a}') THEN ' {b}' ELSE '' END)" for a, b in fn.SYNONYMS.items()]])


@query("f1_tokens", with_(f"terms AS ({terms_sql('(SELECT doc_id AS file_id, text FROM documents)', 'file_id', 'text')})") + "SELECT file_id, count(*) AS n, count(DISTINCT term) AS n_distinct, min(term) AS least, max(term) AS greatest FROM terms GROUP BY file_id")
def tokens(spark, d):
    t = files(spark, d).select("file_id", F.explode(fn.tokens(C("content"))).alias("term"))
    return t.groupBy("file_id").agg(F.count("*").alias("n"), F.countDistinct("term").alias("n_distinct"), F.min("term").alias("least"), F.max("term").alias("greatest"))


@query("f2_identifiers", "SELECT word, array_to_string(" + split_sql("word") + ", ' ') AS parts FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*')) || (CASE WHEN strlen(text) % 2 = 0 THEN 'HTTPResponse2Get' ELSE '_of_' || left(text, 1) END) AS word FROM conversations)")
def identifiers(spark, d):
    ending = F.when(F.octet_length("text") % 2 == 0, "HTTPResponse2Get").otherwise(F.concat(F.lit("_of_"), F.left("text", F.lit(1))))
    words = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0))).alias("w"), ending.alias("e"))
    return words.select(F.concat("w", "e").alias("word")).distinct().select("word", F.array_join(fn.split_identifier(C("word")), " ").alias("parts"))


@query("f4_enrich", with_(FILES) + f"""SELECT file_id, md5((CASE WHEN lang IS NULL THEN '' ELSE '[' || lang || '] ' END) || path || ' ' || array_to_string({split_sql('stem')}, ' ') || chr(10) || content || ' ' || stem || ' ' || array_to_string(list_reverse(dirs)[1:3], ' ')) AS hash
 FROM (SELECT *, {stem_sql('path')} AS stem, {case(ext_sql('path'), paths.by_extension(paths.LANGUAGES))} AS lang, list_filter(string_split(regexp_extract(path, '^(.*)/', 1), '/'), lambda x: x <> '') AS dirs FROM files)""")
def enrich(spark, d):
    return files(spark, d).select("file_id", F.md5(paths.enrich(C("content"), C("path"))).alias("hash"))


@query("f5_token_count", "SELECT doc_id AS file_id, (strlen(text) // 4)::BIGINT AS tokens FROM documents")
def token_count(spark, d):
    return files(spark, d).select("file_id", fn.count_fast(C("content")).alias("tokens"))


@query("f6_path_penalty", with_(FILES) + f"SELECT file_id, path, coalesce({ext_sql('path')}, '') AS ext, {PENALTY} AS penalty FROM files")
def path_penalty(spark, d):
    return files(spark, d).select("file_id", "path", F.coalesce(paths.extension(C("path")), F.lit("")).alias("ext"), F.round(paths.penalty(C("path")), 6).alias("penalty"))


@query("p10_test_files", with_(FILES, SOURCES) + f"""SELECT path, (contains(path, '/tests/') OR starts_with(path, 'tests/') OR contains(path, '__tests__/') OR starts_with(n, 'test_') OR contains(n, '_test.') OR contains(n, '.test.') OR contains(n, '.spec.')) AS workspace, regexp_matches(path, '{paths.TEST}') AS ranking,
 regexp_matches(path, '/(compat|_compat|legacy)/') AS compat, regexp_matches(path, '/(examples|example|docs_src)/') AS examples, n IN ('__init__.py', 'package-info.java') AS reexport FROM (SELECT path, {NAME.format('path')} AS n FROM (SELECT path FROM files UNION ALL SELECT path FROM sources))""")
def test_files(spark, d):
    p = C("path")
    flags = {"workspace": paths.is_workspace_test(p), "ranking": p.rlike(paths.TEST), "compat": p.rlike(paths.COMPAT), "examples": p.rlike(paths.EXAMPLES), "reexport": p.rlike(paths.REEXPORT)}
    return files(spark, d).select("path").unionByName(sources(spark, d).select("path")).select("path", *[v.alias(k) for k, v in flags.items()])


@query("s5_languages", with_(FILES, SOURCES) + f"""SELECT language, count(*) AS files FROM (SELECT {case(ext_sql('path'), paths.by_extension(paths.LANGUAGES, paths.LISTED))} AS language FROM (SELECT path FROM files UNION ALL SELECT path FROM sources)) GROUP BY language""")
def languages(spark, d):
    rows = files(spark, d).select("path").unionByName(sources(spark, d).select("path"))
    return rows.groupBy(paths.language(C("path"), listed=True).alias("language")).agg(F.count("*").alias("files"))


@query("p3_detect_mode", with_(ASKED, _TRIMMED) + f"SELECT query_id, CASE WHEN contains(q, '$') THEN 'structural' WHEN {_SYMBOL} THEN 'hybrid' WHEN len(ws) < 3 OR contains(q, '[') OR contains(q, '(') OR contains(q, '{{') OR contains(q, '|') OR contains(q, chr(92)) THEN 'literal' ELSE 'hybrid' END AS mode FROM trimmed")
def detect_mode(spark, d):
    return asked(spark, d).select("query_id", fn.detect_mode(C("query")).alias("mode"))


@query("p4_symbol_query", with_(ASKED, _TRIMMED) + f"SELECT query_id, query, {_SYMBOL} AS symbol FROM trimmed")
def symbol_query(spark, d):
    return asked(spark, d).select("query_id", "query", fn.is_symbol_query(C("query")).alias("symbol"))


@query("p5_synonyms", with_(ASKED, _TRIMMED) + f"SELECT query_id, {_LONGER} AS longer FROM trimmed")
def synonyms(spark, d):
    return asked(spark, d).select("query_id", fn.expand_synonyms(C("query")).alias("longer"))


@query("p6_alpha", with_(ASKED, _TRIMMED) + f"SELECT query_id, CASE WHEN query_id % 5 = 0 THEN round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, query_id::DOUBLE / 1000 - 1)), 6) WHEN {_SYMBOL} THEN 0.1 WHEN {_LONGER} <> query THEN 0.5 ELSE 0.6 END::DOUBLE AS alpha FROM trimmed")
def alpha(spark, d):
    return asked(spark, d).select("query_id", fn.resolve_alpha(C("query"), F.when(C("query_id") % 5 == 0, F.round(C("query_id") / 1000.0 - 1, 6))).alias("alpha"))


@query("p7_glob_depth", with_(FILES) + f"SELECT file_id, path FROM files WHERE ends_with({NAME.format('path')}, '.rs') AND len(path) - len(replace(path, '/', '')) < 3")
def glob_depth(spark, d):
    return lines.matching(files(spark, d), pattern="*.rs", depth=3).select("file_id", "path")


@query("p9_changed_since", with_(FILES) + """, changed AS (SELECT CASE WHEN file_id % 2 = 0 THEN 'repo/' || path ELSE substr(path, 5) END AS c FROM files WHERE file_id % 25 = 0)
 SELECT DISTINCT file_id, path FROM files JOIN changed ON ends_with(path, c) OR ends_with(c, path)""")
def changed_since(spark, d):
    f = files(spark, d)
    changed = f.where(C("file_id") % 25 == 0).select(F.when(C("file_id") % 2 == 0, F.concat(F.lit("repo/"), "path")).otherwise(F.substring("path", 5, 1000)).alias("path"))
    return lines.matching(f, changed=changed).select("file_id", "path")


@query("f9_path_parts", with_(FILES) + f"SELECT file_id, array_to_string(list_concat({split_sql('stem')}, {split_sql('dir')}), ' ') AS parts FROM (SELECT file_id, {stem_sql('path')} AS stem, regexp_extract(path, '([^/]*)/[^/]*$', 1) AS dir FROM files)")
def path_parts(spark, d):
    return files(spark, d).select("file_id", F.array_join(paths.path_parts(C("path")), " ").alias("parts"))


_RAW = "(CASE doc_id % 6 WHEN 0 THEN 'crate::' || source || '::m' || doc_id WHEN 1 THEN '../../' || source || '/m.' || doc_id WHEN 2 THEN source || '.' || lang || '.m' || doc_id WHEN 3 THEN './' || lang || '.js' WHEN 4 THEN 'self::m' || doc_id ELSE 'super.' || lang END)"


@query("f10_normalize_import", f"""SELECT doc_id AS file_id, CASE WHEN starts_with(s, 'crate/') THEN s[7:] WHEN starts_with(s, 'self/') THEN s[6:] WHEN starts_with(s, 'super/') THEN s[7:] ELSE s END AS target
 FROM (SELECT doc_id, CASE WHEN starts_with(r, './') OR starts_with(r, '../') THEN regexp_replace(regexp_replace(r, '^(\\.\\./)+', ''), '^(\\./)+', '') ELSE replace(r, '.', '/') END AS s FROM (SELECT doc_id, replace({_RAW}, '::', '/') AS r FROM documents))""")
def normalize_import(spark, d):
    i, s, g = C("doc_id"), C("source"), C("lang")
    n = i.cast("string")
    raw = F.when(i % 6 == 0, F.concat(F.lit("crate::"), s, F.lit("::m"), n)).when(i % 6 == 1, F.concat(F.lit("../../"), s, F.lit("/m."), n)).when(i % 6 == 2, F.concat(s, F.lit("."), g, F.lit(".m"), n))
    raw = raw.when(i % 6 == 3, F.concat(F.lit("./"), g, F.lit(".js"))).when(i % 6 == 4, F.concat(F.lit("self::m"), n)).otherwise(F.concat(F.lit("super."), g))
    return table(spark, d, "documents").select(i.alias("file_id"), paths.normalize_import(raw).alias("target"))


@query("f11_suffixes", with_(FILES) + f"SELECT file_id, array_to_string(list_transform(generate_series(1, len(p)), lambda i: array_to_string(p[i:], '/')), '|') AS suffixes, list_sum(list_transform(p, lambda x: 1))::INT AS n FROM (SELECT file_id, string_split(regexp_replace(path, '^(.+)\\.[^./]*$', '\\1'), '/') AS p FROM files)")
def suffixes(spark, d):
    s = paths.suffixes(C("path"))
    return files(spark, d).select("file_id", F.array_join(s, "|").alias("suffixes"), F.size(s).alias("n"))


@query("f12_middle", """SELECT doc_id AS file_id, CASE WHEN strlen(text) <= 400 THEN md5(text) ELSE md5(substr(text, (greatest(0, n // 2 - keep // 2) + 1)::INT, keep::INT)) END AS hash FROM (SELECT doc_id, text, length(text) AS n, floor(length(text) * 400 / strlen(text))::INT AS keep FROM documents WHERE text <> '')""")
def middle(spark, d):
    return files(spark, d).where("content <> ''").select("file_id", F.md5(fn.middle(C("content"), 100)).alias("hash"))


@query("f7_defines", with_(SOURCES) + """SELECT file_id, file_id % 4 IN (1, 3) AS defines, file_id % 6 = 0 AS imports FROM sources""")
def defines(spark, d):
    i = C("file_id")
    s = sources(spark, d).select("file_id", "content", F.array(F.concat(F.lit("box"), i), F.concat(F.lit("start"), i)).alias("names"))
    lines_ = F.when(i % 6 == 0, F.concat(F.lit("import a\n\nuse b;\n#include <c>\n"), F.lit("x = 1\n"))).otherwise(F.concat(F.lit("import a\nuse b;\nx\ny\n"), i.cast("string")))
    return s.select("file_id", fn.defines_symbol(C("content"), C("names")).alias("defines"), fn.mostly_imports(lines_).alias("imports"))


@query("f13_doc_block", """SELECT doc_id AS file_id, strlen(text) // 4 > 400 AS truncated, CASE WHEN strlen(text) // 4 <= 400 THEN length(text) ELSE (SELECT max(n) FROM generate_series(1595 // 4, 1600) g(n) WHERE strlen(left(text, n)) <= 1600) END::INT AS chars FROM documents""")
def doc_block(spark, d):
    b = files(spark, d).select("file_id", fn.doc_block(C("content")).alias("b"))
    return b.select("file_id", "b.truncated", F.length("b.text").alias("chars"))


@query("f14_doc_comment", with_(SOURCES) + "SELECT file_id, CASE WHEN file_id % 4 = 0 THEN 'Module ' || file_id || '.' || chr(10) || 'Made.' END AS doc FROM sources")
def doc_comment(spark, d):
    return sources(spark, d).select("file_id", fn.first_doc_comment(C("content")).alias("doc"))


@query("f15_replace", with_(LINES) + """SELECT file_id, line::INT AS line, CASE WHEN contains(text, 'th') THEN replace(text, 'th', 'ZZ$') END AS every, CASE WHEN regexp_matches(text, '[aeiou]n') THEN regexp_replace(text, '[aeiou]n', '<n>') END AS first_match
 FROM lined WHERE contains(text, 'th') OR regexp_matches(text, '[aeiou]n')""")
def replace(spark, d):
    from lodestrata.operators import changes

    made = lambda name, *how, **more: files(spark, d).select("file_id", F.explode(changes.replaced(C("content"), *how, **more)["changes"]).alias("c")).select("file_id", "c.line", C("c.after").alias(name))
    return made("every", "th", "ZZ$", every=True).join(made("first_match", "[aeiou]n", "<n>", regex=True), ["file_id", "line"], "full_outer")


@query("f16_rename", with_(LINES) + """SELECT file_id, sum((strlen(text) - strlen(replace(text, 'the', ''))) // 3)::BIGINT AS replacements, md5(string_agg(replace(text, 'the', 'THAT'), chr(10) ORDER BY line)) AS hash FROM lined WHERE contains(text, 'the') GROUP BY file_id""")
def rename(spark, d):
    from lodestrata.operators import changes

    rows = changes.rename(files(spark, d), "the", "THAT", include_tests=True)
    return rows.select("file_id", "replacements", F.md5(F.array_join(F.transform("lines", lambda x: x["after"]), "\n")).alias("hash"))


@query("f21_detect_tool", "SELECT i, tool FROM (VALUES (0, 'cargo_llvm_cov'), (1, 'cargo_test'), (2, 'cargo_build'), (3, 'jest_cov'), (4, 'pytest_cov'), (5, 'pytest'), (6, 'go_cover'), (7, 'go_test'), (8, 'jest'), (9, 'tsc'), (10, 'eslint'), (11, 'mypy'), (12, 'git_log'), (13, 'docker_build'), (14, 'terraform'), (15, 'kubectl_logs'), (16, 'kubectl'), (17, 'mvn'), (18, 'gradle'), (19, 'dotnet'), (20, 'npm_ls'), (21, 'unknown'), (22, 'cargo_clippy')) v(i, tool)")
def detect_tool(spark, d):
    commands = ["cargo llvm-cov", "cargo test -q", "cargo check", "npx jest --coverage", "pytest --cov", "python -m pytest", "go test -cover", "go test", "npm test", "npx tsc", "npx eslint .", "mypy .", "git log", "docker build .", "terraform plan", "kubectl logs p", "kubectl get", "./mvnw test", "gradle build", "dotnet build", "npm ls", "make", "cargo clippy"]
    return spark.createDataFrame([(i, c.split()) for i, c in enumerate(commands)], "i int, c array<string>").select("i", logs.detect_tool(C("c")).alias("tool"))


@query("f22_inject_json", """SELECT i, c FROM (VALUES (0, 'kubectl get pods -o=json'), (1, 'terraform plan -json'), (2, 'npm ls --json'), (3, 'eslint . --format=json'), (4, 'mypy src --output=json'), (5, 'kubectl get -o json'), (6, 'cargo test'), (7, 'npm ls --json=true')) v(i, c)""")
def inject_json(spark, d):
    commands = ["kubectl get pods", "terraform plan", "npm ls", "eslint .", "mypy src", "kubectl get -o json", "cargo test", "npm ls --json=true"]
    return spark.createDataFrame([(i, c.split()) for i, c in enumerate(commands)], "i int, c array<string>").select("i", F.array_join(logs.inject_json(C("c")), " ").alias("c"))


@query("f26_diff_summary", """SELECT event_id, n || ' file(s) changed, +' || k || ' -' || (k // 2) || CASE n WHEN 0 THEN '' WHEN 1 THEN '. Functions: f0' WHEN 2 THEN '. Functions: f0, f1' WHEN 3 THEN '. Functions: f0, f1, f2' ELSE '. ' || n || ' functions changed' END AS summary FROM (SELECT event_id, event_id % 6 AS n, (props->>'$.k')::BIGINT AS k FROM events)""")
def diff_summary(spark, d):
    n, k = C("event_id") % 6, F.get_json_object("props", "$.k").cast("long")
    names = F.slice(F.array(*[F.lit(f"f{i}") for i in range(6)]), F.lit(1), n.cast("int"))
    return table(spark, d, "events").select("event_id", fn.summary_of_diff(n, k, F.floor(k / 2).cast("long"), names).alias("summary"))


@query("f25_byte_offset", with_(LINES) + "SELECT file_id, line::INT AS line, (sum(strlen(text) + 1) OVER (PARTITION BY file_id ORDER BY line) - strlen(text) - 1)::BIGINT AS byte_offset FROM lined")
def byte_offset(spark, d):
    f = files(spark, d).where("content <> ''").select("file_id", "content", F.explode(F.sequence(F.lit(1), F.size(fn.lines(C("content"))))).alias("line"))
    return f.select("file_id", "line", fn.byte_offset(C("content"), C("line")).alias("byte_offset"))


@query("l4_page_tokens", "SELECT query_id, to_base64(query_id::VARCHAR::BLOB) AS token, query_id::INT AS skip FROM (SELECT conv_id * 100 + turn AS query_id FROM conversations)")
def page_tokens(spark, d):
    t = asked(spark, d).select("query_id", fn.page_token(C("query_id")).alias("token"))
    return t.withColumn("skip", fn.page_skip(C("token")))


@query("p14_line_range", with_(LINES) + "SELECT file_id, string_agg(text, chr(10) ORDER BY line) AS text FROM lined WHERE line BETWEEN 2 AND 3 + file_id % 3 GROUP BY file_id")
def line_range(spark, d):
    rows = files(spark, d).select("file_id", lines.line_range(C("content"), F.lit(2), (F.lit(3) + C("file_id") % 3).cast("int")).alias("text"), F.size(fn.lines(C("content"))).alias("n"))
    return rows.where("n > 1").select("file_id", "text")


@query("p15_conditional_read", "SELECT doc_id AS file_id, doc_id % 3 = 0 AS cached, CASE WHEN doc_id % 3 <> 0 THEN md5(text) END AS hash FROM documents")
def conditional_read(spark, d):
    f = files(spark, d)
    seen = F.when(C("file_id") % 3 == 0, F.md5("content")).otherwise(F.md5(F.concat("content", F.lit("!"))))
    cached = F.md5("content") == seen
    return f.select("file_id", cached.alias("cached"), F.when(~cached, F.md5("content")).alias("hash"))


@query("s3_text_gate", """SELECT doc_id AS file_id, strlen(text)::BIGINT AS size FROM documents WHERE doc_id % 3 = 2 AND strlen(text) <= 5000""")
def text_gate(spark, d):
    from lodestrata.sources import stores

    body = F.col("text").cast("binary")
    made = F.when(C("doc_id") % 3 == 0, F.concat(F.substring(body, 1, 9), F.lit(b"\0"), body)).when(C("doc_id") % 3 == 1, F.concat(body, F.lit(b"\xff"))).otherwise(body)
    rows = table(spark, d, "documents").select(C("doc_id").alias("file_id"), C("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("size"), made.alias("bytes"))
    return stores.decoded(rows.where(C("size") <= 5000)).select("file_id", "size")


@query("s7_content_hash", "SELECT doc_id AS file_id, md5(text) AS hash FROM documents")
def content_hash(spark, d):
    return files(spark, d).select("file_id", F.md5("content").alias("hash"))


@query("s10_commands", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'exists' WHEN 1 THEN 'find' WHEN 2 THEN 'jump' END AS cmd, CASE event_id % 5 WHEN 2 THEN 'invalid argument cmd: unknown command: jump' WHEN 3 THEN 'invalid argument cmd: missing ''cmd'' field' WHEN 4 THEN 'invalid JSON' END AS error FROM events WHERE event_id % 7 <> 0""")
def commands(spark, d):
    from lodestrata.sources import stores

    i = C("event_id")
    n = F.concat(F.lit('"id": "'), i.cast("string"), F.lit('"'))
    line = F.when(i % 7 == 0, "  ").when(i % 5 == 0, F.concat(F.lit(' {"cmd": "exists", "pattern": "x", '), n, F.lit("} "))).when(i % 5 == 1, F.concat(F.lit('{"cmd": "find", '), n, F.lit("}"))).when(i % 5 == 2, F.concat(F.lit('{"cmd": "jump", '), n, F.lit("}")))
    line = line.when(i % 5 == 3, F.concat(F.lit("{"), n, F.lit("}"))).otherwise(F.concat(F.lit('{"cmd": '), i.cast("string")))
    parsed = stores.parsed_commands(table(spark, d, "events").select(line.alias("value")))
    known = F.coalesce(C("id"), F.regexp_extract("value", r"(\d+)$", 1))
    return parsed.select(known.cast("long").alias("event_id"), "cmd", "error")


@query("s20_envelope", """SELECT event_type AS command, '{"version":"1","command":"stats","status":"ok","tokens":' || (strlen(j) // 4) || ',"data":' || j || '}' AS envelope FROM (SELECT event_type, '{"command":"' || event_type || '","calls":' || count(*) || '}' AS j FROM events GROUP BY event_type)""")
def envelope(spark, d):
    from lodestrata.operators import evaluate

    rows = table(spark, d, "events").groupBy(C("event_type").alias("command")).agg(F.count("*").alias("calls"))
    return rows.select("command", evaluate.envelope("stats", F.struct("command", "calls"), "1").alias("envelope"))
