"""Scalar functions against expected values."""

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import paths
from lodestrata.functions import text as fn
from lodestrata.operators import evaluate, lines, logs


def values(spark, made, *rows):
    """made(columns a, b, …) of each row, in order."""
    names = "abcdef"[: len(rows[0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *names])
    return [r["v"] for r in df.select("i", made(*[F.col(c) for c in names]).alias("v")).orderBy("i").collect()]


def test_split_identifier(spark):
    cases = {
        "my_func": "my_func my func", "getHTTPResponse": "gethttpresponse get http response", "HandlerStack": "handlerstack handler stack", "simple": "simple",
        "XMLParser": "xmlparser xml parser", "_private": "_private", "utf8Decode": "utf8decode", "A": "a", "parseURL": "parseurl parse url",
    }
    assert values(spark, fn.split_identifier, *[(c,) for c in cases]) == [v.split() for v in cases.values()]
    assert values(spark, fn.tokens, ("fn getUser(x_y: 3z) -> é",))[0] == "fn getuser get user x_y x y z".split()


def test_queries(spark):
    symbol = ["Foo::bar", "_private", "getUserById", "HandlerStack", "feature_impact", "_"]
    other, synonym = ["retry logic for api", "find the error handler", "x", "", "two Words"], ["how is auth handled", "db migration", "DB x"]
    assert values(spark, fn.is_symbol_query, *[(q,) for q in symbol + other + synonym]) == [True] * 6 + [False] * 8
    assert values(spark, fn.resolve_alpha, *[(q,) for q in symbol + other + synonym]) == [0.1] * 6 + [0.6] * 5 + [0.5] * 3
    assert values(spark, lambda q, a: fn.resolve_alpha(q, a), ("anything", 0.8), ("x", 5.0), ("x", -1.0)) == [0.8, 1.0, 0.0]
    modes = {"fn": "literal", "how is authentication handled in this codebase": "hybrid", "fn $NAME($$$)": "structural", "a b c(": "literal", "a `b` c": "hybrid", "Foo": "hybrid", " $x ": "structural", "a|b c d": "literal"}
    assert values(spark, fn.detect_mode, *[(q,) for q in modes]) == list(modes.values())
    assert values(spark, lambda q: fn.detect_mode(q, literal=True, structural=True), ("a $b",)) == ["literal"]
    assert values(spark, fn.expand_synonyms, ("Auth DB auth",), ("author",)) == ["Auth DB auth authentication database", "author"]


def test_paths(spark):
    penalties = {
        "src/auth.rs": 1.0, "tests/test_auth.py": 0.3, "tests/compat/test_old.py": 0.09, "x.d.ts": 0.7, "pkg/__init__.py": 0.5, "a\\tests\\b.rs": 0.3, "src/legacy/x.go": 0.3, "a/examples/b_test.go": 0.09,
    }
    assert [round(v, 6) for v in values(spark, paths.penalty, *[(p,) for p in penalties])] == list(penalties.values())
    imports = {"crate::foo::bar": "foo/bar", "self::utils": "utils", "./components/Button": "components/Button", "foo.bar.baz": "foo/bar/baz", "../../a/b.js": "a/b.js", "super::x": "x"}
    assert values(spark, paths.normalize_import, *[(p,) for p in imports]) == list(imports.values())
    assert values(spark, paths.common_prefix, ("src/components", "src/components"), ("src/components", "src/utils"), ("lib/foo", "src/bar")) == [2, 1, 0]
    assert values(spark, paths.extension, ("a/b.rs",), (".gitignore",), ("x",), ("a.b/c",), ("a..b",), ("q.",)) == ["rs", None, None, None, "b", ""]
    assert values(spark, paths.stem, ("a/b.rs",), (".gitignore",), ("a..b",)) == ["b", ".gitignore", "a."]
    assert values(spark, paths.suffixes, ("a/b/c.py",), ("c",)) == [["a/b/c", "b/c", "c"], ["c"]]
    assert values(spark, paths.without_extension, ("a.b/c",), (".x",), ("a/b.c.d",)) == ["a.b/c", ".x", "a/b.c"]
    tests = {"tests/x.rs": True, "a/tests/x": True, "mytests/x.rs": False, "a/__tests__/b.js": True, "test_a": True, "a/b_test.go": True, "a.spec.ts": True, "atest.py": False}
    assert values(spark, paths.is_workspace_test, *[(p,) for p in tests]) == list(tests.values())
    assert values(spark, lambda p: paths.glob_matches(p, "*.rs"), ("a/b.rs",), ("rs",)) == [True, False] and values(spark, lambda p: paths.glob_matches(p, "*"), ("a/b.rs",), ("a*b",)) == [False, True]
    assert values(spark, lambda p: paths.language(p, listed=True), ("a.PY",), ("a.tsx",), ("a.R",), ("makefile",)) == [None, "tsx", "r", None]
    assert values(spark, paths.enrich, ("body", "a/b/c/d/getUser.rs"), ("body", "x")) == ["[rust] a/b/c/d/getUser.rs getuser get user\nbody getUser d c b", "x x\nbody x "]
    assert values(spark, paths.path_parts, ("src/userAuth/my_handler.rs",), ("top.py",)) == ["my_handler my handler userauth user auth".split(), ["top"]]
    assert values(spark, lambda p: paths.under(p, "/a/b/"), ("/a/b/c/d",), ("/a/bc",), ("\\a\\b\\e",)) == ["c/d", None, "e"]


def test_texts(spark):
    assert values(spark, fn.lines, ("a\r\nb\n\nc\n",), ("",), ("x",), ("\n",), ("a\rb",)) == [["a", "b", "", "c"], [], ["x"], [""], ["a\rb"]]
    assert values(spark, fn.count_fast, ("é" * 4,), ("abc",)) == [2, 0]
    defines = [("  fn authenticate(user: &User) -> Token { }", True), ("let result = authenticate(current_user);", False), ("pub fn authenticate()", False), ("def Authenticate_me():", True), ("fnauthenticate", False)]
    assert values(spark, lambda t: fn.defines_symbol(t, F.array(F.lit("authenticate"))), *[(t,) for t, _ in defines]) == [v for _, v in defines]
    imports = ["import os\nimport sys\nfrom a import b\nuse x\n#include <y>", "import os\ndef f(): pass", "fn main() {}", "import a\nimport b\nx\ny", "import a\n\nimport b\nx"]
    assert values(spark, fn.mostly_imports, *[(t,) for t in imports]) == [True, False, False, False, True]
    assert values(spark, lambda t: fn.middle(t, 2), ("0123456789",), ("01234567",), ("é" * 40,)) == ["12345678", "01234567", "é" * 4]
    got = values(spark, lambda t: fn.doc_block(t, 2), ("abcdefghijkl",), ("aaaaaaaééé",), ("abcdefghij",))
    assert [(g["text"], g["tokens"], g["truncated"]) for g in got] == [("abcdefgh", 2, True), ("aaaaaaa", 1, True), ("abcdefghij", 2, False)]
    docs = [("//! one\n//! two\nfn x", "one\ntwo"), ("\n#![allow(x)]\n/// a\n///  b\n\n/// c", "a\nb"), ("fn x() {}\n/// late", None), ("", None), ("//!\nx", None)]
    assert values(spark, fn.first_doc_comment, *[(t,) for t, _ in docs]) == [v for _, v in docs]
    assert values(spark, fn.byte_offset, ("é\nb\n", 1), ("é\nb\n", 2), ("é\nb\n", 3), ("é\nb\n", 4), ("é", 0)) == [0, 3, 5, None, None]
    assert values(spark, lambda n: fn.page_skip(fn.page_token(n)), (0,), (25,)) == [0, 25] and values(spark, fn.page_skip, ("%%",), ("eA==",)) == [0, 0]
    assert values(spark, fn.kind_priority, ("class",), ("interface",), ("zzz",)) == [5, 4, 0]
    names = [["f"], [], ["a", "b", "c", "d"]]
    assert values(spark, lambda f, a, d, n: fn.summary_of_diff(f, a, d, n), *[(1, 2, 3, n) for n in names]) == ["1 file(s) changed, +2 -3. Functions: f", "1 file(s) changed, +2 -3", "1 file(s) changed, +2 -3. 4 functions changed"]


def test_line_expressions(spark):
    body = "\n".join(f"\t item {i}" if i % 2 else f"item {i + 10}" for i in range(16))
    kept = values(spark, lines.entropy, (body,), ("\n".join("a" for _ in range(9)),), ("\n".join(map(str, "abcdefghijk")),))
    # Shapes: "item N" of the lines 1 to 9, "item NN" of the others.
    few, gone = {}, 0
    for line in body.split("\n"):
        shape = "".join("N" if c.isdigit() else c for c in line.strip())
        few.setdefault(shape, []).append(line)
    first = [line for line in body.split("\n") if any(line in ls[:3] for ls in few.values())]
    gone = 16 - len(first)
    assert kept[0] == "\n".join(first) + f"\n\n... ({gone} repetitive lines filtered)\n"
    assert kept[1] == "\n".join("a" for _ in range(9)) and kept[2] == "\n".join("abcdefghijk")
    same = "\n".join([f"\tx {i % 10}" for i in range(16)])
    assert values(spark, lines.entropy, (same,)) == ["\tx 0\n\tx 1\n\tx 2\n\n... (13 repetitive lines filtered)\n"]
    assert values(spark, lines.collapse_blanks, ("\n\na\n \n\t\nb\n\n",), ("",)) == ["a\n\nb\n", "\n"]
    assert values(spark, lambda c: lines.line_range(c, F.lit(2), F.lit(9)), ("a\nb\nc",)) == ["b\nc"] and lines.parse_range("3-7") == (3, 7)
    for bad in ("3", "a-b", "1-2-3", "-1-2"):
        with pytest.raises(ValueError, match="expected START-END"):
            lines.parse_range(bad)
    assert values(spark, lambda c: lines.retain_within(c, 10), ([5, 7, 3, 9, 1],), ([11],)) == [[0, 2, 4], []]
    levels = {"2024 ERROR x": "ERROR", "warning: y": "WARN", "INFO then ERROR": None, "terror": None, "fatal": "FATAL", "": None}
    assert values(spark, lines.level, *[(t,) for t in levels]) == list(levels.values())


def test_tools(spark):
    commands = {
        "cargo llvm-cov test": "cargo_llvm_cov", "cargo test --all": "cargo_test", "cargo clippy": "cargo_clippy", "cargo check": "cargo_build", "npx jest --coverage": "jest_cov", "nyc mocha": "jest_cov",
        "pytest --cov=x": "pytest_cov", "python -m pytest": "pytest", "go test -cover ./...": "go_cover", "go test ./...": "go_test", "npx vitest": "jest", "npm test": "jest", "npx tsc -p .": "tsc", "eslint .": "eslint",
        "mypy src": "mypy", "git log -5": "git_log", "docker buildx build": "docker_build", "Terraform plan": "terraform", "kubectl logs x": "kubectl_logs", "docker logs y": "kubectl_logs", "kubectl get pods": "kubectl",
        "./mvnw test": "mvn", "./gradlew build": "gradle", "dotnet test": "dotnet", "npm ls": "npm_ls", "ls -la": "unknown",
    }
    assert values(spark, logs.detect_tool, *[(c.split(),) for c in commands]) == list(commands.values())
    flagged = values(spark, logs.inject_json, (["kubectl", "get", "pods"],), (["kubectl", "get", "-o=json"],), (["ls"],), (["mypy", "x"],))
    assert flagged == [["kubectl", "get", "pods", "-o=json"], ["kubectl", "get", "-o=json"], ["ls"], ["mypy", "x", "--output=json"]]


def test_baselines(spark):
    names = "total_matches unique_files bytes output_tokens_saved total_files additions deletions symbols".split()
    rows = [
        ("search", 10, {"total_matches": 3, "unique_files": 2}, 6360), ("search", 10, {}, 3000), ("read", 10, {"bytes": 77}, 77), ("read", 10, {}, 10), ("run", 10, {"output_tokens_saved": 5}, 30), ("find", 10, {"total_files": 4}, 480),
        ("exists", 10, {}, 500), ("exists", 900, {}, 900), ("diff", 10, {"additions": 2, "deletions": 1}, 500), ("outline", 10, {"symbols": 3}, 1500), ("outline", 10, {}, 10), ("edit", 10, {"bytes": 3}, 10),
    ]
    df = spark.createDataFrame([(i, c, a, tuple(f.get(n) for n in names)) for i, (c, a, f, _) in enumerate(rows)], f"i int, c string, a long, f struct<{','.join(f'{n}:long' for n in names)}>")
    got = df.select("i", evaluate.baseline_bytes(F.col("c"), F.col("a"), F.col("f")).alias("v"), evaluate.strategy(F.col("c")).alias("s")).orderBy("i").collect()
    assert [r["v"] for r in got] == [r[3] for r in rows] and got[0]["s"] == "grep_rn_all_matches" and got[-1]["s"] == "parity"
    assert values(spark, evaluate.savings, (25.0, 100.0), (300.0, 100.0), (5.0, 0.0), (1.0, 3.0)) == [75.0, 0.0, 0.0, 66.7]
