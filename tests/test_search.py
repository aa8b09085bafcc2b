"""Chunks, index, search, ranking, graph and packages on small trees with known answers."""

import hashlib
import io
import json
import struct
import subprocess

import pytest
from pyspark.sql import functions as F

from lodestrata import api, server
from lodestrata.functions import code as structure
from lodestrata.operators import changes, chunking, code, evaluate, graph, lines, packages, rerank, retrieval
from lodestrata.sources import models, stores

FILES = "file_id long, path string, content string"
TREE = {
    "main.rs": 'fn main() {\n    let x = 1;\n    println!("{x}");\n}\n\nfn helper(n: i32) -> i32 {\n    n + 1\n}\n',
    "lib.py": 'def greet(name):\n    print(f"Hello {name}")\n\ndef add(a, b):\n    return a + b\n',
    "data.json": '{"key": "value"}\n',
}


def files(spark, tree):
    return spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(tree.items())], FILES)


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "chunk_id long, text string")


def queries(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "query_id long, query string")


def test_literal_search(spark):
    found = lines.scan(files(spark, TREE), "fn main").collect()
    assert [(r["path"], r["line"], r["column"], r["match"]) for r in found] == [("main.rs", 1, 1, "fn main")]
    assert lines.scan(files(spark, TREE), "zzzzqqqxxxnonesuch").count() == 0 and lines.scan(files(spark, TREE), "def ").count() == 2
    tree = {"a": "é foo\nfoo x\n  foo foo\nbar\nfoo\n"}
    rows = sorted((r["line"], r["column"], r["snippet"]) for r in lines.scan(files(spark, tree), "foo").collect())
    assert rows == [(1, 4, "é foo\nfoo x\n  foo foo"), (2, 1, "é foo\nfoo x\n  foo foo\nbar"), (3, 3, "é foo\nfoo x\n  foo foo\nbar\nfoo"), (5, 1, "  foo foo\nbar\nfoo")]
    assert [r["line"] for r in lines.scan(files(spark, tree), "^foo").orderBy("line").collect()] == [2, 5]
    pages, token = [], None
    for _ in range(4):
        skip = 0 if token is None else spark.range(1).select(F.lit(token).alias("t")).select(api.fn.page_skip(F.col("t"))).first()[0]
        page = lines.page(lines.scan(files(spark, tree), "foo"), ["path", "line"], 2, skip).collect()
        pages.append([r["line"] for r in page])
        token = page[-1]["token"]
        if token is None:
            break
    assert pages == [[1, 2], [3, 5]]
    costly = lines.page(lines.scan(files(spark, tree), "foo"), ["path", "line"], 9, 0, 12, api.fn.count_fast(F.col("snippet"))).collect()
    assert sum(len(r["snippet"].encode()) // 4 for r in costly) <= 12 and costly


def test_chunks(spark):
    body = "".join(f"line {i} é {'x' * (i % 40)}\n" for i in range(300))
    rows = chunking.by_lines(files(spark, {"notes.txt": body, "empty": "", "one": "no end"})).orderBy("file_id", "chunk").collect()
    got = [r for r in rows if r["path"] == "notes.txt"]
    data, cuts, held = body.encode(), [0], 0
    for i, b in enumerate(data):
        held += 1
        if b == 10 and held >= 1500:
            cuts, held = [*cuts, i + 1], 0
    cuts += [len(data)] if cuts[-1] < len(data) else []
    starts = [0] + [data.index(b"\n", max(a - 200, b)) + 1 for b, a in zip(cuts, cuts[1:-1])]  # noqa: B905
    assert [(r["start_byte"], r["end_byte"]) for r in got] == list(zip(starts, cuts[1:], strict=True))
    assert all(r["content"] == data[r["start_byte"] : r["end_byte"]].decode() and r["start_line"] == data[: r["start_byte"]].count(b"\n") + 1 and r["end_line"] == data[: r["end_byte"]].count(b"\n") + 1 for r in got)
    assert [(r["content"], r["start_line"], r["end_line"]) for r in rows if r["path"] == "one"] == [("no end", 1, 1)] and not any(r["path"] == "empty" for r in rows)
    source = "\n".join(f"def f{i}(a):\n    '''é {i}'''\n    return a + {i}\n" for i in range(120))
    made = chunking.chunks(files(spark, {"a.py": source, "b.txt": "x\n"})).orderBy("file_id", "chunk").collect()
    own, ends = [r for r in made if r["path"] == "a.py"], 0
    assert len(own) > 2 and made[-1]["path"] == "b.txt" and own[0]["language"] == "python" and made[-1]["language"] is None
    for r in own:
        assert r["start_byte"] <= ends < r["end_byte"] and r["content"] == source.encode()[r["start_byte"] : r["end_byte"]].decode()
        ends = r["end_byte"]
    assert ends == len(source.encode()) and all(r["end_byte"] - r["start_byte"] <= 1750 for r in own)
    big = f"class A:\n    def f(self):\n        x = [\n{'            1,\n' * 400}        ]\n\ndef g(): pass\n"
    assert [s[3:] for s in structure.chunk_spans(big, "py", 1500, 0)][0][0] == 0 and len(list(structure.chunk_spans(big, "py", 1500, 0))) > 2


def test_bm25(spark):
    kept = retrieval.postings(texts(spark, "fn authenticate(user: &User) -> Token", "fn process_data(data: &[u8]) -> Result", "fn validate_token(token: &Token) -> bool"))
    first = lambda kept, q: [r["chunk_id"] for r in retrieval.bm25(kept, queries(spark, q), 5).orderBy("rank").collect()]
    assert first(kept, "authenticate") == [0] and first(kept, "zzzzz") == []
    kept = retrieval.postings(texts(spark, "fn getHTTPResponse(url: &str) -> Response", "fn process(data: Data) -> Output"))
    assert first(kept, "http response")[0] == 0
    assert first(retrieval.postings(spark.createDataFrame([], "chunk_id long, text string")), "anything") == []
    body = texts(spark, *["alpha beta beta gamma", "alpha alpha delta", "", "getUser alpha"] * 3)
    asked = queries(spark, "alpha beta", "beta beta", "user", "none")
    a, b = (sorted(map(tuple, r.collect())) for r in (retrieval.bm25(retrieval.postings(body), asked, 5), retrieval.bm25_of_texts(body, asked, 5)))
    assert a == b and a
    assert {tuple(r) for r in lines.exists(retrieval.postings(body).select("term"), queries(spark, "alpha beta", "alpha zzz", "", "getUser")).select("query_id", "exists", "confidence").collect()} == {(0, True, "probable"), (1, False, "exact"), (2, False, "exact"), (3, True, "probable")}


def test_embeddings(spark):
    names = ["hello", "world", "foo", "bar", "auth", "login"]
    vocabulary = spark.createDataFrame([(n, [float(i == j) for j in range(8)]) for i, n in enumerate(names)], "token string, vec array<float>")
    body = texts(spark, "hello world", "foo bar", "auth login", "nothing known", "login auth")
    vectors = retrieval.embed(body, vocabulary, "chunk_id")
    vec = {r["chunk_id"]: r["vec"] for r in vectors.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(vec[a], vec[b], strict=True))
    assert abs(dot(0, 0) - 1) < 1e-9 and vec[3] == [0.0] * 8 and dot(2, 4) > 0.9 and dot(0, 1) < 0.1
    asked = retrieval.embed(queries(spark, "auth login").withColumnRenamed("query", "text"), vocabulary, "query_id")
    ranked = retrieval.nearest(vectors, asked, 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in ranked] == [2, 4, 0] and ranked[0]["score"] == 1.0
    with pytest.raises(Exception, match="has not 4 dimensions"):
        retrieval.check_dim(vectors, 4).collect()


def test_fusion(spark):
    ranked = lambda *rows: spark.createDataFrame([(0, *r) for r in rows], "query_id long, chunk_id long, score double")
    ids = lambda d, x, a: [r["chunk_id"] for r in retrieval.fuse(d, x, a).orderBy(F.desc("score"), "chunk_id").collect()]
    assert abs(retrieval.reciprocal_rank(ranked((0, 1.0))).first()["rrf"] - 1 / 61) < 1e-12
    both = ids(ranked((0, 1.0), (1, 0.5)), ranked((1, 1.0), (2, 0.5)), 0.5)
    assert both[0] == 1 and set(both) == {0, 1, 2}
    assert ids(ranked((0, 1.0)), ranked((1, 1.0)), 0.0)[0] == 1 and ids(ranked((0, 1.0)), ranked((1, 1.0)), 1.0)[0] == 0
    none = ranked((0, 1.0)).limit(0)
    assert ids(none, none, 0.5) == [] and ids(ranked((3, 1.0)), none, 0.5) == [3]


def cards(spark, *rows, query="q"):
    return spark.createDataFrame([(0, query, i, p, c, float(s)) for i, (p, c, s) in enumerate(rows)], "query_id long, query string, chunk_id long, path string, content string, score double")


def scores(df):
    return [round(r["score"], 6) for r in df.orderBy("chunk_id").collect()]


def test_rerank_stages(spark):
    assert scores(rerank.penalties(cards(spark, ("src/auth.rs", "", 1), ("tests/test_auth.py", "", 1), ("tests/compat/test_old.py", "", 1)))) == [1.0, 0.3, 0.09]
    assert scores(rerank.saturate(cards(spark, ("a", "", 1.0), ("a", "", 0.9), ("b", "", 0.8)))) == [1.0, 0.45, 0.8]
    only = rerank.Config(False, False, False, False, False, True)
    top = rerank.run(cards(spark, ("a", "", 1.0), ("a", "", 0.9), ("a", "", 0.8), ("b", "", 0.7)), 2, config=only).orderBy("rank").collect()
    assert [r["chunk_id"] for r in top] == [0, 3]
    assert scores(rerank.coherence(cards(spark, ("a", "", 1.0), ("a", "", 0.8), ("b", "", 0.5)))) == [1.15, 0.8, round(0.5 + 0.15 * 0.5 / 1.8, 6)]
    for stage in (rerank.coherence, rerank.definitions, rerank.stems):
        assert scores(stage(cards(spark, ("a", "fn auth", 0.0), ("b", "", 0.0), query="auth"))) == [0.0, 0.0]
    defined = cards(spark, ("src/x.rs", "fn authenticate(user: &User) -> Token { }", 1), ("src/y.rs", "let result = authenticate(current_user);", 1), ("src/authenticate.rs", "def authenticate(", 0.5), ("z", "import a\nimport b\nimport c", 1), query="authenticate")
    assert scores(rerank.definitions(defined)) == [5.0, 1.0, 6.5, 0.2]
    assert scores(rerank.definitions(cards(spark, ("x", "fn getUser(", 1), query="getUser"))) == [13.0]
    assert scores(rerank.stems(cards(spark, ("src/auth/handler.rs", "", 1), ("src/utils/helper.rs", "", 1), query="auth handler"))) == [2.5, 1.0]
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(10)], "node long, path string")
    edges = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    near = scores(rerank.proximity(cards(spark, ("n0", "", 1.0), ("n1", "", 0.01), ("n2", "", 0.01), ("n9", "", 0.01)), nodes, edges))
    assert near == [1.0, 0.26, 0.135, 0.01]


def test_graph(spark):
    edges = lambda *e: spark.createDataFrame(list(e), "src long, dst long")
    hops = lambda df: {r["node"]: r["hop"] for r in df.collect()}
    assert hops(graph.reach(edges((0, 1), (1, 2), (2, 3)), [0], 2, both=True)) == {1: 1, 2: 2}
    assert hops(graph.reach(edges((0, 1), (1, 0)), [0], 5, both=True)) == {1: 1} and hops(graph.reach(edges((0, 1), (1, 2)), [2], 2)) == {1: 1, 0: 2}
    tree = {"src/auth.py": "from src.models.user import User\nimport os\n", "src/models/user.py": "from ..auth import x\n", "web/app.js": "import { a } from './util';\n", "web/util.js": "", "main.rs": "use crate::web::util::Thing;\n"}
    tree |= {f"pkg{i}/utils.py": "" for i in range(10)} | {"pkg3/user.py": "import utils\n"}
    nodes, found = graph.build(files(spark, tree))
    path = {r["node"]: r["path"] for r in nodes.collect()}
    got = {(path[r["src"]], path[r["dst"]]) for r in found.collect()}
    assert {("src/auth.py", "src/models/user.py"), ("web/app.js", "web/util.js"), ("main.rs", "web/util.js")} <= got
    assert {b for a, b in got if a == "pkg3/user.py"} == {"pkg3/utils.py", "pkg0/utils.py"}
    into, out = graph.boundary(nodes, found, "web")
    assert [(r["file"], r["symbols"]) for r in into.collect()] == [("main.rs", ["util"])] and out.count() == 0
    partial = graph.build(files(spark, tree), nodes.where("path = 'web/app.js'").select(F.col("node").alias("file_id")))[1]
    assert {(path[r["src"]], path[r["dst"]]) for r in partial.collect()} == {("web/app.js", "web/util.js")}


SYMBOLS = {
    "a.rs": ("struct A { x: i32 }\nimpl A {\n  pub fn new() -> Self {\n    A { x: 1 }\n  }\n}\npub const X: i32 = 3;\ntrait T { fn f(&self); fn g() { } }\nmod m { fn h() {} }\nenum E { A }\ntype Q = u8;\n", "struct A 1 1;function new 3 5;const X 7 7;trait T 8 8;function g 8 8;module m 9 9;function h 9 9;enum E 10 10;type Q 11 11"),
    "a.py": ("class Foo:\n    def bar(self):\n        def inner():\n            pass\n\nif x:\n    def top(): pass\n", "class Foo 1 4;function bar 2 4;function top 7 7"),
    "a.js": ("class Foo {\n  constructor(a) {\n  }\n  async run(x) { if (x) { return 1 } }\n}\nconst add = (a, b) => {\n return a;\n};\nexport function zed() {}\n// function no() {}\n", "class Foo 1 5;method constructor 2 3;method run 4 4;function add 6 8;function zed 9 9"),
    "a.ts": ("interface I { a: string }\nenum E { A }\ntype T = { b: number };\nclass C<X> {\n  private go(): void {\n  }\n}\n", "interface I 1 1;enum E 2 2;type T 3 3;class C 4 7;method go 5 6"),
    "a.java": ('package x;\npublic class Foo {\n  @Override\n  public String bar(int a) { return "}"; }\n  interface Q { void z(); }\n}\n', "class Foo 2 6;method bar 3 4;interface Q 5 5;method z 5 5"),
    "a.go": ("package main\nfunc main() {\n}\nfunc (s *S) Run() error {\n return nil\n}\n", "function main 2 3;method Run 4 6"),
    "a.kt": ("class A {\n  fun b(): Int = 1\n}\nobject O { }\nfun c() {\n}\n", "class A 1 3;function b 2 2;class O 4 4;function c 5 6"),
    "a.cs": ("namespace N {\n  public class C {\n    public void M() { }\n  }\n}\n", "module N 1 5;class C 2 4;method M 3 3"),
    "a.php": ("<?php\nclass A {\n  public function b() { }\n}\nfunction c() { }\n", "class A 2 4;method b 3 3;function c 5 5"),
    "a.tf": ('resource "aws_s3" "b" {\n  lifecycle {\n  }\n}\nvariable "x" {}\n', "module resource aws_s3 b 1 4;module lifecycle 2 3;const variable x 5 5"),
    "a.sh": ("f() {\n  echo '}'\n}\nfunction g {\n  :\n}\n", "function f 1 3;function g 4 6"), "a.rb": ("module M\n  def x\n  end\nend\n", "module M 1 4"), "a.ex": ("defmodule A do\n  def run do\n  end\n  def f(x), do: x\nend\n", "module A 1 5;function run 2 3"),
    "a.mk": ("CC = gcc\nall: a.o\n\tld a.o\n", "const CC 1 1;function all 2 3"), "a.c": ("struct s { int a; };\nint f(void) { return 0; }\n", "struct s 1 1"), "a.txt": ("fn x() {}", ""),
}


def test_symbols(spark):
    rows = code.symbols(files(spark, {p: c for p, (c, _) in SYMBOLS.items()})).orderBy("file_id", "symbol").collect()
    for path, (_, want) in SYMBOLS.items():
        assert ";".join(f"{r['kind']} {r['name']} {r['start_line']} {r['end_line']}" for r in rows if r["path"] == path) == want, path
    assert [(r["name"], r["parent"], r["depth"]) for r in rows if r["path"] == "a.rs"][4] == ("g", 3, 1)
    assert code.symbols(files(spark, {"a.py": SYMBOLS["a.py"][0]}), "class").count() == 1
    tree = {"src/manager.py": "class ConfigurationManager:\n    pass\n", "src/handler.py": "from manager import ConfigurationManager\n", "src/auth.rs": "fn authenticate() {}\n"}
    found = code.symbols(files(spark, tree))
    body = texts(spark, *tree.values(), "ConfigurationManager x").withColumnRenamed("text", "content")
    assert {tuple(r) for r in code.references(found, body).collect()} == {("ConfigurationManager", 3), ("authenticate", 1)}
    asked = spark.createDataFrame([(0, "configurationmanager"), (1, "authenticate"), (2, "nothing")], "query_id long, name string")
    assert {(r["query_id"], r["name"]) for r in code.lookup(found, asked).collect()} == {(0, "ConfigurationManager"), (1, "authenticate")}


IMPORTS = {
    "a.rs": ("use crate::commands::read;\nmod search;\nextern crate serde;\n// use no::thing;\n", "crate::commands::read search serde"), "a.py": ('from foo.bar import baz\nimport os, sys as s\nfrom pathlib import Path\n"""\nimport no\n"""\n', "foo.bar os sys pathlib"),
    "a.js": ("import React from 'react';\nconst fs = require('fs');\nimport { foo } from './utils';\nexport * from './x';\nimport('./lazy');\n", "react fs ./utils ./x ./lazy"), "a.go": ('import (\n\t"fmt"\n\tx "os"\n)\nvar s = "no"\n', "fmt os"),
    "a.java": ("import java.util.List;\nimport static org.junit.Assert.assertEquals;\n", "java.util.List org.junit.Assert.assertEquals"), "a.c": ('#include <stdio.h>\n#include "myheader.h"\n', "stdio.h myheader.h"), "a.rb": ("require 'json'\nrequire_relative 'helper'\n", "json helper"),
    "a.kt": ("import java.util.List\nimport kotlin.io.println\n", "java.util.List kotlin.io.println"), "a.swift": ("import Foundation\nimport UIKit\n", "Foundation UIKit"), "a.cs": ("using System;\nusing System.IO;\n", "System System.IO"),
    "a.html": ('<script src="app.js"></script>\n<link href="style.css" rel="stylesheet">\n<a href="no">x</a>', "app.js style.css"), "a.json": ("{}", ""), "a.xyz": ("import x", ""), "b.py": ("", ""),
}


def test_imports(spark):
    rows = code.imports(files(spark, {p: c for p, (c, _) in IMPORTS.items()})).orderBy("file_id", "position").collect()
    assert {p: " ".join(r["raw"] for r in rows if r["path"] == p) for p in IMPORTS} == {p: w for p, (_, w) in IMPORTS.items()}


def test_structure(spark):
    body = "def a():\n    if x:\n        return 1\n    return 2\n\nclass B:\n    def m(self):\n        y = 1  # why\n        return y\n"
    one = files(spark, {"x.py": body})
    snap = lambda line, target: tuple(one.select(code.snapped(F.col("content"), F.col("path"), F.lit(line), target).alias("s")).first()["s"] or ())
    assert snap(3, "fn") == (1, 4, "function_definition", "a") and snap(8, "function") == (7, 9, "function_definition", "m") and snap(9, "class")[3] == "B" and snap(5, "function") == () and snap(3, "block")[:2] == (2, 3)
    assert one.select(code.body(F.col("content"), F.col("path"), F.lit(3)).alias("b")).first()["b"].startswith("def a():") and one.select(code.stripped(F.col("content"), F.col("path")).alias("t")).first()["t"].count("why") == 0
    assert code.skeletons(one).first()["text"] == "def a():  // L1\nclass B:  // L6"
    found, said = code.structural(files(spark, TREE | {"t.rs": "fn x() {\n    foo(a, b(c));\n    foo(1);\n    foo(2, 2);\n}\n"}), "foo($A, $A)", 5)
    assert [(r["path"], r["line"], r["column"], r["match"]) for r in found.collect()] == [("t.rs", 4, 1, "foo(2, 2)")] and said.first()["warning"] is None
    assert [r["line"] for r in code.structural(files(spark, TREE), "fn $NAME($$$) $$$ { $$$ }", 5)[0].collect()] == [1, 6]
    assert "matched 0 of 3 files" in code.structural(files(spark, TREE), "zzz($A)", 5)[1].first()["warning"] and "did not compile" in code.structural(files(spark, TREE), "foo((", 5)[1].first()["warning"]
    bad = {r["path"]: r["e"] is None for r in files(spark, {"a.py": "x = (", "b.py": "x = 1", "c.rs": "fn a() { (}", "d.rs": 'fn a() { ")" }', "e.json": "{", "f.txt": "("}).select("path", code.syntax_error(F.col("content"), F.col("path")).alias("e")).collect()}
    assert bad == {"a.py": False, "b.py": True, "c.rs": False, "d.rs": True, "e.json": False, "f.txt": True}


def test_read(spark):
    all_ = files(spark, TREE)
    read = lambda path, **o: code.read(all_.where(F.col("path") == path), **o).first()
    whole = read("main.rs")
    assert whole["text"] == TREE["main.rs"] and (whole["lines"], whole["start_line"], whole["end_line"], whole["language"]) == (8, 1, 8, "rust") and [s["name"] for s in whole["outline"]] == ["main", "helper"]
    assert read("main.rs", if_changed=whole["hash"].upper())["cached"] and read("main.rs", if_changed=whole["hash"])["text"] is None and not read("main.rs", if_changed="0" * 32)["cached"]
    with pytest.raises(ValueError, match="32-char hex"):
        read("main.rs", if_changed="zz")
    with pytest.raises(ValueError, match="aggressive"):
        read("main.rs", mode="other")
    assert read("main.rs", only_hash=True)["text"] is None and read("main.rs", outlined=True)["text"] is None and read("main.rs", skeleton=True)["text"] == "fn main() {  // L1\nfn helper(n: i32) -> i32 {  // L6"
    part = read("main.rs", span="7-7", snap="function")
    assert (part["start_line"], part["end_line"], part["snap_reason"]) == (6, 8, "expanded to enclosing function_item `helper`") and read("main.rs", span="2-3")["text"] == "    let x = 1;\n    println!(\"{x}\");"
    cut = read("main.rs", budget=5)
    assert cut["truncated"] and cut["tokens"] <= 5
    old = spark.createDataFrame([("lib.py", TREE["lib.py"].replace("a + b", "a - b")), ("main.rs", TREE["main.rs"])], "path string, content string")
    assert read("lib.py", mode="diff", old=old)["text"] == "-L5:     return a - b\n+L5:     return a + b\n" and read("main.rs", mode="diff", old=old)["text"] == "[no changes vs HEAD]\n" and read("data.json", mode="diff", old=old)["text"] == TREE["data.json"]


def test_edits(spark):
    one = files(spark, {"a.py": "x = foo(1)\ny = foo(foo(2))\n", "b.txt": "a.b a.b\na.b"})
    edit = lambda path, pairs, **o: changes.edit(one.where(F.col("path") == path), pairs, **o).first()
    assert edit("a.py", [("foo", "bar")])["text"] == "x = bar(1)\ny = foo(foo(2))\n" and edit("a.py", [("foo", "bar")], every=True)["text"] == "x = bar(1)\ny = bar(bar(2))\n"
    assert edit("a.py", [(r"fo+", "b")], regex=True)["text"] == "x = b(1)\ny = b(foo(2))\n" and edit("a.py", [(r"f(o+)", "$1")], regex=True, every=True)["text"] == "x = oo(1)\ny = oo(oo(2))\n"
    assert edit("b.txt", [("a.b", "$1\\")], every=True)["text"] == "$1\\ $1\\\n$1\\" and edit("b.txt", [("zz", "q")])["total_replacements"] == 0
    both = edit("a.py", [("foo", "bar"), ("bar(1)", "(")])
    assert both["total_replacements"] == 2 and not both["syntax_valid"] and changes.to_apply(changes.edit(one, [("foo", "(")], every=True)).count() == 0
    scoped = files(spark, {"s.py": "def a():\n    return q\n\ndef b():\n    return q\n"})
    assert changes.edit(scoped, [("q", "w")], every=True, scope="b").first()["text"] == "def a():\n    return q\n\ndef b():\n    return w\n"
    tree = {"src/a.py": "def old_name(): pass\nold_name(old_names)\n", "tests/test_a.py": "old_name()\n", "z.md": "none"}
    got = changes.rename(files(spark, tree), "old_name", "new", False).collect()
    assert [(r["path"], r["replacements"], [x["after"] for x in r["lines"]]) for r in got] == [("src/a.py", 3, ["def new(): pass", "new(news)"])] and changes.rename(files(spark, tree), "old_name", "new", True).count() == 2
    assert changes.defined(files(spark, tree), "old_name") and not changes.defined(files(spark, tree), "none")
    with pytest.raises(ValueError, match="differ"):
        changes.rename(files(spark, tree), "a", "a")


def brute_distance(a, b):
    """Fewest additions and deletions, by the longest common subsequence."""
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, best[j] = best[j], last + 1 if x == y else max(best[j], best[j - 1])
    return len(a) + len(b) - 2 * best[-1]


def test_diffs(spark):
    import random

    rng = random.Random(3)
    for _ in range(120):
        a, b = ("".join(rng.choice("abcd") + "\n" for _ in range(rng.randrange(12))) for _ in range(2))
        found = structure.line_diff(a, b)
        assert len(found) == brute_distance(a.splitlines(), b.splitlines())
        kept = [x for i, x in enumerate(a.splitlines(), 1) if ("deletion", i) not in {(t, n) for t, n, _ in found}]
        made = {n: x for t, n, x in found if t == "addition"}
        out = []
        while len(out) < len(kept) + len(made):
            out.append(made[len(out) + 1] if len(out) + 1 in made else kept[len(out) - sum(n <= len(out) for n in made)])
        assert out == b.splitlines()
    old, new = ({"main.rs": "fn main() {\n    let x = 1;\n}\nfn gone() {}\n", "same.py": "x\n"}, {"main.rs": "fn main(a: u8) {\n    let x = 42;\n}\nfn fresh() {}\n", "same.py": "x\n", "add.py": "def q():\n    pass\n"})
    pairs = changes.versions(files(spark, old), files(spark, new))
    rows = changes.diff(pairs)
    named = changes.changed_functions(pairs, rows)
    stats = changes.stats(pairs, rows, named).first()
    assert (stats["additions"], stats["deletions"], stats["files_changed"], stats["functions_changed"]) == (5, 3, 2, ["add.py:q", "main.rs:main", "main.rs:fresh"])
    assert stats["summary"] == "2 file(s) changed, +5 -3. Functions: add.py:q, main.rs:main, main.rs:fresh"
    assert {r["note"] for r in changes.notes(pairs).collect()} == {"add.py: new symbol `q`", "main.rs: new symbol `fresh`", "main.rs: removed symbol `gone`", "main.rs: signature changed `main`"}
    hunks = changes.hunks(rows, named).orderBy("path").collect()
    assert [(h["path"], h["function"], len(h["changes"])) for h in hunks] == [("add.py", "q", 2), ("main.rs", "main", 6)]
    assert [h["path"] for h in changes.hunks(rows, named, budget=hunks[0]["cost"]).collect()] == ["add.py"]
    none = changes.versions(files(spark, old), files(spark, old))
    assert changes.stats(none, changes.diff(none), changes.changed_functions(none, changes.diff(none))).first()["summary"] == "no changes"


def test_evaluation(spark):
    results = spark.createDataFrame([(0, "src/a.rs", 1), (0, "src/a.rs", 2), (0, "src/b.rs", 3), (1, "x", 1), (3, "z", 1)], "query_id long, path string, rank int")
    labels = spark.createDataFrame([(0, 0, "a.rs", 3), (0, 1, "src/b.rs", 1), (1, 0, "q", 2), (2, 0, "q", 2)], "query_id long, position int, file string, relevance int")
    asked = spark.createDataFrame([(0, "symbol", False), (1, "symbol", False), (2, "other", False), (3, "other", True), (4, "other", True)], "query_id long, category string, negative boolean")
    scores_ = evaluate.ndcg(results, labels, asked)
    assert {r["query_id"]: r["ndcg10"] for r in scores_.collect()} == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0}
    by = {r["category"]: r for r in evaluate.by_category(scores_).collect()}
    assert (by[None]["ndcg10"], by[None]["count"], by[None]["misses"]) == (0.4, 5, 3) and (by["symbol"]["ndcg10"], by["symbol"]["low"], by["symbol"]["high"]) == (0.5, 0.5, 0.5)
    values, state, means = [0.1, 0.9, 0.4, 0.4], 0x517CC1B727220A95, []
    for _ in range(2000):
        total = 0.0
        for _ in values:
            state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            total += values[(state >> 33) % 4]
        means.append(total / 4)
    means.sort()
    assert evaluate.interval(values) == tuple(round(means[i], 4) for i in (50, 1950))
    calls = spark.createDataFrame([("search", 100, 1000, 225), ("search", 900, 1000, 25), ("read", 50, 0, 0), (None, 9, 3, 0)], "command string, actual_bytes long, baseline_bytes long, tokens_saved long")
    assert [tuple(r) for r in evaluate.roll_up(calls).collect()] == [("search", 2, 250, 500, 50.0), ("read", 1, 12, 0, 0.0), ("unknown", 1, 2, 0, 0.0)] and tuple(evaluate.totals(calls).first()) == (4, 250)
    tasks = spark.createDataFrame([("a", 40, 400, 1, 2), ("b", 400, 40, 3, 4)], "name string, bytes long, baseline_bytes long, ms long, baseline_ms long")
    assert tuple(evaluate.side_by_side(tasks).first()) == (2, 45.0, 110, 110, 4, 6)


def test_sums_and_labels_stay_in_their_tasks(spark):
    """No row for a query and a text is shuffled, texts are split once, and scores are read once; what is too many goes by shuffles to the same rows."""
    rows = [(i, " ".join(f"w{i * j % 23}" for j in range(1, 4 + i % 40))) for i in range(300)] + [(None, "w1 w2"), (300, None), (301, ""), (302, "w1"), (303, "w1")]
    body = spark.createDataFrame(rows, "chunk_id long, text string").repartition(3)
    asked = spark.createDataFrame([(7, "w1 w2 w2 w5"), (3, "w9"), (1 << 60, "absent"), (5, None), (9, "w1 w1 w0 w22")], "query_id long, query string")
    few = retrieval.bm25_of_texts(body, asked, 4)
    want = sorted(map(tuple, retrieval.bm25_of_texts(body.where("chunk_id is not null"), asked, 4, few=0).collect()))
    assert "hashpartitioning(query_id, chunk_id" not in "".join(few._jdf.queryExecution().executedPlan().toString().split("#")) and len(want) == 12
    assert sorted(map(tuple, retrieval.bm25_of_texts(body.where("chunk_id is not null"), asked, 4).collect())) == want
    whole = " ".join(f"v{j}" for j in range(20))
    docs = spark.createDataFrame([(1, f"a {whole} b"), (2, f"ax{whole}y\nz"), (3, whole.replace("v7", "v8")), (4, whole.replace(" ", "  ")), (5, None), (6, "p q r"), (7, "xp qr"), (None, whole), (8, "")], "doc_id long, text string")
    passages = spark.createDataFrame([(1, whole), (2, "p q"), (3, "p q r"), (4, "v18"), (5, None), (6, ""), (7, " v1 v2 "), (8, f"{whole} b"), (9, "v3 v4 v5 v6")], "item_id long, passage string")
    found = [sorted(map(tuple, evaluate.containing(docs, passages, n).collect())) for n in (100, 0)]
    texts_ = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None and r["text"] is not None}
    assert found[0] == found[1] == sorted((r["item_id"], d) for r in passages.collect() if r["passage"] is not None for d, t in texts_.items() if r["passage"] in t)
    scores = spark.createDataFrame([(i, "ab"[i % 2], i / 10, i / 20) for i in range(10)], "query_id long, category string, ndcg5 double, ndcg10 double")
    assert evaluate.by_category(scores)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_packages(spark, tmp_path):
    tree = {"src/core.rs": "//! The core.\npub struct Engine { }\npub fn start() { }\n", "src/app.rs": "use crate::core::Engine;\nfn run() { start(); }\n", "tests/t.rs": "use crate::core::start;\nfn check() { start(); }\n", "src/deep.rs": "use crate::app::run;\n", "README.md": "# Title\n"}
    all_ = files(spark, tree)
    t = stores.index(all_, str(tmp_path / "index"))[1]
    data = packages.impact(all_, t["nodes"], t["edges"], "src/core.rs")
    assert [(d["path"], d["hops"], d["uses"], d["via"], d["is_test"]) for d in data["dependents"]] == [("src/app.rs", 1, ["Engine"], None, False), ("tests/t.rs", 1, ["start"], None, True), ("src/deep.rs", 2, [], "src/app.rs", False)]
    assert data["stats"] == {"direct": 2, "transitive": 1, "test_files": 1, "total": 3, "max_hops_reached": 2}
    narrow = packages.impact(all_, t["nodes"], t["edges"], "src/core.rs", symbol="Engine", hops=9, no_tests=True)
    assert [d["path"] for d in narrow["dependents"]] == ["src/app.rs", "src/deep.rs"] and narrow["warnings"] == ["hops capped from 9 to 5"]
    small = packages.impact(all_, t["nodes"], t["edges"], "src/core.rs", budget=40)
    assert small["truncated"] and small["stats"]["total"] == 3 and packages.tokens_of({k: v for k, v in small.items() if k != "warnings"}) <= 140
    data = packages.context(all_, "", t["refs"], t["nodes"], t["edges"])
    assert data["stats"] == {"files": 4, "lines": 7, "symbols": 3, "languages": {"rust": 3, "markdown": 1}} and data["doc"]["text"] == "# Title\n" and data["entrypoints"][0]["name"] == "start" and not data["truncated"]
    assert [f["path"] for f in data["files"]][0] == "README.md" and packages.context(all_, "src/core.rs", t["refs"])["doc"]["text"] == "The core."
    edges_ = packages.context(all_, "src", t["refs"], t["nodes"], t["edges"])["edges"]
    assert edges_ == {"imports_in": [{"file": "tests/t.rs", "symbols": ["core"]}], "imports_out": []}
    cut = packages.context(all_, "", t["refs"], t["nodes"], t["edges"], budget=60)
    assert cut["truncated"] and cut["edges"] is None and len(cut["files"]) == 1
    data = packages.explain(all_, t["symbols"], "start")
    assert [(d["path"], d["line"], d["kind"], d["body"]) for d in data["definitions"]] == [("src/core.rs", 3, "function", "pub fn start() { }")] and [r["path"] for r in data["references"]] == ["src/app.rs"] and data["tests"][0]["context"] == "use crate::core::start;"
    assert packages.explain(all_, t["symbols"], "START", budget=1)["definitions"][0]["body"] is None
    with pytest.raises(ValueError, match="not found"):
        packages.explain(all_, t["symbols"], "absent")
    many = spark.createDataFrame([(i, f"p{i}", 1 if i < 60 else 2, [], None, False) for i in range(70)], "node long, path string, hops int, uses array<string>, via string, is_test boolean")
    assert packages.narrowed(many).count() == 60


def test_index_and_api(spark, tmp_path):
    root, folder = tmp_path / "tree", str(tmp_path / "index")
    for path, content in (TREE | {"pkg/__init__.py": "from lib import greet\n", "skip.log": "x", ".gitignore": "*.log\nbuild/\n!keep.log\n", "keep.log": "k", "build/o.rs": "fn o() {}", ".hidden.py": "h = 1\n"}).items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    (root / "data.bin").write_bytes(b"\0" * 64)
    (root / "latin.txt").write_bytes(b"caf\xe9")
    (root / "large.txt").write_text("x" * 2_000_000)
    walked = stores.walk(spark, str(root))
    assert {r["path"] for r in walked.collect()} == {"main.rs", "lib.py", "data.json", "pkg/__init__.py", ".gitignore", "keep.log", ".hidden.py"}
    assert {r["path"]: r["language"] for r in walked.collect()}["lib.py"] == "python"
    space = api.Workspace.of(spark, str(root), folder=folder)
    assert space.index() == "built" and space.index() == "up_to_date"
    before = stores.load(spark, folder)
    assert stores.is_valid(walked, before["files"])
    (root / "lib.py").write_text(TREE["lib.py"] + "\ndef third():\n    pass\n")
    walked = stores.walk(spark, str(root))
    state = {r["path"]: r["reused"] for r in stores.delta(walked, before["files"]).collect()}
    assert [p for p, reused in state.items() if not reused] == ["lib.py"] and not stores.is_valid(walked, before["files"])
    fresh, kept = stores.build(walked), stores.build(walked, before)
    for name in ("chunks", "symbols", "refs", "edges", "postings"):
        columns = sorted(fresh[name].columns)
        assert sorted(map(repr, fresh[name].select(columns).collect())) == sorted(map(repr, kept[name].select(columns).collect())), name
    space = api.Workspace.of(spark, str(root), folder=folder)
    assert space.index() == "built"
    found = json.loads(api.run(space, "search", query="greet someone with a name", top_k=2))
    assert found["status"] == "ok" and found["data"]["matches"][0]["path"] == "lib.py" and found["tokens"] > 0
    assert space.search("greetName", top_k=1)["total_matches"] <= 2 and space.search("fn main")["matches"][0]["line"] == 1 and space.search("fn $N($$$) $$$")["matches"][0]["match"].startswith("fn main")
    assert space.exists("greet name")["exists"] and not space.exists("zzzz")["exists"]
    assert space.find("*.py")["stats"]["total_files"] == 3 and space.find("*.py", flat=False)["tree"]["pkg/"] == {"__init__.py": {"lines": 1, "bytes": 22, "language": "python"}} and space.find(depth=1, outline=True, budget=9)["stats"]["budget_used"] <= 9
    changed = spark.createDataFrame([("tree/pkg/__init__.py",), ("ain.rs",)], "path string")
    assert sorted(r["path"] for r in lines.matching(walked, changed=changed).collect()) == ["main.rs", "pkg/__init__.py"]
    assert [s["name"] for s in space.outline("lib.py")["symbols"]] == ["greet", "add", "third"] and space.run(["echo", "hi"])["tail"] == "hi\n"
    assert space.index_stats()["valid"] and space.index_stats()["file_count"] == 7 and {r["name"]: len(r["defs"]) for r in code.by_name(space.tables()["symbols"]).collect()} == {"main": 1, "helper": 1, "greet": 1, "add": 1, "third": 1}
    rpc = [json.dumps({"jsonrpc": "2.0", "id": i, "method": m, "params": p}) for i, (m, p) in enumerate([("initialize", {}), ("tools/list", {}), ("tools/call", {"name": "exists", "arguments": {"pattern": "greet"}}), ("tools/call", {"name": "exists", "arguments": {"x": 1}}), ("nothing", {}), ("tools/call", {"name": "read", "arguments": {"file": "absent"}})])]
    out = io.StringIO()
    server.serve(space, io.StringIO("\n".join([*rpc, "{", '{"method": "note"}'])), out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(said) == 7 and len(said[1]["result"]["tools"]) == 6 and json.loads(said[2]["result"]["content"][0]["text"])["data"]["exists"] and said[3]["error"]["code"] == -32602 and said[4]["error"]["code"] == -32601 and said[5]["result"]["isError"] and said[6]["error"]["code"] == -32700
    compared = api.compare(space, str(root))
    assert compared["summary"]["total_tasks"] == 6 and [t["name"] for t in compared["tasks"]][0] == "search_literal"
    (tmp_path / "labelled.json").write_text(json.dumps({"queries": [{"query": "greet someone with a name", "category": "semantic", "relevant": [{"file": "lib.py", "relevance": 3}]}, {"query": "helper", "category": "symbol", "relevant": [{"file": "none.rs", "relevance": 1}]}]}))
    judged = api.judge(space, str(tmp_path / "labelled.json"))
    assert judged["misses"] == ["helper"] and judged["by_category"]["semantic"]["ndcg10"] == 1.0 and judged["all"]["count"] == 2 and api.plain([judged["all"]]).splitlines()[0].startswith("category")
    error = json.loads(api.run(space, "read", file="absent", telemetry=None))
    assert error["error"]["code"] == "file_not_found"
    plain = json.loads(api.run(space, "search", query="fn (", mode="literal", errors=str(tmp_path / "errors")))
    assert plain["fallback"] and stores.json_lines(spark, str(tmp_path / "errors"), stores.ERRORS).count() == 1
    api.run(space, "find", pattern="*.rs", telemetry=str(tmp_path / "calls"))
    calls = stores.json_lines(spark, str(tmp_path / "calls"), stores.TELEMETRY)
    assert tuple(calls.select("command", "baseline_bytes", "baseline_strategy").first()) == ("find", 120, "find_ls")
    assert stores.remove(spark, str(tmp_path / "calls"))
    (tmp_path / "in.jsonl").write_text('{"id": "1", "cmd": "read", "file": "main.rs", "hash": true}\n\nnot json\n{"cmd": "jump"}\n{"id": "4", "cmd": "exists", "pattern": "greet"}\n{"x": 1}\n')
    answers = api.batch(space, stores.commands(spark, str(tmp_path / "in.jsonl")))
    assert [a["status"] for a in answers] == ["ok", "error", "error", "ok", "error"] and answers[3]["data"]["exists"] and "unknown command" in answers[2]["error"]
    (tmp_path / "set.json").write_text(json.dumps({"root": "r", "queries": [{"query": "q", "category": "symbol", "relevant": [{"file": "a", "relevance": 3}]}]}))
    asked, labels = stores.dataset(spark, str(tmp_path / "set.json"))
    assert tuple(asked.first()) == (0, "q", "symbol", False) and tuple(labels.first()) == (0, 0, "a", 3)
    subprocess.run("git init -q . && git add -A -f && git -c user.name=a -c user.email=b commit -qm x && echo y >> lib.py", shell=True, cwd=root, check=True)
    assert [r["path"] for r in stores.changed_files(spark, str(root)).collect()] == ["lib.py"] and stores.at_commit(spark, str(root), "HEAD", ["lib.py", "absent"]).count() == 1
    assert stores.changed_files(spark, str(root), "nonsense") is None and stores.workspace_root(str(root / "pkg")) == str(root)
    assert space.diff(stores.at_commit(spark, str(root), "HEAD", ["lib.py", "main.rs", "data.json", "pkg/__init__.py", ".gitignore", "keep.log", ".hidden.py"]))["summary"] == "1 file(s) changed, +1 -0"


def test_streams(spark, tmp_path):
    import time

    from lodestrata.streaming import watch

    root, inbox = tmp_path / "tree", tmp_path / "in"
    root.mkdir()
    inbox.mkdir()
    (root / "a.py").write_text("def first():\n    pass\n")
    states: list[str] = []
    query = watch.follow(spark, str(root), str(tmp_path / "index"), str(tmp_path / "c1"), done=states.append)
    try:
        until = time.time() + 120
        names = lambda: {r["path"] for r in t["files"].collect()} if (t := stores.load(spark, str(tmp_path / "index"))) else set()
        while not states and time.time() < until:
            time.sleep(0.3)
        assert names() == {"a.py"}
        (root / "b.py").write_text("def second():\n    pass\n")
        (root / "a.py").unlink()
        # A batch may have listed the files in between; the one after it puts that right.
        while names() != {"b.py"} and time.time() < until:
            time.sleep(1)
    finally:
        query.stop()
    assert names() == {"b.py"}
    (inbox / "1.jsonl").write_text('{"id": "7", "cmd": "exists", "pattern": "greet"}\nbad\n')
    watch.answer(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "c2"), api.Workspace(files(spark, TREE))).awaitTermination(120)
    got = sorted(json.loads(r["value"])["status"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert got == ["error", "ok"]


def test_models(spark, tmp_path):
    import numpy as np

    for kind, name in ((np.float32, "F32"), (np.float16, "F16")):
        body = np.arange(12, dtype=kind).reshape(3, 4).tobytes()
        head = json.dumps({"__metadata__": {}, "x": {"dtype": "I32", "shape": [1], "data_offsets": [0, 0]}, "my_embed": {"dtype": name, "shape": [3, 4], "data_offsets": [0, len(body)]}}).encode()
        (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + body)
        (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": {"hello": 0, "world": 2, "beyond": 9}}}))
        rows = models.vocabulary(spark, str(tmp_path / "m.safetensors"), str(tmp_path / "t.json")).collect()
        assert {r["token"]: (r["token_id"], r["vec"]) for r in rows} == {"hello": (0, [0.0, 1.0, 2.0, 3.0]), "world": (2, [8.0, 9.0, 10.0, 11.0])}
    with pytest.raises(ValueError, match="embedding matrix"):
        models.matrix(struct.pack("<Q", 2) + b"{}")
    assert models.verified(str(tmp_path / "t.json"), hashlib.sha256((tmp_path / "t.json").read_bytes()).hexdigest()) and not models.verified(str(tmp_path / "t.json"), "0" * 64)
    found = models.bloom(files(spark, {f"f{i}": f"word{i} getName{i}" for i in range(300)}).repartition(5))
    assert found.has([f"word{i}" for i in range(300)]).all() and found.has([f"other{i}" for i in range(2000)]).mean() < 0.02
    assert models.probably_exists(found, ["word1", "name"]) == (False, "exact") and models.probably_exists(found, ["word1", "get"]) == (True, "probable") and models.probably_exists(found, []) == (False, "exact")
    small = models.Bloom(1000, 0.02)
    small.add([f"a{i}" for i in range(1000)])
    assert 0.005 < small.has([f"b{i}" for i in range(20000)]).mean() < 0.04
