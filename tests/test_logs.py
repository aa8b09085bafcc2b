"""Every parser on outputs of its tool, with the result that the tool's output says."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import lines, logs

# tool: (exit, stdout, stderr, summary, passed, failed, skipped, failures, warnings, tail); diagnostics as name|location|message.
CASES = {
    "cargo_test": [
        (101, "running 3 tests\ntest a ... ok\n\nfailures:\n\n---- m::b stdout ----\nthread 'm::b' panicked at src/x.rs:10:5:\nassertion failed\n  left: 1\nnote: run with BACKTRACE\n\n---- m::c stdout ----\nboom\n\nfailures:\n    m::b\n\ntest result: FAILED. 1 passed; 2 failed; 3 ignored; 0 measured\ntest result: ok. 9 passed; 0 failed; 0 ignored\n", "", "1 passed, 2 failed, 3 ignored", 1, 2, 3, ["m::b|src/x.rs:10:5|assertion failed\nleft: 1", "m::c||boom"], [], None),
        (0, "nothing", "", "0 passed, 0 failed", 0, 0, 0, [], [], None),
    ],
    "cargo_build": [
        (101, "", "error[E0308]: mismatched types\n  --> src/main.rs:4:5\n   |\nwarning: unused variable\n\nerror: aborting\n", "2 error(s), 1 warning(s)", 0, 2, 0, ["error[E0308]|src/main.rs:4:5|mismatched types", "error||aborting"], ["warning||unused variable"], None),
        (0, "Finished", "", "build succeeded", 0, 0, 0, [], [], None),
    ],
    "cargo_llvm_cov": [
        (0, "test result: ok. 1 passed; 0 failed; 0 ignored\ntest result: ok. 5 passed; 1 failed; 2 ignored\nsrc/a.rs   100  50  50.00%  3\nsrc/b.rs   10  1  90.00%\nTOTAL   110  51  53.64%\n", "", "53.64% coverage, 5 passed, 1 failed", 5, 1, 2, ["src/a.rs||50.00% line coverage"], [], None),
        (0, "", "", "0 passed, 0 failed", 0, 0, 0, [], [], None),
    ],
    "pytest": [
        (1, "====== test session starts ======\ncollected 3 items\nFAILED tests/a.py::t - assert 1 == 2\n=== 1 failed, 2 passed, 4 skipped in 0.1s ===\n", "", "1 failed, 2 passed, 4 skipped in 0.1s", 2, 1, 4, ["tests/a.py::t||assert 1 == 2"], [], None),
        (0, "== 3 passed ==\n== no tests ran ==\n", "", "no tests ran", 3, 0, 0, [], [], None), (0, "", "", "0 passed, 0 failed", 0, 0, 0, [], [], None),
    ],
    "pytest_cov": [(0, "a.py      10   5  50%\nb/c.py    10   0  100%\nTOTAL     20   5  75%\n", "", "75% total coverage (20 stmts, 5 missed)", 0, 0, 0, [], ["a.py||50% coverage"], None), (0, "x", "", "no coverage data", 0, 0, 0, [], [], None)],
    "go_test": [(1, "--- FAIL: TestA (0.00s)\n    a_test.go:12: got 1\n        more\n--- FAIL: TestB (0.00s)\n    no place\nFAIL\texample.com/a\t0.01s\nok  \texample.com/b\t0.2s\n", "", "1 ok, 1 failed", 1, 1, 0, ["TestA|a_test.go:12|a_test.go:12: got 1\nmore", "TestB||no place"], [], None)],
    "go_cover": [
        (0, "ok  \tpkg/a\t0.1s\tcoverage: 90.0% of statements\nok  \tpkg/b\t0.1s\tcoverage: 50.5% of statements\n", "", "70.3% average coverage across 2 packages (unweighted)", 0, 1, 0, ["pkg/b||50.5% coverage"], [], None),
        (0, "PASS\ncoverage: 88.0% of statements\n", "", "88.0% average coverage across 1 packages (unweighted)", 1, 0, 0, [], [], None), (0, "", "", "no coverage data", 1, 0, 0, [], [], None),
    ],
    "jest": [
        (1, "  ● Suite › works\n\n    expect(1)\n      at Object.<anonymous> (src/a.test.js:5:9)\n      at run (node.js:1:1)\n  ● other\n    bad\nTests:       2 failed, 3 passed, 5 total\n", "", "3 passed, 2 failed", 3, 2, 0, ["Suite › works|src/a.test.js:5:9|expect(1)", "other||bad\nTests:       2 failed, 3 passed, 5 total"], [], None),
        (0, " Tests  1 failed | 7 passed (8)\n", "", "7 passed, 1 failed", 7, 1, 0, [], [], None), (0, "", "", "0 passed, 0 failed", 0, 0, 0, [], [], None),
    ],
    "jest_cov": [(0, "All files |   71.5 |  50 |\n  a.ts    |   60.1 |  1 |\n  b.js    |   95 |\nTests: 4 passed, 6 total\n", "", "71.5% statement coverage", 4, 2, 0, [], ["a.ts||60.1% statement coverage"], None), (0, "Tests: 2 passed, 2 total", "", "2 passed, 0 failed", 2, 0, 0, [], [], None)],
    "tsc": [(2, "src/a.ts(3,5): error TS2322: Type 'x'.\nsrc/b.ts(1,1): warning TS6133: unused\n", "", "1 error(s), 1 warning(s)", 0, 1, 0, ["TS2322|src/a.ts:3:5|Type 'x'."], ["TS6133|src/b.ts:1:1|unused"], None), (0, "", "", "no errors", 0, 0, 0, [], [], None)],
    "eslint": [
        (1, "\n/src/a.js\n  1:5  error  Unexpected var  no-var\n  2:1  warning  Missing semicolon  semi\n\n/src/b.js\n  9:9  error  Bad thing here  rule/x\n\n✖ 3 problems (2 errors, 1 warning)\n", "", "2 error(s), 1 warning(s)", 0, 2, 0, ["no-var|/src/a.js:1:5|Unexpected var", "rule/x|/src/b.js:9:9|Bad thing here"], ["semi|/src/a.js:2:1|Missing semicolon"], None),
        (1, json.dumps([{"filePath": "/a.js", "messages": [{"ruleId": "r", "severity": 2, "message": "m", "line": 1, "column": 2}, {"ruleId": "w", "severity": 1, "message": "n", "line": 3, "column": 4}, {"severity": 2, "message": "no rule", "line": 1, "column": 1}]}]), "", "1 error(s), 1 warning(s)", 0, 1, 0, ["r|/a.js:1:2|m"], ["w|/a.js:3:4|n"], None),
        (0, "", "", "no issues", 0, 0, 0, [], [], None), (0, "{}", "", "no issues", 0, 0, 0, [], [], None),
    ],
    "mypy": [
        (1, "a.py:3: error: Bad type\nb.pyi:4:7: warning: Odd\na.py:3: note: hint\nFound 1 error in 1 file (checked 2)\n", "", "1 error(s) in 1 file(s)", 0, 1, 0, ["mypy/error|a.py:3|Bad type"], ["mypy/warning|b.pyi:4:7|Odd"], None),
        (0, "Success: no issues found in 2 files\n", "", "no issues found", 0, 0, 0, [], [], None), (0, "", "", "clean", 0, 0, 0, [], [], None),
    ],
    "git_log": [(0, "commit 0123456789abcdef0123456789abcdef01234567\nMerge: a b\nAuthor: Ann Lee <a@b>\nDate:   today\n\n    First line\n    more\n\ncommit abcdef0\n\n    No author\n\ncommit 1111111\nAuthor: X <y>\n", "", "2 commit(s)", 0, 0, 0, [], [], "0123456 [Ann Lee] First line\nabcdef0 [?] No author"), (0, "", "", "0 commit(s)", 0, 0, 0, [], [], None)],
    "docker_build": [
        (1, "Sending build context\nStep 1/2 : FROM x\n ---> abc\nabc: Pull complete\nStep 2/2 : RUN make\nmake: bad\nThe command '/bin/sh' returned a non-zero code: 2\n", "ERROR: failed\n", "build FAILED at Step 2/2: RUN make", 0, 2, 0, ["docker/exit_2|Step 2/2: RUN make|The command '/bin/sh' returned a non-zero code: 2", "docker/error|Step 2/2: RUN make|failed"], [], "Step 1/2 : FROM x\nStep 2/2 : RUN make\nmake: bad\nThe command '/bin/sh' returned a non-zero code: 2\n\nERROR: failed"),
        (0, "Successfully built abc\nSuccessfully tagged x:1\n", "", "build succeeded (built abc, tagged x:1)", 0, 0, 0, [], [], None), (0, "", "", "build complete", 0, 0, 0, [], [], None),
    ],
    "terraform": [
        (0, "  # aws_x.a will be created\n  # aws_x.b will be destroyed\nPlan: 1 to add, 0 to change, 1 to destroy.\nWarning: Old thing\n", "", "plan: 1 add, 0 change, 1 destroy", 0, 0, 0, [], ["terraform/warning||Old thing"], "aws_x.a (created)\naws_x.b (destroyed)"),
        (0, "Apply complete! Resources: 2 added, 1 changed, 0 destroyed.\n", "", "apply: 2 added, 1 changed, 0 destroyed", 0, 0, 0, [], [], None), (0, "No changes. Fine.\n", "", "no changes", 0, 0, 0, [], [], None), (1, "Error: broken\n", "", "1 error(s)", 0, 1, 0, ["terraform/error||broken"], [], None),
        (0, '{"@level":"info","@message":"Plan: 1","type":"change_summary"}\n{"type":"planned_change","resource":"aws.a","change":{"actions":["create","delete"]}}\n{"@level":"error","@message":"bad"}\nnot json\n', "", "Plan: 1", 0, 1, 0, ["terraform/error||bad"], [], "aws.a (create)\naws.a (delete)"), (0, "", "", "terraform complete", 0, 0, 0, [], [], None),
    ],
    "kubectl": [
        (0, "Name: p\nStatus:       Pending\nConditions:\n  Type    Status\n  Ready   False\n  Initialized   True\n    Restart Count:  3\nEvents:\n  Ready  False\n  Normal   Pulled  1m  kubelet  ok\n  Warning  BackOff  2m  kubelet  Back-off restarting  \n", "", "status: Pending, 2 problem(s), 2 warning(s)", 0, 2, 0, ["kubectl/phase||status: Pending", "kubectl/condition/Ready||Ready=False"], ["kubectl/restarts||restart count: 3", "kubectl/event/BackOff||Back-off restarting"], None),
        (0, json.dumps({"items": [{"status": {"phase": "Failed", "conditions": [{"type": "Ready", "status": "False"}], "events": [{"type": "Warning", "reason": "R", "message": "m"}], "containerStatuses": [{"restartCount": 2}, {"restartCount": 0}]}}, {"status": {"phase": "Running"}}]}), "", "status: Running, 2 problem(s), 2 warning(s)", 0, 2, 0, ["kubectl/phase||status: Failed", "kubectl/condition/Ready||Ready=False"], ["kubectl/event/R||m", "kubectl/restarts||restart count: 2"], None),
        (0, "x", "", "0 problem(s), 0 warning(s)", 0, 0, 0, [], [], None),
    ],
    "kubectl_logs": [
        (0, "starting\nERROR one\nERROR one\nERROR one\nINFO then ERROR\nWARNING two\nfatal three\n", "", "2 error(s)/fatal(s), 1 warning(s)", 0, 2, 0, ["log/ERROR||ERROR one [repeated 3 times]", "log/FATAL||fatal three"], ["log/WARN||WARNING two"], "context: starting\nERROR one [repeated 3 times]\nWARNING two\nfatal three"),
        (0, "ERROR a\nplain\nERROR b\n", "", "2 error(s)/fatal(s), 0 warning(s)", 0, 2, 0, ["log/ERROR||ERROR a", "log/ERROR||ERROR b"], [], "ERROR a\ncontext: plain\nERROR b"), (0, "", "", "0 error(s)/fatal(s), 0 warning(s)", 0, 0, 0, [], [], None),
    ],
    "mvn": [
        (1, "[INFO] Downloading from x\n[ERROR] /src/A.java:[3,7] cannot find symbol\n[ERROR] plain\nTests run: 5, Failures: 1, Errors: 1, Skipped: 1\n[INFO] BUILD FAILURE\n", "", "BUILD FAILURE, 2 error(s)", 2, 2, 1, ["mvn/error|/src/A.java:3:7|cannot find symbol", "mvn/error||plain"], [], None),
        (0, "Tests run: 5, Failures: 0, Errors: 0, Skipped: 1\n[INFO] BUILD SUCCESS\n", "", "BUILD SUCCESS, 4 passed, 0 failed, 1 skipped", 4, 0, 1, [], [], None), (0, "[INFO] BUILD SUCCESS", "", "BUILD SUCCESS", 0, 0, 0, [], [], None), (0, "", "", "complete", 0, 0, 0, [], [], None),
    ],
    "gradle": [
        (1, "Download x\n> Task :compileJava FAILED\nA.java:9: error: ';' expected\nBUILD FAILED in 1s\n", "", "BUILD FAILED, tasks: :compileJava", 0, 2, 0, ["gradle/task_failed||task :compileJava FAILED", "gradle/compile_error|A.java:9|';' expected"], [], None),
        (1, "7 tests completed, 2 failed\nBUILD FAILED\n", "", "BUILD FAILED, 0 error(s)", 5, 2, 0, [], [], None), (0, "BUILD SUCCESSFUL", "", "BUILD SUCCESSFUL", 0, 0, 0, [], [], None),
    ],
    "dotnet": [
        (1, "A.cs(1,2): error CS1002: ; expected\nB.cs(3,4): warning CS0168: unused\nBuild FAILED.\n", "", "build FAILED, 1 error(s)", 0, 1, 0, ["dotnet/CS1002|A.cs:1:2|; expected"], ["dotnet/CS0168|B.cs:3:4|unused"], None),
        (0, "Passed!  - Failed:     0, Passed:    12, Skipped:     1, Total: 13\n", "", "12 passed, 0 failed, 1 skipped", 12, 0, 1, [], [], None), (0, "Build succeeded.\n", "", "build succeeded, 0 warning(s)", 0, 0, 0, [], [], None), (0, "", "", "clean", 0, 0, 0, [], [], None),
    ],
    "npm_ls": [
        (1, "x@1.0.0 /x\n├── a@1.0.0\n├─┬ b@2.0.0\n│ └── c@1\n└── UNMET DEPENDENCY d@3\nnpm ERR! missing: d\nnpm WARN old\n", "", "2 top-level dep(s), 2 problem(s), 1 warning(s)", 0, 2, 0, ["npm/dep_problem||UNMET DEPENDENCY d@3", "npm/ERR!||missing: d"], ["npm/WARN||old"], "a@1.0.0\nb@2.0.0"),
        (0, json.dumps({"dependencies": {"z": {"version": "1"}, "a": {"version": "2", "problems": ["p1", "p2"], "invalid": True}, "m": {"version": "3", "missing": True}, "n": {"required": 1}}}), "", "1 top-level dep(s), 4 problem(s), 0 warning(s)", 0, 4, 0, ["npm/dep_problem||a: p1", "npm/dep_problem||a: p2", "npm/dep_problem||a: invalid", "npm/dep_problem||m: missing"], [], "z@1"),
    ],
    "unknown": [(0, "\n".join(map(str, range(15))), "", "exited 0", 0, 0, 0, [], [], "\n".join(map(str, range(5, 15)))), (3, "\n".join(map(str, range(25))), "err", "exited 3", 0, 1, 0, [], [], "\n".join([*map(str, range(6, 25)), "err"]))],
}
RUN = "run_id long, tool string, exit_code int, stdout string, stderr string, duration_ms long"


def flat(diags):
    return ["|".join([d["name"], d["location"] or "", d["message"]]) for d in diags]


@pytest.mark.parametrize("tool", sorted(CASES))
def test_parser(spark, tool):
    runs = spark.createDataFrame([(i, tool, *c[:3], 5) for i, c in enumerate(CASES[tool])], RUN)
    for r, (_, out, err, summary, passed, failed, skipped, failures, warnings, tail) in zip(logs.parse(runs, [tool]).orderBy("run_id").collect(), CASES[tool], strict=True):
        assert (r["summary"], r["passed"], r["failed"], r["skipped"], flat(r["failures"]), flat(r["warnings"]), r["tail"]) == (summary, passed, failed, skipped, failures, warnings, tail)
        spent = len(summary.encode()) + sum(len((d["name"] + d["message"] + (d["location"] or "")).encode()) for d in [*r["failures"], *r["warnings"]]) + len((tail or "").encode())
        assert r["output_tokens_saved"] == max(0, len(f"{out}\n{err}".encode()) // 4 - spent // 4)


def test_runs(spark):
    runs = spark.createDataFrame([(0, ["cargo", "test"], 0, CASES["cargo_test"][0][1], "", 1), (1, ["ls"], 2, "a", "b", 1)], "run_id long, command array<string>, exit_code int, stdout string, stderr string, duration_ms long")
    got = logs.parse(runs, ["cargo_test"]).orderBy("run_id").collect()
    assert [(r["tool"], r["failed"]) for r in got] == [("cargo_test", 2), ("unknown", 1)]
    raw = logs.parse(runs, raw=True).orderBy("run_id").collect()[1]
    assert (raw["tool"], raw["summary"], raw["tail"], raw["output_tokens_saved"], raw["output_lines"]) == ("raw", "exited 2", "a\nb", 0, 2) and logs.parse(runs, ["cargo_test"], full=True).where("run_id = 1").first()["tail"] == "a\nb"


def test_windows_over_rows(spark):
    text = ["-- a", "x", "y", "-- b", "y", "y", "z"]
    rows = spark.createDataFrame([(f, i + 1, t) for f in (1, 2) for i, t in enumerate(text)], "file_id int, line int, text string")
    one = lambda df, c: [r[c] for r in df.where("file_id = 1").orderBy("line").collect()]
    assert one(lines.sections(rows, "^-- "), "section") == [1, 1, 1, 2, 2, 2, 2] and one(lines.next_line(rows), "next") == [*text[1:], None]
    assert one(lines.carry(rows, F.when(F.col("text").startswith("--"), F.col("text")), "head"), "head") == ["-- a"] * 3 + ["-- b"] * 4 and one(lines.tail(rows, 2), "text") == ["y", "z"]
    assert sorted(tuple(r) for r in lines.collapse(rows, "file_id", ["line"], "text").where("file_id = 1").collect()) == [(1, 1, "-- a", 1), (1, 2, "x", 1), (1, 3, "y", 1), (1, 4, "-- b", 1), (1, 5, "y", 2), (1, 6, "z", 1)]
    log = spark.createDataFrame([(1, i, t) for i, t in enumerate(["ERROR a", "ERROR a", "INFO b", "WARN c", "ERROR a"])], "file_id int, line int, text string")
    assert sorted((r["run"], r["level"], r["display"]) for r in lines.log_runs(log, "file_id", ["line"]).collect()) == [(1, "ERROR", "ERROR a [repeated 2 times]"), (3, "WARN", "WARN c"), (4, "ERROR", "ERROR a")]
    costs = spark.createDataFrame([(g, i, c) for g in (None, 1 << 60, (1 << 60) + 1) for i, c in enumerate([5, 7, 3, 9, 1])], "g long, i int, c long")
    assert {(r["g"], r["c"]) for r in lines.retain(costs, ["g"], ["i"], F.col("c"), 10).collect()} == {(g, c) for g in (None, 1 << 60, (1 << 60) + 1) for c in (5, 3, 1)}
