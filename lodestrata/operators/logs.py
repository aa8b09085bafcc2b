"""What tools print, read as diagnostics: runs(run_id, command, exit_code, stdout, stderr, duration_ms) to one row each.

A run's lines are one array; every parser is an expression over it, so a run is read where it lies and nothing is
shuffled. Headers with their sections, next lines, carried values, runs of equal lines and tails are array
operations here; for lines of one run spread over many rows ``lines`` has them as windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as fn
from lodestrata.operators import lines

# How a command line names its tool; the first rule that holds decides. "^" begins the line, "~" occurs anywhere.
TOOLS = [
    ("cargo_llvm_cov", "~cargo llvm-cov", "~cargo-llvm-cov"), ("cargo_test", "^cargo test"), ("cargo_clippy", "^cargo clippy"), ("cargo_build", "^cargo build", "^cargo check"),
    ("jest_cov", "~--coverage", "^c8 ", "^nyc "), ("pytest_cov", "~--cov", "^coverage report", "^coverage run"), ("pytest", "~pytest"), ("go_cover", "~-cover", "^go tool cover"),
    ("go_test", "^go test"), ("jest", "~vitest"), ("jest", "~jest", "^npm test"), ("tsc", "^tsc", "^npx tsc"), ("eslint", "~eslint"), ("mypy", "~mypy"), ("git_log", "^git log"),
    ("docker_build", "^docker build"), ("terraform", "^terraform"), ("kubectl_logs", "~kubectl logs", "~docker logs"), ("kubectl", "^kubectl"), ("mvn", "^mvn", "~mvnw"),
    ("gradle", "^gradle", "~gradlew"), ("dotnet", "^dotnet"), ("npm_ls", "^npm list", "^npm ls"),
]
# The argument that makes a tool print JSON.
JSON_FLAGS = {"kubectl": "-o=json", "terraform": "-json", "npm_ls": "--json", "eslint": "--format=json", "mypy": "--output=json"}

_DIAG = "array<struct<name:string,location:string,message:string>>"
_NONE = F.array


def detect_tool(command: Column) -> Column:
    """The tool of a command line (an array of arguments); unknown if no rule holds."""
    line, out = F.lower(F.array_join(command, " ")), None
    for tool, *rules in TOOLS:
        holds = None
        for rule in rules:
            one = line.startswith(rule[1:]) if rule[0] == "^" else line.contains(rule[1:])
            holds = one if holds is None else holds | one
        out = F.when(holds, tool) if out is None else out.when(holds, tool)
    return out.otherwise("unknown")


def inject_json(command: Column) -> Column:
    """The command with its tool's JSON flag, unless an argument speaks of json already."""
    flag = F.try_element_at(F.create_map(*[F.lit(x) for p in JSON_FLAGS.items() for x in p]), detect_tool(command))
    return F.when(flag.isNotNull() & ~F.exists(command, lambda a: a.contains("json")), F.array_append(command, flag)).otherwise(command)


def _hits(ls: Column, pattern: str) -> Column:
    return F.filter(ls, lambda x: x.rlike(pattern))


def _last(ls: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(F.try_element_at(_hits(ls, pattern), F.lit(-1)), pattern, group)


def _int(text: Column) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(0).cast("long"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _diag(name: Column | str, message: Column, location: Column | None = None) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(name.alias("name"), (F.lit(None).cast("string") if location is None else location).alias("location"), message.alias("message"))


def _each(ls: Column, pattern: str, make: Callable[[Column], Column]) -> Column:
    return F.transform(_hits(ls, pattern), make).cast(_DIAG)


def _group(x: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(x, pattern, i)


def _at(x: Column, pattern: str, *groups: int) -> Column:
    return F.concat_ws(":", *[_group(x, pattern, g) for g in groups])


def _place(ls: Column) -> Column:
    return F.transform(ls, lambda x, i: F.struct(x.alias("x"), i.alias("i")))


def _full(ls: Column) -> Column:
    return F.filter(F.transform(ls, fn.strip), lambda x: x != "")


def _sections(ls: Column, header: str, stop: str) -> Column:
    """array<struct<head, body>>: the lines after each header up to the first that matches stop; every header does."""

    def body(i: Column) -> Column:
        rest = F.slice(ls, i + 2, F.size(ls))
        end = F.array_position(F.transform(rest, lambda x: x.rlike(stop)), True).cast("int")
        return F.when(end > 0, F.slice(rest, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(rest)

    return F.transform(F.filter(_place(ls), lambda s: s["x"].rlike(header)), lambda s: F.struct(s["x"].alias("head"), body(s["i"]).alias("body")))


def _counted(errors: Column, warnings: Column, clean: str = "clean") -> Column:
    e, w = _text(errors, " error(s)"), _text(warnings, " warning(s)")
    return F.when((errors == 0) & (warnings == 0), clean).when(warnings == 0, e).when(errors == 0, w).otherwise(_text(e, ", ", w))


def _result(summary: Column, passed=0, failed=None, skipped=0, failures: Column | None = None, warnings: Column | None = None, tail: Column | None = None) -> Column:
    failures = F.array().cast(_DIAG) if failures is None else failures.cast(_DIAG)
    number = lambda n: (F.lit(n) if isinstance(n, int) else n).cast("long")
    return F.struct(
        summary.alias("summary"), number(passed).alias("passed"), number(F.size(failures) if failed is None else failed).alias("failed"), number(skipped).alias("skipped"),
        failures.alias("failures"), (F.array().cast(_DIAG) if warnings is None else warnings.cast(_DIAG)).alias("warnings"), (F.lit(None).cast("string") if tail is None else tail).alias("tail"),
    )


def _listed(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.array_join(found, "\n"))


def _low(ls: Column, pattern: str, after: str) -> Column:
    """Files whose coverage, group 2 of the pattern, is under 80 %."""
    share = lambda x: F.coalesce(F.regexp_replace(_group(x, pattern, 2), "%$", "").try_cast("float"), F.lit(100.0))
    return F.transform(F.filter(_hits(ls, pattern), lambda x: share(x) < 80), lambda x: _diag(_group(x, pattern, 1), _text(_group(x, pattern, 2), after))).cast(_DIAG)


_CARGO = r"test result: (ok|FAILED)\. (\d+) passed; (\d+) failed; (\d+) ignored"


def cargo_test(ls, out, code):
    first = F.get(_hits(ls, _CARGO), F.lit(0))
    p, f, s = (_int(_group(first, _CARGO, i)) for i in (2, 3, 4))
    p, f, s = (F.coalesce(x, F.lit(0).cast("long")) for x in (p, f, s))
    panic = r"panicked at (.+):(\d+)"

    def failure(x):
        where = F.try_element_at(_hits(x["body"], panic), F.lit(-1))
        said = _full(F.filter(x["body"], lambda l: ~l.rlike(panic) & ~l.rlike("^(note:|thread ')")))
        return _diag(_group(x["head"], r"^---- (.+) stdout ----$", 1), F.array_join(said, "\n"), F.when(where.isNotNull(), _at(where, panic, 1, 2)))

    failures = F.transform(_sections(ls, r"^---- (.+) stdout ----$", "^(----|failures:)"), failure)
    ends = F.when(first.isNotNull(), _text(", ", s, " ignored")).otherwise("")
    return _result(_text(p, " passed, ", f, " failed", ends), p, f, s, failures)


def cargo_build(ls, out, code):
    error, place = r"^(error|warning)(\[E\d+\])?: (.+)$", r"^\s+--> (.+):(\d+):(\d+)$"
    found = F.filter(F.transform(ls, lambda x, i: F.struct(x.alias("x"), F.get(ls, i + 1).alias("next"))), lambda s: s["x"].rlike(error))
    made = lambda kind: F.transform(F.filter(found, lambda s: s["x"].startswith(kind)), lambda s: _diag(_text(_group(s["x"], error, 1), _group(s["x"], error, 2)), _group(s["x"], error, 3), F.when(s["next"].rlike(place), _at(s["next"], place, 1, 2, 3))))
    return _result(_counted(F.size(made("error")), F.size(made("warning")), "build succeeded"), failures=made("error"), warnings=made("warning"))


def cargo_llvm_cov(ls, out, code):
    p, f, s = (F.coalesce(_int(_last(ls, _CARGO, i)), F.lit(0).cast("long")) for i in (2, 3, 4))
    total = _last(ls, r"^TOTAL\s+\d+\s+\d+\s+([\d.]+%)")
    counts = _text(p, " passed, ", f, " failed")
    return _result(F.when(total.isNull(), counts).otherwise(_text(total, " coverage, ", counts)), p, f, s, _low(ls, r"^\s*(\S+\.rs)\s+\d+\s+\d+\s+([\d.]+%)", " line coverage"))


def pytest(ls, out, code):
    banner = r"=+ (.+) =+\s*$"
    texts = F.transform(_hits(ls, banner), lambda x: _group(x, banner, 1))
    p, f, s = (F.coalesce(_int(_last(texts, rf"(\d+) {w}")), F.lit(0).cast("long")) for w in ("passed", "failed", "skipped"))
    line = r"^FAILED (.+?) - (.+)$"
    summary = F.coalesce(F.nullif(fn.strip(F.try_element_at(texts, F.lit(-1))), F.lit("")), _text(p, " passed, ", f, " failed"))
    return _result(summary, p, f, s, _each(ls, line, lambda x: _diag(_group(x, line, 1), _group(x, line, 2))))


def pytest_cov(ls, out, code):
    total, counts = _last(ls, r"^TOTAL\s+\d+\s+\d+\s+([\d.]+%)"), r"^TOTAL\s+(\d+)\s+(\d+)"
    stmts, missed = (F.coalesce(_int(_last(ls, counts, i)), F.lit(0).cast("long")) for i in (1, 2))
    summary = F.coalesce(_text(total, " total coverage (", stmts, " stmts, ", missed, " missed)"), F.lit("no coverage data"))
    return _result(summary, failed=0, warnings=_low(ls, r"^(\S+\.py)\s+\d+\s+\d+\s+([\d.]+%)", " coverage"))


def go_test(ls, out, code):
    package = r"^(ok|FAIL)\s+(\S+)\s+([\d.]+)s"

    def failure(x):
        said = _full(x["body"])
        first = F.get(said, F.lit(0))
        return _diag(_group(x["head"], r"^--- FAIL: (\S+)", 1), F.array_join(said, "\n"), F.when(first.contains(".go:"), F.substring_index(first, ":", 2)))

    failures = F.transform(_sections(ls, r"^--- FAIL: (\S+)", f"^---|{package}"), failure)
    ok, bad = (F.size(F.filter(_hits(ls, package), lambda x: x.startswith(w))) for w in ("ok", "FAIL"))
    return _result(_text(ok, " ok, ", bad, " failed"), ok, bad, 0, failures)


def go_cover(ls, out, code):
    package, alone = r"^(ok|FAIL)\s+(\S+)\s+[\d.]+s\s+coverage:\s+([\d.]+)%", r"coverage:\s+([\d.]+)%\s+of\s+statements"
    share = lambda x: F.coalesce(_group(x, package, 3).try_cast("double"), F.lit(0.0))
    singles = F.filter(F.transform(ls, lambda x, i: F.when(x.rlike(r"^(PASS|FAIL)\s*$"), F.get(ls, i + 1))), lambda x: F.coalesce(x.rlike(alone), F.lit(False)))
    all_ = F.concat(F.transform(_hits(ls, package), share), F.transform(singles, lambda x: F.coalesce(_group(x, alone, 1).try_cast("double"), F.lit(0.0))))
    low = F.transform(F.filter(_hits(ls, package), lambda x: x.startswith("FAIL") | (share(x) < 80)), lambda x: _diag(_group(x, package, 2), _text(_group(x, package, 3), "% coverage")))
    mean = F.aggregate(all_, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(all_), F.lit(1))
    summary = F.when(F.size(all_) > 0, _text(F.format_string("%.1f", mean), "% average coverage across ", F.size(all_), " packages (unweighted)")).otherwise("no coverage data")
    return _result(summary, F.when(F.size(low) == 0, 1).otherwise(0), None, 0, low)


def jest(ls, out, code):
    forms = r"Tests:\s+(?:(\d+) failed, )?(\d+) passed, (\d+) total", r"Tests\s+(?:(\d+) failed \| )?(\d+) passed \((\d+)\)"
    line = F.try_element_at(F.filter(ls, lambda x: x.rlike(forms[0]) | x.rlike(forms[1])), F.lit(-1))
    f, p = (F.coalesce(_int(F.when(line.rlike(forms[0]), _group(line, forms[0], i)).otherwise(_group(line, forms[1], i))), F.lit(0).cast("long")) for i in (1, 2))
    at = r"at .+ \((.+):(\d+):(\d+)\)"

    def failure(x):
        where = F.get(_hits(F.transform(x["body"], fn.strip), at), F.lit(0))
        return _diag(fn.strip(_group(x["head"], r"^\s*●\s+(.+)$", 1)), F.array_join(F.filter(_full(x["body"]), lambda l: ~l.rlike(at)), "\n"), F.when(where.isNotNull(), _at(where, at, 1, 2, 3)))

    failures = F.transform(_sections(ls, r"^\s*●\s+(.+)$", r"^\s*●"), failure)
    return _result(_text(p, " passed, ", f, " failed"), p, f, 0, failures)


def jest_cov(ls, out, code):
    total, line = _last(ls, r"^All files\s+\|\s+([\d.]+)\s+\|"), r"Tests:\s+(\d+) passed, (\d+) total"
    p, n = (F.coalesce(_int(_last(ls, line, i)), F.lit(0).cast("long")) for i in (1, 2))
    f = F.greatest(n - p, F.lit(0))
    summary = F.coalesce(_text(total, "% statement coverage"), _text(p, " passed, ", f, " failed"))
    return _result(summary, p, f, warnings=_low(ls, r"^\s+(\S+\.(?:ts|tsx|js|jsx))\s+\|\s+([\d.]+)\s+\|", "% statement coverage"))


def tsc(ls, out, code):
    issue = r"^(.+)\((\d+),(\d+)\): (error|warning) (TS\d+): (.+)$"
    made = lambda kind: F.transform(F.filter(_hits(ls, issue), lambda x: _group(x, issue, 4) == kind), lambda x: _diag(_group(x, issue, 5), _group(x, issue, 6), _at(x, issue, 1, 2, 3)))
    return _result(_counted(F.size(made("error")), F.size(made("warning")), "no errors"), failures=made("error"), warnings=made("warning"))


def _json(out: Column, opening: str, schema: str) -> tuple[Column, Column]:
    """Whether the output is a JSON document that begins so, and the document."""
    trimmed = fn.strip(out)
    return trimmed.startswith(opening) & F.try_parse_json(trimmed).isNotNull(), F.from_json(trimmed, schema)


def eslint(ls, out, code):
    issue, closing = r"^\s+(\d+):(\d+)\s+(error|warning)\s+(.+?)\s{2,}(\S+)\s*$", r"(\d+) problems? \((\d+) errors?, (\d+) warnings?\)"
    named = lambda x: (fn.strip(x) != "") & ~fn.strip(x).rlike("^[✖×]") & ~x.rlike(issue) & ~x.rlike(closing)

    # One pass that carries the file's name along; only issues are appended.
    def step(s, x):
        diag = _diag(_group(x, issue, 5), _group(x, issue, 4), F.concat_ws(":", s["file"], _group(x, issue, 1), _group(x, issue, 2)))
        add = lambda kind, to: F.when(x.rlike(issue) & (_group(x, issue, 3) == kind), F.array_append(to, diag)).otherwise(to)
        return F.struct(F.when(named(x), fn.strip(x)).otherwise(s["file"]).alias("file"), add("error", s["e"]).alias("e"), add("warning", s["w"]).alias("w"))

    zero = F.struct(F.lit(None).cast("string").alias("file"), F.array().cast(_DIAG).alias("e"), F.array().cast(_DIAG).alias("w"))
    read_text = F.aggregate(ls, zero, step)
    is_json, doc = _json(out, "[", "array<struct<filePath:string,messages:array<struct<severity:bigint,message:string,line:bigint,column:bigint,ruleId:string>>>>")
    is_object, _ = _json(out, "{", "struct<a:int>")
    whole = lambda m: m["severity"].isNotNull() & m["message"].isNotNull() & (m["line"] >= 0) & (m["column"] >= 0) & m["ruleId"].isNotNull()
    flat = F.flatten(F.transform(F.filter(doc, lambda f: f["filePath"].isNotNull() & f["messages"].isNotNull()), lambda f: F.transform(F.filter(f["messages"], whole), lambda m: F.struct((m["severity"] == 2).alias("e"), _diag(m["ruleId"], m["message"], _text(f["filePath"], ":", m["line"], ":", m["column"])).alias("d")))))
    read = lambda e: F.transform(F.filter(flat, lambda m: m["e"] == e), lambda m: m["d"]).cast(_DIAG)
    none = F.array().cast(_DIAG)
    errors, warnings = (F.when(is_json, read(e)).when(is_object, none).otherwise(read_text[k]) for e, k in ((True, "e"), (False, "w")))
    return _result(_counted(F.size(errors), F.size(warnings), "no issues"), failures=errors, warnings=warnings)


def mypy(ls, out, code):
    issue = r"^(.+?\.pyi?):(\d+)(?::(\d+))?: (error|warning|note): (.+)$"
    place = lambda x: F.concat_ws(":", _group(x, issue, 1), _group(x, issue, 2), F.nullif(_group(x, issue, 3), F.lit("")))
    made = lambda kind: F.transform(F.filter(_hits(ls, issue), lambda x: _group(x, issue, 4) == kind), lambda x: _diag(f"mypy/{kind}", _group(x, issue, 5), place(x)))
    found = r"^Found (\d+) errors? in (\d+) files?"
    line = F.try_element_at(F.filter(ls, lambda x: ~x.rlike(issue) & (x.rlike(found) | x.rlike("^Success: no issues"))), F.lit(-1))
    said = F.when(line.rlike(found), _text(_group(line, found, 1), " error(s) in ", _group(line, found, 2), " file(s)")).when(line.isNotNull(), "no issues found")
    return _result(F.coalesce(said, _counted(F.size(made("error")), F.size(made("warning")))), failures=made("error"), warnings=made("warning"))


def git_log(ls, out, code):
    head, author = r"^commit ([0-9a-f]{7,40})", r"^Author:\s+(.+?)\s+<"

    def commit(x):
        subject = F.get(F.filter(x["body"], lambda l: (fn.strip(l) != "") & ~l.rlike("^(Date|Merge|Author):")), F.lit(0))
        return _text(F.substring(_group(x["head"], head, 1), 1, 7), " [", F.coalesce(_last(x["body"], author), F.lit("?")), "] ", fn.strip(subject))

    commits = F.filter(F.transform(_sections(ls, head, head), commit), lambda c: c.isNotNull())
    return _result(_text(F.size(commits), " commit(s)"), tail=_listed(commits))


def docker_build(ls, out, code):
    step, error, nonzero = r"^Step (\d+/\d+) : (.+)$", r"^(ERROR|error):\s*(.+)$", r"returned a non-zero code:\s*(\d+)"
    noise = r"^Sending build context|^\s*---> |^\s*--->$|: (Pulling from|Already exists|Pull complete|Downloading|Extracting|Waiting|Verifying Checksum|Download complete)"
    steps = F.transform(F.filter(_place(ls), lambda s: s["x"].rlike(step)), lambda s: F.struct(s["i"].alias("i"), _text("Step ", _group(s["x"], step, 1), ": ", _group(s["x"], step, 2)).alias("x")))

    def failures_of(s):
        last = F.try_element_at(F.filter(steps, lambda t: t["i"] <= s["i"]), F.lit(-1))["x"]
        both = F.array(F.when(s["x"].rlike(error), _diag("docker/error", _group(s["x"], error, 2), last)), F.when(s["x"].rlike(nonzero), _diag(_text("docker/exit_", _group(s["x"], nonzero, 1)), fn.strip(s["x"]), last)))
        return F.filter(both, lambda d: d.isNotNull())

    failures = F.flatten(F.transform(F.filter(_place(ls), lambda s: s["x"].rlike(error) | s["x"].rlike(nonzero)), failures_of)).cast(_DIAG)
    last = F.try_element_at(steps, F.lit(-1))["x"]
    built, tagged = _last(ls, r"^Successfully built (\S+)"), _last(ls, r"^Successfully tagged (\S+)")
    kept = F.filter(ls, lambda x: ~x.rlike(noise))
    tail = F.array_join(F.slice(kept, F.greatest(F.size(kept) - 19, F.lit(1)), F.lit(20)), "\n")
    good = F.when(built.isNull() & tagged.isNull(), "build complete").otherwise(_text("build succeeded (", F.concat_ws(", ", F.concat(F.lit("built "), built), F.concat(F.lit("tagged "), tagged)), ")"))
    bad = F.size(failures) > 0
    return _result(F.when(bad, F.coalesce(_text("build FAILED at ", last), F.lit("build FAILED"))).otherwise(good), failures=failures, tail=F.when(bad, tail))


def terraform(ls, out, code):
    plan, apply = r"^Plan: (\d+) to add, (\d+) to change, (\d+) to destroy\.", r"^Apply complete!\s+Resources:\s+(\d+) added,\s+(\d+) changed,\s+(\d+) destroyed"
    unchanged, resource, error = r"^No changes\.", r"^\s*#\s+(\S+)\s+will be (\w+)", r"^(?i:error):?\s*(.+)$"
    done = F.try_element_at(F.filter(ls, lambda x: x.rlike(plan) | x.rlike(apply)), F.lit(-1))
    three = lambda p, words: _text(words[0], _group(done, p, 1), words[1], _group(done, p, 2), words[2], _group(done, p, 3), words[3])
    said = F.when(done.rlike(plan), three(plan, ("plan: ", " add, ", " change, ", " destroy"))).when(done.rlike(apply), three(apply, ("apply: ", " added, ", " changed, ", " destroyed")))
    rest = F.filter(ls, lambda x: ~x.rlike(plan) & ~x.rlike(apply) & ~x.rlike(unchanged))
    resources = F.transform(_hits(rest, resource), lambda x: _text(_group(x, resource, 1), " (", _group(x, resource, 2), ")"))
    rest = F.filter(rest, lambda x: ~x.rlike(resource))
    errors = _each(rest, error, lambda x: _diag("terraform/error", _group(x, error, 1)))
    warnings = _each(rest, "^Warning:", lambda x: _diag("terraform/warning", fn.strip(F.regexp_replace(x, "^(Warning:)+", ""))))
    schema = "`@message` string, `@level` string, type string, resource string, change struct<actions:array<string>>"
    records = F.filter(F.transform(_full(ls), lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, schema))), lambda r: r.isNotNull())
    planned = F.filter(records, lambda r: (r["type"] == "planned_change") & ~r["resource"].rlike(r"^[{\[]") & r["change"]["actions"].isNotNull())
    json_resources = F.flatten(F.transform(planned, lambda r: F.transform(r["change"]["actions"], lambda a: _text(r["resource"], " (", a, ")"))))
    json_errors = F.transform(F.filter(records, lambda r: (r["@level"] == "error") & r["@message"].isNotNull()), lambda r: _diag("terraform/error", r["@message"])).cast(_DIAG)
    json_said = F.try_element_at(F.filter(records, lambda r: (r["type"] == "change_summary") & r["@message"].isNotNull()), F.lit(-1))["@message"]
    first = fn.strip(F.get(_full(ls), F.lit(0)))
    is_json = F.coalesce(first.startswith("{") & F.try_parse_json(first).isNotNull(), F.lit(False))
    failures = F.when(is_json, json_errors).otherwise(errors)
    none = F.when(~is_json & (F.size(_hits(ls, unchanged)) > 0), "no changes").when(F.size(failures) > 0, _text(F.size(failures), " error(s)")).otherwise("terraform complete")
    return _result(
        F.coalesce(F.nullif(F.when(is_json, json_said).otherwise(said), F.lit("")), none), failures=failures, warnings=F.when(is_json, F.array().cast(_DIAG)).otherwise(warnings),
        tail=_listed(F.when(is_json, json_resources).otherwise(resources)),
    )


_BAD_PHASES = ["failed", "crashloopbackoff", "error", "pending"]


def kubectl(ls, out, code):
    status, event, restart = r"^Status:\s+(\S+)", r"^\s+(Normal|Warning)\s+(\S+)\s+\S+\s+\S+\s+(.+?)\s*$", r"(?i)restart\s*count:\s*(\d+)"
    condition = r"^\s+(Initialized|Ready|PodScheduled|ContainersReady|Available|Progressing)\s+(\S+)"
    is_events = lambda x: x.rlike(r"^\s*Events:") & ~x.rlike(status)
    # Conditions count up to the first "Events:" line: the lines are marked by the side they are on.
    at = F.coalesce(F.nullif(F.array_position(F.transform(ls, is_events), True), F.lit(0).cast("long")).cast("int"), F.size(ls) + 1)
    side = lambda xs, early: F.transform(xs, lambda x: F.struct(x.alias("x"), F.lit(early).alias("early")))
    marked = F.concat(side(F.slice(ls, F.lit(1), at - 1), True), side(F.slice(ls, at, F.size(ls)), False))
    early = lambda s: s["early"] & s["x"].rlike(condition)
    phase = lambda p: _diag("kubectl/phase", _text("status: ", p))
    bad = F.filter(marked, lambda s: F.when(s["x"].rlike(status), F.lower(_group(s["x"], status, 1)).isin(_BAD_PHASES)).otherwise(~is_events(s["x"]) & early(s) & (_group(s["x"], condition, 2) != "True")))
    failures = F.transform(bad, lambda s: F.when(s["x"].rlike(status), phase(_group(s["x"], status, 1))).otherwise(_diag(_text("kubectl/condition/", _group(s["x"], condition, 1)), _text(_group(s["x"], condition, 1), "=", _group(s["x"], condition, 2))))).cast(_DIAG)
    later = F.filter(marked, lambda s: ~s["x"].rlike(status) & ~is_events(s["x"]) & ~early(s) & F.when(s["x"].rlike(event), _group(s["x"], event, 1) == "Warning").otherwise(s["x"].rlike(restart) & (F.coalesce(_group(s["x"], restart, 1).try_cast("long"), F.lit(0)) > 0)))
    warnings = F.transform(later, lambda s: F.when(s["x"].rlike(event), _diag(_text("kubectl/event/", _group(s["x"], event, 2)), fn.strip(_group(s["x"], event, 3)))).otherwise(_diag("kubectl/restarts", _text("restart count: ", _group(s["x"], restart, 1).try_cast("long"))))).cast(_DIAG)
    named = _last(ls, status)
    schema = "items array<struct<status:struct<phase:string,conditions:array<struct<type:string,status:string>>,events:array<struct<type:string,reason:string,message:string>>,containerStatuses:array<struct<restartCount:bigint>>>>>"
    is_json, doc = _json(out, "{", schema)
    is_list, _ = _json(out, "[", "array<int>")
    states = F.transform(F.coalesce(doc["items"], F.from_json(F.lit("[]"), "array<struct<status:struct<phase:string,conditions:array<struct<type:string,status:string>>,events:array<struct<type:string,reason:string,message:string>>,containerStatuses:array<struct<restartCount:bigint>>>>>")), lambda i: i["status"])
    empty = F.array().cast(_DIAG)
    read = F.flatten(F.transform(states, lambda s: F.concat(
        F.when(F.lower(s["phase"]).isin(_BAD_PHASES), F.array(phase(s["phase"])).cast(_DIAG)).otherwise(empty),
        F.coalesce(F.transform(F.filter(s["conditions"], lambda c: c["type"].isNotNull() & (c["status"] != "True")), lambda c: _diag(_text("kubectl/condition/", c["type"]), _text(c["type"], "=", c["status"]))).cast(_DIAG), empty),
    )))
    warned = F.flatten(F.transform(states, lambda s: F.concat(
        F.coalesce(F.transform(F.filter(s["events"], lambda e: (e["type"] == "Warning") & e["reason"].isNotNull() & e["message"].isNotNull()), lambda e: _diag(_text("kubectl/event/", e["reason"]), e["message"])).cast(_DIAG), empty),
        F.coalesce(F.transform(F.filter(s["containerStatuses"], lambda c: c["restartCount"] > 0), lambda c: _diag("kubectl/restarts", _text("restart count: ", c["restartCount"]))).cast(_DIAG), empty),
    )))
    json_named = F.try_element_at(F.filter(F.transform(states, lambda s: s["phase"]), lambda p: p.isNotNull()), F.lit(-1))
    any_json = is_json | is_list
    failures, warnings = F.when(any_json, F.coalesce(read, empty)).otherwise(failures), F.when(any_json, F.coalesce(warned, empty)).otherwise(warnings)
    counts = _text(F.size(failures), " problem(s), ", F.size(warnings), " warning(s)")
    return _result(F.coalesce(_text("status: ", F.when(any_json, json_named).otherwise(named), ", ", counts), counts), failures=failures, warnings=warnings)


def kubectl_logs(ls, out, code):
    begun = F.filter(F.transform(ls, lambda x, i: F.struct(x.alias("x"), i.alias("i"), ((i == 0) | ~x.eqNullSafe(F.get(ls, i - 1))).alias("new"))), lambda s: s["new"])
    ends = F.concat(F.slice(F.transform(begun, lambda s: s["i"]), F.lit(2), F.size(ls) + 1), F.array(F.size(ls)))
    runs = F.zip_with(begun, ends, lambda s, e: F.struct(s["x"].alias("x"), s["i"].alias("i"), (e - s["i"]).alias("n"), lines.level(s["x"]).alias("level")))
    runs = F.filter(runs, lambda r: r["level"].isNotNull())
    shown = lambda r: F.when(r["n"] > 1, _text(r["x"], " [repeated ", r["n"], " times]")).otherwise(r["x"])
    made = lambda bad: F.transform(F.filter(runs, lambda r: (r["level"] != "WARN") == bad), lambda r: _diag(_text("log/", r["level"]), shown(r))).cast(_DIAG)
    # The context comes before the first run that does not open the output.
    at = F.array_position(F.transform(runs, lambda r: r["i"] > 0), True).cast("int")
    before = F.get(ls, F.get(runs, at - 1)["i"] - 1)
    context = F.when((fn.strip(before) != "") & lines.level(before).isNull(), F.array(F.concat(F.lit("context: "), before)))
    all_ = F.transform(runs, shown)
    emitted = F.when(context.isNull(), all_).otherwise(F.concat(F.slice(all_, F.lit(1), F.greatest(at - 1, F.lit(0))), context, F.slice(all_, F.greatest(at, F.lit(1)), F.size(all_))))
    return _result(_text(F.size(made(True)), " error(s)/fatal(s), ", F.size(made(False)), " warning(s)"), failures=made(True), warnings=made(False), tail=_listed(emitted))


def mvn(ls, out, code):
    ls = F.filter(ls, lambda x: ~x.rlike(r"^\[INFO\] (Downloading from|Downloaded from|Progress)"))
    error, place, tests = r"^\[ERROR\]\s+(.+)$", r"^(.+?):\[(\d+),(\d+)\]\s+(.+)$", r"Tests run: (\d+), Failures: (\d+), Errors: (\d+), Skipped: (\d+)"

    def failure(x):
        said = _group(x, error, 1)
        return _diag("mvn/error", F.when(said.rlike(place), _group(said, place, 4)).otherwise(said), F.when(said.rlike(place), _at(said, place, 1, 2, 3)))

    failures = _each(ls, error, failure)
    rest = F.filter(ls, lambda x: ~x.rlike(error))
    n, f, e, s = (F.coalesce(_int(_last(rest, tests, i)), F.lit(0).cast("long")) for i in (1, 2, 3, 4))
    p = F.greatest(n - f - e - s, F.lit(0))
    built = _last(F.filter(rest, lambda x: ~x.rlike(tests)), r"^\[INFO\] BUILD (SUCCESS|FAILURE)")
    counts = F.when(p + f + e + s > 0, _text(", ", p, " passed, ", f + e, " failed, ", s, " skipped")).otherwise("")
    summary = F.when(built == "SUCCESS", _text("BUILD SUCCESS", counts)).when(built == "FAILURE", _text("BUILD FAILURE, ", F.size(failures), " error(s)")).when(F.size(failures) == 0, "complete").otherwise(_text(F.size(failures), " error(s)"))
    return _result(summary, p, F.when(f + e > 0, f + e).otherwise(F.size(failures)), s, failures)


def gradle(ls, out, code):
    ls = F.filter(ls, lambda x: ~x.rlike("^(Download |Starting a Gradle Daemon|Daemon will be stopped|Welcome to Gradle)"))
    task, java, tests = r"^>\s+Task\s+(\S+)\s+FAILED", r"^(.+?):(\d+):\s+error:\s+(.+)$", r"^(\d+) tests? completed, (\d+) failed"
    failures = F.transform(F.filter(ls, lambda x: x.rlike(task) | x.rlike(java)), lambda x: F.when(x.rlike(task), _diag("gradle/task_failed", _text("task ", _group(x, task, 1), " FAILED"))).otherwise(_diag("gradle/compile_error", _group(x, java, 3), _at(x, java, 1, 2)))).cast(_DIAG)
    rest = F.filter(ls, lambda x: ~x.rlike(task) & ~x.rlike(java))
    n, f = (F.coalesce(_int(_last(rest, tests, i)), F.lit(0).cast("long")) for i in (1, 2))
    built, tasks = _last(rest, "^BUILD (SUCCESSFUL|FAILED)"), F.transform(_hits(ls, task), lambda x: _group(x, task, 1))
    failed = F.when(F.size(tasks) == 0, _text("BUILD FAILED, ", F.size(failures), " error(s)")).otherwise(_text("BUILD FAILED, tasks: ", F.array_join(tasks, ", ")))
    summary = F.when(built == "SUCCESSFUL", "BUILD SUCCESSFUL").when(built == "FAILED", failed).when(F.size(failures) == 0, "complete").otherwise(_text(F.size(failures), " failure(s)"))
    return _result(summary, F.greatest(n - f, F.lit(0)), F.when(f > 0, f).otherwise(F.size(failures)), 0, failures)


def dotnet(ls, out, code):
    issue, tests = r"^(.+?)\((\d+),(\d+)\): (error|warning) (CS\d+): (.+)$", r"(?:Failed|Passed)!\s+-\s+Failed:\s+(\d+),\s+Passed:\s+(\d+),\s+Skipped:\s+(\d+)"
    made = lambda kind: F.transform(F.filter(_hits(ls, issue), lambda x: _group(x, issue, 4) == kind), lambda x: _diag(_text("dotnet/", _group(x, issue, 5)), _group(x, issue, 6), _at(x, issue, 1, 2, 3))).cast(_DIAG)
    rest = F.filter(ls, lambda x: ~x.rlike(issue))
    f, p, s = (F.coalesce(_int(_last(rest, tests, i)), F.lit(0).cast("long")) for i in (1, 2, 3))
    built, errors, warnings = _last(rest, r"^Build (succeeded|FAILED)\."), made("error"), made("warning")
    summary = (
        F.when(built == "succeeded", _text("build succeeded, ", F.size(warnings), " warning(s)")).when(built == "FAILED", _text("build FAILED, ", F.size(errors), " error(s)"))
        .when(p + f + s > 0, _text(p, " passed, ", f, " failed, ", s, " skipped")).otherwise(_counted(F.size(errors), F.size(warnings)))
    )
    return _result(summary, p, F.when(f > 0, f).otherwise(F.size(errors)), s, errors, warnings)


def npm_ls(ls, out, code):
    top, err = r"^(?:├──|└──|├─┬|└─┬)\s+(.+)$", r"^npm (ERR!|WARN)\s+(.+)$"
    entries = F.transform(_hits(ls, top), lambda x: fn.strip(_group(x, top, 1)))
    deps = F.filter(entries, lambda e: ~e.rlike("UNMET|INVALID"))
    problem = lambda m: _diag("npm/dep_problem", m)
    bad = lambda x: x.rlike(top) & fn.strip(_group(x, top, 1)).rlike("UNMET|INVALID")
    failures = F.transform(F.filter(ls, lambda x: bad(x) | (x.rlike(err) & (_group(x, err, 1) == "ERR!"))), lambda x: F.when(x.rlike(top), problem(fn.strip(_group(x, top, 1)))).otherwise(_diag("npm/ERR!", _group(x, err, 2)))).cast(_DIAG)
    warnings = F.transform(F.filter(_hits(ls, err), lambda x: _group(x, err, 1) == "WARN"), lambda x: _diag("npm/WARN", _group(x, err, 2))).cast(_DIAG)
    is_json, doc = _json(out, "{", "dependencies map<string,struct<version:string,problems:array<string>,invalid:boolean,missing:boolean>>")
    is_list, _ = _json(out, "[", "array<int>")
    packages = F.filter(F.array_sort(F.transform(F.map_entries(doc["dependencies"]), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))), lambda e: e["v"]["version"].isNotNull())
    flag = lambda e: F.when(F.coalesce(e["v"]["invalid"], F.lit(False)), "invalid").when(F.coalesce(e["v"]["missing"], F.lit(False)), "missing")
    problems = lambda e: F.filter(F.array_append(F.coalesce(e["v"]["problems"], F.array().cast("array<string>")), flag(e)), lambda p: p.isNotNull())
    empty, none = F.array().cast(_DIAG), F.array().cast("array<string>")
    any_json = is_json | is_list
    deps = F.when(any_json, F.coalesce(F.transform(F.filter(packages, lambda e: F.size(problems(e)) == 0), lambda e: _text(e["k"], "@", e["v"]["version"])), none)).otherwise(deps)
    failures = F.when(any_json, F.coalesce(F.flatten(F.transform(packages, lambda e: F.transform(problems(e), lambda p: problem(_text(e["k"], ": ", p))))).cast(_DIAG), empty)).otherwise(failures)
    warnings = F.when(any_json, empty).otherwise(warnings)
    return _result(_text(F.size(deps), " top-level dep(s), ", F.size(failures), " problem(s), ", F.size(warnings), " warning(s)"), failures=failures, warnings=warnings, tail=_listed(deps))


def fallback(ls, out, code):
    n = lines.tail_length(code)
    return _result(_text("exited ", code), 0, (code != 0).cast("int"), tail=F.array_join(F.slice(ls, F.greatest(F.size(ls) - n + 1, F.lit(1)), n), "\n"))


PARSERS = {
    "cargo_test": cargo_test, "cargo_build": cargo_build, "cargo_clippy": cargo_build, "cargo_llvm_cov": cargo_llvm_cov, "pytest": pytest, "pytest_cov": pytest_cov, "go_test": go_test, "go_cover": go_cover,
    "jest": jest, "jest_cov": jest_cov, "tsc": tsc, "eslint": eslint, "mypy": mypy, "git_log": git_log, "docker_build": docker_build, "terraform": terraform, "kubectl": kubectl,
    "kubectl_logs": kubectl_logs, "mvn": mvn, "gradle": gradle, "dotnet": dotnet, "npm_ls": npm_ls,
}


def _size(diags: Column) -> Column:
    bytes_of = lambda d: F.octet_length(d["name"]) + F.octet_length(d["message"]) + F.coalesce(F.octet_length(d["location"]), F.lit(0))
    return F.aggregate(diags, F.lit(0).cast("long"), lambda n, d: n + bytes_of(d))


def parse(runs: DataFrame, tools: list[str] | None = None, raw: bool = False, full: bool = False) -> DataFrame:
    """run_id, exit_code, duration_ms, tool, summary, passed, failed, skipped, failures, warnings, output_lines, output_tokens_saved, tail.

    The tool is runs.tool if there is such a column, else that of the command; ``tools`` are those that are
    told apart (all by default), others fall back to a tail. raw: no parsing, the whole output as tail; full: both.
    """
    out = F.concat("stdout", F.lit("\n"), "stderr")
    tool = F.col("tool") if "tool" in runs.columns else detect_tool(F.col("command"))
    rows = runs.withColumn("tool", F.lit("raw") if raw else tool).withColumn("out", out).withColumn("ls", fn.lines(F.col("out")))
    ls, text, code = F.col("ls"), F.col("out"), F.col("exit_code")
    if raw:
        parsed = _result(_text("exited ", code), 0, (code != 0).cast("int"), tail=text)
    else:
        cases = None
        for name in tools or PARSERS:
            if name in PARSERS:
                own = PARSERS[name](ls, text, code)
                cases = F.when(F.col("tool") == name, own) if cases is None else cases.when(F.col("tool") == name, own)
        parsed = fallback(ls, text, code) if cases is None else cases.otherwise(fallback(ls, text, code))
    rows = rows.withColumn("p", parsed)
    spent = F.floor((F.octet_length("p.summary") + _size(F.col("p.failures")) + _size(F.col("p.warnings")) + F.coalesce(F.octet_length("p.tail"), F.lit(0))) / 4).cast("long")
    saved = F.lit(0).cast("long") if raw else F.greatest(fn.count_fast(text) - spent, F.lit(0).cast("long"))
    tail = text if full else F.col("p.tail")
    return rows.select("run_id", "exit_code", "duration_ms", "tool", "p.summary", "p.passed", "p.failed", "p.skipped", "p.failures", "p.warnings", F.size(ls).alias("output_lines"), saved.alias("output_tokens_saved"), tail.alias("tail"))
