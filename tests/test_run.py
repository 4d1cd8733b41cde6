"""Runs, hooks, assessments, caches, streams and the command line, on small trees."""

import io
import json
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from plumbline import __main__ as cli
from plumbline.functions import text as T
from plumbline.operators import graph, replay, results, rules, run, scope, state
from plumbline.sources import files as sources
from plumbline.streaming import watch

BAD = "package p\n\nfunc f(a, b string) {\n\tv, _ := g()\n}\n"
GOOD = "package p\n\nfunc f(a string) {\n\tg()\n}\n"


def files(spark, rows):
    return spark.createDataFrame(list(rows.items()), "path string, source string")


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


CONFIG = {
    "checks": [
        {"name": "errors", "checker": "go-ignored-error", "severity": "blocking", "message": "mind errors"},
        {"name": "params", "checker": "primitive-obsession", "scope": ["a/**"], "triggers": ["edit"]},
        {"name": "cycles", "architecture_checker": "import-cycles", "severity": "blocking"},
        {"name": "layers", "architecture_checker": "layering"},
        {"name": "fans", "architecture_checker": "coupling"},
    ],
    "architecture": {"layers": ["ui", "core"]},
}


def test_checkers_are_told_by_name_and_gated_by_globs(spark):
    tree = files(spark, {"a/x.go": BAD, "a/x.md": BAD, "a/y.go": GOOD, "b/z.go": None})
    got = rows_of(run.file_results(tree, CONFIG, "batch"), "path", "check_name", "passed", "output", "message")
    assert got == [
        ("a/x.go", "errors", False, "a/x.go:4: the last result, an error by convention, is ignored", "mind errors"),
        ("a/x.md", "errors", True, "", None),  # the checker's own globs leave it out
        ("a/y.go", "errors", True, "", "mind errors"),
        ("b/z.go", "errors", False, "can't read b/z.go", "mind errors"),
    ]
    both = rows_of(run.file_results(tree, CONFIG, "edit"), "path", "check_name", "passed")
    assert ("a/x.go", "params", False) in both and not any(p == "b/z.go" and c == "params" for p, c, _ in both)
    with pytest.raises(ValueError):
        rules.findings_of(tree, ["nope"])
    assert {r.name for r in rules.checkers(spark).collect()} == set(rules.CHECKERS) and len(rules.CHECKERS) == 13
    assert rules.findings_of(tree, []).count() == 0


def test_findings_count_in_changed_lines_only(spark):
    tree = files(spark, {"a.go": BAD})
    for ranges, passed in (([(4, 4)], False), ([(1, 2)], True), (None, False), ([(5, 9), (4, 4)], False)):
        changed = spark.createDataFrame([("a.go", ranges)], "path string, ranges " + run.RANGES)
        assert [r.passed for r in run.file_results(tree, CONFIG, "batch", changed).collect()] == [passed]


def test_what_the_base_has_too_is_advisory(spark):
    tree, config = files(spark, {"a.go": BAD, "new.go": BAD, "b.go": BAD}), {"checks": CONFIG["checks"][:1]}
    head = files(spark, {"a.go": BAD, "b.go": GOOD})
    got = rows_of(run.file_results(tree, config, "batch", head=head), "path", "severity", "message")
    assert got == [("a.go", "advisory", "mind errors (advisory: the base revision fails in the same way)"), ("b.go", "blocking", "mind errors"), ("new.go", "blocking", "mind errors")]
    # lines 4-4 were inserted: the base passes without a look at it
    changed = spark.createDataFrame([("a.go", [(4, 4)])], "path string, ranges " + run.RANGES)
    hunks = scope.diff_hunks(spark.createDataFrame([("a.go", "@@ -3,0 +4 @@\n+x")], "path string, diff string"))
    got = rows_of(run.file_results(tree.where("path = 'a.go'"), config, "batch", changed, head, hunks), "path", "severity")
    assert got == [("a.go", "blocking")]
    # lines 4-4 stood at 4 before, and failed
    hunks = scope.diff_hunks(spark.createDataFrame([("a.go", "@@ -4 +4 @@\n-x\n+x")], "path string, diff string"))
    assert rows_of(run.file_results(tree.where("path = 'a.go'"), config, "batch", changed, head, hunks), "path", "severity") == [("a.go", "advisory")]


def test_a_run_asks_only_what_counts(spark, monkeypatch):
    asked, found = [], rules.findings_of
    monkeypatch.setattr(rules, "findings_of", lambda files, names: asked.append(names) or found(files, names))
    checks = [{"name": "errors", "checker": "go-ignored-error", "severity": "blocking"}, {"name": "params", "checker": "primitive-obsession", "scope": ["*.go"]}, {"name": "more", "checker": "primitive-obsession", "scope": ["b/*"]}, {"name": "imports", "checker": "go-blank-imports", "triggers": ["edit"]}, {"name": "links", "checker": "markdown-link-integrity"}]
    tree = files(spark, {"a.go": BAD, "b/b.go": BAD, "c/c.go": BAD, "d.md": "[x][y]\n", "e.go": None})
    got = run.file_results(tree, {"checks": checks}, "batch", head=tree.where("path <> 'b/b.go'"))
    assert asked == [["go-ignored-error", "markdown-link-integrity", "primitive-obsession"], ["go-ignored-error"]]  # a base changes blocking checks only
    assert "check_name" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x)  # rows of checks aren't dealt
    assert rows_of(got.where("not passed"), "path", "check_name", "severity", "output") == [
        ("a.go", "errors", "advisory", "a.go:4: the last result, an error by convention, is ignored"), ("a.go", "params", "advisory", "a.go:3: 2 parameters in a row of type string"),
        ("b/b.go", "errors", "blocking", "b/b.go:4: the last result, an error by convention, is ignored"), ("b/b.go", "more", "advisory", "b/b.go:3: 2 parameters in a row of type string"),
        ("c/c.go", "errors", "advisory", "c/c.go:4: the last result, an error by convention, is ignored"), ("d.md", "links", "advisory", "d.md:1: undefined reference: y"),
        ("e.go", "errors", "advisory", "can't read e.go"), ("e.go", "params", "advisory", "can't read e.go"),
    ]
    assert rows_of(got.where("passed"), "path", "check_name") == [("a.go", "links"), ("b/b.go", "links"), ("c/c.go", "links"), ("d.md", "errors"), ("e.go", "links")]
    mild = run.file_results(tree, {"checks": checks[1:2]}, "batch", head=tree)
    assert {r.severity for r in mild.collect()} == {"advisory"} and mild.count() == 2 and asked[2:] == [["primitive-obsession"]]


def test_go_facts_of_the_kinds_asked_for(spark):
    source = 'package p\n\nimport (\n\t_ "a"\n\t"b"\n)\n\nfunc f(a, b string) {\n\tv, _ := g()\n\tif err != nil { return err }\n\treturn fmt.Errorf("%w", err)\n}\n'
    every = rows_of(rules.go_facts(files(spark, {"x.go": source})), "kind", "line", "text", "n")
    assert every == [("bare", 10, "", 0), ("ignored", 9, "", 0), ("import", 4, "a", 0), ("import", 5, "b", 0), ("open", 4, "a", 0), ("parameters", 8, "string", 2)]
    for kind in {k for k, *_ in every}:
        assert rows_of(rules.go_facts(files(spark, {"x.go": source}), (kind,)), "kind", "line", "text", "n") == [r for r in every if r[0] == kind]
    assert rows_of(rules.go_findings(files(spark, {"x.go": source}), ["go-blank-imports"]), "rule", "line") == [("go-blank-imports", 4)]


GO_CYCLE = {"go.mod": "module m\n", "ui/u.go": 'package ui\n\nimport "m/core"\n', "core/c.go": 'package core\n\nimport (\n\t"fmt"\n\t"m/ui"\n)\n'}


def test_architecture_of_a_tree(spark):
    got = {r.check_name: r for r in run.run(files(spark, GO_CYCLE), CONFIG, root="/r").where("path = '/r'").collect()}
    assert got["cycles"].output == "core/c.go:5: import cycle: m/core -> m/ui -> m/core" and not got["cycles"].passed and got["cycles"].severity == "blocking"
    assert got["layers"].output.startswith("core/c.go:5: layering: m/core (core) imports m/ui (ui)") and got["fans"].passed
    old = run.architecture_results(files(spark, GO_CYCLE), CONFIG, "batch", "/r", head=files(spark, GO_CYCLE))
    assert {r.check_name: r.severity for r in old.collect()} == {"cycles": "advisory", "layers": "advisory", "fans": "advisory"}
    assert run.architecture_results(files(spark, GO_CYCLE), {"checks": []}, "batch", "/r").count() == 0
    wide = {"go.mod": "module m\n", "hub/h.go": "package hub\nimport (\n" + "".join(f'"m/p{k}"\n' for k in range(11)) + ")\n", **{f"p{k}/x.go": "package p\n" for k in range(11)}}
    fans = run.architecture_results(files(spark, wide), CONFIG, "batch", "/r").where("check_name = 'fans'").first()
    assert fans.output == "[coupling] m/hub imports 11 packages, limit 10"


def test_assessment(spark):
    tree = files(spark, {**GO_CYCLE, "core/long.go": "package core\nfunc f(a, b, c, d, e, g int) {\n" + "x()\n" * 45 + "}\n"})
    text = [r.text for r in run.assessment(tree, CONFIG).orderBy("part", "ord").collect()]
    assert text[0] == "architecture assessment: 4 finding(s) across 4 file(s)"
    assert any(x.startswith("[blocking] core/c.go:5: import cycle") for x in text) and any("core/long.go:2: [long-function]" in x for x in text)
    assert sum(x.startswith("- ") for x in text) == 0 and "graph TD" in text  # recommendations go by the check's name
    named = {**CONFIG, "checks": [{"name": "import-cycles", "architecture_checker": "import-cycles"}]}
    text = [r.text for r in run.assessment(tree, named, ["ui/**", "core/c.go", "go.mod"], diagram=False).orderBy("part", "ord").collect()]
    assert text[0] == "architecture assessment: 1 finding(s) across 3 file(s)" and text[2].startswith("- import-cycles") and text[-1] == "(no diagram asked for)"
    clean = run.assessment(files(spark, {"a.go": GOOD}), {"checks": []}).orderBy("part", "ord").collect()
    assert clean[0].text == "architecture assessment: 0 finding(s) across 1 file(s)"


def events(spark, *given):
    return spark.createDataFrame([json.dumps(g) for g in given], "string").select(F.from_json("value", run.EVENT).alias("e")).select("e.*")


def edit(key, **given):
    return {"cwd": "/", "hook_event_name": "edit", "tool_use_id": key, "tool_input": given}


def test_changed_lines_of_edits(spark):
    text = "one\ntwo\nx\none\nend\n"
    cases = [
        (edit("unique", file_path="f", new_string="two"), [(2, 2)]), (edit("twice", file_path="f", new_string="one"), [(1, 1), (4, 4)]), (edit("lines", file_path="f", new_string="two\nx"), [(2, 3)]),
        (edit("whole", file_path="f", content="one", new_string="one"), None), (edit("gone", file_path="f", new_string="nowhere"), None), (edit("empty", file_path="f", new_string=""), None),
        (edit("many", file_path="f", edits=[{"new_string": "x"}, {"new_string": ""}, {"new_string": "end"}]), [(3, 3), (5, 5)]), (edit("nothing", file_path="f"), None),
    ]
    got = events(spark, *[e for e, _ in cases]).select("tool_use_id", run.changed_ranges(F.lit(text), F.col("tool_input")).alias("r")).collect()
    assert {r.tool_use_id: r.r and [tuple(x) for x in r.r] for r in got} == {e["tool_use_id"]: spans for e, spans in cases}


def test_hooks_answer_once(spark):
    tree, config = files(spark, {"a.go": BAD, "b.go": BAD, "c.go": GOOD}), {"checks": [CONFIG["checks"][0], {**CONFIG["checks"][1], "scope": []}]}
    given = events(spark, edit("1", file_path="a.go", new_string="v, _ := g()"), edit("1", file_path="a.go", new_string="v, _ := g()"), edit("2", file_path="b.go", new_string="func f(a, b string) {"), edit("3", file_path="c.go", content="x"), edit("4"), edit("5", file_path="gone.go"))
    got = {r.tool_use_id: r for r in run.hook_answers(given, tree, config, "edit").collect()}
    assert got.keys() == {"1", "2", "3"}
    assert got["1"].exit_code == 2 and got["1"].stderr.startswith("errors (blocking): mind errors\na.go:4:") and got["1"].stdout is None
    assert got["2"].exit_code == 0 and "params: b.go:3:" in json.loads(got["2"].stdout)["hookSpecificOutput"]["additionalContext"]
    assert got["3"].exit_code == 0 and got["3"].stderr is None and got["3"].stdout is None
    text = {r.path: r.text for r in run.checks_text(run.file_results(tree, config, "edit"), ["path"]).collect()}
    assert text["c.go"] == "all checks passed" and text["a.go"].startswith("[BLOCKING] errors: mind errors\n") and "\n[advisory] params: " in text["a.go"]


def test_sarif_of_commands(spark, tmp_path):
    log = {"runs": [{"results": [{"level": "error", "message": {"text": "bad"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "x"}, "region": {"startLine": 3}}}]}]}]}
    (tmp_path / "log").write_text(json.dumps(log))
    checks = [{"name": "good", "command": "cat log; echo note >&2; exit 1 # {file}", "output_format": "sarif"}, {"name": "broken", "command": "echo oops; echo {changed_lines} >&2; false {file}", "output_format": "sarif"}, {"name": "plain", "command": "echo {file}:9: far; false"}, {"name": "once", "command": "echo whole; false", "scope": ["none"]}]
    tree = files(spark, {"f": "x\n"})
    changed = spark.createDataFrame([("f", [(1, 2)])], "path string, ranges " + run.RANGES)
    got = {r.check_name: r for r in run.file_results(tree, {"checks": checks}, "batch", changed, cwd=str(tmp_path)).collect()}
    assert got["good"].output == "1 error(s)\nx:3: [error] bad" and not got["good"].passed  # not scoped to the changed lines
    assert got["broken"].output == "oops\n1-2\n" and not got["broken"].passed
    assert got["plain"].passed and got["plain"].output == ""
    assert "once" not in got
    every = {r.check_name: r for r in run.run(tree, {"checks": checks}, root="/r", cwd=str(tmp_path)).collect()}
    assert every["once"].path == "/r" and every["once"].output == "whole\n"


def test_cache_as_a_table(spark, tmp_path):
    tree = spark.createDataFrame([("a", "x", "2024-01-01 00:00:00", 1), ("b", "y", "2024-01-01 00:00:00", 1)], "path string, source string, modified string, length long").withColumn("modified", F.col("modified").cast("timestamp"))
    asked = []

    def check(of):
        asked.append(sorted(r.path for r in of.collect()))
        return of.select("path", F.lit("c").alias("check_name"), F.lit("advisory").alias("severity"), (F.col("source") != "x").alias("passed"), F.lit("").alias("output"), F.lit(None).cast("string").alias("message"), F.lit("").alias("command"))

    path = str(tmp_path / "cache")
    assert state.load_cache(spark, path, state.CACHE).count() == 0
    stamp = ("2024-01-01 00:00:00", 5)
    for trigger, given, expected, scoped in (("edit", stamp, ["a", "b"], False), ("edit", stamp, [], False), ("edit", stamp, ["a", "b"], True), ("batch", stamp, ["a", "b"], False), ("edit", stamp, ["a", "b"], False), ("edit", (stamp[0], 6), ["a", "b"], False)):
        out, after = state.cached_run(tree, state.load_cache(spark, path, state.CACHE), trigger, given, check, scoped)
        assert rows_of(out, "path", "passed") == [("a", False), ("b", True)] and asked[-1] == expected
        state.save_cache(after, path)
    out, _ = state.cached_run(tree.withColumn("length", F.when(F.col("path") == "a", 2).otherwise(1).cast("long")), state.load_cache(spark, path, state.CACHE), "edit", (stamp[0], 6), check)
    assert rows_of(out, "path") == [("a",), ("b",)] and asked[-1] == ["a"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    assert state.load_cache(spark, str(tmp_path / "bad"), state.CACHE).count() == 0


def test_streams_answer_and_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps(edit("1", file_path="a.go", new_string="v, _")) + "\n" + json.dumps(edit("1", file_path="a.go", new_string="v, _")))
    got = []
    config = {"checks": CONFIG["checks"][:1]}
    query = watch.answer_edits(watch.edit_events(spark, str(tmp_path / "in")), lambda: files(spark, {"a.go": BAD}), config, "edit", lambda df, k: got.extend(df.collect()), str(tmp_path / "c1"))
    assert query.awaitTermination(120) and [(r.tool_use_id, r.exit_code) for r in got] == [("1", 2)]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "x.go").write_text(BAD)
    seen = []
    for _ in range(2):
        query = watch.watch_files(spark, str(tmp_path / "src"), config, "edit", lambda df, k: seen.extend(df.collect()), str(tmp_path / "c2"))
        assert query.awaitTermination(120)
        time.sleep(1.1)
        (tmp_path / "src" / "y.go").write_text(GOOD)
    assert [(r.line, r.severity, r.source) for r in seen] == [(3, "ERROR", "errors")]


def test_grace_and_claims_as_streams_equal_their_batches(spark, tmp_path):
    from plumbline.streaming import state as streams

    rng = __import__("random").Random(3)
    rows = [(f"f{rng.randrange(3)}", f"c{rng.randrange(2)}", k, f"2024-01-01 00:{k // 60:02}:{k % 60:02}", rng.choice(["edit", "edit", "batch"]), rng.choice(["blocking", "blocking", "advisory"]), rng.random() < 0.5) for k in range(200)]
    schema = "file string, check_name string, event_id long, ts string, trigger string, severity string, passed boolean"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(4):  # four files, read as four micro-batches in order
        df.where(F.expr(f"event_id div 50 = {part}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        time.sleep(1.1)
    read = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    query = streams.graced_stream(read).writeStream.format("memory").queryName("graced").option("checkpointLocation", str(tmp_path / "g")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    expected = state.graced(df, ["file", "check_name"], ["ts", "event_id"])
    assert rows_of(spark.table("graced"), "event_id", "severity") == rows_of(expected, "event_id", "severity")
    query = streams.claimed_stream(read, "file", "ts").writeStream.format("memory").queryName("claimed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    claimed = state.claims(df.select("file", "ts", "event_id"), "file", "ts", "event_id").where("claimed")
    assert rows_of(spark.table("claimed"), "file", "event_id") == rows_of(claimed, "file", "event_id") and claimed.count() == 3


def test_claims_without_a_key(spark):
    df = spark.createDataFrame([(None, k, f"2024-01-01 00:00:{k:02}") for k in range(6)] + [("a", 9, "2024-01-01 00:00:00")], "key string, id long, ts string")
    for rows_a_batch in ("10000", "2"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
        try:
            assert rows_of(state.claims(df, "key", "ts", "id").where("claimed"), "id") == [(0,), (9,)]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_backtest_lines_and_counts(spark):
    snaps = spark.createDataFrame([("t", 1, "a.go", None, BAD, 0), ("t", 2, "a.go", BAD, BAD + "\n", 0), ("t", 3, "n.txt", None, "x", 0), ("t", -1, None, None, None, 2)], replay.SNAPSHOT)
    told = replay.backtest(snaps, lambda f: rules.findings_of(f, ["go-ignored-error"]).withColumnRenamed("checker", "rule"))
    assert [r.text for r in replay.backtest_lines(told).orderBy("seq").collect()] == ["t#1 a.go:4: [go-ignored-error] the last result, an error by convention, is ignored", "t#2 a.go:4: [go-ignored-error] (pre-existing) the last result, an error by convention, is ignored"]
    counts = replay.backtest_counts(snaps, {n: rules.CHECKERS[n][0] for n in ("go-ignored-error", "duplicate-code")}).first()
    assert (counts.transcripts, counts.snapshots, counts.lost) == (1, 4, 2)


def test_command_line(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)

    def call(*argv, stdin=""):
        out, err = io.StringIO(), io.StringIO()
        code = cli.main(list(argv), spark, io.StringIO(stdin), out, err)
        return code, out.getvalue(), err.getvalue()

    assert call("run", str(root))[0] == 0  # nothing is configured
    (root / sources.CONFIG_NAME).write_text(json.dumps({"checks": CONFIG["checks"][:1]}))
    (root / "a.go").write_text(BAD)
    git("init", "-q")
    code, out, _ = call("run", str(root))
    assert code == 1 and out == "[BLOCKING] a.go — errors: mind errors\na.go:4: the last result, an error by convention, is ignored\n"
    git("add", ".")
    git("commit", "-qm", "x")
    code, out, _ = call("run", str(root))
    assert code == 0 and out.startswith("[advisory] a.go — errors: mind errors (advisory")
    assert call("checks", str(root))[1].endswith("errors (blocking, scope=[])\n")
    assert call("native", "go-ignored-error", str(root / "a.go"))[0] == 1 and call("native", "duplicate-code", str(root / "a.go"))[0] == 0
    assert len(call("list")[1].splitlines()) == len(rules.CHECKERS)
    code, _, err = call("hook", stdin=json.dumps({**edit("9", file_path=str(root / "a.go"), new_string="v, _"), "cwd": str(root)}))
    assert code == 2 and err.startswith("errors (blocking)")
    assert "graph TD" not in call("assess", str(root), "--no-diagram")[1]
    (tmp_path / "logs" / "s").mkdir(parents=True)
    line = {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "1", "name": "Write", "input": {"file_path": "a.go", "content": BAD}}]}}
    (tmp_path / "logs" / "s" / "t.jsonl").write_text(json.dumps(line) + "\n\n")
    code, out, _ = call("backtest", "go-ignored-error", "--transcripts-dir", str(tmp_path / "logs"))
    assert code == 1 and out.splitlines()[0].startswith("scanned 1 transcript(s), checked 1 snapshot(s), 0 edit(s)") and "t.jsonl#1 a.go:4: [go-ignored-error]" in out
    (root / sources.CONFIG_NAME).write_text(json.dumps({"checks": [{"name": "x", "checker": "nope"}]}))
    assert call("run", str(root))[0] == 2


def test_command_templates_and_running_sums(spark):
    df = spark.createDataFrame([("lint {file} {changed_lines}", "a b", [(1, 2), (5, 5)]), ("x {changed_lines}", "f", None)], "t string, p string, r " + run.RANGES)
    assert [r.c for r in df.select(T.command_for(F.col("t"), F.col("p"), F.col("r")).alias("c")).collect()] == ["lint a b 1-2,5-5", "x "]
    numbers = [(n * 7) % 11 for n in range(3000)]
    sums = spark.createDataFrame([(numbers,), ([],)], "n array<long>").select(T.running_sums(F.col("n"), 100).alias("s")).collect()
    assert sums[0].s == [sum(numbers[: k + 1]) for k in range(3000)] and sums[1].s == []


def test_diagnostics_of_odd_numbers(spark):
    r = spark.createDataFrame([("a", "c", "blocking", False, "a:99999999999: far\na:0: zero\na: 7 : seven\na:x: no\nb:1: other", None, "")], "path string, check_name string, severity string, passed boolean, output string, message string, command string")
    assert rows_of(results.diagnostics(r), "line", "severity", "source", "message") == [(0, "ERROR", "c", "zero"), (6, "ERROR", "c", "seven")]
    none = r.withColumn("output", F.lit("a:99999999999: far"))
    assert rows_of(results.diagnostics(none), "line", "message") == [(0, "a:99999999999: far")]


def test_joined_output_is_sorted(spark):
    f = spark.createDataFrame([("c", "p", 10, "x"), ("c", "p", 2, "y")], "checker string, path string, line int, message string")
    assert results.joined_output(f, ["checker"]).first().output == "p:2: y\np:10: x"


def test_components_against_a_search(spark):
    import random

    for seed in range(4):
        rng = random.Random(seed)
        edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(rng.randrange(1, 30))}
        reach = {a: set() for a in range(14)}
        for a in reach:
            todo = [a]
            while todo:
                x = todo.pop()
                for s, d in edges:
                    if s == x and d not in reach[a]:
                        reach[a].add(d)
                        todo.append(d)
        expected = sorted((a, min(b for b in reach[a] if a in reach[b]), sum(a in reach[b] for b in reach[a])) for a in reach if a in reach[a])
        df = spark.createDataFrame(sorted(edges), "src int, dst int")
        assert rows_of(graph.strong_components(df), "node", "component", "size") == expected
        assert rows_of(graph.reachable(df), "src", "dst") == sorted((a, b) for a in reach for b in reach[a])
