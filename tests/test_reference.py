"""The reference's operators on small rows, with the expected results written out."""

import json
import random
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import blocks, graph, links, replay, results, rules, scope, state
from plumbline.parse import go, markdown, scan
from plumbline.plans import oracles, queries, source_oracles, source_queries
from plumbline.sources import files as sources
from plumbline.streaming import state as streams


def files(spark, **named):
    return spark.createDataFrame([(k.replace("__", "/").replace("_dot_", "."), v) for k, v in named.items()], "path string, source string")


def of(spark, path, source):
    return spark.createDataFrame([(path, source)], "path string, source string")


# blocks

BLOCK = [f"line number {k} of the block" for k in range(6)]


@pytest.mark.parametrize(
    "lines,expected",
    [
        (BLOCK + ["x"] + BLOCK, []),
        (["a", "b"] + BLOCK + ["x"] + BLOCK + ["y"] + BLOCK, [(17, 3, "3, 10, 17")]),
        ((BLOCK + [f"more {k} and more" for k in range(4)] + ["z"]) * 3, [(23, 3, "1, 12, 23")]),
        ((["}"] * 6 + ["x"]) * 3, []),
        ((BLOCK[:3] + [""] + BLOCK[3:] + ["x"]) * 3, []),
    ],
)
def test_duplicate_blocks(spark, lines, expected):
    found = blocks.duplicate_blocks(of(spark, "a.go", "\n".join(lines)), "path", "source").collect()
    assert [(r.line, r.repeats, r.lines) for r in found] == expected


# scalars


def test_lines_trim_and_slugs(spark):
    df = spark.createDataFrame([("a\r\nb\n\n",), ("",), ("x",), ("\n",)], "t string")
    assert [r.l for r in df.select(T.lines(F.col("t")).alias("l")).collect()] == [["a", "b", ""], [], ["x"], [""]]
    one = spark.createDataFrame([(" \t x y \n", "A &amp; B's Title", " Two  Words ")], "a string, b string, c string")
    r = one.select(T.trimmed(F.col("a")), T.heading_slug(F.col("b")), T.label_key(F.col("c"))).first()
    assert list(r) == ["x y", "a--bs-title", "two words"]


@pytest.mark.parametrize("path,globs,expected", [("a.go", ["**/*.go"], True), ("x/y/a.go", ["**/*.go"], True), ("x/a.go", ["*.go"], False), ("src/a.go", ["src/**"], True), ("a.ts", [], True), ("ab.c", ["a?.c"], True), ("axc", ["a.c"], False)])
def test_globs(spark, path, globs, expected):
    assert spark.range(1).select(T.in_scope(F.lit(path), globs)).first()[0] is expected


def test_descriptions(spark):
    df = spark.createDataFrame([("m", "out\n", "c"), ("m", " ", "c"), (None, "\n".join(map(str, range(30))), "cmd")], "m string, o string, c string")
    got = [r[0] for r in df.select(T.described(F.col("m"), F.col("o"), F.col("c"))).collect()]
    assert got[0] == "m\nout" and got[1] == "m" and got[2].count("\n") == 20 and "10 more line(s)" in got[2]


def test_needles_edits_and_numbered_text(spark):
    df = spark.createDataFrame([("a\nb\nfoo\nb\n", "b"), ("x", ""), ("one\ntwo\nthree", "two\nthree")], "t string, n string")
    spans = [[(s.start, s.end) for s in r[0]] for r in df.select(T.occurrence_lines(F.col("t"), F.col("n"))).collect()]
    assert spans == [[(2, 2), (4, 4)], [], [(2, 3)]]
    e = spark.createDataFrame([("a.a", ".", "!"), ("aa", "a", "b"), (None, "a", "b"), ("x", "y", "z")], "t string, o string, n string")
    assert [r[0] for r in e.select(T.edited(F.col("t"), F.col("o"), F.col("n"))).collect()] == ["a!a", "ba", None, None]
    n = spark.createDataFrame([("1\tx\n2\ty\tz",), ("1\tx\nno",)], "t string")
    assert [r[0] for r in n.select(T.numbered_text(F.col("t"))).collect()] == ["x\ny\tz", None]


# scope


def test_scoped_output(spark):
    schema = "path string, output string, ranges array<struct<start:int,end:int>>, passed boolean"
    rows = [
        ("a.go", "a.go:3: bad\na.go:9: worse", [(2, 4)], False), ("a.go", "a.go:9: worse", [(2, 4)], False), ("a.go", "a.go:9: x\nsummary", [(2, 4)], False),
        ("a.go", "plain words", [(2, 4)], False), ("a.go", "a.go:3: x", [(2, 4)], True), ("a.go", "a.go:9: x\na.go:z: odd", [(2, 4)], False), ("a.go", "a.go:9: x", None, False),
    ]
    got = [(r.kept, r.passed) for r in scope.scoped_output(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("a.go:3: bad", False), ("", True), ("summary", False), ("plain words", False), ("a.go:3: x", True), ("a.go:z: odd", False), ("a.go:9: x", False)]


@pytest.mark.parametrize("hunk,span,expected", [((20, 1, 20, 6), (1, 3), (1, 3)), ((20, 1, 20, 6), (30, 30), (25, 25)), ((20, 1, 20, 6), (21, 23), (20, 20)), ((20, 0, 21, 4), (21, 24), None)])
def test_ranges_before(spark, hunk, span, expected):
    h = spark.createDataFrame([("p", 1, *hunk)], "path string, ord int, old_start int, old_count int, new_start int, new_count int")
    got = scope.ranges_before(spark.createDataFrame([("p", *span)], "path string, start int, end int"), h, "path").collect()
    assert [(r.old_start, r.old_end) for r in got] == ([expected] if expected else [])


def test_diff_hunks(spark):
    df = spark.createDataFrame([("p", "diff\n@@ -1 +1,2 @@ x\n+a\n@@ -9,0 +11,3 @@")], "path string, diff string")
    assert [tuple(r)[1:] for r in scope.diff_hunks(df).orderBy("ord").collect()] == [(1, 1, 1, 1, 2), (2, 9, 0, 11, 3)]


# state


def machine(events):
    pending, out = set(), []
    for key, trigger, severity, passed in events:
        if trigger != "batch" and severity == "blocking":
            if passed:
                pending.discard(key)
            elif key not in pending:
                pending.add(key)
                severity = "advisory"
        out.append(severity)
    return out


def grace_events():
    rng = random.Random(1)
    return [(f"f{rng.randrange(5)}", rng.choice(["edit", "edit", "batch"]), rng.choice(["blocking", "blocking", "advisory"]), rng.random() < 0.4) for _ in range(300)]


def test_grace_equals_the_state_machine(spark):
    events = grace_events()
    df = spark.createDataFrame([(k, *e) for k, e in enumerate(events)], "k int, file string, trigger string, severity string, passed boolean")
    assert [r.severity for r in state.graced(df, ["file"], ["k"]).orderBy("k").collect()] == machine(events)


def test_grace_as_a_stream(spark, tmp_path):
    events = grace_events()
    rows = [(e[0], "c", k, f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}", *e[1:]) for k, e in enumerate(events)]
    schema = "file string, check_name string, event_id long, ts string, trigger string, severity string, passed boolean"
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streams.graced_stream(stream).writeStream.format("memory").queryName("graced").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("graced").count() == len(events)


@pytest.mark.parametrize("times,expected", [([0, 10], [True, False]), ([0, 3600], [True, False]), ([0, 3601], [True, True]), ([0, 1800, 3601, 3700], [True, False, True, False])])
def test_claims(spark, times, expected):
    df = spark.createDataFrame([("a", k, t) for k, t in enumerate(times)], "id string, k int, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.claimed for r in state.claims(df, "id", "ts", "k").orderBy("k").collect()] == expected


def test_cache_and_baseline(spark):
    asked = spark.createDataFrame([("a", "edit", 1), ("b", "edit", 1), ("c", "lsp", 1)], "path string, trigger string, stamp int")
    cached = spark.createDataFrame([("a", "edit", 1), ("b", "edit", 2), ("c", "edit", 1)], "path string, trigger string, stamp int")
    assert {r.path: r.hit for r in state.cache_lookup(asked, cached, "path", ["stamp"]).collect()} == {"a": True, "b": False, "c": False}
    assert {(r.path, r.trigger) for r in state.cache_merge(cached, asked.where("path = 'c'"), "path").collect()} == {("a", "edit"), ("b", "edit"), ("c", "lsp")}
    now = spark.createDataFrame([("a", False, "blocking"), ("b", False, "blocking"), ("c", False, "blocking")], "path string, passed boolean, severity string")
    head = spark.createDataFrame([("a", False), ("b", True)], "path string, passed boolean")
    assert {r.path: r.severity for r in state.with_baseline(now, head, ["path"]).collect()} == {"a": "advisory", "b": "blocking", "c": "blocking"}


# graphs


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, f"{a}.go", k + 1) for k, (a, b) in enumerate(pairs)], "src string, dst string, file string, line int")


def test_cycles(spark):
    found = graph.cycle_findings(edges(spark, "ab", "bc", "ca", "cd", "ee")).collect()
    assert sorted((r.members, r.file, r.line) for r in found) == [("a -> b -> c -> a", "a.go", 1), ("e -> e", "e.go", 5)]
    assert graph.cycle_findings(edges(spark, "ab", "bc")).count() == 0


def test_layers_and_coupling(spark):
    e = spark.createDataFrame([("x/domain/a", "x/api/b"), ("x/api/b", "x/domain/a"), ("u", "x/api/b")], "src string, dst string")
    assert [(r.src, r.dst) for r in graph.layering_violations(e, ["api", "domain"]).collect()] == [("x/domain/a", "x/api/b")]
    assert graph.layering_violations(e, []).count() == 0
    nodes = spark.createDataFrame([("a",), ("z",)] + [(f"n{k}",) for k in range(11)], "node string")
    many = edges(spark, *[("a", f"n{k}") for k in range(11)], ("a", "n0"))
    got = {r.node: (r.fan_out, r.fan_in, r.high) for r in graph.coupling(nodes, many).collect()}
    assert got["a"] == (12, 0, True) and got["z"] == (0, 0, False) and got["n0"] == (0, 2, False)
    assert {r.node: r.fan_out for r in graph.coupling(nodes, many, distinct=True).collect()}["a"] == 11


def test_diagram(spark):
    nodes = spark.createDataFrame([("a/b",), ("1c",)], "node string")
    lines = [r.text for r in graph.diagram_lines(nodes, edges(spark, ("a/b", "1c"), ("1c", "a/b"), ("a/b", "1c"))).orderBy("part", "ord").collect()]
    assert lines[:5] == ["graph TD", '    n1c["1c"]', '    a_b["a/b"]', "    n1c --> a_b", "    a_b --> n1c"] and "    class n1c,a_b cycle;" in lines and len(lines) == 9
    assert graph.diagram_lines(spark.range(151).select(F.col("id").cast("string").alias("node")), edges(spark, "ab")).count() == 1
    assert "no edges" in graph.diagram_lines(nodes.where("false"), edges(spark, "ab")).first().text


# reports


def test_sarif(spark):
    one = {"runs": [{"results": [{"level": "error", "ruleId": "R", "message": {"text": "t"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "f.go"}, "region": {"startLine": 3}}}]}, {"message": {"text": "u"}}]}]}
    df = spark.createDataFrame([(1, json.dumps(one)), (2, '{"runs": []}'), (3, "no json")], "id int, log string")
    got = {r.id: r.output for r in results.sarif_report(df, ["id"]).collect()}
    assert got == {1: "1 error(s), 1 warning(s)\nf.go:3: [error] t (R)\n[warning] u", 2: "0 findings", 3: None}


def test_diagnostics_and_hook(spark):
    schema = "path string, check_name string, severity string, passed boolean, output string, message string, command string"
    df = spark.createDataFrame([("a.go", "c", "blocking", False, "a.go:12: x\na.go:40: y", None, "r"), ("a.go", "d", "advisory", False, "free text", "m", "r"), ("b.go", "e", "blocking", True, "", None, "r"), ("d.go", "f", "advisory", False, "o", None, "r")], schema)
    got = sorted((r.path, r.line, r.severity) for r in results.diagnostics(df).collect())
    assert got == [("a.go", 0, "WARNING"), ("a.go", 11, "ERROR"), ("a.go", 39, "ERROR"), ("d.go", 0, "WARNING")]
    hook = {r.path: r for r in results.hook_responses(df, ["path"], "note").collect()}
    assert hook["a.go"].exit_code == 2 and hook["a.go"].stdout is None and hook["b.go"].exit_code == 0 and hook["b.go"].stdout is None
    assert "note" in json.loads(hook["d.go"].stdout)["hookSpecificOutput"]["additionalContext"]


# languages


def nested(language, n):
    if language == "python":
        return "def f():\n" + "".join("    " * (k + 1) + "if a:\n" for k in range(n)) + "    " * (n + 1) + "x()\n"
    head = {"go": "func f() {", "kotlin": "fun f() {", "java": "class A { void f() {"}.get(language, "function f() {")
    test = "if a {" if language == "go" else "if (a) {"
    return head + "\n" + (test + "\n") * n + "x()\n" + "}\n" * n + "}\n" + ("}" if language == "java" else "")


@pytest.mark.parametrize("language", ["go", "typescript", "javascript", "python", "java", "kotlin"])
def test_nesting_body_and_chains(language):
    assert [scan.functions(language, nested(language, n))[0].depth for n in (0, 3, 4)] == [1, 4, 5]
    if language != "python":
        open_, test, close = nested(language, 0).split("\n")[0], ("if a {" if language == "go" else "if (a) {"), "\n}\n"
        chain = open_ + "\n" + test + "\nx()\n" + "".join(f"}} else {test}\nx()\n" for _ in range(5)) + "} else {\ny()\n}" + close
        assert scan.functions(language, chain)[0].depth == 2
        assert [scan.functions(language, open_ + "\n" + "x()\n" * n + "}")[0].body_lines for n in (38, 39)] == [40, 41]
    else:
        assert scan.functions(language, "def f():\n    if a:\n        x()\n" + "    elif b:\n        x()\n" * 5)[0].depth == 2
        assert scan.functions(language, "def f(a, b, /, c, *, d, e):\n    pass\n")[0].parameters == 5


def test_brackets_are_paired_in_one_pass():
    ts = scan.tokens("f(" * 20_000 + "]" + ")" * 20_000 + "{")
    began = time.perf_counter()
    assert [scan.closing(ts, 2 * k + 1) for k in range(20_000)] == list(range(60_000, 40_000, -1)) and scan.closing(ts, len(ts) - 1) == len(ts) - 1
    assert time.perf_counter() - began < 5  # a search from each bracket takes minutes


def test_tokens_of_odd_sources():
    kinds = lambda source: [(t.kind, t.text, t.row) for t in scan.tokens(source)]
    assert kinds('"a\n"') == [("string", '"a', 1), ("string", '"', 2)] and kinds('"ab\\') == [("sign", '"', 1), ("word", "ab", 1), ("sign", "\\", 1)]
    assert kinds("/* a\n */ $x 1.5e3 ²a\n`b\n` => //") == [("word", "$x", 2), ("number", "1.5e3", 2), ("word", "²a", 2), ("string", "`b\n`", 3), ("sign", "=>", 4)]
    assert [f.depth for f in scan.functions("javascript", ") => { if (a) { b() } }\nf(")] == [2]  # nothing opens the parameters


@pytest.mark.parametrize("facts", [source_queries.syntax_facts, source_queries.syntax_rule_findings, source_queries.go_rule_findings, source_queries.batch_run])
def test_sources_are_scanned_on_all_cores(spark, facts, monkeypatch):
    counts = []
    scanned = rules._facts
    monkeypatch.setattr(rules, "_facts", lambda files, *how: counts.append(files.select(F.spark_partition_id()).distinct().count()) or scanned(files, *how))
    facts(spark, "/root/testdata/sf0.01")
    assert min(n for n in counts if n) >= spark.sparkContext.defaultParallelism  # there are no files of other languages


def test_parameter_counts():
    count = lambda language, source: scan.functions(language, source)[0].parameters
    assert count("go", "func f(a, b, c, d, e int) {}\n") == 5 and count("go", "func (s *S) f(a, b int, c ...string) (x int, err error) {\n}\n") == 3
    assert count("typescript", "function f({a, b}, [c], ...rest) {}\n") == 3 and count("java", "class A { int f(int a, List<Map<K, V>> b) { } }\n") == 2
    assert count("kotlin", "fun f(a: Int, vararg b: Int) { }\n") == 1


@pytest.mark.parametrize("parameters,n", [("a, b string", 1), ("a string, b string", 1), ("a string, b string, c string", 1), ("a string, b int", 0), ("a Foo, b Foo", 0), ("a, b string, c string", 1), ("a string, b ...string", 0)])
def test_same_typed_parameters(parameters, n):
    assert len(go.same_typed_parameters(f"package p\nfunc f({parameters}) {{}}\n")) == n


@pytest.mark.parametrize("statement,n", [("v, _ := f()", 1), ("_, v := f()", 0), ("v := f()", 0), ("_, _ := f()", 1), ("v, _ = f()", 0)])
def test_ignored_errors(statement, n):
    assert len(go.ignored_errors(f"package p\nfunc f() {{\n{statement}\n}}\n")) == n


@pytest.mark.parametrize("body,n", [("if err != nil { return err }", 1), ("if err != nil { return 0, err }", 1), ("if (err != nil) { return err }", 1), ("if err == nil { return err }", 0), ('if err != nil { return fmt.Errorf("x: %w", err) }', 0), ("if err != nil { return }", 0), ("if err != nil { return v, err }", 0), ("if err != nil {\nlog(err)\nreturn err\n}", 0)])
def test_bare_errors(body, n):
    wraps = 'func g() error { return fmt.Errorf("a: %w", e) }\n'
    assert len(go.bare_errors(f"package p\n{wraps}func f() error {{\n{body}\n}}\n")) == n
    assert go.bare_errors(f"package p\nfunc f() error {{\n{body.replace('%w', '%v')}\n}}\n") == []


def test_go_findings(spark):
    source = 'package p\n\nimport (\n\t_ "a" // why\n\t_ "b"\n\t// reason\n\t_ "c"\n\t_ "d"\n)\n\nfunc f(a, b string) {\n\tv, _ := g()\n}\n'
    got = sorted((r.rule, r.line) for r in rules.go_findings(of(spark, "x.go", source)).collect())
    assert got == [("go-blank-imports", 5), ("go-blank-imports", 8), ("go-ignored-error", 12), ("primitive-obsession", 11)]


def test_syntax_findings(spark):
    got = rules.syntax_findings(files(spark, a_dot_go=nested("go", 4), b_dot_py=nested("python", 3), c_dot_ts="function f(a,b,c,d,e,f) {\n" + "x()\n" * 45 + "}\n")).collect()
    assert sorted((r.path, r.rule) for r in got) == [("a.go", "deep-nesting"), ("c.ts", "long-function"), ("c.ts", "long-parameter-list")]


@pytest.mark.parametrize(
    "source,expected",
    [
        ("see [x][a]\n", ["undefined reference: a"]), ("see [x][a]\n\n[a]: http://e.org\n", []), ("[a]: http://e.org\n", ["unused definition: a"]), ("note[^1]\n", []),
        ("![i][nope]\n", []), ("`[x][a]`\n", []), ("```\n[x][a]\n```\n", []), ("[short]\n", ["undefined reference: short"]), ("[A b][]\n\n[a  B]: https://e.org\n", []), ("[A b][]\n\n[a  B]: u\n", ["definition a b: missing file: u"]),
        ("# One\n\n[x](#one)\n", []), ("# One\n\n[x](#two)\n", ["no such heading: #two"]), ("# A\n# A\n\n[x](#a-1)\n", []), ("# A &amp; B\n\n[x](#a--b)\n", []),
        ("[x]\n\n[x]: #gone\n", ["definition x leads to no heading: #gone"]), ("[x]\n\n[x]: other.md#here\n", []), ("[x]\n\n[x]: other.md#gone\n", ["definition x: dead anchor: other.md#gone"]),
        ("[x]\n\n[x]: no.md#here\n", ["definition x: missing file: no.md#here"]), ("[x]\n\n[x]: https://e.org/#a\n", []), ("Title\n=====\n\n[x](#title)\n", []),
        ("![i][p]\n\n[p]: https://e.org/i.png\n", []), ("about [s] here\n\n[s]: https://e.org\n", []), ("use [c][].\n\n[c]: https://e.org/b\n", []), ("[s]: https://e.org\n\nsee [it][ S ]\n", []),
        ("write `[l][r]` and `[r]: t` so\n", []), ("## By `call()`\n\n[l](#by-call)\n", []), ("## The *Big* [Plan](https://e.org)\n\n[l](#the-big-plan)\n", []), ("<details>\n<summary>M</summary>\n\n## In There\n\n</details>\n\n[l](#in-there)\n", []),
        ("", []), ("an [open bracket and no end\n", []), ("# H One\n\nSee [s][r] and [H](#h-one).\n\n[r]: https://e.org\n", []), ("note[^1]\n\n[^1]: a footnote\n", []), ("[x]\n\n[x]: other.md\n", []),
        ("[x]\n\n[x]: https://e.org\n[x]: #gone\n", []), ("[x]\n\n[x]: #\n", []),
    ],
)
def test_markdown(spark, source, expected):
    df = spark.createDataFrame([("d/a.md", source), ("d/other.md", "# Here\n")], "path string, source string")
    assert sorted(r.message for r in rules.markdown_findings(df).collect()) == expected


def test_markdown_rows():
    found = markdown.parse("# A\n\ntext [b]\nmore [c](#d)\n\n[b]: x\n")
    assert found["headings"] == [(1, "A")] and [(u[0], u[1]) for u in found["uses"]] == [(3, "b"), (4, None)] and found["definitions"] == [(6, "b", "x")]


def test_import_graph(spark):
    df = files(spark, go_dot_mod="module ex.org/m\n", a__a_dot_go='package a\nimport (\n"fmt"\n"ex.org/m/b"\n)\n', b__b_dot_go='package b\nimport "ex.org/m/a"\n', w__x_dot_ts='import {y} from "../v/y";\nimport z from "react";\n', v__y_dot_ts='export * from "../w/x";\n')
    nodes, found = rules.import_graph(df)
    assert {r.node for r in nodes.collect()} == {"ex.org/m/a", "ex.org/m/b", "w", "v"}
    assert {(r.src, r.dst, r.file, r.line) for r in found.collect()} == {("ex.org/m/a", "ex.org/m/b", "a/a.go", 4), ("ex.org/m/b", "ex.org/m/a", "b/b.go", 2), ("w", "v", "w/x.ts", 1), ("v", "w", "v/y.ts", 1)}
    assert graph.strong_components(found).count() == 4


def test_import_graphs_of_repositories(spark):
    rows = [("one", "go.mod", "module m\n"), ("one", "a/x.go", 'package a\nimport "m/b"\n'), ("one", "b/x.go", "package b\n"), ("two", "go.mod", "module m\n"), ("two", "a/x.go", 'package a\nimport "m/c"\n'), ("two", "b/x.go", 'package b\nimport "m/a"\n'), ("two", "w/x.ts", 'import {\n  a,\n} from "../v/y"\n'), ("one", "v/y.ts", "")]
    nodes, found = rules.import_graph(spark.createDataFrame(rows, "repo string, path string, source string"))
    assert sorted(map(tuple, nodes.collect())) == [("one", "m/a"), ("one", "m/b"), ("one", "v"), ("two", "m/a"), ("two", "m/b"), ("two", "w")]
    assert sorted(map(tuple, found.collect())) == [("one", "m/a", "m/b", "a/x.go", 2), ("two", "m/b", "m/a", "b/x.go", 2)]
    alone = spark.createDataFrame([("w/x.ts", 'import fs from "fs";\nimport {\n  a,\n} from "../v/y"\n'), ("v/y.ts", "")], "path string, source string")
    assert [tuple(r) for r in rules.import_graph(alone)[1].collect()] == [("w", "v", "w/x.ts", 2)]


def test_imports_on_one_line(spark):
    df = files(spark, w__x_dot_ts='import a from "../u/a"; import b from "../v/b"; import c from "../v/b.ts"\n', u__a_dot_ts="", v__b_dot_ts="")
    assert sorted((r.dst, r.line) for r in rules.import_graph(df)[1].collect()) == [("u", 1), ("v", 1), ("v", 1)]


# replay


def use(name, given, id_="i"):
    return json.dumps({"type": "assistant", "message": {"content": [{"type": "tool_use", "id": id_, "name": name, "input": given}]}})


def answer(id_, text):
    return json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": id_, "content": [{"type": "text", "text": text}]}]}})


def test_replay_takes_only_whole_edits(spark):
    edits = [
        use("Write", {"file_path": "a", "content": "x"}), use("Edit", {"file_path": "a", "new_string": "y"}), use("Edit", {"file_path": "a", "old_string": "x"}),
        use("MultiEdit", {"file_path": "a"}), use("MultiEdit", {"file_path": "a", "edits": [{"old_string": "x"}]}), use("MultiEdit", {"file_path": "b", "edits": []}),
        use("Read", {"file_path": "c"}, "r"), answer("r", "1\tp\u2028q\f\r\n2\tr\n"), use("Edit", {"file_path": "c", "old_string": "r", "new_string": "s"}),
    ]
    df = spark.createDataFrame([("t", k, raw) for k, raw in enumerate(edits)], "transcript string, line_no int, raw string")
    rows = replay.snapshots(df).collect()
    assert [(r.seq, r.path, r.before, r.after) for r in rows if r.path] == [(1, "a", None, "x"), (2, "c", "p\u2028q\f\nr", "p\u2028q\f\ns")]
    assert [r.lost for r in rows if not r.path] == [2]


@pytest.mark.parametrize(
    ("language", "body", "depth"),
    [
        ("javascript", "if (a) { if (b) { if (c) if (d) e() } }", 5),
        ("javascript", "if (a) b(); else if (c) d(); else if (e) f(); else g()", 2),
        ("javascript", "for (const x of y) while (z) do { q() } while (r)", 4),
        ("javascript", "const f = () => { if (a) b() }; function g() { if (c) d() }", 3),
        ("javascript", "x.if(1); if (a)\n  b()\nif (c) { d() }", 2),
        ("javascript", "return a.map(x => x.map(y => y + 1))", 3),
        ("java", "for (int i = 0; i < n; i++) if (a) while (b) c();", 4),
        ("java", "switch (x) { case 1 -> { if (a) b(); } default -> c(); }", 3),
        ("java", "list.forEach(x -> { if (x) y(); });", 3),
        ("kotlin", "if (a) b() else if (c) d() else { when (x) { 1 -> e() } }", 3),
        ("kotlin", "items.forEach { x -> if (x) y() }", 3),
        ("go", "if a {\nif b {\nfor {\nswitch {\ncase c:\nd()\n}\n}\n}\n}", 5),
        ("go", "if a {\n} else if b {\n} else {\nselect {}\n}\ngo func() { if c {} }()", 3),
    ],
)
def test_nesting(language, body, depth):
    ts = scan.tokens("{" + body + "}")
    assert scan.depth_of(language, ts, 0, len(ts) - 1) == depth


def test_replay_and_backtest(spark):
    go_source = "package p\nfunc f() {\n\tv, _ := g()\n}\n"
    logs = {
        "write": [use("Write", {"file_path": "a.go", "content": go_source})],
        "unseeded": [use("Edit", {"file_path": "a.go", "old_string": "x", "new_string": "y"})],
        "seeded": [use("Read", {"file_path": "a.go"}, "r"), answer("r", "\n".join(f"{k}\t{x}" for k, x in enumerate(go_source.splitlines()))), "not json", use("Edit", {"file_path": "a.go", "old_string": "g()", "new_string": "h()"})],
        "windowed": [use("Read", {"file_path": "a.go", "offset": 3}, "r"), answer("r", "1\tx"), use("Edit", {"file_path": "a.go", "old_string": "x", "new_string": "y"})],
        "multi": [use("Write", {"file_path": "a.go", "content": "one two"}), use("MultiEdit", {"file_path": "a.go", "edits": [{"old_string": "one", "new_string": "1"}, {"old_string": "1 two", "new_string": "3"}]}), use("MultiEdit", {"file_path": "a.go", "edits": [{"old_string": "gone", "new_string": ""}]})],
    }
    df = spark.createDataFrame([(t, k, raw) for t, rows in logs.items() for k, raw in enumerate(rows)], "transcript string, line_no int, raw string")
    snaps = replay.snapshots(df).cache()
    assert {r.transcript: r.lost for r in snaps.where("path is null").collect()} == {"write": 0, "unseeded": 1, "seeded": 0, "windowed": 1, "multi": 1}
    assert sorted((r.transcript, r.seq, r.after) for r in snaps.where("transcript = 'multi' and path is not null").collect()) == [("multi", 1, "one two"), ("multi", 2, "3")]
    found = replay.backtest(snaps, rules.go_findings).collect()
    assert sorted((r.transcript, r.line, r.pre_existing) for r in found) == [("seeded", 3, True), ("write", 3, False)]
    assert [r.transcript for r in replay.backtest(snaps, rules.go_findings, only_new=True).collect()] == ["write"]


# sources


def test_trees_repositories_and_commands(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src/vendor").mkdir(parents=True)
    (root / "src/a.go").write_text("package a\n")
    (root / "src/bad.go").write_bytes(b"\xff\xfe")
    (root / "src/vendor/x.go").write_text("no")
    got = {r.path: r.source for r in sources.source_files(spark, str(root)).collect()}
    assert got == {"src/a.go": "package a\n", "src/bad.go": None}
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    assert sources.head_files(spark, str(root)).count() == 0
    git("add", "src/a.go")
    git("commit", "-qm", "x")
    (root / "src/a.go").write_text("package a\n\nvar x = 1\n")
    assert [tuple(r) for r in sources.head_files(spark, str(root)).collect()] == [("src/a.go", "package a\n")]
    assert [tuple(r)[1:] for r in scope.diff_hunks(sources.diffs(spark, str(root))).collect()] == [(1, 1, 0, 2, 2)]
    c = spark.createDataFrame([("c", "src/a.go", "cat src/a.go; exit 3", str(root))], "check_name string, path string, command string, cwd string")
    r = sources.command_results(c, allow=True).first()
    assert r.output.startswith("package a") and r.passed is False
    with pytest.raises(PermissionError):
        sources.command_results(c)
    (root / sources.CONFIG_NAME).write_text('{"checks": []}')
    assert sources.find_config(str(root / "src")) == ({"checks": []}, str(root))
    assert sources.transcripts(spark, str(tmp_path / "none")).count() == 0


def test_config_errors():
    bad = {"checks": [{"name": "a"}, {"name": "b", "command": "x", "checker": "y"}, {"name": "c", "checker": "nope"}, {"name": "d", "architecture_checker": "layering", "triggers": ["edit"]}, {"name": "e", "checker": "known", "output_format": "sarif"}, {"name": "f", "command": "x {file}"}]}
    assert [e.split(":")[0] for e in sources.config_errors(bad, {"known"}, {"layering"})] == ["a", "b", "b", "c", "d", "e"]
    assert [sources.check_kind(c) for c in bad["checks"][3:]] == ["whole-repo native", "per-file native", "per-file command"]


# registered queries against their SQL


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


QUERIES, ORACLES = queries.QUERIES | source_queries.QUERIES, oracles.ORACLES | source_oracles.ORACLES


@pytest.mark.parametrize("name", QUERIES)
def test_query_against_duckdb(spark, tables, name):
    got, expected = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), tables.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and plain(got) == plain(expected)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLES.keys()
