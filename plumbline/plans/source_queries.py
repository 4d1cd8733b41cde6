"""Queries over sources, logs and edits that are written from the driver's tables, row by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import ADVISORY_NOTE
from ..functions.text import command_for, directory, label_key, lines
from ..operators import blocks, graph, replay, results, rules, run, scope
from .queries import _results, _strong_edges, table

LANGUAGES = ("go", "ts", "tsx", "js", "py", "java", "kt")
#: Per language: what opens a function, the two kinds of nested blocks, and what stands around it all.
_SHAPES = {
    "go": ("package p\n\nfunc f({}) {{\n", "if x {\n", "for {\n", "}\n", "a{} int"),
    "ts": ("function f({}) {{\n", "if (x) {\n", "while (y) {\n", "}\n", "a{}: number"),
    "js": ("function f({}) {{\n", "if (x) {\n", "for (;;) {\n", "}\n", "a{}"),
    "java": ("class C {{\n  void f({}) {{\n", "if (x) {\n", "do {\n", "}\n", "int a{}"),
    "kt": ("fun f({}) {{\n", "if (x) {\n", "while (y) {\n", "}\n", "a{}: Int"),
}
_SHAPES["tsx"] = _SHAPES["ts"]


def _source(language: str, n: Column, depth: Column, parameters: Column) -> Column:
    """A function of n statements inside `depth` nested blocks, with that many parameters."""
    numbers = lambda k: F.filter(F.sequence(F.lit(0), F.lit(8)), lambda i: i < k)
    if language == "py":
        indent = lambda k: F.repeat(F.lit(" "), (k + 1).cast("int"))
        nested = F.array_join(F.transform(numbers(depth), lambda i: F.concat(indent(i), F.when(i % 2 == 0, "if x:\n").otherwise("while y:\n"))), "")
        given = F.array_join(F.transform(numbers(parameters), lambda i: F.concat(F.lit("a"), i.cast("string"))), ", ")
        return F.concat(F.lit("def f("), given, F.lit("):\n"), nested, F.repeat(F.concat(indent(depth), F.lit("s()\n")), n.cast("int")))
    head, first, second, end, one = _SHAPES[language]
    before, after = one.split("{}")
    given = F.array_join(F.transform(numbers(parameters), lambda i: F.concat(F.lit(before), i.cast("string"), F.lit(after))), ", ")
    nested = F.array_join(F.transform(numbers(depth), lambda i: F.when(i % 2 == 0, first).otherwise(second)), "")
    closing = F.array_join(F.transform(numbers(depth), lambda i: F.when((i % 2 == 1) & F.lit(language == "java"), "} while (y);\n").otherwise(end)), "")
    if language == "java":  # blocks close from the inside out
        closing = F.array_join(F.transform(numbers(depth), lambda i: F.when((depth - 1 - i) % 2 == 1, "} while (y);\n").otherwise(end)), "")
    opened, rest = head.replace("{{", "{").split("{}")
    tail = "}\n}\n" if language == "java" else "}\n"
    return F.concat(F.lit(opened), given, F.lit(rest), nested, F.repeat(F.lit("s();\n" if language != "go" else "s()\n"), n.cast("int")), closing, F.lit(tail))


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores before a source is written of each: a table of narrow rows is a file of one or two row
    groups, and so would its sources be scanned by one or two tasks, however many they are."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, key)


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", (F.col("p_partkey") % 53 + 1).alias("n"), (F.col("p_size") % 7).alias("depth"), (F.expr("p_partkey div 7") % 9).alias("parameters"), (F.col("p_partkey") % 7).alias("language"))
    source = F.coalesce(*[F.when(F.col("language") == k, _source(x, F.col("n"), F.col("depth"), F.col("parameters"))) for k, x in enumerate(LANGUAGES)])
    suffix = F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), F.col("language").cast("int") + 1)
    return p.select(F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit("."), suffix).alias("path"), source.alias("source"))


def syntax_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long, deep and wide functions in seven languages, a function per part."""
    found = rules.findings_of(_functions(spark, sf_dir), [n for n in rules.CHECKERS if n.startswith("syntax-rules")])
    return found.select("checker", "path", F.col("line").cast("long").alias("line"), "message")


def syntax_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, nesting and parameters of every function."""
    f = rules.syntax_facts(_functions(spark, sf_dir))
    return f.select("path", *[F.col(c).cast("long").alias(c) for c in ("line", "body_lines", "depth", "parameters")])


def _go_files(df: DataFrame, key: str) -> DataFrame:
    """A Go file per key, whose offences follow from the key."""
    k = F.col(key)
    text = F.concat(
        F.lit('package p\n\nimport (\n\t"fmt"\n\t_ "side/'), k.cast("string"), F.lit('"'), F.when(k % 3 == 0, " // registers itself").otherwise(""), F.lit("\n)\n\nfunc f("),
        F.when(k % 2 == 0, "a, b string").otherwise("a string, n int"), F.lit(") error {\n\tv, "), F.when(k % 5 == 0, "_").otherwise("err"), F.lit(" := g()\n\tif err != nil {\n\t\treturn "),
        F.when(k % 4 == 0, "err").otherwise('fmt.Errorf("f: %w", err)'), F.lit('\n\t}\n\treturn fmt.Errorf("x: %w", v)\n}\n'),
    )
    return _dealt(df, key).select(F.concat(F.lit("go/"), k.cast("string"), F.lit(".go")).alias("path"), text.alias("source"))


GO_RULES = ["primitive-obsession", "go-ignored-error", "go-blank-imports", "go-error-context"]


def go_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What Go checkers find in a file per customer."""
    found = rules.findings_of(_go_files(table(spark, sf_dir, "customer"), "c_custkey"), GO_RULES)
    return found.select("checker", "path", F.col("line").cast("long").alias("line"), "message")


def duplicate_code_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated blocks in documents, taken for Python files, as findings."""
    files = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("text").alias("source"))
    return rules.findings_of(files, ["duplicate-code"]).select("path", F.col("line").cast("long").alias("line"), "message")


def _markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    text = F.concat(
        F.lit("# Part "), s(k), F.lit(" &amp; more\n\nSee [a][ref"), s(k % 3), F.lit("], [b][other] and [c](#part-"), s(k + k % 2), F.lit("--more).\n\n[ref0]: https://example.org/"), s(k), F.lit("\n[other]: "), s(k + 1), F.lit(".md#"),
        F.when(k % 5 == 0, "nowhere").otherwise(F.concat(F.lit("part-"), s(k + 1), F.lit("--more"))), F.lit("\n"),
    )
    return _dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(F.concat(F.lit("docs/"), s(k), F.lit(".md")).alias("path"), text.alias("source"))


def markdown_link_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and anchors of a document per customer, each of which leads to the next."""
    found = rules.findings_of(_markdown_files(spark, sf_dir), ["markdown-link-integrity"])
    return found.select("path", F.col("line").cast("long").alias("line"), "message")


def _edge_files(spark: SparkSession, sf_dir: str, script: bool) -> DataFrame:
    """A package per nation that imports those to which its strong edges lead."""
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    e = _strong_edges(spark, sf_dir).groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("to"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src")).join(e, "src", "left").withColumn("to", F.coalesce("to", F.array().cast("array<int>")))
    if script:
        each = F.transform("to", lambda d: F.concat(F.lit("import { x"), d.cast("string"), F.lit(" } from '../n"), d.cast("string"), F.when(d % 2 == 0, F.lit("/index';")).otherwise("';")))
        return n.select(F.concat(name("src"), F.lit("/index.ts")).alias("path"), F.concat(F.lit("import fs from 'fs';\n"), F.array_join(each, "\n")).alias("source"))
    each = F.transform("to", lambda d: F.concat(F.lit('\t"example.org/m/n'), d.cast("string"), F.lit('"\n')))
    files = n.select(F.concat(name("src"), F.lit("/x.go")).alias("path"), F.concat(F.lit("package p\n\nimport (\n\t\"fmt\"\n"), F.array_join(each, ""), F.lit(")\n")).alias("source"))
    return files.unionByName(spark.createDataFrame([("go.mod", "module example.org/m\n\ngo 1.22\n")], "path string, source string"))


def go_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the import graph of Go packages."""
    return rules.import_graph(_edge_files(spark, sf_dir, False))[1].select("src", "dst", "file", F.col("line").cast("long").alias("line"))


def script_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the import graph of script folders; the index of a folder is found without being named."""
    return rules.import_graph(_edge_files(spark, sf_dir, True))[1].select("src", "dst", "file", F.col("line").cast("long").alias("line"))


def architecture_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles, layering and coupling of the Go packages."""
    nodes, edges = (graph._settled(spark, x) for x in rules.import_graph(_edge_files(spark, sf_dir, False)))
    out = None
    for name in rules.ARCHITECTURE_CHECKERS:
        one = graph.architecture_findings(name, nodes, edges, ["n1", "n7", "n3"])
        out = one if out is None else out.unionByName(one)
    return out.select("checker", F.coalesce("file", F.lit("")).alias("file"), F.coalesce(F.col("line").cast("long"), F.lit(0)).alias("line"), "message")


def repository_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packages, dealt into a repository per region: imports from outside a repository are left out."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("/x.go")).alias("path"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("repo"))
    files = _edge_files(spark, sf_dir, False)
    mods = n.select("repo").distinct().select("repo", F.lit("go.mod").alias("path"), F.lit("module example.org/m\n").alias("source"))
    every = files.join(n, "path").select("repo", "path", "source").unionByName(mods)
    return rules.import_graph(every)[1].select("repo", "src", "dst", "file", F.col("line").cast("long").alias("line"))


def assessment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The architecture of the Go packages as a report."""
    config = {"checks": [{"name": n, "architecture_checker": n} for n in rules.ARCHITECTURE_CHECKERS], "architecture": {"layers": ["n1", "n7", "n3"]}}
    out = run.assessment(_edge_files(spark, sf_dir, False), config)
    return out.groupBy(F.col("part").cast("long").alias("part"), "text").agg(F.count("*").alias("n"))


def hook_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit events over a Go file per customer: only what the edit has touched counts."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    empty = F.lit(None).cast("string")
    new = F.when(k % 2 == 0, "v, ").when(k % 3 == 0, "func f(").otherwise("nowhere")
    given = F.struct(F.concat(F.lit("go/"), k.cast("string"), F.lit(".go")).alias("file_path"), new.alias("new_string"), empty.alias("content"), F.lit(None).cast("array<struct<new_string:string>>").alias("edits"))
    events = c.select(F.lit("/").alias("cwd"), F.lit("edit").alias("hook_event_name"), F.concat(F.lit("t"), k.cast("string")).alias("tool_use_id"), given.alias("tool_input"))
    done = run.hook_results(events.unionByName(events), _go_files(c, "c_custkey"), {"checks": RUN["checks"][:2]}, "edit")
    return done.select("tool_use_id", "check_name", "severity", "passed", F.md5("output").alias("output_md5"))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session log per conversation: its first turn is read or written, each later one edits the file."""
    c = table(spark, sf_dir, "conversations")
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    c = c.select("conv_id", turn.alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    name = F.concat(F.lit("f"), F.col("conv_id").cast("string"))
    shown = F.array_join(F.transform(lines(F.col("text")), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\t"), x)), "\n")
    message = lambda kind, block: F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(F.array(block).alias("content")).alias("message")))
    use = lambda tool, given: message("assistant", F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), F.col("k").cast("string")).alias("id"), F.lit(tool).alias("name"), given.alias("input")))
    read = use("Read", F.struct(name.alias("file_path")))
    answer = message("user", F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), F.col("k").cast("string")).alias("tool_use_id"), shown.alias("content")))
    write = use("Write", F.struct(name.alias("file_path"), F.col("text").alias("content")))
    edit = use("Edit", F.struct(name.alias("file_path"), F.element_at(F.array(F.lit("e"), F.lit("an"), F.lit("t\n")), (F.col("k") % 3 + 1).cast("int")).alias("old_string"), F.concat(F.lit("<"), F.col("k").cast("string"), F.lit(">")).alias("new_string")))
    first = F.when(F.col("conv_id") % 2 == 0, F.array(read, answer)).otherwise(F.array(write))
    rows = c.select(F.col("conv_id").cast("string").alias("transcript"), "k", F.posexplode(F.when(F.col("k") == 0, first).otherwise(F.array(edit))).alias("j", "raw"))
    return rows.select("transcript", (F.col("k") * 2 + F.col("j")).cast("int").alias("line_no"), "raw")


def replay_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file after each edit of a session, and edits that can't be followed."""
    s = replay.snapshots(_logs(spark, sf_dir))
    return s.select("transcript", F.col("seq").cast("long").alias("seq"), "path", F.md5("before").alias("before_md5"), F.md5("after").alias("after_md5"), F.col("lost").cast("long").alias("lost"))


def backtest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Go checkers over edits that make each supplier's file the next one's."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") + 1).alias("next"))
    key = F.col("path")
    before, after = _go_files(s, "s_suppkey").select(key, F.col("source").alias("before")), _go_files(s, "next").select(F.concat(F.lit("go/"), (F.regexp_extract("path", "([0-9]+)", 1).cast("long") - 1).cast("string"), F.lit(".go")).alias("path"), F.col("source").alias("after"))
    snaps = before.join(after, "path").select(F.lit("log").alias("transcript"), F.regexp_extract("path", "([0-9]+)", 1).cast("int").alias("seq"), "path", "before", "after", F.lit(0).alias("lost"))
    tested = replay.backtest(snaps, lambda f: rules.findings_of(f, GO_RULES).withColumnRenamed("checker", "rule"))
    return replay.backtest_lines(tested).select(F.col("seq").cast("long").alias("seq"), "text")


def hook_changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that edits have changed: the new texts are each document's third line and its word in front."""
    d = table(spark, sf_dir, "documents").withColumn("third", F.get(F.split("text", "\n", -1), F.lit(2))).withColumn("word", F.split_part("text", F.lit(" "), F.lit(1)))
    empty = F.lit(None).cast("string")
    edits = F.array(F.struct(F.col("third").alias("new_string")), F.struct(F.lit("").alias("new_string")), F.struct(F.col("word").alias("new_string")))
    given = F.struct(F.lit("f").alias("file_path"), empty.alias("new_string"), F.when(F.col("doc_id") % 7 == 0, F.col("text")).alias("content"), edits.alias("edits"))
    spans = d.select("doc_id", F.explode(run.changed_ranges(F.col("text"), given)).alias("r"))
    return spans.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("r.start").cast("long").alias("starts"), F.sum("r.end").cast("long").alias("ends"))


def hook_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit code and texts by which a hook tells of each user's check results."""
    r = _results(spark, sf_dir).withColumn("output", F.concat(F.lit("at "), F.col("event_id").cast("string")))
    return results.hook_responses(r, ["path"], ADVISORY_NOTE).select("path", F.col("exit_code").cast("long").alias("exit_code"), F.md5("stderr").alias("stderr_md5"), F.md5("stdout").alias("stdout_md5"))


def diagnostic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed results of events as diagnostics."""
    k = F.col("event_id")
    text = F.when(k % 3 == 0, F.lit("no line told")).otherwise(F.concat("path", F.lit(":"), (k % 50).cast("string"), F.lit(": first\nelsewhere:3: second\n"), "path", F.lit(": "), (k % 7 + 1).cast("string"), F.lit(" :third : x ")))
    return results.diagnostics(_results(spark, sf_dir).withColumn("output", text)).groupBy("path", "line", "severity", "source", "message").agg(F.count("*").alias("n"))


def scoped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long lines of documents, as a check's output, of which only those in changed lines count."""
    ls = blocks.numbered_lines(table(spark, sf_dir, "documents"), "doc_id", "text").where(F.octet_length("text") >= 200)
    told = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("line").cast("string"), F.lit(": long"))
    r = ls.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", told.alias("x")))), lambda x: x["x"]), "\n").alias("output"))
    a = (F.col("doc_id") % 7 + 1).cast("int")
    ranges = F.when(F.col("doc_id") % 4 != 0, F.array(F.struct(a.alias("start"), (a + 3).alias("end")), F.struct((a + 9).alias("start"), (a + 9).alias("end"))))
    out = scope.scoped_output(r.select("doc_id", F.col("doc_id").cast("string").alias("path"), "output", ranges.alias("ranges"), F.lit(False).alias("passed")))
    return out.select("doc_id", F.md5("kept").alias("kept_md5"), "passed")


RUN = {
    "checks": [
        {"name": "errors", "checker": "go-ignored-error", "severity": "blocking", "message": "mind errors"},
        {"name": "context", "checker": "go-error-context", "severity": "blocking"},
        {"name": "threes", "checker": "primitive-obsession", "scope": ["go/*3.go"]},
        {"name": "never", "checker": "go-blank-imports", "triggers": ["edit"]},
        {"name": "prose", "checker": "markdown-link-integrity"},
    ]
}


def batch_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration over a Go file per customer; at the base revision each file was the one before it."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") - 1).alias("before"))
    files = _go_files(c, "c_custkey")
    head = _go_files(c.where("before % 10 <> 0"), "before").select(F.concat(F.lit("go/"), (F.regexp_extract("path", "(-?[0-9]+)", 1).cast("long") + 1).cast("string"), F.lit(".go")).alias("path"), "source")
    done = run.file_results(files, RUN, "batch", head=head)
    return done.select("path", "check_name", "severity", "passed", F.md5("output").alias("output_md5"), "message")


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of labels, folders of paths and commands of checks."""
    p = table(spark, sf_dir, "part")
    label = F.concat(F.lit(" \t"), F.upper("p_name"), F.lit("\n \n"), F.col("p_type"), F.lit(" "))
    path = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("\\"), "p_type", F.lit("/x.go")))
    spans = F.when(F.col("p_partkey") % 2 == 0, F.array(F.struct(F.lit(1).alias("start"), F.col("p_size").alias("end")), F.struct(F.lit(70).alias("start"), F.lit(71).alias("end"))))
    command = command_for(F.lit("lint {file} --lines {changed_lines}"), F.col("p_brand"), spans)
    return p.select("p_partkey", label_key(label).alias("label"), directory(path).alias("folder"), command.alias("command"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        syntax_rule_findings, syntax_facts, go_rule_findings, duplicate_code_findings, markdown_link_findings, go_import_edges, script_import_edges,
        architecture_findings, repository_import_edges, assessment_report, hook_results, replay_snapshots, backtest_lines, hook_changed_lines, hook_answers, diagnostic_rows, scoped_results, batch_run, text_keys,
    )
}
