"""A run: checks of a configuration over files, as one plan from findings to report and exit code.

files are (path, source); source is null where it can't be read. A configuration is a dictionary with `checks` and,
for architecture checks, `architecture` with `layers`. It is small by nature, so its fields become predicates and
constants of the plan rather than tables to join. Results are (path, check_name, severity, passed, output, message,
command); a check that fails the same way at the base revision is advisory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ADVISORY_NOTE, OLD_FAILURE, RECOMMENDATIONS
from ..functions.text import command_for, in_scope, occurrence_lines
from ..sources.files import check_kind, command_results
from . import graph, results, rules, scope, state

RESULT = ["path", "check_name", "severity", "passed", "output", "message", "command"]
RANGES = "array<struct<start:int,end:int>>"
#: One edit event, as an editor's hook sends it: a JSON object per line.
EVENT = "cwd string, hook_event_name string, tool_use_id string, tool_input struct<file_path: string, new_string: string, content: string, edits: array<struct<new_string: string>>>"


def _of(checks: list[dict], field: str) -> Column:
    """A field of the check that check_name names; null where it has none."""
    out = F.lit(None).cast("string")
    for c in checks:
        out = F.when(F.col("check_name") == c["name"], F.lit(c.get(field)).cast("string")).otherwise(out)
    return out


def split_checks(config: dict) -> tuple[list[dict], list[dict]]:
    """Checks per file, and checks of the whole tree: these run once, and their scope doesn't count."""
    checks = [{"severity": "advisory", **c} for c in config.get("checks", [])]
    per_file = [c for c in checks if check_kind(c).startswith("per-file")]
    return per_file, [c for c in checks if c not in per_file]


def native_results(files: DataFrame, checks: list[dict], trigger: str) -> DataFrame:
    """Results of native checks per file in scope. A file that the checker's own globs leave out passes; one that
    can't be read fails. Findings are gathered by file, and a file's checks are told apart in its row: no row per file
    and check is dealt by a key. Checkers that the trigger doesn't start aren't asked."""
    native = [c for c in checks if c.get("checker")]
    wanted = F.lit(False)
    for c in native:
        wanted = F.when(F.col("check_name") == c["name"], in_scope(F.col("path"), rules.CHECKERS[c["checker"]][0])).otherwise(wanted)
    asked: dict[str, Column] = {}  # per checker: the paths in scope of any of its checks
    for c in scope.started(native, trigger):
        here = in_scope(F.col("path"), c.get("scope", []))
        asked[c["checker"]] = asked[c["checker"]] | here if c["checker"] in asked else here
    found = rules.findings_of(files.where("source is not null"), sorted(asked))
    for name, here in asked.items():
        found = found.where((F.col("checker") != name) | here)
    found = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("checker", "line", "message"))).alias("told"))
    picked = scope.selected_checks(files.select("path", F.col("source").isNull().alias("unreadable")).join(found, "path", "left"), native, trigger)
    own = F.filter("told", lambda x: x["checker"] == F.col("checker"))
    told = picked.withColumn("checker", _of(native, "checker")).withColumn("gated", wanted).withColumn("output", F.when(F.size(own) > 0, results.output_lines(F.col("path"), own)))
    failed = F.col("gated") & (F.col("unreadable") | F.col("output").isNotNull())
    output = F.when(F.col("gated") & F.col("unreadable"), F.concat(F.lit("can't read "), "path")).when(F.col("gated"), F.coalesce("output", F.lit(""))).otherwise("")
    return told.select("path", "check_name", _of(native, "severity").alias("severity"), (~failed).alias("passed"), output.alias("output"), F.when(F.col("gated"), _of(native, "message")).alias("message"), F.concat(F.lit("plumbline check native "), "checker", F.lit(" "), "path").alias("command"))


def shell_results(files: DataFrame, checks: list[dict], trigger: str, cwd: str, ranges: DataFrame | None = None) -> DataFrame:
    """Results of commands, one per file in scope; with sarif: whether the output was a SARIF log, shown as text."""
    own = [c for c in checks if c.get("command")]
    picked = scope.selected_checks(files.select("path"), own, trigger)
    picked = picked.withColumn("ranges", F.lit(None).cast(RANGES)) if ranges is None else picked.join(ranges, "path", "left")
    asked = picked.select("check_name", "path", command_for(_of(own, "command"), F.col("path"), F.col("ranges")).alias("command"), F.lit(cwd).alias("cwd"))
    done = command_results(asked, allow=True)
    raw = done.withColumnRenamed("output", "raw").withColumn("log", F.when(_of(own, "output_format") == "sarif", F.col("stdout")))
    shown = results.sarif_report(raw, ["path", "check_name", "passed", "raw", "command"]).withColumnRenamed("output", "shown")
    return shown.select("path", "check_name", _of(own, "severity").alias("severity"), "passed", F.coalesce("shown", "raw").alias("output"), _of(own, "message").alias("message"), "command", F.col("shown").isNotNull().alias("sarif"))


def settled(now: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """now with blocking failures that base (path, check_name, passed) has too as advisory, and told so."""
    if base is None:
        return now.select(*RESULT)
    old = ~F.col("passed") & ~F.coalesce("base_passed", F.lit(True)) & (F.col("severity") != F.col("was"))
    failing = base.where("not passed").groupBy("path").agg(F.collect_set("check_name").alias("failing"))  # a base that passes changes nothing
    out = state.downgraded(now.withColumn("was", F.col("severity")).join(failing, "path", "left").withColumn("base_passed", F.when(F.array_contains("failing", F.col("check_name")), F.lit(False))))
    return out.withColumn("message", F.when(old, F.concat_ws(" ", "message", F.lit(OLD_FAILURE))).otherwise(F.col("message"))).select(*RESULT)


def in_changes(raw: DataFrame, ranges: DataFrame | None) -> DataFrame:
    """Results of which only findings in changed lines count; ranges: (path, ranges). Without ranges all do."""
    if ranges is None:
        return raw
    out = scope.scoped_output(raw.join(ranges, "path", "left"))
    return out.drop("output", "ranges").withColumnRenamed("kept", "output")


def head_ranges(ranges: DataFrame, hunks: DataFrame) -> DataFrame:
    """(path, ranges) at the base revision: an empty array for a pure insertion."""
    each = ranges.select("path", F.explode("ranges").alias("r")).select("path", "r.start", "r.end").distinct()
    moved = scope.ranges_before(each, hunks, "path").groupBy("path").agg(F.collect_list(F.struct(F.col("old_start").cast("int").alias("start"), F.col("old_end").cast("int").alias("end"))).alias("ranges"))
    return ranges.select("path", F.col("ranges").isNotNull().alias("told")).join(moved, "path", "left").select("path", F.when(F.col("told"), F.coalesce("ranges", F.array().cast(RANGES))).alias("ranges"))


def file_results(files: DataFrame, config: dict, trigger: str, ranges: DataFrame | None = None, head: DataFrame | None = None, hunks: DataFrame | None = None, cwd: str | None = None) -> DataFrame:
    """Results of the checks per file. ranges (path, ranges): changed lines; null ranges: the whole file. head (path,
    source) and hunks (see scope.diff_hunks): the base revision. A file that isn't there has no base; changes that
    only insert have a base that passes, and the base is asked for blocking checks only, as it changes no other. cwd:
    where commands run; without it they don't."""
    per_file, _ = split_checks(config)
    severity = {c["name"]: c["severity"] for c in per_file}
    blocking = [c for c in per_file if severity[c["name"]] == "blocking"]
    out = settled(in_changes(native_results(files, per_file, trigger), ranges), _base(head, blocking, trigger, ranges, hunks) if head is not None and blocking else None)
    if cwd is None:
        return out
    run = shell_results(files, per_file, trigger, cwd, ranges)
    plain = in_changes(run.where("not sarif").drop("sarif"), ranges).select(*RESULT)
    return out.unionByName(plain).unionByName(run.where("sarif").select(*RESULT))


def _base(head: DataFrame, checks: list[dict], trigger: str, ranges: DataFrame | None, hunks: DataFrame | None) -> DataFrame:
    raw = native_results(head, checks, trigger)
    if ranges is None or hunks is None:
        return raw.select("path", "check_name", "passed")
    old = head_ranges(ranges, hunks)
    scoped = in_changes(raw, old).select("path", "check_name", "passed").join(old, "path", "left")
    inserted = F.coalesce(F.size("ranges") == 0, F.lit(False))
    return scoped.select("path", "check_name", (inserted | F.col("passed")).alias("passed"))


Graph = tuple[DataFrame, DataFrame, DataFrame]


def built_graph(files: DataFrame) -> Graph:
    """Nodes, edges and components of the import graph, written once: several searches read them."""
    nodes, edges = (graph._settled(files.sparkSession, x) for x in rules.import_graph(files.where("source is not null")))
    return nodes, edges, graph.strong_components(edges)


def architecture_results(files: DataFrame, config: dict, trigger: str, root: str, head: DataFrame | None = None, built: Graph | None = None) -> DataFrame:
    """Results of the architecture checks over the import graph of all files; root stands for their path. built: the
    graph of the files, if it is there already."""
    _, whole = split_checks(config)
    own = [c for c in whole if c.get("architecture_checker") and (not c.get("triggers") or trigger in c["triggers"])]
    spark = files.sparkSession
    layers = config.get("architecture", {}).get("layers", [])

    def judged(of: DataFrame, known: Graph | None = None) -> DataFrame:
        nodes, edges, components = known or built_graph(of)
        out = spark.createDataFrame([(c["name"],) for c in own], "check_name string")
        found = None
        for c in own:
            one = graph.architecture_findings(c["architecture_checker"], nodes, edges, layers, components).withColumn("check_name", F.lit(c["name"]))
            found = one if found is None else found.unionByName(one)
        line = F.concat_ws(": ", F.concat_ws(":", "file", F.col("line").cast("string")), "message")
        told = found.withColumn("told", F.when(F.col("file").isNull(), F.col("message")).otherwise(line))
        told = told.groupBy("check_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "line", "told"))), lambda x: x["told"]), "\n").alias("output"))
        return out.join(told, "check_name", "left").select(F.lit(root).alias("path"), "check_name", F.col("output").isNull().alias("passed"), F.coalesce("output", F.lit("")).alias("output"))

    if not own:
        return spark.createDataFrame([], "path string, check_name string, severity string, passed boolean, output string, message string, command string")
    now = judged(files, built).select("*", _of(own, "severity").alias("severity"), _of(own, "message").alias("message"), F.concat(F.lit("plumbline check architecture "), _of(own, "architecture_checker")).alias("command"))
    return settled(now, None if head is None else judged(head).select("path", "check_name", "passed"))


def run(files: DataFrame, config: dict, trigger: str = "batch", root: str = ".", head: DataFrame | None = None, cwd: str | None = None) -> DataFrame:
    """All results of a run: whole-tree checks once, the others per file."""
    out = architecture_results(files, config, trigger, root, head).unionByName(file_results(files, config, trigger, head=head, cwd=cwd))
    whole = [c for c in split_checks(config)[1] if c.get("command")]
    if cwd is not None and whole:
        once = files.sparkSession.createDataFrame([(root,)], "path string")
        out = out.unionByName(shell_results(once, [{**c, "scope": []} for c in whole], trigger, cwd).select(*RESULT))
    return out


def report(found: DataFrame) -> DataFrame:
    """(path, check_name, report): failures as lines, whole-tree checks and then files in order."""
    return results.console_lines(found).select("path", "check_name", "report").orderBy("path", "check_name")


def checks_text(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): failures, one after the other, or that there are none."""
    lines = results.console_lines(found.withColumn("report_path", F.lit("")), "report_path")
    told = lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("check_name", F.regexp_replace("report", r"\]  — ", "] ").alias("x")))), lambda r: r["x"]), "\n").alias("text"))
    return found.select(*keys).distinct().join(told, keys, "left").na.fill("all checks passed", ["text"])


def changed_ranges(source: Column, tool_input: Column) -> Column:
    """Lines that an edit has changed: those of every occurrence of its new texts in the file. Null, that is, the
    whole file, for one that was written anew, and where no new text is found; empty texts don't count."""
    needles = F.coalesce(F.transform(tool_input["edits"], lambda e: e["new_string"]), F.when(tool_input["new_string"].isNotNull(), F.array(tool_input["new_string"])))
    spans = F.flatten(F.transform(F.filter(needles, lambda n: n.isNotNull() & (n != "")), lambda n: occurrence_lines(source, n)))
    return F.when(tool_input["content"].isNull() & (F.size(spans) > 0), spans)


def hook_results(events: DataFrame, files: DataFrame, config: dict, trigger: str) -> DataFrame:
    """(tool_use_id, results) of edit events (see EVENT) over the files as they are now. Events without a file, and
    an event's second report, have none. Findings count where the event's edit has changed lines."""
    per_file, _ = split_checks(config)
    first = events.where(F.col("tool_input.file_path").isNotNull()).dropDuplicates(["tool_use_id"])
    at = first.select("tool_use_id", F.col("tool_input.file_path").alias("path"), "tool_input").join(files, "path")
    at = at.select("tool_use_id", "path", changed_ranges(F.col("source"), F.col("tool_input")).alias("ranges"))
    raw = native_results(files.join(at.select("path").distinct(), "path", "left_semi"), per_file, trigger)
    out = scope.scoped_output(raw.join(at, "path"))
    return out.drop("output", "ranges").withColumnRenamed("kept", "output").select("tool_use_id", *RESULT)


def hook_answers(events: DataFrame, files: DataFrame, config: dict, trigger: str) -> DataFrame:
    """(tool_use_id, exit_code, stderr, stdout): what each edit event is answered."""
    return results.hook_responses(hook_results(events, files, config, trigger), ["tool_use_id"], ADVISORY_NOTE)


def assessment(files: DataFrame, config: dict, globs: list[str] = (), diagram: bool = True) -> DataFrame:
    """(part, ord, text) of a report on a tree: counts, findings, recommendations, the import graph."""
    spark = files.sparkSession
    own = files.where(in_scope(F.col("path"), list(globs)))
    whole = [c for c in split_checks(config)[1] if c.get("architecture_checker")]
    built = built_graph(own) if whole or diagram else None
    arch = architecture_results(own, {**config, "checks": [{**c, "triggers": []} for c in whole]}, "batch", "", built=built)
    levels = {c.get("checker"): c.get("severity", "advisory") for c in reversed(config.get("checks", []))}
    syntax = [{"name": n, "checker": n, "severity": levels.get(n, "advisory")} for n in rules.CHECKERS if n.startswith("syntax-rules")]
    found = arch.unionByName(native_results(own, syntax, "batch").select(*RESULT)).where("not passed")
    lines = found.select("check_name", "path", F.posexplode(F.filter(F.split("output", "\n"), lambda x: x != "")).alias("k", "x"), "severity")
    order = F.when(F.col("check_name").isin(*[c["name"] for c in whole] or [""]), 0).otherwise(1)
    lines = lines.select(F.lit(1).alias("part"), F.struct(order.alias("kind"), "check_name", "path", "k").cast("string").alias("ord"), F.concat(F.lit("["), "severity", F.lit("] "), "x").alias("text"))
    n_files = own.count()
    head = lines.agg(F.count("*").alias("n")).select(F.lit(0).alias("part"), F.lit("").alias("ord"), F.concat(F.lit("architecture assessment: "), F.col("n").cast("string"), F.lit(f" finding(s) across {n_files} file(s)")).alias("text"))
    advice = found.select("check_name").distinct().withColumn("text", F.coalesce(*[F.when(F.col("check_name") == k, F.lit(f"- {v}")) for k, v in RECOMMENDATIONS.items()])).where("text is not null")
    out = head.unionByName(lines).unionByName(advice.select(F.lit(2).alias("part"), F.col("check_name").alias("ord"), "text"))
    if not diagram:
        return out.unionByName(spark.createDataFrame([(3, "", "(no diagram asked for)")], "part int, ord string, text string"))
    drawn = graph.diagram_lines(*built)
    return out.unionByName(drawn.select((F.col("part") + 3).alias("part"), F.lpad(F.col("ord").cast("string"), 9, "0").alias("ord"), "text"))


def listed_checks(config: dict, root: str) -> str:
    """The configured checks, as text."""
    names = [f"{c['name']} ({c.get('severity', 'advisory')}, scope={c.get('scope', [])})" for c in config.get("checks", [])]
    return "\n".join([f"config root: {root}", "checks:", *names])
