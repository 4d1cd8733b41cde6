"""Command line: python -m plumbline run|assess|checks|hook|native|list|backtest."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import replay, results, rules, run
from .sources import files as sources


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, told in (("run", "check all files below a folder"), ("assess", "report on the architecture of a tree"), ("checks", "list the configured checks")):
        one = commands.add_parser(name, help=told)
        one.add_argument("dir", nargs="?", default=".")
        if name == "run":
            one.add_argument("--trigger", default="batch")
            one.add_argument("--allow-commands", action="store_true", help="run the shell commands of the configuration, too")
        if name == "assess":
            one.add_argument("--scope", action="append", default=[])
            one.add_argument("--no-diagram", action="store_true")
    commands.add_parser("hook", help="answer one edit event from standard input")
    native = commands.add_parser("native", help="run one checker on one file")
    native.add_argument("name", choices=[*rules.CHECKERS])
    native.add_argument("file")
    commands.add_parser("list", help="list the checkers")
    back = commands.add_parser("backtest", help="run a checker over the edits of session logs")
    back.add_argument("name", choices=[*rules.CHECKERS, "all"])
    back.add_argument("--transcripts-dir", required=True)
    back.add_argument("--only-new", action="store_true")
    return parser


def _one_file(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        return spark.createDataFrame([(path, f.read())], "path string, source string")


def _blocking(found: DataFrame) -> bool:
    return not found.where("not passed and severity = 'blocking'").isEmpty()


def main(argv: list[str] | None = None, spark: SparkSession | None = None, stdin=sys.stdin, out=sys.stdout, err=sys.stderr) -> int:
    """The exit code; everything else goes to out and err."""
    told = _arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
    show = lambda df, c: [print(r[c], file=out) for r in df.toLocalIterator()]
    if told.command in ("run", "assess", "checks"):
        if (found := sources.find_config(told.dir)) is None:
            print(f"no {sources.CONFIG_NAME} above {told.dir}", file=err)
            return 0
        config, root = found
        if told.command == "checks":
            print(run.listed_checks(config, root), file=out)
            return 0
        if errors := sources.config_errors(config, set(rules.CHECKERS), set(rules.ARCHITECTURE_CHECKERS)):
            print("\n".join(errors), file=err)
            return 2
        tree = sources.source_files(spark, root).select("path", "source")
        if told.command == "assess":
            show(run.assessment(tree, config, told.scope, not told.no_diagram).orderBy("part", "ord"), "text")
            return 0
        head = sources.head_files(spark, root)
        done = run.run(tree, config, told.trigger, root, head=head, cwd=root if told.allow_commands else None).cache()
        show(run.report(done), "report")
        code = int(_blocking(done))
        done.unpersist()
        return code
    if told.command == "hook":
        event = json.load(stdin)
        path = (event.get("tool_input") or {}).get("file_path")
        if not path or (found := sources.find_config(event["cwd"])) is None:
            return 0
        events = spark.read.schema(run.EVENT).json(spark.sparkContext.parallelize([json.dumps(event)]))
        answers = run.hook_answers(events.na.fill("-", ["tool_use_id"]), _one_file(spark, path), found[0], event.get("hook_event_name", "")).collect()
        for a in answers:
            print(a.stderr, file=err) if a.stderr else print(a.stdout, file=out) if a.stdout else None
        return max((a.exit_code for a in answers), default=0)
    if told.command == "list":
        for name, (globs, language, about) in rules.CHECKERS.items():
            print(f"{name}: {about} (language: {language or 'any'}, globs: {', '.join(globs)})", file=out)
        return 0
    if told.command == "native":
        found = results.joined_output(rules.findings_of(_one_file(spark, told.file), [told.name]), ["checker"]).collect()
        for r in found:
            print(r.output, file=out)
        return int(bool(found))
    names = [*rules.CHECKERS] if told.name == "all" else [told.name]
    snaps = replay.snapshots(sources.transcripts(spark, told.transcripts_dir)).cache()
    tested = replay.backtest(snaps, lambda f: rules.findings_of(f, names).withColumnRenamed("checker", "rule"), told.only_new).cache()
    counts = replay.backtest_counts(snaps, {n: rules.CHECKERS[n][0] for n in names}).first()
    print(f"scanned {counts.transcripts} transcript(s), checked {counts.snapshots} snapshot(s), {counts.lost} edit(s) that can't be followed", file=out)
    show(replay.backtest_lines(tested).orderBy("transcript", "seq", "line"), "text")
    return int(not tested.where("not pre_existing").isEmpty())


if __name__ == "__main__":
    sys.exit(main())
