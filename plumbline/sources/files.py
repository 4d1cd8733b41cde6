"""Sources: directory trees, edit logs, configurations, revisions and diffs of repositories."""

from __future__ import annotations

import json
import posixpath
import subprocess
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SKIPPED_DIRECTORIES

CONFIG_NAME = ".checks.json"


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(path below root, source, modified, length) of every file of a tree, without skipped directories; source is
    null where the bytes aren't UTF-8."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace("path", r"\A.*?" + "/" + "".join("\\" + c if not c.isalnum() else c for c in base) + "/", "")
    out = raw.withColumn("path", rel).where(~F.exists(F.split("path", "/"), lambda p: p.isin(*SKIPPED_DIRECTORIES)))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return out.select("path", text.alias("source"), F.col("modificationTime").alias("modified"), "length")


def transcripts(spark: SparkSession, root: str) -> DataFrame:
    """(transcript, line_no, raw): lines of *.jsonl in a folder and one level below; blank lines are left out."""
    text = None
    for pattern in ("*.jsonl", "*/*.jsonl"):  # Spark lists the folder, wherever it is
        try:
            one = spark.read.text(f"{root.rstrip('/')}/{pattern}", wholetext=True)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        one = one.select(F.input_file_name().alias("transcript"), "value")
        text = one if text is None else text.unionByName(one)
    if text is None:
        return spark.createDataFrame([], "transcript string, line_no long, raw string")
    text = text.select("transcript", F.posexplode(F.split("value", "\n")).alias("line_no", "raw"))
    return text.select("transcript", F.col("line_no").cast("long").alias("line_no"), "raw").where(F.trim("raw") != "")


def find_config(start: str) -> tuple[dict, str] | None:
    """The nearest configuration at or above a path, and the folder that holds it."""
    at = Path(start).resolve()
    for folder in [at, *at.parents]:
        if (folder / CONFIG_NAME).is_file():
            return json.loads((folder / CONFIG_NAME).read_text()), str(folder)
    return None


def check_kind(check: dict) -> str:
    """What a check runs: a command or a native rule, per file or over the whole repository."""
    command = bool(check.get("command"))
    if check.get("architecture_checker"):
        return "whole-repo native"
    if not command:
        return "per-file native"
    return "per-file command" if "{file}" in check["command"] else "whole-repo command"


def config_errors(config: dict, checkers: set[str], architecture: set[str]) -> list[str]:
    out = []
    for c in config.get("checks", []):
        name = c.get("name", "?")
        modes = [k for k in ("command", "checker", "architecture_checker") if c.get(k)]
        if len(modes) > 1:
            out.append(f"{name}: more than one of {', '.join(modes)}")
        if not modes:
            out.append(f"{name}: neither command nor checker")
        if c.get("checker") and c["checker"] not in checkers:
            out.append(f"{name}: unknown checker {c['checker']}")
        if c.get("architecture_checker"):
            if c["architecture_checker"] not in architecture:
                out.append(f"{name}: unknown architecture checker {c['architecture_checker']}")
            if any(t != "batch" for t in c.get("triggers", [])):
                out.append(f"{name}: architecture checks run on batch only")
        if c.get("output_format") and not c.get("command"):
            out.append(f"{name}: output_format needs a command")
    return out


def head_files(spark: SparkSession, repo: str) -> DataFrame:
    """(path, source) of all files at HEAD, read by one process per batch of paths; empty without a HEAD."""
    listed = subprocess.run(["git", "-C", repo, "ls-tree", "-r", "-z", "--name-only", "HEAD"], capture_output=True)
    paths = [p for p in listed.stdout.decode().split("\0") if p] if listed.returncode == 0 else []
    if not paths:
        return spark.createDataFrame([], "path string, source string")

    def work(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            asked = "".join(f"HEAD:{n}\n" for n in names if "\n" not in n).encode()
            told, at, shown = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input=asked, capture_output=True).stdout, 0, []
            for n in names:  # of each a line that ends with its size, its bytes, a line end
                if "\n" in n:
                    shown.append(subprocess.run(["git", "-C", repo, "show", f"HEAD:{n}"], capture_output=True).stdout)
                    continue
                end = told.index(b"\n", at)
                head = told[at:end].split()
                size = int(head[-1]) if head[-1].isdigit() else None
                shown.append(told[end + 1 : end + 1 + size] if size is not None and head[-2] == b"blob" else None)
                at = end + 1 + (0 if size is None else size + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if s is None else s.decode("utf-8", "replace") for s in shown], pa.string())], names=["path", "source"])

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInArrow(work, "path string, source string")


def diffs(spark: SparkSession, repo: str) -> DataFrame:
    """(path, diff) of files changed since HEAD, without context lines."""
    names = subprocess.run(["git", "-C", repo, "diff", "--name-only", "-z", "HEAD"], capture_output=True).stdout.decode()
    rows = [(posixpath.normpath(n), subprocess.run(["git", "-C", repo, "diff", "-U0", "HEAD", "--", n], capture_output=True).stdout.decode("utf-8", "replace")) for n in names.split("\0") if n]
    return spark.createDataFrame(rows, "path string, diff string")


def command_results(commands: DataFrame, allow: bool = False) -> DataFrame:
    """(check_name, path, command, cwd) run by a shell -> output (with what went to stderr), stdout, passed. Off unless
    allowed: commands are code."""
    if not allow:
        raise PermissionError("commands run only with allow=True")

    def work(batches):
        for batch in batches:
            rows = batch.to_pylist()
            done = [subprocess.run(["sh", "-c", r["command"]], cwd=r["cwd"], capture_output=True) for r in rows]
            out = [(d.stdout + d.stderr).decode("utf-8", "replace") for d in done]
            alone = [d.stdout.decode("utf-8", "replace") for d in done]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(out, pa.string()), pa.array(alone, pa.string()), pa.array([d.returncode == 0 for d in done])], names=["check_name", "path", "command", "output", "stdout", "passed"])

    return commands.select("check_name", "path", "command", "cwd").mapInArrow(work, "check_name string, path string, command string, output string, stdout string, passed boolean")
