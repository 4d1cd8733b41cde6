"""Native checks: facts that scanners read from sources, and relational rules over them.

Sources are read once per file, in Arrow batches; every rule is then a filter, join or aggregate over small
fact tables. Findings have path, line, rule, message.
"""

from __future__ import annotations

import posixpath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import JS_EXTENSIONS, MAX_BODY_LINES, MAX_NESTING, MAX_PARAMETERS
from ..functions.text import directory, in_scope
from ..parse import go, markdown, scan
from . import blocks, graph, links

LANGUAGES = {"go": "go", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "java": "java", "kt": "kotlin", "kts": "kotlin"}
FINDING = ["path", "line", "rule", "message"]
#: Checkers by name: the paths that they look at, their language (None: any) and what they tell; fixed names and globs.
CHECKERS = {
    "primitive-obsession": (("**/*.go",), "go", "several parameters of one primitive type"),
    "markdown-link-integrity": (("**/*.md",), None, "references, anchors and files that links lead to"),
    "duplicate-code": (tuple(f"**/*.{e}" for e in ("go", "ts", "tsx", "js", "jsx", "py", "java", "kt")), None, "blocks of lines repeated within a file"),
    "go-blank-imports": (("**/*.go",), "go", "blank imports without a reason"),
    "go-ignored-error": (("**/*.go",), "go", "errors assigned to _"),
    "go-error-context": (("**/*.go",), "go", "errors passed on without context"),
    "syntax-rules": (("**/*.go",), "go", "long functions, deep nesting, long parameter lists"),
    "syntax-rules-typescript": (("**/*.ts",), "typescript", "long functions, deep nesting, long parameter lists"),
    "syntax-rules-tsx": (("**/*.tsx",), "tsx", "long functions, deep nesting, long parameter lists"),
    "syntax-rules-javascript": (("**/*.js", "**/*.jsx", "**/*.mjs", "**/*.cjs"), "javascript", "long functions, deep nesting, long parameter lists"),
    "syntax-rules-python": (("**/*.py",), "python", "long functions, deep nesting, long parameter lists"),
    "syntax-rules-java": (("**/*.java",), "java", "long functions, deep nesting, long parameter lists"),
    "syntax-rules-kotlin": (("**/*.kt", "**/*.kts"), "kotlin", "long functions, deep nesting, long parameter lists"),
}
ARCHITECTURE_CHECKERS = ("import-cycles", "layering", "coupling")


def checkers(spark) -> DataFrame:
    """(name, language, globs, description) of all checkers."""
    return spark.createDataFrame([(n, language, list(globs), told) for n, (globs, language, told) in CHECKERS.items()], "name string, language string, globs array<string>, description string")


def findings_of(files: DataFrame, names: list[str]) -> DataFrame:
    """(checker, path, line, message) of the named checkers, each over the files that its globs take in. A name that
    is no checker is an error. Languages are scanned together, in one pass per family of rules."""
    if unknown := sorted(set(names) - CHECKERS.keys()):
        raise ValueError(f"unknown checkers: {', '.join(unknown)}")
    parts = []
    syntax = [n for n in names if n.startswith("syntax-rules")]
    go_rules = [n for n in names if CHECKERS[n][1] == "go" and n != "syntax-rules"]
    told = lambda df, name: df.select(name.alias("checker"), "path", F.col("line").cast("int").alias("line"), "message")
    if syntax:
        named = F.coalesce(*[F.when(in_scope(F.col("path"), CHECKERS[n][0]), F.lit(n)) for n in syntax])
        parts.append(told(syntax_findings(files.where(named.isNotNull())), named))
    if go_rules:
        parts.append(told(go_findings(files, go_rules), F.col("rule")))
    if "duplicate-code" in names:
        parts.append(told(duplicate_findings(files), F.lit("duplicate-code")))
    if "markdown-link-integrity" in names:
        parts.append(told(markdown_findings(files), F.lit("markdown-link-integrity")))
    if not parts:
        return files.select(F.lit("").alias("checker"), "path", F.lit(0).alias("line"), F.lit("").alias("message")).where("false")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def extension(path: str = "path"):
    return F.element_at(F.split(path, r"\."), -1)


def _facts(files: DataFrame, read, schema: str) -> DataFrame:
    """What read finds in each source, with the file's path, and its repository where files tell it."""
    of = [c for c in ("repo", "path") if c in files.columns]
    kinds = {"string": pa.string(), "int": pa.int32()}
    names, types = zip(*[(n, kinds[t]) for n, t in (x.split() for x in [*(f"{c} string" for c in of), *schema.split(", ")])])

    def work(batches):
        for batch in batches:
            told = [c.to_pylist() for c in batch.columns]
            rows = [(*of_row, *fact) for *of_row, source in zip(*told) if source is not None for fact in read(of_row[-1] or "", source)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=list(names))

    return files.select(*of, "source").mapInArrow(work, ", ".join([*(f"{c} string" for c in of), schema]))


def syntax_facts(files: DataFrame) -> DataFrame:
    """(path, line, body_lines, depth, parameters) of every function."""

    def read(path, source):
        language = LANGUAGES.get(path.rsplit(".", 1)[-1])
        return [(f.row, f.body_lines, f.depth, f.parameters) for f in scan.functions(language, source)] if language else []

    return _facts(files.where(extension().isin(*LANGUAGES)), read, "line int, body_lines int, depth int, parameters int")


def syntax_findings(files: DataFrame) -> DataFrame:
    """Functions whose body, nesting or parameter list is over its limit; one row per limit."""
    limits = (("long-function", "body_lines", MAX_BODY_LINES), ("deep-nesting", "depth", MAX_NESTING), ("long-parameter-list", "parameters", MAX_PARAMETERS))
    over = [F.when(F.col(c) > n, F.struct(F.lit(rule).alias("rule"), F.concat(F.lit(f"[{rule}] {c} "), F.col(c).cast("string"), F.lit(f", limit {n}")).alias("message"))) for rule, c, n in limits]
    return syntax_facts(files).withColumn("o", F.explode(F.filter(F.array(*over), lambda x: x.isNotNull()))).select("path", "line", "o.rule", "o.message")


def go_facts(files: DataFrame, kinds: tuple[str, ...] = ("parameters", "ignored", "import", "open", "bare")) -> DataFrame:
    """(path, kind, line, text, n): repeated parameter types, ignored errors, imports, blank imports without a comment
    (open), bare errors; of these the kinds asked for. One pass over the sources."""

    def read(path, source):
        ts, out = scan.tokens(source), []
        if "parameters" in kinds:
            out += [("parameters", r, kind, n) for r, n, kind in go.same_typed_parameters(ts)]
        if "ignored" in kinds:
            out += [("ignored", r, "", 0) for r in go.ignored_errors(ts)]
        if "import" in kinds or "open" in kinds:
            found, comments = go.imports(ts)
            if "import" in kinds:
                out += [("import", r, target, 0) for r, _, target in found]
            if "open" in kinds:
                # a comment justifies the import on its row, or on the next row if it shares its own with no import
                rows = {r for r, _, _ in found}
                near = set(comments) | {r + 1 for r in comments if r not in rows}
                out += [("open", r, target, 0) for r, alias, target in found if alias == "_" and r not in near]
        return out + [("bare", r, "", 0) for r in go.bare_errors(ts)] if "bare" in kinds else out

    return _facts(files.where(extension() == "go"), read, "kind string, line int, text string, n int")


def go_findings(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Findings of the Go rules, or of those named; a row of facts is a finding."""
    told = {
        "parameters": ("primitive-obsession", F.concat(F.col("n").cast("string"), F.lit(" parameters in a row of type "), "text")),
        "ignored": ("go-ignored-error", F.lit("the last result, an error by convention, is ignored")),
        "bare": ("go-error-context", F.lit("the error is passed on without context")),
        "open": ("go-blank-imports", F.concat(F.lit("blank import without a reason: "), "text")),
    }
    told = {kind: x for kind, x in told.items() if names is None or x[0] in names}
    of = lambda k: F.coalesce(*[F.when(F.col("kind") == kind, x[k] if k else F.lit(x[k])) for kind, x in told.items()])
    return go_facts(files, tuple(told)).select("path", "line", of(0).alias("rule"), of(1).alias("message"))


def duplicate_findings(files: DataFrame) -> DataFrame:
    found = blocks.duplicate_blocks(files.where(in_scope(F.col("path"), CHECKERS["duplicate-code"][0])), "path", "source")
    return found.select("path", F.col("line").cast("int").alias("line"), F.lit("duplicate-code").alias("rule"), F.concat(F.lit("block of lines repeated "), F.col("repeats").cast("string"), F.lit(" times, at lines "), "lines").alias("message"))


def markdown_facts(files: DataFrame) -> DataFrame:
    """(path, kind, line, label, text, target, image): definitions, uses of references, inline links, headings."""

    def read(path, source):
        found = markdown.parse(source)
        out = [("definition", r, label, "", target or "", 0) for r, label, target in found["definitions"]]
        out += [("use" if target is None else "inline", r, label or "", written, target or "", int(image)) for r, label, written, image, target in found["uses"]]
        return out + [("heading", r, "", text, "", 0) for r, text in found["headings"]]

    return _facts(files.where(extension() == "md"), read, "kind string, line int, label string, text string, target string, image int")


def markdown_findings(files: DataFrame) -> DataFrame:
    """Undefined and unused references, and links to anchors or files that aren't there. Facts, a few short rows per
    document, are written to the checkpoint folder once, as each kind of finding reads them."""
    facts = graph._settled(files.sparkSession, markdown_facts(files))
    of = lambda kind: facts.where(F.col("kind") == kind)
    told = lambda df, *message: df.select("path", "line", F.lit("markdown-link-integrity").alias("rule"), F.concat(*message).alias("message"))
    defs, uses = of("definition"), of("use").withColumn("image", F.col("image") == 1)
    anchors = links.heading_anchors(of("heading").withColumnRenamed("text", "heading"), order="line").select("path", "anchor")
    inline = of("inline").where(F.startswith("target", F.lit("#"))).withColumn("fragment", F.expr("substring(target, 2)"))
    own = defs.where(F.startswith("target", F.lit("#"))).withColumn("fragment", F.expr("substring(target, 2)"))
    other = defs.where(~F.startswith("target", F.lit("#")) & ~F.col("target").rlike("^https?://"))
    cut = other.withColumn("fragment", F.when(F.instr("target", "#") > 0, F.regexp_replace("target", r"\A[^#]*#", "")).otherwise(F.lit(""))).withColumn("file", F.split_part("target", F.lit("#"), F.lit(1)))
    cut = cut.where("file <> ''").withColumn("written", F.col("target")).withColumn("target", normalised(F.concat_ws("/", F.when(directory(F.col("path")) != ".", directory(F.col("path"))), "file")))
    crossed = links.cross_file_links(cut.select("path", "line", "label", "written", "target", "fragment"), files.where("source is not null"), anchors)
    parts = [
        told(links.dangling_uses(uses, defs), F.lit("undefined reference: "), "text"),
        told(links.unused_definitions(defs, uses), F.lit("unused definition: "), "label"),
        told(links.dead_anchors(inline, anchors), F.lit("no such heading: #"), "fragment"),
        told(links.dead_anchors(own, anchors), F.lit("definition "), "label", F.lit(" leads to no heading: #"), "fragment"),
        told(crossed.where("outcome <> 'ok'"), F.lit("definition "), "label", F.lit(": "), "outcome", F.lit(": "), "written"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def normalised(path):
    """Without . and with .. resolved."""

    def step(a, part):
        up = (part == "..") & (F.size(a) > 0) & F.coalesce(F.element_at(a, -1) != "..", F.lit(False))
        return F.when(part.isin("", "."), a).when(up, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step), "/")


def import_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (node), edges (src, dst, file, line)) of Go packages and JS/TS directories. Without go.mod there is no
    Go part; imports from outside the files are left out. Where files have a column repo, so have nodes and edges, and
    each repository has its own graph; of its modules the outermost counts."""
    of = ["repo"] if "repo" in files.columns else []
    files = files if of else files.withColumn("repo", F.lit(""))
    mods = files.where("path = 'go.mod' or path like '%/go.mod'").select("repo", F.regexp_replace("path", r"/?go\.mod\z", "").alias("root"), F.regexp_extract("source", r"(?m)^\s*module\s+(\S+)", 1).alias("module")).where("module <> ''")
    outer = F.struct(F.length("root"), F.col("root"))
    first = mods.groupBy("repo").agg(F.min_by("module", outer).alias("module"), F.min(outer)["root"].alias("root"))
    sources = files.where(extension() == "go").select("repo", "path").join(first, "repo")
    inner = F.when(F.col("root") == "", directory(F.col("path"))).otherwise(F.expr("substring(regexp_replace(path, '/[^/]*$', ''), length(root) + 2)"))
    packages = sources.select("repo", "path", F.concat_ws("/", "module", F.when(~inner.isin(".", ""), inner)).alias("node"))
    found = go_facts(files, ("import",)).join(packages, ["repo", "path"])
    nodes = packages.select("repo", "node").distinct()
    go_edges = found.join(nodes.withColumnsRenamed({"node": "text"}), ["repo", "text"]).where("node <> text").select("repo", F.col("node").alias("src"), F.col("text").alias("dst"), F.col("path").alias("file"), "line")

    js = files.where(extension().isin(*JS_EXTENSIONS))

    def read(path, source):
        ts, out = scan.tokens(source), []
        for k, t in enumerate(ts):
            if t.kind == "string" and k and (ts[k - 1].text == "from" or ts[k - 1].text == "import") and t.text[1:3] in ("./", ".."):
                target = posixpath.normpath(posixpath.join(posixpath.dirname(path), t.text[1:-1]))
                stem = posixpath.splitext(target)[0] if "." in posixpath.basename(target) else target
                tries = [target, *[f"{stem}.{e}" for e in JS_EXTENSIONS], *[f"{target}/index.{e}" for e in JS_EXTENSIONS]]
                begin = k  # an import is where its statement begins
                while begin and ts[begin].text not in ("import", "export") and ts[begin - 1].text != ";":
                    begin -= 1
                out += [(ts[begin].row, k, n, x) for n, x in enumerate(tries)]
        return out

    tries = _facts(js, read, "line int, position int, rank int, target string")
    there = js.select("repo", F.col("path").alias("target")).distinct()
    hits = tries.join(there, ["repo", "target"]).groupBy("repo", "path", "line", "position").agg(F.min_by("target", "rank").alias("target"))
    js_edges = hits.select("repo", directory(F.col("path")).alias("src"), directory(F.col("target")).alias("dst"), F.col("path").alias("file"), "line").where("src <> dst")
    all_nodes = nodes.unionByName(js.select("repo", directory(F.col("path")).alias("node")).distinct()).distinct()
    return all_nodes.select(*of, "node"), go_edges.unionByName(js_edges).select(*of, "src", "dst", "file", "line")


def all_findings(files: DataFrame) -> DataFrame:
    return syntax_findings(files).unionByName(go_findings(files)).unionByName(duplicate_findings(files)).unionByName(markdown_findings(files))
