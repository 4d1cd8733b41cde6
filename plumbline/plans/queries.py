"""Queries over the driver's tables: each applies operators to an analogue of their input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import described, edited, in_scope, occurrence_lines
from ..operators import blocks, graph, links, results, scope, state

CHECKS = [
    {"name": "prose", "scope": ["src1/**/*.md", "src2/*/*.md"], "triggers": ["edit"]},
    {"name": "english", "scope": ["**/en/*.md"], "triggers": ["edit", "batch"]},
    {"name": "every", "scope": [], "triggers": []},
    {"name": "nightly", "scope": ["**"], "triggers": ["batch"]},
    {"name": "teens", "scope": ["src1?/*/*5.md"], "triggers": ["edit"]},
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dup_block_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.duplicate_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")


def dup_block_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.repeated_windows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.col("starts")[0].cast("long").alias("first_start"), F.size("starts").cast("long").alias("n"))


def line_explode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = blocks.numbered_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return ls.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"), F.max("line").cast("long").alias("last_line"), F.sum((F.col("text") == "").cast("long")).alias("n_empty"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))


def scope_glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paths(spark, sf_dir)
    return p.select("doc_id", *[in_scope(F.col("path"), c["scope"]).alias(c["name"]) for c in CHECKS])


def trigger_scope_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paths(spark, sf_dir)
    both = scope.selected_checks(p, CHECKS, "edit").withColumn("trigger", F.lit("edit")).unionByName(scope.selected_checks(p, CHECKS, "batch").withColumn("trigger", F.lit("batch")))
    return both.groupBy("trigger", "check_name").agg(F.count("*").alias("files"))


def _long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = blocks.numbered_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return ls.where(F.octet_length("text") >= 200).select("doc_id", F.col("line").cast("long").alias("line"))


def findings_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality = 1")
    ranges = labels.select("doc_id", (F.col("doc_id") % 7 + 1).alias("start"), (F.col("doc_id") % 7 + 4).alias("end"))
    return scope.findings_in_ranges(_long_lines(spark, sf_dir), ranges, "doc_id")


#: Words of a needle that an index holds: those after its first, which may stand inside a longer word.
INDEXED_WORDS = 4


def needle_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of benchmark passages in documents. An index of some words of each passage finds the documents that may
    hold it; passages too short for it are looked for in all."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    words = lambda c: F.split(c, r"\s+", -1)
    indexed = items.withColumn("w", words(F.col("needle"))).withColumn("long", F.size("w") >= INDEXED_WORDS + 2)
    keys = indexed.where("long").select("item_id", F.xxhash64(F.slice("w", 2, INDEXED_WORDS)).alias("k"))
    runs = docs.select("doc_id", words(F.col("text")).alias("w")).where(F.size("w") >= INDEXED_WORDS)
    runs = runs.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - INDEXED_WORDS + 1), lambda k: F.xxhash64(F.slice("w", k, INDEXED_WORDS))))).alias("k"))
    maybe = runs.join(keys, "k").select("doc_id", "item_id").distinct()
    pairs = maybe.join(docs, "doc_id").join(items, "item_id").select("doc_id", "item_id", "text", "needle")
    short = indexed.where("not long").select("item_id", "needle")
    pairs = pairs.unionByName(docs.join(short, F.contains("text", "needle")).select("doc_id", "item_id", "text", "needle"))
    spans = pairs.select("doc_id", "item_id", F.explode(occurrence_lines(F.col("text"), F.col("needle"))).alias("s"))
    return spans.select("doc_id", "item_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def first_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    after = edited(F.col("text"), F.lit("the"), F.lit("[the]"))
    return docs.select("doc_id", F.md5(after).alias("after_md5"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items numbered within their order (l_linenumber has ties)."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return table(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(by))


def hunk_range_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _items(spark, sf_dir)
    h = li.select("l_orderkey", "ord", (F.col("ord") * 20 + F.col("l_quantity").cast("int") % 10).alias("new_start"), (F.col("l_quantity").cast("int") % 4).alias("old_count"), (F.col("l_partkey") % 5).cast("int").alias("new_count"))
    h = h.withColumn("old_start", F.col("new_start") - F.col("ord"))
    r = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().select("l_orderkey", (F.col("l_orderkey") % 90 + 10).alias("start"), (F.col("l_orderkey") % 90 + 14).alias("end"))
    return scope.ranges_before(r, h, "l_orderkey")


def grace_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("passed"), F.when(F.col("event_id") % 11 == 0, "advisory").otherwise("blocking").alias("severity"), F.when(F.col("event_id") % 5 == 0, "batch").otherwise("edit").alias("trigger"))
    return state.graced(e, ["user_id"], ["ts", "event_id"]).select("event_id", "severity")


def dedup_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("key", F.concat_ws("-", "event_type", (F.col("user_id") % 3).cast("string")))
    return state.claims(e, "key", "ts", "event_id").where("claimed").select("event_id", "key")


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    asked = d.select("doc_id", F.lit("edit").alias("trigger"), "n_chars", (F.col("doc_id") % 5).alias("stamp"))
    cached = d.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "batch").otherwise("edit").alias("trigger"), "n_chars", F.when(F.col("doc_id") % 7 == 0, 9).otherwise(F.col("doc_id") % 5).cast("long").alias("stamp"))
    return state.cache_lookup(asked, cached, "doc_id", ["n_chars", "stamp"]).groupBy("hit").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def baseline_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    judged = c.select("conv_id", "turn", (F.length("text") < 400).alias("passed"), F.lit("blocking").alias("severity"))
    head = judged.select("conv_id", (F.col("turn") + 1).alias("turn"), "passed")
    return state.with_baseline(judged, head, ["conv_id", "turn"]).select("conv_id", "turn", "passed", "base_passed", "severity")


def backtest_pre_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    words = c.select("conv_id", "turn", F.explode(F.array_distinct(F.split("text", "[ \n]+"))).alias("message")).where(F.length("message") >= 9)
    before = words.select("conv_id", (F.col("turn") + 2).alias("turn"), "message")
    out = state.pre_existing(words, before, ["conv_id", "turn"])
    return out.groupBy("conv_id", "turn").agg(F.count("*").alias("findings"), F.sum(F.col("pre_existing").cast("long")).alias("pre_existing"))


def _sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "note")
    place = F.struct(F.struct(F.struct(F.concat(F.lit("f"), (F.col("event_id") % 9).cast("string"), F.lit(".go")).alias("uri")).alias("artifactLocation"), F.struct(F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 50).alias("startLine")).alias("region")).alias("physicalLocation"))
    one = F.struct(level.alias("level"), F.when(F.col("event_id") % 3 == 0, F.lit("R1")).alias("ruleId"), F.struct(F.col("event_type").alias("text")).alias("message"), F.array(place).alias("locations"))
    got = e.select("user_id", "event_id", one.alias("r")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "r"))).alias("rs"))
    return got.select("user_id", F.to_json(F.struct(F.array(F.struct(F.transform("rs", lambda x: x["r"]).alias("results"))).alias("runs"))).alias("log"))


def sarif_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.sarif_counts(results.sarif_results(_sarif(spark, sf_dir), ["user_id"]), ["user_id"])


def sarif_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.sarif_report(_sarif(spark, sf_dir), ["user_id"])


def _nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier's nation to customer's nation, with the number of line items: nations are joined to narrow rows
    first, so the counts that are shuffled are those of pairs of nations."""
    li, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    s, c = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src")), table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    into = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "dst")
    out_of = li.join(s, li.l_suppkey == s.s_suppkey).select("l_orderkey", "src")
    return out_of.join(into, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_edges(spark, sf_dir).where("src <> dst")


def _strong_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with more line items than the median edge: the same share of them at every size."""
    e = import_edges(spark, sf_dir)
    middle = e.agg(F.median("n").alias("middle"))
    return e.join(F.broadcast(middle), F.col("n") > F.col("middle")).select("src", "dst", "n")


def graph_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(_strong_edges(spark, sf_dir))


def graph_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(_strong_edges(spark, sf_dir))


def _region_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("path"))


def layering_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, e = _region_paths(spark, sf_dir), _strong_edges(spark, sf_dir)
    named = e.join(p.withColumnsRenamed({"n_nationkey": "src", "path": "src_path"}), "src").join(p.withColumnsRenamed({"n_nationkey": "dst", "path": "dst_path"}), "dst")
    found = graph.layering_violations(named.select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst")), ["ASIA", "AMERICA", "EUROPE"])
    return found.select("src", "dst", F.col("from_layer").cast("long").alias("from_layer"), F.col("to_layer").cast("long").alias("to_layer"))


def _coupling(spark: SparkSession, sf_dir: str, distinct: bool) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    e = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("src"), (F.col("o_orderkey") % 25).cast("int").alias("dst"))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return graph.coupling(nodes, e, distinct)


def coupling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coupling(spark, sf_dir, False)


def coupling_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coupling(spark, sf_dir, True)


def mermaid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, e = _region_paths(spark, sf_dir), _strong_edges(spark, sf_dir)
    named = e.join(p.withColumnsRenamed({"n_nationkey": "src", "path": "a"}), "src").join(p.withColumnsRenamed({"n_nationkey": "dst", "path": "b"}), "dst")
    named = named.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    out = graph.diagram_lines(p.select(F.col("path").alias("node")), named)
    return out.select(F.col("part").cast("long").alias("part"), "ord", "text")


def heading_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    t = table(spark, sf_dir, "pages").select(F.lit("pages").alias("path"), title.alias("heading"), F.col("page_id").alias("ord"))
    t = t.unionByName(table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_name").alias("heading"), F.col("p_partkey").alias("ord")))
    return links.heading_anchors(t).select("path", "ord", "anchor")


def _hrefs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "pages")
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)))
    used = pages.select("page_id", F.explode(hrefs).alias("label")).select(F.lit("site").alias("path"), "page_id", F.lower("label").alias("label"))
    words = pages.select(F.lit("site").alias("path"), "page_id", F.lower(F.regexp_extract("html", "<title>([^ <]*)", 1)).alias("label"))
    return used, words.where("label <> ''")


def unused_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, defined = _hrefs(spark, sf_dir)
    return links.unused_definitions(defined, used).select("page_id", "label")


def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    used, defined = _hrefs(spark, sf_dir)
    return links.dangling_uses(used, defined).groupBy("label").agg(F.count("*").alias("n"))


def type_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _items(spark, sf_dir)
    out = links.runs(li.select("l_orderkey", "ord", "l_returnflag"), ["l_orderkey"], "ord", "l_returnflag")
    return out.select("l_orderkey", "l_returnflag", F.col("start").cast("long").alias("start"), "length")


def adjacency_unjustified(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.expr("event_id div 3").alias("row"), "event_type")
    marked, notes = (e.where(F.col("event_type") == k).select("path", "row").distinct() for k in ("error", "view"))
    return links.unjustified(marked, notes)


def describe_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    message = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("see "), F.col("source")))
    told = described(message, F.col("text"), F.concat(F.lit("check "), F.col("doc_id").cast("string")))
    return d.select("doc_id", F.md5(told).alias("told_md5"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("check_name"), (F.col("value") < 20).alias("passed"), F.when(F.col("event_type") == "error", "blocking").otherwise("advisory").alias("severity"), F.col("props").alias("output"), F.when(F.col("event_id") % 2 == 0, "slow").alias("message"), F.lit("run").alias("command"))


def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.console_lines(_results(spark, sf_dir)).select("event_id", "report")


def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.exit_codes(_results(spark, sf_dir), ["path"])


def assessment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dup = dup_block_findings(spark, sf_dir).select(F.col("doc_id").alias("path"), "line")
    long_ = _long_lines(spark, sf_dir).select(F.col("doc_id").alias("path"), "line")
    return results.rollup({"duplicate-code": dup, "long-line": long_})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        dup_block_findings, dup_block_windows, line_explode_stats, scope_glob_match, trigger_scope_selection, findings_in_ranges,
        needle_line_ranges, first_edit, hunk_range_map, grace_batch, dedup_claims, cache_hits, baseline_downgrade, backtest_pre_existing,
        sarif_level_counts, sarif_render, import_edges, graph_reach, graph_scc, layering_violations, coupling_edges, coupling_distinct,
        mermaid_lines, heading_slugs, unused_refs, dangling_refs, type_runs, adjacency_unjustified, describe_truncated, batch_report,
        exit_code, assessment_rollup,
    )
}
