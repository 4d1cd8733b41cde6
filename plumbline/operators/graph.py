"""Import graphs: components, cycles, layers, coupling, diagrams. Graphs are (src, dst[, file, line]) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CYCLE_EDGE, CYCLE_NODE, MAX_DIAGRAM_NODES, MAX_FAN
from ..functions.text import diagram_id, layer_rank


def _settled(spark, df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        import tempfile

        folder = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def reachable(edges: DataFrame) -> DataFrame:
    """(src, dst) for every path of one edge or more. Paths found in a round are joined with all paths, so lengths
    double and rounds grow with the logarithm of the longest; each round is written before the next reads it."""
    spark = edges.sparkSession
    known = fresh = _settled(spark, edges.select("src", "dst").distinct())
    while not fresh.isEmpty():
        a, b, c = known.alias("a"), fresh.alias("b"), known.alias("c")
        further = a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        further = further.union(b.join(c, F.col("b.dst") == F.col("c.src")).select(F.col("b.src").alias("src"), F.col("c.dst").alias("dst")))
        fresh = _settled(spark, further.subtract(known))
        known = _settled(spark, known.union(fresh))
    return known


def _least_labels(spark, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label) after each label has gone along the edges wherever it is less than what stands there."""
    changed = labels
    while True:
        moved = changed.join(edges, changed.node == edges.src).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("new"))
        better = labels.join(moved, "node", "left").select("node", F.least("label", F.coalesce("new", "label")).alias("label"), F.coalesce(F.col("new") < F.col("label"), F.lit(False)).alias("changed"))
        settled = _settled(spark, better)
        labels, changed = settled.select("node", "label"), settled.where("changed").select("node", "label")
        if changed.isEmpty():
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of nodes on a cycle (also one of a single edge); component is its smallest node.

    Nodes without an edge in or out are trimmed. Every node takes the smallest node that reaches it; of the nodes
    with one such label those that reach it in turn are its component, found backwards along edges within the
    label. What is left goes through the same again. Rows stay in proportion to the edges; rounds grow with the
    longest path on which labels travel."""
    spark = edges.sparkSession
    left = _settled(spark, edges.select("src", "dst").distinct())
    found = None
    while True:
        while True:  # trim
            inner = _settled(spark, left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if inner.count() == left.count():
                break
            left = inner
        if left.isEmpty():
            break
        nodes = left.select(F.col("src").alias("node")).distinct()
        label = _least_labels(spark, nodes.withColumn("label", F.col("node")), left)
        to, of = label.select(F.col("node").alias("dst"), F.col("label").alias("to")), label.select(F.col("node").alias("src"), F.col("label").alias("of"))
        within = _settled(spark, left.join(of, "src").join(to, "dst").where(F.col("of") == F.col("to")).select("src", "dst"))
        # backwards from each label's own node: the others begin above every label
        back = within.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        flags = _least_labels(spark, label.select("node", F.when(F.col("node") == F.col("label"), 0).otherwise(1).alias("label")), back)
        done = _settled(spark, label.join(flags.where("label = 0").select("node"), "node").select("node", F.col("label").alias("component")))
        found = done if found is None else found.union(done)
        gone = done.select("node")
        left = _settled(spark, left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(1).cast("long").alias("size")).where("false")
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    own = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
    return found.join(sizes, "component").join(own, "node", "left").where("size > 1 or loop").select("node", "component", "size")


def cycle_findings(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(component, members, file, line): each cycle's members in order, the first again at the end, at its first
    edge out of the first member into the cycle."""
    nodes = strong_components(edges) if components is None else components
    members = nodes.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("m"))
    inside = edges.join(nodes.select(F.col("node").alias("dst"), F.col("component")), "dst").where("src = component")
    first = inside.groupBy("component").agg(F.min(F.struct("file", "line")).alias("at"))
    return members.join(first, "component").select("component", F.concat(F.array_join("m", " -> "), F.lit(" -> "), F.col("m")[0]).alias("members"), "at.file", "at.line")


def layering_violations(edges: DataFrame, layers: list[str]) -> DataFrame:
    """Edges from a layer into one declared before it, with both layers' ranks; none without layers."""
    ranked = edges.withColumn("from_layer", layer_rank(F.col("src"), layers)).withColumn("to_layer", layer_rank(F.col("dst"), layers))
    return ranked.where("to_layer < from_layer")


def architecture_findings(name: str, nodes: DataFrame, edges: DataFrame, layers: list[str] = (), components: DataFrame | None = None) -> DataFrame:
    """(checker, file, line, message) of one architecture checker over an import graph (node; src, dst, file, line).
    Findings that belong to no one import have neither file nor line. components: those of the edges, if they are known."""
    told = lambda df, file, line, *message: df.select(F.lit(name).alias("checker"), file.alias("file"), line.cast("int").alias("line"), F.concat(*message).alias("message"))
    none = F.lit(None)
    if name == "import-cycles":
        return told(cycle_findings(edges, components), F.col("file"), F.col("line"), F.lit("import cycle: "), "members")
    if name == "layering":
        at = lambda c: F.get(F.array(*[F.lit(x) for x in layers]), F.col(c))
        found = layering_violations(edges, list(layers)) if layers else edges.withColumn("from_layer", F.lit(0)).withColumn("to_layer", F.lit(0)).where("false")
        names = (at("from_layer"), at("to_layer")) if layers else (F.lit(""), F.lit(""))
        return told(found, F.col("file"), F.col("line"), F.lit("layering: "), "src", F.lit(" ("), names[0], F.lit(") imports "), "dst", F.lit(" ("), names[1], F.lit("), a layer above its own"))
    if name == "coupling":
        fans = coupling(nodes, edges)
        out = told(fans.where(F.col("fan_out") > MAX_FAN), none.cast("string"), none, F.lit("[coupling] "), "node", F.lit(" imports "), F.col("fan_out").cast("string"), F.lit(f" packages, limit {MAX_FAN}"))
        return out.unionByName(told(fans.where(F.col("fan_in") > MAX_FAN), none.cast("string"), none, F.lit("[coupling] "), "node", F.lit(" is imported "), F.col("fan_in").cast("string"), F.lit(f" times, limit {MAX_FAN}")))
    raise ValueError(f"unknown architecture checker: {name}")


def coupling(nodes: DataFrame, edges: DataFrame, distinct: bool = False, limit: int = MAX_FAN) -> DataFrame:
    """(node, fan_out, fan_in, high): edges, or distinct neighbours, out of and into each node; nodes without any too."""
    e = edges.select("src", "dst")
    e = e.distinct() if distinct else e
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    all_ = nodes.select("node").distinct().join(out, "node", "left").join(into, "node", "left").na.fill(0, ["fan_out", "fan_in"])
    return all_.withColumn("high", (F.col("fan_out") > limit) | (F.col("fan_in") > limit))


def diagram_lines(nodes: DataFrame, edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(part, ord, text): lines of a diagram. A graph of no node, or of over MAX_DIAGRAM_NODES, is one note, which
    is decided before anything is numbered; so numbering in one task never sees more than such a graph."""
    from pyspark.sql import Window

    spark = nodes.sparkSession
    n = nodes.select("node").distinct().limit(MAX_DIAGRAM_NODES + 1).count()
    if n == 0 or n > MAX_DIAGRAM_NODES:
        note = "no edges to draw" if n == 0 else f"more than {MAX_DIAGRAM_NODES} nodes: choose a narrower scope"
        return spark.createDataFrame([(0, 0, note)], "part int, ord long, text string")
    order = lambda *c: (F.row_number().over(Window.orderBy(*c)) - 1).cast("long")
    cyclic = (strong_components(edges) if components is None else components).select("node")
    named = nodes.select("node").distinct()
    head = spark.createDataFrame([(0, 0, "graph TD")], "part int, ord long, text string")
    boxes = named.select(F.lit(1).alias("part"), order("node").alias("ord"), F.concat(F.lit("    "), diagram_id(F.col("node")), F.lit('["'), "node", F.lit('"]')).alias("text"))
    links = edges.select("src", "dst").distinct().withColumn("ord", order("src", "dst"))
    arrows = links.select(F.lit(2).alias("part"), "ord", F.concat(F.lit("    "), diagram_id(F.col("src")), F.lit(" --> "), diagram_id(F.col("dst"))).alias("text"))
    ids = cyclic.select(F.lit(1).alias("g"), "node").groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list("node")), diagram_id), ",").alias("ids"))
    style = ids.select(F.lit(3).alias("part"), F.lit(0).cast("long").alias("ord"), F.lit(f"    classDef cycle {CYCLE_NODE};").alias("text")).unionByName(
        ids.select(F.lit(4).alias("part"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("    class "), "ids", F.lit(" cycle;")).alias("text"))
    )
    red = links.join(cyclic.withColumnRenamed("node", "src"), "src", "left_semi").join(cyclic.withColumnRenamed("node", "dst"), "dst", "left_semi")
    marks = red.select(F.lit(5).alias("part"), "ord", F.concat(F.lit("    linkStyle "), F.col("ord").cast("string"), F.lit(f" {CYCLE_EDGE};")).alias("text"))
    return head.unionByName(boxes).unionByName(arrows).unionByName(style).unionByName(marks)
