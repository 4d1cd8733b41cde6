"""Reference and anchor integrity over parsed documents: definitions, uses, headings, anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import heading_slug


def unused_definitions(defs: DataFrame, uses: DataFrame, path: str = "path", label: str = "label") -> DataFrame:
    return defs.join(uses.select(path, label).distinct(), [path, label], "left_anti")


def dangling_uses(uses: DataFrame, defs: DataFrame, path: str = "path", label: str = "label") -> DataFrame:
    """Uses without definition; footnotes (^) and images never count."""
    open_ = uses.where(~F.startswith(F.col(label), F.lit("^")))
    open_ = open_.where(~F.col("image")) if "image" in uses.columns else open_
    return open_.join(defs.select(path, label).distinct(), [path, label], "left_anti")


def heading_anchors(headings: DataFrame, path: str = "path", text: str = "heading", order: str = "ord") -> DataFrame:
    """headings with anchor: the slug, and -1, -2, ... from its second occurrence in a document."""
    slug = headings.withColumn("slug", heading_slug(F.col(text)))
    k = F.row_number().over(Window.partitionBy(path, "slug").orderBy(order)) - 1
    return slug.withColumn("anchor", F.when(k == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), k.cast("string"))))


def dead_anchors(links: DataFrame, anchors: DataFrame, path: str = "path", fragment: str = "fragment") -> DataFrame:
    """Links (path, fragment) to anchors that their document lacks; empty fragments aren't links."""
    have = anchors.select(path, F.col("anchor").alias(fragment)).distinct()
    return links.where(F.col(fragment) != "").join(have, [path, fragment], "left_anti")


def cross_file_links(links: DataFrame, files: DataFrame, anchors: DataFrame) -> DataFrame:
    """links (path, target, fragment) with outcome: missing file, dead anchor, or ok."""
    known = files.select(F.col("path").alias("target")).distinct().withColumn("_file", F.lit(True))
    have = anchors.select(F.col("path").alias("target"), F.col("anchor").alias("fragment")).distinct().withColumn("_anchor", F.lit(True))
    out = links.join(known, "target", "left").join(have, ["target", "fragment"], "left")
    outcome = F.when(F.col("_file").isNull(), "missing file").when((F.coalesce("fragment", F.lit("")) != "") & F.col("_anchor").isNull(), "dead anchor").otherwise("ok")
    return out.withColumn("outcome", outcome).drop("_file", "_anchor")


def runs(rows: DataFrame, keys: list[str], order: str, value: str, least: int = 2) -> DataFrame:
    """(keys, value, start, length): maximal runs of equal values among consecutive rows."""
    by = Window.partitionBy(*keys).orderBy(order)
    island = F.row_number().over(by) - F.row_number().over(Window.partitionBy(*keys, value).orderBy(order))
    out = rows.withColumn("_i", island).groupBy(*keys, value, "_i").agg(F.min(order).alias("start"), F.count("*").alias("length"))
    return out.where(F.col("length") >= least).drop("_i")


def unjustified(marked: DataFrame, notes: DataFrame, key: str = "path", row: str = "row") -> DataFrame:
    """Marked rows with no note on the same row, nor on the row above unless that row is marked itself."""
    above = notes.join(marked.select(key, row), [key, row], "left_anti").select(key, (F.col(row) + 1).alias(row))
    return marked.join(notes.select(key, row).unionByName(above).distinct(), [key, row], "left_anti")
