"""Scalar functions over lines, paths, labels and check results, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MAX_SUMMARY_LINES


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no line, an empty text has none."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n", -1))


#: Unicode's White_Space; fixed values.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob: **/ any directories, ** anything, * and ? within a name."""
    out, at = [], 0
    rules = (("**/", "(.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]"))
    while at < len(pattern):
        for token, meaning in rules:
            if pattern.startswith(token, at):
                out.append(meaning)
                at += len(token)
                break
        else:
            char = pattern[at]
            out.append(char if char.isalnum() or char in "_/-" else "\\" + char)
            at += 1
    return r"\A" + "".join(out) + r"\z"


def in_scope(path: Column, globs: list[str]) -> Column:
    """Whether any glob matches; no globs match everything."""
    if not globs:
        return F.lit(True)
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))


def triggered(triggers: Column, trigger: Column) -> Column:
    return (F.size(triggers) == 0) | F.array_contains(triggers, trigger)


def command_for(template: Column, path: Column, ranges: Column) -> Column:
    """{file} and {changed_lines} filled in; ranges: array of struct(start, end)."""
    told = F.array_join(F.transform(ranges, lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return F.replace(F.replace(template, F.lit("{file}"), path), F.lit("{changed_lines}"), F.coalesce(told, F.lit("")))


def summary(output: Column, command: Column) -> Column:
    """At most the first 20 lines of the trimmed output, and a note on the rest."""
    whole = F.replace(trimmed(output), F.lit("\r\n"), F.lit("\n"))
    hidden = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1 - MAX_SUMMARY_LINES
    note = F.concat(F.lit("\n… "), hidden.cast("string"), F.lit(" more line(s) truncated — see everything, run: "), command)
    return F.when(hidden <= 0, whole).otherwise(F.concat(F.substring_index(whole, "\n", MAX_SUMMARY_LINES), note))


def described(message: Column, output: Column, command: Column) -> Column:
    told = summary(output, command)
    return F.when(message.isNull(), told).when(told == "", message).otherwise(F.concat(message, F.lit("\n"), told))


def label_key(label: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(label, r"(?U)\s+", " ")))


def decoded_entities(text: Column) -> Column:
    """Five entities, & first: so &amp;lt; becomes <."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def heading_slug(heading: Column) -> Column:
    """White space becomes -, one for one; letters, digits, _ and - stay, in small letters; all else goes."""
    dashed = F.regexp_replace(decoded_entities(heading), r"(?U)\s", "-")
    return F.lower(F.regexp_replace(dashed, r"[^\p{L}\p{N}_-]", ""))


def numbered_text(shown: Column) -> Column:
    """What stands right of the first tab of each line; null if a line has none."""
    parts = lines(shown)
    return F.when(F.forall(parts, lambda x: F.instr(x, "\t") > 0), F.array_join(F.transform(parts, lambda x: F.substring(x, F.instr(x, "\t") + 1, F.length(x))), "\n"))


def edited(before: Column, old: Column, new: Column) -> Column:
    """The first occurrence of old replaced; null if before is unknown or doesn't hold it."""
    head = F.split_part(before, old, F.lit(1))
    tail = F.substring(before, F.length(head) + F.length(old) + 1, F.length(before))
    return F.when(F.contains(before, old), F.when(old == "", F.concat(new, before)).otherwise(F.concat(head, new, tail)))


def running_sums(numbers: Column, block: int = 512) -> Column:
    """The sum of the numbers up to each place, that one included. Sums are gathered block by block: an array that
    grows number by number is copied each time."""
    none = F.array().cast("array<long>")
    start = F.struct(F.lit(0).cast("long").alias("sum"), none.alias("out"))

    def step(a: Column, x: Column) -> Column:
        return F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"] + x)).alias("out"))

    def whole(a: Column, k: Column) -> Column:
        inner = F.aggregate(F.slice(numbers, k * block + 1, F.lit(block)), F.struct(a["sum"].alias("sum"), none.alias("out")), step)
        return F.element_at(F.transform(F.array(inner), lambda d: F.struct(d["sum"].alias("sum"), F.concat(a["out"], d["out"]).alias("out"))), 1)

    blocks = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / block).cast("int"))
    return F.when(F.size(numbers) == 0, none).otherwise(F.aggregate(blocks, start, whole, lambda a: a["out"]))


def occurrence_lines(text: Column, needle: Column) -> Column:
    """First and last line, from 1, of each occurrence of the needle; occurrences don't overlap."""
    literal = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    parts = F.split(text, literal, -1)
    breaks = lambda x: (F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))).cast("long")
    before = running_sums(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: breaks(x)))
    start = lambda x, k: x + 1 + k * breaks(needle)
    spans = F.transform(before, lambda x, k: F.struct(start(x, k).cast("int").alias("start"), (start(x, k) + breaks(needle)).cast("int").alias("end")))
    return F.when((needle == "") | ~F.contains(text, needle), F.array().cast("array<struct<start:int,end:int>>")).otherwise(spans)


def diagram_id(name: Column) -> Column:
    slug = F.regexp_replace(name, "[^A-Za-z0-9]", "_")
    return F.when((slug == "") | slug.rlike(r"\A[0-9]"), F.concat(F.lit("n"), slug)).otherwise(slug)


def layer_rank(path: Column, layers: list[str]) -> Column:
    """Place of the first declared layer that is a part of the path; null for none."""
    parts = F.split(path, "/")
    rank = F.lit(None).cast("int")
    for k, layer in reversed(list(enumerate(layers))):
        rank = F.when(F.array_contains(parts, layer), F.lit(k)).otherwise(rank)
    return rank


def directory(path: Column) -> Column:
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.instr(slashed, "/") == 0, F.lit(".")).otherwise(F.regexp_replace(slashed, r"/[^/]*\z", ""))
