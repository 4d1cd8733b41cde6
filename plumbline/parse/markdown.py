"""Markdown facts: reference definitions, uses of references, headings, and links to anchors, with rows from 1."""

from __future__ import annotations

import re

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<([^<>]*)>|(\S+))[ \t]*(?:\"[^\"]*\"|'[^']*'|\([^()]*\))?[ \t]*")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*")
_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_LINK = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.|\[(?:[^\[\]\\]|\\.)*\])*)\](?:\(\s*(?:<([^<>]*)>|([^\s()]*(?:\([^\s()]*\)[^\s()]*)*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)|\[((?:[^\[\]\\]|\\.)*)\])?")


def key(label: str) -> str:
    return " ".join(label.split()).lower()


def parse(source: str) -> dict[str, list[tuple]]:
    """definitions (row, label, target), uses (row, label, as written, image, inline target), headings (row, text)."""
    rows = source.split("\n")
    out: dict[str, list[tuple]] = {"definitions": [], "uses": [], "headings": []}
    text: list[tuple[int, str]] = []
    fence, paragraph, known = None, False, set()
    for number, line in enumerate(rows, 1):
        line = line.rstrip("\r")
        m = _FENCE.fullmatch(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
            text.append((number, ""))
            continue
        if m and not (m[1][0] == "`" and "`" in m[2]):
            fence, paragraph = m[1], False
            text.append((number, ""))
            continue
        if not paragraph and (line.startswith("    ") or line.startswith("\t")):
            text.append((number, ""))
            continue
        d = _DEFINITION.fullmatch(line)
        if d and not paragraph and not d[1].startswith("^"):
            if key(d[1]) not in known:  # the first of several definitions holds
                known.add(key(d[1]))
                out["definitions"].append((number, key(d[1]), d[2] if d[2] is not None else d[3]))
            text.append((number, ""))
            continue
        h = _ATX.fullmatch(line)
        if h:
            out["headings"].append((number, _plain(h[2] or "")))
            paragraph = False
        elif paragraph and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", line):
            out["headings"].append((number - 1, _plain(rows[number - 2])))
            paragraph = False
        else:
            paragraph = bool(line.strip())
        text.append((number, line))
    out["headings"].sort()
    for block in _blocks(text):
        joined = "\n".join(x for _, x in block)
        joined = _CODE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), joined)
        joined = re.sub(r"\\[\[\]]", "  ", joined)
        _uses(joined, block[0][0], known, out["uses"])
    return out


def _blocks(text: list[tuple[int, str]]):
    block: list[tuple[int, str]] = []
    for number, line in text:
        if line.strip():
            block.append((number, line))
        elif block:
            yield block
            block = []
    if block:
        yield block


def _uses(text: str, first: int, known: set[str], uses: list[tuple]) -> None:
    for m in _LINK.finditer(text):
        row = first + text.count("\n", 0, m.start())
        image, inner, angled, bare, label = m[1] == "!", m[2], m[3], m[4], m[5]
        if angled is not None or bare is not None:
            uses.append((row, None, inner, image, angled if angled is not None else bare))
        else:
            written = label or inner
            if written.strip():
                uses.append((row, key(written), written, image, None))
        if "[" in inner:
            _uses(inner, row, known, uses)


def _plain(heading: str) -> str:
    """A heading's text: links and images by their text, code by its content, emphasis signs gone."""
    heading = _CODE.sub(lambda m: m[2].strip(), heading)
    heading = re.sub(r"!?\[((?:[^\[\]])*)\](?:\([^()]*\)|\[[^\[\]]*\])", r"\1", heading)
    heading = re.sub(r"(\*{1,3}|(?<!\w)_{1,3}(?=\S))(.+?)(\1|(?<=\S)_{1,3}(?!\w))", r"\2", heading)
    return heading.strip()
