"""Go facts that rules and graphs read: parameters, ignored errors, blank imports, bare errors."""

from __future__ import annotations

import re

from ..constants import GO_PRIMITIVES
from .scan import Tokens, closing, go_parameters, is_word, tokens


def _tokens(source: str | Tokens) -> Tokens:
    """Those of a source that several searches share are read once."""
    return source if isinstance(source, Tokens) else tokens(source)


def same_typed_parameters(source: str | Tokens) -> list[tuple[int, int, str]]:
    """(row, count, type): declarations that name several parameters of a primitive, and runs of single ones."""
    ts, out = _tokens(source), []
    for k in ts.places("func"):
        j = k + 1
        while j < len(ts) and (ts.kind(j) == "word" or ts.texts[j] in "(["):
            if ts.kind(j) == "word":
                j += 1
                continue
            end = closing(ts, j)
            if ts.texts[j] == "(":
                row, run = ts.rows[j], None
                for names, kind in [p for p in go_parameters(ts.texts[j + 1 : end]) if not p[1].startswith("...")] + [([], "")]:
                    if run and not (len(names) == 1 and kind == run[1]):
                        if run[0] >= 2:
                            out.append((row, *run))
                        run = None
                    if len(names) >= 2 and kind in GO_PRIMITIVES:
                        out.append((row, len(names), kind))
                    elif len(names) == 1 and kind in GO_PRIMITIVES:
                        run = (run[0] + 1 if run else 1, kind)
            j = end + 1
    return out


def ignored_errors(source: str | Tokens) -> list[int]:
    """Rows of := with two names or more on the left, the last of them _."""
    ts, out = _tokens(source), []
    for k in ts.places(":="):
        if k and ts.texts[k - 1] == "_":
            j, names = k - 1, 1
            while j >= 2 and ts.texts[j - 1] == "," and ts.kind(j - 2) == "word":
                j, names = j - 2, names + 1
            if names >= 2:
                out.append(ts.rows[j])
    return out


def imports(source: str | Tokens) -> tuple[list[tuple[int, str, str]], list[int]]:
    """(row, alias, path) of the imports, and the rows on which comments begin or end."""
    ts, out = _tokens(source), []
    comments = sorted({r for row, text in ts.comments for r in (row, row + text.count("\n"))})
    for k in ts.places("import"):
        if (k == 0 or ts.rows[k - 1] < ts.rows[k] or ts.texts[k - 1] == ";") and k + 1 < len(ts):
            part = ts[k + 1 :][:2] if ts.texts[k + 1] != "(" else ts[k + 2 : closing(ts, k + 1)]
            alias = ""
            for x in part:
                if x.kind == "string":
                    out.append((x.row, alias, x.text.strip("\"`")))
                    alias = ""
                    if ts.texts[k + 1] != "(":
                        break
                else:
                    alias = x.text
    return out, comments


def bare_errors(source: str | Tokens) -> list[int]:
    """Rows of `if x != nil { return ..., x }`, the name on the left, whose only returned name is x, in files that wrap errors elsewhere."""
    ts, out = _tokens(source), []
    texts, rows = ts.texts, ts.rows
    told = [k for k, x in enumerate(texts) if "%w" in x and ts.kind(k) == "string"]
    wraps = told and any(k >= 2 and texts[k - 2] == "fmt" and k + 2 < len(texts) and any(k < i <= closing(ts, k + 1) for i in told) for k in ts.places("Errorf") if k + 1 < len(texts) and texts[k + 1] == "(")
    if not wraps:
        return out
    for k in ts.places("if"):
        j = k + 1
        while j < len(texts) and texts[j] != "{":
            j += 1
        if j >= len(texts):
            continue
        begin = k + 1
        if ";" in texts[begin:j]:
            begin = j - texts[begin:j][::-1].index(";")
        condition = [x for x in texts[begin:j] if x not in "()"]
        if len(condition) != 3 or condition[1] != "!=" or condition[2] != "nil" or not is_word(condition[0]):
            continue
        end = closing(ts, j)
        body = texts[j + 1 : end]
        if not body or body[0] != "return" or "{" in body or ";" in body or len(set(rows[j + 1 : end])) != 1:
            continue
        parts, depth = [[]], 0
        for x in body[1:]:
            depth += (x in "([") - (x in ")]")
            if x == "," and not depth:
                parts.append([])
            else:
                parts[-1].append(x)
        plain = [[x for x in p if x not in "()"] for p in parts]
        idents = [p[0] for p in plain if len(p) == 1 and is_word(p[0]) and p[0] not in ("nil", "true", "false")]
        if idents == condition[:1]:
            out.append(rows[k])
    return out


def module_path(go_mod: str) -> str | None:
    m = re.search(r"(?m)^\s*module\s+(\S+)", go_mod)
    return m[1] if m else None
