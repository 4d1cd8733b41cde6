"""A scanner for brace languages: tokens with rows, functions with parameters, bodies and nesting depth.

It knows as much of each language as the rules need and is not a grammar: declarations are recognised by their
tokens, nesting by the statements that open blocks.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

#: The most frequent stand first; only a comment or string must come before a sign.
_TOKEN = re.compile(
    r"[(){}\[\],;]|[^\W\d]\w*|\$\w*|\n|\d[\w.]*"
    r"|//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)|\"(?:\\.|[^\"\\\n])*(?:\"|$)|'(?:\\.|[^'\\\n])*(?:'|$)"
    r"|=>|->|:=|\.\.\.|==|!=|<=|>=|&&|\|\||::|[^\s\w]",
    re.S | re.M,
)
_QUOTES = frozenset("\"'`")
#: First characters of what may go over a line's end, or is one.
_LONG = _QUOTES | frozenset("\n/")
#: Statements that nest, by language, beside if; fixed values.
LOOPS = {
    "go": {"for", "switch", "select"},
    "typescript": {"for", "while", "do", "switch"},
    "java": {"for", "while", "do", "switch"},
    "kotlin": {"for", "while", "do", "when"},
}
#: What else may begin a nested level, in some language.
_TURNS = {"if", "func", "fun", "function", "=>", "->", "(", "[", "{"}
LOOPS["tsx"] = LOOPS["javascript"] = LOOPS["typescript"]
_NO_METHOD = {"if", "for", "while", "switch", "catch", "with", "function", "return", "new", "await", "typeof", "super", "synchronized", "try", "throw", "else", "do", "when"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    row: int  # from 1


@dataclass
class Function:
    row: int
    body_lines: int
    depth: int
    parameters: int


def is_word(text: str) -> bool:
    first = text[0]
    return first in "_$" or first.isalnum() and not first.isdecimal()


class Tokens(Sequence[Token]):
    """The tokens of a source but its comments, which are kept beside them as (first row, text). Texts and rows are
    lists, since most tokens are only passed over; a token is built where it is asked for."""

    def __init__(self, texts: list[str], rows: list[int], comments: list[tuple[int, str]], stray: set[int]):
        self.texts, self.rows, self.comments, self.stray = texts, rows, comments, stray

    def __len__(self) -> int:
        return len(self.texts)

    def __getitem__(self, k):
        if isinstance(k, slice):
            return [self[i] for i in range(*k.indices(len(self.texts)))]
        text = self.texts[k]
        return Token(self.kind(k), text, self.rows[k])

    def kind(self, k: int) -> str:
        first = self.texts[k][0]
        if first in _QUOTES:
            return "sign" if self.stray and k % len(self.texts) in self.stray else "string"
        if first.isdecimal():
            return "number"
        return "word" if is_word(first) else "sign"

    @cached_property
    def ends(self) -> list[int]:
        """Where each bracket closes; the end if it doesn't. Each kind of bracket is counted by itself."""
        out = [len(self.texts) - 1] * len(self.texts)
        opened = {"(": [], "{": [], "[": []}
        of = {"(": opened["("], "{": opened["{"], "[": opened["["], ")": opened["("], "}": opened["{"], "]": opened["["]}
        for k, x in enumerate(self.texts):
            if x in of:
                if x in opened:
                    of[x].append(k)
                elif of[x]:
                    out[of[x].pop()] = k
        return out

    def places(self, text: str) -> list[int]:
        """Where a text stands."""
        return [k for k, x in enumerate(self.texts) if x == text] if text in self.texts else []


def tokens(source: str) -> Tokens:
    texts, rows, comments, stray, row = [], [], [], set(), 1
    found = _TOKEN.findall(source)
    for k, x in enumerate(found):
        first = x[0]
        if first not in _LONG:
            texts.append(x)
            rows.append(row)
        elif first == "\n":
            row += 1
        elif x[:2] in ("//", "/*"):
            comments.append((row, x))
            row += x.count("\n")
        else:
            if x in _QUOTES and k + 1 < len(found) and (x == "`" or found[k + 1] != "\n"):
                stray.add(len(texts))  # a quote that opens no string, as a \\ ends the source
            texts.append(x)
            rows.append(row)
            row += x.count("\n")
    return Tokens(texts, rows, comments, stray)


def closing(ts: Tokens, at: int) -> int:
    """Where the bracket at `at` closes; the end if it doesn't."""
    return ts.ends[at]


def split_list(texts: list[str]) -> list[list[str]]:
    """Parts between commas outside all brackets."""
    out, depth = [[]], 0
    for x in texts:
        if x in _NESTS:
            depth += _NESTS[x]
        elif x == "," and depth <= 0:
            out.append([])
            continue
        out[-1].append(x)
    return [p for p in out if p]


#: Brackets of a list, types' included: one level more or less.
_NESTS = {"(": 1, "[": 1, "{": 1, "<": 1, ")": -1, "]": -1, "}": -1, ">": -1}


def go_parameters(texts: list[str]) -> list[tuple[list[str], str]]:
    """(names, type) of each parameter declaration; names are empty where only types stand."""
    parts = split_list(texts)
    named = any(len(p) > 1 and is_word(p[0]) and p[0] not in ("func", "map", "chan", "struct", "interface") and p[1] not in (".", "[") or len(p) > 2 and is_word(p[0]) and p[1] == "[" and p[2] == "]" for p in parts)
    if not named:
        return [([], "".join(p)) for p in parts]
    out, names = [], []
    for p in parts:
        names.append(p[0])
        if len(p) > 1:
            out.append((names, "".join(p[1:])))
            names = []
    return out + [([], n) for n in names]


def count_parameters(language: str, texts: list[str]) -> int:
    if language == "go":
        return sum(max(1, len(names)) for names, _ in go_parameters(texts))
    parts = split_list(texts)
    if language == "kotlin":  # a vararg parameter isn't counted
        return sum("vararg" not in p for p in parts)
    return len(parts)


def _body_start(language: str, ts: Tokens, at: int) -> int | None:
    """The brace of the body after parameters that end before `at`; None for a declaration without one."""
    k, texts, rows = at, ts.texts, ts.rows
    while k < len(texts):
        x = texts[k]
        if x == "{":
            if language == "go" and texts[k - 1] in ("interface", "struct") or language in ("typescript", "tsx") and texts[k - 1] in (":", "|", "&"):
                k = closing(ts, k) + 1
                continue
            return k
        if x in ("(", "["):
            k = closing(ts, k) + 1
            continue
        if x in (";", "}", "=", "=>") or x in ("func", "fun", "function", "class", "type", "var", "const", "val", "import") and k > at and rows[k] > rows[at - 1]:
            return None
        if language == "go" and rows[k] > rows[k - 1] and k > at:
            return None
        k += 1
    return None


def depth_of(language: str, ts: Tokens, start: int, end: int) -> int:
    """1 for a body (between the braces at start and end), and one more for each nested statement or function literal
    around the deepest place, braces or not. An else if stays on the level of its if."""
    return _Nesting(language, ts).inside(start + 1, end, 1)


class _Nesting:
    """Reads tokens as statements, as far as their nesting calls for it. Methods return the deepest level found;
    those that read one statement also return the place behind it."""

    def __init__(self, language: str, ts: Tokens):
        self.ts, self.language, self.loops = ts, language, LOOPS[language]
        self.texts, self.rows, self.turns = ts.texts, ts.rows, LOOPS[language] | _TURNS
        self.script = language in ("typescript", "tsx", "javascript")

    def text(self, k: int) -> str:
        return self.texts[k] if 0 <= k < len(self.texts) else ""

    def inside(self, k: int, end: int, depth: int) -> int:
        most, texts, turns = depth, self.texts, self.turns
        while k < end:
            x = texts[k]
            if x not in turns or x == "(" and texts[k + 1] == ")":  # nothing that nests begins here
                k += 1
                continue
            k, deep = self.step(k, end, depth)
            most = max(most, deep)
        return most

    def brackets(self, k: int, end: int, depth: int) -> tuple[int, int]:
        close = min(closing(self.ts, k), end)
        return close + 1, self.inside(k + 1, close, depth) if close > k + 1 else depth

    def step(self, k: int, end: int, depth: int) -> tuple[int, int]:
        """One token, or the construct that begins with it."""
        x = self.texts[k]
        if x in ("(", "["):
            return self.brackets(k, end, depth)
        if x == "{":
            return self.brackets(k, end, depth + (self.language == "kotlin" and self.is_lambda(k)))
        if x == "=>" or x == "->" and self.language == "java" and not self.in_case(k):
            return self.arrow(k + 1, end, depth + 1)
        if x != "->" and self.text(k - 1) not in (".", "::"):
            if x == "if":
                return self.chain(k, end, depth + 1)
            if x in self.loops:
                return self.loop(k, end, depth + 1)
            if x == "func" or x == "fun" and self.text(k + 1) == "(":
                return self.literal(k + 1, end, depth + 1)
            if self.script and x == "function" and not self.begins(k):
                return self.literal(k + 1, end, depth + 1)
        return k + 1, depth

    def begins(self, k: int) -> bool:
        """Whether a statement begins here."""
        before = self.text(k - 1)
        return before in ("{", "}", ";", "async", "export", "default") or self.rows[k - 1] < self.rows[k] and before not in ("(", ",", "=", "=>", ":", "return", "&&", "||", "?")

    def in_case(self, k: int) -> bool:
        """Whether an arrow ends the label of a switch."""
        k -= 1
        while k >= 0 and self.text(k) not in ("{", "}", ";", "->", "(", ")") or self.text(k) == ")" and self.text(k + 1) == "->":
            if self.text(k) in ("case", "default"):
                return True
            k -= 1
        return False

    def is_lambda(self, k: int) -> bool:
        before, j = self.ts[k - 1], k - 1
        if before.text in ("else", "try", "finally", "do", "init", "object") or before.text in ("{", "}", ";", "->") and before.text != "->":
            return before.text in ("{",)
        row = before.row
        while j >= 0 and self.rows[j] == row and self.text(j) not in ("{", "}", ";", "="):
            if self.text(j) in ("class", "object", "interface", "fun", "catch", "companion", "when", "for", "while", "if"):
                return False
            j -= 1
        return before.kind == "word" or before.text in ("(", ")", "=", ",", ">", "->")

    def statement(self, k: int, end: int, depth: int) -> tuple[int, int]:
        """A block, or what goes up to the end of one statement."""
        if self.text(k) == "{":
            return self.brackets(k, end, depth)
        if k < end and (self.text(k) == "if" or self.text(k) in self.loops):
            return self.step(k, end, depth)
        most, first = depth, True
        while k < end:
            if self.text(k) in (";", "}"):
                return k + (self.text(k) == ";"), most
            if self.text(k) == "else" or not first and self.language != "java" and self.rows[k] > self.rows[k - 1] and self.ends_line(k):
                break
            k, deep = self.step(k, end, depth)
            most, first = max(most, deep), False
        return k, most

    def ends_line(self, k: int) -> bool:
        """Whether a line break before k ends a statement: neither side calls for more."""
        before, t = self.ts[k - 1], self.ts[k]
        return (before.kind != "sign" or before.text in (")", "]", "}")) and (t.kind != "sign" or t.text in ("{", "(", "[") and self.language == "kotlin")

    def header(self, k: int, end: int, depth: int) -> tuple[int, int]:
        """What stands between a keyword and its body."""
        if self.language != "go":
            while k < end and self.text(k) == "await":
                k += 1
            return self.brackets(k, end, depth) if self.text(k) == "(" else (k, depth)
        most = depth
        while k < end and self.text(k) != "{":
            k, deep = self.step(k, end, depth)
            most = max(most, deep)
        return k, most

    def chain(self, k: int, end: int, depth: int) -> tuple[int, int]:
        most = depth
        while True:
            k, a = self.header(k + 1, end, depth)
            k, b = self.statement(k, end, depth)
            most = max(most, a, b)
            if self.text(k) == ";" and self.text(k + 1) == "else":
                k += 1
            if k >= end or self.text(k) != "else" or self.text(k + 1) == "->":
                return k, most
            k += 1
            if self.text(k) != "if":
                k, deep = self.statement(k, end, depth)
                return k, max(most, deep)

    def loop(self, k: int, end: int, depth: int) -> tuple[int, int]:
        if self.text(k) == "do" and self.language != "go":
            k, most = self.statement(k + 1, end, depth)
            if self.text(k) == "while":
                k, deep = self.header(k + 1, end, depth)
                most = max(most, deep)
            return k, most
        k, most = self.header(k + 1, end, depth)
        k, deep = self.statement(k, end, depth)
        return k, max(most, deep)

    def literal(self, k: int, end: int, depth: int) -> tuple[int, int]:
        """A function literal, from behind its keyword."""
        while k < end and self.text(k) != "(":
            k += 1
        body = _body_start(self.language, self.ts, min(closing(self.ts, k), end) + 1) if k < end else None
        if body is None or body >= end:
            return k + 1, depth
        most = self.inside(k + 1, body, depth)
        k, deep = self.brackets(body, end, depth)
        return k, max(most, deep)

    def arrow(self, k: int, end: int, depth: int) -> tuple[int, int]:
        """The body behind an arrow: a block, or an expression up to the end of what holds it."""
        if self.text(k) == "{":
            return self.brackets(k, end, depth)
        most, first = depth, True
        while k < end and self.text(k) not in (",", ";", ")", "]", "}") and (first or self.rows[k] == self.rows[k - 1] or not self.ends_line(k)):
            k, deep = self.step(k, end, depth)
            most, first = max(most, deep), False
        return k, most


#: What a function begins with; in other languages it may begin with its name and a bracket.
_HEADS = {"go": {"func"}, "kotlin": {"fun"}}


def functions(language: str, source: str) -> list[Function]:
    if language == "python":
        return _python(source)
    ts, out = tokens(source), []
    nesting, texts, rows = _Nesting(language, ts), ts.texts, ts.rows

    def add(at: int, opening: int, body: int | None) -> None:
        if body is not None:
            end = closing(ts, body)
            out.append(Function(rows[at], rows[end] - rows[body] + 1, nesting.inside(body + 1, end, 1), count_parameters(language, texts[opening + 1 : closing(ts, opening)])))

    heads = _HEADS.get(language, {"function", "=>", "->"})
    named = None if language in _HEADS else "("
    for k in [k for k, (x, after) in enumerate(zip(texts, texts[1:])) if after == named or x in heads]:
        x, nxt = texts[k], texts[k + 1]
        if language == "go" and x == "func":
            j = k + 1
            if texts[j] == "(":  # a receiver, or a literal's parameters
                after = closing(ts, j) + 1
                if not (after + 1 < len(ts) and ts.kind(after) == "word" and texts[after + 1] in "(["):
                    continue
                j = after
            elif ts.kind(j) != "word":
                continue
            j += 1
            if j < len(ts) and texts[j] == "[":
                j = closing(ts, j) + 1
            if j < len(ts) and texts[j] == "(":
                add(k, j, _body_start(language, ts, closing(ts, j) + 1))
        elif language == "kotlin" and x == "fun":
            j = k + 1
            while j < len(ts) and texts[j] != "(":
                j += 1
            if j < len(ts):
                add(k, j, _body_start(language, ts, closing(ts, j) + 1))
        elif language in ("typescript", "tsx", "javascript"):
            if x == "function":
                j = k + 1
                while j < len(ts) and texts[j] != "(":
                    j += 1
                if j < len(ts):
                    add(k, j, _body_start(language, ts, closing(ts, j) + 1))
            elif x == "=>" and nxt == "{" and k and (texts[k - 1] == ")" or ts.kind(k - 1) == "word"):
                if texts[k - 1] == ")":
                    depth, j = 0, k - 1
                    while j >= 0:
                        depth += (texts[j] == ")") - (texts[j] == "(")
                        if not depth:
                            break
                        j -= 1
                    add(max(j, 0), max(j, 0), k + 1)  # from the beginning if nothing opens it
                else:
                    end = closing(ts, k + 1)
                    out.append(Function(rows[k - 1], rows[end] - rows[k + 1] + 1, nesting.inside(k + 2, end, 1), 1))
            elif nxt == "(" and x not in _NO_METHOD and (k == 0 or texts[k - 1] not in (".", "function", "new")) and ts.kind(k) == "word":
                after = closing(ts, k + 1) + 1
                if after < len(ts) and texts[after] in ("{", ":"):
                    body = _body_start(language, ts, after)
                    if body is not None and (texts[after] == "{" or texts[k - 1] in ("{", "}", ";", "async", "static", "public", "private", "protected", "get", "set", "*")):
                        add(k, k + 1, body)
        elif language == "java":
            if x == "->" and nxt == "{":
                end = closing(ts, k + 1)
                n = 1
                if texts[k - 1] == ")":
                    j, depth = k - 1, 0
                    while j >= 0:
                        depth += (texts[j] == ")") - (texts[j] == "(")
                        if not depth:
                            break
                        j -= 1
                    n = len(split_list(texts[j + 1 : k - 1]))
                out.append(Function(rows[k - 1], rows[end] - rows[k + 1] + 1, nesting.inside(k + 2, end, 1), n))
            elif nxt == "(" and x not in _NO_METHOD and k and ts.kind(k) == "word" and (ts.kind(k - 1) == "word" and texts[k - 1] not in ("new", "return", "else", "public", "private", "protected", "throw") or texts[k - 1] in ("]", ">")):
                body = _body_start(language, ts, closing(ts, k + 1) + 1)
                if body is not None:
                    add(k, k + 1, body)
    return sorted(out, key=lambda f: f.row)


def _python(source: str) -> list[Function]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    nests = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Match, ast.Lambda)
    inner_nodes = ast.iter_child_nodes if "lambda" in source else _blocks  # only lambdas nest within expressions
    out, left = [], [tree]
    while left:
        node = left.pop()
        left += _blocks(node)
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        most, todo = 1, [(x, 1) for x in node.body]
        while todo:
            at, depth = todo.pop()
            inner = depth + isinstance(at, nests)
            most = max(most, inner)
            if isinstance(at, ast.If):
                todo += [(x, inner) for x in [at.test, *at.body]]
                chain = len(at.orelse) == 1 and isinstance(at.orelse[0], ast.If) and at.orelse[0].col_offset == at.col_offset
                todo += [(x, depth if chain else inner) for x in at.orelse]
            else:
                todo += [(x, inner) for x in inner_nodes(at)]
        a = node.args
        n = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + (a.vararg is not None) + (a.kwarg is not None)
        out.append(Function(node.lineno, node.body[-1].end_lineno - node.body[0].lineno + 1, most, n))
    return sorted(out, key=lambda f: f.row)


def _blocks(node: ast.AST) -> list[ast.AST]:
    """What holds statements right below a statement, and those statements."""
    out = []
    for name in node._fields:
        if name in _HOLD and isinstance(part := getattr(node, name), list):
            out += part
    return out


#: Fields of statements, handlers and cases.
_HOLD = {"body", "orelse", "handlers", "finalbody", "cases"}
