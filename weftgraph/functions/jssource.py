"""Arrow-batch helper that reads JS/TS imports: a scanner for tokens, and a reader of import forms over them.

The scanner keeps a stack of open brackets, template literals and JSX elements. Whether a slash begins a regular expression, and whether a
less-than sign begins JSX, is decided by the token before it. Brackets that do not match, and literals that do not end, are syntax errors.
"""

from __future__ import annotations

import re

import pandas as pd

_SPACE = re.compile(r"(?:\s+|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/)+")
_TOKEN = re.compile(
    r"""(?P<id>[\w$]+)|(?P<str>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<p>=>|\+\+|--|\.\.\.|[^\w\s$])""")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_TAG = re.compile(r"<(>|[A-Za-z_$][\w$.:-]*(?=[\s/>{<]))")
_GENERIC = re.compile(r"<\s*(?:const\s+)?([A-Za-z_$][\w$]*)\s*(?:,|extends\b|=(?!=)|>\s*\()")
_IN_TAG = re.compile(r"""(?:\s+|//[^\n]*|/\*[\s\S]*?\*/|[\w$.:=-]+|"[^"]*"|'[^']*')*""")
_TYPE_ARGUMENTS = re.compile(r"<[^<>{}]*(?:<[^<>{}]*>[^<>{}]*)*>")
_TEXT = re.compile(r"[^<{]*")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")

BEFORE_VALUE = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
STATEMENTS = frozenset("if for while return import export const let var class function switch try throw do".split())
CONDITIONS = frozenset(("if", "while", "for", "with"))
CLOSING = {")": "(", "]": "[", "}": "{"}
# what a bracket of the stack leads back to
JS, TEMPLATE, TAG, CHILD = "js", "template", "tag", "child"

ID, STR, P, VALUE = "id", "str", "p", "value"
Token = tuple[str, str]


class SyntaxFault(ValueError):
    def __init__(self, source: str, what: str, at: int):
        line = source.count("\n", 0, at) + 1
        super().__init__(f"{what} ({line}:{at - source.rfind(chr(10), 0, at) - 1})")


def unquoted(raw: str) -> str:
    """The value of a string literal."""
    def one(m):
        code = m[1] or m[2] or m[3]
        if code:
            return chr(min(int(code, 16), 0x10FFFF))
        return {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}.get(m[4], m[4])

    body = raw[1:-1]
    return _ESCAPE.sub(one, body) if "\\" in body else body


def tokens(source: str) -> list[Token]:
    """Identifiers, strings and marks in order; templates, regular expressions and JSX elements end in one ``value`` token each.

    What stands in a template's or an element's braces is tokenised in its place.
    """
    out: list[Token] = []
    stack: list[tuple] = []  # (bracket or element, what it leads back to, whether a value ends with it, where)
    mode, at, end = JS, source.find("\n") if source.startswith("#!") else 0, len(source)
    at = end if at < 0 else at
    value = False  # whether the last token ends a value
    last = ""
    while at < end:
        if mode == JS:
            if m := _SPACE.match(source, at):
                at = m.end()
                continue
            if source.startswith("/*", at):
                raise SyntaxFault(source, "unterminated comment", at)
            m = _TOKEN.match(source, at)
            kind, text = m.lastgroup, m.group()
            if kind == ID:
                value = last == "." or text not in BEFORE_VALUE
            elif kind == STR:
                value = True
            elif text in "\"'":
                raise SyntaxFault(source, "unterminated string", at)
            elif text == "`":
                stack.append(("`", JS, True, at))
                mode, at = TEMPLATE, at + 1
                continue
            elif text == "/" and not value and (r := _REGEX.match(source, at)):
                out.append((VALUE, "/"))
                last, value, at = "/", True, r.end()
                continue
            elif text == "<" and not value and last != "}" and (t := _TAG.match(source, at)) and not _is_generic(source, at):
                stack.append(("<", JS, True, at))
                mode, at = (CHILD if t[1] == ">" else TAG), t.end()
                continue
            elif text in ("(", "[", "{"):
                ends_value = not (last in CONDITIONS if text == "(" else text == "{" and (value or last in ("", ";", "{", "}", "=>", "else", "do")))
                stack.append((text, JS, ends_value, at))
                value = False
            elif text in CLOSING:
                if not stack or stack[-1][0] != CLOSING[text]:
                    raise SyntaxFault(source, f"unexpected {text}", at)
                _, mode, value, _ = stack.pop()
                if mode != JS:
                    value = True
            else:
                value = text in ("++", "--")
            out.append((kind, text))
            last, at = text, m.end()
        elif mode == TEMPLATE:
            at = _TEMPLATE.match(source, at).end()
            if at >= end or source[at] == "\\":
                break
            if source[at] == "`":
                stack.pop()
                out.append((VALUE, "`"))
                mode, at, value, last = JS, at + 1, True, "`"
            else:
                stack.append(("{", TEMPLATE, False, at))
                out.append((P, "${"))
                mode, at, value, last = JS, at + 2, False, "{"
        elif mode == TAG:
            at = _IN_TAG.match(source, at).end()
            if source.startswith("/>", at):
                mode, at = _closed(stack, out), at + 2
                value, last = True, ">"
            elif source.startswith(">", at):
                mode, at = CHILD, at + 1
            elif source.startswith("{", at):
                stack.append(("{", TAG, False, at))
                out.append((P, "{"))
                mode, at, value, last = JS, at + 1, False, "{"
            elif m := _TYPE_ARGUMENTS.match(source, at):
                at = m.end()
            elif at < end:
                raise SyntaxFault(source, f"unexpected {source[at]} in a tag", at)
        else:
            at = _TEXT.match(source, at).end()
            if source.startswith("</", at):
                stop = source.find(">", at)
                if stop < 0:
                    break
                mode, at = _closed(stack, out), stop + 1
                value, last = True, ">"
            elif source.startswith("<", at):
                if not (t := _TAG.match(source, at)):
                    raise SyntaxFault(source, "unexpected < in JSX", at)
                stack.append(("<", CHILD, True, at))
                mode, at = (CHILD if t[1] == ">" else TAG), t.end()
            elif source.startswith("{", at):
                stack.append(("{", CHILD, False, at))
                out.append((P, "{"))
                mode, at, value, last = JS, at + 1, False, "{"
    if stack:
        raise SyntaxFault(source, f"unterminated {stack[-1][0]}", stack[-1][3])
    return out


def _is_generic(source: str, at: int) -> bool:
    """Whether ``<`` at a value's place begins type parameters of an arrow function and no element."""
    m = _GENERIC.match(source, at)
    return m is not None and f"</{m[1]}" not in source[m.end():]


def _closed(stack: list[tuple], out: list[Token]) -> str:
    _, mode, _, _ = stack.pop()
    if mode == JS:
        out.append((VALUE, "<>"))
    return mode


class Reader:
    """Import records of a file's tokens, in source order."""

    def __init__(self, found: list[Token]):
        self.t = [*found, (P, ""), (P, ""), (P, ""), (P, "")]
        self.n = len(found)
        self.bound: dict[int, list[str]] = {}  # of a require, by its place
        self.records: list[dict] = []

    def is_(self, i: int, *texts: str) -> bool:
        return self.t[i][0] in (ID, P) and self.t[i][1] in texts

    def name(self, i: int) -> str:
        kind, text = self.t[i]
        return unquoted(text) if kind == STR else text

    def add(self, literal: int, kind: str, symbols: list[str]) -> None:
        value = unquoted(self.t[literal][1])
        if value or kind == "require":
            self.records.append({"specifier": value, "level": 0, "type": kind, "symbols": symbols})

    def read(self) -> list[dict]:
        depth, declaring = 0, set()
        for i in range(self.n):
            kind, text = self.t[i]
            if kind == P:
                if text in ("(", "[", "{", "${"):
                    depth += 1
                elif text in CLOSING:
                    declaring.discard(depth)
                    depth -= 1
                elif text == ";":
                    declaring.discard(depth)
                elif text == "," and depth in declaring:
                    self.declarator(i + 1)
            elif kind == ID and not (i and self.t[i - 1] == (P, ".")):
                if text in STATEMENTS and i and self.t[i - 1][0] != P:
                    declaring.discard(depth)
                if text in ("const", "let", "var") and (self.t[i + 1][0] == ID or self.is_(i + 1, "{", "[")):
                    declaring.add(depth)
                    self.declarator(i + 1)
                elif text == "import":
                    self.imported(i)
                elif text == "export":
                    self.exported(i)
                elif text == "require" and self.is_literal_call(i) and not self.is_(i - 1, "new") and not self.is_reference(i):
                    self.add(i + 2, "require", self.bound.get(i, []))
        return self.records

    def is_literal_call(self, i: int) -> bool:
        return self.is_(i + 1, "(") and self.t[i + 2][0] == STR and self.is_(i + 3, ")", ",")

    def is_reference(self, i: int) -> bool:
        """``import name = require(...)`` is no call."""
        return i >= 3 and self.is_(i - 1, "=") and self.is_(i - 3, "import") or i >= 4 and self.is_(i - 1, "=") and self.is_(i - 3, "type") and self.is_(i - 4, "import")

    def past(self, i: int) -> int:
        """The place after the bracket that closes the one at ``i``."""
        depth = 0
        while i < self.n:
            if self.is_(i, "(", "[", "{", "${"):
                depth += 1
            elif self.is_(i, ")", "]", "}"):
                depth -= 1
                if not depth:
                    return i + 1
            i += 1
        return self.n

    def declarator(self, i: int) -> None:
        """Note what a require is bound to, if it is all of the declared value."""
        if self.is_(i, "{", "["):
            stop = self.past(i)
            names = self.keys(i + 1, stop - 1) if self.is_(i, "{") else []
        elif self.t[i][0] == ID:
            stop, names = i + 1, [self.t[i][1]]
        else:
            return
        if self.is_(stop, "!"):
            stop += 1
        if self.is_(stop, ":"):
            angles = 0
            while stop < self.n and not (not angles and self.is_(stop, "=", ",", ";", ")", "of", "in")):
                if self.is_(stop, "(", "[", "{"):
                    stop = self.past(stop)
                    continue
                angles += self.is_(stop, "<") - self.is_(stop, ">")
                stop += 1
        call = stop + 1
        if self.is_(stop, "=") and self.is_(call, "require") and self.is_literal_call(call):
            after = self.past(call + 1)
            kind, text = self.t[after]
            goes_on = text in ("as", "satisfies", "instanceof", "in") if kind == ID else kind == VALUE or kind == P and text != "" and text not in ",;)]}"
            if not goes_on:
                self.bound[call] = names

    def keys(self, i: int, stop: int) -> list[str]:
        out = []
        while i < stop:
            if not self.is_(i, "..."):
                key = i + 1 if self.is_(i, "[") else i
                if self.t[key][0] in (ID, STR) and self.name(key) not in ("", "0"):
                    out.append(self.name(key))
            while i < stop and not self.is_(i, ","):
                i = self.past(i) if self.is_(i, "(", "[", "{") else i + 1
            i += 1
        return out

    def names(self, i: int) -> tuple[list[str], int]:
        """Source-side names of the braces at ``i``, and the place behind them."""
        stop, out = self.past(i), []
        i += 1
        while i < stop - 1:
            if self.is_(i, "type") and self.t[i + 1][0] in (ID, STR) and (not self.is_(i + 1, "as") or self.is_(i + 2, "as") and self.t[i + 3][0] == ID):
                i += 1
            out.append(self.name(i))
            while i < stop - 1 and not self.is_(i, ","):
                i += 1
            i += 1
        return out, stop

    def imported(self, i: int) -> None:
        if self.is_(i + 1, "("):
            if self.is_literal_call(i) and not (i and self.is_(i - 1, "typeof", "keyof", "as", "satisfies", "<")):
                self.add(i + 2, "import", [])
            return
        if self.t[i + 1][0] == STR:
            self.add(i + 1, "import", [])
            return
        j, symbols = i + 1, []
        if self.is_(j, "type") and not self.is_(j + 1, ",") and not (self.is_(j + 1, "from") and self.t[j + 2][0] == STR):
            j += 1
        if self.t[j][0] == ID:
            symbols.append("default")
            j += 1
            if self.is_(j, ","):
                j += 1
        if self.is_(j, "*") and self.is_(j + 1, "as"):
            symbols.append("*")
            j += 3
        elif self.is_(j, "{"):
            named, j = self.names(j)
            symbols += named
        if self.is_(j, "from") and self.t[j + 1][0] == STR:
            self.add(j + 1, "import", symbols)

    def exported(self, i: int) -> None:
        j = i + 2 if self.is_(i + 1, "type") and self.is_(i + 2, "{", "*") else i + 1
        if self.is_(j, "*"):
            symbols, j = ["*"], j + 3 if self.is_(j + 1, "as") else j + 1
        elif self.is_(j, "{"):
            symbols, j = self.names(j)
        else:
            return
        if self.is_(j, "from") and self.t[j + 1][0] == STR:
            self.add(j + 1, "re-export", symbols)


def parse_source(source: str | None) -> tuple[str | None, list[dict]]:
    """(error, import records) of one file."""
    if source is None:
        return "read failed", []
    try:
        return None, Reader(tokens(source)).read()
    except SyntaxFault as exc:
        return f"parse failed: SyntaxError: {exc}", []


def parse_batch(content: pd.Series) -> pd.DataFrame:
    rows = [parse_source(text) for text in content]
    return pd.DataFrame({"error": [r[0] for r in rows], "imports": [r[1] for r in rows]})
