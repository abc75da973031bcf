"""Reads CREATE TABLE statements: a lexer, and a walk over the tokens of one schema text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

#: Blanks and comments, quoted pieces (a doubled or escaped quote does not end one), words, single marks.
LEXER = re.compile(
    r"""(?P<blank>\s+|(?:--|\#)[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<quoted>`(?:[^`]|``)*`|"(?:[^"\\]|""|\\.)*"|'(?:[^'\\]|''|\\.)*')
    |(?P<word>[\w$]+)
    |(?P<mark>.)""",
    re.S | re.X,
)
TABLE_LEVEL = {"PRIMARY", "FOREIGN", "UNIQUE", "KEY", "INDEX", "CHECK", "CONSTRAINT", "FULLTEXT", "SPATIAL"}


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int

    def name(self) -> str:
        """The identifier without its quotes."""
        if self.kind != "quoted":
            return self.text
        mark = self.text[0]
        return self.text[1:-1].replace(mark * 2, mark).strip()

    def word(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


class Entry(NamedTuple):
    """One name of a table: a column, a part of a key or unique constraint, or of a link."""

    owner: str
    table: str
    kind: str
    ordinal: int
    part: int
    name: str
    definition: str | None = None
    ref_table: str | None = None
    ref_column: str | None = None


def tokens(text: str) -> list[Token]:
    return [Token(m.lastgroup, m.group(), *m.span()) for m in LEXER.finditer(text) if m.lastgroup != "blank"]


def dotted(part: list[Token], at: int) -> tuple[list[str], int]:
    """The names of ``a.b.c`` from a place on, and the place behind them."""
    names = []
    while at < len(part) and part[at].kind in ("quoted", "word"):
        names.append(part[at].name())
        at += 1
        if at == len(part) or part[at].text != ".":
            break
        at += 1
    return names, at


def closing(part: list[Token], at: int) -> int:
    """The place of the bracket that closes the one at ``at``; the end if none does."""
    depth = 0
    for i in range(at, len(part)):
        depth += {"(": 1, ")": -1}.get(part[i].text, 0)
        if not depth:
            return i
    return len(part)


def listed(part: list[Token], at: int) -> tuple[list[str], int]:
    """The leading names of a bracketed list that starts at or after ``at``, and the place behind it."""
    while at < len(part) and part[at].text != "(":
        at += 1
    end = closing(part, at)
    return [item[0].name() for item in separated(part[at + 1 : end]) if item], end + 1


def separated(part: list[Token]) -> Iterator[list[Token]]:
    """The items between commas outside of brackets."""
    start = depth = 0
    for i, token in enumerate(part):
        depth += {"(": 1, ")": -1}.get(token.text, 0)
        if token.text == "," and not depth:
            yield part[start:i]
            start = i + 1
    yield part[start:]


def entries_of(item: list[Token], text: str) -> Iterator[tuple]:
    """(kind, part, name, definition, ref_table, ref_column) of one item of a table's body."""
    at = 0
    if item[0].word() == "CONSTRAINT":
        at = 1 if len(item) > 1 and item[1].word() in TABLE_LEVEL else 2
    kind = item[at].word() if at < len(item) else ""
    following = item[at + 1].word() if at + 1 < len(item) else ""
    if kind == "FOREIGN" and following == "KEY":
        own, at = listed(item, at)
        if at >= len(item) or item[at].word() != "REFERENCES":
            return
        target, at = dotted(item, at + 1)
        other, _ = listed(item, at)
        for part, (name, column) in enumerate(zip(own, other)):
            yield "link", part, name, None, target[-1] if target else None, column
    elif (kind == "PRIMARY" and following == "KEY") or kind == "UNIQUE":
        names, _ = listed(item, at)
        for part, name in enumerate(names):
            yield "key" if kind == "PRIMARY" else "unique", part, name, None, None, None
    elif kind not in TABLE_LEVEL and len(item) > 1:
        yield "column", 0, item[0].name(), text[item[1].start : item[-1].end], None, None


def tables(text: str) -> Iterator[Entry]:
    """The entries of all ``CREATE TABLE owner.table (...)`` statements of a schema text, in order."""
    every = tokens(text)
    at = 0
    while at < len(every):
        if every[at].word() != "CREATE":
            at += 1
            continue
        at += 1
        while at < len(every) and every[at].word() in ("TEMPORARY", "OR", "REPLACE"):
            at += 1
        if at == len(every) or every[at].word() != "TABLE":
            continue
        at += 1
        while at < len(every) and every[at].word() in ("IF", "NOT", "EXISTS"):
            at += 1
        names, at = dotted(every, at)
        if len(names) != 2 or at == len(every) or every[at].text != "(":
            continue
        end = closing(every, at)
        items = (item for item in separated(every[at + 1 : end]) if item)
        for ordinal, item in enumerate(items):
            for kind, part, *rest in entries_of(item, text):
                yield Entry(names[0], names[1], kind, ordinal, part, *rest)
        at = end + 1
