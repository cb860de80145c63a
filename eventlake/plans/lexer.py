"""Tokens of a statement, and cutting them at clauses and commas outside brackets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from eventlake.errors import ParseError

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<string>'(?:[^'\\]|''|\\.)*')
      | (?P<name>`[^`]+`|"[^"]+"|[A-Za-z_][A-Za-z0-9_]*|\$(?:\.[A-Za-z0-9_]+)+|\$)
      | (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?:(?:BD|[LSYDF])\b)?)
      | (?P<mark>->>|->|<=>|<=|>=|<>|!=|\|\||::|[-+*/%(),.<>=;\[\]?:{}])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str

    @property
    def word(self) -> str:
        """The text in capitals, if it is an unquoted name."""
        return self.text.upper() if self.kind == "name" and self.text[0] not in '`"' else ""


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ParseError(f"unexpected character {sql[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m.group()))
        at = m.end()
    return out


def statements(tokens: list[Token]) -> list[list[Token]]:
    """Tokens of each statement between semicolons."""
    out: list[list[Token]] = [[]]
    for t in tokens:
        if t.text == ";":
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


def depth_after(depth: int, token: Token) -> int:
    return depth + (token.text in ("(", "[") and token.kind == "mark") - (token.text in (")", "]") and token.kind == "mark")


def split(tokens: list[Token], mark: str = ",", words: tuple[str, ...] = ()) -> list[list[Token]]:
    """Parts between marks (or words) outside brackets."""
    out, depth = [[]], 0
    for t in tokens:
        depth = depth_after(depth, t)
        if depth == 0 and ((not words and t.text == mark and t.kind == "mark") or t.word in words):
            out.append([])
        else:
            out[-1].append(t)
    if depth:
        raise ParseError("brackets don't match")
    return out


def conjuncts(tokens: list[Token]) -> list[list[Token]]:
    """Conditions that AND joins outside brackets, BETWEEN .. AND and CASE .. END; one, if an OR stands beside them."""
    out, depth, cases, between = [[]], 0, 0, 0
    for t in tokens:
        depth = depth_after(depth, t)
        cases += (t.word == "CASE") - (t.word == "END")
        top = depth == 0 and cases == 0
        if top and t.word == "OR":
            return [tokens]
        if top and t.word == "AND" and not between:
            out.append([])
            continue
        between += top * ((t.word == "BETWEEN") - (t.word == "AND"))
        out[-1].append(t)
    if depth:
        raise ParseError("brackets don't match")
    parts = []
    for part in out:
        whole = len(part) > 2 and part[0].text == "(" and closing(part, 0) == len(part) - 1
        parts += conjuncts(part[1:-1]) if whole else [part]
    return parts


def clauses(tokens: list[Token], heads: tuple[str, ...]) -> dict[str, list[Token]]:
    """Tokens after each head word outside brackets; heads may have two words (GROUP BY)."""
    out: dict[str, list[Token]] = {}
    current, depth, i = None, 0, 0
    while i < len(tokens):
        t = tokens[i]
        two = f"{t.word} {tokens[i + 1].word}" if i + 1 < len(tokens) else ""
        head = two if two in heads else t.word if t.word in heads else None
        if head == "OFFSET" and (i + 1 == len(tokens) or tokens[i + 1].kind != "number"):
            head = None  # the column
        if depth == 0 and head:
            if head in out:
                raise ParseError(f"{head} stands twice")
            current = out.setdefault(head, [])
            i += 1 + (head == two)
            continue
        depth = depth_after(depth, t)
        if current is None:
            raise ParseError(f"unexpected {t.text}")
        current.append(t)
        i += 1
    return out


def closing(tokens: list[Token], at: int) -> int:
    """Index of the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(tokens)):
        depth = depth_after(depth, tokens[i])
        if depth == 0:
            return i
    raise ParseError("brackets don't match")


def join(tokens: list[Token]) -> str:
    return " ".join(t.text for t in tokens)


def unquote(token: Token) -> str:
    if token.kind == "string":
        return re.sub(r"\\(.)", r"\1", token.text[1:-1].replace("''", "'"))
    return token.text.strip('`"')
