"""Lowering of the engine's SELECT dialect to Spark SQL.

A SELECT over topics may use JSON paths (``json_extract(value, '$.p')``, ``value->>'p'``, ``'$.p'`` or a bare payload field), time
windows in GROUP BY, TABLE(topic) joins, statistical columns and vector functions. Everything else in an expression is left as Spark
SQL. Typed reads of JSON follow their context: numbers beside numbers, texts beside texts, text elsewhere.

WHERE is cut at its outer ANDs. Conditions that name a statistic come last, and their statistics are over the rows that pass the
others; an OR with a statistic on either side is one such condition.

The result is one SQL text over views, so that Catalyst sees the whole query. Payloads are parsed once for all typed reads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from eventlake.errors import InvalidQuery, ParseError
from eventlake.functions import jsonx, vectors
from eventlake.plans.intervals import interval_ms, timestamp_ms
from eventlake.plans.lexer import Token, clauses, closing, conjuncts, join, split, tokenize, unquote

HEADS = ("SELECT", "FROM", "WHERE", "GROUP BY", "HAVING", "ORDER BY", "LIMIT", "OFFSET")
AGGREGATES = {"COUNT", "SUM", "AVG", "MEAN", "MIN", "MAX", "FIRST", "FIRST_VALUE", "LAST", "LAST_VALUE", "APPROX_COUNT_DISTINCT"}
ROW_STATS = {"AVG", "MEAN", "STDDEV", "STD", "ZSCORE", "ANOMALY", "MOVING_AVG"}
VECTORS = {"COSINE_SIMILARITY", "EUCLIDEAN_DISTANCE", "DOT_PRODUCT", "VECTOR_NORM", "L2_NORM"}
WINDOWS = {"TUMBLE", "HOP", "SESSION"}
COMPARISONS = {"=", "<", ">", "<=", ">=", "<>", "!=", "<=>"}
KEYWORDS = {
    "AND", "OR", "NOT", "IN", "IS", "NULL", "LIKE", "RLIKE", "BETWEEN", "TRUE", "FALSE", "CASE", "WHEN", "THEN", "ELSE", "END", "AS", "ASC",
    "DESC", "NULLS", "FIRST", "LAST", "DISTINCT", "CAST", "INTERVAL", "DATE", "TIMESTAMP", "BIGINT", "INT", "DOUBLE", "STRING", "BOOLEAN", "OVER",
    "PARTITION", "BY", "ORDER", "ROWS", "RANGE", "UNBOUNDED", "PRECEDING", "FOLLOWING", "CURRENT", "ROW", "ESCAPE", "ALL", "FILTER", "WHERE",
}


@dataclass
class Side:
    """A table of the FROM clause."""

    topic: str
    alias: str
    columns: list[str]
    latest: bool = False


@dataclass
class Lowering:
    """State of one query."""

    sides: list[Side]
    stats: dict[str, str] = field(default_factory=dict)
    grouped: bool = False
    windowed: bool = False
    #: rows of the longest moving average
    moving: int = 0

    def prefix(self, side: Side | None) -> str:
        return f"{side.alias}." if len(self.sides) > 1 and side else ""

    def side(self, name: str) -> Side | None:
        return next((s for s in self.sides if name.lower() in (s.alias.lower(), s.topic.lower())), None)


@dataclass
class Json:
    """A JSON path of a side's payload."""

    path: str
    prefix: str = ""

    def text(self) -> str:
        return jsonx.text_sql(self.path, f"{self.prefix}value")

    def num(self) -> str:
        return jsonx.num_sql(self.path, f"{self.prefix}{jsonx.PARSED}")

    def string(self) -> str:
        return jsonx.str_sql(self.path, f"{self.prefix}{jsonx.PARSED}")

    def boolean(self) -> str:
        return jsonx.bool_sql(self.path, f"{self.prefix}{jsonx.PARSED}")

    def null(self) -> str:
        return jsonx.null_sql(self.path, f"{self.prefix}{jsonx.PARSED}")

    def vector(self) -> str:
        return jsonx.vector_sql(self.path, f"{self.prefix}value")


def is_dialect(tokens: list[Token]) -> bool:
    """Whether the dialect covers the statement: one SELECT, without subqueries, set operations, window functions or lambdas."""
    if not tokens or tokens[0].word != "SELECT":
        return False
    words = [t.word for t in tokens]
    if any(t.text == "->" for t in _arrows(tokens)):
        return False
    return words.count("SELECT") == 1 and not {"UNION", "INTERSECT", "EXCEPT", "OVER", "LATERAL", "QUALIFY", "ROLLUP", "CUBE", "GROUPING"} & set(words)


def _arrows(tokens: list[Token]) -> list[Token]:
    """value->'a'->>'b' as json_extract(value, '$.a.b'). An arrow before anything but a text, or a number after the payload, is a lambda's."""
    out: list[Token] = []
    i = 0

    def arrow(at: int) -> bool:
        step = at + 1 < len(tokens) and tokens[at].text in ("->", "->>")
        return step and (tokens[at + 1].kind == "string" or tokens[at + 1].kind == "number" and tokens[i].text.lower() == "value")

    while i < len(tokens):
        if tokens[i].kind == "name" and arrow(i + 1):
            path, j = "$", i + 1
            while arrow(j):
                path += "." + unquote(tokens[j + 1]).lstrip("$").lstrip(".")
                j += 2
            start = [Token("name", "json_extract"), Token("mark", "(")]
            qualifier = out[-2:] if len(out) > 1 and out[-1].text == "." else []
            if qualifier:
                del out[-2:]
            out += [*start, *qualifier, tokens[i], Token("mark", ","), Token("string", jsonx.literal(path)), Token("mark", ")")]
            i = j
        else:
            out.append(tokens[i])
            i += 1
    return out


class Rewriter:
    """Rewrites expressions. Atoms are SQL text or a Json path, whose reading is chosen by what stands beside it."""

    def __init__(self, state: Lowering, schema: Callable[[str], list[str]], known: set[str] = frozenset()):
        self.state, self.schema, self.known = state, schema, known

    def sql(self, tokens: list[Token], kind: str = "text") -> str:
        """SQL of an expression; kind says how lone JSON paths are read (text or num)."""
        atoms = self.atoms(tokens)
        out: list[str] = []
        for i, a in enumerate(atoms):
            out.append(a if isinstance(a, str) else self.read(atoms, i, kind))
        return " ".join(x for x in out if x)

    def read(self, atoms: list, i: int, kind: str) -> str:
        """A path's reading, by the operator and the operand beside it."""
        path: Json = atoms[i]
        after = atoms[i + 1 : i + 6]
        before = atoms[max(0, i - 2) : i][::-1]
        words = [x.upper() if isinstance(x, str) else "" for x in after]
        if words[:1] == ["IS"]:
            return path.text()
        for near in (after, before):
            if len(near) > 1 and isinstance(near[0], str) and near[0].upper() in (*COMPARISONS, "BETWEEN", "IN", "NOT", "LIKE", "RLIKE"):
                op = near[0].upper()
                operand = next((x for x in near[1:] if not (isinstance(x, str) and x.upper() in ("(", "IN", "BETWEEN", "LIKE", "RLIKE", "-", "+"))), near[1])
                if op in ("LIKE", "RLIKE") or (op == "NOT" and words[1:2] in (["LIKE"], ["RLIKE"])):
                    return path.text()
                if isinstance(operand, Json):
                    return path.text()
                text = operand.upper()
                if text == "NULL" and op == "=":
                    # a missing field equals NULL, if the payload is JSON: both operands become booleans
                    at = i + 2 if near is after else i - 2
                    atoms[at] = "true"
                    return path.null()
                if operand.startswith("'"):
                    return path.string()
                if text in ("TRUE", "FALSE"):
                    return path.boolean()
                return path.num()
        beside = [x for x in (atoms[i - 1] if i else None, atoms[i + 1] if i + 1 < len(atoms) else None) if isinstance(x, str)]
        if any(x in ("+", "-", "*", "/", "%") for x in beside):
            return path.num()
        return path.num() if kind == "num" else path.text()

    def atoms(self, tokens: list[Token]) -> list:
        out, i, quoted_time = [], 0, False
        while i < len(tokens):
            t = tokens[i]
            call = i + 1 < len(tokens) and tokens[i + 1].text == "(" and t.kind == "name"
            if call and t.word not in ("IN", "AND", "OR", "NOT", "AS", "WHEN", "THEN", "ELSE", "FILTER", "OVER"):
                end = closing(tokens, i + 1)
                out.append(self.call(t.text, tokens[i + 2 : end]))
                i = end + 1
            elif t.kind == "name" and t.text[0] == "$":
                out.append(Json(t.text))
                i += 1
            elif t.kind == "name" and i + 2 < len(tokens) and tokens[i + 1].text == "." and tokens[i + 2].kind in ("name",) or (t.kind == "name" and i + 2 < len(tokens) and tokens[i + 1].text == "." and tokens[i + 2].text == "*"):
                out.append(self.qualified(t, tokens[i + 2]))
                i += 3
            elif t.kind == "name" and t.word not in KEYWORDS or t.word in ("PARTITION", "TIMESTAMP") and not (i + 1 < len(tokens) and (tokens[i + 1].kind == "string" or tokens[i + 1].word == "BY")):
                out.append(self.name(unquote(t)))
                i += 1
            elif t.kind == "string":
                out.append(self.string(t, out))
                i += 1
            else:
                out.append(t.text)
                i += 1
        return out

    def string(self, t: Token, before: list) -> str:
        """A text; beside the envelope's timestamp it is a time."""
        text = unquote(t)
        recent = [x for x in before[-4:] if isinstance(x, str)]
        if any(x.rpartition(".")[2].strip("`") == "timestamp" for x in recent):
            ms = timestamp_ms(text)
            if ms is None:
                raise InvalidQuery(f"no time: {text!r}")
            return f"{ms}L"
        return jsonx.literal(text)

    def name(self, name: str):
        if name in self.known:
            return f"`{name}`"
        for side in self.state.sides:
            if name.lower() in side.columns:
                return f"{self.state.prefix(side)}`{name.lower()}`"
        side = self.state.sides[0]
        if "value" not in side.columns:
            return f"`{name}`"
        return Json(f"$.{name}", self.state.prefix(side))

    def qualified(self, table: Token, column: Token):
        side = self.state.side(unquote(table))
        if side is None:
            return f"`{unquote(table)}`.`{unquote(column)}`"
        if column.text == "*":
            return f"{self.state.prefix(side)}*"
        name = unquote(column).lower()
        if name in side.columns or "value" not in side.columns:
            return f"{self.state.prefix(side)}`{name}`"
        return Json(f"$.{unquote(column)}", self.state.prefix(side))

    def json_of(self, tokens: list[Token]) -> Json | None:
        """The path that an argument names: json_extract(..), '$.p', $.p or a payload field."""
        if len(tokens) == 1 and tokens[0].kind == "string" and unquote(tokens[0]).startswith("$"):
            return Json(unquote(tokens[0]), self.state.prefix(self.state.sides[0]))
        atoms = self.atoms(tokens)
        return atoms[0] if len(atoms) == 1 and isinstance(atoms[0], Json) else None

    def call(self, name: str, args: list[Token]):
        word, parts = name.upper(), split(args) if args else []
        if word == "JSON_EXTRACT":
            if len(parts) != 2 or len(parts[1]) != 1 or parts[1][0].kind != "string":
                raise InvalidQuery("json_extract takes a column and a path")
            column = parts[0]
            side = self.state.side(unquote(column[0])) if len(column) == 3 else self.state.sides[0]
            return Json(unquote(parts[1][0]), self.state.prefix(side))
        if word in VECTORS:
            return self.vector(word, parts)
        if word in ROW_STATS and not self.state.grouped:
            return self.stat(word, parts)
        if word in AGGREGATES:
            return self.aggregate(word, parts)
        if word in WINDOWS and self.state.windowed:
            return "window_start"
        if word in ("CAST", "TRY_CAST"):
            return f"{name}({self.sql(args)})"
        return f"{name}({', '.join(self.sql(p) for p in parts)})"

    def number(self, tokens: list[Token]) -> str:
        """An argument as a number. A bare name is a payload field, also where the envelope has a text column of that name."""
        if len(tokens) == 1 and unquote(tokens[0]).lower() in ("key", "value", "topic") and "value" in self.state.sides[0].columns:
            path = Json(f"$.{unquote(tokens[0])}", self.state.prefix(self.state.sides[0]))
        else:
            path = self.json_of(tokens)
        return path.num() if path else f"try_cast({self.sql(tokens, 'num')} AS DOUBLE)"

    def aggregate(self, word: str, parts: list[list[Token]]) -> str:
        first = parts[0] if parts else []
        distinct = bool(first) and first[0].word == "DISTINCT"
        arg = first[1:] if distinct else first
        star = len(arg) == 1 and arg[0].text == "*"
        if word in ("COUNT", "APPROX_COUNT_DISTINCT"):
            call = "count" if word == "COUNT" else "approx_count_distinct"
            if star:
                inner = "struct(topic, `partition`, `offset`)" if distinct else "*"
            else:
                path = self.json_of(arg)
                inner = path.text() if path else self.sql(arg)
            if distinct and not star and not self.json_of(arg):
                inner = f"coalesce(cast({inner} AS STRING), '')"
            return f"{call}({'DISTINCT ' if distinct else ''}{inner})"
        if word in ("FIRST", "FIRST_VALUE", "LAST", "LAST_VALUE"):
            path = self.json_of(arg)
            value = path.text() if path else self.sql(arg)
            pick, p = ("min_by" if word.startswith("FIRST") else "max_by"), self.state.prefix(self.state.sides[0])
            return f"{pick}(struct({value} AS v), struct({p}`timestamp`, {p}`partition`, {p}`offset`)).v"
        number = self.number(arg)
        if distinct:
            number = "DISTINCT " + number
        if word == "SUM":
            return f"coalesce(sum({number}), 0D)"
        return f"{'avg' if word == 'MEAN' else word.lower()}({number})"

    def stat(self, word: str, parts: list[list[Token]]) -> str:
        """A statistical column: what it needs from all rows becomes a column of a single row that is joined."""
        if not parts:
            raise InvalidQuery(f"{word} takes a path")
        x = self.number(parts[0])
        extra = float(unquote(parts[1][0])) if len(parts) > 1 and parts[1] else None
        if word == "MOVING_AVG":
            n = 10 if extra is None else int(extra)
            if n < 1:
                raise InvalidQuery("MOVING_AVG takes at least one row")
            self.state.moving = max(self.state.moving, n)
            return f"avg({x}) OVER ({{moving_order}} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        mean = self.stats.setdefault(f"coalesce(avg({x}), 0D)", f"__s{len(self.stats)}")
        if word in ("AVG", "MEAN"):
            return mean
        sd = self.stats.setdefault(f"CASE WHEN count({x}) < 2 THEN 0D ELSE stddev_pop({x}) END", f"__s{len(self.stats)}")
        if word in ("STDDEV", "STD"):
            return sd
        z = f"(CASE WHEN {sd} = 0 THEN 0D ELSE (coalesce({x}, 0D) - {mean}) / {sd} END)"
        return z if word == "ZSCORE" else f"(abs({z}) > {2.0 if extra is None else extra}D)"

    @property
    def stats(self) -> dict[str, str]:
        return self.state.stats

    def vector(self, word: str, parts: list[list[Token]]) -> str:
        def one(tokens: list[Token]) -> str:
            if tokens and tokens[0].word == "ARRAY":
                return "array(" + ", ".join(f"{float(join(p).replace(' ', ''))!r}D" for p in split(tokens[2:-1])) + ")"
            if len(tokens) == 1 and tokens[0].kind == "string" and not unquote(tokens[0]).startswith("$"):
                body = unquote(tokens[0]).strip().strip("[]").strip()
                if not body:
                    raise InvalidQuery("a vector can't be empty")
                try:
                    return "array(" + ", ".join(f"{float(v)!r}D" for v in body.split(",")) + ")"
                except ValueError:
                    raise InvalidQuery(f"no vector: {body!r}") from None
            path = self.json_of(tokens)
            return f"({path.vector()})" if path else f"cast({self.sql(tokens)} AS ARRAY<DOUBLE>)"

        if len(parts) != (1 if word in ("VECTOR_NORM", "L2_NORM") else 2):
            raise InvalidQuery(f"{word}: wrong number of arguments")
        call = {"COSINE_SIMILARITY": vectors.cosine_sql, "EUCLIDEAN_DISTANCE": vectors.euclidean_sql, "DOT_PRODUCT": vectors.dot_sql}.get(word, vectors.norm_sql)
        return f"({call(*map(one, parts))})"


def _alias(tokens: list[Token]) -> tuple[list[Token], str | None]:
    """An item without its alias, and the alias."""
    if len(tokens) > 2 and tokens[-2].word == "AS":
        return tokens[:-2], unquote(tokens[-1])
    plain = len(tokens) > 1 and tokens[-1].kind == "name" and tokens[-1].word not in KEYWORDS and tokens[-1].text[0] != "$"
    if plain and (tokens[-2].text == ")" or tokens[-2].kind in ("string", "number") or (tokens[-2].kind == "name" and tokens[-2].word not in KEYWORDS)):
        return tokens[:-1], unquote(tokens[-1])
    return tokens, None


def _call_name(tokens: list[Token]) -> str:
    """The function, if the whole expression is one call."""
    if len(tokens) > 2 and tokens[1].text == "(" and closing(tokens, 1) == len(tokens) - 1:
        return tokens[0].word
    return ""


def _path_of(tokens: list[Token]) -> str | None:
    for t in tokens:
        if t.kind == "string" and unquote(t).startswith("$"):
            return unquote(t)
        if t.kind == "name" and t.text[0] == "$":
            return t.text
    return None


def column_name(path: str) -> str:
    return "_".join(jsonx.segments(path))


def default_name(tokens: list[Token], index: int) -> str | None:
    """The name of an item without an alias; None leaves it to Spark."""
    word = _call_name(tokens)
    if word in ("FIRST_VALUE", "LAST_VALUE", "MEAN"):
        word = {"FIRST_VALUE": "FIRST", "LAST_VALUE": "LAST", "MEAN": "AVG"}[word]
    if word in ROW_STATS | VECTORS and index < 0:
        path = _path_of(tokens) or "$." + "".join(t.text for t in split(tokens[2:-1])[0])
        extra = split(tokens[2:-1])[1:2] if word in ("MOVING_AVG", "ANOMALY") else []
        return f"{word.lower()}({path}{', ' + join(extra[0]) if extra else ''})"
    if word in AGGREGATES:
        return f"{'count_distinct' if word == 'COUNT' and tokens[2].word == 'DISTINCT' else word.lower()}_{index}"
    if word == "JSON_EXTRACT":
        return column_name(unquote(split(tokens[2:-1])[1][0]))
    if len(tokens) == 1 and tokens[0].kind == "name":
        return tokens[0].text if tokens[0].text[0] == "$" else unquote(tokens[0])
    if len(tokens) == 3 and tokens[1].text == ".":
        return f"{unquote(tokens[0])}.{unquote(tokens[2])}"
    return None


def _tables(tokens: list[Token], schema: Callable[[str], list[str]]) -> tuple[list[Side], list[tuple[str, list[Token]]]]:
    """The FROM clause: its sides, and for each after the first the kind of join and its condition."""
    sides, joins, i, kind = [], [], 0, None

    def side(part: list[Token]) -> Side:
        latest = part[0].word == "TABLE" and len(part) > 1 and part[1].text == "("
        if latest:
            end = closing(part, 1)
            part, name = part[end + 1 :], part[2:end]
        else:
            name = part[:1]
            part = part[1:]
        if len(name) != 1 or name[0].kind not in ("name",):
            raise ParseError("a topic is expected after FROM")
        part = part[1:] if part and part[0].word == "AS" else part
        if len(part) > 1:
            raise ParseError(f"unexpected {part[1].text}")
        topic = unquote(name[0])
        return Side(topic, unquote(part[0]) if part else topic, schema(topic), latest)

    words = ("JOIN",)
    chunks, depth, current = [], 0, []
    while i < len(tokens):
        t = tokens[i]
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and (t.word in words or t.text == ","):
            lead = []
            while current and current[-1].word in ("INNER", "LEFT", "RIGHT", "FULL", "OUTER", "CROSS", "SEMI", "ANTI"):
                lead.insert(0, current.pop().word)
            chunks.append((kind, current))
            kind = "CROSS" if t.text == "," else " ".join(w for w in lead if w != "OUTER") or "INNER"
            current = []
        else:
            current.append(t)
        i += 1
    chunks.append((kind, current))
    for kind, part in chunks:
        table, *condition = split(part, words=("ON",))
        if not table:
            raise ParseError("a topic is expected after FROM")
        sides.append(side(table))
        if kind:
            if kind != "CROSS" and not condition:
                raise InvalidQuery("a join needs ON")
            joins.append((kind, condition[0] if condition else []))
    return sides, joins


def _source(side: Side, parse: bool) -> str:
    """A side as a subquery: its records, or the last one of each key; with the payload parsed if typed reads need it."""
    extra = f", try_parse_json(value) AS {jsonx.PARSED}" if parse and "value" in side.columns else ""
    if side.latest:
        columns = ", ".join(f"`{c}`" for c in side.columns)
        inner = f"SELECT max_by(struct({columns}), struct(`timestamp`, `partition`, `offset`)) AS r FROM `{side.topic}` WHERE key IS NOT NULL GROUP BY key"
        return f"(SELECT *{extra} FROM (SELECT r.* FROM ({inner})))"
    return f"(SELECT *{extra} FROM `{side.topic}`)"


#: Offsets of a partition that are ranked in one task, and rows over which one task takes moving averages.
SPAN = 1 << 20


def lower(sql: str | list[Token], schema: Callable[[str], list[str]], compat: bool = False, large: bool = False) -> str:
    """Spark SQL of a dialect SELECT. schema gives a topic's columns (or raises); compat leaves out leading hop windows; large says that
    the topic is more than a task should read in order, so that moving averages are taken in spans."""
    tokens = _arrows(tokenize(sql) if isinstance(sql, str) else sql)
    parts = clauses(tokens, HEADS)
    if "SELECT" not in parts or "FROM" not in parts:
        raise ParseError("a query needs SELECT and FROM")
    sides, joins = _tables(parts["FROM"], schema)
    state = Lowering(sides)
    select = parts["SELECT"]
    distinct = bool(select) and select[0].word == "DISTINCT"
    items = [_alias(i) for i in split(select[1:] if distinct else select)]
    if any(not i for i, _ in items):
        raise ParseError("an item of SELECT is empty")
    group = [g for g in split(parts.get("GROUP BY", [])) if g]
    windows = {a: i for i, a in items if a and _call_name(i) in WINDOWS}
    # GROUP BY may name an alias or a place of SELECT
    resolved = []
    for g in group:
        if len(g) == 1 and g[0].kind == "number" and 0 < int(g[0].text) <= len(items):
            g = items[int(g[0].text) - 1][0]
        elif len(g) == 1 and unquote(g[0]) in windows:
            g = windows[unquote(g[0])]
        elif len(g) == 1 and any(a == unquote(g[0]) for _, a in items) and unquote(g[0]).lower() not in sides[0].columns:
            g = next(i for i, a in items if a == unquote(g[0]))
        resolved.append(g)
    window = next((g for g in resolved if _call_name(g) in WINDOWS), None)
    calls = [_call_name(i) for i, _ in items]
    stat_words = {t.word for i, _ in items for t in i} | {t.word for t in parts.get("WHERE", [])}
    # without GROUP BY, all items being aggregates makes one row; otherwise AVG is a column of every row
    state.grouped = bool(group) or (all(c in AGGREGATES for c in calls) and not {"ZSCORE", "ANOMALY", "MOVING_AVG", "STDDEV", "STD"} & stat_words)
    state.windowed = window is not None
    rewrite = Rewriter(state, schema)
    if joins:
        return _join(state, joins, parts, items, rewrite, distinct, resolved, window)

    conditions = conjuncts(parts["WHERE"]) if parts.get("WHERE") else []
    if any("MOVING_AVG" in _calls(c) for c in conditions):
        raise InvalidQuery("MOVING_AVG can't stand in WHERE")
    late = [c for c in conditions if _calls(c) & ROW_STATS]
    where = " AND ".join(f"({rewrite.sql(c)})" for c in conditions if c not in late)
    base = f"SELECT * FROM {_source(sides[0], True)} AS `{sides[0].alias}`" + (f" WHERE {where}" if where else "")
    if state.grouped:
        return _grouped(rewrite, _where_stats(rewrite, base, late), items, resolved, window, parts, distinct, compat)
    return _rows(rewrite, base, items, late, parts, distinct, large)


def _calls(tokens: list[Token]) -> set[str]:
    return {a.word for a, b in zip(tokens, tokens[1:], strict=False) if b.text == "("}


def _where_stats(rewrite: Rewriter, base: str, late: list) -> str:
    """base without the rows that fail conditions on statistics; those are over all rows of base."""
    if not late:
        return base
    rewrite.state.grouped = False
    filters = " AND ".join(f"({rewrite.sql(c)})" for c in late)
    scalars = ", ".join(f"{sql} AS {name}" for sql, name in rewrite.stats.items())
    rewrite.state.grouped, rewrite.state.stats = True, {}
    return f"SELECT /*+ BROADCAST(s) */ b.* FROM ({base}) b CROSS JOIN (SELECT {scalars} FROM ({base})) s WHERE {filters}"


def _rows(rewrite: Rewriter, base: str, items: list, late: list, parts: dict, distinct: bool, large: bool) -> str:
    out, names = [], []
    for tokens, alias in items:
        if len(tokens) == 1 and tokens[0].text == "*":
            columns = rewrite.state.sides[0].columns
            out += [f"`{c}`" for c in columns]
            names += columns
            continue
        name = alias or default_name(tokens, -1)
        out.append(rewrite.sql(tokens) + (f" AS `{name}`" if name else ""))
        names.append(name)
    filters = " AND ".join(f"({rewrite.sql(c)})" for c in late)
    order = _order(rewrite, parts, {a: i for i, a in items if a}, distinct)
    body, spans = ", ".join(out), large and rewrite.state.moving and not order and not late
    body = body.replace("{moving_order}", "PARTITION BY __k ORDER BY __g" if spans else f"ORDER BY {', '.join(order) or '`partition`, `offset`'}")
    tail = (f" ORDER BY {', '.join(order)}" if order else "") + _limit(parts)
    if spans:
        return _in_spans(rewrite, base, body, distinct) + tail
    if rewrite.stats:
        scalars = ", ".join(f"{sql} AS {name}" for sql, name in rewrite.stats.items())
        source = f"(SELECT /*+ BROADCAST(s) */ b.*, s.* FROM base b CROSS JOIN (SELECT {scalars} FROM base) s)"
        return f"WITH base AS ({base}) SELECT {'DISTINCT ' if distinct else ''}{body} FROM {source}" + (f" WHERE {filters}" if filters else "") + tail
    return f"SELECT {'DISTINCT ' if distinct else ''}{body} FROM ({base})" + tail


def _in_spans(rewrite: Rewriter, base: str, body: str, distinct: bool) -> str:
    """Moving averages by (partition, offset), each span of rows in a task of its own. Rows are ranked in spans of offsets, the spans' counts
    are summed up, and spans of ranks get the last rows before them, too."""
    more = rewrite.state.moving - 1
    width = max(SPAN, more)
    scalars = ", ".join(f"{sql} AS {name}" for sql, name in rewrite.stats.items())
    joined = f"SELECT /*+ BROADCAST(s) */ h.*, s.* FROM h CROSS JOIN (SELECT {scalars} FROM base) s" if scalars else "SELECT * FROM h"
    return f"""WITH base AS ({base}),
        r AS (SELECT *, floor(`offset` / {SPAN}) AS __b, row_number() OVER (PARTITION BY `partition`, floor(`offset` / {SPAN}) ORDER BY `offset`) - 1 AS __r FROM base),
        c AS (SELECT `partition` AS __p, __b AS __c, count(*) AS __n FROM r GROUP BY `partition`, __b),
        f AS (SELECT __p, __c, sum(__n) OVER (ORDER BY __p, __c) - __n AS __first FROM c),
        g AS (SELECT r.*, __first + __r AS __g FROM r JOIN f ON `partition` = __p AND __b = __c),
        h AS (SELECT *, explode(if(__g % {width} >= {width - more}, array(__g div {width}, __g div {width} + 1), array(__g div {width}))) AS __k FROM g),
        m AS (SELECT {body}, __k = __g div {width} AS __own FROM ({joined}))
        SELECT {'DISTINCT ' if distinct else ''}* EXCEPT (__own) FROM m WHERE __own"""


def _order(rewrite: Rewriter, parts: dict, aliases: dict[str, list[Token]], distinct: bool = False) -> list[str]:
    """Sort keys; aliases with their items. A payload field sorts by number where it is one, then by text."""
    out = []
    own = rewrite
    rewrite = Rewriter(rewrite.state, rewrite.schema, set(aliases))
    for item in split(parts.get("ORDER BY", [])):
        words = [t.word for t in item]
        cut = next((i for i, w in enumerate(words) if w in ("ASC", "DESC", "NULLS")), len(item))
        expr, how = item[:cut], " ".join(words[cut:])
        if not expr:
            continue
        if len(expr) == 1 and unquote(expr[0]) in aliases:
            item = aliases[unquote(expr[0])]
            path = own.json_of(item) if item and not rewrite.state.grouped and not distinct else None
            if path:
                out += [f"{path.num()} {how}".strip(), f"{path.text()} {how}".strip()]
                continue
            out.append(f"`{unquote(expr[0])}` {how}".strip())
            continue
        path = rewrite.json_of(expr)
        if path:
            out += [f"{path.num()} {how}".strip(), f"{path.text()} {how}".strip()]
        else:
            out.append(f"{rewrite.sql(expr)} {how}".strip())
    return out


def _limit(parts: dict) -> str:
    out = ""
    for head in ("LIMIT", "OFFSET"):
        if head in parts:
            if len(parts[head]) != 1 or not parts[head][0].text.isdigit():
                raise InvalidQuery(f"{head} takes a number")
            out += f" {head} {parts[head][0].text}"
    return out


def window_parts(tokens: list[Token]) -> tuple[str, list[int]]:
    """Kind and milliseconds of a window: TUMBLE(time, size), HOP(time, size, slide), SESSION(time, gap)."""
    args = split(tokens[2:-1])
    kind = tokens[0].word
    if len(args) != (3 if kind == "HOP" else 2):
        raise InvalidQuery(f"{kind}: wrong number of arguments")
    sizes = [interval_ms(a) for a in args[1:]]
    if min(sizes) <= 0:
        raise InvalidQuery("a window can't be empty")
    return kind, sizes


def _grouped(rewrite: Rewriter, base: str, items: list, group: list, window, parts: dict, distinct: bool, compat: bool, from_sql: str | None = None) -> str:
    keys, key_names = [], {}
    time = f"{rewrite.state.prefix(rewrite.state.sides[0])}`timestamp`"
    end = "window_end"
    if window:
        kind, sizes = window_parts(window)
        ts = f"timestamp_millis({time})"
        if kind == "SESSION":
            keys.append(f"session_window({ts}, '{sizes[0]} milliseconds')")
            bounds = f"unix_millis(session_window.start) AS window_start, unix_millis(session_window.end) - {sizes[0]} AS window_end"
        elif kind == "HOP" and sizes[1] > sizes[0]:
            start = f"cast(floor({time} / {sizes[1]}) * {sizes[1]} as bigint)"
            base = f"SELECT * FROM ({base}) WHERE {time} < {start} + {sizes[0]}"
            keys.append(start)
            bounds = f"{start} AS window_start, {start} + {sizes[0]} AS window_end"
        else:
            slide = f", '{sizes[1]} milliseconds'" if kind == "HOP" else ""
            keys.append(f"window({ts}, '{sizes[0]} milliseconds'{slide})")
            bounds = "unix_millis(window.start) AS window_start, unix_millis(window.end) AS window_end"
    columns, names, at = [], [], 0
    plain = []
    for g in group:
        if g is window:
            continue
        path = rewrite.json_of(g)
        sql = path.text() if path else rewrite.sql(g)
        name = default_name(g, at) or f"group_{len(plain)}"
        name = column_name(path.path) if path and "value" in rewrite.state.sides[0].columns else name
        keys.append(sql)
        plain.append((join(g), sql, name))
        key_names[join(g)] = (sql, name)
    for tokens, alias in items:
        if len(tokens) == 1 and tokens[0].text == "*":
            raise InvalidQuery("* can't stand beside GROUP BY")
        word = _call_name(tokens)
        bare = unquote(tokens[0]) if len(tokens) == 1 else ""
        if window and (word in WINDOWS or bare in ("window_start", "window_end")):
            if word in WINDOWS:
                columns.append(("window_start", alias or "window_start"))
            else:
                columns.append((bare, alias or bare))
            continue
        if join(tokens) in key_names:
            sql, name = key_names[join(tokens)]
            columns.append((sql, alias or name))
            continue
        same = next((n for _, s, n in plain if s == rewrite.sql(tokens)), None)
        lone = "count" if word == "COUNT" and len(items) == 1 and not group else None
        columns.append((rewrite.sql(tokens), alias or same or lone or default_name(tokens, at)))
        at += any(t.word in AGGREGATES for t in tokens)
    shown = [n for _, n in columns]
    if window and not {"window_start", "window_end"} & set(shown):
        columns = [("window_start", "window_start"), ("window_end", "window_end")] + [
            (s, n) for _, s, n in plain if n not in shown and not any(s == c for c, _ in columns)
        ] + columns
    select = []
    for sql, name in columns:
        if sql in ("window_start", "window_end"):
            sql = next(b.rsplit(" AS ", 1)[0] for b in _split_bounds(bounds) if b.endswith(sql))
        select.append(sql + (f" AS `{name}`" if name else ""))
    having = f" HAVING {rewrite.sql(parts['HAVING'])}" if "HAVING" in parts else ""
    grouping = f" GROUP BY {', '.join(keys)}" if keys else ""
    body = f"SELECT {'DISTINCT ' if distinct else ''}{', '.join(select)} FROM {from_sql or f'({base})'}{grouping}{having}"
    aliases = {n: [] for _, n in columns if n}
    if window and compat and kind == "HOP" and sizes[1] <= sizes[0]:
        first = f"(SELECT floor(min({time}) / {sizes[1]}) * {sizes[1]} FROM ({base}))"
        body = f"SELECT * FROM ({body}) WHERE window_start >= {first}"
    order = _order(rewrite, parts, aliases, distinct)
    return body + (f" ORDER BY {', '.join(order)}" if order else "") + _limit(parts)


def _split_bounds(bounds: str) -> list[str]:
    start, _, end = bounds.partition(" AS window_start, ")
    return [f"{start} AS window_start", end]


def _join(state: Lowering, joins: list, parts: dict, items: list, rewrite: Rewriter, distinct: bool, group: list, window) -> str:
    if any(_calls(t) & {"ZSCORE", "ANOMALY"} for t in (parts.get("WHERE", []), *(i for i, _ in items))):
        raise InvalidQuery("statistics of a join's rows are not defined; join in a view, or select them from one topic")
    source = f"{_source(state.sides[0], True)} AS `{state.sides[0].alias}`"
    for side, (kind, condition) in zip(state.sides[1:], joins, strict=True):
        on = f" ON {_condition(rewrite, condition)}" if condition else ""
        source += f" {kind} JOIN {_source(side, True)} AS `{side.alias}`{on}"
    where = f" WHERE {rewrite.sql(parts['WHERE'])}" if parts.get("WHERE") else ""
    if state.grouped:
        return _grouped(rewrite, "", items, group, window, parts, distinct, False, from_sql=source + where)
    out = []
    for tokens, alias in items:
        star = tokens[-1].text == "*"
        if star:
            sides = state.sides if len(tokens) == 1 else [state.side(unquote(tokens[0]))]
            if None in sides:
                raise InvalidQuery(f"no such table: {tokens[0].text}")
            out += [f"`{s.alias}`.`{c}` AS `{s.alias}.{c}`" for s in sides for c in s.columns]
            continue
        name = alias or default_name(tokens, -1)
        out.append(rewrite.sql(tokens) + (f" AS `{name}`" if name else ""))
    order = _order(rewrite, parts, {a: i for i, a in items if a}, distinct)
    return f"SELECT {'DISTINCT ' if distinct else ''}{', '.join(out)} FROM {source}{where}" + (f" ORDER BY {', '.join(order)}" if order else "") + _limit(parts)


def _condition(rewrite: Rewriter, tokens: list[Token]) -> str:
    """A join condition; equal sides of a comparison are compared as text, as keys are."""
    out = []
    for part in split(tokens, words=("AND",)):
        left, *right = split(part, "=")
        if len(right) == 1:
            a, b = (p.text() if (p := rewrite.json_of(x)) else f"cast({rewrite.sql(x)} AS STRING)" for x in (left, right[0]))
            out.append(f"{a} = {b}")
        else:
            out.append(f"({rewrite.sql(part)})")
    return " AND ".join(out)
