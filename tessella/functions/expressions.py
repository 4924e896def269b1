"""The expression language: a precedence parser that builds Columns as it reads.

Accepts Python and SQL spellings: and/or/not, ==/=, !=/<>, chained comparisons, in / not in, is [not] null, CASE WHEN,
quoted text, numbers, true/false/null, column('any name') and a fixed list of functions. Window functions need the
relation's order and so are built by `over`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sketches, temporal
from .conditions import pattern
from .values import BOOLEAN, INTEGER, NULL, NUMBER, TEXT, TIME, PlanError, Value, boolean, common, finite, literal, number, pandas_round, quoted, text, time

MAX_LENGTH, MAX_TOKENS, MAX_DEPTH = 4096, 512, 40
WINDOW_FUNCTIONS = (
    "row_number", "lag", "lead", "rolling_mean", "rolling_sum", "cumsum",
    "rank", "dense_rank", "percent_rank", "ntile", "first_value", "last_value", "rolling_max", "rolling_min", "cummax", "cummin",
)
STATISTICS = ("median", "percentile", "percentile_cont", "quantile")

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<string>'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[^\W\d]\w*)|(?P<op>\*\*|==|!=|<>|<=|>=|[-+*/%()<>=,\[\]]))")
_KEYWORDS = {"and", "or", "not", "in", "is", "case", "when", "then", "else", "end", "true", "false", "null", "none"}


@dataclass(frozen=True)
class Token:
    kind: str
    value: str


def tokens(source: str) -> list[Token]:
    if not isinstance(source, str) or not source.strip():
        raise PlanError("an expression must be nonempty text")
    if len(source) > MAX_LENGTH:
        raise PlanError(f"an expression has at most {MAX_LENGTH} characters")
    found, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise PlanError(f"unexpected character in expression: {source[at:at + 10]!r}")
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "string":
            value = value[1:-1].replace("''", "'") if value[0] == "'" else value[1:-1]
            value = re.sub(r"\\(.)", r"\1", value)
        elif kind == "name" and value.lower() in _KEYWORDS:
            kind, value = "word", value.lower()
        found.append(Token(kind, value))
        at = m.end()
    if len(found) > MAX_TOKENS:
        raise PlanError(f"an expression has at most {MAX_TOKENS} tokens")
    return found


def columns(source: str) -> list[str]:
    """Field names that an expression reads, in order."""
    names, all_tokens = [], tokens(source)
    for i, t in enumerate(all_tokens):
        call = i + 1 < len(all_tokens) and all_tokens[i + 1].value == "(" and all_tokens[i + 1].kind == "op"
        if t.kind == "name" and not call:
            names.append(t.value)
        elif t.kind == "name" and t.value == "column" and i + 2 < len(all_tokens) and all_tokens[i + 2].kind == "string":
            names.append(all_tokens[i + 2].value)
    return list(dict.fromkeys(names))


def calls(source: str) -> set[str]:
    all_tokens = tokens(source)
    return {t.value.lower() for t, n in zip(all_tokens, all_tokens[1:], strict=False) if t.kind == "name" and n == Token("op", "(")}


def copied_field(source: str) -> str | None:
    """The field, where the expression is nothing but one."""
    t = tokens(source)
    if len(t) == 1 and t[0].kind == "name":
        return t[0].value
    if [x.value for x in t[:2]] == ["column", "("] and len(t) == 4 and t[2].kind == "string":
        return t[2].value
    return None


def statistic(source: str) -> dict | None:
    """A whole-column statistic, such as percentile(column('x'), 0.9), as an aggregate."""
    t = tokens(source)
    if t[0].kind != "name" or t[0].value.lower() not in STATISTICS or len(t) < 4 or t[1].value != "(" or t[-1].value != ")":
        return None
    name, inner = t[0].value.lower(), t[2:-1]
    if inner[0].kind == "name" and inner[0].value == "column" and len(inner) >= 4:
        field, rest = inner[2].value, inner[4:]
    else:
        field, rest = inner[0].value, inner[1:]
    if name == "median":
        if rest:
            raise PlanError("median takes one column")
        return {"operation": "median", "target_column": field}
    if len(rest) != 2 or rest[0].value != "," or rest[1].kind != "number":
        raise PlanError(f"{name} takes a column and a quantile between 0 and 1")
    return {"operation": "percentile_cont", "target_column": field, "quantile": float(rest[1].value)}


class Parser:
    def __init__(self, source: str, kinds: dict[str, str], over: Callable[[str], object] | None = None):
        self.tokens, self.at, self.kinds, self.over, self.depth = tokens(source), 0, kinds, over, 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at].kind in ("op", "word") and self.tokens[self.at].value in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1].value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise PlanError(f"expected {value!r} in expression")

    def parse(self) -> Value:
        v = self.either()
        if self.at < len(self.tokens):
            raise PlanError(f"unexpected {self.tokens[self.at].value!r} in expression")
        return v

    def either(self) -> Value:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise PlanError(f"an expression nests at most {MAX_DEPTH} deep")
        v = self.both()
        while self.take("or"):
            v = Value(boolean(v) | boolean(self.both()), BOOLEAN)
        self.depth -= 1
        return v

    def both(self) -> Value:
        v = self.negation()
        while self.take("and"):
            v = Value(boolean(v) & boolean(self.negation()), BOOLEAN)
        return v

    def negation(self) -> Value:
        return Value(~boolean(self.negation()), BOOLEAN) if self.take("not") else self.comparison()

    def comparison(self) -> Value:
        left, out = self.sum(), None
        while True:
            if op := self.take("==", "=", "!=", "<>", "<=", ">=", "<", ">"):
                right = self.sum()
                test, left = compare(left, op, right), right
            elif self.take("is"):
                negative = bool(self.take("not"))
                if not self.take("null", "none"):
                    raise PlanError("is tests for null only")
                test = left.column.isNotNull() if negative else left.column.isNull()
            elif self.peek("in") or (self.peek("not") and self.tokens[self.at + 1 : self.at + 2] == [Token("word", "in")]):
                negative = bool(self.take("not"))
                self.need("in")
                test = member(left, self.listed(), negative)
            else:
                return left if out is None else Value(out, BOOLEAN)
            out = test if out is None else out & test

    def listed(self) -> list[Value]:
        close = {"(": ")", "[": "]"}.get(self.take("(", "[") or "")
        if not close:
            raise PlanError("in requires a list of literals")
        found = []
        while not self.take(close):
            v = self.sum()
            if not v.is_literal:
                raise PlanError("in requires a list of literals")
            found.append(v)
            if not self.peek(close):
                self.need(",")
        return found

    def sum(self) -> Value:
        v = self.product()
        while op := self.take("+", "-"):
            v = plus_minus(v, op, self.product())
        return v

    def product(self) -> Value:
        v = self.sign()
        while op := self.take("*", "/", "%"):
            v = times(v, op, self.sign())
        return v

    def sign(self) -> Value:
        if op := self.take("+", "-"):
            v = number(self.sign())
            return v if op == "+" else Value(-v.column, v.kind, -v.literal if v.is_literal and v.literal is not None else None, v.is_literal)
        base = self.atom()
        if self.take("**"):
            power = self.sign()
            if power.is_literal and abs(power.literal) > 1000:
                raise PlanError("an exponent is at most 1000")
            return Value(finite(F.pow(number(base).column.cast("double"), number(power).column.cast("double"))), NUMBER)
        return base

    def atom(self) -> Value:
        if self.take("("):
            v = self.either()
            self.need(")")
            return v
        if self.at >= len(self.tokens):
            raise PlanError("the expression ends too early")
        t = self.tokens[self.at]
        self.at += 1
        if t.kind == "number":
            return literal(float(t.value) if re.search(r"[.eE]", t.value) else int(t.value))
        if t.kind == "string":
            return literal(t.value)
        if t.kind == "word" and t.value in ("true", "false"):
            return literal(t.value == "true")
        if t.kind == "word" and t.value in ("null", "none"):
            return literal(None)
        if t.kind == "word" and t.value == "case":
            return self.case()
        if t.kind != "name":
            raise PlanError(f"unexpected {t.value!r} in expression")
        if self.take("("):
            args = []
            while not self.take(")"):
                args.append(self.either())
                if not self.peek(")"):
                    self.need(",")
            return self.call(t.value.lower(), args)
        return self.field(t.value)

    def field(self, name: str) -> Value:
        if name not in self.kinds:
            raise PlanError(f"field does not exist on the selected input: {name}")
        return Value(quoted(name), self.kinds[name])

    def case(self) -> Value:
        tests, values = [], []
        while self.take("when"):
            tests.append(boolean(self.either()))
            self.need("then")
            values.append(self.either())
        if not tests:
            raise PlanError("CASE requires WHEN")
        values.append(self.either() if self.take("else") else literal(None))
        self.need("end")
        return chosen(tests, values)

    def call(self, name: str, args: list[Value]) -> Value:
        if name == "column":
            if len(args) != 1 or not isinstance(args[0].literal, str):
                raise PlanError("column takes one name in quotes")
            return self.field(args[0].literal)
        if name in WINDOW_FUNCTIONS:
            if self.over is None:
                raise PlanError(f"{name} requires an explicit Order_By on its input")
            return self.over(name, args)
        if name not in FUNCTIONS:
            raise PlanError(f"unsupported function: {name}")
        least, most, build = FUNCTIONS[name]
        if not least <= len(args) <= most:
            raise PlanError(f"{name} takes {least} to {most} arguments, not {len(args)}")
        return build(args)


def compare(left: Value, op: str, right: Value) -> Column:
    if {left.kind, right.kind} == {TEXT, INTEGER} or {left.kind, right.kind} == {TEXT, NUMBER}:
        a, b = number(left, "comparison").column, number(right, "comparison").column
    else:
        (a, b), _ = common([left, right], "comparison")
    if NULL in (left.kind, right.kind):
        return F.lit(None).cast("boolean")
    return {"==": a == b, "=": a == b, "!=": a != b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def member(left: Value, right: list[Value], negative: bool) -> Column:
    out = F.lit(False)
    for v in right:
        out = out | compare(left, "==", v)
    out = F.when(left.column.isNotNull(), out)
    return ~out if negative else out


def plus_minus(a: Value, op: str, b: Value) -> Value:
    if op == "-" and TIME in (a.kind, b.kind):
        return Value((temporal.epoch(time(a)) - temporal.epoch(time(b))) / 86400.0, NUMBER)
    x, y = number(a), number(b)
    kind = INTEGER if x.kind == y.kind == INTEGER else NUMBER
    x, y = (v.column.cast("long" if kind == INTEGER else "double") for v in (x, y))
    out = x + y if op == "+" else x - y
    return Value(out if kind == INTEGER else finite(out), kind)


def times(a: Value, op: str, b: Value) -> Value:
    x, y = number(a), number(b)
    kind = INTEGER if x.kind == y.kind == INTEGER and op != "/" else NUMBER
    x, y = (v.column.cast("long" if kind == INTEGER else "double") for v in (x, y))
    if op == "*":
        return Value(x * y if kind == INTEGER else finite(x * y), kind)
    nonzero = F.nullif(y, F.lit(0).cast("long" if kind == INTEGER else "double"))
    if op == "/":
        return Value(finite(x / nonzero), NUMBER)
    # the remainder has the divisor's sign
    return Value((x % nonzero + nonzero) % nonzero, kind)


def chosen(tests: list[Column], values: list[Value]) -> Value:
    found, kind = common(values, "CASE")
    out = None
    for test, value in zip(tests, found[:-1], strict=True):
        out = F.when(test, value) if out is None else out.when(test, value)
    return Value(out.otherwise(found[-1]), kind)


def _round(args: list[Value]) -> Value:
    digits = args[1].literal if len(args) > 1 else 0
    if isinstance(digits, bool) or not isinstance(digits, int) or not -15 <= digits <= 15:
        raise PlanError("round takes digits from -15 to 15")
    return Value(finite(pandas_round(number(args[0]).column, digits)), NUMBER)


def _coalesce(args: list[Value]) -> Value:
    found, kind = common(args, "coalesce")
    return Value(F.coalesce(*found), kind)


def _nullif(args: list[Value]) -> Value:
    return Value(F.when(compare(args[0], "==", args[1]), F.lit(None)).otherwise(args[0].column), args[0].kind)


def _substring(args: list[Value]) -> Value:
    start, length = args[1].literal, args[2].literal if len(args) > 2 else None
    if not isinstance(start, int) or start < 1 or (len(args) > 2 and (not isinstance(length, int) or length < 0)):
        raise PlanError("substr takes a start from 1 and a length from 0, as literals")
    source = text(args[0])
    return Value(source.substr(F.lit(start), F.lit(length)) if length is not None else source.substr(F.lit(start), F.length(source)), TEXT)


def _matches(how: str):
    def build(args: list[Value]) -> Value:
        if not isinstance(args[1].literal, str):
            raise PlanError(f"{how} takes a literal pattern")
        source, wanted = text(args[0]), args[1].literal
        return Value(source.contains(wanted) if how == "contains" else getattr(source, how)(pattern(wanted)), BOOLEAN)

    return build


def _replace(args: list[Value]) -> Value:
    """A Java regular expression's matches replaced; both pattern and replacement are literals."""
    if not all(isinstance(a.literal, str) for a in args[1:]):
        raise PlanError("regexp_replace takes a literal pattern and replacement")
    return Value(F.regexp_replace(text(args[0]), args[1].literal, args[2].literal if len(args) > 2 else ""), TEXT)


def _extract(args: list[Value]) -> Value:
    """The first match's group, null without a match."""
    group = args[2].literal if len(args) > 2 else 0
    if not isinstance(args[1].literal, str) or isinstance(group, bool) or not isinstance(group, int):
        raise PlanError("regexp_extract takes a literal pattern and group")
    found = F.regexp_extract(text(args[0]), args[1].literal, group)
    return Value(F.when(F.regexp_like(text(args[0]), F.lit(args[1].literal)), found), TEXT)


def _extreme(pick: Callable[..., Column], name: str):
    """The greatest or least of the values that aren't null."""

    def build(args: list[Value]) -> Value:
        found, kind = common(args, name)
        return Value(pick(*found), kind)

    return 2, 20, build


def _json(args: list[Value]) -> Value:
    """The value at a JSON path such as $.a.b[0], as text."""
    if not isinstance(args[1].literal, str):
        raise PlanError("json_value takes a literal path")
    return Value(F.get_json_object(text(args[0]), args[1].literal), TEXT)


def _part_of(args: list[Value]) -> Value:
    """The n-th part, from 1, of a text cut at a separator; null beyond the last."""
    n = args[2].literal
    if not isinstance(args[1].literal, str) or isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise PlanError("split_part takes a literal separator and a number from 1")
    parts = F.split(text(args[0]), re.escape(args[1].literal))
    return Value(F.get(parts, F.lit(n - 1)), TEXT)


def _date_part(f):
    return 1, 1, lambda a: Value(f(time(a[0])).cast("long"), INTEGER)


def _unit(v: Value) -> str:
    if not isinstance(v.literal, str):
        raise PlanError("a date unit is a literal")
    return v.literal


def _add(args: list[Value]) -> Value:
    n = args[1].literal
    if isinstance(n, bool) or not isinstance(n, int) or abs(n) > 10_000:
        raise PlanError("a date offset is an integer literal within 10000")
    return Value(temporal.add(_unit(args[0]), n, time(args[2])), TIME)


_DIFFERENCE = (3, 3, lambda a: Value(temporal.difference(_unit(a[0]), time(a[1]), time(a[2])), INTEGER))
_SUBSTRING = (2, 3, _substring)

#: name -> least and most arguments, builder
FUNCTIONS: dict[str, tuple[int, int, Callable[[list[Value]], Value]]] = {
    "abs": (1, 1, lambda a: (lambda v: Value(F.abs(v.column), v.kind))(number(a[0]))),
    "round": (1, 2, _round),
    "coalesce": (2, 20, _coalesce),
    "nullif": (2, 2, _nullif),
    "where": (3, 3, lambda a: chosen([boolean(a[0])], a[1:])),
    "is_null": (1, 1, lambda a: Value(a[0].column.isNull(), BOOLEAN)),
    "is_not_null": (1, 1, lambda a: Value(a[0].column.isNotNull(), BOOLEAN)),
    "lower": (1, 1, lambda a: Value(F.lower(text(a[0])), TEXT)),
    "upper": (1, 1, lambda a: Value(F.upper(text(a[0])), TEXT)),
    "length": (1, 1, lambda a: Value(F.length(text(a[0])).cast("long"), INTEGER)),
    "substr": _SUBSTRING,
    "substring": _SUBSTRING,
    "like": (2, 2, _matches("like")),
    "ilike": (2, 2, _matches("ilike")),
    "contains": (2, 2, _matches("contains")),
    "regexp_replace": (2, 3, _replace),
    "regexp_extract": (2, 3, _extract),
    "regexp_like": (2, 2, lambda a: Value(F.regexp_like(text(a[0]), F.lit(a[1].literal)), BOOLEAN)),
    "split_part": (3, 3, _part_of),
    "json_value": (2, 2, _json),
    "trim": (1, 1, lambda a: Value(F.trim(text(a[0])), TEXT)),
    "concat": (2, 20, lambda a: Value(F.concat(*[text(x) if x.kind == TEXT else x.column.cast("string") for x in a]), TEXT)),
    "greatest": _extreme(F.greatest, "greatest"),
    "least": _extreme(F.least, "least"),
    "floor": (1, 1, lambda a: Value(F.floor(number(a[0]).column).cast("long"), INTEGER)),
    "ceil": (1, 1, lambda a: Value(F.ceil(number(a[0]).column).cast("long"), INTEGER)),
    "number": (1, 1, lambda a: Value(text(a[0]).try_cast("double") if a[0].kind == TEXT else number(a[0]).column.cast("double"), NUMBER)),
    "date": (1, 1, lambda a: Value(F.date_trunc("day", time(a[0])).cast("timestamp_ntz"), TIME)),
    "datetime": (1, 1, lambda a: Value(time(a[0]), TIME)),
    "year": _date_part(F.year),
    "month": _date_part(F.month),
    "day": _date_part(F.dayofmonth),
    "quarter": _date_part(F.quarter),
    "date_diff": _DIFFERENCE,
    "datediff": _DIFFERENCE,
    "dateadd": (3, 3, _add),
    "date_add": (3, 3, _add),
    "date_trunc": (2, 2, lambda a: Value(temporal.truncate(_unit(a[0]), time(a[1])), TIME)),
    **sketches.FUNCTIONS,
}

#: Fixed values of the plan language: two-column formulas by name, over the fields L and R.
TEMPLATES = {
    "add": "L + R",
    "addition": "L + R",
    "subtract": "L - R",
    "difference": "L - R",
    "multiply": "L * R",
    "product": "L * R",
    "divide": "L / R",
    "ratio": "L / R",
    "absolute_gap": "abs(L - R)",
    "percentage": "(L / R) * 100",
    "percentage_diff": "((R - L) / L) * 100",
    "percentage_change": "((R - L) / L) * 100",
}


def template(operation: str, left: str, right: str) -> str:
    name = lambda f: "column('" + f.replace("'", "''") + "')"
    return re.sub(r"\b[LR]\b", lambda m: name(left if m[0] == "L" else right), TEMPLATES[operation])


def compile_expression(source: str, kinds: dict[str, str], over=None) -> Value:
    return Parser(source, kinds, over).parse()
