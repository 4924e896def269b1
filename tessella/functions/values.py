"""Typed values of the expression language: a Column and its kind, and the conversions between kinds."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER, INTEGER, TEXT, BOOLEAN, TIME, NULL, OTHER = "number", "integer", "text", "boolean", "time", "null", "other"


class PlanError(ValueError):
    """A plan that breaks its contract; .errors lists every breach found."""

    def __init__(self, errors: list[str] | str):
        self.errors = [errors] if isinstance(errors, str) else list(errors)
        super().__init__("; ".join(self.errors))


@dataclass(frozen=True)
class Value:
    column: Column
    kind: str
    literal: Any = None
    is_literal: bool = False


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.IntegralType):
        return INTEGER
    if isinstance(t, T.NumericType):
        return NUMBER
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(t, T.BooleanType):
        return BOOLEAN
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TIME
    return NULL if isinstance(t, T.NullType) else OTHER


def literal(x: Any) -> Value:
    kind = NULL if x is None else BOOLEAN if isinstance(x, bool) else INTEGER if isinstance(x, int) else NUMBER if isinstance(x, float) else TEXT
    return Value(F.lit(x), kind, x, True)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def guarded(source: Column, converted: Column, message: str) -> Column:
    """converted, and an error where it is null though its source isn't: bad data fails the query, it isn't dropped."""
    return F.when(source.isNotNull() & converted.isNull(), F.raise_error(F.concat(F.lit(message + ": "), source.cast("string"))).cast("double")).otherwise(converted)


def number(v: Value, context: str = "arithmetic") -> Value:
    if v.kind in (NUMBER, INTEGER):
        return v if v.kind == INTEGER else Value(v.column.cast("double"), NUMBER, v.literal, v.is_literal)
    if v.kind == NULL:
        return Value(F.lit(None).cast("double"), NUMBER)
    if v.kind == BOOLEAN:
        return Value(v.column.cast("long"), INTEGER)
    if v.kind == TEXT:
        return Value(guarded(v.column, v.column.try_cast("double"), f"{context}: not a number"), NUMBER)
    raise PlanError(f"{context} requires numbers, not {v.kind}")


def time(v: Value, context: str = "date function") -> Column:
    """A timestamp without zone; text is read as ISO and in UTC."""
    if v.kind == TIME:
        return v.column.cast("timestamp_ntz")
    if v.kind == NULL:
        return F.lit(None).cast("timestamp_ntz")
    if v.kind == TEXT:
        stamp = v.column.try_cast("timestamp").cast("timestamp_ntz")
        bad = v.column.isNotNull() & stamp.isNull()
        return F.when(bad, F.raise_error(F.concat(F.lit(f"{context}: not a date: "), v.column)).cast("timestamp_ntz")).otherwise(stamp)
    raise PlanError(f"{context} requires dates or ISO text, not {v.kind}")


def boolean(v: Value, context: str = "logic") -> Column:
    if v.kind == BOOLEAN:
        return v.column
    if v.kind == NULL:
        return F.lit(None).cast("boolean")
    if v.kind in (INTEGER, NUMBER):
        return v.column != 0
    raise PlanError(f"{context} requires booleans, not {v.kind}")


def text(v: Value, context: str = "text function") -> Column:
    if v.kind in (TEXT, NULL):
        return v.column.cast("string")
    raise PlanError(f"{context} requires text, not {v.kind}")


def finite(c: Column) -> Column:
    """Non-finite numbers are null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast("double")).otherwise(c)


def common(values: list[Value], context: str) -> tuple[list[Column], str]:
    """The values as columns of one kind."""
    kinds = {v.kind for v in values} - {NULL}
    if not kinds:
        return [v.column for v in values], NULL
    if len(kinds) == 1:
        return [v.column for v in values], kinds.pop()
    if kinds <= {INTEGER, NUMBER, BOOLEAN}:
        return [number(v, context).column.cast("double") for v in values], NUMBER
    if kinds == {TIME, TEXT}:
        return [time(v, context) for v in values], TIME
    raise PlanError(f"{context}: values of different kinds: {', '.join(sorted(kinds))}")


def pandas_round(c: Column, digits: int) -> Column:
    """Scale, round half to even, scale back."""
    scale = float(10**digits) if digits >= 0 else 1 / float(10**-digits)
    return F.rint(c.cast("double") * scale) / scale


def exact_round(c: Column, digits: int) -> Column:
    """Round the double's exact value half to even, as decimal arithmetic would.

    The scaled product's rounding error is recovered by Dekker's two-product, so a product that only looks like a half is
    rounded to its true side.
    """
    x = c.cast("double")
    if digits < 0:
        return pandas_round(x, digits)
    s = float(10**digits)
    p, split = x * s, 134217729.0
    xh = x * split - (x * split - x)
    sh = s * split - (s * split - s)
    xl, sl = x - xh, s - sh
    error = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
    half = F.abs(p - F.floor(p).cast("double")) == 0.5
    rounded = F.when(half & (error > 0), F.ceil(p).cast("double")).when(half & (error < 0), F.floor(p).cast("double")).otherwise(F.rint(p)) / s
    return F.when(F.abs(p) < 4503599627370496.0, rounded).otherwise(x)
