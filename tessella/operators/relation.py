"""A relation: a lazy DataFrame and the order that its rows are in.

Spark's rows have no order, so an Order_By only notes its keys; windows, limits and choices of a first row read them, and
the result is sorted once at the end.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.values import kind_of, quoted


@dataclass(frozen=True)
class SortKey:
    field: str
    ascending: bool = True
    nulls_first: bool = False
    #: Compare the text as the number that it says; other text counts as null.
    numeric: bool = False

    def column(self) -> Column:
        c = quoted(self.field)
        if self.numeric:
            c = F.regexp_replace(F.trim(c.cast("string")), ",", "").try_cast("double")
        if self.ascending:
            return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    order: tuple[SortKey, ...] = ()
    #: df with each row's number in this order, `__row`, where a window over all rows has found it.
    placed: DataFrame | None = None

    @property
    def fields(self) -> list[str]:
        return self.df.columns

    @property
    def kinds(self) -> dict[str, str]:
        return {f.name: kind_of(f.dataType) for f in self.df.schema}

    def with_df(self, df: DataFrame) -> Relation:
        kept = []
        for k in self.order:  # a key that is gone hides those after it
            if k.field not in df.columns:
                break
            kept.append(k)
        return replace(self, df=df, order=tuple(kept), placed=None)

    def total_order(self) -> list[Column]:
        """The order's keys, then every other sortable field: a definite order but for equal rows."""
        named = {k.field for k in self.order if not k.numeric}
        rest = [SortKey(f.name) for f in self.df.schema if f.name not in named and not isinstance(f.dataType, (T.MapType, T.VariantType))]
        return [k.column() for k in (*self.order, *rest)]
