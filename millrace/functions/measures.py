"""Measures: ``{"total": "sum(quantity)"}`` as aggregate columns, in one step or in two.

Every supported function can be computed from partial results. Sliding and session windows use that on
bounded data: they aggregate raw rows once into small time slots and combine the slots afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPEC = re.compile(r"^\s*(count|sum|avg|min|max)\s*\(\s*(\*|[A-Za-z_][A-Za-z0-9_]*)\s*\)\s*$")

DEFAULT_SPEC = {"event_count": "count(*)"}
ORDER_METRICS = {
    "event_count": "count(*)",
    "total_quantity": "sum(quantity)",
    "avg_price": "avg(unit_price)",
}


@dataclass(frozen=True)
class Measure:
    name: str
    function: str
    column: str

    def whole(self) -> Column:
        """The measure over raw rows."""
        if self.function == "count":
            return F.count(F.lit(1) if self.column == "*" else F.col(self.column)).alias(self.name)
        return getattr(F, self.function)(F.col(self.column)).alias(self.name)

    def partials(self, df: DataFrame) -> list[Column]:
        """Partial results over the raw rows of ``df`` in one slot."""
        if self.function == "avg":
            # Spark's average adds decimals as decimals and all else as doubles, so whole numbers cannot overflow.
            value = F.col(self.column)
            if not isinstance(column_type(df, self.column), T.DecimalType):
                value = value.cast("double")
            return [
                F.sum(value).alias(self._part("sum")),
                F.count(self.column).alias(self._part("count")),
            ]
        return [self.whole().alias(self._part(self.function))]

    def merges(self) -> dict[str, str]:
        """How each partial result is put together with others of its kind."""
        if self.function == "avg":
            return {self._part("sum"): "sum", self._part("count"): "sum"}
        return {self._part(self.function): "sum" if self.function in ("count", "sum") else self.function}

    def combined(self, types: Mapping[str, T.DataType]) -> Column:
        """The measure from the partial results of many slots, in the type ``whole`` would give."""
        if self.function == "avg":
            total = F.sum(self._part("sum")).cast(types[self._part("sum")])
            result = total / F.nullif(F.sum(self._part("count")), F.lit(0))
        elif self.function in ("count", "sum"):
            result = F.sum(self._part(self.function))
        else:
            result = getattr(F, self.function)(self._part(self.function))
        return result.cast(types[self.name]).alias(self.name)

    def _part(self, kind: str) -> str:
        return f"__{self.name}_{kind}"


def parse_measures(spec: Mapping[str, str] | None) -> list[Measure]:
    """Measures of a specification; the number of events where there is none."""
    measures = []
    for name, text in (DEFAULT_SPEC if spec is None else spec).items():
        match = _SPEC.match(text)
        if match is None or (match.group(2) == "*" and match.group(1) != "count"):
            raise ValueError(f"not a measure: {name!r}: {text!r}")
        measures.append(Measure(name, match.group(1), match.group(2)))
    if not measures:
        raise ValueError("at least one measure is needed")
    return measures


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.select(name).schema[0].dataType


def measure_types(df: DataFrame, measures: list[Measure]) -> dict[str, T.DataType]:
    """Result types of measures and of their partials, from the analysed plan alone."""
    columns = [column for m in measures for column in (m.whole(), *m.partials(df))]
    return {field.name: field.dataType for field in df.groupBy().agg(*columns).schema.fields}
