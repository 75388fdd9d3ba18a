"""Matches of many patterns with their places, as a table function.

`spans(text, pattern, ...)` gives a row for each match and group of each pattern, patterns in turn over a text that is handed over
once. It is called from SQL as LATERAL spans(...) once register() has named it, and from DataFrames by with_spans().
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

COLUMNS = StructType([StructField("pattern", IntegerType()), StructField("match", IntegerType()), StructField("group", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("span", StringType())])


@dataclass
class Compiled(AnalyzeResult):
    patterns: tuple[str, ...] = ()
    names: tuple[str, ...] = ()


class Spans:
    """Rows: pattern (its place from 0), match (its number in the text), group (0: the whole match), start and end (code points, end
    exclusive), span (the text between); then a column for each named group of any pattern, with that group's text in
    rows of group 0. Groups that took no part have no row. Null text: no rows."""

    def __init__(self, analyzed: Compiled):
        self.patterns, self.names = [re.compile(p) for p in analyzed.patterns], analyzed.names

    @staticmethod
    def analyze(text: AnalyzeArgument, *patterns: AnalyzeArgument) -> Compiled:
        if not patterns or not all(p.isConstantExpression and isinstance(p.value, str) for p in patterns):
            raise ValueError("spans(): a text, then constant patterns")
        names = dict.fromkeys(n for p in patterns for n in re.compile(p.value).groupindex)
        if clash := [n for n in names if n in COLUMNS.names]:
            raise ValueError(f"spans(): groups can't be called {', '.join(clash)}")
        return Compiled(StructType([*COLUMNS.fields, *(StructField(n, StringType()) for n in names)]), patterns=tuple(p.value for p in patterns), names=tuple(names))

    def eval(self, text: str, *patterns: str) -> Iterator[tuple]:
        if text is None:
            return
        for i, pattern in enumerate(self.patterns):
            for k, m in enumerate(pattern.finditer(text)):
                named = m.groupdict()
                for g in range(pattern.groups + 1):
                    if m.start(g) >= 0:
                        yield i, k, g, m.start(g), m.end(g), m[g], *(named.get(n) if g == 0 else None for n in self.names)


def register(spark: SparkSession, name: str = "spans") -> None:
    """Makes the function callable from SQL."""
    spark.udtf.register(name, F.udtf(Spans, useArrow=True))


def with_spans(df: DataFrame, patterns: Sequence[str], text: str = "text") -> DataFrame:
    """Each row of `df` with each of its spans; rows without any are not there."""
    return df.lateralJoin(F.udtf(Spans, useArrow=True)(F.col(f"`{text}`").outer(), *map(F.lit, patterns)))
