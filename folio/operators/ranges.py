"""Neighbours and ranks within groups of any size.

A window over a group puts the group in one task. Here rows are dealt by ranges of (group, order), so a large group lies in many
ranges of a bounded number of rows. Windows run within a range; what crosses a border is carried in a table of one row for each
group and range: the first row of the next range, or the number of rows before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions.text import free
from folio.sources.shared import cut

#: Rows of a range, about: bounds are sampled.
RANGE_ROWS = 100_000


def ranged(df: DataFrame, key: str, order: Sequence[str], part: str, rows: int = RANGE_ROWS) -> DataFrame:
    """`df` as a written table, with the number of the range of each row; ranges ascend by (key, order)."""
    n = max(1, -(-df.count() // rows))
    return cut(df.repartitionByRange(n, key, *order).withColumn(part, F.spark_partition_id()), "ranged")


def with_next(df: DataFrame, key: str, order: str, values: dict[str, str], rows: int = RANGE_ROWS) -> DataFrame:
    """Adds to each row, under new names, columns (`values`: new name to column) of the row that follows it in its group by `order`;
    the last one gets nulls. Rows of one place follow each other in any order."""
    part, last, head = free(df, "part", "last", "head")
    table = ranged(df, key, [order], part, rows)
    w = Window.partitionBy(part, key).orderBy(order)
    packed = F.struct(*(F.col(c).alias(n) for n, c in values.items()))
    inside = table.withColumns({head: F.lead(packed).over(w), last: F.lead(F.lit(False), 1, True).over(w)})
    # the first row of each group in each range, handed to the range of the group that comes before
    heads = table.groupBy(part, key).agg(F.min_by(packed, order).alias("__first"))
    carried = heads.select(part, key, F.lead("__first").over(Window.partitionBy(key).orderBy(part)).alias("__next")).where("__next is not null")
    joined = inside.join(carried.withColumn(last, F.lit(True)), [part, key, last], "left")
    return joined.select(*df.columns, *(F.coalesce(F.col(head)[n], F.col("__next")[n]).alias(n) for n in values))


def ranks(df: DataFrame, key: str, order: Sequence[str], name: str = "rank", count: str = "count", rows: int = RANGE_ROWS) -> DataFrame:
    """Adds each row's place (from 1) in its group by `order`, and the group's number of rows."""
    (part,) = free(df, "part")
    table = ranged(df, key, order, part, rows)
    sizes = table.groupBy(part, key).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(key).orderBy(part)  # of a group: a row a range
    before = sizes.select(part, key, (F.sum("__n").over(w) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(key)).alias(count))
    place = F.row_number().over(Window.partitionBy(part, key).orderBy(*order))
    return table.withColumn(name, place).join(before, [part, key]).select(*df.columns, (F.col(name) + F.col("__before")).alias(name), count)


def medians(df: DataFrame, key: str, value: str, rows: int = RANGE_ROWS) -> DataFrame:
    """The exact median of each group, from its one or two middle places; null values don't count."""
    placed = ranks(df.select(key, value).where(F.col(value).isNotNull()), key, [value], "__rank", "__count", rows)
    middle = F.col("__rank").between(F.floor((F.col("__count") + 1) / 2), F.ceil((F.col("__count") + 1) / 2))
    return placed.where(middle).groupBy(key).agg(F.avg(value).alias("median"))
