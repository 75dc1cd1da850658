"""Literal search, pages of results and byte budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fronda.operators.graph import saved


def has_keywords(text: Column, keywords: list[str], every: bool = True) -> Column:
    """Literal pre-filter that runs before any parsing."""
    tests = [text.contains(k) for k in keywords]
    if not tests:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests)


def literal_matches(lines: DataFrame, pattern: str, by: str = "doc_id", limit: int | None = 200) -> DataFrame:
    """First place of the pattern in each line that holds it: line and column, both from 1."""
    found = lines.filter(F.col("line").contains(pattern)).select(by, "line_number", F.locate(pattern, "line").alias("column"), F.trim("line").alias("snippet"))
    return found if limit is None else found.orderBy(by, "line_number").limit(limit)


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def budget_prefix(rows: DataFrame, order: list[str], size: str, max_bytes: int, reserve: int = 256) -> DataFrame:
    """The longest prefix in `order` whose sizes and the reserve fit the budget, with the running total; a null size counts nothing.

    Rows are dealt by ranges of the order and written once; totals of whole ranges
    tell in which range the budget ends, and only ranges up to that one are ordered.
    """
    part = "__fronda_range"
    dealt = saved(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    totals = dealt.groupBy(part).agg(F.sum(size).alias("total"))
    # one row a range
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    near = dealt.join(F.broadcast(before), part).filter(F.col("before") + reserve <= max_bytes)
    total = F.coalesce(F.sum(size).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return near.withColumn("running", F.col("before") + total).filter(F.col("running") + reserve <= max_bytes).drop(part, "before")
