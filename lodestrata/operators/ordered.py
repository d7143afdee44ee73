"""Joins and look-backs along an order, without a task that holds all of a key or a day.

Rows are range-partitioned by their order with splitters that Spark samples,
so that neither a long key nor a busy day goes to one task; a hash closes the
order, and splits even rows of one instant. Each range works on its own rows;
what an earlier range hands on to a later one is one row for each key and range
that has it, carried by a window over those rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import staged

_RANGE, _LAST = "_range", "_handed"


def ranges(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``_range``, numbers of ranges in ascending ``order``, written so that all that follows sees the same ranges."""
    return staged(rows.repartitionByRange(*order).withColumn(_RANGE, F.spark_partition_id()), "ranges")


def _handed(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """``by, _range, _handed``: the aggregate ``value`` of all earlier ranges of the key, to be taken as their greatest."""
    each = rows.groupBy(*by, _RANGE).agg(value.alias("v"))
    earlier = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*by, _RANGE, F.max("v").over(earlier).alias(_LAST))


def _with(rows: DataFrame, handed: DataFrame, by: list[str]) -> DataFrame:
    right = handed.withColumnsRenamed({c: f"_h_{c}" for c in [*by, _RANGE]})
    on = [rows[c].eqNullSafe(right[f"_h_{c}"]) for c in by] + [rows[_RANGE] == right[f"_h_{_RANGE}"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return rows.join(right, cond, "left").drop(*(f"_h_{c}" for c in [*by, _RANGE]))


def asof(left: DataFrame, right: DataFrame, at: str, value: str, by: tuple[str, ...] = (), greatest: bool = False) -> DataFrame:
    """``left`` with ``value``: that of the last row of ``right`` with the same ``by`` and an ``at`` up to its own, or null.

    Of several rows of ``right`` at one time the greatest value counts. With
    ``greatest`` it is the greatest value so far instead of the last. Rows
    without a time see nothing; null keys match null keys. ``left`` may have any columns.
    """
    keys = [f"_by{i}" for i in range(len(by))] or ["_by"]
    key = lambda df: {k: (F.col(c) if c else F.lit(0)) for k, c in zip(keys, by or ("",))}
    points = right.where(F.col(at).isNotNull() & F.col(value).isNotNull()).withColumns(key(right)).groupBy(*keys, F.col(at).alias("_at")).agg(F.max(value).alias("_value"))
    asked = left.select(F.struct("*").alias("_row"), F.col(at).alias("_at"), *(c.alias(k) for k, c in key(left).items()))
    both = asked.withColumns({"_value": F.lit(None).cast(right.schema[value].dataType), "_salt": F.pmod(F.xxhash64("_row"), F.lit(1 << 20))}).unionByName(
        points.withColumns({"_row": F.lit(None).cast(asked.schema["_row"].dataType), "_salt": F.lit(-1).cast("long")})
    )
    rows = ranges(both, *keys, "_at", "_salt")
    seen = F.when(F.col("_value").isNotNull(), F.col("_value") if greatest else F.struct("_at", "_value"))
    rows = rows.withColumn("_seen", seen)
    so_far = Window.partitionBy(_RANGE, *keys).orderBy("_at", "_salt").rowsBetween(Window.unboundedPreceding, 0)
    rows = _with(rows.withColumn("_own", F.max("_seen").over(so_far)), _handed(rows, keys, F.max("_seen")), keys).where(F.col("_row").isNotNull())
    found = F.coalesce(F.greatest("_own", _LAST) if greatest else F.coalesce("_own", _LAST))
    found = F.when(F.col("_at").isNotNull(), found if greatest else found["_value"])
    return rows.select("_row.*", found.alias(value))


def previous(rows: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``rows`` with ``before``, a struct of the ``values`` of the row before each in its key, or null for the first.

    ``order`` must set the rows of a key apart, or which of equal ones comes first is any.
    """
    own = ranges(rows, *by, *order)
    inside = Window.partitionBy(_RANGE, *by).orderBy(*order)
    mine = own.withColumn("_mine", F.struct(*values))
    last = mine.groupBy(*by, _RANGE).agg(F.max_by("_mine", F.struct(*order)).alias("v"))
    handed = last.select(*by, _RANGE, F.lag("v").over(Window.partitionBy(*by).orderBy(_RANGE)).alias(_LAST))
    out = _with(mine.withColumn("_lag", F.lag("_mine").over(inside)), handed, by)
    return out.withColumn("before", F.coalesce("_lag", _LAST)).drop("_mine", "_lag", _LAST, _RANGE)
