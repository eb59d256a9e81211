"""Writes with enforced keys: a violation is found in the write's own shuffle and raised there, by any action on the result.

The check is a filter, which no count() or narrower selection can prune away, and no second job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def required(condition: Column, message: Column) -> Column:
    """A filter that lets every row through for which the condition holds, and raises for any other."""
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def insert_checked(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and new rows together; raises when read if a key of new is there already, twice in new, or missing.

    Rows are counted by key on the map side first, so that many copies of one key meet as few rows.
    """
    rest = [c for c in old.columns if c not in keys]
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    grouped = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("_new").alias("_added"), F.first(F.struct(F.lit(1).alias("_x"), *rest)).alias("_r"))
    named = F.concat_ws(", ", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    fine = (F.col("_n") == 1) & (present | (F.col("_added") == 0)) | (F.col("_added") == 0)
    return grouped.where(required(fine, F.concat(F.lit("key exists: "), named))).select(*(F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in old.columns))


def append_indexed(old: DataFrame, new: DataFrame, session: str, index: str, order: Sequence[Column]) -> DataFrame:
    """old and new rows together, the new ones numbered on from their session's largest index, from 0 in a new one.

    Raises when read if old has an index of a session twice, so that no number is given twice either.
    """
    last = old.groupBy(F.col(session).alias("_s")).agg(F.max(index).alias("_last"))
    rank = F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1
    numbered = new.withColumn("_k", rank).join(last, F.col(session) == F.col("_s"), "left")
    numbered = numbered.withColumn(index, (F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("_k")).cast(dict(old.dtypes)[index])).select(*old.columns)
    return insert_checked(old.limit(0), old, [session, index]).unionByName(numbered)
