"""As-of: the last k rows strictly before a moment, over a whole table, without a window of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of days that the moments are split into.
RANGES = 200


def before(date: Column, time: Column, other_date: Column, other_time: Column) -> Column:
    """Whether (date, time) is strictly before another: a missing time is the start of its day, a missing date is before nothing."""
    key = lambda d, t: F.struct(d.alias("d"), F.coalesce(t, F.lit("")).alias("t"))
    return F.coalesce(date.isNotNull() & other_date.isNotNull() & (key(date, time) < key(other_date, other_time)), F.lit(False))


def _newest(rows: DataFrame, id_: str, k: int) -> DataFrame:
    """_d, _t, _own: the k newest ids of each moment, newest first; ids with a time before ids without, larger ones first.

    The rank limit is applied on the map side too, so a crowded moment never meets as a whole.
    """
    order = Window.partitionBy("_d", "_t").orderBy(F.col("_timed").desc(), F.col(id_).desc())
    ranked = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return ranked.groupBy("_d", "_t").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", id_))), lambda x: x[id_]).alias("_own"))


def preceding(probe: DataFrame, corpus: DataFrame, k: int, id_: str = "id", date: str = "meeting_date", time: str = "meeting_time", ranges: int = RANGES) -> DataFrame:
    """id, prior of every row of probe: ids of the k last rows of corpus strictly before its (date, time), newest first.

    Rows of one moment don't precede each other; an unknown time is the start of its day; a row
    without a date has no prior rows and precedes none. Only moments are ordered: they are cut into
    ranges of days by quantiles, each range is one window, and what a range carries on is k ids. The
    rows themselves only meet the moments by an equi-join.
    """
    stamp = lambda df, *more: df.select(id_, F.col(date).alias("_d"), F.coalesce(time, F.lit("")).alias("_t"), *more)
    asked = stamp(probe)
    known = stamp(corpus, F.col(time).isNotNull().alias("_timed")).where("_d IS NOT NULL")
    own = _newest(known, id_, k)
    kind = f"array<{dict(corpus.dtypes)[id_]}>"
    none = F.array().cast(kind)
    moments = asked.where("_d IS NOT NULL").select("_d", "_t").distinct().join(own, ["_d", "_t"], "full").withColumn("_own", F.coalesce("_own", none))
    cuts = moments.agg(F.percentile_approx(F.unix_date("_d"), [i / ranges for i in range(1, ranges)]).alias("c")).first()["c"] or []
    # at most `ranges` numbers, as one sorted array beside each moment
    at = F.size(F.filter(F.lit(sorted(set(cuts))).cast("array<int>"), lambda c: c < F.unix_date("_d")))
    placed = moments.withColumn("_g", at)

    has = F.size("_own") > 0
    order = lambda *by: Window.partitionBy(*by).orderBy("_d", "_t")
    # moments that have ids: the k before them hold k ids at least
    some = F.collect_list("_own").over(order("_g", "_has").rowsBetween(-k, -1))
    upto = F.slice(F.concat("_own", F.flatten(F.reverse(some))), 1, k)
    rows = placed.withColumn("_has", has).withColumn("_upto", F.when(F.col("_has"), upto))
    rows = rows.withColumn("_in", F.coalesce(F.last("_upto", ignorenulls=True).over(order("_g").rowsBetween(Window.unboundedPreceding, -1)), none))

    # what each range adds is one row; their order is a window over at most `ranges` rows
    tails = rows.where("_has").groupBy("_g").agg(F.max_by("_upto", F.struct("_d", "_t")).alias("_tail"))
    every = tails.select("_g", "_tail")
    carried = every.withColumn("_c", F.slice(F.concat("_tail", F.flatten(F.reverse(F.collect_list("_tail").over(Window.orderBy("_g").rowsBetween(-k, -1))))), 1, k))
    steps = F.broadcast(carried.agg(F.array_sort(F.collect_list(F.struct("_g", "_c"))).alias("_steps")))  # one row
    last = F.element_at(F.concat(F.array(F.lit(None).cast(f"struct<_g:int,_c:{kind}>")), F.filter("_steps", lambda s: s["_g"] < F.col("_g"))), -1)
    prior = F.slice(F.concat("_in", F.coalesce(last["_c"], none)), 1, k)
    found = rows.join(steps).select("_d", "_t", prior.alias("prior"))
    return asked.join(found, ["_d", "_t"], "left").select(id_, F.coalesce("prior", none).alias("prior"))
