"""Interval and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _by_slab(points: DataFrame, day: str, slab: int) -> DataFrame:
    return points.withColumn("__slab", F.floor(F.unix_date(F.col(day)) / slab))


def asof_forward(points: DataFrame, series: DataFrame, key: str, day: str, tolerance: int, values: list[str], series_day: str = "date", prefix: str = "entry_") -> DataFrame:
    """Each point with the first observation at or after its day, at most ``tolerance`` days later.

    The join has the equi keys (key, slab of days): the observations within reach of a slab's
    border are in both slabs, so it is a hash or merge join whose hot keys are cut by time. Points
    without an observation keep nulls. Several observations of a day: the smallest values.
    """
    s = series.where(F.col(series_day).isNotNull()).groupBy(key, series_day).agg(*[F.min(v).alias(v) for v in values])
    d = F.unix_date(series_day)
    slab = max(tolerance, 30)
    s = s.select(F.col(key).alias("__k"), F.explode(F.sequence(F.floor((d - tolerance) / slab), F.floor(d / slab))).alias("__s"), F.struct(F.col(series_day).alias("date"), *values).alias("__obs"))
    p = _by_slab(points.withColumn("__id", F.struct(key, day)), day, slab)
    need = p.select("__id", key, day, "__slab").distinct()
    hit = need.join(s, (need[key] == s["__k"]) & (need["__slab"] == s["__s"]) & (F.col("__obs.date") >= F.col(day)) & (F.datediff(F.col("__obs.date"), F.col(day)) <= tolerance))
    best = hit.groupBy(key, day).agg(F.min("__obs").alias("__best"))
    out = points.join(best.withColumnRenamed(key, "__k").withColumnRenamed(day, "__d"), (points[key] == F.col("__k")) & (points[day] == F.col("__d")), "left")
    return out.withColumns({prefix + "date": F.col("__best.date"), **{prefix + v: F.col(f"__best.{v}") for v in values}}).drop("__k", "__d", "__best")


def asof_backward(points: DataFrame, series: DataFrame, key: str, day: str, values: list[str], series_day: str = "date", prefix: str = "exit_") -> DataFrame:
    """Each point with the last observation at or before its day, however long ago; nulls if none.

    One pass over the union of distinct (key, day) pairs and observations; a window partition is
    the days of one key."""
    s = series.where(F.col(series_day).isNotNull()).groupBy(key, series_day).agg(*[F.max(v).alias(v) for v in values])
    obs = s.select(F.col(key).alias("__k"), F.col(series_day).alias("__d"), F.lit(0).alias("__ask"), F.struct(F.col(series_day).alias("date"), *values).alias("__obs"))
    ask = points.select(F.col(key).alias("__k"), F.col(day).alias("__d")).where("__k is not null and __d is not null").distinct().withColumn("__ask", F.lit(1))
    w = W.partitionBy("__k").orderBy("__d", "__ask").rowsBetween(W.unboundedPreceding, 0)
    last = obs.unionByName(ask, allowMissingColumns=True).withColumn("__obs", F.last("__obs", ignorenulls=True).over(w)).where("__ask = 1").drop("__ask")
    out = points.join(last, (points[key] == last["__k"]) & (points[day] == last["__d"]), "left")
    return out.withColumns({prefix + "date": F.col("__obs.date"), **{prefix + v: F.col(f"__obs.{v}") for v in values}}).drop("__k", "__d", "__obs")


def listed_at(points: DataFrame, listings: DataFrame, key: str, day: str, begin: str = "listed_from", end: str = "listed_to") -> DataFrame:
    """Three-valued membership ``was_listed``: true, false, or null where the key has no interval
    or the day is null. Intervals are closed, a null end is open, a null begin holds always.

    Points are reduced to distinct (key, day) pairs before they meet the intervals of their key."""
    pairs = points.select(F.col(key).alias("__k"), F.col(day).alias("__d")).where("__k is not null and __d is not null").distinct()
    iv = listings.select(F.col(key).alias("__lk"), F.col(begin).alias("__b"), F.col(end).alias("__e")).distinct()
    inside = (F.col("__b").isNull() | (F.col("__b") <= F.col("__d"))) & (F.col("__e").isNull() | (F.col("__e") >= F.col("__d")))
    got = pairs.join(iv, pairs["__k"] == iv["__lk"]).groupBy("__k", "__d").agg(F.bool_or(inside).alias("was_listed"))
    return points.join(got, (points[key] == got["__k"]) & (points[day] == got["__d"]), "left").drop("__k", "__d")


def universe_sizes(listings: DataFrame, days: DataFrame, key: str, begin: str = "listed_from", end: str = "listed_to") -> DataFrame:
    """``day, n_listed``: keys with an interval that holds each day. Intervals meet days through
    the years they touch, an equi key."""
    far = F.lit("9999-12-31").cast("date")
    d = days.select("day").where("day is not null").distinct().withColumn("__y", F.year("day"))
    lo, hi = d.agg(F.min("__y")).scalar(), d.agg(F.max("__y")).scalar()
    iv = listings.select(F.col(key).alias("__k"), F.coalesce(begin, F.lit("0001-01-01").cast("date")).alias("__b"), F.coalesce(end, far).alias("__e")).distinct()
    iv = iv.select("__k", "__b", "__e", F.greatest(F.year("__b"), lo).alias("a"), F.least(F.year("__e"), hi).alias("z")).where("a <= z")
    iv = iv.withColumn("__iy", F.explode(F.sequence("a", "z")))
    hit = d.join(iv, (d["__y"] == iv["__iy"]) & (F.col("__b") <= F.col("day")) & (F.col("__e") >= F.col("day")))
    n = hit.groupBy("day").agg(F.count_distinct("__k").alias("n_listed"))
    return d.select("day").join(n, "day", "left").withColumn("n_listed", F.coalesce("n_listed", F.lit(0).cast("long")))


def dead_names(listings: DataFrame, key: str, end: str, grace: int = 30) -> DataFrame:
    """``key, last_observed, is_dead``: dead where the last day is over ``grace`` days before the
    latest last day of all. A null end is alive."""
    per = listings.groupBy(key).agg(F.when(F.count_if(F.col(end).isNull()) == 0, F.max(end)).alias("last_observed"))
    as_of = listings.agg(F.max(end)).scalar()
    return per.withColumn("is_dead", F.coalesce(F.col("last_observed") < F.date_sub(as_of, grace), F.lit(False)))


def member_since(points: DataFrame, members: DataFrame, key: str, day: str, added: str = "date_added") -> DataFrame:
    """``in_index``: true where the member was added by the day, false where later or no member,
    null where the member's date is unknown."""
    m = members.groupBy(F.col(key).alias("__k")).agg(F.min(added).alias("__a"), F.lit(True).alias("__is"))
    on = points.join(m, points[key] == m["__k"], "left")
    return on.withColumn("in_index", F.when(F.col("__is").isNull(), False).when(F.col("__a").isNotNull(), F.col("__a") <= F.col(day))).drop("__k", "__a", "__is")


