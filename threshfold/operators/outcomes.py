"""Outcomes of names over horizons, from price series alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threshfold.functions.stats import add_years

TOLERANCE = 15
SIZE_DAYS = 60


def clean_prices(prices: DataFrame, key: str = "symbol") -> DataFrame:
    """``ticker, date, price, dollar_volume``: one row per spelling-free symbol and priced day.

    Rows without symbol, day or adjusted close are dropped, missing close or volume count as 0; of a
    day delivered several times the largest values stand."""
    from threshfold.functions.symbols import symbol_key

    ok = prices.where(F.col(key).isNotNull() & F.col("date").isNotNull() & F.col("adj_close").isNotNull())
    dv = F.coalesce("close_px", F.lit(0.0)) * F.coalesce("volume", F.lit(0.0))
    return ok.groupBy(symbol_key(key).alias("ticker"), "date").agg(F.max("adj_close").alias("price"), F.max(dv).alias("dollar_volume"))


def price_series(prices: DataFrame) -> DataFrame:
    """``ticker, obs``: the observations of a ticker (``date, price, dollar_volume``) in order of day. A
    series has one observation a day, which bounds the array by the calendar."""
    return prices.groupBy("ticker").agg(_in_order().alias("obs"))


def _in_order() -> Column:
    return F.array_sort(F.collect_list(F.struct("date", "price", "dollar_volume")))


def first_within(obs: Column, day: Column, days: int) -> Column:
    """The first observation from a day to ``days`` later, or null."""
    return F.get(F.filter(obs, lambda x: (x["date"] >= day) & (x["date"] <= F.date_add(day, days))), F.lit(0))


def last_until(obs: Column, day: Column) -> Column:
    """The last observation at or before a day, or null."""
    return F.try_element_at(F.filter(obs, lambda x: x["date"] <= day), F.lit(-1))


def size_proxy(obs: Column, entry: Column, observations: int = SIZE_DAYS, first_rows: int | None = None) -> Column:
    """The median dollar volume of the first observations at or after entry; ``first_rows`` looks only
    among the first that many observations of a series (null where none of them is left)."""
    near = F.filter(obs if first_rows is None else F.slice(obs, 1, first_rows), lambda x: x["date"] >= entry)
    v = F.array_sort(F.transform(F.slice(near, 1, observations), lambda x: x["dollar_volume"]))
    half = F.size(v) / 2
    return F.when(F.size(v) > 0, (F.get(v, F.floor(half - 0.5).cast("int")) + F.get(v, F.floor(half).cast("int"))) / 2)


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row: a generator keeps the optimizer from writing them
    into the conditions of later searches, where they would be computed for every observation."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.withColumn("__one", one).select("*", "__one.*").drop("__one")


def outcomes(cohort: DataFrame, prices: DataFrame, horizons: tuple[int, ...], benchmark: DataFrame | None = None, winner: float = 2.0, wipeout: float = -0.7, legacy_size_proxy: bool = False) -> DataFrame:
    """One row per name of ``cohort`` (``ticker, formation_date`` and whatever else) and horizon.

    Entry is the first price at or after formation, within 15 days and positive; without one there
    is no row. Exit is the first price at or after entry plus the horizon within 15 days; failing
    that, the last price before it (the series ended, and that is the outcome). Labels are set
    before rounding. ``exit_reason``: horizon, series_ended, hole (prices resume later) or censored
    (the target lies behind the last day of all prices). ``benchmark`` (``date, price``) gives
    return, excess and whether the name did better; null where it has no price.

    ``prices`` has one row per ticker and day (:func:`clean_prices`). Prices are shuffled once, into one
    series per ticker; a name meets its series in one join, and entry, target, exit, size and
    benchmark are then read off the arrays in the same row.
    """
    series = price_series(prices)
    last = series.agg(F.max(F.element_at("obs", -1)["date"])).scalar()

    def entered(c: DataFrame, obs: Column) -> DataFrame:
        c = _settled(c, __e=first_within(obs, F.col("formation_date"), TOLERANCE)).where(F.col("__e.price") > 0)
        each = [F.struct(F.lit(h).alias("horizon_years"), add_years(F.col("__e.date"), h).alias("__target")) for h in horizons]
        c = c.withColumn("__h", F.explode(F.array(*each))).select("*", "__h.*").drop("__h")
        c = _settled(c, __at=first_within(obs, F.col("__target"), TOLERANCE), __last=last_until(obs, F.col("__target"))).withColumn("__x", F.coalesce("__at", "__last"))
        c = c.where(F.col("__at").isNotNull() | (F.col("__x.date") > F.col("__e.date")))
        return c.withColumn("__ret", F.col("__x.price") / F.col("__e.price") - 1)

    c = entered(cohort.join(series.select(F.col("ticker").alias("__t"), F.col("obs").alias("__obs")), F.col("ticker") == F.col("__t")), F.col("__obs"))
    kept, target = F.col("__at").isNotNull(), F.col("__target")
    reason = F.when(kept, "horizon").when(F.element_at("__obs", -1)["date"] > target, "hole").when(target > last, "censored").otherwise("series_ended")
    size = size_proxy(F.col("__obs"), F.col("__e.date"), first_rows=200 if legacy_size_proxy else None)
    c = c.select(
        *cohort.columns, "horizon_years", F.col("__e.date").alias("entry_date"), F.round("__e.price", 6).alias("entry_price"), kept.alias("survived_full_horizon"),
        F.col("__x.date").alias("exit_date"), F.round("__x.price", 6).alias("exit_price"), reason.alias("exit_reason"), (F.col("__ret") >= winner).alias("winner_3x"), (F.col("__ret") <= wipeout).alias("wipeout"),
        F.round("__ret", 6).alias("forward_return"), F.round(F.coalesce(size, F.col("__e.dollar_volume"), F.lit(0.0)), 2).alias("dollar_volume"),
    )
    if benchmark is None:
        return c
    days = cohort.select("formation_date").distinct().withColumn("__b", benchmark.withColumn("dollar_volume", F.lit(0.0)).agg(_in_order()).scalar())
    r = entered(days, F.col("__b")).select("formation_date", "horizon_years", F.round("__ret", 6).alias("benchmark_return"))
    c = c.join(r, ["formation_date", "horizon_years"], "left")
    return c.withColumns({"outperformer": F.col("forward_return") > F.col("benchmark_return"), "excess_return": F.round(F.col("forward_return") - F.col("benchmark_return"), 6)})


def first_per_name(rows: DataFrame, key: str = "ticker", day: str = "formation_date", tie: str = "entry_date") -> DataFrame:
    """One row per name: the earliest formation, on a tie the smallest ``tie``."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(day, tie))).where("__r = 1").drop("__r")
