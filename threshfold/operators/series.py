"""Price series, regressions and lags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threshfold.functions.stats import month_of, ratio
from threshfold.session import written


def month_end_returns(prices: DataFrame) -> DataFrame:
    """``ticker, month, month_return`` over consecutive available months: a gap is one return.

    Prices are cut to one row per month before the window, so it sees months, not days."""
    m = prices.groupBy("ticker", month_of(F.col("date")).alias("month")).agg(F.max_by("price", "date").alias("p"))
    before = F.lag("p").over(W.partitionBy("ticker").orderBy("month"))
    return m.withColumn("month_return", ratio(F.col("p"), before) - 1).where("month_return is not null").drop("p")


def move_timing(rows: DataFrame, prices: DataFrame, lookback: int = 365, gain: float = 0.5, least: int = 60) -> DataFrame:
    """``ticker, peak_date, trough_date, gain, lag_days`` of names with a major move.

    The peak is the first maximum from ``lookback`` days before entry to exit, the trough the first
    minimum up to the peak; names with fewer than ``least`` observations, with the peak first, or
    with a smaller gain are left out. A positive lag: entry came after the trough."""
    r = rows.select("ticker", "entry_date", "exit_date")
    w = r.join(prices, "ticker").where((F.col("date") >= F.date_sub("entry_date", lookback)) & (F.col("date") <= F.col("exit_date")))
    key = ["ticker", "entry_date", "exit_date"]
    peak = w.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("start"), F.min_by(F.struct("date", "price"), F.struct(-F.col("price"), F.col("date"))).alias("peak"))
    peak = peak.where((F.col("n") >= least) & (F.col("peak.date") > F.col("start")))
    low = w.join(peak, key).where(F.col("date") <= F.col("peak.date")).groupBy(*key).agg(F.min(F.struct("price", "date")).alias("trough"), F.first("peak").alias("peak"))
    low = low.withColumn("gain", ratio(F.col("peak.price"), F.col("trough.price")) - 1).where(F.col("gain") >= gain)
    return low.select("ticker", F.col("peak.date").alias("peak_date"), F.col("trough.date").alias("trough_date"), "gain", F.datediff("entry_date", F.col("trough.date")).alias("lag_days"))


def timing_summary(timing: DataFrame, least: int = 10) -> DataFrame:
    """One row (none below ``least`` names): names, share after the move began, median lag."""
    out = timing.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("lag_days") > 0).cast("double")).alias("share_after"), F.median("lag_days").alias("median_lag_days"))
    return out.where(F.col("n") >= least)


def gram(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """One row: n and all sums of products of (1, xs, y), in one pass over the rows without nulls."""
    names = ["one", *xs, y]
    d = df.select(*xs, y).dropna().withColumn("one", F.lit(1.0))
    return d.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for i, a in enumerate(names) for b in names[i:]])


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """``term, beta, se``: least squares with intercept from the Gram matrix; no rows where it is
    singular. The driver solves a matrix as wide as there are terms."""
    import numpy as np

    g = gram(df, y, xs).first()
    names = ["one", *xs, y]
    k = len(xs) + 1
    m = np.array([[float(g[f"{a}__{b}"] if i <= j else g[f"{b}__{a}"]) if g["one__one"] is not None else 0.0 for j, b in enumerate(names)] for i, a in enumerate(names)])
    a, b, n = m[:k, :k], m[:k, k], m[0, 0]
    schema = "term string, beta double, se double"
    if n < k or np.linalg.matrix_rank(a) < k:
        return df.sparkSession.createDataFrame([], schema)
    beta = np.linalg.solve(a, b)
    rss = max(float(m[k, k] - beta @ b), 0.0)
    se = np.sqrt(np.diag(np.linalg.inv(a)) * rss / (n - k)) if n > k else np.full(k, np.nan)
    return df.sparkSession.createDataFrame([(t, float(x), float(s)) for t, x, s in zip(["intercept", *xs], beta, se, strict=True)], schema)


def factor_alpha(returns: DataFrame, factors: DataFrame, xs: list[str], risk_free: str = "rf", least_names: int = 5, least_months: int = 24) -> DataFrame:
    """Least squares of an equal-weighted portfolio's monthly excess return on factors.

    Months with fewer than ``least_names`` names are left out; below ``least_months`` months there
    are no rows. ``t_residual`` is alpha over the residuals' standard error, as published; ``t_ols``
    uses the intercept's own standard error."""
    port = returns.groupBy("month").agg(F.avg("month_return").alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_names)
    d = port.join(factors, "month").withColumn("y", F.col("r") - F.col(risk_free)).select("y", *xs).dropna()
    fit = ols(d, "y", xs)
    b = {r["term"]: r for r in fit.collect()}  # one row per term
    spark = returns.sparkSession
    schema = "months long, alpha_monthly double, alpha_annual double, t_residual double, t_ols double"
    if not b or (n := d.count()) < least_months:
        return spark.createDataFrame([], schema)
    alpha = b["intercept"]["beta"]
    hat = F.lit(alpha)
    for x in xs:
        hat = hat + F.lit(b[x]["beta"]) * F.col(x)
    sd = d.agg(F.stddev_pop(F.col("y") - hat)).first()[0]
    se = sd / n**0.5
    return spark.createDataFrame([(n, alpha, (1 + alpha) ** 12 - 1, alpha / se if se else None, alpha / b["intercept"]["se"] if b["intercept"]["se"] else None)], schema)


def ordinal_ranks(df: DataFrame, out: str, *order: str) -> DataFrame:
    """``df`` with its ordinal place, 1 to n, in an order. A distributed sort is written to the shared
    folder with each row's place in its partition, and the partitions' sizes (one row per partition) give the offsets,
    so no task sees the whole table."""
    s = written(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "ranked").withColumn("__p", F.shiftright("__m", 33))
    sizes = s.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return s.join(before, "__p").withColumn(out, place).drop("__m", "__p", "__before")


def spearman_ordinal(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """One row, ``rho``: the correlation of ordinal ranks (ties by ``tie``, not averaged) of the rows
    without nulls; null for fewer than two rows."""
    d = df.select(F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(tie).alias("__tie")).dropna()
    r = ordinal_ranks(ordinal_ranks(d, "__a", "__x", "__tie"), "__b", "__y", "__tie")
    return r.agg(F.corr(F.col("__a").cast("double"), F.col("__b").cast("double")).alias("rho"), F.count(F.lit(1)).alias("n"))


def capture_lag(docs: DataFrame, created: str = "created_utc", retrieved: str = "retrieved_on", score: str = "score") -> DataFrame:
    """Per year of creation, and over all years (year null): documents with a retrieval time, lag in days (median, mean, least,
    most), share within a day, share with a score of at most 1 (none counts as 0), and a verdict."""
    d = docs.where(F.col(created).isNotNull() & F.col(retrieved).isNotNull())
    lag = (F.col(retrieved) - F.col(created)) / 86400
    d = d.select(F.year(F.to_date(F.timestamp_seconds(created))).alias("year"), lag.alias("lag"), (F.coalesce(score, F.lit(0)) <= 1).alias("low"))
    d = d.withColumn("year", F.explode(F.array("year", F.lit(None).cast("int"))))
    out = d.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.median("lag").alias("median_lag"), F.avg("lag").alias("mean_lag"), F.min("lag").alias("min_lag"), F.max("lag").alias("max_lag"),
        F.avg((F.col("lag") < 1).cast("double")).alias("share_fast"), F.avg(F.col("low").cast("double")).alias("share_low_score"),
    )
    return out.withColumn("verdict", F.when((F.col("median_lag") < 1) | (F.col("share_fast") > 0.5), "UNRELIABLE").otherwise("usable"))
