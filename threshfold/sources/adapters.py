"""Price sources behind one contract: ``ticker, date, adj_close, close, volume`` (null where a source does not tell)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threshfold.operators.review import GateError, require, source_gate

Adapter = Callable[[SparkSession, dict], DataFrame]
REGISTRY: dict[str, Adapter] = {}


def adapter(name: str) -> Callable[[Adapter], Adapter]:
    def add(f: Adapter) -> Adapter:
        REGISTRY[name] = f
        return f

    return add


def _contract(prices: DataFrame) -> DataFrame:
    """``ticker, date, adj_close, close, volume``; what a source does not tell is null."""
    return prices.select("ticker", "date", *[(F.col(c) if c in prices.columns else F.lit(None)).cast("double").alias(c) for c in ("adj_close", "close", "volume")])


@adapter("parquet")
def _parquet(spark: SparkSession, options: dict) -> DataFrame:
    p = spark.read.parquet(options["path"])
    return _contract(p.withColumnsRenamed({options.get("symbol", "symbol"): "ticker", "close_px": "close"}))


@adapter("folder")
def _folder(spark: SparkSession, options: dict) -> DataFrame:
    from threshfold.sources.files import price_rows

    return _contract(price_rows(spark, options["path"]).withColumnRenamed("symbol", "ticker"))


@adapter("aggregates")
def _aggregates(spark: SparkSession, options: dict) -> DataFrame:
    """Newline JSON of bars with epoch milliseconds: ``{"ticker", "t", "c", "v"}``."""
    p = spark.read.schema("ticker string, t long, c double, v double").json(options["path"])
    return _contract(p.select("ticker", F.to_date(F.timestamp_millis("t")).alias("date"), F.col("c").alias("adj_close"), F.col("c").alias("close"), F.col("v").alias("volume")))


def history(spark: SparkSession, name: str, options: dict, probes: DataFrame | None = None, control: str | None = None) -> DataFrame:
    """The prices of a registered source. With ``probes`` the gate runs first and refuses a source
    that fails it; an unknown name is refused as well."""
    if name not in REGISTRY:
        raise GateError(f"no source {name}; there are {sorted(REGISTRY)}")
    prices = REGISTRY[name](spark, options).where("ticker is not null and date is not null and adj_close is not null")
    if probes is not None:
        require(source_gate(prices, probes, control))
    return prices
