"""Treated and control names, their signals and their calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threshfold.functions.stats import month_of, utc_date
from threshfold.operators.panel import confident, known_author


def shuffle_key(seed: int, *keys: Column | str) -> Column:
    """A place in a random order that depends on the seed and the keys only: the same on any
    partitioning and any engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k if isinstance(k, Column) else F.col(k) for k in keys]))


def treated_names(mentions: DataFrame, name: Column, years: tuple[int, ...], min_authors: int, floor: float = 0.75) -> DataFrame:
    """Names with at least ``min_authors`` distinct authors in the years: mentions, authors, first
    day and month, and the entity first seen with the name (smallest on a tie)."""
    m = confident(mentions, floor).withColumn("ticker", name).withColumn("day", utc_date(F.col("created_utc")))
    m = m.where(F.col("ticker").isNotNull() & F.year("day").isin(*years))
    out = m.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_mentions"),
        F.count_distinct(known_author()).alias("n_authors"),
        F.min("day").alias("first_mention"),
        F.min_by("entity_id", F.struct("created_utc", "mention_no")).alias("entity_id"),
    )
    return out.where(F.col("n_authors") >= min_authors).withColumn("formation_month", month_of(F.col("first_mention")))


def top_names(names: DataFrame, n: int, by: str = "n_mentions", key: str = "ticker") -> DataFrame:
    """The ``n`` names with most mentions, ties by name: what a symbol quota leaves room for."""
    return names.orderBy(F.desc(by), key).limit(n)


def control_pool(universe: DataFrame, treated: DataFrame, key: str = "ticker") -> DataFrame:
    """Names of the universe that are not treated."""
    return universe.select(key).where(F.col(key).isNotNull()).distinct().join(treated.select(key), key, "left_anti")


def draw(pool: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """A simple random sample without replacement of ``n`` rows, fixed by seed and keys."""
    return pool.orderBy(shuffle_key(seed, *keys), *keys).limit(n)


def matched_dates(treated: DataFrame, controls: DataFrame, seed: int, key: str = "ticker", day: str = "first_mention") -> DataFrame:
    """Controls with formation days that repeat the treated days' distribution exactly.

    The i-th control in random order gets the sorted treated days' entry ``floor(i * T / n)``.
    Cohorts hold names, not mentions, so the ordinals are taken over few rows."""
    t = treated.select(day, key).withColumn("__i", F.row_number().over(W.orderBy(day, key)) - 1)
    c = controls.withColumn("__r", F.row_number().over(W.orderBy(shuffle_key(seed, key), key)) - 1)
    nt, nc = treated.agg(F.count(F.lit(1))).scalar(), controls.agg(F.count(F.lit(1))).scalar()
    c = c.withColumn("__at", F.floor(F.col("__r") * nt / nc))
    t = t.select(F.col(day).alias("formation_date"), F.col("__i").cast("long").alias("__i"))
    return c.join(t, c["__at"] == t["__i"]).drop("__r", "__at", "__i")


def ranking_signals(mentions: DataFrame, scores: DataFrame, name: Column, years: tuple[int, ...], floor: float = 0.75) -> DataFrame:
    """Per name: mentions, authors, and total and highest score over its distinct documents.

    ``scores``: one row per (``doc_type, doc_id``) with ``doc_score``; missing scores count as 0,
    the highest score is at least 0."""
    m = confident(mentions, floor).withColumn("ticker", name)
    m = m.where(F.col("ticker").isNotNull() & F.year(utc_date(F.col("created_utc"))).isin(*years))
    per_doc = m.select("ticker", "doc_type", "doc_id").distinct().join(scores, ["doc_type", "doc_id"], "left")
    s = F.coalesce("doc_score", F.lit(0))
    docs = per_doc.groupBy("ticker").agg(F.sum(s).alias("total_score"), F.greatest(F.max(s), F.lit(0)).cast("long").alias("max_score"))
    return m.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_mentions"), F.count_distinct(known_author()).alias("n_authors")).join(docs, "ticker")


def fetch_plan(benchmarks: DataFrame, treated: DataFrame, controls: DataFrame, done: DataFrame | None = None, key: str = "ticker") -> DataFrame:
    """``place, ticker``: benchmarks first, then treated and controls interleaved in proportion,
    each name once at its first place, without names already ``done``."""
    nt, nc = treated.agg(F.count(F.lit(1))).scalar(), controls.agg(F.count(F.lit(1))).scalar()
    per = F.greatest(F.lit(1), F.round(nt / F.greatest(nc, F.lit(1))))
    t = treated.select(F.col(key), (F.row_number().over(W.orderBy(F.desc("n_mentions"), key)) - 1).alias("i")).select(key, F.lit(1).alias("part"), F.floor(F.col("i") / per).alias("turn"), F.lit(0).alias("who"), "i")
    c = controls.select(F.col(key), (F.row_number().over(W.orderBy(key)) - 1).alias("i")).select(key, F.lit(1).alias("part"), F.col("i").cast("long").alias("turn"), F.lit(1).alias("who"), "i")
    b = benchmarks.select(F.col(key), F.lit(0).alias("part"), F.lit(0).cast("long").alias("turn"), F.lit(0).alias("who"), F.lit(0).alias("i"))
    once = b.unionByName(t).unionByName(c).groupBy(key).agg(F.min(F.struct("part", "turn", "who", "i")).alias("at"))
    out = once.select(F.row_number().over(W.orderBy("at", key)).alias("place"), key)
    return out if done is None else out.join(done.select(key), key, "left_anti").select("place", key)
