"""Vocabularies of symbols and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threshfold.functions.text import normalise_name

# Patterns of securities that are no common shares, and exchange test symbols.
NOT_COMMON = r"(?i)(-P-|-PR|\.PR|-WT|-WS|\.WS|-U$|-UN$|-RT|-R$|-CL$|-W$)"
TEST_SYMBOL = r"(?i)^(N?TEST|ZTEST|ZVZZT|ZXZZT|ZWZZT|ZJZZT|IBM[0-9])"
DISTINCTIVE_RANK = 50_000


def common_equity(listings: DataFrame, key: str = "ticker") -> DataFrame:
    """Listings of common shares: no preferred, warrant, unit or right by pattern, no test symbol, and
    no five letters that end in W, U or R while their first four are a symbol of the table. Null symbols go."""
    ok = listings.where(F.col(key).isNotNull() & ~F.col(key).rlike(NOT_COMMON) & ~F.col(key).rlike(TEST_SYMBOL))
    stems = listings.where(F.length(key) == 4).select(F.col(key).alias("__stem")).distinct()
    suffixed = (F.length(F.col(key)) == 5) & F.substring(F.col(key), 5, 1).isin("W", "U", "R")
    return ok.join(stems, suffixed & (F.substring(F.col(key), 1, 4) == F.col("__stem")), "left_anti")


def derive_aliases(names: DataFrame, ranks: DataFrame, entity: str = "entity_id", name: str = "name", order: str = "listing_no", word: str = "word", rank: str = "rank_no", common: int = DISTINCTIVE_RANK) -> DataFrame:
    """``alias, entity_id``: what a company may be called. A single word needs four letters and must
    not be a common word; several words need six letters in all, and their first word counts too where
    it has six letters and is not common. Of entities with one alias the first in ``order`` keeps it."""
    n = names.where(F.col(name).isNotNull() & F.col(entity).isNotNull()).select(F.col(entity).alias("entity_id"), F.col(order).alias("o"), normalise_name(F.col(name)).alias("a"))
    many, head = F.col("a").contains(" "), F.split("a", " ")[0]
    whole = F.when(many & (F.length("a") >= 6), F.struct(F.col("a").alias("alias"), F.lit(False).alias("proof"))).when(~many & (F.length("a") >= 4), F.struct(F.col("a").alias("alias"), F.lit(True).alias("proof")))
    first = F.when(many & (F.length("a") >= 6) & (F.length(head) >= 6), F.struct(head.alias("alias"), F.lit(True).alias("proof")))
    cand = n.select("entity_id", "o", F.explode(F.array(whole, first)).alias("c")).where("c is not null").select("entity_id", "o", "c.*")
    known = ranks.where(F.col(word).isNotNull() & (F.col(rank) <= common)).select(F.lower(word).alias("alias"), F.lit(True).alias("__w")).distinct()
    ok = cand.join(known, "alias", "left").where(~F.col("proof") | F.col("__w").isNull())
    return ok.groupBy("alias").agg(F.min_by("entity_id", F.struct("o", "entity_id")).alias("entity_id"))


def delisted_topup(symbols: DataFrame, listings: DataFrame, key: str = "ticker", prefix: str = "TIINGO:") -> DataFrame:
    """``ticker, entity_id, delisted``: the symbols, and those of the listings that are not among them, under
    an identifier made of the symbol."""
    have = symbols.where(F.col(key).isNotNull()).groupBy(F.upper(F.trim(key)).alias("ticker")).agg(F.min("entity_id").alias("entity_id"))
    more = listings.where(F.col(key).isNotNull()).select(F.upper(F.trim(key)).alias("ticker")).where("ticker <> ''").distinct().join(have, "ticker", "left_anti")
    return have.withColumn("delisted", F.lit(False)).unionByName(more.select("ticker", F.concat(F.lit(prefix), "ticker").alias("entity_id"), F.lit(True).alias("delisted")))


def usable_cohorts(funnel: DataFrame, as_of: int, horizon: int, first: int = 2015, least: int = 200, share: Column | None = None) -> DataFrame:
    """One row: the widest cohort that has had its horizon (and more than ``least`` mentions) and its
    verdict. ``funnel``: ``year, n_mentions, mentions_2, universe``; no usable cohort gives nulls."""
    s = F.try_divide(F.col("mentions_2").cast("double"), F.col("universe").cast("double")) if share is None else share
    ok = funnel.where((F.col("year") >= first) & (F.col("year") <= as_of - horizon) & (F.col("n_mentions") > least)).withColumn("share", s)
    out = ok.agg(F.max_by("year", F.struct(F.col("share"), -F.col("year"))).alias("widest_year"), F.max("share").alias("share"), F.count(F.lit(1)).alias("n_cohorts"))
    verdict = F.when(F.col("share").isNull(), "INSUFFICIENT").when(F.col("share") > 0.5, "FAIL").when(F.col("share") > 0.25, "MARGINAL").otherwise("PASS")
    return out.withColumn("verdict", verdict).withColumn("horizon", F.lit(horizon))


def listed_stocks(listings: DataFrame, exchanges: tuple[str, ...], kinds: tuple[str, ...] | None = None, exchange: str = "exchange", kind: str = "asset_type", begin: str = "listed_from", key: str = "ticker") -> DataFrame:
    """Listings of common shares on some exchanges, of some asset types where these are told, with a first day.
    A null exchange or type is none of those asked for."""
    ok = listings.where(F.col(exchange).isin(*exchanges) & F.col(begin).isNotNull())
    if kinds is not None:
        ok = ok.where(F.col(kind).isin(*kinds))
    return common_equity(ok, key)
