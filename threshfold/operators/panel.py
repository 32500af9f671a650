"""From mentions to panels and funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threshfold.functions.stats import month_of, months_between, ratio, utc_date

DELETED = "[deleted]"


def known_author(c: Column | str = "author") -> Column:
    """The author, null for the sentinel of a deleted account."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != DELETED, c)


def confident(mentions: DataFrame, floor: float) -> DataFrame:
    """Mentions with at least this confidence; null confidence is below any floor."""
    return mentions.where(F.col("confidence") >= floor)


def mention_panel(mentions: DataFrame, docs: DataFrame, floor: float = 0.75, stance: DataFrame | None = None) -> DataFrame:
    """The entity by month panel.

    ``docs``: one row per (``doc_type, doc_id``) with ``doc_score, num_comments, lag_days,
    removed``. Mentions of a null entity are left out. Removed and top-level counts count
    mentions; thread comments count each document of a cell once. Without ``stance``
    (``doc_id, entity_id, stance``, and ``doc_type`` where it is known) its columns are null; of several stances
    of a document towards an entity the alphabetically first counts. The ticker is the
    cell's most frequent, the alphabetically first on a tie.

    Mentions are shuffled by document, where they meet it and become one row per entity and
    document; a hot entity is spread over its documents. A row then adds to its cell, and to one
    counter each for its tickers, authors and lag; counters combine on the map side, so a cell is
    made from its distinct tickers, authors and lags (whole seconds), whatever its mentions.
    """
    m = confident(mentions, floor).where(F.col("entity_id").isNotNull()).select("doc_type", "doc_id", "created_utc", known_author().alias("author"), "entity_id", "ticker", "channel", "in_title", "is_primary")
    m = m.withColumn("day", utc_date(F.col("created_utc"))).withColumn("year_month", month_of(F.col("day")))
    docs = docs.select(F.col("doc_type").alias("__type"), F.col("doc_id").alias("__id"), "doc_score", "num_comments", "lag_days", "removed")
    yes = lambda c: F.coalesce(c, F.lit(False))
    count_if = lambda c: F.count_if(c).cast("long")
    channels = ("cashtag", "bare", "name")
    per = m.repartition("doc_type", "doc_id").groupBy("doc_type", "doc_id", "entity_id", "year_month").agg(
        F.count(F.lit(1)).alias("n"), *[count_if(F.col("channel") == c).alias(f"n_{c}") for c in channels], count_if(yes(F.col("in_title"))).alias("n_in_title"), count_if(yes(F.col("is_primary"))).alias("n_primary"),
        F.min("day").alias("first_day"), F.collect_list("ticker").alias("tickers"), F.collect_set("author").alias("authors"),
    )
    per = per.join(docs, (per["doc_type"] == docs["__type"]) & (per["doc_id"] == docs["__id"]), "left").drop("__type", "__id")
    if stance is not None:
        keys = [k for k in ("doc_type", "doc_id", "entity_id") if k in stance.columns]
        per = per.join(stance.groupBy(*keys).agg(F.min("stance").alias("stance")), keys, "left")
    post, n = F.col("doc_type") == "post", F.col("n")
    nothing = F.lit(None).cast("long")
    stances = ("bullish", "bearish", "neutral", "question")
    sums = {
        "n_mentions": n, "n_toplevel_posts": F.when(post, n).otherwise(0), "total_score": F.col("doc_score").cast("long") * n, "n_removed": F.when(yes(F.col("removed")), n).otherwise(0),
        "threads": F.when(post, F.col("num_comments").cast("long")), **{f"n_{c}": F.col(f"n_{c}") for c in (*channels, "in_title", "primary")},
        **({f"n_{x}": F.when(F.col("stance") == x, n).otherwise(0) for x in stances} if stance is not None else {}),
    }
    cell = F.struct(F.lit("cell").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("lag"))
    of = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text"), F.lit(None).cast("double").alias("lag"))
    lag = F.when(F.col("lag_days").isNotNull(), F.array(F.struct(F.lit("lag").alias("kind"), F.lit(None).cast("string").alias("text"), F.col("lag_days").alias("lag")))).otherwise(F.array())
    parts = F.concat(F.array(cell), F.transform("tickers", of("ticker")), F.transform("authors", of("author")), lag)
    long = per.select("entity_id", "year_month", F.explode(parts).alias("part"), "first_day", F.col("doc_score").cast("long").alias("doc_score"), *[v.cast("long").alias(k) for k, v in sums.items()]).select("*", "part.*")
    is_cell = F.col("kind") == "cell"
    some = long.groupBy("entity_id", "year_month", "kind", "text", "lag").agg(
        F.count(F.lit(1)).alias("c"), F.sum("n_mentions").alias("w"), F.min("first_day").alias("first_day"), F.max(F.when(is_cell, F.col("doc_score"))).alias("max_score"), *[F.sum(F.when(is_cell, F.col(k))).alias(f"s_{k}") for k in sums]
    )
    kind = lambda k, c: F.when(F.col("kind") == k, c)
    cells = some.groupBy("entity_id", "year_month").agg(
        *[F.sum(f"s_{k}").alias(k) for k in sums], F.max("max_score").alias("max_score"), F.count(kind("author", F.lit(1))).alias("n_distinct_authors"), F.min("first_day").alias("first_day"),
        F.min_by(kind("ticker", F.col("text")), kind("ticker", F.struct(-F.col("c"), F.col("text")))).alias("ticker_at_date"),
        F.round(F.percentile(kind("lag", F.col("lag")), F.lit(0.5), F.when(F.col("kind") == "lag", F.col("w")).otherwise(F.lit(1))), 1).alias("score_lag_days_median"),
    )
    first = F.min("first_day").over(W.partitionBy("entity_id"))
    return (
        cells.withColumn("total_thread_comments", F.coalesce("threads", F.lit(0).cast("long")))
        .withColumn("months_since_first_mention", months_between(F.col("first_day"), first).cast("long"))
        .withColumn("first_mention_ever", F.col("months_since_first_mention") == 0)
        .withColumns({f"n_{x}": F.col(f"n_{x}") if stance is not None else nothing for x in stances})
        .drop("threads", "first_day")
    )


def documents_of(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """``doc_type, doc_id, doc_score, num_comments, lag_days, removed`` of posts and comments as delivered,
    each message once. The columns come along through the deduplication, no text does."""
    from threshfold.functions.symbols import message_key
    from threshfold.functions.text import removed
    from threshfold.operators.once import mark_surplus

    carry = {"doc_id": "string", "doc_score": "int", "num_comments": "int", "lag_days": "double", "removed": "boolean"}

    def slim(df: DataFrame, body: str) -> DataFrame:
        n = F.col("num_comments") if "num_comments" in df.columns else F.lit(None).cast("int")
        return df.select(
            "id", "ingest_no", "retrieved_on", message_key("id").alias("doc_id"), F.col("score").alias("doc_score"), n.alias("num_comments"),
            ((F.col("retrieved_on") - F.col("created_utc")) / 86400).alias("lag_days"), removed(F.col("removed_by_category"), F.col(body)).alias("removed"),
        )

    once = mark_surplus({"post": slim(posts, "selftext"), "comment": slim(comments, "body")}, carry=carry).where("not surplus")
    return once.select(F.col("src").alias("doc_type"), *carry)


def funnel(mentions: DataFrame, entity: str = "entity_id", by: list[str] | None = None, universe: int = 5000) -> DataFrame:
    """How many entities have at least 1, 2, 5 mentions and 2, 3 authors, and the shares of a universe."""
    by = by or []
    per = mentions.where(F.col(entity).isNotNull()).groupBy(*by, entity).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(known_author()).alias("a"))
    out = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("ever"), *[F.count_if(F.col("n") >= k).cast("long").alias(f"mentions_{k}") for k in (2, 5)], *[F.count_if(F.col("a") >= k).cast("long").alias(f"authors_{k}") for k in (2, 3)]
    )
    return out.withColumn("share_of_universe", F.col("ever") / F.lit(float(universe)))


def funnel_by_year(mentions: DataFrame, universe: DataFrame, fallback: int = 5000) -> DataFrame:
    """The funnel per calendar year against the listed universe of that year (``year, n_listed``)."""
    y = mentions.withColumn("year", F.year(utc_date(F.col("created_utc"))))
    f = funnel(y, by=["year"]).drop("share_of_universe").join(universe, "year", "left").withColumn("universe", F.coalesce("n_listed", F.lit(fallback).cast("long"))).drop("n_listed")
    return f.withColumn("share", ratio(F.col("ever"), F.col("universe")))


def rolling_funnel(mentions: DataFrame, days: int = 365, entity: str = "entity_id") -> DataFrame:
    """Per entity and day: mentions and active days in the ``days`` up to and with that day.

    Rows are days of one entity (pre-aggregated), so a window is bounded by the calendar."""
    per = mentions.where(F.col(entity).isNotNull()).groupBy(entity, utc_date(F.col("created_utc")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(entity).orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    return per.select(entity, "day", F.sum("n").over(w).alias("n_window"), F.count(F.lit(1)).over(w).alias("active_days"))


def primary_entities(mentions: DataFrame) -> DataFrame:
    """Per document: the most mentioned entity (the earliest span on a tie) and how many entities."""
    m = mentions.where(F.col("entity_id").isNotNull())
    per = m.groupBy("doc_type", "doc_id", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.min("span_start").alias("s"))
    return per.groupBy("doc_type", "doc_id").agg(F.min_by("entity_id", F.struct(-F.col("n"), F.col("s"), F.col("entity_id"))).alias("primary_entity"), F.count(F.lit(1)).alias("n_entities"))


def breakdown(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """Removed and kept documents: how many, how many with mentions, mentions per document."""
    per = mentions.groupBy("doc_type", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    d = docs.join(per, ["doc_type", "doc_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = d.groupBy("doc_type", "removed").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("n") > 0).cast("long").alias("n_with_mentions"), F.sum("n").alias("n_mentions"))
    return out.withColumn("mentions_per_doc", ratio(F.col("n_mentions"), F.col("n_docs")))
