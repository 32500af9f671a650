"""Attributes as known at an event's time.

Statements say what an entity bore from one day to another, and each has the day on which it
became known. For every attribute an own history of changes is kept: on each day the value of
the latest-known statement that covers the day and was known by then, written only where it
changes. Events are reduced to their distinct (entity, day) pairs, each attribute is matched by
itself (last change at or before the day), and the matches are pivoted back to one row.

Skew: an entity with a third of all events has at most as many pairs as there are days; the
events themselves join on (entity, day).
"""

from __future__ import annotations

import heapq
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HISTORY = "entity string, attr string, day date, value string"


def _sweep(pdf: pd.DataFrame) -> pd.DataFrame:
    """Change points of one (entity, attribute). Of statements known on the same day the one with
    the largest number wins."""
    pdf = pdf.sort_values(["begin", "known_on", "no"])
    rows = list(zip(pdf["begin"], pdf["listed_to"], pdf["known_on"], pdf["no"], pdf["value"], strict=True))
    days = sorted({r[0] for r in rows} | {r[1] + timedelta(days=1) for r in rows if pd.notna(r[1])})
    out, heap, i, now = [], [], 0, None
    for day in days:
        while i < len(rows) and rows[i][0] <= day:
            b, to, known, no, value = rows[i]
            heapq.heappush(heap, (-known.toordinal(), -no, i))
            i += 1
        while heap and pd.notna(rows[heap[0][2]][1]) and rows[heap[0][2]][1] < day:
            heapq.heappop(heap)
        value = rows[heap[0][2]][4] if heap else None
        if value != now:
            out.append((day, value))
            now = value
    return pd.DataFrame({"entity": pdf["entity"].iloc[0], "attr": pdf["attr"].iloc[0], "day": [d for d, _ in out], "value": [v for _, v in out]})


def change_history(statements: DataFrame, entity: str, attrs: list[str], number: str = "listing_no", begin: str = "listed_from", end: str = "listed_to", known: str = "known_on") -> DataFrame:
    """``entity, attr, day, value``: the value known from ``day`` on; null where nothing holds.

    Each attribute is swept by itself; a statement with a null value says nothing about it.
    Null ``begin`` or ``known`` count as always, null ``end`` as open. Repeated statements are
    merged before anything is grouped, so a group is the distinct statements about one attribute
    of one entity.
    """
    base = statements.where(F.col(entity).isNotNull())
    long = base.select(
        F.col(entity).cast("string").alias("entity"),
        F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attrs])).alias("kv"),
        F.coalesce(F.col(begin), F.lit("0001-01-01").cast("date")).alias("listed_from"),
        F.col(end).alias("listed_to"),
        F.coalesce(F.col(known), F.lit("0001-01-01").cast("date")).alias("known_on"),
        F.col(number).cast("long").alias("no"),
    ).select("entity", "kv.*", "listed_from", "listed_to", "known_on", "no")
    long = long.where("value is not null and (listed_to is null or listed_to >= greatest(listed_from, known_on))")
    long = long.groupBy("entity", "attr", "value", "listed_from", "listed_to", "known_on").agg(F.max("no").alias("no"))
    long = long.withColumn("begin", F.greatest("listed_from", "known_on"))
    return long.groupBy("entity", "attr").applyInPandas(_sweep, HISTORY)


def known_at(events: DataFrame, history: DataFrame, attrs: list[str], entity: str = "entity", day: str = "day") -> DataFrame:
    """The distinct (entity, day) pairs of ``events`` with each attribute as known on that day.

    Events with a null entity or day have no pair. Columns: ``entity, day`` and the attributes.
    """
    pairs = events.select(F.col(entity).cast("string").alias("entity"), F.col(day).alias("day")).where("entity is not null and day is not null").distinct()
    asked = pairs.select("entity", F.explode(F.array(*[F.lit(a) for a in attrs])).alias("attr"), "day", F.lit(1).alias("asks"), F.lit(None).cast("struct<value:string>").alias("said"))
    told = history.select("entity", "attr", "day", F.lit(0).alias("asks"), F.struct("value").alias("said"))
    w = W.partitionBy("entity", "attr").orderBy("day", "asks").rowsBetween(W.unboundedPreceding, 0)
    last = asked.unionByName(told).withColumn("said", F.last("said", ignorenulls=True).over(w)).where("asks = 1")
    return last.groupBy("entity", "day").agg(*[F.max(F.when(F.col("attr") == a, F.col("said.value"))).alias(a) for a in attrs])


def attach_known(events: DataFrame, statements: DataFrame, attrs: list[str], event_entity: str, event_day: str, entity: str = "entity_id", prefix: str = "known_") -> DataFrame:
    """``events`` with ``known_<attr>`` columns; null where no statement held or entity or day is null.

    All rows and columns of ``events`` stay, whatever they are called.
    """
    got = known_at(events, change_history(statements, entity, attrs), attrs, event_entity, event_day)
    got = got.select(F.col("entity").alias("__entity"), F.col("day").alias("__day"), *[F.col(a).alias(prefix + a) for a in attrs])
    on = (events[event_entity].cast("string") == got["__entity"]) & (events[event_day] == got["__day"])
    return events.join(got, on, "left").drop("__entity", "__day")
