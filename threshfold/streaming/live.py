"""The panel, ingestion and quotas as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threshfold.functions.symbols import message_key


def stream_panel(mentions: DataFrame, floor: float = 0.75, window: str = "30 days", delay: str = "7 days", slide: str | None = None) -> DataFrame:
    """Entity by window counts of a mention stream; rows later than ``delay`` are dropped.

    Distinct authors are approximate (2 % standard error), as streams hold no exact sets. With
    ``slide`` the windows overlap: ``365 days`` sliding by ``30 days`` is the rolling funnel."""
    m = mentions.where((F.col("confidence") >= floor) & F.col("entity_id").isNotNull()).withColumn("ts", F.timestamp_seconds("created_utc")).withWatermark("ts", delay)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    author = F.when(F.col("author") != "[deleted]", F.col("author"))
    out = m.groupBy("entity_id", w.alias("w")).agg(
        F.count(F.lit(1)).alias("n_mentions"), F.approx_count_distinct(author, 0.02).alias("n_authors"), F.sum("score").alias("total_score"), *[F.count_if(F.col("channel") == c).alias(f"n_{c}") for c in ("cashtag", "bare", "name")]
    )
    return out.select("entity_id", F.col("w.start").alias("window_start"), *[c for c in out.columns if c not in ("entity_id", "w")])


def sessions(mentions: DataFrame, gap: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Bursts of mentions of an entity that are at most ``gap`` apart."""
    m = mentions.where("entity_id is not null").withColumn("ts", F.timestamp_seconds("created_utc")).withWatermark("ts", delay)
    out = m.groupBy("entity_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_mentions"))
    return out.select("entity_id", F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "n_mentions")


def stream_once(messages: DataFrame, id_col: str = "id", delay: str = "30 days") -> DataFrame:
    """One row per message identifier within the watermark; state older than ``delay`` is dropped."""
    keyed = messages.withColumn("__ts", F.timestamp_seconds("created_utc")).withColumn("__key", message_key(id_col)).withWatermark("__ts", delay)
    return keyed.dropDuplicatesWithinWatermark(["__key"]).drop("__ts", "__key")


def limit_rate(calls: DataFrame, limits: dict[int, int], key: str = "name", at: str = "at", delay: str = "1 minute") -> DataFrame:
    """``name, at, granted`` of a call stream (``at``: seconds): a call is granted where no window of
    any limit (seconds to most calls) would hold more granted calls than it may. The state of a name is its
    granted calls within the longest window, which the limits bound."""
    longest = max(limits)

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        parts = list(batches)
        if not parts:  # the watermark passed: nothing of the state is within reach any more
            state.remove()
            return
        out = []
        for t in sorted(pd.concat(parts)["at"].tolist()):
            kept = [x for x in kept if x > t - longest]
            ok = all(sum(1 for x in kept if x > t - s) < n for s, n in limits.items())
            if ok:
                kept.append(t)
            out.append((k[0], t, ok))
        state.update((kept,))
        state.setTimeoutTimestamp(max((max(kept, default=0) + longest + 1) * 1000, state.getCurrentWatermarkMs() + 1000))
        yield pd.DataFrame(out, columns=["name", "at", "granted"])

    c = calls.select(F.col(key).alias("name"), F.col(at).cast("long").alias("at")).withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", delay)
    out = T.StructType.fromDDL("name string, at long, granted boolean")
    return c.groupBy("name").applyInPandasWithState(step, out, T.StructType.fromDDL("kept array<bigint>"), "append", "EventTimeTimeout")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now into a parquet folder, restartable from its checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
