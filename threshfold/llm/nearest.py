"""Pairing records of two tables by nearest time, as a stateful join of two streams.

Per entity both sides are buffered. When the watermark has passed a left record's time plus the
tolerance, no closer right record can come: the left record is emitted with its nearest
candidate and leaves the buffer, and candidates that no pending or later left record can reach
are evicted. :class:`NearestBuffer` is that state. It is driven in two ways:

* :func:`nearest_join` replays bounded tables in event-time order, which makes the event time
  itself a perfect watermark;
* :func:`nearest_stream` runs on Structured Streaming with ``applyInPandasWithState``.

Skew: the state key is (entity, slab of time); right records within reach of a slab's border go
to both slabs, so an entity with a third of all rows is as many keys as it has slabs, and what a
key buffers is at most the rows of two tolerances. Left records are matched each by itself, so a slab
that holds more than its share of them is salted: its left records are dealt to several keys and its
right records, at most one a second, are copied to each. A slab is hot beyond ``total / (SHARES *
partitions)`` records; fewer than ``SHARES * partitions`` slabs can be, which bounds the broadcast
list of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of one slab.
SLAB = 14 * 86_400
#: Left records below which no slab is salted, and how many shares of a task make a hot slab.
HOT, SHARES = 200_000, 4
_END = np.iinfo(np.int64).max


class NearestBuffer:
    """State of one key: pending left records and live right candidates, both in time order."""

    def __init__(self, tolerance: int, lt=(), lid=(), rt=(), rv=()) -> None:
        self.tol = int(tolerance)
        self.lt, self.lid = np.asarray(lt, np.int64), np.asarray(lid, np.int64)
        self.rt, self.rv = np.asarray(rt, np.int64), np.asarray(rv, np.float64)

    def push(self, lt: np.ndarray, lid: np.ndarray, rt: np.ndarray, rv: np.ndarray, watermark: int) -> tuple[np.ndarray, ...]:
        """Take in rows, then emit what the watermark has settled: left ids, right times (-1: none) and values."""
        if len(lt):
            self.lt, self.lid = np.concatenate([self.lt, lt]), np.concatenate([self.lid, lid])
            o = np.lexsort((self.lid, self.lt))
            self.lt, self.lid = self.lt[o], self.lid[o]
        if len(rt):
            self.rt, self.rv = np.concatenate([self.rt, rt]), np.concatenate([self.rv, rv])
            o = np.lexsort((-self.rv, self.rt))
            self.rt, self.rv = self.rt[o], self.rv[o]
            first = np.concatenate([[True], self.rt[1:] != self.rt[:-1]])
            self.rt, self.rv = self.rt[first], self.rv[first]
        k = len(self.lt) if watermark >= _END - self.tol else int(np.searchsorted(self.lt, watermark - self.tol, side="left"))
        t, out_id = self.lt[:k], self.lid[:k]
        self.lt, self.lid = self.lt[k:], self.lid[k:]
        at, value = np.full(k, -1, np.int64), np.full(k, np.nan)
        if k and len(self.rt):
            hi = np.searchsorted(self.rt, t, side="right")
            before, after = np.maximum(hi - 1, 0), np.minimum(hi, len(self.rt) - 1)
            db = np.where(hi > 0, t - self.rt[before], _END)
            da = np.where(hi < len(self.rt), self.rt[after] - t, _END)
            best = np.where(db <= da, before, after)
            ok = np.minimum(db, da) <= self.tol
            at[ok], value[ok] = self.rt[best[ok]], self.rv[best[ok]]
        if len(self.rt):  # evict what neither pending nor coming left records reach
            reach = (self.lt[0] if len(self.lt) else watermark) - self.tol if watermark < _END else _END
            keep = np.searchsorted(self.rt, min(reach, watermark - self.tol), side="left")
            self.rt, self.rv = self.rt[keep:], self.rv[keep:]
        return out_id, at, value


_TAGGED = "entity string, slab long, at long, kind int, row_no long, value double"
PAIR = "row_no long, match_at long, match_value double"


def _tagged(left: DataFrame, right: DataFrame, tol: int, slab: int, streaming: bool = False) -> DataFrame:
    """Both sides as one table of (entity, slab, time); kind 0 right, 1 left."""
    where = lambda t: F.floor(t / F.lit(slab))
    r = right.where("entity is not null and at is not null and value is not null")
    if not streaming:
        r = r.groupBy("entity", "at").agg(F.max("value").alias("value"))
    r = r.select("entity", F.explode(F.sequence(where(F.col("at") - tol), where(F.col("at") + tol))).alias("slab"), "at", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("row_no"), "value")  # a null would make pandas round the others
    x = left.where("entity is not null and at is not null").select("entity", where(F.col("at")).alias("slab"), "at", F.lit(1).alias("kind"), F.coalesce("row_no", F.lit(-1).cast("long")).alias("row_no"), F.lit(None).cast("double").alias("value"))
    return r.unionByName(x)


def _replay(tol: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, NearestBuffer(tol)
        none_l, none_v = np.zeros(0, np.int64), np.zeros(0)

        def shape(parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
            ids, at, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pd.DataFrame({"row_no": ids, "match_at": pd.array(at, dtype="Int64").astype("Int64"), "match_value": value}).assign(match_at=lambda z: z["match_at"].mask(z["match_at"] == -1))

        for b in batches:
            if not len(b):
                continue
            out = []
            entity, slab, salt = b["entity"].to_numpy(object), b["slab"].to_numpy(np.int64), b["salt"].to_numpy(np.int64)
            at, kind = b["at"].to_numpy(np.int64), b["kind"].to_numpy()
            row, value = b["row_no"].to_numpy(np.int64), b["value"].to_numpy(np.float64)
            cuts = np.flatnonzero(np.concatenate([[True], (entity[1:] != entity[:-1]) | (slab[1:] != slab[:-1]) | (salt[1:] != salt[:-1])]))
            for a, z in zip(cuts, [*cuts[1:], len(b)], strict=True):
                if (now := (entity[a], slab[a], salt[a])) != key:
                    out.append(state.push(none_l, none_l, none_l, none_v, _END))
                    key, state = now, NearestBuffer(tol)
                is_left = kind[a:z] == 1
                t, n, v = at[a:z], row[a:z], value[a:z]
                out.append(state.push(t[is_left], n[is_left], t[~is_left], v[~is_left], int(t[-1])))
            yield shape(out)
        yield shape([state.push(none_l, none_l, none_l, none_v, _END)])

    return run


def _salted(rows: DataFrame, left: DataFrame, hot: int) -> DataFrame:
    """``rows`` with ``salt``: 0, or for a hot slab one of as many as it has shares (left records by
    their number, right records in every one)."""
    most = F.greatest(F.lit(hot), F.floor(left.agg(F.count(F.lit(1))).scalar() / (SHARES * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    n = rows.where("kind = 1").groupBy("entity", "slab").agg(F.count(F.lit(1)).alias("n"))
    busy = n.where(F.col("n") > most).select("entity", "slab", F.ceil(F.col("n") / most).cast("int").alias("salts"))
    one = F.array(F.pmod(F.xxhash64("row_no", "at"), F.col("salts")).cast("int"))
    each = F.when(F.col("salts").isNull(), F.array(F.lit(0))).when(F.col("kind") == 1, one).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    return rows.join(F.broadcast(busy), ["entity", "slab"], "left").withColumn("salt", F.explode(each)).drop("salts")


def nearest_join(left: DataFrame, right: DataFrame, tolerance: int, slab: int = SLAB, hot: int = HOT) -> DataFrame:
    """``row_no, match_at, match_value`` for every left record.

    ``left`` has ``entity, at, row_no`` (seconds), ``right`` has ``entity, at, value``. The match
    is the right record of the same entity with the smallest distance, at most ``tolerance``; on
    equal distance the earlier, of several at one time the largest value. Left records with a null
    entity or time, or without a candidate, come out with nulls; right records with a null entity,
    time or value are none. Either side may be empty; repeated left records stay repeated.
    """
    if slab < tolerance:
        raise ValueError("a slab is at least as long as the tolerance")
    rows = _salted(_tagged(left, right, tolerance, slab), left, hot)
    rows = rows.repartition("entity", "slab", "salt").sortWithinPartitions("entity", "slab", "salt", "at", "kind", "row_no")
    found = rows.mapInPandas(_replay(tolerance), PAIR)
    null = F.lit(None)
    lost = left.where("entity is null or at is null").select("row_no", null.cast("long").alias("match_at"), null.cast("double").alias("match_value"))
    return found.unionByName(lost)


_STATE = "lt array<bigint>, lid array<bigint>, rt array<bigint>, rv array<double>"


def nearest_stream(left: DataFrame, right: DataFrame, tolerance: int, delay: str, slab: int = SLAB) -> DataFrame:
    """The same join of two streaming tables (columns as in :func:`nearest_join`).

    Records later than ``delay`` behind the latest are dropped by the watermark; a left record is
    emitted once the watermark has passed its time plus the tolerance.
    """

    def step(key, batches, state):
        buf = NearestBuffer(tolerance, *state.get) if state.exists else NearestBuffer(tolerance)
        parts = list(batches)
        b = pd.concat(parts) if parts else pd.DataFrame({"at": [], "kind": [], "row_no": [], "value": []})
        mark = state.getCurrentWatermarkMs() // 1000
        is_left = (b["kind"] == 1).to_numpy(dtype=bool)
        at = b["at"].to_numpy(np.int64)
        ids, m, v = buf.push(at[is_left], b["row_no"].to_numpy()[is_left].astype(np.int64), at[~is_left], b["value"].to_numpy(np.float64)[~is_left], int(mark))
        if len(buf.lt) or len(buf.rt):
            state.update((buf.lt.tolist(), buf.lid.tolist(), buf.rt.tolist(), buf.rv.tolist()))
            horizon = int(buf.lt[0] if len(buf.lt) else buf.rt[0]) + tolerance + 1
            state.setTimeoutTimestamp(max(horizon, int(mark) + 1) * 1000)
        elif state.exists:
            state.remove()
        out = pd.DataFrame({"row_no": ids, "match_at": pd.array(m, dtype="Int64"), "match_value": v})
        out["match_at"] = out["match_at"].mask(out["match_at"] == -1)
        yield out

    rows = _tagged(left, right, tolerance, slab, streaming=True).withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", delay)
    return rows.groupBy("entity", "slab").applyInPandasWithState(step, PAIR, _STATE, "append", "EventTimeTimeout")


def seconds_of(day: Column) -> Column:
    """Seconds at 00:00:00 UTC of a date."""
    return F.unix_date(day).cast("long") * 86_400
