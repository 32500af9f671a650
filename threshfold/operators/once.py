"""Exactly one copy of messages that were delivered at least once.

Identifiers that are written as base-36 numbers come from a producer's sequence: a *lane* is the
source, the identifier's width and the number's upper bits, and what was accepted of a lane is
held as disjoint ranges of numbers. A number outside all ranges is accepted once and its range
grows and merges; a number inside is a surplus copy. Identifiers that are no such number are
looked up by their exact key. Ranges and keys of earlier batches can be handed in
(:func:`accept_batch`): they then stand before everything the new batch offers.

Which copy stays is decided by the order of offers: the numbers of a lane are offered latest
``retrieved_on`` first (null counts as earliest), then by smallest row number, in whatever order
the numbers themselves are.

Skew: every Arrow batch first collapses its own copies, so a message with a third of all rows
leaves a map task as one row per batch; the rows found surplus there travel under a spread key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshfold.functions.symbols import message_key

#: Numbers of one lane: the bound of a lane's range state and of what one lane sends to a task.
LANE_BITS = 16
ROW = "src string, lane string, seq long, bad_key string, retrieved_on long, row_no long, surplus boolean, upto long"


class RangeSet:
    """Disjoint closed ranges of integers, kept sorted and merged where they touch."""

    def __init__(self, lo=(), hi=()) -> None:
        self.lo, self.hi = np.asarray(lo, dtype=np.int64), np.asarray(hi, dtype=np.int64)

    def covered(self, n: np.ndarray) -> np.ndarray:
        if not len(self.lo):
            return np.zeros(len(n), dtype=bool)
        at = np.searchsorted(self.lo, n, side="right") - 1
        return (at >= 0) & (n <= self.hi[np.maximum(at, 0)])

    def merge(self, lo: np.ndarray, hi: np.ndarray) -> None:
        lo, hi = np.concatenate([self.lo, lo]), np.concatenate([self.hi, hi])
        if not len(lo):
            return
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], np.maximum.accumulate(hi[order])
        starts = np.concatenate([[True], lo[1:] > hi[:-1] + 1])
        ends = np.concatenate([np.flatnonzero(starts)[1:] - 1, [len(lo) - 1]])
        self.lo, self.hi = lo[starts], hi[ends]

    def accept(self, n: np.ndarray) -> np.ndarray:
        """Offer numbers in any order; true where one is accepted. All of them are covered afterwards."""
        ok = np.zeros(len(n), dtype=bool)
        ok[np.unique(n, return_index=True)[1]] = True
        ok &= ~self.covered(n)
        self.merge(n[ok], n[ok])
        return ok


def _lanes(df: DataFrame, src: str, id_col: str, row_col: str, time_col: str, carry: dict[str, str] | None = None) -> DataFrame:
    key = message_key(id_col)
    good = key.rlike("^[0-9a-z]{1,12}$")
    seq = F.conv(key, 36, 10).cast("long")
    return df.select(
        F.lit(src).alias("src"),
        F.when(good, F.concat(F.length(key).cast("string"), F.lit(":"), F.shiftright(seq, LANE_BITS).cast("string"))).alias("lane"),
        F.when(good, seq).alias("seq"),
        F.when(~good, key).alias("bad_key"),
        F.col(time_col).cast("long").alias("retrieved_on"),
        F.col(row_col).cast("long").alias("row_no"),
        *[F.col(c).cast(t).alias(f"__{c}") for c, t in (carry or {}).items()],
    )


_ORDER = ["src", "lane", "seq", "bad_key", "late", "row_no"]


def _collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        known = b["lane"].notna() | b["bad_key"].notna()
        b["late"] = -b["retrieved_on"].astype("float64").fillna(-np.inf)
        b = b.sort_values(_ORDER, kind="stable", na_position="last")
        b["surplus"] = b.duplicated(["src", "lane", "seq", "bad_key"]) & known.reindex(b.index)
        b["upto"] = -1
        yield b.drop(columns="late")


def _accept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a task by lane and in the order of offers: a lane's ranges and the last exact key are its
    state. Rows with ``upto`` are ranges (or keys) of earlier batches; they come first and go nowhere."""
    lane, ranges, last = None, RangeSet(), None
    for b in batches:
        surplus = b["surplus"].to_numpy(dtype=bool).copy()
        src, lanes, keys = b["src"].to_numpy(object), b["lane"].to_numpy(object), b["bad_key"].to_numpy(object)
        seq, upto = b["seq"].to_numpy(np.int64), b["upto"].to_numpy(np.int64)
        todo = np.flatnonzero(~surplus)
        numbered = todo[pd.notna(lanes[todo])]
        if len(numbered):
            names = pd.Series(src[numbered]).str.cat(pd.Series(lanes[numbered]), sep="|").to_numpy(object)
            cuts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            for a, z in zip(cuts, [*cuts[1:], len(numbered)], strict=True):
                if names[a] != lane:
                    lane, ranges = names[a], RangeSet()
                part = numbered[a:z]
                old = part[upto[part] >= 0]
                ranges.merge(seq[old], upto[old])
                new = part[upto[part] < 0]
                surplus[new] = ~ranges.accept(seq[new])
        for i in todo[pd.isna(lanes[todo]) & pd.notna(keys[todo])]:
            surplus[i] = (src[i], keys[i]) == last
            last = (src[i], keys[i])
        b["surplus"] = surplus
        yield b[upto < 0]


def mark_surplus(sources: dict[str, DataFrame], id_col: str = "id", row_col: str = "ingest_no", time_col: str = "retrieved_on", seen: DataFrame | None = None, seen_keys: DataFrame | None = None, carry: dict[str, str] | None = None) -> DataFrame:
    """``src, row_no, surplus``: one row per delivered row, false for the copy that stays.

    A null identifier names no message: its row stays. Blank-only identifiers are one malformed
    key. Empty tables give no rows. Other columns of the sources are not looked at, except those of
    ``carry`` (column to type, for narrow columns), which come along. ``seen`` (``src, lane, lo, hi``) and
    ``seen_keys`` (``src, bad_key``) are what earlier batches delivered: every copy of it is surplus.
    """
    rows = None
    for src, df in sources.items():
        part = _lanes(df, src, id_col, row_col, time_col, carry)
        rows = part if rows is None else rows.unionByName(part)
    more = "".join(f", `__{c}` {t}" for c, t in (carry or {}).items())
    rows = rows.withColumn("seq", F.coalesce("seq", F.lit(-1).cast("long")))  # a null would make pandas round the others
    offered = rows.mapInPandas(_collapse, ROW.replace(", upto long", more + ", upto long"))
    none = lambda t: F.lit(None).cast(t)
    before = {"retrieved_on": none("long"), "row_no": F.lit(-1).cast("long"), "surplus": F.lit(False), **{f"__{c}": none(t) for c, t in (carry or {}).items()}}
    if seen is not None:
        offered = offered.unionByName(seen.select("src", "lane", F.col("lo").alias("seq"), none("string").alias("bad_key"), F.col("hi").alias("upto")).withColumns(before))
    if seen_keys is not None:
        offered = offered.unionByName(seen_keys.select("src", none("string").alias("lane"), F.lit(-1).cast("long").alias("seq"), "bad_key", F.lit(0).cast("long").alias("upto")).withColumns(before))
    spread = F.when(F.col("surplus") | (F.col("lane").isNull() & F.col("bad_key").isNull()), F.hash("row_no")).otherwise(F.hash("src", "lane", "bad_key"))
    offered = offered.repartition(spread).sortWithinPartitions(
        "src", F.asc_nulls_last("lane"), F.asc_nulls_last("bad_key"), F.desc(F.col("upto") >= 0), F.desc_nulls_last("retrieved_on"), "row_no"
    )
    return offered.mapInPandas(_accept, offered.schema).select("src", "row_no", "surplus", *[F.col(f"__{c}").alias(c) for c in (carry or {})])


def deliver_once(df: DataFrame, src: str = "rows", id_col: str = "id", row_col: str = "ingest_no", time_col: str = "retrieved_on", carry: dict[str, str] | None = None) -> DataFrame:
    """The rows of ``df`` that stay, all columns as they are; with ``carry`` only those narrow columns
    (column to type: string, double, int, boolean), which then need no join."""
    if carry:
        return mark_surplus({src: df}, id_col, row_col, time_col, carry=carry).where("not surplus").select(*carry)
    gone = mark_surplus({src: df}, id_col, row_col, time_col).where("surplus").select(F.col("row_no").alias("__gone"))
    return df.join(gone, F.col(row_col) == F.col("__gone"), "left_anti")


# --- batches over time -----------------------------------------------------------------------


def seen_ranges(df: DataFrame, src: str = "rows", id_col: str = "id") -> DataFrame:
    """``src, lane, lo, hi``: the disjoint ranges that the well-formed identifiers of ``df`` cover.

    Numbers are cut into runs with a window per lane (at most 2**LANE_BITS distinct numbers)."""
    from pyspark.sql import Window as W

    n = _lanes(df.select(F.col(id_col), F.lit(0).alias("__r"), F.lit(0).alias("__t")), src, id_col, "__r", "__t")
    n = n.where("lane is not null").select("src", "lane", "seq").distinct()
    run = F.col("seq") - F.row_number().over(W.partitionBy("src", "lane").orderBy("seq"))
    return n.withColumn("run", run).groupBy("src", "lane", "run").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).drop("run")


def merge_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two range tables as disjoint ranges; order and repetition don't matter."""
    from pyspark.sql import Window as W

    w = W.partitionBy("src", "lane").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    cut = a.unionByName(b).distinct().withColumn("cut", F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0))
    return (
        cut.withColumn("isle", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("src", "lane", "isle")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("isle")
    )


def seen_keys(df: DataFrame, src: str = "rows", id_col: str = "id") -> DataFrame:
    """``src, bad_key``: the malformed identifiers of ``df``."""
    n = _lanes(df.select(F.col(id_col), F.lit(0).alias("__r"), F.lit(0).alias("__t")), src, id_col, "__r", "__t")
    return n.where("bad_key is not null").select("src", "bad_key").distinct()


def accept_batch(batch: DataFrame, ranges: DataFrame, keys: DataFrame, src: str = "rows", id_col: str = "id", row_col: str = "ingest_no", time_col: str = "retrieved_on") -> DataFrame:
    """The rows of a later batch whose message no earlier batch delivered, one copy of each.

    ``ranges`` and ``keys`` are the state of the earlier batches (:func:`seen_ranges`,
    :func:`seen_keys`); the state afterwards is :func:`merge_ranges` of it and the batch's own.
    """
    gone = mark_surplus({src: batch}, id_col, row_col, time_col, ranges, keys).where("surplus").select(F.col("row_no").alias("__gone"))
    return batch.join(gone, F.col(row_col) == F.col("__gone"), "left_anti")
