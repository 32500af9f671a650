"""Per-key results where a few keys hold most rows.

Each input split encodes its keys with a dictionary of its own and reduces its rows into dense
accumulator arrays (``bincount`` for counts and sums, a scattered minimum), whatever keys it
holds: the work of a task is the length of its split. A task sends one array per hash block of its
keys, and a distributed reduction adds up the arrays of a block, so a key with most of the rows
costs a reducer as many additions as any other key. There are as many blocks as the input's size
asks for (``BLOCK_BYTES`` of input a block), which bounds the keys of a reducer; where there are many
splits the arrays of a block are first added up in salted parts, so no reducer meets all splits.

Distinct companions (authors) are first reduced to distinct (field, key, author) triples, which combine
on the map side and spread over all three columns, and the triples then go through the same arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshfold.session import input_bytes

#: Bytes of input for which there is one block of keys.
BLOCK_BYTES = 64 << 20
#: Fewest blocks, and arrays of one block that one reducer adds up at most (about).
LEAST_BLOCKS, FAN_IN = 4, 256
#: Most tasks of a reduction; a task goes through its blocks one by one.
MOST_TASKS = 32_768
BLOCK = "field string, block long, salt int, keys array<string>, n array<bigint>, distinct_n array<bigint>, total array<bigint>, n_total array<bigint>, first array<bigint>"
_NAMES = ["field", "block", "salt", "keys", "n", "distinct_n", "total", "n_total", "first"]
_LONGS = pa.list_(pa.int64())
_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), *[_LONGS] * 5]
_NONE = np.iinfo(np.int64).max


class Dense:
    """Accumulators of one field: a dictionary of keys and arrays under its codes."""

    def __init__(self) -> None:
        self.code: dict[str | None, int] = {}
        self.n = np.zeros((4, 1024), dtype=np.int64)  # rows, distinct companions, sum, rows with a summand
        self.first = np.full(1024, _NONE, dtype=np.int64)

    def codes(self, values: pa.Array) -> np.ndarray:
        enc = values.dictionary_encode(null_encoding="encode")
        table = np.fromiter((self.code.setdefault(v, len(self.code)) for v in enc.dictionary.to_pylist()), dtype=np.int64, count=len(enc.dictionary))
        if (more := len(self.code)) > len(self.first):
            size = max(more, 2 * len(self.first))
            self.n = np.pad(self.n, ((0, 0), (0, size - self.n.shape[1])))
            self.first = np.pad(self.first, (0, size - len(self.first)), constant_values=_NONE)
        return table[enc.indices.to_numpy(zero_copy_only=False)]

    def add(self, code: np.ndarray, row: int, weight: np.ndarray | None = None) -> None:
        size = self.n.shape[1]
        if weight is None:
            self.n[row] += np.bincount(code, minlength=size)
        else:  # 32-bit halves: a double keeps each half's sum exact
            lo, hi = weight & 0xFFFFFFFF, weight >> 32
            self.n[row] += np.bincount(code, lo, size).astype(np.int64) + (np.bincount(code, hi, size).astype(np.int64) << 32)

    def least(self, code: np.ndarray, value: np.ndarray) -> None:
        np.minimum.at(self.first, code, value)


def _block(key: str | None, blocks: int) -> int:
    import hashlib

    return 0 if key is None else int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little") % blocks


def _rows(field: str, d: Dense, salt: int, blocks: int) -> Iterator[tuple]:
    keys = list(d.code)
    where: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        where.setdefault(_block(k, blocks), []).append(i)
    for b, at in where.items():
        yield (field, b, salt, [keys[i] for i in at], *d.n[:, at], d.first[at])


def _scatter(fields: list[str], pairs: bool, blocks: int, salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        acc = {f: Dense() for f in fields}
        for b in batches:
            t = pa.Table.from_batches([b])
            names = t.column("field").combine_chunks() if pairs else None
            for f in fields:
                sub = t.filter(pa.compute.equal(names, f)) if pairs else t
                if not sub.num_rows:
                    continue
                d = acc[f]
                code = d.codes(sub.column("key" if pairs else f).combine_chunks())
                if pairs:
                    d.add(code, 1)
                    continue
                d.add(code, 0)
                s = sub.column("summand").combine_chunks()
                ok = ~s.is_null().to_numpy(zero_copy_only=False)
                d.add(code[ok], 2, s.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
                d.add(code[ok], 3)
                s = sub.column("at").combine_chunks()
                ok = ~s.is_null().to_numpy(zero_copy_only=False)
                d.least(code[ok], s.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        salt = TaskContext.get().partitionId() % salts
        rows = [r for f in fields for r in _rows(f, acc[f], salt, blocks)]
        if rows:
            yield from _arrow(rows)

    return run


def _arrow(rows: list[tuple]) -> list[pa.RecordBatch]:
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES).to_batches(max_chunksize=256)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], Dense]]:
    """Arrays added up by field, block and salt, which come one after the other: a task holds the keys of one
    block at a time."""
    now, d = None, Dense()
    for b in batches:
        col = [b.column(c) for c in range(b.num_columns)]
        for i, at in enumerate(zip(*[c.to_pylist() for c in col[:3]], strict=True)):
            if at != now:
                if now is not None:
                    yield now, d
                now, d = at, Dense()
            code = d.codes(col[3][i].values)  # keys of one row differ
            for row in range(4):
                d.n[row][code] += col[4 + row][i].values.to_numpy()
            d.first[code] = np.minimum(d.first[code], col[8][i].values.to_numpy())
    if now is not None:
        yield now, d


def _add_parts(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (field, _, salt), d in _summed(batches):
            yield from _arrow(list(_rows(field, d, salt, blocks)))

    return run


def _add_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (field, _, _), d in _summed(batches):
        k = len(d.code)
        total = pa.array(d.n[2, :k], mask=d.n[3, :k] == 0)
        first = pa.array(d.first[:k], mask=d.first[:k] == _NONE)
        yield pa.RecordBatch.from_arrays([pa.array([field] * k, pa.string()), pa.array(list(d.code), pa.string()), pa.array(d.n[0, :k]), pa.array(d.n[1, :k]), first, total], ["field", "key_value", "n_rows", "n_distinct", "first_at", "total"])


def key_totals(
    df: DataFrame,
    fields: list[str],
    time_col: str | None = None,
    sum_col: str | None = None,
    distinct_col: str | None = None,
    ignore: tuple[str, ...] = (),
) -> DataFrame:
    """``field, key_value, n_rows, n_distinct, first_at, total`` per key of each field.

    Keys are taken as written; rows with a null key come out under a null ``key_value``, the
    empty string is a key. ``n_distinct`` counts values of ``distinct_col`` other than null and
    ``ignore`` (0 without one); ``first_at`` and ``total`` skip nulls and are null where nothing
    is left. An empty table gives no rows. Other columns of ``df`` don't matter.
    """
    null = F.lit(None).cast("long")
    work = df.select(
        *[F.col(f).cast("string").alias(f) for f in fields],
        (F.col(time_col).cast("long") if time_col else null).alias("at"),
        (F.col(sum_col).cast("long") if sum_col else null).alias("summand"),
    )
    size = input_bytes(df)
    n_blocks = max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))
    salts = -(-size // (FAN_IN * BLOCK_BYTES)) or 1
    blocks = work.mapInArrow(_scatter(list(fields), False, n_blocks, salts), BLOCK)
    if distinct_col:
        who = F.col(distinct_col)
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("key")) for f in fields])).alias("k")
        triples = df.where(who.isNotNull() & ~who.isin(*ignore)).select(each, who.alias("who")).select("k.field", "k.key", "who").distinct()
        blocks = blocks.unionByName(triples.select("field", "key").mapInArrow(_scatter(list(fields), True, n_blocks, salts), BLOCK))
    tasks = len(fields) * n_blocks  # said outright: arrays are few and long, so their number says little about their work
    group = ["field", "block", "salt"]
    if salts > 1:
        blocks = blocks.repartition(min(tasks * salts, MOST_TASKS), *group).sortWithinPartitions(*group).mapInArrow(_add_parts(n_blocks), BLOCK)
    out = "field string, key_value string, n_rows long, n_distinct long, first_at long, total long"
    return blocks.withColumn("salt", F.lit(0)).repartition(min(tasks, MOST_TASKS), "field", "block").sortWithinPartitions(*group).mapInArrow(_add_whole, out)


def heavy_keys(totals: DataFrame, share: float) -> DataFrame:
    """``field, key_value``: non-null keys that hold at least ``share`` of all rows.

    The totals of a field are one row per field (as many as were asked for), hence broadcast."""
    whole = totals.groupBy("field").agg(F.sum("n_rows").alias("__all"))
    return (
        totals.join(F.broadcast(whole), "field")
        .where(F.col("key_value").isNotNull() & (F.col("n_rows") >= F.lit(share) * F.col("__all")))
        .select("field", "key_value")
    )
