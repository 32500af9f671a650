import random

import numpy as np
import pytest

from threshfold.operators import once as O

SCHEMA = "ingest_no long, id string, retrieved_on long, lane string, surplus string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute(rows):
    best = {}
    for n, i, t in rows:
        if i is None:
            continue
        k = "".join(i.split()).lower()
        k = k[3:] if k[:3] in ("t1_", "t3_") else k
        best.setdefault(k, []).append((-(t if t is not None else -(10**12)), n))
    return {n for v in best.values() for _, n in sorted(v)[1:]}


def test_surplus_matches_brute_force(spark):
    rnd = random.Random(1)
    ids = [*("%06x" % rnd.randrange(4000) for _ in range(40)), "000abc", "abc", "not an id!", "Not-an-ID!", "  ", "zzzzzzzzzzzzzzzzzz"]
    rows = [(n, rnd.choice([str, str.upper, lambda s: f" t3_{s}\n"])(rnd.choice(ids)), rnd.choice([None, 5, 7, 9])) for n in range(600)]
    rows += [(600 + n, "hot001", rnd.choice([None, 1, 2])) for n in range(400)] + [(2000, None, 1), (2001, None, 1)]
    got = {r.row_no for r in O.mark_surplus({"a": table(spark, rows).repartition(5)}).where("surplus").collect()}
    assert got == brute(rows)
    kept = O.deliver_once(table(spark, rows))
    assert kept.columns == ["ingest_no", "id", "retrieved_on", "lane", "surplus"]
    assert {r.ingest_no for r in kept.collect()} == {r[0] for r in rows} - brute(rows)


def test_same_identifier_in_two_sources_is_two_messages(spark):
    t = table(spark, [(1, "abc123", 5)])
    assert O.mark_surplus({"a": t, "b": t}).where("surplus").count() == 0


def test_empty_table(spark):
    assert O.mark_surplus({"a": table(spark, [])}).count() == 0


def test_range_set():
    r = O.RangeSet()
    assert r.accept(np.array([3, 3, 4, 9])).tolist() == [True, False, True, True]
    assert (r.lo.tolist(), r.hi.tolist()) == ([3, 9], [4, 9])
    assert r.accept(np.array([4, 5, 8])).tolist() == [False, True, True]
    assert (r.lo.tolist(), r.hi.tolist()) == ([3, 8], [5, 9])
    r.merge(np.array([6]), np.array([7]))
    assert (r.lo.tolist(), r.hi.tolist()) == ([3], [9])


def test_batches_with_ranges(spark):
    first = table(spark, [(1, "00000a", 1), (2, "00000b", 1), (3, "00000d", 1), (4, "odd-id", 1)])
    second = table(spark, [(5, "00000B", 9), (6, "00000c", 1), (7, "00000c", 2), (8, "ODD-ID ", 1), (9, "new odd!", 1), (10, None, 1)])
    ranges = O.seen_ranges(first)
    assert sorted((r.lo, r.hi) for r in ranges.collect()) == [(10, 11), (13, 13)]
    got = O.accept_batch(second, ranges, O.seen_keys(first))
    assert sorted(r.ingest_no for r in got.collect()) == [7, 9, 10]
    both = O.merge_ranges(ranges, O.seen_ranges(second))
    assert [(r.lo, r.hi) for r in both.collect()] == [(10, 13)]
    assert sorted(map(tuple, O.merge_ranges(both, ranges).collect())) == sorted(map(tuple, both.collect()))


@pytest.mark.parametrize("partitions", [1, 7])
def test_partitioning_does_not_matter(spark, partitions):
    rows = [(n, f"{n % 13:06d}", n % 5) for n in range(200)]
    got = {r.row_no for r in O.mark_surplus({"a": table(spark, rows).repartition(partitions)}).where("surplus").collect()}
    assert got == brute(rows)


def test_ranges_decide_in_the_order_of_offers():
    """Numbers of a lane come latest first, not sorted; ranges of earlier batches stand before them."""
    r = O.RangeSet([10], [12])
    assert r.accept(np.array([30, 11, 9, 30, 13, 29])).tolist() == [True, False, True, False, True, True]
    assert (r.lo.tolist(), r.hi.tolist()) == ([9, 29], [13, 30])


@pytest.mark.parametrize("partitions", [1, 6])
def test_many_batches_equal_one_look_at_all(spark, partitions):
    rnd = random.Random(8)
    rows = [(n, rnd.choice(["%06d" % rnd.randrange(300), "odd id-%d!" % rnd.randrange(20)]), rnd.choice([None, 1, 2, 3])) for n in range(900)]
    first: dict = {}
    ranges = keys = None
    for k in range(3):
        part = rows[k * 300 : k * 300 + 300]
        df = table(spark, part).repartition(partitions)
        got = {r.row_no for r in O.mark_surplus({"rows": df}, seen=ranges, seen_keys=keys).where("not surplus").collect()}
        fresh = [r for r in part if "".join(r[1].split()) not in first]
        assert got == {r[0] for r in fresh} - brute(fresh)
        first |= dict.fromkeys("".join(r[1].split()) for r in part)
        new, odd = O.seen_ranges(df), O.seen_keys(df)
        ranges, keys = (new, odd) if ranges is None else (O.merge_ranges(ranges, new), keys.unionByName(odd).distinct())


def test_carried_columns(spark):
    df = spark.createDataFrame([(1, "a1", 5, None, 2.5, True), (2, "A1", 4, 7, None, None), (3, None, None, 9, 1.5, False)], "ingest_no long, id string, retrieved_on long, score int, lag double, gone boolean")
    got = O.deliver_once(df, carry={"ingest_no": "string", "score": "int", "lag": "double", "gone": "boolean"})
    assert sorted(map(tuple, got.collect())) == [("1", None, 2.5, True), ("3", 9, 1.5, False)]
