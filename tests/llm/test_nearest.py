import random

import pytest

from threshfold.llm import nearest as N

TOL = 50
L, R = "entity string, at long, row_no long, slab long", "entity string, at long, value double, kind int"


def data(seed, n=400):
    rnd = random.Random(seed)
    left = [(rnd.choice(["hot", "hot", "hot", "a", None]), rnd.choice([None, *[rnd.randrange(2000) for _ in range(20)]]), i, 0) for i in range(n)]
    right = [(rnd.choice(["hot", "a", "b", None]), rnd.choice([None, *[rnd.randrange(2000) for _ in range(20)]]), rnd.choice([None, 1.0, 2.0, 3.0, 4.0]), 0) for _ in range(60)]
    return left, right + right[:10]


def brute(left, right):
    out = {}
    for e, t, n, _ in left:
        c = [(abs(t - rt), rt, -v) for re, rt, v, _ in right if e is not None and t is not None and re == e and rt is not None and v is not None and abs(t - rt) <= TOL]
        out[n] = (min(c)[1], -min(c)[2]) if c else (None, None)
    return out


@pytest.mark.parametrize(("slab", "parts"), [(50, 1), (137, 5), (100_000, 3)])
def test_replay(spark, slab, parts):
    left, right = data(slab)
    got = N.nearest_join(spark.createDataFrame(left, L).repartition(parts), spark.createDataFrame(right, R), TOL, slab).collect()
    assert {r.row_no: (r.match_at, r.match_value) for r in got} == brute(left, right) and len(got) == len(left)


def test_hot_slabs_are_salted(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARES", 1000)
    left, right = data(3)
    l, r = spark.createDataFrame(left, L), spark.createDataFrame(right, R)
    got = N.nearest_join(l, r, TOL, 500, hot=7).collect()
    assert {x.row_no: (x.match_at, x.match_value) for x in got} == brute(left, right) and len(got) == len(left)
    salts = N._salted(N._tagged(l, r, TOL, 500), l, 7).where("kind = 1").groupBy("entity", "slab", "salt").count()
    assert salts.agg({"count": "max"}).first()[0] <= 20 and salts.where("salt > 3").count() > 0


def test_empty_sides(spark):
    left, right = data(9)
    l, r = spark.createDataFrame(left, L), spark.createDataFrame(right, R)
    assert N.nearest_join(l.limit(0), r, TOL, 99).count() == 0
    got = N.nearest_join(l, r.limit(0), TOL, 99)
    assert got.count() == len(left) and got.where("match_at is not null").count() == 0
    with pytest.raises(ValueError):
        N.nearest_join(l, r, TOL, 10)


def test_buffer_waits_for_the_watermark_and_evicts():
    import numpy as np

    a = lambda *x: np.array(x, np.int64)
    b, none = N.NearestBuffer(10), np.zeros(0, np.int64)
    assert len(b.push(a(100), a(1), a(95), np.array([1.0]), 105)[0]) == 0
    assert len(b.push(none, none, a(103), np.array([2.0]), 110)[0]) == 0
    ids, at, value = b.push(none, none, none, np.zeros(0), 111)
    assert (ids.tolist(), at.tolist(), value.tolist()) == ([1], [103], [2.0])
    assert b.rt.tolist() == [103] and len(b.lt) == 0
    b.push(none, none, none, np.zeros(0), 114)
    assert len(b.rt) == 0


def test_stream_equals_replay(spark, tmp_path):
    left, right = data(4, 150)
    # one file per stretch of time on both sides, then a far record that moves the watermark
    def write(rows, schema, name):
        rows = [r for r in rows if r[0] is not None and r[1] is not None]
        for k in range(4):
            part = [r for r in rows if k * 500 <= r[1] < (k + 1) * 500]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        spark.createDataFrame([("far", 10_000_000, *rows[0][2:])], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        return spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")

    q = N.nearest_stream(write(left, L, "l"), write(right, R, "r"), TOL, "3000 seconds", 200)
    q.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {r.row_no: (r.match_at, r.match_value) for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    want = {n: v for n, v in brute(left, right).items() if left[n][0] is not None and left[n][1] is not None}
    assert {n: v for n, v in got.items() if n in want} == want
