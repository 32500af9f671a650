import random
from collections import defaultdict

from threshfold.operators import hot_keys as H
from threshfold.operators.hot_keys import heavy_keys, key_totals

SCHEMA = "entity_id string, ticker string, author string, created_utc long, score int, key string, n long"


def test_totals_match_brute_force(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", "", "é", None, *map(str, range(300))]), rnd.choice(["T", None]), rnd.choice(["u1", "u2", "[deleted]", None]), rnd.choice([None, 5, 9, -3]), rnd.choice([None, -(2**31), 2**31 - 1, 4]), "k", 1) for _ in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {(r.field, r.key_value): (r.n_rows, r.n_distinct, r.first_at, r.total) for r in key_totals(df, ["entity_id", "ticker"], "created_utc", "score", "author", ("[deleted]",)).collect()}
    want = defaultdict(lambda: [0, set(), [], []])
    for e, t, a, c, s, _, _ in rows:
        for f, k in (("entity_id", e), ("ticker", t)):
            w = want[f, k]
            w[0] += 1
            if a and a != "[deleted]":
                w[1].add(a)
            w[2].append(c), w[3].append(s)
    least = lambda v: min((x for x in v if x is not None), default=None)
    total = lambda v: sum(x for x in v if x is not None) if any(x is not None for x in v) else None
    assert got == {k: (w[0], len(w[1]), least(w[2]), total(w[3])) for k, w in want.items()}
    heavy = {(r.field, r.key_value) for r in heavy_keys(key_totals(df, ["entity_id", "ticker"]), 0.05).collect()}
    assert heavy == {(f, k) for (f, k), w in want.items() if k is not None and w[0] >= 150}


def test_empty_table(spark):
    t = key_totals(spark.createDataFrame([], SCHEMA), ["ticker"], "created_utc", "score", "author")
    assert t.count() == 0 and heavy_keys(t, 0.05).count() == 0


def test_all_null_keys(spark):
    t = key_totals(spark.createDataFrame([(None, None, None, None, None, None, None)] * 3, SCHEMA), ["ticker"], "created_utc", "score", "author")
    assert [tuple(r) for r in t.collect()] == [("ticker", None, 3, 0, None, None)]


def test_salted_parts_and_few_tasks_give_the_same(spark, tmp_path, monkeypatch):
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot", "hot", *map(str, range(50))]), rnd.choice(["T", "U", None]), rnd.choice(["u1", "u2", "u3"]), rnd.randrange(99), rnd.randrange(9), "k", 1) for _ in range(2000)]
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    ask = lambda: sorted(map(str, key_totals(df, ["entity_id", "ticker"], "created_utc", "score", "author").collect()))
    want = ask()
    for name, value in (("BLOCK_BYTES", 2000), ("FAN_IN", 2), ("MOST_TASKS", 3)):
        monkeypatch.setattr(H, name, value)
        assert ask() == want
