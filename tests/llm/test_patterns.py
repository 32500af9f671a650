import random

from pyspark.sql import functions as F

from threshfold.llm import patterns as P

SCHEMA = "author string, channel string, day string, n long, grp string"


def rows(seed):
    rnd = random.Random(seed)
    return [(rnd.choice([None, "[deleted]", "", *map(str, range(60))]), rnd.choice(["a", "b", "c", None]), str(rnd.randrange(5)), 1, "x") for _ in range(500)]


def members(spark, data):
    return P.memberships(spark.createDataFrame(data, SCHEMA), "author", {"channel": F.col("channel"), "day": F.col("day")}, ("[deleted]",))


def truth(data, k, groups):
    sets = {}
    for r in data:
        if r[0] is not None and r[0] != "[deleted]" and r[k] is not None:
            sets.setdefault(r[0], set()).add(r[k])
    g = set(groups)
    return tuple(sum(1 for s in sets.values() if f(s)) for f in (lambda s: s & g, lambda s: g <= s, lambda s: s <= g))


def test_counts_and_combinations(spark):
    data = rows(1)
    t = P.pattern_totals(members(spark, data))
    got = {(r.dimension, r.grp): r.n_distinct for r in P.group_counts(t).collect()}
    assert got == {("channel", c): truth(data, 1, [c])[0] for c in "abc"} | {("day", str(d)): truth(data, 2, [str(d)])[0] for d in range(5)}
    combos = [("ab", "channel", ["a", "b"]), ("abc", "channel", ["a", "b", "c"]), ("aa", "channel", ["a", "a"]), ("d", "day", ["0", "3"]), ("none", "day", ["9"])]
    got = {r.combo: (r.n_any, r.n_all, r.n_only) for r in P.combination_counts(t, spark.createDataFrame(combos, "combo string, dimension string, grps array<string>")).collect()}
    assert got == {c: truth(data, 1 if d == "channel" else 2, g) for c, d, g in combos}


def test_partials_merge(spark):
    a, b = rows(1), rows(2)
    one, two = members(spark, a), members(spark, b)
    want = sorted(map(str, P.pattern_totals(members(spark, a + b)).collect()))
    assert sorted(map(str, P.pattern_totals(P.merge_memberships(two, one, one)).collect())) == want
    parts = [P.pattern_totals(P.merge_memberships(one, two).where(F.pmod(F.hash("identifier"), F.lit(3)) == k)) for k in range(3)]
    assert sorted(map(str, P.merge_totals(*parts).collect())) == want


def test_empty(spark):
    t = P.pattern_totals(members(spark, []))
    assert t.count() == 0 and P.group_counts(t).count() == 0
