import itertools

from pyspark.sql import functions as F
from test_patterns import SCHEMA, members, rows, truth

from threshfold.llm import patterns as P

GROUPS = {"channel": lambda x: x["channel"], "day": lambda x: x["day"]}


def cells(spark, data):
    return P.cells(spark.createDataFrame(data, SCHEMA), "author", {"channel": F.col("channel"), "day": F.col("day")}, ("[deleted]",))


def both(data):
    return [(r[0], f"{n}={r[k]}") for r in data for k, n in ((1, "channel"), (2, "day")) if r[k] is not None]


def test_stated_combinations_across_dimensions(spark):
    data = rows(3)
    t = P.pattern_totals(P.across(members(spark, data), "any", "channel", "day"))
    combos = [("a3", "any", ["channel=a", "day=3"]), ("ab0", "any", ["channel=a", "channel=b", "day=0"]), ("none", "any", ["day=9", "channel=z"])]
    got = {r.combo: (r.n_any, r.n_all, r.n_only) for r in P.combination_counts(t, spark.createDataFrame(combos, "combo string, dimension string, grps array<string>")).collect()}
    assert got == {c: truth(both(data), 1, g) for c, _, g in combos}


def test_all_pairs_and_cells(spark):
    data = [r for r in rows(4)[:150]] + [("solo", "a", "0", 1, "x"), ("nowhere", None, "0", 1, "x"), ("noday", "a", None, 1, "x"), ("", "c", "4", 1, "x")]
    got = {(r.one, r.other): (r.n_any, r.n_all, r.n_only) for r in P.pair_counts(cells(spark, data), GROUPS, [("channel", "day")]).collect()}
    assert got == {(c, str(k)): truth(both(data), 1, [f"channel={c}", f"day={k}"]) for c, k in itertools.product("abc", range(5))}
    crossed = {"channel_day": lambda x: F.concat(x["channel"], F.lit("|"), x["day"])}
    got = {r.grp: r.n_distinct for r in P.cell_counts(cells(spark, data), crossed).collect()}
    want = {}
    for who, c, k, *_ in data:
        if who not in (None, "[deleted]") and c is not None and k is not None:
            want.setdefault(f"{c}|{k}", set()).add(who)
    assert got == {g: len(w) for g, w in want.items()}


def test_no_rows(spark):
    none = cells(spark, [])
    assert P.cell_counts(none, GROUPS).count() == 0 and P.pair_counts(none, GROUPS, [("channel", "day")]).count() == 0


def sets(spark, data):
    return P.space(spark.createDataFrame(data, SCHEMA), {"author": ("[deleted]",)}, {"channel": F.col("channel"), "day": F.col("day")})


def test_one_space_answers_groups_and_mixed_combinations(spark):
    data = [*rows(6), ("nowhere", None, None, 1, "x")]
    t = P.space_totals(sets(spark, data), ["channel", "day"])
    groups = {"channel": F.col("channel"), "day": F.col("day")}
    got = {(r.dimension, r.grp): r.n_distinct for r in P.space_counts(t, groups).collect()}
    assert got == {("channel", c): truth(data, 1, [c])[0] for c in "abc"} | {("day", str(d)): truth(data, 2, [str(d)])[0] for d in range(5)}
    combos = [("a3", "any|author", ["channel=a", "day=3"]), ("ab0", "any|author", ["channel=a", "channel=b", "day=0"]), ("none", "any|author", ["day=9"])]
    got = {r.combo: (r.n_any, r.n_all, r.n_only) for r in P.combination_counts(P.space_patterns(t, "any", groups), spark.createDataFrame(combos, "combo string, dimension string, grps array<string>")).collect()}
    assert got == {c: truth(both(data), 1, g) for c, _, g in combos}


def test_partial_spaces_merge(spark):
    a, b = rows(7), rows(8)
    want = sorted(map(str, sets(spark, a + b).collect()))
    one, two = sets(spark, a), sets(spark, b)
    assert sorted(map(str, P.merge_spaces(["channel", "day"], two, one, one).collect())) == want
    assert P.space_totals(sets(spark, []), ["channel", "day"]).count() == 0
