"""Operators of the study on hand-made series and cohorts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from threshfold.functions import stats as S
from threshfold.functions import text as T
from threshfold.functions.symbols import message_key, symbol_key
from threshfold.operators import cohort as C
from threshfold.operators import lift as L
from threshfold.operators import outcomes as O
from threshfold.operators import panel as P
from threshfold.operators import review as R
from threshfold.operators import series as Z
from threshfold.operators import timejoin as J

D = dt.date


def weekdays(ticker, start, end, first, step, holes=()):
    out, p, d = [], first, start
    while d <= end:
        if d.weekday() < 5 and not any(a <= d <= b for a, b in holes):
            out.append((ticker, d, float(p), 1000.0))
        if d.weekday() < 5:
            p += step
        d += dt.timedelta(days=1)
    return out


@pytest.fixture(scope="module")
def prices(spark):
    a, z = D(2019, 1, 1), D(2026, 1, 1)
    rows = weekdays("UP", a, z, 100, 0.20) + weekdays("DOWN", a, D(2022, 3, 1), 100, -0.11) + weekdays("BOUGHT", a, D(2022, 3, 1), 100, 0.05) + weekdays("LATE", D(2022, 1, 3), z, 100, 0.1)
    rows += weekdays("SLOW", a, z, 100, 0.10) + weekdays("HOLE", a, z, 100, 0.1, [(D(2019, 7, 1), D(2019, 12, 31)), (D(2024, 5, 25), D(2024, 7, 10))])
    return spark.createDataFrame(rows, "ticker string, date date, price double, dollar_volume double").cache()


def cohort(spark, *rows):
    return spark.createDataFrame(rows, "ticker string, formation_date date")


def test_outcomes(spark, prices):
    c = cohort(spark, *[(t, D(2019, 6, 3)) for t in ("UP", "DOWN", "BOUGHT", "LATE", "SLOW", "HOLE", "NONE")], ("UP", D(2022, 6, 1)), (None, D(2019, 6, 3)), ("UP", None))
    got = {(r.ticker, r.formation_date.year, r.horizon_years): r for r in O.outcomes(c, prices, (3, 5), prices.where("ticker = 'SLOW'").select("date", "price")).collect()}
    up = got["UP", 2019, 5]
    assert up.forward_return > 2.0 and up.winner_3x and up.survived_full_horizon and up.exit_reason == "horizon" and up.outperformer
    down = got["DOWN", 2019, 5]
    assert down.wipeout and down.exit_date == D(2022, 3, 1) and not down.survived_full_horizon and down.exit_reason == "series_ended"
    bought = got["BOUGHT", 2019, 5]
    assert bought.forward_return > 0 and not bought.wipeout and bought.exit_date <= D(2022, 3, 1)
    assert not any(k[0] in ("LATE", "NONE", None) for k in got)
    assert got["SLOW", 2019, 5].forward_return > got["SLOW", 2019, 3].forward_return and not got["SLOW", 2019, 5].outperformer
    assert got["HOLE", 2019, 5].exit_reason == "hole"
    assert got["UP", 2022, 5].exit_reason == "censored"
    assert up.dollar_volume == 1000.0


def test_size_proxy_modes(spark):
    rows = [("A", D(2018, 1, 1) + dt.timedelta(days=i), 1.0, float(i)) for i in range(900)]
    px = spark.createDataFrame(rows, "ticker string, date date, price double, dollar_volume double")
    c = cohort(spark, ("A", D(2018, 1, 1) + dt.timedelta(days=400)))
    assert O.outcomes(c, px, (1,)).first().dollar_volume == 429.5
    assert O.outcomes(c, px, (1,), legacy_size_proxy=True).first().dollar_volume == 400.0


def test_asof(spark, prices):
    pts = cohort(spark, ("HOLE", D(2019, 8, 1)), ("HOLE", D(2019, 6, 29)), ("HOLE", D(2019, 6, 28)), (None, None))
    f = {r.formation_date: r.entry_date for r in J.asof_forward(pts, prices, "ticker", "formation_date", 15, ["price"]).collect()}
    assert f == {D(2019, 8, 1): None, D(2019, 6, 29): None, D(2019, 6, 28): D(2019, 6, 28), None: None}
    b = {r.formation_date: r.exit_date for r in J.asof_backward(pts, prices, "ticker", "formation_date", ["price"]).collect()}
    assert b == {D(2019, 8, 1): D(2019, 6, 28), D(2019, 6, 29): D(2019, 6, 28), D(2019, 6, 28): D(2019, 6, 28), None: None}


def test_years_and_verdicts(spark):
    one = spark.createDataFrame([(D(2020, 2, 29),)], "d date")
    assert one.select(S.add_years(F.col("d"), 5)).first()[0] == D(2025, 2, 28)
    v = spark.createDataFrame([(1.2, 2.0), (0.2, 0.9), (0.5, 1.5), (None, 1.0)], "lo double, hi double")
    assert [r[0] for r in v.select(S.lift_verdict(F.col("lo"), F.col("hi"))).collect()] == ["POSITIVE", "NEGATIVE", "NULL", "INCONCLUSIVE"]
    s = spark.createDataFrame([("2000",), ("9999",), ("x",), (None,), ("100",)], "c string")
    assert [r[0] for r in s.select(S.division(F.col("c"))).collect()] == ["manufacturing", "unknown", "unknown", "unknown", "agriculture"]


@pytest.mark.parametrize(("k", "n"), [(5, 50), (0, 30), (0, 0), (30, 30)])
def test_wilson(spark, k, n):
    lo, hi = spark.range(1).select(*S.wilson(F.lit(k), F.lit(n))).first()
    assert 0 <= lo <= hi <= 1
    if n == 0:
        assert (lo, hi) == (0, 0)
    elif k == 5:
        assert lo < 0.1 < hi
    if k == 0:
        assert lo == 0


ROWS = "ticker string, grp string, dollar_volume double, winner_3x boolean, outperformer boolean, wipeout boolean, forward_return double, n_authors long, benchmark_return double"


def names(spark, rows):
    return spark.createDataFrame([(f"n{i}", g, v, w, o, False, 0.1, 5, 0.05) for i, (g, v, w, o) in enumerate(rows)], ROWS)


def lifted(spark, rows):
    df = names(spark, rows)
    df = L.stratified(df, L.strata_edges(df))
    return df, {r.label: r for r in L.lift_table(df).collect()}


def test_identical_mix_leaves_the_rate(spark):
    mix = [("control", 10.0 ** (i % 5 + 3), i % 3 == 0, None) for i in range(100)] + [("treated", 10.0 ** (i % 5 + 3), i % 2 == 0, True) for i in range(50)]
    _, t = lifted(spark, mix)
    assert abs(t["winner_3x"].p_control_adj - t["winner_3x"].p_control) < 0.05 and t["winner_3x"].unsupported == 0
    assert "outperformer" not in t  # no control has that label


def test_reweighting_recovers_the_truth(spark):
    mix = [("control", 1e9, i < 40, True) for i in range(50)] + [("control", 1e3, i < 10, True) for i in range(50)] + [("treated", 1e9, i % 2 == 0, True) for i in range(50)]
    _, t = lifted(spark, mix)
    assert t["winner_3x"].p_control == 0.5 and t["winner_3x"].p_control_adj > 0.7


def test_unsupported_weight_is_reported(spark):
    mix = [("control", 1e3 + 100 * i, False, True) for i in range(100)] + [("treated", 1e12, True, True) for _ in range(100)]
    df, t = lifted(spark, mix)
    assert t["winner_3x"].unsupported > 0.9
    assert L.common_support(df).count() < 200


def test_strata(spark):
    v = spark.createDataFrame([(1.0,), (50.0,), (500.0,), (5000.0,), (None,), (-1.0,)], "v double")
    e = F.array(F.lit(10.0), F.lit(100.0), F.lit(1000.0))
    assert [r[0] for r in v.select(L.stratum(F.col("v"), e)).collect()] == [0, 1, 2, 3, 0, 0]
    few = names(spark, [("control", 1.0, True, True)] * 3)
    assert L.strata_edges(few).first().edges == []
    assert L.strata_edges(names(spark, [])).first().edges == []
    same = names(spark, [("control", 7.0, True, True)] * 30)
    assert L.strata_edges(same).first().edges == [7.0]


def test_bootstrap(spark):
    mix = [("control", float(i % 5 + 1), i % 4 == 0, True) for i in range(200)] + [("treated", float(i % 5 + 1), i % 4 == 0, True) for i in range(200)]
    df = names(spark, mix)
    df = L.stratified(df, L.strata_edges(df))
    b = {r.label: r for r in L.bootstrap(df, 400).collect()}
    assert b["winner_3x"].lo < 1 < b["winner_3x"].hi and b["winner_3x"].n_used == 400
    assert "wipeout" not in b  # a control rate of 0 in every replicate
    again = {r.label: r for r in L.bootstrap(df.repartition(7), 400).collect()}
    assert again == b


def test_first_formation_wins(spark):
    rows = spark.createDataFrame([("AAA", D(2020, 1, 1), D(2020, 1, 2), 1), ("AAA", D(2019, 1, 1), D(2019, 1, 2), 2), ("BBB", D(2021, 1, 1), D(2021, 1, 2), 3)], "ticker string, formation_date date, entry_date date, n int")
    assert sorted(r.n for r in O.first_per_name(rows).collect()) == [2, 3]


def test_symbols_and_keys(spark):
    df = spark.createDataFrame([(" $brk-b ",), ("BRK/B",), ("brk.B",), ("A-1",), ("$",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(symbol_key("s")).collect()] == ["BRK.B", "BRK.B", "BRK.B", "A-1", "", "", None]
    ids = spark.createDataFrame([(" T3_AbC\n",), ("t1_abc",), ("abc",), ("t2_abc",), (None,)], "s string")
    assert [r[0] for r in ids.select(message_key("s")).collect()] == ["abc", "abc", "abc", "t2_abc", None]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.clean_text(F.lit("a `x` [shown](http://y) http://z b\n> quoted\nlast"))).split() == ["a", "shown", "b", "last"]
    assert one(T.clean_text(F.lit(None).cast("string"))) == ""
    assert one(T.cashtags(F.lit("$ABC and $BRK.B, not $1 or $abc"))) == ["ABC", "BRK-B"]
    assert one(T.normalise_name(F.lit("The Foo-Bar Holdings, Inc."))) == "foo bar"
    assert one(T.mark_span(F.lit("xx🤡ABCyy"), F.lit(3), F.lit(6), 1)) == "…🤡«ABC»y…"
    assert one(T.strip_tags(F.lit("<b>A &amp; B</b>\n c"))) == "A & B c"
    html = '<table class="x wikitable"><tr><th>S</th></tr><tr><td><a>MMM</a></td><td>3M</td></tr></table>'
    assert one(T.table_rows(F.lit(html))) == [["S"], ["MMM", "3M"]]
    assert one(T.lexical_stance(F.lit("undervalued and cheap, sold none"))).stance == "bullish"
    assert one(T.lexical_stance(F.lit("thoughts on this?"))).stance == "question"
    assert one(T.lexical_stance(F.lit(None).cast("string"))).stance == "neutral"


MENTIONS = "mention_no long, doc_id string, doc_type string, created_utc long, author string, entity_id string, ticker string, channel string, confidence double, span_start int, in_title boolean, is_primary boolean"


def test_panel(spark):
    t0 = 1_577_880_000  # 2020-01-01
    m = spark.createDataFrame(
        [
            (1, "d1", "post", t0, "u", "e", "B", "cashtag", 0.97, 5, True, True), (2, "d1", "post", t0, "u", "e", "A", "bare", 0.75, 9, None, False),
            (3, "d2", "comment", t0 + 40 * 86400, "[deleted]", "e", "A", "name", 0.9, 1, False, True), (4, "d2", "comment", t0, None, "e", "A", "name", 0.74, 1, False, True),
            (5, "d9", "post", t0, "u", None, None, "name", 0.9, 1, False, True),
        ], MENTIONS)
    docs = spark.createDataFrame([("post", "d1", 7, 3, 1.0, True), ("comment", "d2", None, None, 2.0, False)], "doc_type string, doc_id string, doc_score int, num_comments int, lag_days double, removed boolean")
    got = {r.year_month: r for r in P.mention_panel(m, docs).collect()}
    jan, feb = got["2020-01"], got["2020-02"]
    assert (jan.n_mentions, jan.n_distinct_authors, jan.n_toplevel_posts, jan.total_score, jan.max_score, jan.total_thread_comments, jan.n_removed) == (2, 1, 2, 14, 7, 3, 2)
    assert (jan.ticker_at_date, jan.first_mention_ever, jan.n_in_title, jan.n_primary, jan.n_bullish) == ("A", True, 1, 1, None)
    assert (feb.n_mentions, feb.n_distinct_authors, feb.total_score, feb.months_since_first_mention, feb.first_mention_ever) == (1, 0, None, 1, False)
    stance = spark.createDataFrame([("d1", "e", "bullish")], "doc_id string, entity_id string, stance string")
    assert {r.year_month: r.n_bullish for r in P.mention_panel(m, docs, stance=stance).collect()} == {"2020-01": 2, "2020-02": 0}
    assert P.mention_panel(m.limit(0), docs).count() == 0


def test_membership_is_three_valued(spark):
    pts = spark.createDataFrame([("A", D(2020, 1, 1)), ("B", D(2020, 1, 1)), ("C", D(2020, 1, 1)), ("A", D(2018, 1, 1)), (None, None)], "k string, day date")
    li = spark.createDataFrame([("A", D(2019, 1, 1), None), ("B", D(2021, 1, 1), None), ("A", D(2019, 1, 1), None)], "k string, listed_from date, listed_to date")
    assert [(r.k, r.day and r.day.year, r.was_listed) for r in J.listed_at(pts, li, "k", "day").orderBy("k", "day").collect()] == [(None, None, None), ("A", 2018, False), ("A", 2020, True), ("B", 2020, False), ("C", 2020, None)]
    me = spark.createDataFrame([("A", D(2019, 1, 1)), ("B", None)], "k string, date_added date")
    assert {r.k: r.in_index for r in J.member_since(pts.where("day = '2020-01-01'"), me, "k", "day").collect()} == {"A": True, "B": None, "C": False}


def test_cohort_and_plan(spark):
    t = spark.createDataFrame([("A", D(2020, 1, 1), 9), ("B", D(2020, 2, 1), 9), ("C", D(2020, 3, 1), 1), ("D", D(2020, 4, 1), 1)], "ticker string, first_mention date, n_mentions int")
    u = spark.createDataFrame([("A",), ("X",), ("Y",), (None,), ("X",)], "ticker string")
    pool = C.control_pool(u, t)
    assert sorted(r.ticker for r in pool.collect()) == ["X", "Y"]
    assert sorted(r.formation_date for r in C.matched_dates(t, pool, 1).collect()) == [D(2020, 1, 1), D(2020, 3, 1)]
    plan = [r.ticker for r in C.fetch_plan(u.where("ticker = 'A'"), t, pool).orderBy("place").collect()]
    assert plan == ["A", "B", "X", "C", "D", "Y"]
    left = C.fetch_plan(u.where("ticker = 'A'"), t, pool, done=u.where("ticker = 'X'").distinct())
    assert [r.ticker for r in left.orderBy("place").collect()] == ["A", "B", "C", "D", "Y"]
    assert [r.ticker for r in C.top_names(t, 2).collect()] == ["A", "B"]
    assert [r.ticker for r in C.draw(t, 3, 5, "ticker").collect()] == [r.ticker for r in C.draw(t.repartition(3), 3, 5, "ticker").collect()]


def test_timing_and_returns(spark):
    rows = [("A", D(2020, 1, 1) + dt.timedelta(days=i), p, 1.0) for i, p in enumerate([10.0] * 30 + [5.0] + [6.0] * 30 + [20.0, 20.0] + [15.0] * 10)]
    px = spark.createDataFrame(rows, "ticker string, date date, price double, dollar_volume double")
    r = spark.createDataFrame([("A", D(2020, 2, 10), D(2020, 12, 31))], "ticker string, entry_date date, exit_date date")
    got = Z.move_timing(r, px).first()
    assert (got.trough_date, got.peak_date, got.gain, got.lag_days) == (D(2020, 1, 31), D(2020, 3, 2), 3.0, 10)
    gap = spark.createDataFrame([("A", D(2020, 1, 31), 1.0, 1.0), ("A", D(2020, 4, 30), 2.0, 1.0)], px.schema)
    assert [tuple(x) for x in Z.month_end_returns(gap).collect()] == [("A", "2020-04", 1.0)]


def test_ols(spark):
    df = spark.createDataFrame([(float(i), float(i * i), 3.0 + 2 * i - 0.5 * i * i) for i in range(20)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    assert {r.term: round(r.beta, 6) for r in Z.ols(df, "y", ["a", "b"]).collect()} == {"intercept": 3.0, "a": 2.0, "b": -0.5}
    assert Z.ols(df.withColumn("b", F.col("a") * 2), "y", ["a", "b"]).count() == 0  # singular
    assert Z.ols(df.limit(0), "y", ["a"]).count() == 0


def test_review(spark):
    gold = spark.createDataFrame([("1", "A"), ("1", "B"), ("2", None)], "doc string, t string")
    pred = spark.createDataFrame([("1", "A"), ("1", "C"), ("2", "Z"), ("3", "Q"), ("1", "A")], "doc string, t string")
    p = R.precision_recall(R.compare(gold, pred, ["doc", "t"])).first()
    assert (p.tp, p.fp, p.fn) == (1, 2, 1) and abs(p.precision - 1 / 3) < 1e-9 and p.recall == 0.5
    assert R.precision_recall(R.compare(gold.limit(0), pred, ["doc", "t"])).first().f1 == 0
    rows = spark.createDataFrame([(i, 2010 if i % 10 else 2020) for i in range(1000)], "k int, y int")
    s = R.stratified_sample(rows, "y", "k", 50)
    assert {(r.y, r["count"]) for r in s.groupBy("y").count().collect()} == {(2010, 43), (2020, 7)} or s.count() == 50
    assert sorted(r.k for r in s.collect()) == sorted(r.k for r in R.stratified_sample(rows.repartition(9), "y", "k", 50).collect())
    calls = spark.createDataFrame([("a", t) for t in (0, 1, 2, 3599, 3600)], "name string, at long")
    assert [r.admissible for r in R.admissible(calls, {3600: 3}, "name", "at").orderBy("at").collect()] == [True, True, True, False, False]
    claims = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3), ("z", 4), (None, 0)], "s string, at long")
    assert {r.symbol: r.granted for r in R.symbol_budget(claims, 2, F.lit("p"), "s", "at").collect()} == {"x": True, "y": True, "z": False}


def test_gate(spark, prices):
    probes = spark.createDataFrame([("DOWN", D(2022, 3, 10)), ("UP", None)], "ticker string, expected_end date")
    ok = R.source_gate(prices, probes, "SLOW")
    assert ok.first().usable
    R.require(ok)
    late = spark.createDataFrame([("DOWN", D(2023, 3, 10)), ("GONE", None)], "ticker string, expected_end date")
    with pytest.raises(R.GateError):
        R.require(R.source_gate(prices, late, "SLOW"))


def test_ordinal_ranks(spark):
    df = spark.createDataFrame([(i * 7919 % 100 // 10, i) for i in range(500)], "x long, k long").repartition(6)
    got = Z.ordinal_ranks(df, "r", "x", "k").collect()
    assert [(r.x, r.k) for r in sorted(got, key=lambda r: r.r)] == sorted((r.x, r.k) for r in got) and sorted(r.r for r in got) == list(range(1, 501))
    assert Z.spearman_ordinal(df, "x", "x", "k").first().rho == pytest.approx(1.0)
    assert tuple(Z.spearman_ordinal(df.limit(0), "x", "x", "k").first()) == (None, 0)
