import pytest
from pyspark.sql import functions as F

from threshfold.operators import extraction as X
from threshfold.operators import lift as L
from threshfold.operators import review as R
from threshfold.operators import universe as U
from threshfold.sources import adapters, classify, files, paged

ROW = "ticker string, grp string, dollar_volume double, winner_3x boolean, wipeout boolean, forward_return double, n_authors long, n_mentions long, total_score long, max_score long"


def names(spark, n=60):
    t = [(f"T{i:03d}", "treated", 10.0 ** (i % 5 + 3), i % 4 == 0, i % 7 == 0, i / 10, 100 - i, 50 + i % 9, i, None) for i in range(n)]
    c = [(f"C{i:03d}", "control", 10.0 ** (i % 5 + 3), i % 8 == 0, None, -i / 50, None, None, None, None) for i in range(80)]
    return spark.createDataFrame(t + c, ROW)


def test_rank_analysis(spark):
    got = {(r.signal, r.bucket): r for r in L.rank_analysis(names(spark)).collect()}
    assert {s for s, _ in got} == {"n_authors", "n_mentions", "total_score"}  # no name has a max_score
    top = got["n_authors", "top 10"]
    assert (top.n, top.winner_rate, top.median_return) == (10, 0.3, 0.45) and top.n_control_events == 10
    assert top.stable and top.winner_lift == pytest.approx(0.3 / (10 / 80)) and not top.off_support
    assert got["total_score", "top 10"].excess_vs_control == pytest.approx(5.45 + 0.79)
    assert got["n_authors", "rest"].n == 10
    thin = L.rank_analysis(names(spark), least_events=11).collect()
    assert all(r.winner_lift is None and not r.stable for r in thin)
    assert L.rank_analysis(names(spark, 39)).count() == 0  # fewer than 40 names
    assert L.rank_intervals(names(spark), n_boot=50).where("lo <= hi").count() == len(got)
    assert L.rank_intervals(names(spark), least_events=11, n_boot=50).count() == 0


def test_index_shares(spark):
    rows = spark.createDataFrame([("A", "treated", "2020-01-01"), ("B", "treated", "2020-01-01"), ("C", "treated", "2020-01-01"), ("D", "treated", "2020-01-01"), ("A", "control", "2020-01-01")], "ticker string, grp string, formation_date string").withColumn("formation_date", F.to_date("formation_date"))
    members = spark.createDataFrame([("A", "2019-05-01"), ("B", "2021-05-01"), ("C", None)], "ticker string, date_added string").withColumn("date_added", F.to_date("date_added"))
    assert tuple(L.index_shares(rows, members).first()) == (0.25, 0.75, 0.25)


def test_listed_stocks(spark):
    rows = [("AAA", "N", "Stock", "2001-01-01"), ("BBB", "N", "ETF", "2001-01-01"), ("CCC", None, "Stock", "2001-01-01"), ("DDD", "N", "Stock", None), ("AAA-WT", "N", "Stock", "2001-01-01"), (None, "N", "Stock", "2001-01-01")]
    df = spark.createDataFrame(rows, "ticker string, exchange string, asset_type string, listed_from string")
    assert [r.ticker for r in U.listed_stocks(df, ("N",), ("Stock",)).collect()] == ["AAA"]
    assert sorted(r.ticker for r in U.listed_stocks(df, ("N",)).collect()) == ["AAA", "BBB"]


def test_budget(spark):
    claims = spark.createDataFrame([("m1", "A", 1), ("m1", "B", 2), ("m1", "C", 3), ("m1", "A", 9), ("m2", None, 1), ("m2", "A", 2)], "p string, symbol string, at long")
    left = {r.period: (r.used, r.remaining) for r in R.budget_left(claims, 2, F.col("p"), "symbol", "at").collect()}
    assert left == {"m1": (2, 0), "m2": (1, 1)}
    batch = spark.createDataFrame([("m1", "A"), ("m1", "C"), ("m2", "A"), ("m2", "Z"), ("m3", "Q"), ("m3", None)], "period string, symbol string")
    assert {r.period: (r.new_symbols, r.fits) for r in R.would_cost(batch, claims, 2, F.col("p"), "symbol", "at").collect()} == {"m1": (1, False), "m2": (1, True), "m3": (1, True)}


def test_granted_calls_use_up_only_what_is_granted(spark):
    calls = spark.createDataFrame([("a", t) for t in (0, 1, 2, 3, 61, 62)] + [(None, 1), ("b", None), ("b", 5)], "who string, at long")
    got = sorted((r.key, r.at, r.granted) for r in R.granted_calls(calls, {60: 2}, "who", "at").collect())
    assert got == [("a", 0, True), ("a", 1, True), ("a", 2, False), ("a", 3, False), ("a", 61, True), ("a", 62, True), ("b", 5, True)]
    assert R.granted_calls(calls.limit(0), {60: 2}, "who", "at").count() == 0


def test_reports_and_rank_lists_are_refused_not_cut(spark, monkeypatch):
    monkeypatch.setattr(files, "MOST_ROWS", 3)
    df = spark.range(5)
    for f in (lambda: files.report(df, "t"), lambda: files.results_json(df, ["id"])):
        with pytest.raises(ValueError):
            f()
    monkeypatch.setattr(X, "MAX_DICTIONARY", 2)
    t = spark.createDataFrame([("A", "e", "Name", 1, 1)], "ticker string, entity_id string, name string, known_on int, listing_no int")
    with pytest.raises(ValueError):
        X.lexicon(t, spark.createDataFrame([(f"w{i}", i) for i in range(5)], "word string, rank_no int"))


def test_manual_names_may_be_short(spark):
    t = spark.createDataFrame([("NKE", "e1", "Nike Inc", 1, 1)], "ticker string, entity_id string, name string, known_on int, listing_no int")
    doc = "i think nike is undervalued at this price"
    assert X.Extractor(X.lexicon(t)).mentions(doc) == []
    assert [h["ticker"] for h in X.Extractor(X.lexicon(t, manual=frozenset({"nike"}))).mentions(doc)] == ["NKE"]


def test_gaps_are_logged(spark, tmp_path):
    class Broken:
        page = 10

        def fetch(self, a, z):
            if a < 5000:
                raise paged.SoftFailure
            return [{"id": "x", "created_utc": 6000}] if a <= 6000 < z else []

    gaps = []
    assert [r["id"] for r in paged.walk(Broken(), 0, 9000, window=900, gaps=gaps)] == ["x"] and gaps[0][0] == 0 and gaps[-1][1] >= 5000
    rec = spark.createDataFrame([(None, 0, '{"gap_from":0,"gap_to":900}'), ("x", 6000, "{}")], paged.SCHEMA)
    assert [tuple(r) for r in paged.gap_log(rec).collect()] == [(0, 900)]


def test_adapters_keep_close_and_volume(spark, tmp_path):
    (tmp_path / "bars.json").write_text('{"ticker":"A","t":1577923200000,"c":2.5,"v":10}\n')
    assert [tuple(r)[2:] for r in adapters.history(spark, "aggregates", {"path": f"{tmp_path}/bars.json"}).collect()] == [(2.5, 2.5, 10.0)]


def test_stance_limit(spark):
    m = spark.createDataFrame([("d1", "e", "T", 0, 2), ("d2", "e", "T", 0, 2), ("d0", "e", "T", 0, 2)], "doc_id string, entity_id string, ticker string, span_start int, span_end int")
    d = spark.createDataFrame([("d1", "cheap"), ("d2", "avoid"), ("d0", "")], "doc_id string, text string")
    assert [(r.doc_id, r.stance) for r in classify.classify(m, d, lexical=True, limit=1).collect()] == [("d1", "bullish")]


def test_hot_callers_are_cut_by_time(spark):
    import random

    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "hot", "b"]), rnd.randrange(4000)) for _ in range(900)] + [(None, 5), ("b", None)]
    got = R.admissible(spark.createDataFrame(rows, "who string, t long"), {60: 7, 300: 30}, "who", "t").collect()
    assert len(got) == len(rows)
    for r in got:
        if r.who is None or r.t is None:
            assert r.admissible is None
        else:
            held = lambda s: sum(1 for k, t in rows if k == r.who and t is not None and r.t - s < t <= r.t)
            assert r.admissible == (held(60) <= 7 and held(300) <= 30)


def test_factors_with_momentum(spark):
    base = spark.createDataFrame([("2020-01", "Mkt-RF", 0.1), ("2020-01", "RF", 0.0), ("2020-02", "Mkt-RF", 0.2), ("2020-02", "RF", 0.01)], "month string, factor string, value double")
    mom = spark.createDataFrame([("2020-02", "Mom", 0.5), ("2020-02", "RF", 9.0), ("2020-03", "Mom", 0.6)], "month string, factor string, value double")
    got = files.factor_table(base, mom)
    assert got.columns == ["month", "Mkt-RF", "RF", "Mom"]
    assert sorted(map(tuple, got.collect())) == [("2020-01", 0.1, 0.0, None), ("2020-02", 0.2, 0.01, 0.5)]
