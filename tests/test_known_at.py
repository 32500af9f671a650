import datetime as dt
import random

from threshfold.operators.known_at import attach_known

D = dt.date
STATEMENTS = "listing_no long, entity_id string, ticker string, name string, exchange string, listed_from date, listed_to date, known_on date"
EVENTS = "row_no long, entity_id string, day date, ticker string, attr string"
ATTRS = ["ticker", "name", "exchange"]


def brute(statements, entity, day, k):
    ok = [s for s in statements if s[1] is not None and s[1] == entity and s[2 + k] is not None and (s[5] is None or s[5] <= day) and (s[6] is None or s[6] >= day) and (s[7] is None or s[7] <= day)]
    return max(ok, key=lambda s: (s[7] or D.min, s[0]))[2 + k] if ok else None


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    day = lambda: D(2020, 1, 1) + dt.timedelta(days=rnd.randrange(60))
    st = [(n, rnd.choice(["e1", "e2", None]), rnd.choice(["A", "B", "C"]), rnd.choice(["N", None]), rnd.choice(["X", "Y", None]), rnd.choice([None, day()]), rnd.choice([None, day()]), rnd.choice([None, day()])) for n in range(40)]
    ev = [(n, rnd.choice(["e1", "e2", "e3", None]), rnd.choice([None, *[day() for _ in range(6)]]), "t", "a") for n in range(300)]
    got = {r.row_no: (r.known_ticker, r.known_name, r.known_exchange) for r in attach_known(spark.createDataFrame(ev, EVENTS), spark.createDataFrame(st + st[:5], STATEMENTS), ATTRS, "entity_id", "day").collect()}
    assert got == {n: (None, None, None) if e is None or d is None else tuple(brute(st, e, d, k) for k in range(3)) for n, e, d, _, _ in ev}


def test_never_uses_what_became_known_later(spark):
    st = [(1, "e", "OLD", "n", "x", D(2020, 1, 1), None, D(2020, 1, 1)), (2, "e", "NEW", "n", "x", D(2020, 2, 1), None, D(2020, 3, 1))]
    ev = [(1, "e", D(2020, 2, 15), "", ""), (2, "e", D(2020, 3, 1), "", ""), (3, "e", D(2019, 12, 31), "", "")]
    out = attach_known(spark.createDataFrame(ev, EVENTS), spark.createDataFrame(st, STATEMENTS), ["ticker"], "entity_id", "day")
    assert {r.row_no: r.known_ticker for r in out.collect()} == {1: "OLD", 2: "NEW", 3: None}
    assert out.columns == ["row_no", "entity_id", "day", "ticker", "attr", "known_ticker"]


def test_a_gap_and_an_independent_attribute(spark):
    st = [(1, "e", "A", None, "X", D(2020, 1, 1), D(2020, 1, 10), D(2020, 1, 1)), (2, "e", None, "N", None, D(2020, 1, 5), None, D(2020, 1, 5))]
    ev = [(1, "e", D(2020, 1, 7), "", ""), (2, "e", D(2020, 1, 11), "", "")]
    out = attach_known(spark.createDataFrame(ev, EVENTS), spark.createDataFrame(st, STATEMENTS), ATTRS, "entity_id", "day")
    assert {r.row_no: (r.known_ticker, r.known_name, r.known_exchange) for r in out.collect()} == {1: ("A", "N", "X"), 2: (None, "N", None)}


def test_empty_tables(spark):
    e, s = spark.createDataFrame([], EVENTS), spark.createDataFrame([], STATEMENTS)
    assert attach_known(e, s, ATTRS, "entity_id", "day").count() == 0
    one = spark.createDataFrame([(1, "e", D(2020, 1, 1), "", "")], EVENTS)
    assert attach_known(one, s, ATTRS, "entity_id", "day").first().known_ticker is None
