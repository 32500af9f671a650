import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threshfold.operators import extraction as X

LEX = X.Lexicon(
    symbols={"ALL": "e_all", "KEY": "e_key", "ON": "e_on", "MORN": "e_morn", "LSEGY": "e_lse", "QSHW": "e_q", "WGTJ": "e_w", "JOT": "e_j", "U": "e_u", "AS": "e_as", "CAN": "e_can", "PS": "e_ps", "EPS": "e_eps", "BRK-B": "e_brk", "RM": "e_rm"},
    names={"allstate": "e_all", "on semiconductor": "e_on", "morningstar": "e_morn", "london stock exchange": "e_lse", "honest": "e_hon", "growth": "e_gro", "grindrod": "e_gri", "ishares": "e_is", "berkshire hathaway": "e_brk"},
    ranks={w: i + 1 for i, w in enumerate("all key on as can honest growth the play position".split())},
)


def run(text):
    return [(m["ticker"], m["channel"], m["confidence"], tuple(m["evidence"])) for m in X.Extractor(LEX).mentions(text)]


def best(text):
    out = {}
    for m in X.Extractor(LEX).mentions(text):
        out[m["entity_id"]] = max(out.get(m["entity_id"], 0), m["confidence"])
    return out


@pytest.mark.parametrize(
    ("text", "entity", "confidence"),
    [
        ("ALL is a great insurer, Allstate has a moat", "e_all", 0.90),
        ("KEY: my thesis is that the market cap is too low", "e_key", 0.88),
        ("ON Semiconductor is cheap. ON trades at 12x earnings", "e_on", 0.90),
        ("I like $QSHW here", "e_q", 0.97),
        ("$BRK.B is fine", "e_brk", 0.97),
        ("QSHW went up", "e_q", 0.70),
        ("QSHW stock went up", "e_q", 0.85),
        ("listed on the London Stock Exchange with a stock", "e_lse", 0.50),
        ("According to Morningstar this stock is cheap", "e_morn", 0.55),
        ("Morningstar is blue", "e_morn", 0.50),
        ("Grinrod earnings were fine", "e_gri", 0.78),
        ("Honest stock is a buy, a position", "e_hon", 0.75),
    ],
)
def test_sentences(text, entity, confidence):
    assert best(text)[entity] == confidence


@pytest.mark.parametrize("text", ["I did some DD on the EPS and it grew. ROIC is 14%.", "all of it is key to be honest, so we play it safe", "My honest opinion is that growth stocks are expensive", "RM 829,919 was paid", "PS - I know that", "ishares is fine", "", None, "`QSHW` > code", "> QSHW stock\n"])
def test_nothing(text):
    assert run(text) == []


def test_lists():
    got = run("My list: QSHW, WGTJ, JOT")
    assert all("ticker_list" in e and c == 0.93 for _, _, c, e in got) and len(got) == 3
    assert "e_u" not in best("GO BUY AS MUCH SHARES AS U CAN")
    assert len(run("QSHW\nWGTJ\nJOT")) == 3


def test_overlaps_merge_without_growing():
    h = lambda a, z, c, e="x": {"entity_id": e, "ticker": "t", "channel": "c", "confidence": c, "start": a, "end": z, "evidence": [f"{a}"]}
    got = X.merge_spans([h(0, 5, 0.5), h(3, 9, 0.9), h(6, 8, 0.7), h(4, 6, 0.1, "y")])
    assert [(m["entity_id"], m["start"], m["end"], m["confidence"], m["evidence"]) for m in got] == [("x", 0, 5, 0.9, ["0", "3"]), ("y", 4, 6, 0.1, ["4"]), ("x", 6, 8, 0.7, ["6"])]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_one_edit(a, b):
    def dist(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    assert X.one_edit(a, b) == (dist(a, b) <= 1)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300))
def test_any_text(text):
    for m in X.Extractor(LEX).mentions(text):
        assert 0 <= m["start"] < m["end"] <= len(X.clean(text))


def test_documents(spark):
    docs = spark.createDataFrame(
        [("post", "a", 1, "u", None, 3, "About QSHW", "About QSHW\nQSHW and $WGTJ and QSHW"), ("comment", "b", None, None, "t3_a", None, None, "$QSHW" * 3 + " " * 70_000), ("comment", "c", 1, "u", "l", 1, None, None), ("comment", "d", 1, "u", "l", 1, None, "")],
        "doc_type string, doc_id string, created_utc long, author string, link_id string, score int, title string, text string",
    )
    got = X.extract_mentions(docs, LEX).collect()
    a = [m for m in got if m.doc_id == "a"]
    assert [m.in_title for m in a] == [True, False, False, False] and a[0].is_primary and not a[2].is_primary and a[0].n_entities_in_doc == 2
    assert [m.ticker for m in got if m.doc_id == "b"] == ["QSHW"] * 3
    assert X.extract_mentions(docs.limit(0), LEX).count() == 0


def test_joins(spark):
    docs = spark.createDataFrame([(1, "Foo Bar and foo bar baz"), (2, None), (3, "")], "id int, text string")
    names = spark.createDataFrame([("foo bar",), ("baz",), ("bar and foo",), ("a b c d e",)], "name string")
    assert sorted(tuple(r) for r in X.ngram_matches(docs, names, "id", "text").collect()) == [(1, "bar and foo", 1), (1, "baz", 1), (1, "foo bar", 2)]
    words = spark.createDataFrame([("grindrods",), ("grinrod",), ("grindrod",), ("other",), (None,)], "word string")
    assert sorted(tuple(r) for r in X.near_matches(words, spark.createDataFrame([("grindrod",)], "name string")).collect()) == [("grindrods", "grindrod"), ("grinrod", "grindrod")]
