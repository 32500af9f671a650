import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threshfold.llm import quality as Q

COMMON = "the of and to in a is that it for on with as at by this from or an be are was but not have which".split()
J = Q.Judge(COMMON)


def form(t):
    return J([t]).form[0]


P = "In practice the margin of this company is better than it was, and management knows that. "


LONG = "".join(P.replace("margin", f"margin in {i} of part {i * 7 % 100}") for i in range(700))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (P, "prose"),
        (P.upper(), "prose"),
        (P.lower().replace(".", "").replace(",", ""), "prose"),
        ("In practice the margin of this\ncompany is better than it was,\nand management knows that it\nwill not be so for long", "prose"),
        ("Leider scheint das Management viel zu optimistisch, obwohl die Schulden steigen.", "prose"),
        ("À mon avis la dette nette reste raisonnable malgré un risque évident.", "prose"),
        ("Según el informe la directiva no convence a nadie y voy a esperar.", "prose"),
        (LONG, "prose"),
        (P * 400, "junk"),  # one sentence again and again is repetition
        ("- ABC\n- cheap margin\n- XYZ\n- tired brand", "list"),
        ("1. ABC\n2. cheap margin\n3. XYZ", "list"),
        ("* [ABC](https://b.example/r/1)\n* [cheap brand](https://b.example/r/2)\n* [X](https://b.example/r/3)", "list"),
        ("$ABC, $DEF, $GHI.A, $JKL, $MNO, $PQR", "list"),
        ("abc ; def ; ghi.b ; jkl ; mno ; pqr", "list"),
        ("ABC\ncheap margin\nXYZ\ntired brand\nQRS", "list"),
        ("Ticker,Price,Chg\nABC,1.5,2%\nDEF,22.10,-3.1%\nGHI,3.00,0%", "table"),
        ("|Ticker|Price|\n|:--|:--|\n|ABC|1.5|\n|DEF|2.5|", "table"),
        ("Ticker   Price   Chg\nABC      1.50    2%\nDEF      2.50    3%", "table"),
        ("A\tB\tC\nx\t1\t2\ny\t3\t4", "table"),
        ("SELL SELL SELL SELL SELL SELL SELL SELL SELL SELL", "junk"),
        ("xdekjspodesq jcmokwqsfisi fkaapiiq lmajsai rwpijjqmewx jfclzllmklvcp", "junk"),
        ("NVcHVwYBtlAvEHXRLOVBsUu/Of0xYGmz1YiTZwW3e66kH1TD7/UGUXV0MXApYgBrsOXaTrxdorX6GG1", "junk"),
        ("4920626f75676874204441" * 8, "junk"),
        ("function f77(){var x=9272;if(x>93){return [41,58];}}\nfunction f08(){var x=1;}", "junk"),
        ('<div class="c1" data-x="6"><span style="w:29px"></span></div>\n<div class="c2"></div>', "junk"),
        ("Home | Next | Prev | [+] | Share | Log in | About | Report | Sign up", "junk"),
        ("~~~~~~~~~~~~\n~~~~~~~~~~~~", "junk"),
        ("🚀🚀🌕 🚀🚀!!! 💎🙌", "junk"),
        ("Ã© Ã¼ï¿½ â€™Ã©Ã¼ Ãâ€™ Ã©Â Ã¼", "junk"),
        (P * 3 + "\n- ABC\n- DEF", "prose"),
        (P + "\n" + "\n".join(f"- item {i}" for i in range(60)), "list"),
        ("", "prose"),
        ("   \n\n ", "prose"),
    ],
)
def test_forms(text, want):
    assert form(text) == want


def test_statistics_by_hand():
    r = J(["The cat sat.\nno end here\n\n- It is!"]).iloc[0]
    words = ["the", "cat", "sat", "no", "end", "here", "it", "is"]
    assert r.n_words == 8 and r.mean_word_length == pytest.approx(sum(map(len, words)) / 8)
    assert r.punct_line_share == pytest.approx(2 / 3) and r.common_share == pytest.approx(3 / 8) and r.bullet_share == pytest.approx(1 / 3)
    assert r.symbol_ratio == pytest.approx(3 / (sum(map(len, words)) + 3))
    assert "word_count" in r.reasons and r.form == "prose"
    assert J(["4920626f" * 30]).iloc[0].reasons[-1] == "form_junk"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=120), max_size=4))
def test_any_text(texts):
    out = J(texts)
    assert len(out) == len(texts) and out["form"].isin(Q.FORMS).all()
    for t, n in zip(texts, out["n_words"], strict=True):
        assert n >= 0 and (t.strip() or n == 0)


def test_table(spark):
    df = spark.createDataFrame([(1, P, 3), (2, None, 3), (3, "", 3), (None, LONG, 3), (1, P, 3)], "doc_id long, text string, n_words int")
    words = spark.createDataFrame([(w, i) for i, w in enumerate(COMMON)] + [(None, 99)], "word string, rank_no int")
    got = Q.quality(df, words).collect()
    assert sorted((r.doc_id or 0, r.form) for r in got) == [(0, "prose"), (1, "prose"), (1, "prose"), (3, "prose")]
    assert Q.quality(df.limit(0), words).count() == 0
    assert Q.quality(df, words.limit(0)).where("common_share > 0").count() == 0
