import itertools
import random

import numpy as np

from threshfold.llm import leakage as K

ITEM = "Without depreciation the greenhouse at Saltersey could be upgraded before 1975. Nettlebay upgraded its pro-forma sawmill for 832 million after subsidy in 1962; each quarry outside Elverton carries 757 units of impaired stock against 281 of exposed debt."
OTHER = "Only 892 percent of Glenmarsh output left the tannery once currency set in. Thanks for reading this far, please correct me if I am wrong, and not financial advice."
W = ITEM.split()
FILL = "some words that have nothing to do with it at all were written here to fill the space".split()


def leak(spark, docs, items=((1, ITEM), (2, OTHER))):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumnsRenamed({})
    i = spark.createDataFrame(list(items), "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in K.leaks(d, i).collect())


def test_forms_of_a_leak(spark):
    p = W[3:31]
    change = list(p)
    change[5], change[14] = "xx", "yy"
    docs = [
        " ".join([*FILL, *p, *FILL]),  # whole
        " ".join(p).upper().replace(" ", " \n> ").replace(".", " !!"),  # case, breaks, punctuation
        " ".join([*FILL, *change, *FILL]),  # two words changed
        " ".join([*FILL, *p[:4], "really", *p[4:12], *p[13:], *FILL]),  # one added, one dropped
        " ".join([*FILL, *W[2:16], *FILL, *FILL, *W[18:32], *FILL]),  # two stretches
        " ".join([*FILL, *W[18:32], *FILL, *W[2:16]]),  # wrong order: each alone is too short
        " ".join([*FILL, *W[3:15], *FILL]),  # too short
        "**" + " ".join(f"<i>{w}</i>" if k % 9 == 0 else w for k, w in enumerate(p)) + "**",  # markup
        "Thanks for reading this far, please correct me if I am wrong. " + " ".join(FILL),  # stock phrases
        None,
        "",
        " ".join(FILL) * 3000 + " " + ITEM,  # very long
    ]
    assert leak(spark, docs) == [(d, 1) for d in (0, 1, 2, 3, 4, 7, 11)]


def test_against_brute_force(spark):
    """Runs of the item's words in random text: a leak exactly where the run has 20 words."""
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(60))) for k in range(20)]
    docs, want = [], []
    for d in range(120):
        k, n = rnd.randrange(20), rnd.choice([0, 12, 18, 20, 21, 35, 60])
        a = rnd.randrange(61 - n)
        docs.append(" ".join([*[rnd.choice(vocab) for _ in range(30)], *items[k][1].split()[a : a + n], *[rnd.choice(vocab) for _ in range(30)]]))
        if n >= 20:
            want.append((d, k))
    assert leak(spark, docs, items) == sorted(want)


def test_edges(spark):
    assert leak(spark, [ITEM, ITEM], [(1, ITEM), (2, ITEM), (3, None), (4, "short one"), (5, "")]) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    assert leak(spark, [], [(1, ITEM)]) == []
    assert leak(spark, [ITEM], []) == []


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = [ITEM + " x", OTHER], [(1, ITEM), (2, OTHER), (3, "other " + ITEM)]
    whole = leak(spark, docs, items)
    monkeypatch.setattr(K, "BLOCK_WORDS", 50)
    assert leak(spark, docs, items) == whole == [(0, 1), (0, 3), (1, 2)]


def test_prefix_leaves_out_the_most_frequent():
    b = K.Block.build([1], [ITEM])
    n = np.zeros(len(b.shingle), np.int64)
    n[[3, 8, 5]] = 10, 30, 20
    b.order_by_rarity(n)
    left_out = {int(s) for s in np.repeat(np.arange(len(b.shingle)), np.diff(b.first))[~b.prefix]}
    assert len(left_out) == K.MIN_SHARED - 1 and {3, 5, 8} <= left_out


def gapped(words):
    return {tuple(words[p + i] for i in q) for p in range(len(words) - 3) for q in K.KEPT.tolist() if p + q[3] < len(words)}


def edited(columns):
    """Item and document of a pattern: M kept, S changed, I added, D dropped."""
    item = [c for c, t in enumerate(columns) if t in "MSD"]
    return item, [c if t == "M" else -1 - c for c, t in enumerate(columns) if t in "MSI"]


def test_bounds_hold_for_every_way_of_editing():
    """The fewest shared shingles and covered words of a stretch of 10 with 2 edits (all of them), and
    of 20 with 5 (all places, edits of one kind): what the filters ask for at most."""
    def least(kept, edits, kinds):
        shared, cover = 10**9, 10**9
        for at in itertools.combinations(range(1, kept + edits - 1), edits):
            for kind in kinds:
                cols = ["M"] * (kept + edits)
                for p, t in zip(at, kind, strict=True):
                    cols[p] = t
                item, doc = edited(cols)
                common = gapped(item) & gapped(doc)
                shared, cover = min(shared, len(common)), min(cover, len({w for s in common for w in s}))
        return shared, cover

    s10, c10 = least(10, 2, list(itertools.product("SID", repeat=2)))
    s20, c20 = least(20, 5, ["SSSSS"])
    assert s10 >= K.MIN_CHAIN and min(2 * s10, s20) >= K.MIN_SHARED and min(2 * c10, c20) >= K.MIN_COVER


def test_dense_edits(spark):
    item = [f"w{i}" for i in range(40)]
    fifth = [("x" if k % 5 == 4 else w) for k, w in enumerate(item[:26])]  # 26 words, every fifth changed
    two = [*item[:5], "y", *item[6:11], *FILL, *FILL, *item[20:24], "z", *item[25:31]]  # twice 11 words, one changed in each
    near = [*item[:5], "y", *item[6:11], *FILL[:13], *item[20:24], "z", *item[25:31]]
    short = [*item[:5], "y", *item[6:11], *FILL, *FILL, *item[20:24], "z", *item[25:30]]  # 19 words
    thin = [("x" if k % 3 == 2 else w) for k, w in enumerate(item)]  # every third changed
    docs = [" ".join([*FILL, *x, *FILL]) for x in (fifth, two, near, short, thin)]
    assert leak(spark, docs, [(1, " ".join(item))]) == [(0, 1), (1, 1), (2, 1)]


def test_random_leaks(spark):
    """One stretch or two with words changed, added and dropped, up to one edit in four kept words."""
    rnd = random.Random(11)
    vocab = [f"v{i}" for i in range(2000)]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(70))) for k in range(30)]
    noise = lambda n: [rnd.choice(vocab) for _ in range(n)]

    def stretch(words, kept):
        edits = rnd.randint(0, kept // 4)
        cols = ["M"] * (kept + edits)
        for p in rnd.sample(range(1, kept + edits - 1), edits):
            cols[p] = rnd.choice("SID")
        out, at = [], 0
        for t in cols:
            out += [words[at]] if t == "M" else [] if t == "D" else [f"n{rnd.randrange(10**6)}"]
            at += t != "I"
        return out, at

    docs, want = [], []
    for d in range(400):
        k = rnd.randrange(30)
        words = items[k][1].split()
        if d % 2:
            kept = rnd.randint(20, 40)
            body, _ = stretch(words[rnd.randint(0, 5) :], kept)
        else:
            a, at = stretch(words, rnd.randint(10, 14))
            b, _ = stretch(words[at + rnd.randint(0, 8) :], rnd.randint(10, 14))
            body = [*a, *noise(rnd.choice([3, 12, 50])), *b]
        docs.append(" ".join([*noise(40), *body, *noise(40)]))
        want.append((d, k))
    got = leak(spark, docs, items)
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want), (len(got), set(want) - set(got))


def test_a_long_text_that_repeats_itself(spark):
    item = [f"w{i}" for i in range(30)]
    text = " ".join([*item[:12], *FILL] * 3000 + item[14:28])
    assert leak(spark, [text, " ".join(f"p{i}" for i in range(200_000))], [(1, " ".join(item))]) == [(0, 1)]
