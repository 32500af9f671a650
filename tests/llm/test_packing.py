import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threshfold.llm import packing as K


def best_possible(sizes, cap):
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0] and i < len(sizes) or len(bins) > best[0]:
            return
        if i == len(sizes):
            best[0] = min(best[0], len(bins))
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= cap and bins[k] not in bins[:k]:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=10))
def test_small_packings_are_the_best(sizes):
    a = np.array(sizes)
    bins = K.pack(a, 20)
    assert sorted(x for b in bins for x in b) == sorted(sizes) and all(sum(b) <= 20 for b in bins)
    assert len(bins) == best_possible(sizes, 20)
    assert len(bins) <= len(K.best_fit(a, 20))


def test_completion_beats_best_fit():
    # best-fit decreasing needs 4 bins of 100, completion 3
    sizes = np.array([60, 50, 40, 35, 30, 30, 20, 20, 15])
    assert len(K.pack(sizes, 100)) == K.lower_bound(sizes, 100) == 3


def test_completion_prunes_and_finds_exact_fillings():
    waste, fill = K.completion(K.Shelf(np.array([7, 5, 3, 3])), 11)
    assert waste == 0 and sum(s * k for s, k in fill) == 11
    assert K.completion(K.Shelf(np.array([50])), 11) == (11, [])
    assert K.completion(K.Shelf(np.array([], dtype=int)), 11) == (11, [])


def test_many_ones():
    assert len(K.pack(np.ones(5000, int), 2048)) == 3


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "word " * (i * 37 % 400), "en") for i in range(300)] + [(300, None, "x"), (301, "", "x"), (302, "long " * 9000, "x"), (5, "again", "x"), (None, "no id", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string")


def test_containers(spark, docs):
    rows = K.containers(docs, capacity=512, shard=100).collect()
    assert len({(r.doc_id, r.piece, r.n_tokens) for r in rows}) == len(rows)
    held = {}
    for r in rows:
        if r.container is not None:
            held.setdefault(r.container, []).append(r.n_tokens)
    assert all(sum(v) <= 512 for v in held.values())
    count = K.Tokens(K.read_vocabulary(K.VOCABULARY)).count
    for d in docs.collect():
        n = count(d.text or "")
        mine = sorted((r.piece, r.first_token, r.n_tokens) for r in rows if r.doc_id == d.doc_id)
        if d.doc_id != 5:
            assert sum(x[2] for x in mine) == n and [x[1] for x in mine] == [512 * k for k in range(max(1, -(-n // 512)))]
            assert len(mine) == 1 or n > 512
    assert {r.doc_id for r in rows if r.container is None} == {d.doc_id for d in docs.collect() if not d.text}
    rep = K.fill_report(K.containers(docs, capacity=512), 512).first()
    assert rep.n_containers - rep.least_containers <= 1 and rep.unused_share < 0.02


@pytest.mark.parametrize(("sizes", "cap", "n"), [([31, 31, 30, 27, 25, 20, 15, 15, 15, 11, 10, 7, 7], 50, 5), ([11, 11, 10, 9, 7, 7, 7, 6, 5, 4, 3], 20, 4)])
def test_goes_beyond_the_first_fillings(sizes, cap, n):
    assert len(K.pack(np.array(sizes), cap)) == n


def test_partitioning_does_not_matter(spark, docs):
    one, many = (sorted(tuple(r) for r in K.containers(docs.repartition(n), capacity=512, shard=100).collect() if r.container is not None and r.doc_id is not None) for n in (1, 7))
    assert one == many


def test_empty(spark, docs):
    assert K.containers(docs.limit(0)).count() == 0
    assert K.fill_report(K.containers(docs.limit(0))).first().n_containers == 0
