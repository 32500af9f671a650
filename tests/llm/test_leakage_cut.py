import numpy as np
import pyarrow as pa
import pytest

from threshfold.llm import leakage as L


def scan(doc, item):
    block = L.Block.build([7], [item])
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([doc])], ["doc_id", "text"])
    found = [b.select(["doc_id", "pos", "shingle", "at", "word"]) for b in L.postings(block)(iter([batch])) if b.column("pos")[0].as_py() is not None]
    block.order_by_rarity(np.zeros(len(block.shingle), np.int64))
    return [(r["item_id"], r["n_words"]) for b in L._verified(block)(iter(found)) for r in b.to_pylist()]


@pytest.mark.parametrize(("a", "gap", "b", "n"), [(15, 8, 15, 30), (14, 9, 14, 28)])
def test_stretches_around_replaced_words(a, gap, b, n):
    item = [f"w{i}" for i in range(a + gap + b)]
    doc = ["x"] * 30 + item[:a] + [f"z{i}" for i in range(gap)] + item[a + gap :] + ["y"] * 30
    assert scan(" ".join(doc), " ".join(item)) == [(7, n)]


def test_words_of_a_long_leak_are_all_counted():
    item = [f"w{i}" for i in range(3000)]
    doc = [w for k, w in enumerate(item) if k % 50 != 49]  # every fiftieth word dropped
    assert scan(" ".join(["x"] * 40 + doc), " ".join(item)) == [(7, len(doc))]


def test_batches_are_read_in_slices(monkeypatch):
    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * n for n in (5, 30, 3, 3, 4, 11)])], ["doc_id", "text"])
    monkeypatch.setattr(L, "SLICE_BYTES", 10)
    assert [s.column("doc_id").to_pylist() for s in L._sliced(b)] == [[0], [1], [2, 3, 4], [5]]
    assert list(L._sliced(b.slice(0, 0))) == []


def test_a_stock_phrase_alone_covers_too_little():
    item = [f"w{i}" for i in range(40)]
    assert scan(" ".join([*["x"] * 30, *item[5:17], *["y"] * 30]), " ".join(item)) == []
    assert scan(" ".join([*["x"] * 30, *item[5:13], *["y"] * 30]), " ".join(item)) == []
