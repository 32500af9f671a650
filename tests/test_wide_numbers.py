"""Numbers above 2**53 next to nulls."""

from threshfold.operators.once import mark_surplus


def test_long_identifiers_next_to_malformed_ones(spark):
    rows = [(1, "zzzzzzzzzz1", 5), (2, "zzzzzzzzzz2", 5), (3, "zzzzzzzzzz3", 5), (4, "bad-key!", 5), (5, None, 5), (6, "zzzzzzzzzz2", 4), (7, "bad-key!", 4)]
    df = spark.createDataFrame(rows, "ingest_no long, id string, retrieved_on long").coalesce(1)
    assert {r.row_no for r in mark_surplus({"a": df}).where("surplus").collect()} == {6, 7}
