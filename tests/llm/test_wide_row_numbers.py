"""Numbers above 2**53 next to nulls."""

from threshfold.llm.nearest import nearest_join


def test_long_row_numbers(spark):
    left = spark.createDataFrame([("A", 100, 2**53 + 1), ("A", 101, 2**53 + 3)], "entity string, at long, row_no long")
    right = spark.createDataFrame([("A", 90, 1.0)], "entity string, at long, value double")
    assert sorted(r.row_no for r in nearest_join(left, right, 50).collect()) == [2**53 + 1, 2**53 + 3]
