import pytest

from threshfold.llm import quality as Q


def test_padded_line_ends_are_seen_and_long_lists_refused(spark):
    docs = spark.createDataFrame([(1, "It ended here." + " " * 20 + "\nand not here\nWell!" + ")" * 15)], "doc_id long, text string")
    words = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word string, rank_no int")
    assert Q.quality(docs, words).first().punct_line_share == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        Q.quality(docs, words, most=2)
