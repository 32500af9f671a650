import __spark_entry__ as entry


def test_tickers_written_differently_are_one_group(spark, tmp_path):
    rows = [("u", 1, "A", " $brk-b "), ("v", 1, "A", "BRK.B"), ("u", 1, "B", "BRK/B"), ("w", 1, "A", "GME"), ("[deleted]", 1, "A", "gme"), ("x", 1, None, None)]
    cols = "author string, created_utc long, entity_id string, ticker string"
    spark.createDataFrame(rows, cols).selectExpr("*", "'c' AS channel").write.parquet(f"{tmp_path}/mentions.parquet")
    got = {(r.counted, r.grp): r.n_distinct for r in entry.queries()["p4_ticker_counts"](spark, str(tmp_path)).collect()}
    assert got == {("author", "BRK.B"): 2, ("author", "GME"): 1, ("entity_id", "BRK.B"): 2, ("entity_id", "GME"): 1}
