import json
import zipfile

import pytest
from pyspark.sql import functions as F

from threshfold.operators.review import GateError
from threshfold.sources import adapters, classify, files, paged
from threshfold.streaming import live


def test_ndjson_and_csv(spark, tmp_path):
    p = tmp_path / "m.ndjson"
    p.write_text('{"doc_id": "a", "confidence": 0.75, "entity_id": 123, "evidence": ["x"]}\n{"doc_id": "b", "confidence": 0.7, "entity_id": "T:x"}\n')
    got = files.read_ndjson(spark, [str(p), str(tmp_path / "none.ndjson")], files.MENTIONS, 0.75).collect()
    assert [(r.doc_id, r.entity_id, r.evidence) for r in got] == [("a", "123", ["x"])]
    assert files.read_ndjson(spark, str(tmp_path / "none"), files.MENTIONS).count() == 0
    bad = tmp_path / "p.ndjson"
    bad.write_text('{"id": "a"}\nnot json\n')
    assert files.read_ndjson(spark, str(bad), files.POSTS).cache().where("_corrupt_record is not null").count() == 1
    df = spark.createDataFrame([("b", 2, None), ("a", 1, 'x,"y"')], "k string, n int, t string")
    files.write_csv(df, str(tmp_path / "c"), ["n", "k", "t"], order=["n"])
    back = files.read_csv(spark, str(tmp_path / "c"), "k string, n int, missing string")
    assert [tuple(r) for r in back.orderBy("n").collect()] == [("a", 1, None), ("b", 2, None)]
    files.write_ndjson(df, str(tmp_path / "j"))
    assert spark.read.schema("k string, n int, t string").json(str(tmp_path / "j")).count() == 2


def test_label_sheet(spark, tmp_path):
    (tmp_path / "g.tsv").write_bytes(b"doc_id\tyear\tgold_tickers\tnotes\r\na\t2020\taapl, msft\t\r\nb\t2020\t\t\r\nc\t2021\t\tnone\r\n")
    got = {r.doc_id: r.gold_tickers for r in files.read_gold(spark, str(tmp_path / "g.tsv")).collect()}
    assert got == {"a": ["AAPL", "MSFT"], "c": []}
    df = spark.createDataFrame([("a", 2020, "x\ty\nz" + "w" * 5000)], "doc_id string, year int, text string")
    files.write_label_sheet(df, str(tmp_path / "s"))
    line = next((tmp_path / "s").glob("*.csv")).read_text().splitlines()[1]
    assert line.startswith("a\t2020\t") and "x y ⏎ z" in line and line.endswith("…[truncated]")


def test_prices_zip_factors_registry_html(spark, tmp_path):
    (tmp_path / "px").mkdir()
    (tmp_path / "px" / "AB.json").write_text(json.dumps([{"date": "2020-01-02", "adj_close": 2.0, "close": 3.0, "volume": None}, {"date": "2020-01-03", "adj_close": None}]))
    assert [tuple(r)[0::2] for r in files.read_price_folder(spark, str(tmp_path / "px")).collect()] == [("AB", 2.0)]
    text = "This file\n\n,Mkt-RF,SMB\n202001, 1.00, -2.5\n202002,0.5,0\n\n Annual\n2020,9,9\n"
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("F.CSV", text)
    got = {(r.month, r.factor): r.value for r in files.parse_factors(files.read_zipped(spark, str(tmp_path / "f.zip"))).collect()}
    assert got == {("2020-01", "Mkt-RF"): 0.01, ("2020-01", "SMB"): -0.025, ("2020-02", "Mkt-RF"): 0.005, ("2020-02", "SMB"): 0.0}
    (tmp_path / "r.json").write_text('{"fields": ["cik", "name"], "data": [[1, "A"], [2, null]]}')
    assert [tuple(r) for r in files.registry_rows(spark, str(tmp_path / "r.json")).collect()] == [("1", "A"), ("2", None)]
    (tmp_path / "t.html").write_text('<table class="wikitable">\n<tr><td>BRK.B</td></tr></table>')
    assert files.html_table(spark, str(tmp_path / "t.html")).first().cells == ["BRK.B"]
    res = spark.createDataFrame([("A2", "x", 1.5), ("A2", "y", float("nan"))], "a string, b string, v double")
    assert json.loads(files.results_json(res, ["a", "b"])) == {"A2": {"x": {"v": 1.5}, "y": {"v": None}}}
    assert "| A2 | x | 1.5 |" in files.report(res, "T")
    files.write_json_document(res, str(tmp_path / "doc"))
    assert spark.read.text(str(tmp_path / "doc")).count() == 2


class Flaky(paged.FileService):
    def fetch(self, start, end):
        if end - start > 5000 or start <= 7000 < end:
            raise paged.SoftFailure
        return super().fetch(start, end)


def test_paging(tmp_path):
    p = tmp_path / "s.ndjson"
    p.write_text("".join(json.dumps({"id": f"r{i}", "created_utc": i * 10}) + "\n" for i in range(1000)) + json.dumps({"id": "twin", "created_utc": 990}) + "\n")
    got = [r["id"] for r in paged.walk(paged.FileService(str(p), 100), 0, 10_000)]
    assert len(got) == len(set(got)) == 1001
    gaps = []
    got = [r["id"] for r in paged.walk(Flaky(str(p), 100), 0, 10_000, gaps=gaps)]
    assert gaps and all(z - a <= paged.FLOOR for a, z in gaps) and len(got) == len(set(got)) and len(got) > 850
    waits = []
    answers = iter([paged.StatusError(429), TimeoutError(), 5])

    def call():
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    assert paged.with_backoff(call, sleep=waits.append) == 5 and waits == [6.4, 3.2]
    with pytest.raises(paged.HardFailure):
        paged.with_backoff(lambda: (_ for _ in ()).throw(paged.StatusError(400)))


def test_paged_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.ndjson").write_text("".join(json.dumps({"id": f"r{i % 450}", "created_utc": 60 + (i % 450) * 60}) + "\n" for i in range(500)))
    paged.register(spark)
    o = {"path": f"{tmp_path}/in/*.ndjson", "start": "0", "end": "30000", "partitions": "3", "step": "10000"}
    assert spark.read.format("paged").options(**o).load().select("id").distinct().count() == 450
    s = live.stream_once(spark.readStream.format("paged").options(**o).load(), delay="1 day")
    q = s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="0 seconds").start()
    for _ in range(60):
        q.processAllAvailable()
        if q.lastProgress and q.lastProgress["sources"][0]["endOffset"] and '30000' in str(q.lastProgress["sources"][0]["endOffset"]):
            break
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").select("id").count() == 450


def test_adapters(spark, tmp_path):
    with pytest.raises(GateError):
        adapters.history(spark, "nobody", {})
    (tmp_path / "a.json").write_text('{"ticker": "A", "t": 1577923200000, "c": 2.5, "v": 1}\n{"ticker": null, "t": 1, "c": 1}\n')
    got = adapters.history(spark, "aggregates", {"path": str(tmp_path / "a.json")}).collect()
    assert [(r.ticker, str(r.date), r.adj_close) for r in got] == [("A", "2020-01-02", 2.5)]
    probes = spark.createDataFrame([("A", None)], "ticker string, expected_end date")
    with pytest.raises(GateError):
        adapters.history(spark, "aggregates", {"path": str(tmp_path / "a.json")}, probes, "A")


def test_classifier(spark):
    m = spark.createDataFrame([("d", "e", "T", 0, 3)], "doc_id string, entity_id string, ticker string, span_start int, span_end int")
    docs = spark.createDataFrame([("d", "ABC is cheap")], "doc_id string, text string")
    with pytest.raises(ValueError):
        classify.classify(m, docs)
    assert classify.classify(m, docs, lexical=True).first().stance == "bullish"
    got = classify.classify(m, docs, lambda xs: ['so {"stance": "bearish", "confidence": 0.8} ok' for _ in xs]).first()
    assert (got.stance, got.stance_confidence, got.method) == ("bearish", 0.8, "service")
    assert classify.salvage("nothing") == ("neutral", 0.0) and classify.salvage('{"stance": "odd"}') == ("neutral", 0.5)


def test_streams_equal_batches(spark, tiny, tmp_path):
    m = spark.read.parquet(f"{tiny}/mentions.parquet")
    m.repartition(3).write.parquet(f"{tmp_path}/in")
    s = lambda: spark.readStream.schema(m.schema).parquet(f"{tmp_path}/in")
    live.drain(live.stream_panel(s(), delay="5000 days"), f"{tmp_path}/p", f"{tmp_path}/c1")
    far = m.limit(1).withColumns({"created_utc": F.lit(4_000_000_000), "confidence": F.lit(0.9), "entity_id": F.lit("zzz")})
    far.write.mode("append").parquet(f"{tmp_path}/in")  # moves the watermark, so that all windows close
    live.drain(live.stream_panel(s(), delay="5000 days"), f"{tmp_path}/p", f"{tmp_path}/c1")
    got = {(r.entity_id, r.window_start, r.n_mentions, r.total_score) for r in spark.read.parquet(f"{tmp_path}/p").collect()}
    want = live.stream_panel(m, delay="5000 days")
    assert got == {(r.entity_id, r.window_start, r.n_mentions, r.total_score) for r in want.collect()}
    assert live.sessions(m).agg(F.sum("n_mentions")).first()[0] == m.where("entity_id is not null").count()


def test_rate_limit_stream(spark, tmp_path):
    calls = [("a", t) for t in (100, 101, 102, 103, 170)] + [("b", 100)]
    spark.createDataFrame(calls, "name string, at long").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("name string, at long").parquet(f"{tmp_path}/in")
    live.drain(live.limit_rate(s, {60: 3}), f"{tmp_path}/o", f"{tmp_path}/c")
    got = {(r.name, r.at): r.granted for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    assert got == {("a", 100): True, ("a", 101): True, ("a", 102): True, ("a", 103): False, ("a", 170): True, ("b", 100): True}
