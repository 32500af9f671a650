"""Queries of the general data problems: repeated delivery, hot keys, attributes as known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threshfold.functions.symbols import message_key_sql, symbol_key, symbol_key_sql
from threshfold.operators.hot_keys import heavy_keys, key_totals
from threshfold.operators.known_at import attach_known
from threshfold.operators.once import mark_surplus, merge_ranges, seen_keys, seen_ranges
from threshfold.session import table, written

DELETED = "[deleted]"
HEAVY_SHARE = 0.05
ATTRS = ["ticker", "name", "exchange"]


def _marked(spark: SparkSession, d: str) -> DataFrame:
    return mark_surplus({t: table(spark, d, t).select("ingest_no", "id", "retrieved_on") for t in ("submissions", "comments")})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).where("surplus").select("src", F.col("row_no").alias("ingest_no"))


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).where("not surplus").select("src", F.col("row_no").alias("ingest_no"))


BATCHES = 3


def p2_batches(spark: SparkSession, d: str) -> DataFrame:
    """The deliveries as three batches in the order of ``ingest_no``: what each accepts, given the ranges
    and keys that the batches before it left behind. A message stays with its first batch."""
    tables = {}
    for t in ("submissions", "comments"):
        df = table(spark, d, t).select("ingest_no", "id", "retrieved_on")
        lo, hi = df.agg(F.min("ingest_no")).scalar(), df.agg(F.max("ingest_no")).scalar()
        tables[t] = df.withColumn("batch", F.floor((F.col("ingest_no") - lo) * F.lit(BATCHES) / (hi - lo + 1)).cast("int"))
    out = ranges = keys = None
    for k in range(BATCHES):
        now = {t: df.where(F.col("batch") == k) for t, df in tables.items()}
        part = mark_surplus(now, seen=ranges, seen_keys=keys).where("not surplus").select("src", F.col("row_no").alias("ingest_no"), F.lit(k).alias("batch"))
        out = part if out is None else out.unionByName(part)
        if k + 1 < BATCHES:
            new, odd = (seen_ranges(now["submissions"], "submissions").unionByName(seen_ranges(now["comments"], "comments")), seen_keys(now["submissions"], "submissions").unionByName(seen_keys(now["comments"], "comments")))
            ranges = written(new if ranges is None else merge_ranges(ranges, new), "ranges")
            keys = written(odd if keys is None else keys.unionByName(odd).distinct(), "keys")
    return out


_P2_BATCH = """SELECT '{t}' AS src, ingest_no, id, {k} AS k, retrieved_on, CAST(floor((ingest_no - (SELECT min(ingest_no) FROM {t})) * 3.0 / (SELECT max(ingest_no) - min(ingest_no) + 1 FROM {t})) AS INTEGER) AS batch FROM {t}"""
_P2_BATCHES = f"""WITH b AS ({' UNION ALL '.join(_P2_BATCH.format(t=t, k=message_key_sql('id')) for t in ('submissions', 'comments'))}),
 r AS (SELECT *, min(batch) OVER (PARTITION BY src, k) AS first_batch, row_number() OVER (PARTITION BY src, k, batch ORDER BY retrieved_on DESC NULLS LAST, ingest_no) AS rn FROM b)
 SELECT src, ingest_no, batch FROM r WHERE id IS NULL OR (batch = first_batch AND rn = 1)"""


def _p2_sql(surplus: bool) -> str:
    part = """SELECT '{t}' AS src, ingest_no, row_number() OVER (PARTITION BY {k} ORDER BY retrieved_on DESC NULLS LAST, ingest_no) AS rn, id FROM {t}"""
    both = " UNION ALL ".join(part.format(t=t, k=message_key_sql("id")) for t in ("submissions", "comments"))
    return f"SELECT src, ingest_no FROM ({both}) WHERE " + ("id IS NOT NULL AND rn > 1" if surplus else "id IS NULL OR rn = 1")


def _mention_totals(spark: SparkSession, d: str, full: bool) -> DataFrame:
    m = table(spark, d, "mentions")
    return key_totals(m, ["entity_id", "ticker"], "created_utc", "score", "author", (DELETED,)) if full else key_totals(m, ["entity_id", "ticker"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(_mention_totals(spark, d, False), HEAVY_SHARE)


def p3_key_totals(spark: SparkSession, d: str) -> DataFrame:
    t = _mention_totals(spark, d, True).where("key_value is not null")
    return t.select("field", "key_value", F.col("n_rows").alias("n_mentions"), F.col("n_distinct").alias("n_authors"), F.col("first_at").alias("first_mention"), F.col("total").alias("total_score"))


_P3 = """SELECT '{f}' AS field, {f} AS key_value, count(*) AS n_mentions,
 count(DISTINCT CASE WHEN author <> '[deleted]' THEN author END) AS n_authors, min(created_utc) AS first_mention, CAST(sum(score) AS BIGINT) AS total_score
 FROM mentions WHERE {f} IS NOT NULL GROUP BY {f}"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "mentions").select(
        F.lit("mentions").alias("src"), F.col("mention_no").alias("row_no"), F.col("entity_id").alias("entity"), F.to_date(F.timestamp_seconds("created_utc")).alias("day"), F.col("ticker").alias("said")
    )
    p = table(spark, d, "panel").select(
        F.lit("panel").alias("src"), F.col("panel_no").alias("row_no"), F.col("entity_id").alias("entity"), F.last_day(F.to_date(F.concat("year_month", F.lit("-01")))).alias("day"), F.col("ticker_at_date").alias("said")
    )
    return m.unionByName(p)


def p6_known_attributes(spark: SparkSession, d: str) -> DataFrame:
    return attach_known(_events(spark, d), table(spark, d, "tickers"), ATTRS, "entity", "day").select("src", "row_no", *[f"known_{a}" for a in ATTRS])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    got = attach_known(_events(spark, d), table(spark, d, "tickers"), ["ticker"], "entity", "day")
    return got.where(symbol_key("said") != symbol_key("known_ticker")).select("src", "row_no")


_P6_EVENTS = """SELECT 'mentions' AS src, mention_no AS row_no, entity_id AS entity, CAST(to_timestamp(created_utc) AT TIME ZONE 'UTC' AS DATE) AS day, ticker AS said FROM mentions
 UNION ALL SELECT 'panel', panel_no, entity_id, last_day(CAST(year_month || '-01' AS DATE)), ticker_at_date FROM panel"""


def _p6_sql(attrs: list[str]) -> str:
    ask = f"WITH ev AS ({_P6_EVENTS}), pairs AS (SELECT DISTINCT entity, day FROM ev WHERE entity IS NOT NULL AND day IS NOT NULL)"
    for a in attrs:
        ask += f""", a_{a} AS (SELECT entity, day, v FROM (SELECT p.entity, p.day, t.{a} AS v, row_number() OVER (PARTITION BY p.entity, p.day ORDER BY t.known_on DESC, t.listing_no DESC) AS rn
 FROM pairs p JOIN tickers t ON t.entity_id = p.entity AND t.listed_from <= p.day AND (t.listed_to IS NULL OR t.listed_to >= p.day) AND t.known_on <= p.day WHERE t.{a} IS NOT NULL) WHERE rn = 1)"""
    return ask


def _join_attrs(attrs: list[str]) -> str:
    return "ev " + " ".join(f"LEFT JOIN a_{a} ON a_{a}.entity = ev.entity AND a_{a}.day = ev.day" for a in attrs)


QUERIES = {f.__name__: f for f in (p2_found, p2_kept, p2_batches, p3_found, p3_key_totals, p6_found, p6_known_attributes)}

SQL = {
    "p2_found": _p2_sql(True),
    "p2_kept": _p2_sql(False),
    "p2_batches": _P2_BATCHES,
    "p3_found": " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS key_value FROM mentions WHERE {f} IS NOT NULL GROUP BY {f} HAVING count(*) >= 0.05 * (SELECT count(*) FROM mentions)" for f in ("entity_id", "ticker")),
    "p3_key_totals": " UNION ALL ".join(_P3.format(f=f) for f in ("entity_id", "ticker")),
    "p6_found": _p6_sql(["ticker"]) + f" SELECT ev.src, ev.row_no FROM {_join_attrs(['ticker'])} WHERE {symbol_key_sql('ev.said')} <> {symbol_key_sql('a_ticker.v')}",
    "p6_known_attributes": _p6_sql(ATTRS) + f" SELECT ev.src, ev.row_no, {', '.join(f'a_{a}.v AS known_{a}' for a in ATTRS)} FROM {_join_attrs(ATTRS)}",
}
