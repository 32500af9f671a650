"""Queries of the text and set problems with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threshfold.functions.symbols import symbol_key, symbol_key_sql
from threshfold.llm.leakage import leaks
from threshfold.llm.nearest import nearest_join, seconds_of
from threshfold.llm.packing import containers, fill_report
from threshfold.llm.patterns import ERROR_BOUND, cell_counts, cells, combination_counts, pair_counts, space, space_counts, space_patterns, space_totals
from threshfold.llm.pii import find_items, redacted
from threshfold.llm.quality import quality
from threshfold.session import table

TOLERANCE = 259_200
DELETED = "[deleted]"


# --- 1: personal information -----------------------------------------------------------------

_BODIES = (("submissions", "selftext"), ("comments", "body"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every item of personal information in posts and comments, as delivered."""
    a, b = (find_items(table(spark, d, t), c, "ingest_no", t) for t, c in _BODIES)
    return a.unionByName(b).select("src", "ingest_no", "pii_type", "span_start")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders."""
    a, b = (redacted(table(spark, d, t).select(F.lit(t).alias("src"), "ingest_no", F.col(c).alias("text")), "text") for t, c in _BODIES)
    return a.unionByName(b)


# --- 4: distinct counts ----------------------------------------------------------------------


_WHO = {"author": (DELETED,), "entity_id": ()}
_SETS = ["day", "channel", "ticker", "channel_month"]


def _month(day: Column) -> Column:
    return F.date_format(F.date_from_unix_date(day), "yyyy-MM")


def _groups() -> dict[str, Column]:
    """Groups of every dimension as they come out of the sets of the pattern space."""
    day = F.transform("day", lambda x: F.date_format(F.date_from_unix_date(x), "yyyy-MM-dd"))
    return {"day": day, "channel": F.col("channel"), "ticker": F.col("ticker"), "month": F.transform("day", _month), "channel_month": F.col("channel_month")}


def _space(spark: SparkSession, d: str) -> DataFrame:
    """The pattern totals of authors and entities over day, channel, ticker (as written), month and channel by month."""
    day = F.floor(F.col("created_utc") / 86_400).cast("int")
    month = F.date_format(F.date_from_unix_date(day), "yyyy-MM")
    m = table(spark, d, "mentions")
    return space_totals(space(m, _WHO, {"day": day, "channel": F.col("channel"), "ticker": F.col("ticker"), "channel_month": F.concat_ws("|", "channel", month)}), _SETS)


def p4_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct authors and entities of every day, channel, ticker, month and channel by month, and entities of
    every panel month."""
    p = space(table(spark, d, "panel"), {"entity_id": ()}, {"panel_month": F.col("year_month")})
    out = space_counts(_space(spark, d), _groups()).unionByName(space_counts(space_totals(p, ["panel_month"]), {"panel_month": F.col("panel_month")}))
    return out.withColumn("error_bound", F.lit(ERROR_BOUND)).select("counted", "dimension", "grp", "n_distinct", "error_bound")


def _stated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Channels (``channel, all``: with the list of all, as many entries as there are channels), and months with
    the month after each (``m, after``)."""
    m = table(spark, d, "mentions")
    known = m.agg(F.array_sort(F.collect_set("channel")).alias("all"))
    month = m.where("created_utc is not null").select(F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM").alias("m")).distinct()
    return known, month.select("m", F.date_format(F.add_months(F.to_date(F.concat("m", F.lit("-01"))), 1), "yyyy-MM").alias("after"))


def _combinations(spark: SparkSession, d: str, who: str) -> DataFrame:
    t = _space(spark, d).where(F.col("counted") == who)
    known, months = _stated(spark, d)
    of = lambda n, *g: F.array(*[F.concat(F.lit(n + "="), x) for x in g])
    pairs = known.select(F.posexplode("all").alias("i", "channel"), "all").select("channel", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("other"))
    pairs = pairs.select(F.concat_ws("+", "channel", "other").alias("combo"), F.lit(f"channel|{who}").alias("dimension"), of("channel", F.col("channel"), F.col("other")).alias("grps"))
    months = months.select(F.concat_ws("+", "m", "after").alias("combo"), F.lit(f"month|{who}").alias("dimension"), of("month", F.col("m"), F.col("after")).alias("grps"))
    totals = space_patterns(t, "channel", {"channel": _groups()["channel"]}).unionByName(space_patterns(t, "month", {"month": _groups()["month"]}))
    return combination_counts(totals, pairs.unionByName(months)).withColumn("dimension", F.split("dimension", "[|]")[0])


def p4_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Distinct authors of combinations: every pair of channels, and each month with the month after it."""
    return _combinations(spark, d, "author")


def p4_mixed_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Authors and entities in any, all or only of three groups of two dimensions: every channel with every month
    and the month after it."""
    known, months = _stated(spark, d)
    each = months.withColumn("k", F.lit(1)).join(F.broadcast(known.withColumn("k", F.lit(1))), "k").select("m", "after", F.explode("all").alias("channel"))
    each = each.select(F.explode(F.array(*[F.lit(f"mixed|{w}") for w in _WHO])).alias("dimension"), F.concat_ws("+", "channel", "m", "after").alias("combo"), F.array(F.concat(F.lit("channel="), "channel"), F.concat(F.lit("month="), "m"), F.concat(F.lit("month="), "after")).alias("grps"))
    got = combination_counts(space_patterns(_space(spark, d), "mixed", {n: g for n, g in _groups().items() if n in ("channel", "month")}), each)
    return got.select(F.split("dimension", "[|]")[1].alias("counted"), "combo", "n_any", "n_all", "n_only")


def _cells(spark: SparkSession, d: str, who: str, only: tuple[str, ...] = ("day", "channel", "ticker")) -> DataFrame:
    at = F.timestamp_seconds("created_utc")
    fields = {"day": F.date_format(at, "yyyy-MM-dd"), "channel": F.col("channel"), "ticker": symbol_key("ticker")}
    return cells(table(spark, d, "mentions"), who, {n: fields[n] for n in only}, (DELETED,) if who == "author" else ())


_CELL = {"day": lambda x: x["day"], "channel": lambda x: x["channel"], "ticker": lambda x: x["ticker"], "month": lambda x: F.substring(x["day"], 1, 7)}
#: Groups of several fields; day with month is the day, and channel with month is in p4_distinct_counts.
_CROSSED = (("channel", "ticker"), ("ticker", "month"), ("day", "channel"), ("day", "ticker"), ("channel", "ticker", "month"), ("day", "channel", "ticker"))
_PAIRS = [("channel", "ticker"), ("channel", "month"), ("ticker", "month"), ("day", "channel"), ("day", "ticker"), ("day", "month")]


def p4_ticker_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct authors and entities of every ticker, however it is written."""
    a, e = (cell_counts(_cells(spark, d, w, ("ticker",)), {"ticker": _CELL["ticker"]}).select(F.lit(w).alias("counted"), "dimension", "grp", "n_distinct", F.lit(ERROR_BOUND).alias("error_bound")) for w in ("author", "entity_id"))
    return a.unionByName(e)


def p4_cross_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct authors and entities of the mentions that share a day, channel, ticker or month in combination."""
    groups = {"_".join(c): lambda x, c=c: F.concat(*[p for n in c for p in (F.lit("|"), _CELL[n](x))][1:]) for c in _CROSSED}
    a, e = (cell_counts(_cells(spark, d, w), groups).select(F.lit(w).alias("counted"), "dimension", "grp", "n_distinct", F.lit(ERROR_BOUND).alias("error_bound")) for w in ("author", "entity_id"))
    return a.unionByName(e)


def p4_cross_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Authors and entities in any, all or only of two groups: every pair of groups of two dimensions, and for entities the pairs of p4_combinations."""
    out = _combinations(spark, d, "entity_id").select(F.lit("entity_id").alias("counted"), "*")
    for w in ("author", "entity_id"):
        got = pair_counts(_cells(spark, d, w), _CELL, _PAIRS)
        out = out.unionByName(got.select(F.lit(w).alias("counted"), F.concat_ws("+", "one", "other").alias("combo"), "dimension", "n_any", "n_all", "n_only"))
    return out


_P4_AT = "to_timestamp(created_utc) AT TIME ZONE 'UTC'"
_P4_DIMS = {"day": f"strftime({_P4_AT}, '%Y-%m-%d')", "channel": "channel", "ticker": "ticker", "month": f"strftime({_P4_AT}, '%Y-%m')", "channel_month": f"concat_ws('|', channel, strftime({_P4_AT}, '%Y-%m'))"}
_P4 = " UNION ALL ".join(
    [f"SELECT '{w}' AS counted, '{n}' AS dimension, {g} AS grp, count(DISTINCT {w}) AS n_distinct, 0.0::DOUBLE AS error_bound FROM mentions WHERE {w} IS NOT NULL AND {w} <> '[deleted]' AND {g} IS NOT NULL GROUP BY 3" for w in ("author", "entity_id") for n, g in _P4_DIMS.items()]
    + ["SELECT 'entity_id', 'panel_month', year_month, count(DISTINCT entity_id), 0.0 FROM panel WHERE entity_id IS NOT NULL AND year_month IS NOT NULL GROUP BY 3"]
)
_P4_COMBO = f"""WITH m AS (SELECT DISTINCT author, channel, {_P4_DIMS['month']} AS month FROM mentions), ok AS (SELECT * FROM m WHERE author IS NOT NULL AND author <> '[deleted]'),
g AS (SELECT DISTINCT author, 'channel' AS dimension, channel AS grp FROM ok WHERE channel IS NOT NULL UNION ALL SELECT DISTINCT author, 'month', month FROM ok WHERE month IS NOT NULL),
c AS (SELECT DISTINCT 'channel' AS dimension, a.channel || '+' || b.channel AS combo, a.channel AS x, b.channel AS y FROM m a JOIN m b ON a.channel < b.channel
 UNION ALL SELECT DISTINCT 'month', month || '+' || strftime(CAST(month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m'), month, strftime(CAST(month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') FROM m WHERE month IS NOT NULL),
h AS (SELECT c.combo, c.dimension, g.author, count(*) AS k FROM c JOIN g ON g.dimension = c.dimension AND g.grp IN (c.x, c.y) GROUP BY 1, 2, 3),
s AS (SELECT author, dimension, count(*) AS k FROM g GROUP BY 1, 2)
SELECT c.combo, c.dimension, count(h.author) AS n_any, CAST(count(CASE WHEN h.k = 2 THEN 1 END) AS BIGINT) AS n_all, CAST(count(CASE WHEN h.k = s.k THEN 1 END) AS BIGINT) AS n_only
FROM c LEFT JOIN h ON h.combo = c.combo AND h.dimension = c.dimension LEFT JOIN s ON s.author = h.author AND s.dimension = h.dimension GROUP BY 1, 2"""

_P4_MIXED = f"""WITH m AS (SELECT author, entity_id, channel, {_P4_DIMS['month']} AS month FROM mentions),
g AS ({" UNION ".join(f"SELECT '{w}' AS counted, {w} AS who, '{n}=' || {n} AS k FROM m WHERE {w} IS NOT NULL AND {w} <> '[deleted]' AND {n} IS NOT NULL" for w in ("author", "entity_id") for n in ("channel", "month"))}),
c AS (SELECT DISTINCT x.channel || '+' || y.month || '+' || strftime(CAST(y.month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS combo, x.channel, y.month, strftime(CAST(y.month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS after
 FROM (SELECT DISTINCT channel FROM m WHERE channel IS NOT NULL) x, (SELECT DISTINCT month FROM m WHERE month IS NOT NULL) y),
k AS (SELECT combo, unnest(['channel=' || channel, 'month=' || month, 'month=' || after]) AS k FROM c), h AS (SELECT k.combo, g.counted, g.who, count(*) AS n FROM k JOIN g ON g.k = k.k GROUP BY ALL), s AS (SELECT counted, who, count(*) AS n FROM g GROUP BY ALL)
SELECT w.counted, c.combo, count(h.who) AS n_any, CAST(count(CASE WHEN h.n = 3 THEN 1 END) AS BIGINT) AS n_all, CAST(count(CASE WHEN h.n = s.n THEN 1 END) AS BIGINT) AS n_only
FROM c CROSS JOIN (VALUES ('author'), ('entity_id')) w(counted) LEFT JOIN h ON h.combo = c.combo AND h.counted = w.counted LEFT JOIN s ON s.counted = h.counted AND s.who = h.who GROUP BY 1, 2"""

_P4_WHO = {"author": "author IS NOT NULL AND author <> '[deleted]'", "entity_id": "entity_id IS NOT NULL"}
_P4_CELL = _P4_DIMS | {"ticker": symbol_key_sql("ticker")}
_P4_TICKER = " UNION ALL ".join(
    f"SELECT '{w}' AS counted, 'ticker' AS dimension, {_P4_CELL['ticker']} AS grp, count(DISTINCT {w}) AS n_distinct, 0.0::DOUBLE AS error_bound FROM mentions WHERE {ok} AND ticker IS NOT NULL GROUP BY 3"
    for w, ok in _P4_WHO.items()
)
_P4_CROSS = " UNION ALL ".join(
    f"SELECT '{w}' AS counted, '{'_'.join(c)}' AS dimension, {g} AS grp, count(DISTINCT {w}) AS n_distinct, 0.0::DOUBLE AS error_bound FROM mentions WHERE {ok} AND {g} IS NOT NULL GROUP BY 3"
    for w, ok in _P4_WHO.items() for c in _CROSSED for g in [" || '|' || ".join(f"({_P4_CELL[n]})" for n in c)]
)
_P4_CROSS_COMBO = f"""WITH p(x, y) AS (VALUES {", ".join(map(str, _PAIRS))}),
s AS ({" UNION ".join(f"SELECT '{w}' AS counted, {w} AS who, '{n}' AS dim, {_P4_CELL[n]} AS grp FROM mentions WHERE {ok} AND {_P4_CELL[n]} IS NOT NULL" for w, ok in _P4_WHO.items() for n in ("day", "channel", "ticker", "month"))}),
g AS (SELECT counted, dim, grp, count(*) AS n FROM s GROUP BY ALL),
b AS (SELECT p.x, p.y, i.counted, i.grp AS one, j.grp AS other, count(*) AS n FROM p JOIN s i ON i.dim = p.x JOIN s j ON j.dim = p.y AND j.counted = i.counted AND j.who = i.who GROUP BY ALL),
f AS (SELECT p.x, p.y, s.counted, s.who, min(CASE WHEN s.dim = p.x THEN s.grp END) AS one, min(CASE WHEN s.dim = p.y THEN s.grp END) AS other FROM p JOIN s ON s.dim IN (p.x, p.y) GROUP BY 1, 2, 3, 4
 HAVING count(CASE WHEN s.dim = p.x THEN 1 END) <= 1 AND count(CASE WHEN s.dim = p.y THEN 1 END) <= 1),
o AS (SELECT x, y, counted, one, other, count(*) AS n FROM f GROUP BY ALL)
SELECT i.counted, i.grp || '+' || j.grp AS combo, p.x || '+' || p.y AS dimension, i.n + j.n - coalesce(b.n, 0) AS n_any, coalesce(b.n, 0) AS n_all, coalesce(o.n, 0) + coalesce(q.n, 0) + coalesce(r.n, 0) AS n_only
FROM p JOIN g i ON i.dim = p.x JOIN g j ON j.dim = p.y AND j.counted = i.counted
LEFT JOIN b ON b.x = p.x AND b.y = p.y AND b.counted = i.counted AND b.one = i.grp AND b.other = j.grp
LEFT JOIN o ON o.x = p.x AND o.y = p.y AND o.counted = i.counted AND o.one = i.grp AND o.other = j.grp
LEFT JOIN o q ON q.x = p.x AND q.y = p.y AND q.counted = i.counted AND q.one = i.grp AND q.other IS NULL
LEFT JOIN o r ON r.x = p.x AND r.y = p.y AND r.counted = i.counted AND r.one IS NULL AND r.other = j.grp
UNION ALL SELECT 'entity_id', * FROM ({_P4_COMBO.replace("author", "entity_id")})"""


# --- 5: nearest time -------------------------------------------------------------------------


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Every mention with the nearest priced day of its ticker, nulls where none is within three days."""
    left = table(spark, d, "mentions").select(symbol_key("ticker").alias("entity"), F.col("created_utc").alias("at"), F.col("mention_no").alias("row_no"))
    right = table(spark, d, "prices").where("adj_close is not null").select(symbol_key("symbol").alias("entity"), seconds_of(F.col("date")).alias("at"), F.col("adj_close").alias("value"))
    got = nearest_join(left, right, TOLERANCE)
    return got.select(F.col("row_no").alias("mention_no"), F.date_format(F.timestamp_seconds("match_at"), "yyyy-MM-dd").alias("price_date"), F.col("match_value").alias("adj_close"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_nearest(spark, d).where("price_date is not null").select("mention_no", "price_date")


_P5 = f"""WITH px AS (SELECT {symbol_key_sql('symbol')} AS s, date, CAST(epoch(date) AS BIGINT) AS t, max(adj_close) AS adj_close FROM prices WHERE adj_close IS NOT NULL AND symbol IS NOT NULL AND date IS NOT NULL GROUP BY ALL),
c AS (SELECT m.mention_no, px.date, px.adj_close, row_number() OVER (PARTITION BY m.mention_no ORDER BY abs(m.created_utc - px.t), px.t) AS rn
 FROM mentions m JOIN px ON px.s = {symbol_key_sql('m.ticker')} AND px.t BETWEEN m.created_utc - 259200 AND m.created_utc + 259200)"""

# --- 7, 8, 9: containers, leaks, quality -----------------------------------------------------


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document (or piece of a long one) and its container of 2,048 tokens."""
    return containers(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, against the least number that the tokens need."""
    return fill_report(p7_containers(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items they leak and the number of words."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_quality(spark, d).where("form <> 'prose'").select("doc_id", "form")


def p9_quality(spark: SparkSession, d: str) -> DataFrame:
    """Statistics, form and failed rules of every document."""
    return quality(table(spark, d, "documents"), table(spark, d, "word_rank"))


def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counting statistics alone, to be held against SQL."""
    return p9_quality(spark, d).select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "punct_line_share", "common_share")])


_P9 = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w,
 list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '[\s\p{Z}]*')) AS l FROM documents WHERE text IS NOT NULL),
k AS (SELECT list(lower(word)) AS words FROM word_rank WHERE word IS NOT NULL)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(list_sum(list_transform(w, lambda x: length(x))) / greatest(len(w), 1), 0), 6) AS mean_word_length,
 round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?…]["''”’»)\]*_]*[\s\p{Z}]*$'))) / greatest(len(l), 1), 6) AS punct_line_share,
 round(len(list_filter(w, lambda x: list_contains(k.words, x))) / greatest(len(w), 1), 6) AS common_share FROM d, k"""

QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_redacted, p4_distinct_counts, p4_combinations, p4_mixed_combinations, p4_ticker_counts, p4_cross_counts, p4_cross_combinations, p5_found, p5_nearest, p7_containers, p7_fill, p8_found, p8_leaks, p9_found, p9_quality, p9_counts)
}
SQL = {
    "p9_counts": _P9,
    "p4_distinct_counts": _P4,
    "p4_combinations": _P4_COMBO,
    "p4_mixed_combinations": _P4_MIXED,
    "p4_ticker_counts": _P4_TICKER,
    "p4_cross_counts": _P4_CROSS,
    "p4_cross_combinations": _P4_CROSS_COMBO,
    "p5_found": _P5 + " SELECT mention_no, strftime(date, '%Y-%m-%d') AS price_date FROM c WHERE rn = 1",
    "p5_nearest": _P5 + " SELECT m.mention_no, strftime(c.date, '%Y-%m-%d') AS price_date, c.adj_close FROM mentions m LEFT JOIN c ON c.mention_no = m.mention_no AND c.rn = 1",
}
