"""Queries of the mention study and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threshfold.functions import stats as S
from threshfold.functions import text as T
from threshfold.functions.symbols import message_key, message_key_sql, symbol_key, symbol_key_sql
from threshfold.operators import cohort as C
from threshfold.operators import extraction as X
from threshfold.operators import lift as L
from threshfold.operators import outcomes as O
from threshfold.operators import panel as P
from threshfold.operators import review as R
from threshfold.operators import series as Z
from threshfold.operators import timejoin as J
from threshfold.operators import universe as U
from threshfold.operators.once import deliver_once
from threshfold.session import table, written

YEARS = (2019, 2020, 2021)
MIN_AUTHORS = 20
HORIZONS = (1, 2)
SEED = 20260816
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# --- shared parts ----------------------------------------------------------------------------


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return P.documents_of(table(spark, d, "submissions"), table(spark, d, "comments"))


def _prices(spark: SparkSession, d: str) -> DataFrame:
    return O.clean_prices(table(spark, d, "prices"))


def _treated(spark: SparkSession, d: str) -> DataFrame:
    return C.treated_names(table(spark, d, "mentions"), symbol_key("ticker"), YEARS, MIN_AUTHORS)


def _cohort(spark: SparkSession, d: str) -> DataFrame:
    t = _treated(spark, d)
    c = C.matched_dates(t, C.control_pool(_prices(spark, d).select("ticker"), t), SEED)
    a = t.select("ticker", F.lit("treated").alias("grp"), F.col("first_mention").alias("formation_date"), "n_mentions", "n_authors")
    zero = F.lit(0).cast("long")
    return a.unionByName(c.select("ticker", F.lit("control").alias("grp"), "formation_date", zero.alias("n_mentions"), zero.alias("n_authors")))


def _benchmark(px: DataFrame) -> DataFrame:
    n = px.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    name = n.agg(F.min_by("ticker", F.struct(-F.col("n"), F.col("ticker")))).scalar()
    return px.where(F.col("ticker") == name).select("date", "price")


def _analysis(spark: SparkSession, d: str) -> DataFrame:
    """The analysis table, computed by every query that asks for it."""
    px = _prices(spark, d)
    return O.outcomes(_cohort(spark, d), px, HORIZONS, _benchmark(px))


def _names(spark: SparkSession, d: str, horizon: int = 2) -> DataFrame:
    """One row per name and group at a horizon, with its size stratum. The rows (names) are written once
    for the query that asks: edges, rates and weights all read them."""
    a = written(_analysis(spark, d).where(F.col("horizon_years") == horizon), "analysis")
    return L.stratified(a, L.strata_edges(a))


_ONCE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY retrieved_on DESC NULLS LAST, ingest_no) AS rn FROM {t}) WHERE id IS NULL OR rn = 1"
_DOCS = f"""docs AS (SELECT 'post' AS doc_type, {message_key_sql('id')} AS doc_id, score AS doc_score, num_comments, (retrieved_on - created_utc) / 86400.0 AS lag_days,
 coalesce(removed_by_category <> '', false) OR coalesce(selftext IN ('[deleted]', '[removed]'), false) AS removed FROM ({_ONCE.format(k=message_key_sql('id'), t='submissions')})
 UNION ALL SELECT 'comment', {message_key_sql('id')}, score, NULL, (retrieved_on - created_utc) / 86400.0, coalesce(removed_by_category <> '', false) OR coalesce(body IN ('[deleted]', '[removed]'), false)
 FROM ({_ONCE.format(k=message_key_sql('id'), t='comments')}))"""
_DAY = "CAST(to_timestamp(created_utc) AT TIME ZONE 'UTC' AS DATE)"
_MEN = f"men AS (SELECT *, {_DAY} AS day, strftime({_DAY}, '%Y-%m') AS year_month, CASE WHEN author <> '[deleted]' THEN author END AS who, {symbol_key_sql('ticker')} AS name FROM mentions WHERE confidence >= 0.75)"
_PX = f"px AS (SELECT {symbol_key_sql('symbol')} AS ticker, date, max(adj_close) AS price, max(coalesce(close_px, 0) * coalesce(volume, 0)) AS dollar_volume FROM prices WHERE symbol IS NOT NULL AND date IS NOT NULL AND adj_close IS NOT NULL GROUP BY 1, 2)"
_TREATED = f"""treated AS (SELECT name AS ticker, count(*) AS n_mentions, count(DISTINCT who) AS n_authors, min(day) AS first_mention, arg_min(entity_id, (created_utc, mention_no)) AS entity_id
 FROM men WHERE name IS NOT NULL AND year(day) IN (2019, 2020, 2021) GROUP BY 1 HAVING count(DISTINCT who) >= {MIN_AUTHORS})"""
_COHORT = f"""{_MEN}, {_PX}, {_TREATED}, pool AS (SELECT DISTINCT ticker FROM px WHERE ticker NOT IN (SELECT ticker FROM treated)),
 td AS (SELECT first_mention AS day, row_number() OVER (ORDER BY first_mention, ticker) - 1 AS i FROM treated),
 cd AS (SELECT ticker, row_number() OVER (ORDER BY md5('{SEED}|' || ticker), ticker) - 1 AS r FROM pool),
 cohort AS (SELECT ticker, 'treated' AS grp, first_mention AS formation_date, n_mentions, n_authors FROM treated
 UNION ALL SELECT cd.ticker, 'control', td.day, 0, 0 FROM cd JOIN td ON td.i = CAST(floor(cd.r * (SELECT count(*) FROM treated) / (SELECT count(*) FROM pool)) AS BIGINT))"""


def _outcome_sql(rows: str, series: str, out: str, match: str) -> str:
    """CTEs of entry and exit of ``rows`` in ``series``."""
    return f"""{out}_e AS (SELECT c.*, (SELECT min((x.date, x.price, x.dollar_volume)) FROM {series} x WHERE {match.format('c', 'x')} AND x.date BETWEEN c.formation_date AND c.formation_date + 15) AS e FROM {rows} c),
 {out}_h AS (SELECT *, e[1] AS entry_date, e[2] AS entry_price, e[3] AS entry_dv, CAST(e[1] + to_years(h) AS DATE) AS target, h AS horizon_years FROM {out}_e, (VALUES (1), (2)) v(h) WHERE e[2] > 0),
 {out}_x AS (SELECT c.*, (SELECT min((x.date, x.price)) FROM {series} x WHERE {match.format('c', 'x')} AND x.date BETWEEN c.target AND c.target + 15) AS a,
 (SELECT max((x.date, x.price)) FROM {series} x WHERE {match.format('c', 'x')} AND x.date <= c.target) AS b FROM {out}_h c),
 {out} AS (SELECT *, a IS NOT NULL AS survived_full_horizon, coalesce(a[1], b[1]) AS exit_date, coalesce(a[2], b[2]) AS exit_price, coalesce(a[2], b[2]) / entry_price - 1 AS ret FROM {out}_x WHERE a IS NOT NULL OR b[1] > entry_date)"""


_ANALYSIS = f"""{_COHORT}, bench AS (SELECT date, price, 0.0 AS dollar_volume FROM px WHERE ticker = (SELECT ticker FROM px GROUP BY ticker ORDER BY count(*) DESC, ticker LIMIT 1)),
 {_outcome_sql('cohort', 'px', 'oc', '{0}.ticker = {1}.ticker')}, days AS (SELECT DISTINCT formation_date FROM cohort), {_outcome_sql('days', 'bench', 'ob', 'true')},
 near AS (SELECT o.ticker, o.entry_date, x.dollar_volume, row_number() OVER (PARTITION BY o.ticker, o.entry_date ORDER BY x.date) AS r FROM (SELECT DISTINCT ticker, entry_date FROM oc) o JOIN px x ON x.ticker = o.ticker AND x.date >= o.entry_date),
 size AS (SELECT ticker, entry_date, median(dollar_volume) AS size FROM near WHERE r <= 60 GROUP BY 1, 2), ends AS (SELECT ticker, max(date) AS last FROM px GROUP BY 1),
 an AS (SELECT oc.ticker, oc.grp, oc.n_mentions, oc.n_authors, oc.formation_date, oc.horizon_years, oc.entry_date, round(oc.entry_price, 6) AS entry_price, oc.exit_date, round(oc.exit_price, 6) AS exit_price,
 round(oc.ret, 6) AS forward_return, oc.survived_full_horizon, oc.ret >= 2.0 AS winner_3x, oc.ret <= -0.7 AS wipeout, round(coalesce(size.size, oc.entry_dv, 0), 2) AS dollar_volume,
 CASE WHEN oc.survived_full_horizon THEN 'horizon' WHEN ends.last > oc.target THEN 'hole' WHEN oc.target > (SELECT max(date) FROM px) THEN 'censored' ELSE 'series_ended' END AS exit_reason,
 round(ob.ret, 6) AS benchmark_return, round(oc.ret, 6) > round(ob.ret, 6) AS outperformer, round(round(oc.ret, 6) - round(ob.ret, 6), 6) AS excess_return
 FROM oc LEFT JOIN ob ON ob.formation_date = oc.formation_date AND ob.horizon_years = oc.horizon_years LEFT JOIN size ON size.ticker = oc.ticker AND size.entry_date = oc.entry_date LEFT JOIN ends ON ends.ticker = oc.ticker)"""
_NAMES = f"""{_ANALYSIS}, a2 AS (SELECT * FROM an WHERE horizon_years = 2), vals AS (SELECT list(dollar_volume ORDER BY dollar_volume) AS v FROM a2 WHERE dollar_volume > 0),
 edges AS (SELECT CASE WHEN len(v) >= 5 THEN list_sort(list_distinct([v[1 + len(v) * 1 // 5], v[1 + len(v) * 2 // 5], v[1 + len(v) * 3 // 5], v[1 + len(v) * 4 // 5]])) ELSE [] END AS edges FROM vals),
 n2 AS (SELECT a2.*, CASE WHEN dollar_volume > 0 THEN len(list_filter((SELECT edges FROM edges), lambda e: dollar_volume >= e)) ELSE 0 END AS stratum FROM a2)"""
_LABELS = ("winner_3x", "outperformer", "wipeout")
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT ticker, grp, stratum, '{x}' AS label, {x} AS hit FROM {{src}}" for x in _LABELS) + ")"
_ADJ = """cell AS (SELECT label, grp, stratum, count(*) AS n, count(*) FILTER (WHERE hit) AS k FROM long GROUP BY ALL),
 j AS (SELECT t.label, t.n AS w, c.n AS cn, c.k AS ck FROM cell t LEFT JOIN cell c ON c.label = t.label AND c.stratum = t.stratum AND c.grp = 'control' WHERE t.grp = 'treated'),
 adj AS (SELECT label, sum(CASE WHEN cn IS NOT NULL THEN w * ck / cn END) / sum(CASE WHEN cn IS NOT NULL THEN w END) AS p_control_adj, coalesce(sum(CASE WHEN cn IS NULL THEN w END), 0) / sum(w) AS unsupported FROM j GROUP BY 1),
 rate AS (SELECT grp, label, avg(CAST(hit AS DOUBLE)) AS rate FROM long WHERE hit IS NOT NULL GROUP BY ALL)"""
_LIFT = """SELECT t.label, round(t.rate, 6) AS p_treated, round(c.rate, 6) AS p_control, round(adj.p_control_adj, 6) AS p_control_adj, round(adj.unsupported, 6) AS unsupported,
 round(t.rate / nullif(c.rate, 0), 6) AS naive_lift, round(t.rate / nullif(adj.p_control_adj, 0), 6) AS adjusted_lift FROM rate t JOIN rate c ON c.label = t.label AND c.grp = 'control' JOIN adj ON adj.label = t.label WHERE t.grp = 'treated'"""
_SUMMARY = "count(*) AS n, round(avg(CAST(coalesce(winner_3x, false) AS DOUBLE)), 6) AS winner_rate, round(avg(CAST(coalesce(wipeout, false) AS DOUBLE)), 6) AS wipeout_rate, round(median(forward_return), 8) AS median_return"


# --- panel and funnels -----------------------------------------------------------------------

_PANEL_COLS = ["entity_id", "ticker_at_date", "year_month", "n_mentions", "n_distinct_authors", "n_toplevel_posts", "total_score", "max_score", "score_lag_days_median", "total_thread_comments", "n_removed", "first_mention_ever", "months_since_first_mention", "n_cashtag", "n_bare", "n_name", "n_in_title", "n_primary"]


@query(
    f"""WITH {_DOCS}, {_MEN}, m AS (SELECT men.*, d.doc_score, d.num_comments, d.lag_days, d.removed FROM men LEFT JOIN docs d ON d.doc_type = men.doc_type AND d.doc_id = men.doc_id WHERE entity_id IS NOT NULL),
 cells AS (SELECT entity_id, year_month, count(*) AS n_mentions, count(DISTINCT who) AS n_distinct_authors, count(*) FILTER (WHERE doc_type = 'post') AS n_toplevel_posts, CAST(sum(doc_score) AS BIGINT) AS total_score, CAST(max(doc_score) AS BIGINT) AS max_score,
 round(median(lag_days), 1) AS score_lag_days_median, count(*) FILTER (WHERE removed) AS n_removed, count(*) FILTER (WHERE channel = 'cashtag') AS n_cashtag, count(*) FILTER (WHERE channel = 'bare') AS n_bare, count(*) FILTER (WHERE channel = 'name') AS n_name,
 count(*) FILTER (WHERE in_title) AS n_in_title, count(*) FILTER (WHERE is_primary) AS n_primary, min(day) AS first_day FROM m GROUP BY 1, 2),
 th AS (SELECT entity_id, year_month, CAST(sum(c) AS BIGINT) AS t FROM (SELECT entity_id, year_month, doc_id, max(num_comments) AS c FROM m WHERE doc_type = 'post' AND num_comments IS NOT NULL GROUP BY ALL) GROUP BY 1, 2),
 tk AS (SELECT entity_id, year_month, arg_min(ticker, (-c, ticker)) AS ticker_at_date FROM (SELECT entity_id, year_month, ticker, count(*) AS c FROM m WHERE ticker IS NOT NULL GROUP BY ALL) GROUP BY 1, 2),
 o AS (SELECT c.*, coalesce(th.t, 0) AS total_thread_comments, tk.ticker_at_date, min(first_day) OVER (PARTITION BY c.entity_id) AS f FROM cells c LEFT JOIN th ON th.entity_id = c.entity_id AND th.year_month = c.year_month LEFT JOIN tk ON tk.entity_id = c.entity_id AND tk.year_month = c.year_month)
 SELECT entity_id, ticker_at_date, year_month, n_mentions, n_distinct_authors, n_toplevel_posts, total_score, max_score, score_lag_days_median, total_thread_comments, n_removed, (year(first_day) - year(f)) * 12 + month(first_day) - month(f) = 0 AS first_mention_ever,
 CAST((year(first_day) - year(f)) * 12 + month(first_day) - month(f) AS BIGINT) AS months_since_first_mention, n_cashtag, n_bare, n_name, n_in_title, n_primary FROM o"""
)
def mention_panel(spark, d):
    """The entity by month panel of the delivered-once tables."""
    return P.mention_panel(table(spark, d, "mentions"), _docs(spark, d)).select(*_PANEL_COLS)


@query(
    f"""WITH {_MEN}, p AS (SELECT entity_id, count(*) AS n, count(DISTINCT who) AS a FROM men WHERE entity_id IS NOT NULL GROUP BY 1)
 SELECT count(*) AS ever, count(*) FILTER (WHERE n >= 2) AS mentions_2, count(*) FILTER (WHERE n >= 5) AS mentions_5, count(*) FILTER (WHERE a >= 2) AS authors_2, count(*) FILTER (WHERE a >= 3) AS authors_3, round(count(*) / 5000.0, 6) AS share_of_universe FROM p"""
)
def funnel_counts(spark, d):
    return r6(P.funnel(P.confident(table(spark, d, "mentions"), 0.75)), "share_of_universe")


_LISTED = "li AS (SELECT entity_id, coalesce(listed_from, DATE '0001-01-01') AS b, coalesce(listed_to, DATE '9999-12-31') AS e FROM tickers)"


@query(
    f"""WITH {_MEN}, {_LISTED}, p AS (SELECT year(day) AS year, entity_id, count(*) AS n, count(DISTINCT who) AS a FROM men WHERE entity_id IS NOT NULL GROUP BY 1, 2),
 f AS (SELECT year, count(*) AS ever, count(*) FILTER (WHERE n >= 2) AS mentions_2, count(*) FILTER (WHERE n >= 5) AS mentions_5, count(*) FILTER (WHERE a >= 2) AS authors_2, count(*) FILTER (WHERE a >= 3) AS authors_3 FROM p GROUP BY 1),
 u AS (SELECT f.*, coalesce((SELECT count(DISTINCT entity_id) FROM li WHERE b <= make_date(f.year, 6, 30) AND e >= make_date(f.year, 6, 30)), 5000) AS universe FROM f)
 SELECT *, round(ever / universe, 6) AS share, CASE WHEN ever / universe > 0.5 THEN 'FAIL' WHEN ever / universe > 0.25 THEN 'MARGINAL' ELSE 'PASS' END AS verdict FROM u"""
)
def funnel_by_period(spark, d):
    m = P.confident(table(spark, d, "mentions"), 0.75)
    days = m.select(F.make_date(F.year(S.utc_date(F.col("created_utc"))), F.lit(6), F.lit(30)).alias("day")).distinct()
    size = J.universe_sizes(table(spark, d, "tickers"), days, "entity_id").select(F.year("day").alias("year"), "n_listed")
    return r6(P.funnel_by_year(m, size).withColumn("verdict", S.funnel_verdict(F.col("share"))), "share")


@query(
    f"""WITH {_MEN}, p AS (SELECT entity_id, day, count(*) AS n FROM men WHERE entity_id IS NOT NULL GROUP BY 1, 2)
 SELECT entity_id, day, CAST(sum(n) OVER w AS BIGINT) AS n_window, count(*) OVER w AS active_days FROM p WINDOW w AS (PARTITION BY entity_id ORDER BY day RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW)"""
)
def rolling_window_funnel(spark, d):
    return P.rolling_funnel(P.confident(table(spark, d, "mentions"), 0.75))


@query(
    """WITH p AS (SELECT doc_type, doc_id, entity_id, count(*) AS n, min(span_start) AS s FROM mentions WHERE entity_id IS NOT NULL GROUP BY ALL)
 SELECT doc_type, doc_id, arg_min(entity_id, (-n, s, entity_id)) AS primary_entity, count(*) AS n_entities FROM p GROUP BY 1, 2"""
)
def primary_entity(spark, d):
    return P.primary_entities(table(spark, d, "mentions"))


@query(
    f"""WITH {_DOCS}, p AS (SELECT doc_type, doc_id, count(*) AS n FROM mentions GROUP BY 1, 2)
 SELECT d.doc_type, d.removed, count(*) AS n_docs, count(*) FILTER (WHERE p.n > 0) AS n_with_mentions, CAST(sum(coalesce(p.n, 0)) AS BIGINT) AS n_mentions, round(sum(coalesce(p.n, 0)) / count(*), 6) AS mentions_per_doc
 FROM docs d LEFT JOIN p ON p.doc_type = d.doc_type AND p.doc_id = d.doc_id GROUP BY 1, 2"""
)
def removed_breakdown(spark, d):
    return r6(P.breakdown(table(spark, d, "mentions"), _docs(spark, d)), "mentions_per_doc")


@query(
    f"""WITH x AS (SELECT year({_DAY}) AS year, (retrieved_on - created_utc) / 86400.0 AS lag, coalesce(score, 0) <= 1 AS low FROM submissions WHERE retrieved_on IS NOT NULL AND created_utc IS NOT NULL),
 y AS (SELECT year, count(*) AS n, median(lag) AS median_lag, avg(lag) AS mean_lag, min(lag) AS min_lag, max(lag) AS max_lag, avg(CAST(lag < 1 AS DOUBLE)) AS share_fast, avg(CAST(low AS DOUBLE)) AS share_low_score FROM x GROUP BY GROUPING SETS ((year), ()))
 SELECT year, n, round(median_lag, 6) AS median_lag, round(mean_lag, 6) AS mean_lag, round(min_lag, 6) AS min_lag, round(max_lag, 6) AS max_lag, round(share_fast, 6) AS share_fast, round(share_low_score, 6) AS share_low_score,
 CASE WHEN median_lag < 1 OR share_fast > 0.5 THEN 'UNRELIABLE' ELSE 'usable' END AS verdict FROM y"""
)
def capture_lag(spark, d):
    return r6(Z.capture_lag(table(spark, d, "submissions")), "median_lag", "mean_lag", "min_lag", "max_lag", "share_fast", "share_low_score")


@query(
    """SELECT 'post' AS kind, count(*) AS n, count(*) FILTER (WHERE score >= 100) AS n_high FROM submissions UNION ALL SELECT 'comment', count(*), count(*) FILTER (WHERE score >= 100) FROM comments"""
)
def source_union(spark, d):
    """Posts and comments as one table, filtered and counted."""
    both = table(spark, d, "submissions").select(F.lit("post").alias("kind"), "score").unionByName(table(spark, d, "comments").select(F.lit("comment").alias("kind"), "score"))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= 100).cast("long").alias("n_high"))


# --- cohort ----------------------------------------------------------------------------------


@query(f"WITH {_MEN}, {_TREATED} SELECT *, strftime(first_mention, '%Y-%m') AS formation_month FROM treated")
def treated_cohort(spark, d):
    return _treated(spark, d)


@query(f"WITH {_MEN}, {_TREATED} SELECT *, strftime(first_mention, '%Y-%m') AS formation_month FROM treated ORDER BY n_mentions DESC, ticker LIMIT 25")
def top_treated(spark, d):
    """What a quota of 25 symbols leaves room for."""
    return C.top_names(_treated(spark, d), 25)


@query(
    f"""WITH {_MEN}, {_DOCS}, pd AS (SELECT DISTINCT name, doc_type, doc_id FROM men WHERE name IS NOT NULL AND year(day) IN (2019, 2020, 2021)),
 s AS (SELECT name, sum(coalesce(d.doc_score, 0)) AS total_score, greatest(max(coalesce(d.doc_score, 0)), 0) AS max_score FROM pd LEFT JOIN docs d ON d.doc_type = pd.doc_type AND d.doc_id = pd.doc_id GROUP BY 1),
 m AS (SELECT name, count(*) AS n_mentions, count(DISTINCT who) AS n_authors FROM men WHERE name IS NOT NULL AND year(day) IN (2019, 2020, 2021) GROUP BY 1)
 SELECT m.name AS ticker, n_mentions, n_authors, CAST(total_score AS BIGINT) AS total_score, CAST(max_score AS BIGINT) AS max_score FROM m JOIN s ON s.name = m.name"""
)
def ranking_signals(spark, d):
    return C.ranking_signals(table(spark, d, "mentions"), _docs(spark, d).select("doc_type", "doc_id", "doc_score"), symbol_key("ticker"), YEARS)


@query(f"WITH {_COHORT} SELECT ticker, grp, formation_date, CAST(n_mentions AS BIGINT) AS n_mentions, CAST(n_authors AS BIGINT) AS n_authors FROM cohort")
def matched_cohort(spark, d):
    """Treated names and controls with the same calendar."""
    return _cohort(spark, d)


@query(
    f"""WITH {_COHORT}, nt AS (SELECT greatest(1, round((SELECT count(*) FROM treated) / greatest((SELECT count(*) FROM pool), 1))) AS per),
 q AS (SELECT ticker, 1 AS part, CAST(floor(i / per) AS BIGINT) AS turn, 0 AS who, i FROM (SELECT ticker, row_number() OVER (ORDER BY n_mentions DESC, ticker) - 1 AS i FROM treated), nt
 UNION ALL SELECT ticker, 1, i, 1, i FROM (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS i FROM pool) UNION ALL SELECT ticker, 0, 0, 0, 0 FROM (SELECT ticker FROM px GROUP BY 1 ORDER BY count(*) DESC, ticker LIMIT 2)),
 o AS (SELECT ticker, min((part, turn, who, i)) AS first_at FROM q GROUP BY 1) SELECT row_number() OVER (ORDER BY first_at, ticker) AS place, ticker FROM o"""
)
def fetch_plan(spark, d):
    """Benchmarks first, then treated and controls in proportion."""
    px, t = _prices(spark, d), _treated(spark, d)
    bench = px.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ticker").limit(2)
    return C.fetch_plan(bench, t, C.control_pool(px, t)).withColumn("place", F.col("place").cast("long"))


# --- intervals and as-of ---------------------------------------------------------------------


@query(
    f"""WITH {_LISTED}, days AS (SELECT CAST(unnest(generate_series(DATE '2005-06-30', DATE '2023-06-30', INTERVAL 1 YEAR)) AS DATE) AS day)
 SELECT days.day, count(DISTINCT li.entity_id) AS n_listed FROM days LEFT JOIN li ON li.b <= days.day AND li.e >= days.day GROUP BY 1"""
)
def pit_universe_size(spark, d):
    days = spark.range(2005, 2024).select(F.make_date(F.col("id").cast("int"), F.lit(6), F.lit(30)).alias("day"))
    return J.universe_sizes(table(spark, d, "tickers"), days, "entity_id")


@query(
    f"""WITH {_LISTED}, p AS (SELECT DISTINCT entity_id, {_DAY} AS day FROM mentions WHERE entity_id IS NOT NULL)
 SELECT m.mention_no, g.was_listed FROM mentions m LEFT JOIN (SELECT p.entity_id, p.day, bool_or(li.b <= p.day AND li.e >= p.day) AS was_listed FROM p JOIN li ON li.entity_id = p.entity_id GROUP BY 1, 2) g
 ON g.entity_id = m.entity_id AND g.day = CAST(to_timestamp(m.created_utc) AT TIME ZONE 'UTC' AS DATE)"""
)
def listed_at_mention(spark, d):
    """Three-valued membership of each mention's entity at its day."""
    m = table(spark, d, "mentions").select("mention_no", "entity_id", S.utc_date(F.col("created_utc")).alias("day"))
    return J.listed_at(m, table(spark, d, "tickers"), "entity_id", "day").select("mention_no", "was_listed")


@query(
    f"""WITH {_PX}, e AS (SELECT ticker, max(date) AS last_observed FROM px GROUP BY 1) SELECT ticker, last_observed, last_observed < (SELECT max(date) FROM px) - 30 AS is_dead FROM e"""
)
def is_dead(spark, d):
    return J.dead_names(_prices(spark, d), "ticker", "date")


@query(
    f"""WITH {_MEN}, f AS (SELECT entity_id, min(day) AS date_added FROM men WHERE channel = 'cashtag' AND entity_id IS NOT NULL GROUP BY 1), p AS (SELECT panel_no, entity_id, last_day(CAST(year_month || '-01' AS DATE)) AS day FROM panel)
 SELECT p.panel_no, CASE WHEN f.entity_id IS NULL THEN false ELSE f.date_added <= p.day END AS in_index FROM p LEFT JOIN f ON f.entity_id = p.entity_id"""
)
def index_membership(spark, d):
    """Membership since a first day (here: an entity's first cashtag) as of each panel month."""
    m = P.confident(table(spark, d, "mentions"), 0.75).where("channel = 'cashtag' and entity_id is not null")
    members = m.groupBy("entity_id").agg(F.min(S.utc_date(F.col("created_utc"))).alias("date_added"))
    p = table(spark, d, "panel").select("panel_no", "entity_id", F.last_day(F.to_date(F.concat("year_month", F.lit("-01")))).alias("day"))
    return J.member_since(p, members, "entity_id", "day").select("panel_no", "in_index")


_FORM = "form AS (SELECT DISTINCT name AS ticker, day AS formation_date FROM men WHERE name IS NOT NULL)"


def _formations(spark, d):
    m = P.confident(table(spark, d, "mentions"), 0.75)
    return m.select(symbol_key("ticker").alias("ticker"), S.utc_date(F.col("created_utc")).alias("formation_date")).where("ticker is not null").distinct()


@query(
    f"""WITH {_MEN}, {_PX}, {_FORM}, b AS (SELECT f.ticker, f.formation_date, min((x.date, x.price)) AS e FROM form f JOIN px x ON x.ticker = f.ticker AND x.date BETWEEN f.formation_date AND f.formation_date + 15 GROUP BY 1, 2)
 SELECT f.ticker, f.formation_date, b.e[1] AS entry_date, round(b.e[2], 6) AS entry_price FROM form f LEFT JOIN b ON b.ticker = f.ticker AND b.formation_date = f.formation_date"""
)
def asof_forward(spark, d):
    return r6(J.asof_forward(_formations(spark, d), _prices(spark, d), "ticker", "formation_date", 15, ["price"]), "entry_price")


@query(
    f"""WITH {_MEN}, {_PX}, {_FORM} SELECT f.ticker, f.formation_date, x.date AS exit_date, round(x.price, 6) AS exit_price FROM form f ASOF LEFT JOIN px x ON x.ticker = f.ticker AND x.date <= f.formation_date"""
)
def asof_backward(spark, d):
    return r6(J.asof_backward(_formations(spark, d), _prices(spark, d), "ticker", "formation_date", ["price"]), "exit_price")


# --- outcomes and lift -----------------------------------------------------------------------


@query(f"WITH {_ANALYSIS} SELECT * REPLACE (CAST(n_mentions AS BIGINT) AS n_mentions, CAST(n_authors AS BIGINT) AS n_authors) FROM an")
def outcome_labels(spark, d):
    """The analysis table."""
    return _analysis(spark, d)


@query(f"WITH {_NAMES} SELECT pos - 1 AS i, round(e, 2) AS edge FROM (SELECT unnest(edges) AS e, generate_subscripts(edges, 1) AS pos FROM edges)")
def strata_edges(spark, d):
    a = _analysis(spark, d).where("horizon_years = 2").select("dollar_volume")
    return L.strata_edges(a).select(F.posexplode("edges").alias("i", "edge")).select(F.col("i").cast("long").alias("i"), F.round("edge", 2).alias("edge"))


@query(f"WITH {_NAMES} SELECT ticker, grp, CAST(stratum AS BIGINT) AS stratum FROM n2")
def strata_assign(spark, d):
    return _names(spark, d).select("ticker", "grp", F.col("stratum").cast("long").alias("stratum"))


@query(f"WITH {_NAMES}, {_LONG.format(src='n2')} SELECT grp, label, count(*) AS n, count(*) FILTER (WHERE hit) AS k, round(avg(CAST(hit AS DOUBLE)), 6) AS rate FROM long WHERE hit IS NOT NULL GROUP BY 1, 2")
def naive_rate(spark, d):
    return r6(L.label_rates(_names(spark, d)), "rate")


_LIFT_COLS = ("p_treated", "p_control", "p_control_adj", "unsupported", "naive_lift", "adjusted_lift")


@query(f"WITH {_NAMES}, {_LONG.format(src='n2')}, {_ADJ} {_LIFT}")
def post_stratified_lift(spark, d):
    return r6(L.lift_table(_names(spark, d)), *_LIFT_COLS)


@query(f"WITH {_NAMES}, cs AS (SELECT * FROM n2 WHERE stratum IN (SELECT stratum FROM n2 GROUP BY 1 HAVING count(DISTINCT grp) = 2)), {_LONG.format(src='cs')}, {_ADJ} {_LIFT}")
def common_support(spark, d):
    """The lift table where both groups are present."""
    return r6(L.lift_table(L.common_support(_names(spark, d))), *_LIFT_COLS)


@query(
    f"""WITH {_NAMES}, {_LONG.format(src='n2')}, r AS (SELECT grp, label, count(*) AS n, count(*) FILTER (WHERE hit) AS k FROM long WHERE hit IS NOT NULL GROUP BY 1, 2),
 w AS (SELECT *, k / n AS p, 1 + 1.96 * 1.96 / n AS dd FROM r) SELECT grp, label, n, k, round(greatest(0, (p + 1.96 * 1.96 / (2 * n)) / dd - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / dd), 6) AS lo,
 round(least(1, (p + 1.96 * 1.96 / (2 * n)) / dd + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / dd), 6) AS hi FROM w"""
)
def wilson_interval(spark, d):
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return r6(L.label_rates(_names(spark, d)).select("grp", "label", "n", "k", lo.alias("lo"), hi.alias("hi")), "lo", "hi")


@query()
def bootstrap_ci(spark, d):
    """Intervals of the adjusted lift and what they say; random draws, hence no SQL."""
    b = L.bootstrap(_names(spark, d))
    return b.withColumn("verdict", S.lift_verdict(F.col("lo"), F.col("hi")))


@query(
    f"WITH {_NAMES}, t AS (SELECT DISTINCT ticker FROM n2 WHERE grp = 'treated'), c AS ("
    + " UNION ALL ".join(f"SELECT '{x}' AS label, ticker FROM n2 WHERE {x}" for x in _LABELS)
    + " UNION ALL SELECT 'all names', ticker FROM n2) SELECT label, count(*) AS n, count(t.ticker) AS mentioned, round(count(t.ticker) / count(*), 6) AS recall FROM c LEFT JOIN t ON t.ticker = c.ticker GROUP BY 1"
)
def recall_by_class(spark, d):
    return r6(L.recall_by_class(_names(spark, d)), "recall")


def _rates(df: DataFrame) -> DataFrame:
    """Rates to six digits; the median of returns of six digits ends on a half at the seventh, so to eight."""
    return r6(df, "winner_rate", "wipeout_rate").withColumn("median_return", F.round("median_return", 8))


@query(
    f"WITH {_NAMES} SELECT CASE WHEN n_authors BETWEEN 3 AND 4 THEN '3-4' WHEN n_authors BETWEEN 5 AND 9 THEN '5-9' WHEN n_authors BETWEEN 10 AND 19 THEN '10-19' WHEN n_authors >= 20 THEN '20+' END AS bucket, {_SUMMARY} FROM n2 WHERE grp = 'treated' GROUP BY 1 HAVING bucket IS NOT NULL AND count(*) >= 5"
)
def dose_response(spark, d):
    return _rates(L.dose_response(_names(spark, d).where("grp = 'treated'")))


@query(
    f"WITH {_NAMES} SELECT CASE WHEN n_authors < 30 THEN '20-29' WHEN n_authors < 60 THEN '30-59' WHEN n_authors < 200 THEN '60-199' ELSE '200+' END AS bucket, {_SUMMARY} FROM n2 WHERE grp = 'treated' GROUP BY 1 HAVING count(*) >= 5"
)
def dose_response_fine(spark, d):
    """P16 with buckets that split this cohort."""
    return _rates(L.dose_response(_names(spark, d).where("grp = 'treated'"), ((20, 29), (30, 59), (60, 199), (200, None))))


@query(
    f"""WITH {_NAMES}, t AS (SELECT * FROM n2 WHERE grp = 'treated') SELECT round(avg(forward_return), 6) AS equal_weighted, round(sum(forward_return * n_authors) / nullif(sum(n_authors), 0), 6) AS author_weighted, round(avg(benchmark_return), 6) AS benchmark,
 round(avg(forward_return) - avg(benchmark_return), 6) AS excess FROM t"""
)
def portfolio_weighted(spark, d):
    return r6(L.portfolio(_names(spark, d).where("grp = 'treated'")), "equal_weighted", "author_weighted", "benchmark", "excess")


_CUT = "(SELECT list(dollar_volume ORDER BY dollar_volume DESC)[1 + CAST(floor(count(*) * {q}) AS BIGINT)] FROM n2 WHERE dollar_volume > 0{w})"


@query(f"WITH {_NAMES} SELECT round(avg(CAST(coalesce(dollar_volume, 0) >= {_CUT.format(q=0.2, w='')} AS DOUBLE)), 6) AS share_top_quintile, round(avg(CAST(coalesce(dollar_volume, 0) >= {_CUT.format(q=0.5, w='')} AS DOUBLE)), 6) AS share_above_median FROM n2 WHERE grp = 'treated'")
def novelty_shares(spark, d):
    return r6(L.novelty(_names(spark, d)), "share_top_quintile", "share_above_median")


_MEMBERS = f"mem AS (SELECT {symbol_key_sql('ticker')} AS ticker, min(listed_from) AS a FROM tickers WHERE exchange = 'NORTHX' AND ticker IS NOT NULL GROUP BY 1)"


@query(
    f"""WITH {_NAMES}, {_MEMBERS}, x AS (SELECT CASE WHEN mem.ticker IS NULL THEN false WHEN mem.a IS NOT NULL THEN mem.a <= n2.formation_date END AS i FROM n2 LEFT JOIN mem ON mem.ticker = n2.ticker WHERE grp = 'treated')
 SELECT round(coalesce(avg(CAST(coalesce(i, false) AS DOUBLE)), 0), 6) AS confirmed_in, round(coalesce(avg(CAST(NOT coalesce(i, false) AS DOUBLE)), 0), 6) AS novelty_upper_bound, round(coalesce(avg(CAST(i IS NULL AS DOUBLE)), 0), 6) AS membership_unknown FROM x"""
)
def novelty_in_index(spark, d):
    """Treated names that were in an index at formation (stand-in members: one exchange's listings)."""
    t = table(spark, d, "tickers").where("exchange = 'NORTHX' and ticker is not null").select(symbol_key("ticker").alias("ticker"), F.col("listed_from").alias("date_added"))
    return r6(L.index_shares(_names(spark, d), t), "confirmed_in", "novelty_upper_bound", "membership_unknown")


_CONTROL = " AND grp = 'control'"


@query(
    f"""WITH {_NAMES}, sc AS (SELECT * FROM n2 WHERE grp = 'control' AND coalesce(dollar_volume, 0) >= {_CUT.format(q=0.2, w=_CONTROL)}), {_LONG.format(src='n2')},
 t AS (SELECT label, avg(CAST(hit AS DOUBLE)) AS p FROM long WHERE grp = 'treated' AND hit IS NOT NULL GROUP BY 1), s AS (SELECT label, avg(CAST(hit AS DOUBLE)) AS p FROM long WHERE grp = 'control' AND hit IS NOT NULL AND ticker IN (SELECT ticker FROM sc) GROUP BY 1)
 SELECT t.label, round(t.p, 6) AS p_treated, round(s.p, 6) AS p_screen, round(t.p / nullif(s.p, 0), 6) AS ratio FROM t JOIN s ON s.label = t.label WHERE (SELECT count(*) FROM sc) >= 2"""
)
def trivial_screen(spark, d):
    """P19; the cohort of these tables has few controls, so two of them make a screen."""
    return r6(L.trivial_screen(_names(spark, d), 2), "p_treated", "p_screen", "ratio")


@query(
    f"""WITH {_NAMES}, r AS (SELECT *, row_number() OVER (ORDER BY n_authors DESC, ticker) AS r FROM n2 WHERE grp = 'treated'),
 b AS (SELECT 'top 10' AS bucket, * FROM r WHERE r <= 10 UNION ALL SELECT 'top 25', * FROM r WHERE r <= 25 UNION ALL SELECT 'top 50', * FROM r WHERE r <= 50 UNION ALL SELECT 'rest', * FROM r WHERE r > 50) SELECT bucket, {_SUMMARY} FROM b GROUP BY 1 HAVING count(*) >= 5"""
)
def rank_buckets(spark, d):
    return _rates(L.rank_buckets(_names(spark, d).where("grp = 'treated'"), "n_authors"))


#: Names that a signal must have; the cohort of these tables is small.
LEAST_RANKED, LEAST_EVENTS = 10, 1


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    s = ranking_signals(spark, d).select("ticker", "total_score", "max_score")
    return written(_names(spark, d).join(s, "ticker", "left"), "ranked-names")


_SIGNAL = f"""sig AS (SELECT name AS ticker, sum(coalesce(d.doc_score, 0)) AS total_score, greatest(max(coalesce(d.doc_score, 0)), 0) AS max_score FROM (SELECT DISTINCT name, doc_type, doc_id FROM men WHERE name IS NOT NULL AND year(day) IN (2019, 2020, 2021)) pd
 LEFT JOIN docs d ON d.doc_type = pd.doc_type AND d.doc_id = pd.doc_id GROUP BY 1)"""


@query(
    f"""WITH {_DOCS}, {_NAMES}, {_SIGNAL}, t0 AS (SELECT n2.*, sig.total_score, sig.max_score FROM n2 LEFT JOIN sig ON sig.ticker = n2.ticker WHERE grp = 'treated'),
 lo AS ({" UNION ALL ".join(f"SELECT '{x}' AS signal, CAST({x} AS DOUBLE) AS v, * FROM t0 WHERE {x} IS NOT NULL" for x in L.SIGNALS)}),
 rk AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY v DESC, ticker) AS r, count(*) OVER (PARTITION BY signal) AS names FROM lo),
 bk AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY signal, bucket) AS held FROM ({" UNION ALL ".join(f"SELECT '{n}' AS bucket, * FROM rk WHERE names >= {LEAST_RANKED} AND {c}" for n, c in (('top 10', 'r <= 10'), ('top 25', 'r <= 25'), ('top 50', 'r <= 50'), ('rest', 'r > 50')))})) WHERE held >= 5),
 ct AS (SELECT * FROM n2 WHERE grp = 'control'), rp AS (SELECT signal, bucket, grp, dollar_volume, winner_3x, wipeout FROM bk UNION ALL SELECT b.signal, b.bucket, ct.grp, ct.dollar_volume, ct.winner_3x, ct.wipeout FROM ct, (SELECT DISTINCT signal, bucket FROM bk) b),
 ed AS (SELECT signal, bucket, CASE WHEN len(v) >= 5 THEN [v[1 + len(v) * 1 // 5], v[1 + len(v) * 2 // 5], v[1 + len(v) * 3 // 5], v[1 + len(v) * 4 // 5]] ELSE [] END AS edges FROM (SELECT signal, bucket, coalesce(list(dollar_volume ORDER BY dollar_volume) FILTER (WHERE dollar_volume > 0), []) AS v FROM rp GROUP BY 1, 2)),
 st AS (SELECT rp.signal, rp.bucket, grp, winner_3x, wipeout, CASE WHEN dollar_volume > 0 THEN len(list_filter(list_distinct(edges), lambda e: dollar_volume >= e)) ELSE 0 END AS stratum FROM rp JOIN ed ON ed.signal = rp.signal AND ed.bucket = rp.bucket),
 ce AS (SELECT signal, bucket, grp, stratum, count(*) AS n, count(*) FILTER (WHERE winner_3x) AS kw, count(*) FILTER (WHERE wipeout) AS kk FROM st GROUP BY ALL),
 aj AS (SELECT t.signal, t.bucket, sum(CASE WHEN c.n IS NOT NULL THEN t.n * c.kw / c.n END) / sum(CASE WHEN c.n IS NOT NULL THEN t.n END) AS pw, sum(CASE WHEN c.n IS NOT NULL THEN t.n * c.kk / c.n END) / sum(CASE WHEN c.n IS NOT NULL THEN t.n END) AS pk,
 coalesce(sum(CASE WHEN c.n IS NULL THEN t.n END), 0) / sum(t.n) AS unsupported, CAST(coalesce(sum(c.kw), 0) AS BIGINT) AS events FROM ce t LEFT JOIN ce c ON c.signal = t.signal AND c.bucket = t.bucket AND c.stratum = t.stratum AND c.grp = 'control' WHERE t.grp = 'treated' GROUP BY 1, 2),
 su AS (SELECT signal, bucket, count(*) AS n, avg(CAST(coalesce(winner_3x, false) AS DOUBLE)) AS w, avg(CAST(coalesce(wipeout, false) AS DOUBLE)) AS k, median(forward_return) AS m FROM bk GROUP BY 1, 2)
 SELECT su.signal, su.bucket, su.n, round(w, 6) AS winner_rate, round(k, 6) AS wipeout_rate, round(m, 8) AS median_return, round(m - (SELECT median(forward_return) FROM ct), 8) AS excess_vs_control, round(unsupported, 6) AS unsupported, events AS n_control_events,
 events >= {LEAST_EVENTS} AND coalesce(pw, 0) > 0 AS stable, CASE WHEN events >= {LEAST_EVENTS} AND coalesce(pw, 0) > 0 THEN round(w / pw, 6) END AS winner_lift, round(k / nullif(pk, 0), 6) AS wipeout_lift, unsupported > 0.2 AS off_support FROM su JOIN aj ON aj.signal = su.signal AND aj.bucket = su.bucket"""
)
def rank_analysis(spark, d):
    """Four signals, size-adjusted lifts, thin cells suppressed."""
    got = L.rank_analysis(_ranked(spark, d), least_names=LEAST_RANKED, least_events=LEAST_EVENTS)
    return r6(got, "winner_rate", "wipeout_rate", "unsupported", "winner_lift", "wipeout_lift").withColumns({c: F.round(c, 8) for c in ("median_return", "excess_vs_control")})


@query()
def rank_intervals(spark, d):
    """Intervals of the stable winner lifts; random draws, hence no SQL."""
    return L.rank_intervals(_ranked(spark, d), least_names=LEAST_RANKED, least_events=LEAST_EVENTS)


@query(f"WITH {_NAMES}, e AS (SELECT count(*) AS n FROM n2 WHERE grp = 'control' AND coalesce(wipeout, false) AND stratum IN (SELECT stratum FROM n2 WHERE grp = 'treated')) SELECT n AS n_events, n >= 5 AS stable FROM e")
def matched_events(spark, d):
    return L.matched_events(L.cells(_names(spark, d)), "wipeout")


@query(
    f"""WITH {_NAMES}, b AS (SELECT * FROM (SELECT 'all' AS scope, * FROM n2 ORDER BY dollar_volume DESC NULLS LAST, ticker LIMIT 25) UNION ALL SELECT * FROM (SELECT 'not_mentioned' AS scope, * FROM n2 WHERE grp = 'control' ORDER BY dollar_volume DESC NULLS LAST, ticker LIMIT 25))
 SELECT scope, {_SUMMARY} FROM b GROUP BY 1"""
)
def largest_names(spark, d):
    return _rates(L.largest(_names(spark, d), 25))


@query(
    f"""WITH {_NAMES} SELECT ticker, CASE grp WHEN 'treated' THEN 'mentioned' ELSE 'not_mentioned' END AS grp, row_number() OVER (ORDER BY dollar_volume DESC, ticker) AS size_rank_in_sample, CASE WHEN grp = 'treated' THEN row_number() OVER (PARTITION BY grp ORDER BY n_authors DESC, ticker) END AS rank_by_authors,
 round(100 * forward_return, 1) AS forward_return_pct, CAST(floor(dollar_volume) AS BIGINT) AS dollar_volume_at_entry FROM n2"""
)
def companies_export(spark, d):
    """The ranked export table."""
    from pyspark.sql import Window as W

    n = _names(spark, d)
    t = F.col("grp") == "treated"
    return n.select(
        "ticker", F.when(t, "mentioned").otherwise("not_mentioned").alias("grp"), F.row_number().over(W.orderBy(F.desc("dollar_volume"), "ticker")).cast("long").alias("size_rank_in_sample"),
        F.when(t, F.row_number().over(W.partitionBy("grp").orderBy(F.desc("n_authors"), "ticker"))).cast("long").alias("rank_by_authors"), F.round(100 * F.col("forward_return"), 1).alias("forward_return_pct"),
        F.floor("dollar_volume").alias("dollar_volume_at_entry"),
    )


@query(f"WITH {_NAMES} SELECT grp, count(*) AS n, round(median(forward_return), 8) AS median_return, round(avg(CAST(survived_full_horizon AS DOUBLE)), 6) AS survived_share FROM n2 GROUP BY 1")
def group_outcomes(spark, d):
    """Median return and survival of both groups."""
    return r6(L.group_outcomes(_names(spark, d)), "survived_share").withColumn("median_return", F.round("median_return", 8))


@query(
    f"""WITH {_NAMES}, s AS (SELECT stratum, count(*) FILTER (WHERE grp = 'treated') AS t, count(*) FILTER (WHERE grp = 'control') AS c FROM n2 GROUP BY 1), x AS (SELECT sum(CASE WHEN c = 0 THEN t ELSE 0 END) / sum(t) AS share, count(*) FILTER (WHERE t > 0 AND c > 0) AS k FROM s)
 SELECT round(share, 6) AS trimmed_share, k AS n_strata, coalesce(round(share, 6) > 0.01, false) AS shown FROM x"""
)
def trimmed_support(spark, d):
    """Whether the table on common support is shown."""
    return r6(L.trimmed_support(_names(spark, d)), "trimmed_share")


@query(
    f"""WITH {_NAMES}, e AS (SELECT {symbol_key_sql('ticker')} AS ticker, min(exchange) AS exchange FROM tickers WHERE ticker IS NOT NULL GROUP BY 1), x AS (SELECT n2.grp, coalesce(e.exchange, 'unknown') AS exchange, count(*) AS n FROM n2 LEFT JOIN e ON e.ticker = n2.ticker GROUP BY 1, 2)
 SELECT grp, exchange, n, round(n / sum(n) OVER (PARTITION BY grp), 6) AS share FROM x"""
)
def exchange_mix(spark, d):
    """Treated names against controls by a classification (here the exchange; the tables have no industry codes of names)."""
    e = table(spark, d, "tickers").where("ticker is not null").groupBy(symbol_key("ticker").alias("ticker")).agg(F.min("exchange").alias("exchange"))
    return r6(L.mix(_names(spark, d).join(e, "ticker", "left"), "exchange"), "share")


@query(
    f"""WITH {_DOCS}, {_ANALYSIS}, {_SIGNAL}, a AS (SELECT an.*, sig.total_score, sig.max_score FROM an LEFT JOIN sig ON sig.ticker = an.ticker AND an.grp = 'treated')
 SELECT ticker, CASE grp WHEN 'treated' THEN 'mentioned' ELSE 'not_mentioned' END AS grp, horizon_years, CAST(n_mentions AS BIGINT) AS n_mentions, CAST(n_authors AS BIGINT) AS n_authors, CAST(coalesce(total_score, 0) AS BIGINT) AS total_upvotes, CAST(coalesce(max_score, 0) AS BIGINT) AS best_post_upvotes,
 CASE WHEN grp = 'treated' THEN row_number() OVER (PARTITION BY horizon_years, grp ORDER BY n_authors DESC NULLS LAST, ticker) END AS rank_by_authors, CASE WHEN grp = 'treated' THEN row_number() OVER (PARTITION BY horizon_years, grp ORDER BY total_score DESC NULLS LAST, ticker) END AS rank_by_upvotes,
 entry_date, round(entry_price, 4) AS entry_price, exit_date, round(exit_price, 4) AS exit_price, round(100 * forward_return, 1) AS forward_return_pct, round(100 * benchmark_return, 1) AS benchmark_return_pct, round(100 * excess_return, 1) AS excess_pct,
 CAST(winner_3x AS INTEGER) AS tripled, CAST(outperformer AS INTEGER) AS beat_benchmark, CAST(wipeout AS INTEGER) AS lost_70pct, CAST(survived_full_horizon AS INTEGER) AS survived_full_horizon, CAST(floor(dollar_volume) AS BIGINT) AS dollar_volume_at_entry,
 row_number() OVER (PARTITION BY horizon_years ORDER BY dollar_volume DESC NULLS LAST, ticker) AS size_rank_in_sample FROM a"""
)
def companies_table(spark, d):
    """The full export, both horizons, with upvotes."""
    a = _analysis(spark, d)
    s = ranking_signals(spark, d).select(F.lit("treated").alias("grp"), "ticker", "total_score", "max_score")
    return L.companies(a.join(s, ["grp", "ticker"], "left"))


# --- series ----------------------------------------------------------------------------------

_MONTHS = "me AS (SELECT ticker, strftime(date, '%Y-%m') AS month, arg_max(price, date) AS p FROM px GROUP BY 1, 2), mr AS (SELECT ticker, month, p / nullif(lag(p) OVER (PARTITION BY ticker ORDER BY month), 0) - 1 AS month_return FROM me)"


@query(f"WITH {_PX}, {_MONTHS} SELECT ticker, month, round(month_return, 6) AS month_return FROM mr WHERE month_return IS NOT NULL")
def month_end_returns(spark, d):
    return r6(Z.month_end_returns(_prices(spark, d)), "month_return")


_TIMING = f"""{_ANALYSIS}, r AS (SELECT ticker, entry_date, exit_date FROM an WHERE horizon_years = 2 AND grp = 'treated'),
 w AS (SELECT r.*, x.date, x.price FROM r JOIN px x ON x.ticker = r.ticker AND x.date BETWEEN r.entry_date - 365 AND r.exit_date),
 pk AS (SELECT ticker, entry_date, count(*) AS n, min(date) AS s, arg_min(date, (-price, date)) AS peak_date, max(price) AS peak FROM w GROUP BY 1, 2),
 tr AS (SELECT w.ticker, w.entry_date, pk.peak_date, pk.peak, min((w.price, w.date)) AS t FROM w JOIN pk ON pk.ticker = w.ticker AND pk.entry_date = w.entry_date AND w.date <= pk.peak_date WHERE pk.n >= 60 AND pk.peak_date > pk.s GROUP BY ALL),
 tm AS (SELECT ticker, peak_date, t[2] AS trough_date, peak / t[1] - 1 AS gain, CAST(entry_date - t[2] AS BIGINT) AS lag_days FROM tr WHERE peak / t[1] - 1 >= 0.5)"""


@query(f"WITH {_TIMING} SELECT ticker, peak_date, trough_date, round(gain, 6) AS gain, lag_days FROM tm")
def peak_trough_timing(spark, d):
    a = _analysis(spark, d).where("horizon_years = 2 and grp = 'treated'")
    return r6(Z.move_timing(a, _prices(spark, d)).withColumn("lag_days", F.col("lag_days").cast("long")), "gain")


@query(f"WITH {_TIMING} SELECT count(*) AS n, round(avg(CAST(lag_days > 0 AS DOUBLE)), 6) AS share_after, median(lag_days) AS median_lag_days FROM tm HAVING count(*) >= 3")
def timing_summary(spark, d):
    a = _analysis(spark, d).where("horizon_years = 2 and grp = 'treated'")
    return r6(Z.timing_summary(Z.move_timing(a, _prices(spark, d)), 3), "share_after")


_GRAM = ["l_quantity", "l_discount", "l_tax"]


@query("SELECT " + ", ".join(f"round(sum({a} * {b}) / count(*), 4) AS {n}" for n, a, b in (("yy", "l_extendedprice", "l_extendedprice"), ("y", "l_extendedprice", "1"), ("xy", "l_extendedprice", "l_quantity"), ("xx", "l_quantity", "l_quantity"))) + " FROM lineitem")
def ols_gram(spark, d):
    g = Z.gram(table(spark, d, "lineitem"), "l_extendedprice", _GRAM)
    at = lambda a: F.round(F.col(a) / F.col("one__one"), 4)
    return g.select(at("l_extendedprice__l_extendedprice").alias("yy"), at("one__l_extendedprice").alias("y"), at("l_quantity__l_extendedprice").alias("xy"), at("l_quantity__l_quantity").alias("xx"))


@query(
    """SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS beta FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem"""
)
def ols_single(spark, d):
    return Z.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"]).select("term", F.round("beta", 4).alias("beta"))


@query()
def ols_betas(spark, d):
    return Z.ols(table(spark, d, "lineitem"), "l_extendedprice", _GRAM)


@query()
def factor_alpha(spark, d):
    """P20, M1: the cohort's monthly returns on a market and a size factor made of the prices themselves."""
    px = _prices(spark, d)
    ret = Z.month_end_returns(px)
    market = ret.groupBy("month").agg(F.avg("month_return").alias("mkt"), F.median("month_return").alias("mid"))
    factors = market.select("month", "mkt", (F.col("mkt") - F.col("mid")).alias("spread"), F.lit(0.0).alias("rf"))
    held = ret.join(_treated(spark, d).select("ticker"), "ticker", "left_semi")
    return Z.factor_alpha(held, factors, ["mkt", "spread"])


@query("""WITH t AS (SELECT o_custkey, sum(o_totalprice) AS y FROM orders GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) AS a, row_number() OVER (ORDER BY round(y, 2), c_custkey) AS b FROM customer JOIN t ON o_custkey = c_custkey) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r""")
def spearman_ordinal(spark, d):
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("y"))
    return r6(Z.spearman_ordinal(table(spark, d, "customer").join(t, F.col("o_custkey") == F.col("c_custkey")), "c_acctbal", "y", "c_custkey"), "rho")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_per_key(spark, d):
    return O.first_per_name(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate")


@query(
    "SELECT CASE "
    + " ".join(f"WHEN p_size * 190 BETWEEN {a} AND {z} THEN '{n}'" for a, z, n in S.DIVISIONS)
    + " ELSE 'unknown' END AS division, p_brand, count(*) AS n FROM part GROUP BY 1, 2"
)
def sector_mix(spark, d):
    p = table(spark, d, "part").withColumn("division", S.division((F.col("p_size") * 190).cast("string")))
    return p.groupBy("division", "p_brand").agg(F.count(F.lit(1)).alias("n"))


# --- text ------------------------------------------------------------------------------------


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Posts and comments as documents, one row per delivery."""
    p, c = table(spark, d, "submissions"), table(spark, d, "comments")
    none = F.lit(None).cast("string")
    a = p.select(F.lit("post").alias("doc_type"), "ingest_no", message_key("id").alias("doc_id"), "created_utc", "author", none.alias("link_id"), "score", "title", T.document_text(F.lit("post"), F.col("title"), F.col("selftext"), none).alias("text"))
    b = c.select(F.lit("comment").alias("doc_type"), "ingest_no", message_key("id").alias("doc_id"), "created_utc", "author", "link_id", "score", none.alias("title"), T.document_text(F.lit("comment"), none, none, F.col("body")).alias("text"))
    return a.unionByName(b)


_TEXT = "tx AS (SELECT 'post' AS doc_type, ingest_no, coalesce(title, '') || chr(10) || coalesce(selftext, '') AS text FROM submissions UNION ALL SELECT 'comment', ingest_no, coalesce(body, '') FROM comments)"


@query(f"WITH {_TEXT} SELECT doc_type, ingest_no, md5({T.clean_text_sql('text')}) AS digest FROM tx")
def clean_text(spark, d):
    return _texts(spark, d).select("doc_type", "ingest_no", F.md5(T.clean_text(F.col("text"))).alias("digest"))


@query(f"WITH {_TEXT}, x AS (SELECT unnest(regexp_extract_all({T.clean_text_sql('text')}, '\\$([A-Z]{{1,5}}(?:\\.[A-Z])?)\\b', 1)) AS s FROM tx) SELECT replace(s, '.', '-') AS symbol, count(*) AS n FROM x GROUP BY 1")
def cashtag_counts(spark, d):
    return _texts(spark, d).select(F.explode(T.cashtags(T.clean_text(F.col("text")))).alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query()
def extracted_mentions(spark, d):
    """Mentions of all delivered texts; order-dependent scan, hence no SQL."""
    docs = _texts(spark, d).withColumn("doc_id", F.concat_ws("#", "doc_id", F.col("ingest_no").cast("string")))
    return X.extract_mentions(docs, X.lexicon(table(spark, d, "tickers"), table(spark, d, "word_rank"), MANUAL_NAMES))


#: Names that need no proof by length: brands of four letters, and what companies are called besides.
MANUAL_NAMES = frozenset("nike ford ebay meta visa ibm amd ge 3m coke intel jnj".split())


_NAME_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9& ]', ' ', 'g'), '\\b(?:" + "|".join(T.NAME_SUFFIXES) + ")\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
)


@query(
    f"""WITH {_TEXT}, nm AS (SELECT DISTINCT {_NAME_SQL} AS name FROM tickers WHERE name IS NOT NULL), w AS (SELECT doc_type || ingest_no AS doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9&]+'), lambda x: x <> '') AS w FROM tx),
 g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS name FROM w)
 SELECT doc_id, g.name, count(*) AS n FROM g JOIN nm ON nm.name = g.name WHERE g.name <> '' GROUP BY 1, 2"""
)
def ngram_lookup(spark, d):
    """J4 as a join: names of up to four words in all texts."""
    docs = _texts(spark, d).select(F.concat("doc_type", F.col("ingest_no").cast("string")).alias("doc_id"), "text")
    names = table(spark, d, "tickers").where("name is not null").select(T.normalise_name(F.col("name")).alias("name")).where("name <> ''")
    return X.ngram_matches(docs, names, "doc_id", "text", 4)


@query(
    f"""WITH {_TEXT}, nm AS (SELECT DISTINCT {_NAME_SQL} AS name FROM tickers WHERE name IS NOT NULL), n1 AS (SELECT DISTINCT unnest(string_split(name, ' ')) AS name FROM nm UNION SELECT lower(word) FROM word_rank WHERE word IS NOT NULL), ok AS (SELECT name FROM n1 WHERE regexp_full_match(name, '[a-z]+') AND length(name) >= 7),
 w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z0-9&]+')) AS word FROM tx) SELECT w.word, ok.name FROM w JOIN ok ON left(w.word, 2) = left(ok.name, 2) AND abs(length(w.word) - length(ok.name)) <= 1 AND levenshtein(w.word, ok.name) <= 1
 WHERE length(w.word) >= 7 AND regexp_full_match(w.word, '[a-z]+') AND w.word NOT IN (SELECT name FROM n1)"""
)
def fuzzy_match(spark, d):
    """Words of all texts within one edit of a word of a name or of the ranked words."""
    words = _texts(spark, d).select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9&]+"))).alias("word"))
    names = table(spark, d, "tickers").where("name is not null").select(F.explode(F.split(T.normalise_name(F.col("name")), " ")).alias("name"))
    names = names.unionByName(table(spark, d, "word_rank").where("word is not null").select(F.lower("word").alias("name")))
    return X.near_matches(words, names)


_JARGON = ", ".join(f"'{x}'" for x in X.JARGON)


@query(
    f"""WITH t AS (SELECT DISTINCT upper(ticker) AS token FROM tickers WHERE ticker IS NOT NULL UNION SELECT upper(word) FROM word_rank WHERE word IS NOT NULL)
 SELECT token, CASE WHEN length(token) = 1 OR token IN ({_JARGON}) THEN 'JARGON' WHEN r.rank_no <= 20000 THEN 'COMMON' ELSE 'CLEAR' END AS tier FROM t LEFT JOIN word_rank r ON r.word = lower(token)"""
)
def tier_classify(spark, d):
    w = table(spark, d, "word_rank")
    t = table(spark, d, "tickers").where("ticker is not null").select(F.upper("ticker").alias("token")).union(w.where("word is not null").select(F.upper("word"))).distinct()
    return t.join(w, F.lower("token") == w["word"], "left").select("token", T.evidence_tier(F.col("token"), X.JARGON, F.col("rank_no"), X.COMMON_RANK).alias("tier"))


@query(f"SELECT listing_no, {_NAME_SQL} AS alias FROM tickers")
def alias_normalise(spark, d):
    return table(spark, d, "tickers").select("listing_no", T.normalise_name(F.col("name")).alias("alias"))


def _count_sql(phrases: tuple[str, ...]) -> str:
    return " + ".join(f"(length(t) - length(replace(t, '{p}', ''))) // {len(p)}" for p in phrases)


@query(
    f"""WITH {_TEXT}, l AS (SELECT doc_type, ingest_no, lower(text) AS t FROM tx), c AS (SELECT doc_type, ingest_no, {_count_sql(T.BULLISH)} AS b, {_count_sql(T.BEARISH)} AS r, {_count_sql(T.QUESTION)} AS q FROM l),
 s AS (SELECT doc_type, ingest_no, CASE WHEN q > 0 AND q >= greatest(b, r) THEN 'question' WHEN b > r THEN 'bullish' WHEN r > b THEN 'bearish' ELSE 'neutral' END AS stance FROM c)
 SELECT doc_type, ingest_no, stance, CASE WHEN stance = 'neutral' THEN 0.30 ELSE 0.35 END::DOUBLE AS stance_confidence FROM s"""
)
def stance_baseline(spark, d):
    return _texts(spark, d).select("doc_type", "ingest_no", T.lexical_stance(F.col("text")).alias("s")).select("doc_type", "ingest_no", "s.*")


_BODIES = f"""b AS (SELECT 'post' AS doc_type, {message_key_sql('id')} AS doc_id, coalesce(title, '') || chr(10) || coalesce(selftext, '') AS t FROM ({_ONCE.format(k=message_key_sql('id'), t='submissions')})
 UNION ALL SELECT 'comment', {message_key_sql('id')}, coalesce(body, '') FROM ({_ONCE.format(k=message_key_sql('id'), t='comments')}))"""


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """``doc_type, doc_id, text`` of posts and comments, each message once."""
    none = F.lit(None).cast("string")
    p, c = (deliver_once(table(spark, d, t)) for t in ("submissions", "comments"))
    a = p.select(F.lit("post").alias("doc_type"), message_key("id").alias("doc_id"), T.document_text(F.lit("post"), F.col("title"), F.col("selftext"), none).alias("text"))
    return a.unionByName(c.select(F.lit("comment").alias("doc_type"), message_key("id").alias("doc_id"), T.document_text(F.lit("comment"), none, none, F.col("body")).alias("text")))


@query(
    f"""WITH {_BODIES}, m AS (SELECT m.mention_no, b.t, m.span_start AS s, m.span_end AS e FROM mentions m JOIN b ON b.doc_type = m.doc_type AND b.doc_id = m.doc_id WHERE m.span_end <= length(b.t))
 SELECT mention_no, md5((CASE WHEN s > 40 THEN '…' ELSE '' END) || substring(t, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0)) || '«' || substring(t, s + 1, e - s) || '»' || substring(t, e + 1, least(e + 40, length(t)) - e) || (CASE WHEN e + 40 < length(t) THEN '…' ELSE '' END)) AS marked FROM m"""
)
def mark_spans(spark, d):
    """Mentions marked in their messages, 40 characters around."""
    m = table(spark, d, "mentions").select("mention_no", "doc_type", "doc_id", "span_start", "span_end")
    j = m.join(_bodies(spark, d), ["doc_type", "doc_id"]).where(F.col("span_end") <= F.length("text"))
    return j.select("mention_no", F.md5(T.mark_span(F.col("text"), F.col("span_start"), F.col("span_end"), 40)).alias("marked"))


_STANCE = f"""st AS (SELECT doc_type, doc_id, CASE WHEN q > 0 AND q >= greatest(b, r) THEN 'question' WHEN b > r THEN 'bullish' WHEN r > b THEN 'bearish' ELSE 'neutral' END AS stance
 FROM (SELECT doc_type, doc_id, {_count_sql(T.BULLISH)} AS b, {_count_sql(T.BEARISH)} AS r, {_count_sql(T.QUESTION)} AS q FROM (SELECT doc_type, doc_id, lower(t) AS t FROM b)))"""


@query(
    f"""WITH {_BODIES}, {_STANCE}, {_MEN} SELECT m.entity_id, m.year_month, count(*) AS n_mentions, count(*) FILTER (WHERE stance = 'bullish') AS n_bullish, count(*) FILTER (WHERE stance = 'bearish') AS n_bearish, count(*) FILTER (WHERE stance = 'neutral') AS n_neutral,
 count(*) FILTER (WHERE stance = 'question') AS n_question FROM men m LEFT JOIN st ON st.doc_type = m.doc_type AND st.doc_id = m.doc_id WHERE entity_id IS NOT NULL GROUP BY 1, 2"""
)
def stance_panel(spark, d):
    """The panel with the stance of each mention's message (the lexical floor)."""
    st = _bodies(spark, d).where("doc_id is not null").select("doc_type", "doc_id", T.lexical_stance(F.col("text"))["stance"].alias("stance"))
    return P.mention_panel(table(spark, d, "mentions"), _docs(spark, d), stance=st).select("entity_id", "year_month", "n_mentions", "n_bullish", "n_bearish", "n_neutral", "n_question")


# --- review, quotas, gates, sets -------------------------------------------------------------

_LABEL = f"""gold AS (SELECT item_id, trim(unnest(string_split(gold_tickers, ','))) AS ticker FROM eval_items WHERE gold_tickers IS NOT NULL), sy AS (SELECT DISTINCT {symbol_key_sql('ticker')} AS ticker FROM tickers),
 pred AS (SELECT DISTINCT item_id, w AS ticker FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[^A-Za-z.]+')) AS w FROM eval_items) JOIN sy ON sy.ticker = w),
 p AS (SELECT * FROM pred WHERE item_id IN (SELECT item_id FROM gold)), g AS (SELECT DISTINCT * FROM gold), c AS (SELECT coalesce(g.item_id, p.item_id) AS item_id, CASE WHEN g.item_id IS NOT NULL AND p.item_id IS NOT NULL THEN 'tp' WHEN p.item_id IS NOT NULL THEN 'fp' ELSE 'fn' END AS outcome FROM g FULL JOIN p ON p.item_id = g.item_id AND p.ticker = g.ticker)"""


def _compared(spark, d):
    e = table(spark, d, "eval_items")
    gold = e.where("gold_tickers is not null").select("item_id", F.explode(F.split("gold_tickers", ",")).alias("ticker")).select("item_id", F.trim("ticker").alias("ticker"))
    sy = table(spark, d, "tickers").select(symbol_key("ticker").alias("ticker")).distinct()
    pred = e.select("item_id", F.explode(F.split("text", "[^A-Za-z.]+")).alias("ticker")).join(sy, "ticker", "left_semi")
    return R.compare(gold, pred.select("item_id", "ticker"), ["item_id", "ticker"])


@query(
    f"""WITH {_LABEL}, n AS (SELECT count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'fn') AS fn FROM c), q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM n)
 SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, p >= 0.9 AND r >= 0.8 AS passes FROM q"""
)
def precision_recall(spark, d):
    """Symbols found as words of evaluation items against their gold tickers."""
    return r6(R.extraction_gate(R.precision_recall(_compared(spark, d))), "precision", "recall", "f1")


@query(
    f"""WITH {_TEXT}, p AS (SELECT ingest_no, year({_DAY}) AS year FROM submissions WHERE length(trim(coalesce(title, '') || chr(10) || coalesce(selftext, ''), ' ' || chr(9) || chr(10) || chr(13))) >= 40), c AS (SELECT year, count(*) AS n FROM p GROUP BY 1),
 q AS (SELECT p.*, row_number() OVER (PARTITION BY p.year ORDER BY md5('{SEED}|' || ingest_no), ingest_no) AS r, greatest(greatest(5, floor(120 / ((SELECT count(*) FROM c) * 3))), round(120 * c.n / (SELECT count(*) FROM p))) AS quota FROM p JOIN c ON c.year = p.year)
 SELECT ingest_no, year FROM q WHERE r <= quota ORDER BY md5('{SEED}|' || ingest_no), ingest_no LIMIT 120"""
)
def stratified_sample(spark, d):
    """A label sample of 120 posts, every year represented."""
    p = table(spark, d, "submissions")
    text = F.trim(F.regexp_replace(T.document_text(F.lit("post"), F.col("title"), F.col("selftext"), F.lit(None)), r"^\s+|\s+$", ""))
    rows = p.where(F.length(text) >= 40).select("ingest_no", F.year(S.utc_date(F.col("created_utc"))).alias("year"))
    return R.stratified_sample(rows, "year", "ingest_no", 120, SEED)


@query(f"SELECT ingest_no FROM submissions ORDER BY md5('{SEED}|' || ingest_no), ingest_no LIMIT 50")
def random_sample(spark, d):
    """R2: 50 posts drawn without replacement."""
    return C.draw(table(spark, d, "submissions").select("ingest_no"), 50, SEED, "ingest_no")


@query(
    """WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) <= 3 AND count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) <= 5 AS admissible FROM e"""
)
def quota_admission(spark, d):
    """Calls within 3 an hour and 5 a day per user."""
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts")).alias("t"))
    return R.admissible(e, {3600: 3, 86400: 5}, "user_id", "t").select("event_id", "admissible")


@query(
    f"""WITH f AS (SELECT strftime({_DAY}, '%Y-%m') AS period, {symbol_key_sql('ticker')} AS symbol, min(created_utc) AS f FROM mentions WHERE ticker IS NOT NULL GROUP BY 1, 2), r AS (SELECT period, symbol, row_number() OVER (PARTITION BY period ORDER BY f, symbol) AS place FROM f) SELECT *, place <= 20 AS granted FROM r"""
)
def symbol_budget(spark, d):
    """20 distinct symbols a month, first come first served."""
    m = table(spark, d, "mentions").select("created_utc", symbol_key("ticker").alias("symbol"))
    return R.symbol_budget(m, 20, S.month_of(S.utc_date(F.col("created_utc"))), "symbol", "created_utc").withColumn("place", F.col("place").cast("long"))


_BUDGET = f"""f AS (SELECT strftime({_DAY}, '%Y-%m') AS period, {symbol_key_sql('ticker')} AS symbol, min(created_utc) AS f FROM mentions WHERE ticker IS NOT NULL GROUP BY 1, 2), r AS (SELECT period, symbol, row_number() OVER (PARTITION BY period ORDER BY f, symbol) AS place FROM f)"""


@query(f"WITH {_BUDGET} SELECT period, count(*) FILTER (WHERE place <= 20) AS used, greatest(0, 20 - count(*) FILTER (WHERE place <= 20)) AS remaining FROM r GROUP BY 1")
def budget_left(spark, d):
    """Symbols of a month that were granted, and how many more could be."""
    m = table(spark, d, "mentions").select("created_utc", symbol_key("ticker").alias("symbol"))
    return R.budget_left(m, 20, S.month_of(S.utc_date(F.col("created_utc"))), "symbol", "created_utc")


@query(
    f"""WITH {_BUDGET}, b AS (SELECT DISTINCT year_month AS period, {symbol_key_sql('ticker_at_date')} AS symbol FROM panel WHERE ticker_at_date IS NOT NULL), n AS (SELECT b.period, count(*) FILTER (WHERE r.symbol IS NULL) AS new_symbols FROM b LEFT JOIN r ON r.period = b.period AND r.symbol = b.symbol AND r.place <= 20 GROUP BY 1),
 u AS (SELECT period, least(20, count(*)) AS used FROM r GROUP BY 1) SELECT n.period, n.new_symbols, n.new_symbols <= 20 - coalesce(u.used, 0) AS fits FROM n LEFT JOIN u ON u.period = n.period"""
)
def budget_cost(spark, d):
    """What the panel's symbols would cost the budget of their month."""
    m = table(spark, d, "mentions").select("created_utc", symbol_key("ticker").alias("symbol"))
    batch = table(spark, d, "panel").select(F.col("year_month").alias("period"), symbol_key("ticker_at_date").alias("symbol"))
    return R.would_cost(batch, m, 20, S.month_of(S.utc_date(F.col("created_utc"))), "symbol", "created_utc")


@query()
def quota_granted(spark, d):
    """R4 as a limiter grants: a refused call uses nothing up; each answer depends on those before it, hence no SQL."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("user_id"), F.unix_timestamp(F.col("ts")).alias("t"))
    return R.granted_calls(e, {3600: 3, 86400: 5}, "user_id", "t")


@query(
    f"""WITH {_PX}, p AS (SELECT ticker, count(*) AS n, max(date) AS last FROM px GROUP BY 1), pr AS (SELECT entity_id, {symbol_key_sql('arg_max(ticker, (known_on, listing_no))')} AS ticker, arg_max(listed_to, (known_on, listing_no)) AS e FROM tickers WHERE delisted GROUP BY 1),
 g AS (SELECT coalesce(p.n, 0) >= 100 AND (pr.e IS NULL OR abs(p.last - pr.e) <= 20) AS good FROM pr LEFT JOIN p ON p.ticker = pr.ticker), c AS (SELECT coalesce(max(n), 0) AS n FROM p WHERE ticker = (SELECT ticker FROM p ORDER BY n DESC, ticker LIMIT 1))
 SELECT count(*) AS n_probes, count(*) FILTER (WHERE good) AS n_good, (SELECT n FROM c) AS n_control, count(*) FILTER (WHERE good) = count(*) AND (SELECT n FROM c) >= 500 AS usable FROM g"""
)
def quality_gate(spark, d):
    """G1: delisted names as probes of the price source."""
    px, t = _prices(spark, d), table(spark, d, "tickers").where("delisted")
    last = F.struct("known_on", "listing_no")
    probes = t.groupBy("entity_id").agg(symbol_key(F.max_by("ticker", last)).alias("ticker"), F.max_by(F.struct("listed_to"), last).alias("e")).select("ticker", F.col("e.listed_to").alias("expected_end"))
    n = px.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    control = n.agg(F.min_by("ticker", F.struct(-F.col("n"), F.col("ticker")))).scalar()
    return R.source_gate(px, probes, control)


@query(
    """WITH a AS (SELECT DISTINCT entity_id FROM mentions WHERE channel = 'cashtag' AND entity_id IS NOT NULL), b AS (SELECT DISTINCT entity_id FROM panel WHERE entity_id IS NOT NULL)
 SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_mentions', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)"""
)
def set_ops(spark, d):
    """Union, difference and intersection of entities."""
    a = table(spark, d, "mentions").where("channel = 'cashtag' and entity_id is not null").select("entity_id").distinct()
    b = table(spark, d, "panel").where("entity_id is not null").select("entity_id").distinct()
    parts = {"both": a.intersect(b), "only_mentions": a.subtract(b), "either": a.union(b).distinct()}
    out = None
    for k, v in parts.items():
        one = v.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """WITH e AS (SELECT mention_no, unnest(evidence) AS x, entity_id, doc_id, doc_type FROM mentions WHERE entity_id IS NOT NULL) SELECT doc_type, doc_id, entity_id, array_to_string(list_sort(list_distinct(list(x))), ',') AS evidence FROM e GROUP BY 1, 2, 3"""
)
def evidence_union(spark, d):
    """All evidence of an entity in a document, each kind once."""
    m = table(spark, d, "mentions").where("entity_id is not null").select("doc_type", "doc_id", "entity_id", F.explode("evidence").alias("x"))
    return m.groupBy("doc_type", "doc_id", "entity_id").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("evidence"))


# --- vocabularies, cohorts, score trust, examples --------------------------------------------


_SYMBOLS = f"""t0 AS (SELECT DISTINCT {symbol_key_sql('symbol')} AS s FROM prices WHERE symbol IS NOT NULL), t AS (SELECT s AS ticker FROM t0 UNION SELECT s || '-WT' FROM t0 UNION SELECT s || '-P-A' FROM t0 UNION SELECT s || 'W' FROM t0 WHERE length(s) = 4 UNION SELECT 'ZVZZT')"""
_COMMON = f"NOT regexp_matches(ticker, '{U.NOT_COMMON}') AND NOT regexp_matches(ticker, '{U.TEST_SYMBOL}')"


@query(f"WITH {_SYMBOLS} SELECT ticker FROM t WHERE {_COMMON} AND NOT (length(ticker) = 5 AND right(ticker, 1) IN ('W', 'U', 'R') AND left(ticker, 4) IN (SELECT ticker FROM t))")
def common_equity(spark, d):
    """symbols of common shares, of all symbols and made warrants, preferred shares and a test symbol beside them."""
    t = table(spark, d, "prices").where("symbol is not null").select(symbol_key("symbol").alias("s")).distinct()
    odd = F.array(F.col("s"), F.concat("s", F.lit("-WT")), F.concat("s", F.lit("-P-A")), F.when(F.length("s") == 4, F.concat("s", F.lit("W"))), F.lit("ZVZZT"))
    return U.common_equity(t.select(F.explode(odd).alias("ticker")).where("ticker is not null").distinct())


_EXCHANGES = ("NORTHX", "CIVIC", "HARBOR")


@query(f"""SELECT listing_no, ticker FROM tickers WHERE exchange IN {_EXCHANGES} AND listed_from IS NOT NULL AND ticker IS NOT NULL AND {_COMMON}
 AND NOT (length(ticker) = 5 AND right(ticker, 1) IN ('W', 'U', 'R') AND left(ticker, 4) IN (SELECT ticker FROM tickers WHERE ticker IS NOT NULL AND exchange IN {_EXCHANGES} AND listed_from IS NOT NULL))""")
def listed_stocks(spark, d):
    """listings on the main exchanges with a first day."""
    return U.listed_stocks(table(spark, d, "tickers"), _EXCHANGES).select("listing_no", "ticker")


@query(
    f"""WITH n AS (SELECT entity_id, listing_no AS o, {_NAME_SQL} AS a FROM tickers WHERE name IS NOT NULL AND entity_id IS NOT NULL),
 c AS (SELECT entity_id, o, a AS alias, false AS proof FROM n WHERE contains(a, ' ') AND length(a) >= 6 UNION ALL SELECT entity_id, o, a, true FROM n WHERE NOT contains(a, ' ') AND length(a) >= 4
 UNION ALL SELECT entity_id, o, split_part(a, ' ', 1), true FROM n WHERE contains(a, ' ') AND length(a) >= 6 AND length(split_part(a, ' ', 1)) >= 6)
 SELECT alias, arg_min(entity_id, (o, entity_id)) AS entity_id FROM c WHERE NOT proof OR alias NOT IN (SELECT lower(word) FROM word_rank WHERE word IS NOT NULL AND rank_no <= 50000) GROUP BY 1"""
)
def alias_derivation(spark, d):
    """Names that companies may be called by."""
    return U.derive_aliases(table(spark, d, "tickers"), table(spark, d, "word_rank"))


@query(
    f"""WITH h AS (SELECT upper(trim(ticker)) AS ticker, min(entity_id) AS entity_id FROM tickers WHERE ticker IS NOT NULL GROUP BY 1), p AS (SELECT DISTINCT {symbol_key_sql('symbol')} AS ticker FROM prices WHERE symbol IS NOT NULL)
 SELECT ticker, entity_id, false AS delisted FROM h UNION ALL SELECT ticker, 'TIINGO:' || ticker, true FROM p WHERE ticker <> '' AND ticker NOT IN (SELECT ticker FROM h)"""
)
def delisted_topup(spark, d):
    """Symbols that only the price table knows, under made identifiers."""
    px = table(spark, d, "prices").where("symbol is not null").select(symbol_key("symbol").alias("ticker"))
    return U.delisted_topup(table(spark, d, "tickers"), px)


@query(
    f"""WITH {_MEN}, {_LISTED}, p AS (SELECT year(day) AS year, entity_id, count(*) AS n FROM men WHERE entity_id IS NOT NULL GROUP BY 1, 2), f AS (SELECT year, sum(n) AS n_mentions, count(*) FILTER (WHERE n >= 2) AS m2 FROM p GROUP BY 1),
 u AS (SELECT f.*, m2 / (SELECT count(DISTINCT entity_id) FROM li WHERE b <= make_date(f.year, 6, 30) AND e >= make_date(f.year, 6, 30)) AS share FROM f WHERE year BETWEEN 2015 AND 2021 AND n_mentions > 200)
 SELECT arg_max(year, (share, -year)) AS widest_year, round(max(share), 6) AS share, count(*) AS n_cohorts, CASE WHEN max(share) IS NULL THEN 'INSUFFICIENT' WHEN max(share) > 0.5 THEN 'FAIL' WHEN max(share) > 0.25 THEN 'MARGINAL' ELSE 'PASS' END AS verdict, 3 AS horizon FROM u"""
)
def usable_cohort_gate(spark, d):
    """The widest cohort that has had a three-year horizon by 2024."""
    m = P.confident(table(spark, d, "mentions"), 0.75)
    days = m.select(F.make_date(F.year(S.utc_date(F.col("created_utc"))), F.lit(6), F.lit(30)).alias("day")).distinct()
    size = J.universe_sizes(table(spark, d, "tickers"), days, "entity_id").select(F.year("day").alias("year"), "n_listed")
    n = m.where("entity_id is not null").groupBy(F.year(S.utc_date(F.col("created_utc"))).alias("year")).agg(F.count(F.lit(1)).alias("n_mentions"))
    f = P.funnel_by_year(m, size).join(n, "year")
    return r6(U.usable_cohorts(f, 2024, 3), "share")


@query(
    f"""WITH a AS (SELECT {message_key_sql('id')} AS k, ingest_no, score, retrieved_on, row_number() OVER (PARTITION BY {message_key_sql('id')} ORDER BY retrieved_on NULLS FIRST, ingest_no DESC) AS f, row_number() OVER (PARTITION BY {message_key_sql('id')} ORDER BY retrieved_on DESC NULLS LAST, ingest_no) AS l, count(*) OVER (PARTITION BY {message_key_sql('id')}) AS c FROM submissions WHERE id IS NOT NULL),
 p AS (SELECT x.k, x.score AS early, y.score AS late FROM a x JOIN a y ON y.k = x.k AND y.l = 1 WHERE x.f = 1 AND x.c > 1 AND x.score IS NOT NULL AND y.score IS NOT NULL),
 r AS (SELECT row_number() OVER (ORDER BY early, k) AS a, row_number() OVER (ORDER BY late, k) AS b FROM p) SELECT round(corr(a, b), 6) AS rho, count(*) AS n, round(corr(a, b), 6) >= 0.7 AS trusted FROM r"""
)
def score_trust(spark, d):
    """Scores at the first delivery against those at the last (the supplied later look)."""
    s = table(spark, d, "submissions").where("id is not null").select(message_key("id").alias("k"), "score", "ingest_no", "retrieved_on")
    t = F.coalesce("retrieved_on", F.lit(-(2**62)))
    first, last = F.struct(t, -F.col("ingest_no")), F.struct(t, -F.col("ingest_no"))
    box = F.struct("score")  # keeps a null score from being passed over
    p = s.groupBy("k").agg(F.min_by(box, first)["score"].alias("early"), F.max_by(box, last)["score"].alias("late"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return r6(Z.spearman_ordinal(p, "early", "late", "k"), "rho").withColumn("trusted", F.col("rho") >= 0.7)


@query(f"WITH {_LABEL}, x AS (SELECT coalesce(g.item_id, p.item_id) AS item_id, coalesce(g.ticker, p.ticker) AS ticker, CASE WHEN p.item_id IS NULL THEN 'fn' ELSE 'fp' END AS outcome FROM g FULL JOIN p ON p.item_id = g.item_id AND p.ticker = g.ticker WHERE g.item_id IS NULL OR p.item_id IS NULL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY item_id, ticker) AS place FROM x) WHERE place <= 15")
def error_examples(spark, d):
    """T4: the first 15 misses and the first 15 false finds."""
    x = R.first_examples(_compared(spark, d), "outcome", ("fn", "fp"), 15, "item_id", "ticker")
    return x.select("item_id", "ticker", "outcome", F.col("place").cast("long").alias("place"))
