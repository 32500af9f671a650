"""Labels, samples, quotas and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threshfold.functions.stats import ratio
from threshfold.operators.cohort import shuffle_key


def compare(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides' distinct keys with ``outcome``: tp, fp or fn. Predictions count only for
    documents that are labelled (the first key)."""
    g = gold.select(*keys).distinct().withColumn("__g", F.lit(True))
    p = pred.select(*keys).distinct().join(gold.select(keys[0]).distinct(), keys[0], "left_semi").withColumn("__p", F.lit(True))
    g = g.dropna(subset=keys)
    kind = F.when(F.col("__g") & F.col("__p"), "tp").when(F.col("__p"), "fp").otherwise("fn")
    return p.join(g, keys, "full_outer").withColumn("outcome", kind).drop("__g", "__p")


def precision_recall(compared: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``tp, fp, fn, precision, recall, f1`` (0 where a denominator is 0)."""
    n = lambda o: F.count_if(F.col("outcome") == o).cast("long").alias(o)
    d = compared.groupBy(*by) if by else compared.groupBy()
    z = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    out = d.agg(n("tp"), n("fp"), n("fn"))
    out = out.withColumns({"precision": z(F.col("tp"), F.col("tp") + F.col("fp")), "recall": z(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", z(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def extraction_gate(scores: DataFrame, precision: float = 0.90, recall: float = 0.80) -> DataFrame:
    return scores.withColumn("passes", (F.col("precision") >= precision) & (F.col("recall") >= recall))


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 20260816) -> DataFrame:
    """``n`` rows at most, each stratum in proportion but at least ``max(5, n // (3 * strata))``.

    Within a stratum and over all, rows are taken in an order that only seed and key decide.
    The rank within a stratum is taken after rows that cannot be in any quota are cut: of each
    stratum's hash parts only the first ``n`` of a part remain, so a stratum with most rows is not
    sorted in one task."""
    counts = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("__c"))
    strata, total = counts.agg(F.count(F.lit(1))).scalar(), counts.agg(F.sum("__c")).scalar()
    quota = F.greatest(F.greatest(F.lit(5), F.floor(F.lit(n) / (strata * 3))), F.round(n * F.col("__c") / total))
    order = [shuffle_key(seed, key), key]
    part = F.pmod(F.xxhash64(key), F.lit(64))
    pre = rows.withColumn("__p", part).withColumn("__r", F.row_number().over(W.partitionBy(stratum, "__p").orderBy(*order))).where(F.col("__r") <= n)
    ranked = pre.withColumn("__r", F.row_number().over(W.partitionBy(stratum).orderBy(*order))).join(counts, stratum)
    return ranked.where(F.col("__r") <= quota).orderBy(*order).limit(n).drop("__p", "__r", "__c")


def first_examples(rows: DataFrame, group: str, values: tuple[str, ...], n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of each named group in an order, with their ``place``: a top-n per group, so that no
    task sorts a group."""
    out = None
    for v in values:
        top = rows.where(F.col(group) == v).orderBy(*order).limit(n)
        out = top if out is None else out.unionByName(top)
    return out.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order)))


def flat_label_text(c: Column, most: int = 4000) -> Column:
    """Text for a label sheet: tabs and returns as blanks, newlines as a sign, cut at ``most``."""
    t = F.regexp_replace(F.regexp_replace(c, "[\\t\\r]", " "), "\\n", " ⏎ ")
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(" …[truncated]"))).otherwise(t)


def admissible(calls: DataFrame, limits: dict[int, int], key: str, at: str) -> DataFrame:
    """``calls`` with ``admissible``: whether, of all calls as they came, no window of any limit
    (seconds to most calls) that ends with this one held more than it may. ``at``: epoch seconds; null where
    key or time is.

    Calls are first counted by second. A key is cut into slabs of time, and the seconds that the longest window
    reaches back over are in the next slab as well, so a caller with a third of all calls is many windows."""
    longest = max(limits)
    slab = 4 * longest
    per = calls.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).alias("__k"), F.col(at).cast("long").alias("__t")).agg(F.count(F.lit(1)).alias("__c"))
    own = F.floor(F.col("__t") / slab)
    reach = F.floor((F.col("__t") + longest - 1) / slab)
    cut = per.withColumn("__s", F.explode(F.sequence(own, reach))).withColumn("__own", F.col("__s") == own)
    ok = F.lit(True)
    for seconds, most in limits.items():
        ok = ok & (F.sum("__c").over(W.partitionBy("__k", "__s").orderBy("__t").rangeBetween(-(seconds - 1), 0)) <= most)
    got = cut.withColumn("admissible", ok).where("__own").select("__k", "__t", "admissible")
    return calls.join(got, (calls[key] == got["__k"]) & (calls[at].cast("long") == got["__t"]), "left").drop("__k", "__t")


def symbol_budget(claims: DataFrame, most: int, period: Column, symbol: str, at: str) -> DataFrame:
    """``period, symbol, place, granted``: the first ``most`` distinct symbols of a period, by first
    claim (symbol on a tie); claiming again costs nothing."""
    first = claims.where(F.col(symbol).isNotNull()).groupBy(period.alias("period"), F.col(symbol).alias("symbol")).agg(F.min(at).alias("__f"))
    place = F.row_number().over(W.partitionBy("period").orderBy("__f", "symbol"))
    return first.withColumn("place", place).withColumn("granted", F.col("place") <= most).drop("__f")


#: Presets of quotas: most calls by seconds, and most symbols a month.
QUOTAS = {"tiingo": ({3600: 50, 86_400: 1000}, 500), "massive": ({60: 5}, None)}


def budget_left(claims: DataFrame, most: int, period: Column, symbol: str, at: str) -> DataFrame:
    """``period, used, remaining`` of a symbol budget: symbols that were granted, and how many more could be."""
    b = symbol_budget(claims, most, period, symbol, at)
    return b.groupBy("period").agg(F.count_if("granted").cast("long").alias("used")).withColumn("remaining", F.greatest(F.lit(0).cast("long"), F.lit(most) - F.col("used")))


def would_cost(batch: DataFrame, claims: DataFrame, most: int, period: Column, symbol: str, at: str) -> DataFrame:
    """``period, new_symbols, fits``: how many symbols of a batch (``period, symbol``) the budget of their period has
    not seen (seen ones are free), and whether what remains of it holds them."""
    seen = symbol_budget(claims, most, period, symbol, at).where("granted").select("period", F.col("symbol").alias("__s"))
    b = batch.where("symbol is not null").select("period", "symbol").distinct()
    new = b.join(seen, (b["period"] == seen["period"]) & (b["symbol"] == seen["__s"]), "left_anti").groupBy("period").agg(F.count(F.lit(1)).alias("new_symbols"))
    left = budget_left(claims, most, period, symbol, at).select("period", "remaining")
    out = b.select("period").distinct().join(new, "period", "left").join(left, "period", "left").withColumn("new_symbols", F.coalesce("new_symbols", F.lit(0).cast("long")))
    return out.select("period", "new_symbols", (F.col("new_symbols") <= F.coalesce("remaining", F.lit(most))).alias("fits"))


def granted_calls(calls: DataFrame, limits: dict[int, int], key: str, at: str) -> DataFrame:
    """``key, at, granted`` of calls as a limiter grants them: a call is granted where no window of a limit would hold
    more *granted* calls than it may (:func:`admissible` counts all calls). Calls of one key are walked in order
    by an Arrow group; a key is one caller, and what it keeps is bounded by the limits."""
    import pandas as pd

    longest = max(limits)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        out = []
        for t in sorted(pdf["at"].tolist()):
            kept = [x for x in kept if x > t - longest]
            ok = all(sum(1 for x in kept if x > t - s) < n for s, n in limits.items())
            if ok:
                kept.append(t)
            out.append(ok)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "at": sorted(pdf["at"].tolist()), "granted": out})

    c = calls.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(at).cast("long").alias("at"))
    return c.groupBy("key").applyInPandas(run, "key string, at long, granted boolean")


def source_gate(prices: DataFrame, probes: DataFrame, control: str, least_control: int = 500, least: int = 100, drift: int = 20) -> DataFrame:
    """One row: whether a price source is usable. ``probes``: ``ticker, expected_end`` (null: none).

    The control needs ``least_control`` rows, each probe ``least`` and an end within ``drift`` days
    of the expected one."""
    per = prices.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last"))
    p = probes.join(per, "ticker", "left")
    good = (F.coalesce("n", F.lit(0)) >= least) & (F.col("expected_end").isNull() | (F.abs(F.datediff("last", "expected_end")) <= drift))
    n = per.where(F.col("ticker") == control).agg(F.coalesce(F.max("n"), F.lit(0))).scalar()
    out = p.agg(F.count(F.lit(1)).alias("n_probes"), F.count_if(F.coalesce(good, F.lit(False))).cast("long").alias("n_good"))
    return out.withColumn("n_control", n.cast("long")).withColumn("usable", (F.col("n_good") == F.col("n_probes")) & (F.col("n_control") >= least_control))


class GateError(RuntimeError):
    """A gate refused a source."""


def require(gate: DataFrame, column: str = "usable") -> None:
    """Raise where a gate's single row says no."""
    row = gate.first()
    if row is None or not row[column]:
        raise GateError(f"refused: {row.asDict() if row else 'no row'}")
