"""Size strata, post-stratified lift, bootstrap intervals and the comparisons built on them.

Analysis tables hold one row per name, a few thousand at most; edges, rates and replicates are
aggregates over strata, and no name ever leaves its executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threshfold.functions.stats import ratio

STRATA = 5
LABELS = ("winner_3x", "outperformer", "wipeout")


def strata_edges(rows: DataFrame, value: str = "dollar_volume", n: int = STRATA) -> DataFrame:
    """One row, ``edges``: the values at places ``floor(N * i / n)`` of the sorted positive values,
    each once; empty where there are fewer than ``n`` values. Places are found by counting the
    distinct values in order, so equal values cost one row."""
    v = rows.where(F.col(value) > 0).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    total = v.agg(F.coalesce(F.sum("c"), F.lit(0))).scalar()
    v = v.withColumn("hi", F.sum("c").over(W.orderBy("v"))).withColumn("lo", F.col("hi") - F.col("c"))
    holds = F.lit(False)
    for i in range(1, n):
        place = F.floor(total * i / n)
        holds = holds | ((place >= F.col("lo")) & (place < F.col("hi")))
    hit = v.where((total >= n) & holds)
    return hit.agg(F.array_sort(F.collect_set("v")).alias("edges"))


def stratum(value: Column, edges: Column) -> Column:
    """How many edges the value reaches; 0 for null and non-positive values."""
    reached = F.lit(0)
    for i in range(STRATA - 1):
        reached = reached + F.when(value >= F.get(edges, F.lit(i)), 1).otherwise(0)
    return F.when(value > 0, reached).otherwise(0)


def stratified(rows: DataFrame, edges: DataFrame, value: str = "dollar_volume") -> DataFrame:
    return rows.withColumn("stratum", stratum(F.col(value), edges.scalar()))


def label_rates(rows: DataFrame, labels: tuple[str, ...] = LABELS, by: tuple[str, ...] = ("grp",)) -> DataFrame:
    """``grp, label, n, k, rate``: shares of true labels; null labels are left out."""
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("hit")) for x in labels])).alias("x")).select(*by, "x.*")
    long = long.where("hit is not null").groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit")).cast("long").alias("k"))
    return long.withColumn("rate", ratio(F.col("k"), F.col("n")))


def cells(rows: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``label, grp, stratum, n, k``: names and true labels per cell; a null label counts as false."""
    long = rows.select("grp", "stratum", F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.coalesce(F.col(x), F.lit(False)).alias("hit")) for x in labels])).alias("x")).select("grp", "stratum", "x.*")
    return long.groupBy("label", "grp", "stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit")).cast("long").alias("k"))


def post_stratified(cell: DataFrame, treated: str = "treated", control: str = "control") -> DataFrame:
    """``label, p_control_adj, unsupported``: control rates weighted by the treated strata. Strata
    without controls are left out, the other weights renormalised, and the share left out reported;
    (null, 1) where nothing is left."""
    t = cell.where(F.col("grp") == treated).select("label", "stratum", F.col("n").alias("w"))
    c = cell.where(F.col("grp") == control).select("label", "stratum", F.col("n").alias("cn"), F.col("k").alias("ck"))
    j = t.join(c, ["label", "stratum"], "left")
    ok = F.col("cn").isNotNull()
    out = j.groupBy("label").agg(
        ratio(F.sum(F.when(ok, F.col("w") * F.col("ck") / F.col("cn"))), F.sum(F.when(ok, F.col("w")))).alias("p_control_adj"),
        ratio(F.coalesce(F.sum(F.when(~ok, F.col("w"))), F.lit(0)), F.sum("w")).alias("unsupported"),
    )
    return out


def common_support(rows: DataFrame) -> DataFrame:
    """Rows of strata that hold both groups."""
    both = rows.groupBy("stratum").agg(F.count_distinct("grp").alias("g")).where("g = 2").select("stratum")
    return rows.join(both, "stratum", "left_semi")


def lift_table(rows: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``label, p_treated, p_control, p_control_adj, unsupported, naive_lift, adjusted_lift``."""
    r = label_rates(rows, labels)
    side = lambda g: r.where(F.col("grp") == g).select("label", F.col("rate").alias(f"p_{g}"))
    out = side("treated").join(side("control"), "label").join(post_stratified(cells(rows, labels)), "label")
    return out.withColumns({"naive_lift": ratio(F.col("p_treated"), F.col("p_control")), "adjusted_lift": ratio(F.col("p_treated"), F.col("p_control_adj"))})


def bootstrap(rows: DataFrame, n_boot: int = 2000, seed: int = 20260816, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``label, n_used, lo, hi``: percentile interval of the adjusted lift, names drawn with
    replacement in each group, edges fixed. Replicates with a control rate of 0 are left out.

    A replicate depends on the counts of the cells (stratum, label) only, and drawing names with
    replacement draws these counts from a multinomial: every replicate draws a handful of
    numbers, whatever the number of names. Replicates are spread over tasks and each has a seed
    of its own, so the result does not depend on how they are spread."""
    return bootstrap_cells(cells(rows, labels), n_boot, seed)


def bootstrap_cells(cell: DataFrame, n_boot: int = 2000, seed: int = 20260816) -> DataFrame:
    """:func:`bootstrap` of given cells (``label, grp, stratum, n, k``); they are strata x labels x 2 rows."""
    import numpy as np
    import pandas as pd

    got = cell.select("label", "grp", "stratum", "n", "k").toPandas().sort_values(["label", "grp", "stratum"])
    tables = {x: t for x, t in got.groupby("label")}

    def run(batches):
        for b in batches:
            out = []
            for rep in b["id"]:
                rng = np.random.default_rng([seed, int(rep)])
                for x, t in tables.items():
                    side = {}
                    for g in ("treated", "control"):
                        part = t[t["grp"] == g]
                        cnt = np.stack([part["k"].to_numpy(), (part["n"] - part["k"]).to_numpy()], axis=1).astype(float)
                        n = int(cnt.sum())
                        drawn = rng.multinomial(n, cnt.ravel() / n).reshape(cnt.shape) if n else cnt
                        side[g] = dict(zip(part["stratum"], drawn.tolist(), strict=True))
                    w = {s: sum(v) for s, v in side["treated"].items()}
                    have = {s: v for s, v in side["control"].items() if sum(v) > 0}
                    den = sum(w[s] for s in w if s in have)
                    total = sum(w.values())
                    if not den or not total:
                        continue
                    pc = sum(w[s] * have[s][0] / sum(have[s]) for s in w if s in have) / den
                    if pc > 0:
                        out.append((x, sum(v[0] for v in side["treated"].values()) / total / pc))
            yield pd.DataFrame(out, columns=["label", "lift"])

    lifts = cell.sparkSession.range(n_boot).mapInPandas(run, "label string, lift double")
    sorted_ = lifts.groupBy("label").agg(F.array_sort(F.collect_list("lift")).alias("a"))  # at most n_boot numbers
    at = lambda q: F.element_at("a", (F.floor(F.size("a") * q) + 1).cast("int"))
    return sorted_.select("label", F.size("a").cast("long").alias("n_used"), at(0.025).alias("lo"), at(0.975).alias("hi"))


def recall_by_class(rows: DataFrame) -> DataFrame:
    """``label, n, mentioned, recall`` of names in each outcome class, and of all."""
    t = rows.where("grp = 'treated'").select("ticker").distinct().withColumn("m", F.lit(True))
    r = rows.join(t, "ticker", "left")
    classes = [*[F.when(F.col(x), F.lit(x)) for x in LABELS], F.lit("all names")]
    long = r.select("m", F.explode(F.array(*classes)).alias("label")).where("label is not null")
    out = long.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("m").alias("mentioned"))
    return out.withColumn("recall", ratio(F.col("mentioned"), F.col("n")))


def dose_response(rows: DataFrame, buckets: tuple[tuple[int, int | None], ...] = ((3, 4), (5, 9), (10, 19), (20, None)), least: int = 5) -> DataFrame:
    """``bucket, n, winner_rate, wipeout_rate, median_return`` by number of authors."""
    b = None
    for lo, hi in buckets:
        hit = (F.col("n_authors") >= lo) & (F.col("n_authors") <= hi if hi else F.lit(True))
        b = (F if b is None else b).when(hit, f"{lo}-{hi}" if hi else f"{lo}+")
    return _summary(rows.withColumn("bucket", b).where("bucket is not null"), "bucket").where(F.col("n") >= least)


def _summary(rows: DataFrame, key: str) -> DataFrame:
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), share("winner_3x").alias("winner_rate"), share("wipeout").alias("wipeout_rate"), F.median("forward_return").alias("median_return"))


def portfolio(rows: DataFrame) -> DataFrame:
    """One row: equal-weighted, author-weighted and benchmark return, and the excess."""
    w = F.col("n_authors")
    out = rows.agg(F.avg("forward_return").alias("equal_weighted"), ratio(F.sum(F.col("forward_return") * w), F.sum(w)).alias("author_weighted"), F.avg("benchmark_return").alias("benchmark"))
    return out.withColumn("excess", F.col("equal_weighted") - F.col("benchmark"))


def size_cut(rows: DataFrame, share: float, value: str = "dollar_volume") -> Column:
    """The value at place ``floor(N * share)`` of the positive values in falling order (a scalar)."""
    v = rows.where(F.col(value) > 0)
    ranked = v.select(F.col(value).alias("v"), F.row_number().over(W.orderBy(F.desc(value))).alias("r"))
    n = v.agg(F.count(F.lit(1))).scalar()
    return ranked.where(F.col("r") == F.floor(n * share) + 1).agg(F.max("v")).scalar()


def novelty(rows: DataFrame) -> DataFrame:
    """One row: shares of treated names above the 20 % and the 50 % size cut of all names."""
    t, size = rows.where("grp = 'treated'"), F.coalesce("dollar_volume", F.lit(0.0))
    above = lambda q: F.avg((size >= size_cut(rows, q)).cast("double"))
    return t.agg(above(0.2).alias("share_top_quintile"), above(0.5).alias("share_above_median"))


def trivial_screen(rows: DataFrame, least: int = 10) -> DataFrame:
    """``label, p_treated, p_screen, ratio`` against the control names of the top 20 % by size."""
    cut = size_cut(rows.where("grp = 'control'"), 0.2)
    screen = rows.where("grp = 'control'").where(F.coalesce("dollar_volume", F.lit(0.0)) >= cut)
    enough = screen.agg(F.count(F.lit(1))).scalar() >= least
    t = label_rates(rows.where("grp = 'treated'")).select("label", F.col("rate").alias("p_treated"))
    s = label_rates(screen.withColumn("grp", F.lit("screen"))).where(enough).select("label", F.col("rate").alias("p_screen"))
    return t.join(s, "label").withColumn("ratio", ratio(F.col("p_treated"), F.col("p_screen")))


def rank_buckets(rows: DataFrame, signal: str, tops: tuple[int, ...] = (10, 25, 50), least: int = 5) -> DataFrame:
    """``bucket, n, winner_rate, wipeout_rate, median_return`` of the top names by a signal and the rest.

    Buckets overlap (the top 10 are in the top 25). Ties by name; names without the signal are left out."""
    r = rows.where(F.col(signal).isNotNull()).withColumn("r", F.row_number().over(W.orderBy(F.desc(signal), "ticker")))
    labels = F.array(*[F.when(F.col("r") <= k, f"top {k}") for k in tops], F.when(F.col("r") > max(tops), "rest"))
    return _summary(r.withColumn("bucket", F.explode(labels)).where("bucket is not null"), "bucket").where(F.col("n") >= least)


def matched_events(cell: DataFrame, label: str) -> DataFrame:
    """One row, ``n_events``: true labels of controls in strata that treated names occupy; and
    whether that is enough (five) for a ratio to be stable."""
    c = cell.where(F.col("label") == label)
    occupied = c.where("grp = 'treated'").select("stratum")
    out = c.where("grp = 'control'").join(occupied, "stratum", "left_semi").agg(F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("n_events"))
    return out.withColumn("stable", F.col("n_events") >= 5)


def largest(rows: DataFrame, k: int) -> DataFrame:
    """``scope, n, winner_rate, wipeout_rate, median_return`` of the k largest names, of all and of
    those never mentioned."""
    def top(df: DataFrame, scope: str) -> DataFrame:
        return df.orderBy(F.desc_nulls_last("dollar_volume"), "ticker").limit(k).withColumn("scope", F.lit(scope))

    return _summary(top(rows, "all").unionByName(top(rows.where("grp = 'control'"), "not_mentioned")), "scope")


SIGNALS = ("n_authors", "n_mentions", "total_score", "max_score")
#: Share of a bucket's weight without controls beyond which its adjusted lift is marked.
OFF_SUPPORT = 0.20


def rank_rows(rows: DataFrame, signals: tuple[str, ...] = SIGNALS, tops: tuple[int, ...] = (10, 25, 50), least_names: int = 40, least: int = 5) -> DataFrame:
    """``signal, bucket`` and the treated rows in it, for every signal that at least ``least_names`` names have and
    every bucket (top 10, 25, 50 and the rest) of at least ``least`` names. Ties by name."""
    long = rows.where("grp = 'treated'").withColumn("s", F.explode(F.array(*[F.struct(F.lit(x).alias("signal"), F.col(x).cast("double").alias("value")) for x in signals]))).select("*", "s.*").where("value is not null")
    r = long.withColumn("r", F.row_number().over(W.partitionBy("signal").orderBy(F.desc("value"), "ticker"))).withColumn("names", F.count(F.lit(1)).over(W.partitionBy("signal"))).where(F.col("names") >= least_names)
    buckets = F.array_compact(F.array(*[F.when(F.col("r") <= k, f"top {k}") for k in tops], F.when(F.col("r") > max(tops), "rest")))
    r = r.withColumn("bucket", F.explode(buckets)).withColumn("held", F.count(F.lit(1)).over(W.partitionBy("signal", "bucket")))
    return r.where(F.col("held") >= least).drop("s", "value", "r", "names", "held")


def rank_cells(rows: DataFrame, ranked: DataFrame, labels: tuple[str, ...] = ("winner_3x", "wipeout"), value: str = "dollar_volume") -> DataFrame:
    """Cells as of :func:`cells` for every bucket of :func:`rank_rows` beside all controls, under labels
    ``signal|bucket|label``. A bucket has size strata of its own, cut from its names and the controls together.

    Buckets are a dozen and hold names: the controls are repeated for each."""
    b = ranked.select("signal", "bucket").distinct()
    c = rows.where("grp = 'control'").join(F.broadcast(b.groupBy(F.lit("control").alias("grp")).agg(F.collect_list(F.struct("signal", "bucket")).alias("bs"))), "grp").withColumn("b", F.explode("bs")).select("*", "b.*")
    cols = ["signal", "bucket", "grp", value, *labels]
    both = ranked.select(*cols).unionByName(c.select(*cols))
    v = F.array_sort(F.collect_list(F.when(F.col(value) > 0, F.col(value))))
    n = F.size("v")
    edges = both.groupBy("signal", "bucket").agg(v.alias("v")).select("signal", "bucket", F.when(n >= STRATA, F.array_distinct(F.array(*[F.get("v", F.floor(n * i / STRATA).cast("int")) for i in range(1, STRATA)]))).otherwise(F.array().cast("array<double>")).alias("edges"))
    both = both.join(edges, ["signal", "bucket"]).withColumn("stratum", stratum(F.col(value), F.col("edges")))
    hit = F.explode(F.array(*[F.struct(F.concat_ws("|", "signal", "bucket", F.lit(x)).alias("label"), F.coalesce(F.col(x), F.lit(False)).alias("hit")) for x in labels])).alias("x")
    return both.select("grp", "stratum", hit).select("grp", "stratum", "x.*").groupBy("label", "grp", "stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit")).cast("long").alias("k"))


def rank_analysis(rows: DataFrame, signals: tuple[str, ...] = SIGNALS, tops: tuple[int, ...] = (10, 25, 50), least_names: int = 40, least: int = 5, least_events: int = 5) -> DataFrame:
    """One row per signal and bucket: names, winner and wipeout rate, median return and its excess over the
    controls' median, and the size-adjusted lifts against controls weighted like the bucket.

    The winner lift is null (``stable`` false) where fewer than ``least_events`` controls that won lie in strata
    of the bucket: a ratio over so few says nothing. ``off_support`` marks buckets of which more than OFF_SUPPORT
    has no controls. ``rows``: one row per name and group, with the signals of treated names."""
    ranked = rank_rows(rows, signals, tops, least_names, least)
    cell = rank_cells(rows, ranked)
    of = F.split("label", "[|]")
    adj = post_stratified(cell)
    occupied = cell.where("grp = 'treated'").select("label", "stratum")
    events = cell.where("grp = 'control'").join(occupied, ["label", "stratum"], "left_semi").groupBy("label").agg(F.sum("k").alias("events"))
    a = adj.join(events, "label", "left").select(of[0].alias("signal"), of[1].alias("bucket"), of[2].alias("what"), "p_control_adj", "unsupported", F.coalesce("events", F.lit(0).cast("long")).alias("events"))
    win = a.where("what = 'winner_3x'").select("signal", "bucket", F.col("p_control_adj").alias("p_win"), "unsupported", F.col("events").alias("n_control_events"))
    wipe = a.where("what = 'wipeout'").select("signal", "bucket", F.col("p_control_adj").alias("p_wipe"))
    middle = rows.where("grp = 'control'").agg(F.median("forward_return")).scalar()
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    out = ranked.groupBy("signal", "bucket").agg(F.count(F.lit(1)).alias("n"), share("winner_3x").alias("winner_rate"), share("wipeout").alias("wipeout_rate"), F.median("forward_return").alias("median_return"))
    out = out.join(win, ["signal", "bucket"]).join(wipe, ["signal", "bucket"])
    stable = (F.col("n_control_events") >= least_events) & (F.coalesce("p_win", F.lit(0.0)) > 0)
    return out.withColumns({
        "excess_vs_control": F.col("median_return") - middle, "stable": stable, "winner_lift": F.when(stable, ratio(F.col("winner_rate"), F.col("p_win"))),
        "wipeout_lift": ratio(F.col("wipeout_rate"), F.col("p_wipe")), "off_support": F.col("unsupported") > OFF_SUPPORT,
    }).drop("p_win", "p_wipe")


def rank_intervals(rows: DataFrame, signals: tuple[str, ...] = SIGNALS, tops: tuple[int, ...] = (10, 25, 50), least_names: int = 40, least: int = 5, least_events: int = 5, n_boot: int = 800) -> DataFrame:
    """``signal, bucket, n_used, lo, hi``: intervals of the winner lifts of :func:`rank_analysis` that are stable."""
    ranked = rank_rows(rows, signals, tops, least_names, least)
    cell = rank_cells(rows, ranked, ("winner_3x",))
    occupied = cell.where("grp = 'treated'").select("label", "stratum")
    enough = cell.where("grp = 'control'").join(occupied, ["label", "stratum"], "left_semi").groupBy("label").agg(F.sum("k").alias("e")).where(F.col("e") >= least_events)
    got = bootstrap_cells(cell.join(enough.select("label"), "label", "left_semi"), n_boot)
    of = F.split("label", "[|]")
    return got.select(of[0].alias("signal"), of[1].alias("bucket"), "n_used", "lo", "hi")


def index_shares(rows: DataFrame, members: DataFrame, key: str = "ticker", day: str = "formation_date") -> DataFrame:
    """One row: shares of treated names that were certainly in an index at formation, that were not certainly
    in it (the upper bound of novelty), and of which membership is unknown (no date of joining)."""
    from threshfold.operators.timejoin import member_since

    t = member_since(rows.where("grp = 'treated'").select(key, day), members, key, day)
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    sure = F.coalesce(F.col("in_index"), F.lit(False))
    return t.agg(share(sure).alias("confirmed_in"), share(~sure).alias("novelty_upper_bound"), share(F.col("in_index").isNull()).alias("membership_unknown"))


def group_outcomes(rows: DataFrame) -> DataFrame:
    """``grp, n, median_return, survived_share``: what the lift table says of the groups as a whole."""
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.median("forward_return").alias("median_return"), F.avg(F.coalesce("survived_full_horizon", F.lit(False)).cast("double")).alias("survived_share"))


def trimmed_support(rows: DataFrame, least: float = 0.01) -> DataFrame:
    """One row: the share of treated names without controls of their size, how many strata hold both groups, and
    whether that share is large enough (over ``least``) for the table on common support to be shown."""
    both = rows.groupBy("stratum").agg(F.count_if(F.col("grp") == "treated").alias("t"), F.count_if(F.col("grp") == "control").alias("c"))
    out = both.agg(ratio(F.sum(F.when(F.col("c") == 0, F.col("t")).otherwise(0)), F.sum("t")).alias("trimmed_share"), F.count_if((F.col("t") > 0) & (F.col("c") > 0)).cast("long").alias("n_strata"))
    return out.withColumn("shown", F.coalesce(F.col("trimmed_share") > least, F.lit(False)))


def mix(rows: DataFrame, key: str) -> DataFrame:
    """``grp, <key>, n, share``: how the names of each group spread over a classification; null is ``unknown``."""
    n = rows.groupBy("grp", F.coalesce(F.col(key), F.lit("unknown")).alias(key)).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", ratio(F.col("n"), F.sum("n").over(W.partitionBy("grp"))))


def companies(rows: DataFrame) -> DataFrame:
    """The table of names for readers: per horizon the ranks by authors and by upvotes (mentioned names) and by size
    (all), returns in percent, labels as 0 and 1 (null where not known). Ties by name."""
    t = F.col("grp") == "treated"
    rank = lambda c, *by: F.row_number().over(W.partitionBy("horizon_years", *by).orderBy(F.desc_nulls_last(c), "ticker")).cast("long")
    pct = lambda c: F.round(100 * F.col(c), 1)
    one = lambda c: F.col(c).cast("int")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.select(
        "ticker", F.when(t, "mentioned").otherwise("not_mentioned").alias("grp"), "horizon_years", n("n_mentions").alias("n_mentions"), n("n_authors").alias("n_authors"), n("total_score").alias("total_upvotes"), n("max_score").alias("best_post_upvotes"),
        F.when(t, rank("n_authors", "grp")).alias("rank_by_authors"), F.when(t, rank("total_score", "grp")).alias("rank_by_upvotes"), "entry_date", F.round("entry_price", 4).alias("entry_price"), "exit_date", F.round("exit_price", 4).alias("exit_price"),
        pct("forward_return").alias("forward_return_pct"), pct("benchmark_return").alias("benchmark_return_pct"), pct("excess_return").alias("excess_pct"), one("winner_3x").alias("tripled"), one("outperformer").alias("beat_benchmark"),
        one("wipeout").alias("lost_70pct"), one("survived_full_horizon").alias("survived_full_horizon"), F.floor("dollar_volume").alias("dollar_volume_at_entry"), rank("dollar_volume").alias("size_rank_in_sample"),
    )
