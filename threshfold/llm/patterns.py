"""Distinct counts for any combination of groups by membership patterns.

Every identifier is reduced to the set of groups that hold it (its pattern); identical patterns
are counted, and the distinct count of a group, of a union, an intersection or a difference of
groups is a sum over pattern totals. The counts are exact: the stated error bound is zero.

Partial results merge at the level of :func:`memberships` (identifier and group, each pair
once): two partial tables are united and made distinct again, in any order and any number of
times. Pattern totals of *disjoint* identifier sets (hash parts of the identifiers) add up as
they are: see :func:`merge_totals`.

One pattern space: :func:`space` reduces all identifiers of a table, of several kinds, in one pass to
the groups of all dimensions that hold them; :func:`space_totals` counts identical patterns over all
dimensions, and :func:`space_counts` and :func:`space_patterns` (with :func:`combination_counts`) answer
groups and combinations of any dimensions from these totals alone. Partial spaces merge
(:func:`merge_spaces`); totals of disjoint identifiers add up.

Combinations across dimensions: :func:`across` puts the groups of several dimensions into one
pattern for :func:`combination_counts`; :func:`cells` keeps for every identifier in which
combinations of fields it occurs in one row, from which :func:`cell_counts` counts groups of
several fields and :func:`pair_counts` all pairs of groups of two dimensions.

Size: a pattern is a subset of the groups of one dimension (days, channels, tickers, months), so
its length is bounded by the number of groups and not by the number of rows; the pairs combine
on the map side before they are shuffled by identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threshfold.session import written

ERROR_BOUND = 0.0


def memberships(df: DataFrame, identifier: Column | str, groups: dict[str, Column], ignore: tuple[str, ...] = ()) -> DataFrame:
    """``dimension, identifier, grp``: each pair once. Null identifiers, those in ``ignore`` and
    null groups are no members; the empty string is an identifier."""
    who = F.col(identifier) if isinstance(identifier, str) else identifier
    rows = df.select(who.cast("string").alias("identifier"), F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), g.cast("string").alias("grp")) for n, g in groups.items()])).alias("g"))
    ok = F.col("identifier").isNotNull() & F.col("g.grp").isNotNull()
    if ignore:
        ok = ok & ~F.col("identifier").isin(*ignore)
    return rows.where(ok).select("g.dimension", "identifier", "g.grp").distinct()


def merge_memberships(*parts: DataFrame) -> DataFrame:
    """Partial membership tables as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def pattern_totals(members: DataFrame) -> DataFrame:
    """``dimension, pattern, n``: how many identifiers belong to exactly the groups of ``pattern``."""
    sets = members.groupBy("dimension", "identifier").agg(F.array_sort(F.collect_set("grp")).alias("pattern"))
    return sets.groupBy("dimension", "pattern").agg(F.count(F.lit(1)).alias("n"))


def merge_totals(*parts: DataFrame) -> DataFrame:
    """Pattern totals of disjoint identifier sets, added up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("dimension", "pattern").agg(F.sum("n").alias("n"))


def group_counts(totals: DataFrame) -> DataFrame:
    """``dimension, grp, n_distinct`` for every group."""
    return totals.select("dimension", F.explode("pattern").alias("grp"), "n").groupBy("dimension", "grp").agg(F.sum("n").alias("n_distinct"))


def combination_counts(totals: DataFrame, combos: DataFrame) -> DataFrame:
    """``combo, dimension, n_any, n_all, n_only`` for stated combinations (``combo, dimension, grps``).

    ``n_any`` counts identifiers in at least one of the groups, ``n_all`` in every one, ``n_only``
    in these and no other group. A combination of groups that hold nobody has zeros. Totals meet a
    combination only through a group both hold, each pattern once per combination."""
    long = combos.select("combo", "dimension", F.array_distinct("grps").alias("grps")).withColumn("grp", F.explode("grps"))
    hits = (
        totals.withColumn("grp", F.explode("pattern"))
        .join(long, ["dimension", "grp"])
        .where(F.col("grp") == F.array_min(F.array_intersect("pattern", "grps")))
    )
    every = F.size(F.array_intersect("pattern", "grps")) == F.size("grps")
    got = hits.groupBy("combo", "dimension").agg(
        F.sum("n").alias("n_any"),
        F.sum(F.when(every, F.col("n")).otherwise(0)).alias("n_all"),
        F.sum(F.when(F.size(F.array_except("pattern", "grps")) == 0, F.col("n")).otherwise(0)).alias("n_only"),
    )
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("n_any", "n_all", "n_only")]
    return combos.select("combo", "dimension").distinct().join(got, ["combo", "dimension"], "left").select("combo", "dimension", *zero)


def across(members: DataFrame, name: str, *dimensions: str) -> DataFrame:
    """The memberships of ``dimensions`` as those of one dimension ``name``; a group is written
    ``dimension=group``. Its pattern totals answer combinations across these dimensions."""
    return members.where(F.col("dimension").isin(*dimensions)).select(F.lit(name).alias("dimension"), "identifier", F.concat_ws("=", "dimension", "grp").alias("grp"))


def cells(df: DataFrame, identifier: str, fields: dict[str, Column], ignore: tuple[str, ...] = ()) -> DataFrame:
    """``identifier, cells``: per identifier the distinct combinations of ``fields`` in its rows.

    Rows combine on the map side; the array is bounded by the number of combinations. Partial
    tables merge by the union of an identifier's arrays."""
    rows = df.select(F.col(identifier).cast("string").alias("identifier"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("cell")).where("identifier is not null")
    if ignore:
        rows = rows.where(~F.col("identifier").isin(*ignore))
    return rows.groupBy("identifier").agg(F.collect_set("cell").alias("cells"))


def _set_of(group) -> Column:
    """Distinct groups of an identifier's cells, without null."""
    return F.array_distinct(F.filter(F.transform("cells", lambda x: group(x).cast("string")), lambda g: g.isNotNull()))


def cell_counts(cells: DataFrame, groups: dict) -> DataFrame:
    """``dimension, grp, n_distinct``; ``groups`` has a function of a cell for each dimension.
    A null group counts nobody."""
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), _set_of(g).alias("grps")) for n, g in groups.items()])).alias("s")
    return cells.select(one).select("s.dimension", F.explode("s.grps").alias("grp")).groupBy("dimension", "grp").agg(F.count(F.lit(1)).alias("n_distinct"))


def pair_counts(cells: DataFrame, groups: dict, pairs: list[tuple[str, str]]) -> DataFrame:
    """``dimension, one, other, n_any, n_all, n_only`` for every group of one dimension with every
    group of another; ``groups`` as in :func:`cell_counts`.

    An identifier need not hold both groups in the same row. ``n_only`` counts identifiers that are
    in these and no other group of the two dimensions. Every identifier adds its pairs and, with a
    null on the other side, its single groups, so one aggregation holds all that is needed."""
    held = F.explode(F.array(*[F.struct(F.lit(f"{a}+{b}").alias("dimension"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs])).alias("s")
    wide = cells.select(*[_set_of(g).alias(n) for n, g in groups.items()]).select(held).select("s.*")
    few = (F.size("a") <= 1) & (F.size("b") <= 1)
    none = F.array(F.lit(None).cast("string"))
    rows = wide.select("dimension", few.alias("few"), (F.size("a") == 0).alias("no_a"), (F.size("b") == 0).alias("no_b"), F.explode(F.concat("a", none)).alias("one"), "b")
    rows = rows.select("dimension", "few", "no_a", "no_b", "one", F.explode(F.concat("b", none)).alias("other")).where("one is not null or other is not null")
    only = F.col("few") & (F.col("one").isNotNull() | F.col("no_a")) & (F.col("other").isNotNull() | F.col("no_b"))
    t = written(rows.groupBy("dimension", "one", "other").agg(F.count(F.lit(1)).alias("n"), F.sum(only.cast("long")).alias("n_only")), "pairs")
    a = t.where("other is null").select("dimension", "one", F.col("n").alias("n_a"), F.col("n_only").alias("only_a"))
    b = t.where("one is null").select("dimension", "other", F.col("n").alias("n_b"), F.col("n_only").alias("only_b"))
    both = t.where("one is not null and other is not null")
    all_ = F.coalesce("n", F.lit(0).cast("long"))
    return a.join(b, "dimension").join(both, ["dimension", "one", "other"], "left").select(
        "dimension", "one", "other", (F.col("n_a") + F.col("n_b") - all_).alias("n_any"), all_.alias("n_all"), (F.coalesce("n_only", F.lit(0).cast("long")) + F.col("only_a") + F.col("only_b")).alias("n_only")
    )


# --- one pattern space over all dimensions ---------------------------------------------------


def space(df: DataFrame, identifiers: dict[str, tuple[str, ...]], groups: dict[str, Column]) -> DataFrame:
    """``counted, identifier`` and for each dimension the sorted set of groups that hold the identifier.

    ``identifiers``: columns to count, with values that are none; nulls are none either, and null groups
    hold nobody. One read for all kinds of identifiers; sets combine on the map side and are
    bounded by the number of groups."""
    who = F.explode(F.array(*[F.struct(F.lit(k).alias("counted"), F.when(~F.col(k).isin(*v), F.col(k)).otherwise(F.lit(None)).cast("string").alias("identifier")) if v else F.struct(F.lit(k).alias("counted"), F.col(k).cast("string").alias("identifier")) for k, v in identifiers.items()])).alias("w")
    rows = df.select(who, *[g.alias(n) for n, g in groups.items()]).select("w.*", *groups).where("identifier is not null")
    return rows.groupBy("counted", "identifier").agg(*[F.array_sort(F.collect_set(n)).alias(n) for n in groups])


def merge_spaces(dimensions: list[str], *parts: DataFrame) -> DataFrame:
    """Partial spaces as one: the union of each identifier's sets."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("counted", "identifier").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(n)))).alias(n) for n in dimensions])


def space_totals(one: DataFrame, dimensions: list[str]) -> DataFrame:
    """``counted``, the sets of all dimensions, and ``n``: how many identifiers have exactly these."""
    return one.groupBy("counted", *dimensions).agg(F.count(F.lit(1)).alias("n"))


def space_counts(totals: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """``counted, dimension, grp, n_distinct``; ``groups`` has an array of groups for each dimension, a set of the
    totals or something made of one (the months of a set of days)."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.array_distinct(g).cast("array<string>").alias("grps")) for n, g in groups.items()])).alias("d")
    return totals.select("counted", "n", each).select("counted", "n", "d.dimension", F.explode("d.grps").alias("grp")).groupBy("counted", "dimension", "grp").agg(F.sum("n").alias("n_distinct"))


def space_patterns(totals: DataFrame, name: str, groups: dict[str, Column]) -> DataFrame:
    """Pattern totals (``dimension, pattern, n``) over some dimensions at once, under one dimension
    ``name|counted``; a group is written ``dimension=group``. For :func:`combination_counts`."""
    named = lambda n: lambda x: F.concat(F.lit(n + "="), x)
    sets = [F.transform(F.array_distinct(g).cast("array<string>"), named(n)) for n, g in groups.items()]
    return totals.select(F.concat(F.lit(name + "|"), "counted").alias("dimension"), F.concat(*sets).alias("pattern"), "n").groupBy("dimension", "pattern").agg(F.sum("n").alias("n"))
