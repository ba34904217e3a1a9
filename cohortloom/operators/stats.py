"""Rank tests, survival curves and scores, as sums over ranks.

Average ranks come from per-value counts, summed up in the order of the values. The sums run inside
ranges of about ROWS values, cut at approximate quantiles, and start from the totals of the ranges before
(one row a range), so that no window ever holds a whole column; as many values as one range holds need no cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pvalues import chi2_sf, exact_mann_whitney, normal_two_sided
from .matrix import arrays
from .pairs import label_distances

#: Values of a range: what one window holds.
ROWS = 1 << 16


def place_among(cuts: Column, x: Column, most: int) -> Column:
    """How many of at most `most` sorted cuts are not above x, by bisection."""

    def halve(at, _):
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        open_ = at["lo"] < at["hi"]
        below = open_ & (F.get(cuts, F.least(middle, F.size(cuts) - 1)) <= x)
        return F.struct(F.when(below, middle + 1).otherwise(at["lo"]).alias("lo"), F.when(open_ & ~below, middle).otherwise(at["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, most.bit_length()))), F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), halve)["lo"]


def running_sums(df: DataFrame, order: str, weights: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """The rows with, for each weight, its sum over the rows before in the group `by`, in the order of the (numeric) column; rows of one group and value must be one."""
    by = by or []
    ranges = -(-df.count() // ROWS)
    inside = Window.partitionBy(*by, *(["_range"] if ranges > 1 else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if ranges <= 1:
        return df.withColumns({n: F.coalesce(F.sum(w).over(inside), F.lit(0)) for n, w in weights.items()})
    x = F.col(order).cast("double")
    cuts = df.agg(F.percentile_approx(x, [k / ranges for k in range(1, ranges)], 10 * ranges).alias("_cuts"))
    rows = df.crossJoin(F.broadcast(cuts)).withColumn("_range", F.coalesce(place_among(F.array_distinct("_cuts"), x, ranges), F.lit(0))).drop("_cuts")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "_range").agg(*[F.sum(w).alias(f"_all_{n}") for n, w in weights.items()])
    starts = starts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_from_{n}") for n in weights])
    rows = rows.withColumns({n: F.coalesce(F.sum(w).over(inside), F.lit(0)) for n, w in weights.items()})
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = rows.join(starts, same)
    for n in weights:
        out = out.withColumn(n, F.col(n) + F.col(f"_from_{n}"))
    return out.select(*df.columns, *weights)


def average_ranks(df: DataFrame, col: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Rank from 1 within `by`, ties at their mean; also `{out}_ties`, how many share the value."""
    by = by or []
    ties = f"{out}_ties"
    counts = df.groupBy(*by, col).agg(F.count("*").alias(ties))
    ranks = running_sums(counts, col, {out: F.col(ties)}, by).withColumn(out, F.col(out) + (F.col(ties) + 1) / 2)
    return df.join(ranks, [*by, col])


def spearman(pairs: DataFrame, x: str, y: str, max_missing: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """(by, n, rho) over rows with both values; rho is NULL for three rows or fewer, a constant side, or if y misses that share of all rows or more.

    One ranking of each side serves all groups of `by`.
    """
    by = by or []
    both = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = average_ranks(average_ranks(both, x, "rx", by), y, "ry", by)
    rho = F.covar_pop("rx", "ry") / F.nullif(F.stddev_pop("rx") * F.stddev_pop("ry"), F.lit(0.0))
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), rho.alias("rho"))
    missing = pairs.groupBy(*by).agg((F.count("*") - F.count(y)).alias("_gone"), F.count("*").alias("_rows"))
    out = missing.join(out, by, "left") if by else missing.crossJoin(F.broadcast(out))
    skipped = F.lit(max_missing < 1) & (F.col("_gone") >= max_missing * F.col("_rows"))
    return out.select(*by, F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.when((F.col("n") > 3) & ~skipped, F.col("rho")).alias("rho"))


#: Which way each measure should go with the time, and the bound of sign * rho.
EXPECTED = (("mmse", -1, -0.30), ("braaksc", 1, 0.30), ("ceradsc", -1, -0.30), ("cogdx", 1, 0.30))


def time_validation(clinical: DataFrame, time: str, columns: dict[str, str], max_missing: float = 0.5) -> DataFrame:
    """(measure, sign, n, rho, passed) of every measure that has a column: passed if sign * rho is above its bound. All measures are stacked and ranked together."""
    held = [(m, s, b) for m, s, b in EXPECTED if m in columns]
    if not held:
        return clinical.sparkSession.createDataFrame([], "measure string, sign int, n long, rho double, passed boolean")
    stacked = clinical.select(F.col(time).alias("t"), F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(columns[m]).cast("double").alias("v")) for m, _, _ in held])).alias("x")).select("t", "x.*")
    found = spearman(stacked, "t", "v", max_missing, ["measure"])
    pick = lambda k: F.create_map(*[v for r in held for v in (F.lit(r[0]), F.lit(r[k]))])[F.col("measure")]
    return found.select("measure", pick(1).alias("sign"), "n", "rho", F.coalesce(pick(1) * F.col("rho") > pick(2), F.lit(False)).alias("passed"))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """(n, groups, h): Kruskal–Wallis H with tie correction."""
    ranked = average_ranks(df.where(F.col(value).isNotNull()).select(group, value), value, "r")
    per = ranked.groupBy(group).agg(F.sum("r").alias("s"), F.count("*").alias("m"))
    whole = per.agg(F.sum("m").alias("n"), F.count("*").alias("groups"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q"))
    ties = ranked.groupBy(value).agg(F.count("*").cast("double").alias("tied")).agg(F.sum(F.col("tied") ** 3 - F.col("tied")).alias("ties"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n**3 - n))
    return whole.crossJoin(F.broadcast(ties)).select("n", "groups", h.alias("h"))


def mann_whitney(df: DataFrame, group: str, value: str, first: object, second: object) -> DataFrame:
    """(n1, n2, u): U of the first group."""
    two = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull()).select(group, value)
    ranked = average_ranks(two, value, "r")
    is_first = F.col(group) == F.lit(first)
    s = ranked.agg(F.sum(is_first.cast("long")).alias("n1"), F.sum((~is_first).cast("long")).alias("n2"), F.sum(F.when(is_first, F.col("r"))).alias("s"))
    return s.select("n1", "n2", (F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"))


def kruskal_test(df: DataFrame, group: str, value: str) -> DataFrame:
    """kruskal with its p-value (chi-squared, one degree fewer than the groups)."""
    return kruskal(df, group, value).withColumn("p", chi2_sf("h", (F.col("groups") - 1).cast("int")))


def mann_whitney_test(df: DataFrame, group: str, value: str, first: object, second: object, exact_up_to: int = 8) -> DataFrame:
    """mann_whitney with z and the two-sided p-value.

    p is exact where one group has at most `exact_up_to` rows and no value occurs twice; else it is that of
    the normal approximation, corrected for ties and continuity.
    """
    two = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    ties = two.groupBy(value).agg(F.count("*").cast("double").alias("m")).agg(F.coalesce(F.sum(F.col("m") ** 3 - F.col("m")), F.lit(0.0)).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    far = F.abs(F.col("u") - n1 * n2 / 2) - 0.5
    z = F.signum(F.col("u") - n1 * n2 / 2) * F.greatest(far, F.lit(0.0)) / F.nullif(spread, F.lit(0.0))
    exact = (F.least("n1", "n2") <= exact_up_to) & (F.col("ties") == 0)
    out = mann_whitney(df, group, value, first, second).crossJoin(F.broadcast(ties)).select("n1", "n2", "u", z.alias("z"), exact.alias("exact"))
    return out.withColumn("p", F.when(F.col("exact"), exact_mann_whitney(F.when(F.col("exact"), F.col("u")), "n1", "n2")).otherwise(normal_two_sided("z"))).drop("exact")


def group_test(df: DataFrame, group: str, value: str) -> DataFrame:
    """(test, stat, p) over the groups that are not NULL: Kruskal–Wallis for more than two, Mann–Whitney for two; no row if a group has no value."""
    known = df.where(F.col(group).isNotNull())
    names = [r[0] for r in known.groupBy(group).agg(F.count(value).alias("n")).orderBy(group).where("n > 0").collect()]  # a few groups
    empty = known.groupBy(group).agg(F.count(value).alias("n")).where("n = 0").count()
    if empty or len(names) < 2:
        return df.sparkSession.createDataFrame([], "test string, stat double, p double")
    if len(names) > 2:
        return kruskal_test(known, group, value).select(F.lit("kruskal").alias("test"), F.col("h").alias("stat"), "p")
    return mann_whitney_test(known, group, value, *names).select(F.lit("mann_whitney").alias("test"), F.col("u").cast("double").alias("stat"), "p")


def survival_linear(df: DataFrame, group: str, t: str) -> DataFrame:
    """Sorted times against an even fall from 1 to 0; a group of one row stays at 1. Rows of equal time share its first and last level."""
    counts = df.groupBy(group, t).agg(F.count("*").alias("m"))
    whole = counts.groupBy(F.col(group).alias("_g")).agg(F.sum("m").alias("_n"))
    placed = running_sums(counts, t, {"_before": F.col("m")}, [group]).join(F.broadcast(whole), F.col(group).eqNullSafe(F.col("_g")))
    level = lambda place: F.when(F.col("_n") > 1, 1 - (place - 1) / (F.col("_n") - 1)).otherwise(F.lit(1.0))
    return placed.select(group, t, "m", level(F.col("_before") + 1).alias("level_first"), level(F.col("_before") + F.col("m")).alias("level_last"))


def product_limit(df: DataFrame, group: str, t: str, event: str) -> DataFrame:
    """Product-limit survival after each time with an event: (group, t, at_risk, deaths, survival)."""
    counts = df.groupBy(group, t).agg(F.count("*").alias("m"), F.sum(event).alias("deaths"))
    whole = counts.groupBy(F.col(group).alias("_g")).agg(F.sum("m").alias("_n"))
    risk = running_sums(counts, t, {"_before": F.col("m")}, [group]).join(F.broadcast(whole), F.col(group).eqNullSafe(F.col("_g")))
    risk = risk.select(group, t, (F.col("_n") - F.col("_before")).alias("at_risk"), "deaths").where("deaths > 0")
    share = 1 - F.col("deaths") / F.col("at_risk")
    log = F.when(share > 0, F.ln(share)).otherwise(F.lit(0.0))
    over = F.when(share <= 0, 1).otherwise(0)
    s = running_sums(risk, t, {"_log": log, "_over": over}, [group])
    return s.select(group, t, "at_risk", "deaths", F.when(F.col("_over") + over > 0, F.lit(0.0)).otherwise(F.exp(F.col("_log") + log)).alias("survival"))


def auroc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the curve by rank sums, ties at their mean; 0.5 for a single class."""
    by = by or []
    ranked = average_ranks(df.select(*by, label, score), score, "r", by)
    s = ranked.groupBy(*by).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("q"), F.sum(F.when(F.col(label) == 1, F.col("r"))).alias("s"))
    area = (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif((F.col("p") * F.col("q")).cast("double"), F.lit(0.0))
    return s.select(*by, "p", "q", F.coalesce(area, F.lit(0.5)).alias("auroc"))


def pair_jaccard(sets: DataFrame, run: str, members: str) -> DataFrame:
    """Jaccard of every two runs' member arrays; two empty sets have 0."""
    a, b = sets.select(F.col(run).alias("run_a"), F.col(members).alias("ma")), sets.select(F.col(run).alias("run_b"), F.col(members).alias("mb"))
    both = a.join(b, F.col("run_a") < F.col("run_b"))
    union = F.size(F.array_union("ma", "mb"))
    return both.select("run_a", "run_b", F.when(union > 0, F.size(F.array_intersect("ma", "mb")) / F.nullif(union, F.lit(0))).otherwise(F.lit(0.0)).alias("jaccard"))


def silhouette(m: DataFrame, labels: DataFrame) -> DataFrame:
    """(sample_id, label, s) with Euclidean distances; a sample alone in its cluster has 0.

    Distances are summed per label inside pairs of blocks (see pairs.py).
    """
    per = label_distances(arrays(m).join(labels.select("sample_id", "label"), "sample_id")).withColumn("d", F.col("d") / F.col("n"))
    ab = per.groupBy("i", "li").agg(F.min(F.when(F.col("li") == F.col("lj"), F.col("d"))).alias("a"), F.min(F.when(F.col("li") != F.col("lj"), F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return ab.select(F.col("i").alias("sample_id"), F.col("li").alias("label"), F.coalesce(s, F.lit(0.0)).alias("s"))
