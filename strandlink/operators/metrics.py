"""Ranking metrics as aggregates.

Rows are grouped by score first, so that ties are one point. Cumulative counts
come from ranges of scores, cut at quantiles: totals of the ranges before, and a window within each
range, so that no task holds all scores of a group. Rows with null or non-finite scores
make a group's metrics NaN, as an empty group's are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def _keys(by: list[str]) -> list[Column]:
    return [F.col(c) for c in by]


def score_groups(rows: DataFrame, by: list[str], score: str = "score", label: str = "label", buckets: int = 256) -> DataFrame:
    """Each distinct finite score with ``p`` positives, ``n`` rows, cumulative ``tp`` and ``k`` from the top.

    ``pos`` and ``all`` are the totals of the group.
    """
    return placed_groups(grouped_scores(rows, by, score, label).where(FINITE), by, buckets)


#: Whether a score can be ranked.
FINITE = "score is not null and not isnan(score) and abs(score) <> double('inf')"


def grouped_scores(rows: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Each distinct score, finite or not, with ``p`` positives and ``n`` rows; stored, as all that follows reads it
    several times and the score may be costly."""
    points = rows.groupBy(*_keys(by), F.col(score).cast("double").alias("score"))
    return stored(points.agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n")))


def placed_groups(points: DataFrame, by: list[str], buckets: int = 256) -> DataFrame:
    """``score_groups`` of distinct scores that are grouped already."""
    points = _bucketed(points, by, "score", buckets)
    sums = points.groupBy(*_keys(by), "__b").agg(F.sum("p").alias("__p"), F.sum("n").alias("__n"))
    over = Window.partitionBy(*by).orderBy("__b") if by else Window.partitionBy(F.lit(0)).orderBy("__b")
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sums = sums.select(
        *by,
        "__b",
        (F.sum("__p").over(over) - F.col("__p")).alias("__p0"),
        (F.sum("__n").over(over) - F.col("__n")).alias("__n0"),
        F.sum("__p").over(every).alias("pos"),
        F.sum("__n").over(every).alias("all"),
    )
    points = _with(points, sums, [*by, "__b"])
    inner = Window.partitionBy(*by, "__b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return points.select(*by, "score", "p", "n", (F.col("__p0") + F.sum("p").over(inner)).alias("tp"), (F.col("__n0") + F.sum("n").over(inner)).alias("k"), "pos", "all")


def _bucketed(points: DataFrame, by: list[str], value: str, buckets: int = 256) -> DataFrame:
    """``points`` with ``__b``: ranges of ``value`` in each group with about as many points each, 0 at the top."""
    shares = [k / buckets for k in range(1, buckets)]
    ends = points.groupBy(*_keys(by)).agg(F.percentile_approx(value, shares, 10_000).alias("__ends"))
    points = _with(points, ends, by)
    above = F.aggregate("__ends", F.lit(0), lambda n, e: n + F.when(e > F.col(value), 1).otherwise(0))
    return points.withColumn("__b", above).drop("__ends")


def _counted(points: DataFrame, by: list[str], value: str) -> DataFrame:
    """``points`` with ``__i``, their place from 0 by falling ``value`` in each group, and ``__total``."""
    points = _bucketed(points, by, value)
    sizes = points.groupBy(*_keys(by), "__b").agg(F.count("*").alias("__n"))
    group = by or [F.lit(0)]
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__b")) - F.col("__n")
    sizes = sizes.select(*by, "__b", before.alias("__before"), F.sum("__n").over(Window.partitionBy(*group)).alias("__total"))
    points = _with(points, sizes, [*by, "__b"])
    inner = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(F.desc(value)))
    return points.withColumn("__i", (F.col("__before") + inner - 1).cast("int")).drop("__b", "__before")


def _with(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Inner join on null-safe keys; with no keys every row gets the one row of ``right``."""
    if not by:
        return left.crossJoin(right)
    other = right.select(*(F.col(c).alias(f"__r_{c}") if c in by else F.col(c) for c in right.columns))
    on = None
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        on = same if on is None else on & same
    return left.join(other, on).drop(*(f"__r_{c}" for c in by))


def average_precision(rows: DataFrame, by: list[str], **names) -> DataFrame:
    """``ap`` of each group: the sum over distinct scores of recall gained times precision."""
    return ranking_metrics(rows, by, **names).select(*by, "ap")


def roc_auc(rows: DataFrame, by: list[str], **names) -> DataFrame:
    """``roc_auc`` of each group, ties counted half."""
    return ranking_metrics(rows, by, **names).select(*by, "roc_auc")


def ranking_metrics(rows: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """``pairs, positives, negatives, ap, roc_auc`` of each group.

    A group of one class has its mean label as ``ap`` and NaN as ``roc_auc``.
    """
    grouped = grouped_scores(rows, by, score, label)
    bad = F.sum(F.when(~F.expr(FINITE), F.col("n")).otherwise(0))
    totals = grouped.groupBy(*_keys(by)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.sum("p").alias("positives"), bad.alias("__bad"))
    points = placed_groups(grouped.where(FINITE), by)
    sums = points.groupBy(*_keys(by)).agg(
        F.sum(F.col("p") * F.col("tp") / F.col("k")).alias("__ap"),
        F.sum((F.col("n") - F.col("p")) * (F.col("tp") - F.col("p") / 2)).alias("__auc"),
    )
    nan = F.lit(float("nan"))
    pos, neg = F.col("positives"), F.col("pairs") - F.col("positives")
    if by:
        renamed = sums.select(*(F.col(c).alias(f"__r_{c}") for c in by), "__ap", "__auc")
        on = F.lit(True)
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        joined = totals.join(renamed, on, "left")
    else:
        joined = totals.crossJoin(sums)
    one = (pos == 0) | (neg == 0)
    broken = (F.col("__bad") > 0) | (F.col("pairs") == 0)
    ap = F.when(broken, nan).when(one, pos / F.col("pairs")).otherwise(F.col("__ap") / pos)
    auc = F.when(broken | one, nan).otherwise(F.col("__auc") / (pos * neg))
    return joined.select(*by, "pairs", F.coalesce(pos, F.lit(0)).alias("positives"), F.coalesce(neg, F.lit(0)).alias("negatives"), ap.alias("ap"), auc.alias("roc_auc"))


def pr_points(rows: DataFrame, by: list[str], **names) -> DataFrame:
    """``point_index, threshold, precision, recall`` by rising threshold; the last point is (1, 0) without threshold."""
    points = _counted(stored(score_groups(rows, by, **names)), by, "score")
    recall = F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(1.0)
    own = F.struct(F.col("score").alias("threshold"), (F.col("tp") / F.col("k")).alias("precision"), recall.alias("recall"), (F.col("__total") - 1 - F.col("__i")).cast("int").alias("point_index"))
    last = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.col("__total").cast("int").alias("point_index"))
    # The point of the greatest score brings the closing point with it.
    out = points.select(*by, F.explode(F.when(F.col("__i") == 0, F.array(own, last)).otherwise(F.array(own))).alias("x"))
    return out.select(*by, "x.*")


def roc_points(rows: DataFrame, by: list[str], **names) -> DataFrame:
    """``point_index, threshold, fpr, tpr`` by falling threshold from infinity; points on a straight line are dropped.

    A point's neighbours are joined by their places.
    """
    points = _counted(stored(score_groups(rows, by, **names)), by, "score")
    at = F.struct((F.col("__i") + 1).alias("i"), F.col("score").alias("threshold"), (F.col("k") - F.col("tp")).alias("fp"), F.col("tp").alias("tp"))
    first = F.struct(F.lit(0).alias("i"), F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("tp"))
    curve = points.select(*by, (F.col("all") - F.col("pos")).alias("neg"), "pos", "__total", F.explode(F.when(F.col("__i") == 0, F.array(first, at)).otherwise(F.array(at))).alias("x"))
    curve = stored(curve.select(*by, "neg", "pos", "__total", "x.*"))
    near = curve.select(*by, F.explode(F.array(F.struct((F.col("i") + 1).alias("i"), "fp", "tp"), F.struct((F.col("i") - 1).alias("i"), "fp", "tp"))).alias("y")).select(*by, "y.*")
    # The two neighbours of a place add up to twice the point where the three lie evenly on a line.
    near = near.groupBy(*_keys(by), "i").agg(F.sum("fp").alias("sfp"), F.sum("tp").alias("stp"))
    bend = _with(curve, near, [*by, "i"])
    inner = (F.col("i") > 0) & (F.col("i") < F.col("__total"))
    kept = bend.where(~inner | (F.col("sfp") != 2 * F.col("fp")) | (F.col("stp") != 2 * F.col("tp")))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(float("nan"))
    kept = kept.select(*by, "threshold", rate("fp", "neg").alias("fpr"), rate("tp", "pos").alias("tpr"), (-F.col("i")).alias("__place"))
    return _counted(stored(kept), by, "__place").withColumnRenamed("__i", "point_index").drop("__total", "__place")


def chance_level(rows: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """The share of positives: the precision of a random order."""
    return rows.groupBy(*_keys(by)).agg(F.avg(F.col(label).cast("double")).alias("chance"))
