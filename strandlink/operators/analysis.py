"""Further analyses: regressions on alignment features, clusters, label issues, conflicts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import conflicting, likelihood_bands, sigmoid, softplus
from ..storage import stored
from .fit import normal_equations
from .places import ranked
from .quantiles import order_statistics
from .splits import seeded


def tallied(rows: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """The distinct rows of ``columns`` with ``n``: how many there are, or the sum of their ``weight``."""
    number = F.sum(F.col(weight).cast("double")) if weight else F.count("*").cast("double")
    return rows.groupBy(*(F.col(f"`{c}`") for c in columns)).agg(number.alias("n"))


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows)


def logistic_regression(rows: DataFrame, features: list[str], penalty: float = 0.0, weight: str | None = None) -> tuple[LogisticRegressionModel, dict[str, float]]:
    """A logistic regression of ``label``, unpenalised by default; its coefficients by name, with ``intercept``.

    Equal rows are fitted as one of their common weight, so that steps run over distinct ones.
    """
    lr = LogisticRegression(labelCol="label", regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9, weightCol="n")
    model = lr.fit(assembled(tallied(rows, ["label", *features], weight), features))
    return model, dict(zip(features, map(float, model.coefficients), strict=True)) | {"intercept": float(model.intercept)}


def clusters(rows: DataFrame, features: list[str], k: int = 3, seed: int = 1, weight: str | None = None) -> tuple[DataFrame, list[list[float]]]:
    """``rows`` with ``cluster``, and the centres. ``weight`` names how much a row counts."""
    means = KMeans(k=k, seed=seed, weightCol=weight) if weight else KMeans(k=k, seed=seed)
    model = means.fit(assembled(rows, features))
    out = model.transform(assembled(rows, features)).drop("features").withColumnRenamed("prediction", "cluster")
    return out, [list(map(float, c)) for c in model.clusterCenters()]


def out_of_fold(rows: DataFrame, features: list[str], key: list[str], folds: int = 5, seed: int = 1, penalty: float = 0.0) -> DataFrame:
    """``rows`` with ``probability`` of label 1 from models that haven't seen the row's fold."""
    rows = rows.withColumn("fold", (F.conv(F.substring(seeded(seed, *key), 1, 6), 16, 10).cast("long") % folds).cast("int"))
    out = None
    for f in range(folds):
        model, _ = logistic_regression(rows.where(F.col("fold") != f), features, penalty)
        part = model.transform(assembled(rows.where(F.col("fold") == f), features))
        part = part.withColumn("p", F.element_at(vector_to_array("probability"), 2)).select(*rows.columns, F.col("p").alias("probability"))
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class ConfidentJoint:
    """Of labels 0 and 1: thresholds, counts by given and confident label, and the joint share that they are scaled to."""

    thresholds: tuple[float, float]
    counts: list[list[int]]
    joint: list[list[float]]
    rows: tuple[int, int]

    def flipped(self, label: int) -> int:
        """How many rows of a label truly have the other."""
        return math.floor(self.joint[label][1 - label] * sum(self.rows) + 0.5)


def confident_counts(rows: DataFrame, probability: str = "probability") -> DataFrame:
    """``label, confident, n, t0, t1``: rows by given label and by the label that they are confidently of, null for neither.

    A label's threshold is the mean probability of it over the rows that carry it. A row is confidently of the labels
    whose threshold its probability reaches, and of the likelier of two (its own where both are as likely).
    """
    p, own = F.col(probability), F.col("label")
    means = rows.agg(F.avg(F.when(own == 0, 1 - p)).alias("t0"), F.avg(F.when(own == 1, p)).alias("t1"))
    zero, one = 1 - p >= F.col("t0"), p >= F.col("t1")
    both = F.when(p > 0.5, 1).when(p < 0.5, 0).otherwise(own)
    confident = F.when(zero & one, both).when(one, 1).when(zero, 0)
    return rows.where(own.isin(0, 1)).crossJoin(means).groupBy("label", confident.cast("int").alias("confident"), "t0", "t1").agg(F.count("*").alias("n"))


def confident_joint(rows: DataFrame, probability: str = "probability") -> ConfidentJoint:
    """Estimates how labels are confused: each label's confident counts, scaled to all rows that carry it."""
    counts, sizes, thresholds = [[0, 0], [0, 0]], [0, 0], (math.nan, math.nan)
    for r in confident_counts(rows, probability).collect():  # six rows at most
        sizes[r["label"]] += r["n"]
        if r["confident"] is not None:
            counts[r["label"]][r["confident"]] = r["n"]
        thresholds = tuple(math.nan if r[t] is None else r[t] for t in ("t0", "t1"))
    total = sum(sizes)
    joint = [[0.0, 0.0], [0.0, 0.0]]
    for i, row in enumerate(counts):
        if sizes[i]:
            # Rows of no confident label leave their own label.
            share = [x / sum(row) for x in row] if sum(row) else [float(j == i) for j in (0, 1)]
            joint[i] = [x * sizes[i] / total for x in share]
    return ConfidentJoint(thresholds, counts, joint, tuple(sizes))


def label_issues(rows: DataFrame, probability: str = "probability") -> DataFrame:
    """``rows`` with ``self_confidence``, the probability of their own label, ``issue``, and ``issue_rank``.

    As many rows of a label as the joint takes for flipped are issues: those of least self-confidence, and what ties with
    the last of them. Issues are ranked from 1 by self-confidence, others have a null rank. Rows without a probability are none.
    """
    points = stored(rows.select("label", F.col(probability).alias("p")))
    joint = confident_joint(points, "p")
    own = F.when(F.col("label") == 1, F.col(probability)).otherwise(1 - F.col(probability))
    least = points.withColumn("own", F.when(F.col("label") == 1, F.col("p")).otherwise(1 - F.col("p")))
    cuts = order_statistics(least, "own", {i: joint.flipped(i) for i in (0, 1)}, "label")
    marked = rows.withColumn("self_confidence", own)
    issue = F.lit(False)
    for i, cut in cuts.items():
        if not math.isnan(cut):
            issue = issue | ((F.col("label") == i) & (F.col("self_confidence") <= cut))
    marked = stored(marked.withColumn("issue", F.coalesce(issue, F.lit(False))))
    found = ranked(marked.where("issue"), [F.col("self_confidence").asc()], "issue_rank").withColumn("issue_rank", (F.col("issue_rank") + 1).cast("long"))
    return found.unionByName(marked.where("not issue").withColumn("issue_rank", F.lit(None).cast("long")))


@dataclass
class Inference:
    """A logistic regression's coefficients with their errors, and tests; ``separated`` if some direction splits the labels."""

    names: list[str]
    coefficients: np.ndarray
    errors: np.ndarray
    loglik: float
    null_loglik: float
    n: int
    rounds: int
    separated: bool

    def rows(self) -> list[tuple[str, float, float, float, float, float, float]]:
        """``feature, coefficient, std_error, z, p_value, low, high``: p of two sides, an interval of 95 %."""
        out = []
        for name, b, e in zip(self.names, self.coefficients.tolist(), self.errors.tolist(), strict=True):
            z = b / e if e else math.nan
            out.append((name, b, e, z, math.erfc(abs(z) / math.sqrt(2)), b - Z95 * e, b + Z95 * e))
        return out

    @property
    def ratio(self) -> float:
        """The likelihood ratio statistic against the intercept alone."""
        return 2 * (self.loglik - self.null_loglik)

    @property
    def ratio_p(self) -> float:
        return chi_square_tail(self.ratio, len(self.names) - 1)


#: The normal quantile of 0.975.
Z95 = 1.959963984540054


def chi_square_tail(x: float, df: int) -> float:
    """The probability of more than ``x``: sums that end for whole degrees of freedom."""
    if df < 1:
        return math.nan
    half = max(x, 0.0) / 2
    if df % 2 == 0:
        return min(1.0, sum(math.exp(-half + k * math.log(half) - math.lgamma(k + 1)) if half else float(k == 0) for k in range(df // 2)))
    tail = math.erfc(math.sqrt(half))
    return min(1.0, tail + sum(math.exp(-half + (k + 0.5) * math.log(half) - math.lgamma(k + 1.5)) for k in range(df // 2))) if half else 1.0


def inference(rows: DataFrame, features: list[str], rounds: int = 50, tolerance: float = 1e-9) -> Inference:
    """An unpenalised logistic regression of ``label`` with an intercept by Newton steps, one pass each, and its observed information.

    Labels that some direction of the features splits have no maximum: steps end once all rows are as good as certain, or
    the information is singular, and ``separated`` says so; errors then mean nothing. A feature that is always 0 has
    coefficient 0 and error NaN.
    """
    names = [*features, "intercept"]
    # Equal rows are one, so that passes run over distinct ones.
    data = tallied(rows, ["label", *features]).select("n", F.col("label").cast("double").alias("label"), *(F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)), F.lit(1.0).alias(f"f{len(features)}")).persist()
    columns = [f"f{i}" for i in range(len(names))]
    beta, value, h = np.zeros(len(names)), -math.inf, np.eye(len(names))

    def terms(beta):
        eta = sum((F.col(c) * F.lit(float(b)) for c, b in zip(columns, beta, strict=True)), F.lit(0.0))
        fitted = data.withColumn("eta", eta).withColumn("probability", sigmoid(F.col("eta")))
        value = F.sum(-F.col("n") * softplus(F.when(F.col("label") == 1, -F.col("eta")).otherwise(F.col("eta"))))
        r = fitted.agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("pos"), value.alias("value")).first()
        return r, *normal_equations(fitted, columns, times="n")

    try:
        r, h, g = terms(beta)
        n, pos, value = int(r["n"] or 0), r["pos"] or 0.0, r["value"] or 0.0
        null = sum(k * math.log(k / n) for k in (pos, n - pos) if k)
        separated = pos in (0.0, float(n))
        for k in range(1, rounds + 1):
            if separated:
                break
            step = np.linalg.lstsq(h, g, rcond=None)[0]
            r, h2, g2 = terms(beta + step)
            while r["value"] < value and np.abs(step).max() > tolerance:
                step /= 2
                r, h2, g2 = terms(beta + step)
            beta, value, h, g = beta + step, r["value"], h2, g2
            separated = value > -1e-6 * n
            if np.abs(step).max() < tolerance:
                break
        else:
            separated = True
    finally:
        data.unpersist()
    used = np.diag(h) > 0
    errors = np.full(len(names), math.nan)
    some = h[np.ix_(used, used)]
    if used.any() and np.linalg.cond(some) < 1e14:
        errors[used] = np.sqrt(np.diag(np.linalg.inv(some)))
    return Inference(names, beta, errors, value, null, n, k, bool(separated))


def with_conflicts(rows: DataFrame, conflicts: DataFrame, key: list[str], limit: float = 25.0) -> DataFrame:
    """Drops rows that scores against other datasets contradict; ``conflicts`` has ``best_positive`` and ``best_negative``."""
    joined = rows.join(conflicts, key, "left")
    bad = F.coalesce(conflicting(F.col("label"), F.col("best_positive"), F.col("best_negative"), limit), F.lit(False))
    return joined.where(~bad).select(*rows.columns)


def band_counts(rows: DataFrame, alpha: float) -> DataFrame:
    """How many rows are in each band of probability."""
    p: Column = sigmoid(F.col("score") + F.lit(alpha))
    return rows.agg(*(F.count_if(c).alias(name) for name, c in likelihood_bands(p, F.col("label")).items()))


def feature_sums(rows: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Each row's sums over groups of feature columns."""
    return rows.withColumns({name: sum((F.col(f"`{c}`") for c in columns[1:]), F.col(f"`{columns[0]}`")) for name, columns in groups.items()})
