"""Regression summaries and label issues against plain versions."""

import math

import numpy as np
import pytest

from strandlink.operators import analysis


def data(n=300, seed=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * (1, 3)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.7 * x[:, 0] - 0.4 * x[:, 1] + 0.3)))).astype(int)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(k, float(a), float(b), 0.0, int(c)) for k, ((a, b), c) in enumerate(zip(x, y))], "id long, `a b` double, c double, zero double, label int").repartition(3)


def test_inference_equals_plain(spark):
    x, y = data()
    found = analysis.inference(frame(spark, x, y), ["a b", "c", "zero"])
    z = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        h = (z.T * (p * (1 - p))) @ z
        beta += np.linalg.solve(h, z.T @ (y - p))
    errors = np.sqrt(np.diag(np.linalg.inv(h)))
    assert found.coefficients[[0, 1, 3]] == pytest.approx(beta, abs=1e-8) and found.coefficients[2] == 0
    assert found.errors[[0, 1, 3]] == pytest.approx(errors, rel=1e-6) and math.isnan(found.errors[2])
    loglik = -np.logaddexp(0, np.where(y == 1, -(z @ beta), z @ beta)).sum()
    null = len(y) * (y.mean() * math.log(y.mean()) + (1 - y.mean()) * math.log(1 - y.mean()))
    assert found.loglik == pytest.approx(loglik) and found.ratio == pytest.approx(2 * (loglik - null)) and not found.separated
    name, b, e, score, p, low, high = found.rows()[0]
    assert name == "a b" and score == pytest.approx(beta[0] / errors[0]) and 0 < p < 1 and high - low == pytest.approx(2 * 1.959964 * e, rel=1e-5)


@pytest.mark.parametrize("x,df,p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (0.0, 3, 1.0), (0.0, 2, 1.0), (20.515, 5, 0.001)])
def test_chi_square(x, df, p):
    assert analysis.chi_square_tail(x, df) == pytest.approx(p, rel=1e-3)


def test_separated_labels(spark):
    rows = spark.createDataFrame([(float(k), int(k > 10)) for k in range(20)], "a double, label int")
    assert analysis.inference(rows, ["a"]).separated
    assert analysis.inference(rows.where("label = 1"), ["a"]).separated


def plain_issues(p, y):
    t = [np.mean(1 - p[y == 0]), np.mean(p[y == 1])]
    counts = np.zeros((2, 2))
    for q, label in zip(p, y):
        able = [j for j, v in enumerate((1 - q, q)) if v >= t[j]]
        if able:
            best = max(able, key=lambda j: ((1 - q, q)[j], j == label))
            counts[label, best] += 1
    out = np.zeros(len(p), bool)
    own = np.where(y == 1, p, 1 - p)
    for i in (0, 1):
        flipped = math.floor(counts[i, 1 - i] / counts[i].sum() * (y == i).sum() + 0.5)
        if flipped:
            out |= (y == i) & (own <= np.sort(own[y == i])[flipped - 1])
    return counts.astype(int).tolist(), out


def test_label_issues_equal_plain(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    p = np.clip(np.round(np.where(y == 1, 0.75, 0.3) + rng.normal(0, 0.25, 400), 2), 0.01, 0.99)
    rows = spark.createDataFrame([(k, float(a), int(b)) for k, (a, b) in enumerate(zip(p, y))], "id long, probability double, label int").repartition(3)
    counts, issues = plain_issues(p, y)
    joint = analysis.confident_joint(rows)
    assert joint.counts == counts and sum(map(sum, joint.joint)) == pytest.approx(1.0)
    found = {r["id"]: r for r in analysis.label_issues(rows).collect()}
    assert [found[k]["issue"] for k in range(400)] == issues.tolist()
    ranks = sorted((r["issue_rank"], r["self_confidence"]) for r in found.values() if r["issue"])
    assert [r for r, _ in ranks] == list(range(1, len(ranks) + 1)) and [c for _, c in ranks] == sorted(c for _, c in ranks)
    assert all(r["issue_rank"] is None for r in found.values() if not r["issue"])


def test_planted_flips_are_found(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 2)) * 2
    true = (x[:, 0] - x[:, 1] + rng.normal(0, 0.5, 800) > 0).astype(int)
    flipped = rng.random(800) < 0.08
    rows = frame(spark, x, np.where(flipped, 1 - true, true))
    found = analysis.label_issues(analysis.out_of_fold(rows, ["a b", "c"], ["id"], folds=4))
    issue = np.zeros(800, bool)
    for r in found.where("issue").select("id").collect():
        issue[r["id"]] = True
    assert (issue & flipped).sum() / issue.sum() > 0.7 and (issue & flipped).sum() / flipped.sum() > 0.7


def test_label_issues_of_odd_tables(spark):
    schema = "probability double, label int"
    assert analysis.label_issues(spark.createDataFrame([], schema)).count() == 0
    one = analysis.label_issues(spark.createDataFrame([(0.9, 1), (0.2, 1), (None, 1)], schema)).collect()
    assert not any(r["issue"] for r in one) and len(one) == 3
