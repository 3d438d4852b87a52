"""Likelihood, gradient, fit, splits, metrics, sources."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlink.operators import align, analysis, diagnostics, fit, jvm, kernels, metrics, model, moments, objective, splits
from strandlink.operators.kernels import Weights
from strandlink.sources import pairs as sources
from strandlink.sources import sinks


def table(spark, rows):
    return spark.createDataFrame(rows, "noncodingRNA string, gene string, label int")


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(2)
    text = lambda n: "".join(rng.choice(list("ACGT"), n))
    rows = [(text(rng.integers(5, 8)), text(20), int(rng.integers(0, 2))) for _ in range(40)]
    return sources.prepared(table(spark, rows)).withColumn("weight", F.lit(1.0)).cache()


@pytest.mark.parametrize("observed", [None, [[0.9, 0.1], [0.2, 0.8]]])
def test_gradient_is_a_finite_difference(small, observed):
    rng = np.random.default_rng(4)
    w = Weights(rng.normal(0.3, 1, (4, 4, 7)), rng.normal(-1, 0.2, 6), rng.normal(-1, 0.2, 7))
    m, alpha = model.Model(w, 0.0), -2.0

    def value(weights):
        rows = small.withColumn("score", align.score_column(F.col("noncodingRNA"), F.col("target_rc"), weights))
        return objective.loglik(rows, alpha, observed)

    rows = align.footprinted(small, m)
    g = objective.gradient(rows, 7, alpha, observed)
    for index in ((0, 0, 0), (1, 1, 3), (2, 3, 2)):
        up, down = w.match.copy(), w.match.copy()
        up[index] += 1e-3
        down[index] -= 1e-3
        slope = (value(Weights(up, w.gap_first, w.gap_second)) - value(Weights(down, w.gap_first, w.gap_second))) / 2e-3
        assert g.match[index] == pytest.approx(slope, abs=5e-3)
    slopes = objective.d_alpha(rows, [alpha], observed)[0]
    assert slopes == pytest.approx((objective.loglik(rows, alpha + 1e-4, observed) - objective.loglik(rows, alpha - 1e-4, observed)) / 2e-4, abs=1e-3)


def test_fit_improves_and_finds_alpha(small):
    found = fit.fit(small, fit.Config(max_iter=3, step_scale=1e-3), weights=False)
    assert found.loglik[-1] > found.loglik[0] and len(found.subgradient) == 3
    assert found.model.weights.length == 7
    noisy = fit.fit(small, fit.Config(max_iter=2, step_scale=1e-3, label_prior="symmetric_90_10", prior_precision=1.0, aligner="glocal", model_length=8))
    assert noisy.model.label_observation and noisy.model.weights.length == 8


def test_stacked_fits_equal_single_ones(small):
    configs = [
        fit.Config(max_iter=2, step_scale=1e-3),
        fit.Config(max_iter=3, step_scale=1e-2, aligner="glocal", label_prior="symmetric_90_10"),
        fit.Config(max_iter=1, step_scale=1e-3, prior_precision=1.0, sample_weight="mirna_gene_sqrt", model_length=9),
        fit.Config(max_iter=2, aligner="nosuch"),
        fit.Config(max_iter=2, model_length=3),
    ]
    found = fit.fit_many(small, configs)
    assert [type(f) for f in found[3:]] == [ValueError, ValueError]
    for config, many in zip(configs[:3], found):
        one = fit.fit(small, config)
        assert many.loglik == pytest.approx(one.loglik) and many.auprc == pytest.approx(one.auprc) and many.subgradient == pytest.approx(one.subgradient)
        assert kernels.flat(many.model.weights) == pytest.approx(kernels.flat(one.model.weights)) and many.model.alpha == pytest.approx(one.model.alpha)
        assert many.model.aligner == config.aligner and len(many.loglik) == config.max_iter


def test_stacked_fits_take_the_jobs_of_one(small):
    def jobs(n):
        small.sparkSession.sparkContext.setJobGroup(f"stack-{n}", "")
        fit.fit_many(small, [fit.Config(max_iter=1, step_scale=1e-4 * (k + 1), label_prior="symmetric_90_10") for k in range(n)])
        small.sparkSession.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(small.sparkSession.sparkContext.statusTracker().getJobIdsForGroup(f"stack-{n}"))

    # A model length is looked up for each configuration; the rest is shared.
    assert jobs(8) <= jobs(1) + 8 * 3


def test_alpha_is_stationary(small):
    rows = align.scored(small, model.Model(model.uniform_weights(8, 1, -1, -1), 0.0))
    a, warning = fit.fit_alpha(rows, 0.0)
    assert warning is None and abs(objective.d_alpha(rows, [a])[0]) < 0.05
    assert fit.newton_alpha(rows, 0.0) == pytest.approx(a, abs=1e-2)


@pytest.mark.parametrize("rows,weight,what", [([], 1.0, "no pairs"), ([("", "A", 1)], 1.0, "empty"), ([("A", "A", 2)], 1.0, "labels"), ([("A", "A", 1)], -1.0, "negative"), ([("A", "A", 1)], 0.0, "positive sum"), ([("A", "A", 1)], float("nan"), "finite")])
def test_rejects(spark, rows, weight, what):
    df = sources.prepared(table(spark, rows)).withColumn("weight", F.lit(weight))
    with pytest.raises(ValueError, match=what):
        fit.validate(df, None)


def test_extreme_scores(spark):
    rows = spark.createDataFrame([(1000.0, 1, 1.0), (-1000.0, 0, 1.0), (900.0, 0, 1.0), (-900.0, 1, 1.0)], "score double, label int, weight double")
    for observed in (None, [[0.9, 0.1], [0.1, 0.9]]):
        assert math.isfinite(objective.loglik(rows, 0.0, observed)) and math.isfinite(objective.d_alpha(rows, [0.0], observed)[0])


def test_step_size():
    f = fit.step_size(2.0, 1.0, 3)
    assert [f(k) for k in (0, 3, 4, 5)] == [2.0, 2.0, 2.0, 1.0]


def test_weights_have_mean_one(spark):
    rows = table(spark, [("mir1", "gene1", 1), ("mir1", "gene2", 0), ("mir2", "gene2", 1), ("mir3", "gene2", 0)])
    for kind in diagnostics.WEIGHTINGS:
        assert diagnostics.sample_weights(rows, kind).agg(F.avg("weight")).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError, match="unknown weighting"):
        diagnostics.sample_weights(rows, "x")


@pytest.mark.parametrize("group,column", [("mirna", "noncodingRNA"), ("gene", "gene")])
def test_group_split(spark, group, column):
    rows = table(spark, [(f"m{i if group == 'mirna' else 2 * i + j}", f"g{i if group == 'gene' else 2 * i + j}", j) for i in range(8) for j in range(2)])
    out = splits.group_split(rows, group, 0.25, 1)
    sides = out.groupBy(column).agg(F.countDistinct("held_out").alias("n"))
    assert sides.where("n > 1").count() == 0
    assert out.where("held_out").select(column).distinct().count() == 2
    assert out.groupBy("held_out").agg(F.countDistinct("label").alias("n")).where("n = 2").count() == 2


def test_metrics_edges(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 0), ("a", 0.5, 1), ("one", 1.0, 1), ("bad", float("nan"), 1), ("bad", 1.0, 0)], "split string, score double, label int")
    got = {r["split"]: r for r in metrics.ranking_metrics(rows, ["split"]).collect()}
    assert got["a"]["ap"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3) and got["a"]["roc_auc"] == pytest.approx(0.25)
    assert got["one"]["ap"] == 1.0 and math.isnan(got["one"]["roc_auc"]) and math.isnan(got["bad"]["ap"])
    whole = metrics.ranking_metrics(rows.where("split = 'a'"), []).first()
    assert whole["ap"] == pytest.approx(got["a"]["ap"])


def test_validation(spark):
    good = sources.prepared(sources.validated(table(spark, [("acgt", "ttaa", 1)]))).first()
    assert (good["noncodingRNA"], good["target_rc"]) == ("ACGT", "TTAA")
    with pytest.raises(ValueError, match="unsupported nucleotide"):
        sources.validated(table(spark, [("ACGN", "A", 1)]))
    with pytest.raises(ValueError, match="label"):
        sources.validated(table(spark, [("A", "A", None)]))
    with pytest.raises(ValueError, match="missing"):
        sources.validated(spark.range(1))
    with pytest.raises(ValueError, match="no rows"):
        sources.validated(table(spark, []), allow_empty=False)


def test_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("noncodingRNA\tgene\tlabel\tmore\nacg\tttt\t1\tx\n")
    (tmp_path / "b.csv").write_text("noncodingRNA,gene,label\nACG,TTT,0\n")
    named = sources.read_named(spark, f"{tmp_path}/a.tsv, two={tmp_path}/b.csv")
    assert list(named) == ["a", "two"] and named["a"].columns == list(sources.REQUIRED)
    assert named["a"].first()["label"] == 1
    with pytest.raises(ValueError, match="twice"):
        sources.parse_named("x=1,x=2")
    catalog = sources.Catalog()
    catalog.add("t_train", "t", "train", lambda s: named["a"])
    catalog.add("t_test", "t", "test", lambda s: named["two"])
    both = sources.load_splits(spark, catalog, "t_train")
    assert {r["split"]: r["split_ord"] for r in both.collect()} == {"train": 0, "t_test": 1}
    with pytest.raises(ValueError, match="t_test, t_train"):
        catalog.resolve("x")
    assert not sinks.write_csv(both.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    sinks.save_json(spark, {"a": np.float64("nan"), "b": np.array([1, 2]), "c": tmp_path}, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": None, "b": [1, 2], "c": str(tmp_path)}
    assert catalog.listing(spark).count() == 2 and catalog.describe(spark, "t_test").count() == 5
    public = sources.Catalog.of_folder(str(tmp_path / "public"))
    assert public.resolve("manakov_leftout") == ("AGO2_eCLIP_Manakov2022", "leftout") and public.listing(spark).count() == 6


def test_workflow(spark, tmp_path):
    from strandlink.plans import workflow

    rng = np.random.default_rng(3)
    text = lambda n: "".join(rng.choice(list("ACGT"), n))
    mk = lambda n: table(spark, [(text(6), text(12), k % 2) for k in range(n)])
    both = diagnostics.union_splits({"train": mk(30), "other": mk(10)})
    todo = workflow.configs({"aligner": ("local", "nosuch"), "max_iter": (1,)})
    assert [c.index for c in todo] == [1, 2] and todo[0].name.startswith("cfg_0001_local")
    out = workflow.search(spark, both, todo, workers=2, final_max_iter=1)
    assert [r["status"] for r in out.results] == ["ok", "error"] and out.errors == out.results[1:]
    assert out.best_evaluation.flat.keys() == {f"{m}_{s}" for m in ("ap", "roc_auc") for s in ("fit", "validation", "other")}
    assert out.refit.evaluation.flat.keys() == {"ap_train", "roc_auc_train", "ap_other", "roc_auc_other"}
    assert out.refit.summary["config"] == f"final_refit_{todo[0].name}" and out.refit.summary["config_index"] == 0
    assert {"ap_fit", "roc_auc_fit", "roc_auc_validation"} <= out.results[0].keys()
    assert {"aligner", "step_scale", "iteration", "loglik"} <= out.trajectories[0].keys() and "ap_validation" in out.results[0]
    workflow.save_outcome(spark, out, str(tmp_path))
    best = tmp_path / "best_grid_model"
    assert json.loads((best / "parameters.json").read_text())["fitted"]["aligner"] == "local"
    assert json.loads((best / "selected_summary.json").read_text())["summary"]["ap_other"] == pytest.approx(out.best_evaluation.flat["ap_other"])
    names = ("summary", "errors", "trajectories", "metrics", "metric_slices", "pr_points", "roc_points")
    read = {n: spark.read.option("header", True).csv(str(tmp_path / f"{n}.csv")) for n in names}
    assert read["summary"].count() == 2 and read["errors"].first()["status"] == "error"
    assert {r["split"] for r in read["metrics"].collect()} == {"fit", "validation"} and {r["config"] for r in read["pr_points"].collect()} == {todo[0].name}
    assert {p.name for p in (tmp_path / "final_refit").iterdir()} >= {"summary.csv", "trajectory.csv", "metrics.csv", "roc_points.csv", "model"}
    assert {p.name for p in (best / "evaluation").iterdir()} >= {"summary.csv", "metrics.csv", "metric_slices.csv", "pr_points.csv"}
    assert workflow.evaluate_saved(spark, both, str(best / "model.parquet")).flat["ap_other"] == pytest.approx(out.best_evaluation.flat["ap_other"])


def test_search_without_refit_or_evaluation(spark, monkeypatch):
    from strandlink.plans import workflow

    both = diagnostics.union_splits({"train": table(spark, [("ACG" + "ACGT"[k % 4] + "ACGT"[k // 4 % 4] + "AC"[k % 2], "GATTACA" * 2, k % 2) for k in range(32)]), "other": table(spark, [("ACGTA", "GATTACA", 1), ("ACG", "AC", 0)])})
    todo = workflow.configs({"max_iter": (1,)})
    bare = workflow.search(spark, both, todo, skip_evaluation=True, final_max_iter=3)
    assert bare.best and bare.refit is None and bare.best_evaluation is None and "ap_validation" not in bare.results[0]
    held = workflow.search(spark, both, todo)
    assert held.refit is None and "ap_other" in held.selected
    real = workflow.fit_many

    def failing(rows, configs, **options):
        if configs[0].label:
            raise RuntimeError("no refit today")
        return real(rows, configs, **options)

    monkeypatch.setattr(workflow, "fit_many", failing)
    broken = workflow.search(spark, both, todo, final_max_iter=2)
    assert broken.results[0]["status"] == "ok" and broken.refit.fit is None and [e["error"] for e in broken.errors] == ["RuntimeError: no refit today"]


def test_evaluate_only_writes_every_split(spark, tmp_path):
    from strandlink.plans import workflow

    model.save_model(spark, model.Model(*model.baseline_weights(22)), str(tmp_path / "model"))
    for name, rows in (("fit", [("A" * 22, "A" * 30, 1), ("C" * 21, "T" * 30, 0)]), ("heldout", [("A" * 22, "A" * 30, 1), ("G" * 21, "G" * 30, 0)])):
        (tmp_path / f"{name}.csv").write_text("noncodingRNA,gene,label\n" + "".join(f"{a},{b},{y}\n" for a, b, y in rows))
    splits = {n: sources.read_delimited(spark, str(tmp_path / f"{n}.csv")) for n in ("fit", "heldout")}
    out = workflow.evaluate_saved(spark, diagnostics.union_splits(splits), str(tmp_path / "model"))
    out.save(str(tmp_path / "out"), {"config": "baseline"}, "fit")
    read = lambda n: spark.read.option("header", True).csv(str(tmp_path / "out" / f"{n}.csv"))
    assert {r["split"] for r in read("metrics").collect()} == {"fit", "heldout"}
    assert {r["slice_type"] for r in read("metric_slices").collect()} == set(diagnostics.SLICES)
    assert read("summary").first()["config"] == "baseline" and read("pr_points").count() and read("roc_points").count()
    assert workflow.aligner_precision(sources.prepared(splits["fit"]), model.Model(*model.baseline_weights(22))) in (0.5, 1.0)


def test_defaults():
    from strandlink.plans import workflow

    a = workflow.options().parse_args([])
    assert len(workflow.configs(workflow.grid_of(a))) == 160 and workflow.grid_of(a) == workflow.GRID
    assert (a.step_power, a.split_seed, a.final_max_iter, a.top_entities) == (0.5, 42, 500, 20)
    assert model.label_prior("none") is None
    assert model.label_prior("symmetric_95_5")[0][0] == 950 and model.label_prior("symmetric_90_10")[0][1] == 100 and model.label_prior("symmetric_80_20")[1][0] == 200


def test_small_parts(spark):
    w, alpha = model.from_coefficients({"0_is_match": 2.0, "1_is_mismatch": -1.0, "Gap_miR": -3.0, "Gap_gene": -4.0, "intercept": 0.5}, 3)
    assert w.match[0, 0, 0] == 2 and w.match[0, 1, 1] == -1 and w.match[0, 0, 2] == 0 and alpha == 0.5
    assert w.gap_first.tolist() == [-3, -3] and w.gap_second.tolist() == [-4, -4, -4]
    assert model.rescaled(np.array([3.0, 4.0]), np.array([0.0, 1.0])).tolist() == pytest.approx([0.6, 0.8])
    rows = table(spark, [("ACGT", "A", 1), ("ACG", "A", 0)])
    assert model.starting_point(rows)[0].length == 4 and model.starting_point(rows, 9)[0].length == 9
    means = {r["kind"]: r["mean"] for r in model.mean_weights(model.model_params(spark, model.Model(*model.baseline_weights(5)))).collect()}
    assert means == pytest.approx({"match": model.BASELINE_MATCH, "mismatch": model.BASELINE_MISMATCH})


def plain_logistic(x, y, penalty=0.0, rounds=60):
    """Newton steps on the mean loss with half the penalty times the squared coefficients, the intercept free."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    free = np.diag([penalty] * (len(w) - 1) + [0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x / len(x) + free, x.T @ (p - y) / len(x) + free @ w)
    return w


def feature_rows(spark, n=240):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(n, 2)) + rng.integers(0, 3, n)[:, None] * 4
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1])))).astype(int)
    return x, y, spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, label int").cache()


@pytest.mark.parametrize("penalty", [0.0, 0.3])
def test_regression_by_plain_newton(spark, penalty):
    x, y, rows = feature_rows(spark)
    _, found = analysis.logistic_regression(rows, ["a", "b"], penalty)
    assert [found[k] for k in ("a", "b", "intercept")] == pytest.approx(plain_logistic(x, y, penalty).tolist(), abs=2e-3)


def test_out_of_fold(spark):
    x, y, rows = feature_rows(spark)
    out = analysis.out_of_fold(rows, ["a", "b"], ["id"], folds=3).collect()
    assert sorted(r["id"] for r in out) == list(range(len(y)))
    fold = np.zeros(len(y), int)
    for r in out:
        fold[r["id"]] = r["fold"]
    for f in range(3):
        w = plain_logistic(x[fold != f], y[fold != f])
        for r in out:
            if r["fold"] == f:
                assert r["probability"] == pytest.approx(1 / (1 + np.exp(-(x[r["id"]] @ w[:2] + w[2]))), abs=5e-3)


def test_clusters_by_plain_distances(spark):
    x, _, rows = feature_rows(spark)
    out, centres = analysis.clusters(rows, ["a", "b"], 3)
    own = {r["id"]: r["cluster"] for r in out.collect()}
    near = ((x[:, None, :] - np.array(centres)[None]) ** 2).sum(2)
    assert [own[i] for i in range(len(x))] == near.argmin(1).tolist()
    for c in range(3):
        assert x[near.argmin(1) == c].mean(0) == pytest.approx(centres[c], abs=0.05)


def test_clipped_probability(spark):
    from strandlink.functions.sequences import TINY, clip_probability

    rows = spark.createDataFrame([(0.0,), (0.5,), (1.5,)], "p double")
    assert [r[0] for r in rows.select(clip_probability(F.col("p"))).collect()] == [TINY, 0.5, 1.0]


def test_scores_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text("noncodingRNA,score\nACG,1.5\nAAA,2\n")
    assert sources.read_scores(spark, str(tmp_path / "s.csv")).dtypes == [("noncodingRNA", "string"), ("score", "double")]


def test_noise_and_intercept_at_the_maximum(spark):
    rng = np.random.default_rng(4)
    score = rng.normal(size=400) * 3
    true = rng.random(400) < 1 / (1 + np.exp(-(score - 1)))
    label = np.where(rng.random(400) < 0.1, ~true, true).astype(int)
    rows = spark.createDataFrame([(float(s), int(y), 1.0) for s, y in zip(score, label)], "score double, label int, weight double").cache()
    prior = [[90.0, 10.0], [10.0, 90.0]]

    def value(alpha, a, b):
        p = 1 / (1 + np.exp(-(score + alpha)))
        q = np.where(label == 1, b * p + (1 - a) * (1 - p), (1 - b) * p + a * (1 - p))
        return np.log(q).sum() + 90 * np.log(a) + 10 * np.log(1 - a) + 10 * np.log(1 - b) + 90 * np.log(b)

    noise = fit.fit_noise(rows, -1.0, [[0.8, 0.2], [0.3, 0.7]], prior)
    best = value(-1.0, noise[0][0], noise[1][1])
    assert all(best >= value(-1.0, noise[0][0] + d, noise[1][1] + e) for d in (-1e-3, 0, 1e-3) for e in (-1e-3, 0, 1e-3))
    alpha, warning = fit.fit_alpha(rows, 5.0, noise)
    assert warning is None
    assert all(value(alpha, noise[0][0], noise[1][1]) >= value(alpha + d, noise[0][0], noise[1][1]) for d in (-0.01, 0.01))


def test_grouped_precision(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(float(rng.integers(0, 40)), int(rng.integers(0, 2))) for _ in range(500)], "score double, label int").repartition(3)
    tally = rows.groupBy("score", "label").agg(F.count("*").alias("n"))
    assert fit.grouped_precision(tally) == pytest.approx(metrics.average_precision(rows, []).first()["ap"])
    assert fit.grouped_precision(tally.where("label = 1")) == 1.0 and math.isnan(fit.grouped_precision(tally.limit(0)))


def test_few_jobs_a_round(spark):
    rows = sources.prepared(table(spark, [("ACGTAC", "GTACGTAA", 1), ("ACCTAC", "TTTTTTTT", 0), ("GGGTAC", "GTACCCAA", 1)]))
    spark.sparkContext.setJobGroup("fit-rounds", "")
    fit.fit(rows, fit.Config(max_iter=2, label_prior="symmetric_90_10"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit-rounds"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 60, jobs


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from strandlink.storage import shared_dir

    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))


def test_stream_scores(spark, tmp_path):
    from strandlink.streaming.scoring import rejected_stream, scored_stream

    table(spark, [("ACG", "CGT", 1), ("ANG", "A", 0), ("", "A", 1), ("ACGTA", "A", 1), ("AC", None, 0)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("noncodingRNA string, gene string, label int").parquet(str(tmp_path / "in"))
    q = scored_stream(stream, model.Model(model.uniform_weights(4, 5, -4, -6), 0.0)).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["score"] for r in spark.table("scored").collect()] == [15.0]
    batch = spark.read.schema("noncodingRNA string, gene string, label int").parquet(str(tmp_path / "in"))
    left = {(r["noncodingRNA"], r["column"], r["reason"]) for r in rejected_stream(batch, model.Model(model.uniform_weights(4, 5, -4, -6), 0.0)).collect()}
    assert left == {("ANG", "noncodingRNA", "unsupported nucleotide"), ("", "noncodingRNA", "empty first sequence"), ("ACGTA", "noncodingRNA", "first sequence longer than the model"), ("AC", "gene", "unsupported nucleotide")}


@pytest.mark.parametrize("observed", [None, [[0.9, 0.1], [0.2, 0.8]]])
def test_sums_by_intercept_of_arrays(spark, observed):
    """Sums over arrays at many intercepts are those of the columns."""
    from strandlink.operators import objective

    rng = np.random.default_rng(8)
    score, label, weight = rng.normal(0, 30, 300), rng.integers(0, 2, 300), rng.random(300)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in zip(score, label, weight)], "score double, label double, weight double")
    alphas = np.linspace(-40, 40, 7)
    assert objective.sums_by_alpha(score, label, weight, alphas, observed).T == pytest.approx(np.array(objective.by_alpha(rows, alphas.tolist(), observed)))


def test_jvm_footprints_equal_the_kernels(spark):
    rng = np.random.default_rng(8)
    text = lambda low, high: "".join(rng.choice(list(kernels.BASES), int(rng.integers(low, high))))
    rows = [(text(0, 9), text(0, 14)) for _ in range(120)] + [("", ""), ("A", ""), ("", "C"), ("ACGTACGT", "ACGTACGT")]
    pairs = spark.createDataFrame(rows, "a string, b string")
    whole = rng.integers(-3, 4, 18 * 8 - 1).astype(float)
    for flat in (rng.normal(0, 1.5, 18 * 8 - 1), whole, kernels.flat(model.baseline_weights(8)[0])):
        w = kernels.unflat(flat, 8)
        for local in (True, False):
            foot = jvm.footprint(spark, F.col("a"), F.col("b"), w, local)
            found = [(r["f"]["score"], bytes(r["f"]["slots"])) for r in pairs.select(foot.alias("f")).collect()]
            wanted = [None] * len(rows)
            for places, score, slots, offsets in kernels.footprint_slots(*map(list, zip(*rows, strict=True)), w, local):
                for k, place in enumerate(places.tolist()):
                    wanted[place] = float(score[k]), slots[offsets[k] : offsets[k + 1]].tobytes()
            assert found == wanted
    plain = model.baseline_weights(8)[0]
    for bad in (("ACNT", "A"), ("A", "Ä"), ("A" * 9, "A"), (None, "A")):
        with pytest.raises(Exception, match="unsupported nucleotide|has 9 bases|sequence is null"):
            spark.createDataFrame([bad], "a string, b string").select(jvm.footprint(spark, F.col("a"), F.col("b"), plain, True)).collect()


def test_fits_are_the_same_without_the_jvm(small, monkeypatch):
    def fits():
        configs = [fit.Config(max_iter=3), fit.Config(max_iter=2, aligner="glocal", label_prior="symmetric_90_10")]
        return [(f.loglik, f.auprc, f.subgradient, f.model.alpha) for f in fit.fit_many(small, configs)]

    found = fits()
    monkeypatch.setenv("STRANDLINK_JVM", "0")
    for a, b in zip(found, fits(), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y, rel=1e-12)


def test_sums_from_moments_are_those_of_the_rows(spark):
    rng = np.random.default_rng(9)
    score = np.concatenate([rng.normal(3, 9, 400), rng.integers(-3, 9, 100), [0.0, -1e-17, 40.5, -37.0]])
    rows = [(0, float(s), int(rng.integers(0, 2)), float(rng.uniform(0, 3))) for s in score]
    table = spark.createDataFrame(rows, "c int, score double, label int, weight double")
    nodes = moments.nodes(table)[0]
    for alpha in (-6.3, 0.0, 2.5):
        for noise in (None, [[0.9, 0.1], [0.2, 0.8]], [[1 - 1e-6, 1e-6], [1e-5, 1 - 1e-5]]):
            exact = objective.sums_by_alpha(*(np.array(x, float) for x in list(zip(*rows, strict=True))[1:]), np.array([alpha]), noise)
            assert objective.sums_by_alpha(*nodes, np.array([alpha]), noise) == pytest.approx(exact, rel=1e-11)
            if noise:
                sums = table.agg(*objective.eta_columns(alpha, noise)).first()
                assert objective.eta_sums(*nodes, alpha, noise) == pytest.approx(list(sums), rel=1e-10)
        assert objective.terms_at(*nodes, alpha) == pytest.approx(objective.alpha_terms(table, alpha), rel=1e-11)
    assert moments.nodes(spark.createDataFrame([(0, math.nan, 1, 1.0)], table.schema)) is None
    assert not moments.smooth([[1.0, 0.0], [0.1, 0.9]]) and moments.smooth(None)
    assert moments.nodes(table.limit(0)) == {}


def test_rounds_of_a_fit_take_few_jobs(spark):
    rows = spark.createDataFrame([("ACGTACGT", "ACGTTCGA", 1), ("CCCCAAAA", "ACGGTCGA", 0)] * 10, "noncodingRNA string, target_rc string, label int")

    def jobs(rounds):
        spark.sparkContext.setJobGroup(f"rounds-{rounds}", "")
        fit.fit(rows, fit.Config(max_iter=rounds, label_prior="symmetric_90_10"))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{rounds}"))

    few, more = jobs(2), jobs(4)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert more - few <= 2 * 14, (few, more)
