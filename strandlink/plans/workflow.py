"""Grid search, selection by validation metrics, refit and evaluation."""

from __future__ import annotations

import argparse
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics, metrics
from ..operators.align import scored
from ..operators.fit import Config, Fit, described, fit_many, summary, trajectory
from ..operators.model import Model, load_model
from ..operators.places import ranked
from ..operators.splits import group_split, stratified_split
from ..sources import pairs as sources
from ..sources import sinks
from ..storage import stored

#: The default grid.
GRID = {
    "aligner": ("local", "glocal"),
    "step_scale": (1e-5, 1.2e-5, 5e-5, 1e-4, 5e-4),
    "step_decay_burnin": (300,),
    "prior_precision": (0.0, 1.0),
    "label_prior": ("none", "symmetric_95_5", "symmetric_90_10", "symmetric_80_20"),
    "sample_weight": ("none", "mirna_gene_sqrt"),
    "max_iter": (100,),
}
#: Names of the grid's options on the command line.
OPTIONS = {"aligner": "aligners", "step_scale": "step-scales", "step_decay_burnin": "step-decay-burnins", "prior_precision": "prior-precisions", "label_prior": "label-priors", "sample_weight": "sample-weights", "max_iter": "max-iters"}


def config_grid(spark: SparkSession, grid: dict[str, tuple] | None = None, limit: int = 0) -> DataFrame:
    """All combinations as rows in nested-loop order, with ``config_index`` from 1; the first ``limit``, or all for 0."""
    grid = grid or GRID
    total = math.prod(map(len, grid.values()))
    rows = spark.range(0, min(limit, total) if limit else total, 1, 1).select((F.col("id") + 1).cast("int").alias("config_index"))
    stride = total
    for name, values in grid.items():
        stride //= len(values)
        place = F.floor((F.col("config_index") - 1) / stride) % len(values) + 1
        rows = rows.withColumn(name, F.element_at(F.array(*map(F.lit, values)), place.cast("int")))
    return rows


def configs(grid: dict[str, tuple] | None = None, limit: int = 0, **fixed) -> list[Config]:
    grid = grid or GRID
    found = [Config(**dict(zip(grid, values, strict=True)), index=k, **fixed) for k, values in enumerate(product(*grid.values()), 1)]
    return found[:limit] if limit else found


def ranked_configs(results: DataFrame) -> DataFrame:
    """Successful results with ``rank`` from 1 by validation metrics; missing and NaN come last, ties by index."""
    low = F.lit(-math.inf)
    key = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), low), low)
    order = [key("ap_validation").desc(), key("roc_auc_validation").desc(), F.col("config_index").asc()]
    return ranked(results.where("status = 'ok'"), order, "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


@dataclass
class Evaluation:
    metrics: DataFrame
    slices: DataFrame | None
    pr: DataFrame
    roc: DataFrame
    flat: dict[str, float] = field(default_factory=dict)

    def named(self, config: str) -> dict[str, DataFrame]:
        """The tables by name, with the configuration's name as a column."""
        tables = {"metrics": self.metrics, "metric_slices": self.slices, "pr_points": self.pr, "roc_points": self.roc}
        return {name: df.withColumn("config", F.lit(config)) for name, df in tables.items() if df is not None}

    def save(self, folder: str, config: dict, reference: str | None = None) -> None:
        """All tables as CSV, with the configuration's name, and drawings of each split's curves against the reference split's."""
        sinks.save_records(self.metrics.sparkSession, [config | {"status": "ok", "error": ""} | self.flat], f"{folder}/summary.csv")
        save_tables(self.named(config.get("config", "")), folder)
        self.draw(folder, config.get("config", ""), reference)

    def draw(self, folder: str, config: str, reference: str | None) -> None:
        if reference:
            for kind, points, x, y in (("pr", self.pr, "recall", "precision"), ("roc", self.roc, "fpr", "tpr")):
                for split, panels in sinks.curves(points, x, y, reference).items():
                    sinks.draw(panels, f"{config}: {reference} vs {split}", f"{folder}/{kind}_curves/{config}_{reference}_vs_{split}.png")


#: The order of the rows of each table.
ORDERS = {"metrics": ("config", "split"), "metric_slices": ("config", "split", "slice_type", "slice_value"), "pr_points": ("config", "split", "point_index"), "roc_points": ("config", "split", "point_index")}


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        sinks.write_csv(df, f"{folder}/{name}.csv", ORDERS[name])


def evaluate(splits: DataFrame, model: Model, reference: DataFrame | None = None) -> Evaluation:
    """Metrics, slices and curves of every split of ``splits(split, noncodingRNA, target_rc, gene, label)``.

    Pairs are aligned once; their scores and all tables are stored.
    """
    rows = stored(scored(splits, model).select("split", "noncodingRNA", "gene", "label", F.col("logit").alias("score")))
    found = stored(metrics.ranking_metrics(rows, ["split"]))
    flat = {}
    for r in found.collect():  # a row to a split
        flat[f"ap_{r['split']}"], flat[f"roc_auc_{r['split']}"] = r["ap"], r["roc_auc"]
    slices = diagnostics.metric_slices(rows, reference)
    return Evaluation(found, None if slices is None else stored(slices), stored(metrics.pr_points(rows, ["split"])), stored(metrics.roc_points(rows, ["split"])), flat)


def aligner_precision(pairs: DataFrame, model: Model) -> float:
    """The average precision of a model's scores on one table of pairs."""
    return metrics.average_precision(scored(pairs, model), []).first()["ap"]


def train_validation(train: DataFrame, strategy: str, fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    if strategy == "random":
        rows = stratified_split(train, fraction, seed, ["noncodingRNA", "gene"])
    elif strategy in ("group_mirna", "group_gene"):
        rows = group_split(train, strategy.removeprefix("group_"), fraction, seed)
    else:
        raise ValueError(f"unknown split strategy {strategy!r}")
    sides = rows.where(~F.col("held_out")).drop("held_out"), rows.where("held_out").drop("held_out")
    for name, side in zip(("fit", "validation"), sides, strict=True):
        if side.agg(F.countDistinct("label")).first()[0] < 2:
            raise ValueError(f"{name} must have both labels")
    return sides


@dataclass
class Run:
    """One configuration: its row, and what came of it unless it failed."""

    config: Config
    summary: dict
    fit: Fit | None = None
    evaluation: Evaluation | None = None

    @property
    def trajectory(self) -> list[dict]:
        return trajectory(self.config, self.fit) if self.fit else []


def named_splits(**splits: DataFrame) -> DataFrame:
    """Tables of pairs as one, with their names as ``split``."""
    rows = [df.select("noncodingRNA", "target_rc", "gene", "label").withColumn("split", F.lit(name)) for name, df in splits.items()]
    return reduce(DataFrame.unionByName, rows)


def run_configs(rows: DataFrame, splits: DataFrame | None, todo: list[Config], folder: str | None = None, reference: DataFrame | None = None) -> list[Run]:
    """Fits ``rows`` under every configuration in the same passes and evaluates ``splits``, if any; an exception becomes a row of status 'error'.

    With a ``folder`` fits keep their state there, and go on from what a run before has left. What ends the common
    passes ends only the configuration that it came from: they are run one by one then.
    """

    def failed(config: Config, e: Exception) -> Run:
        return Run(config, described(config) | {"status": "error", "error": f"{type(e).__name__}: {e}", "final_loglik": math.nan})

    try:
        found = fit_many(rows, todo, folders=[f"{folder}/states/{c.name}" for c in todo] if folder else None)
    except Exception as e:
        if len(todo) == 1:
            return [failed(todo[0], e)]
        return [run for c in todo for run in run_configs(rows, splits, [c], folder, reference)]
    out = []
    for config, one in zip(todo, found, strict=True):
        try:
            if isinstance(one, Exception):
                raise one
            row = summary(config, one)
            evaluation = None if splits is None else evaluate(splits, one.model, rows if reference is None else reference)
            out.append(Run(config, row | (evaluation.flat if evaluation else {}), one, evaluation))
        except Exception as e:
            out.append(failed(config, e))
    return out


@dataclass
class Outcome:
    """The runs of a search in the grid's order, the best of them with its evaluation on all splits, and the refit."""

    runs: list[Run]
    best: Run | None = None
    best_evaluation: Evaluation | None = None
    refit: Run | None = None

    @property
    def results(self) -> list[dict]:
        return [r.summary for r in self.runs]

    @property
    def errors(self) -> list[dict]:
        return [r.summary for r in [*self.runs, *([self.refit] if self.refit else [])] if r.summary["status"] == "error"]

    @property
    def trajectories(self) -> list[dict]:
        return [t for r in self.runs for t in r.trajectory]

    @property
    def selected(self) -> dict:
        """The best run's row, with its metrics on all splits."""
        return {} if self.best is None else self.best.summary | (self.best_evaluation.flat if self.best_evaluation else {})


def search(
    spark: SparkSession,
    splits: DataFrame,
    todo: list[Config],
    strategy: str = "random",
    fraction: float = 0.2,
    seed: int = 42,
    workers: int = 1,
    final_max_iter: int = 0,
    skip_evaluation: bool = False,
    folder: str | None = None,
    stacked: int = 16,
) -> Outcome:
    """Fits every configuration on part of ``train`` and ranks them on the rest; evaluates the best on all splits, and its refit on all of ``train``.

    ``stacked`` configurations share each pass over the pairs; ``workers`` such groups run as threads, whose jobs Spark
    schedules side by side. A refit that fails is a row of status 'error'. With ``skip_evaluation`` there is neither evaluation nor refit, and the first
    configuration that could be fitted is the best.
    """
    ready = sources.prepared(splits)
    train = stored(ready.where("split = 'train'").drop("split", "split_ord"))
    others = stored(ready.where("split <> 'train'"))
    length = sources.longest(ready)
    fit_rows, validation = (stored(x) for x in train_validation(train, strategy, fraction, seed))
    todo = [replace(c, model_length=c.model_length or length, split_strategy=strategy) for c in todo]
    shown = None if skip_evaluation else named_splits(fit=fit_rows, validation=validation)
    with ThreadPoolExecutor(max(workers, 1)) as pool:
        groups = [todo[k : k + stacked] for k in range(0, len(todo), stacked)]
        out = Outcome([run for runs in pool.map(lambda g: run_configs(fit_rows, shown, g, folder), groups) for run in runs])
    good = lambda r, k: -math.inf if r.get(k) is None or math.isnan(r[k]) else r[k]
    out.best = min((r for r in out.runs if r.fit), key=lambda r: (-good(r.summary, "ap_validation"), -good(r.summary, "roc_auc_validation"), r.config.index), default=None)
    if out.best is None or skip_evaluation:
        return out
    held = named_splits(**{r["split"]: others.where(F.col("split") == r["split"]) for r in others.select("split").distinct().collect()}) if not others.isEmpty() else None
    if held is not None:
        out.best_evaluation = evaluate(shown.unionByName(held), out.best.fit.model, fit_rows)
    if final_max_iter > 0:
        again = replace(out.best.config, max_iter=final_max_iter, index=0, label=f"final_refit_{out.best.config.name}")
        whole = named_splits(train=train)
        out.refit = run_configs(train, whole if held is None else whole.unionByName(held), [again], folder, train)[0]
    return out


def evaluate_saved(spark: SparkSession, splits: DataFrame, path: str) -> Evaluation:
    """A stored model on all splits. Slices refer to a split ``fit`` or ``train``; without one there are none."""
    model = load_model(spark, path)
    ready = sources.prepared(splits)
    if sources.longest(ready) > model.length:
        raise ValueError("the splits have longer first sequences than the model")
    names = {r["split"] for r in ready.select("split").distinct().collect()}  # a row to a split
    reference = next((n for n in ("fit", "train") if n in names), None)
    return evaluate(ready, model, ready.where(F.col("split") == reference) if reference else None)


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Searches a grid of fits, or evaluates a stored model.")
    p.add_argument("--dataset", help="catalog family whose train and test splits are read")
    p.add_argument("--datasets-dir", default="datasets", help="folder with a Parquet table to each alias of the catalog")
    p.add_argument("--eval-splits", help="aliases of the catalog, comma-separated")
    p.add_argument("--train", help="training file, in place of a dataset")
    p.add_argument("--eval-files", default="", help="name=path,...")
    p.add_argument("--results-dir", default="results")
    p.add_argument("--run-tag", default="")
    p.add_argument("--trained-model", help="stored model")
    p.add_argument("--evaluate-only", action="store_true")
    p.add_argument("--skip-evaluation", action="store_true")
    p.add_argument("--split-strategy", default="random", choices=("random", "group_mirna", "group_gene"))
    p.add_argument("--validation-fraction", type=float, default=0.2)
    p.add_argument("--split-seed", type=int, default=42)
    for name, option in OPTIONS.items():
        p.add_argument(f"--{option}", dest=name, default=",".join(map(str, GRID[name])))
    p.add_argument("--step-power", type=float, default=0.5)
    p.add_argument("--model-length", type=int)
    p.add_argument("--limit-configs", type=int, default=0)
    p.add_argument("--config-workers", type=int, default=1)
    p.add_argument("--stacked-configs", type=int, default=16, help="configurations that share each pass over the pairs")
    p.add_argument("--final-max-iter", type=int, default=500)
    p.add_argument("--top-entities", type=int, default=20)
    return p


def read_splits(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The splits that the options name."""
    catalog = sources.Catalog.of_folder(a.datasets_dir)
    train = f"{a.dataset}_train" if a.dataset and not a.evaluate_only else None
    if a.train and not a.evaluate_only:
        catalog.add("train_file", "files", "train", lambda s: sources.read_delimited(s, a.train))
        train = "train_file"
    tests = None if a.eval_splits is None and a.dataset and not a.evaluate_only else [x.strip() for x in (a.eval_splits or "").split(",") if x.strip()]
    return sources.load_splits(spark, catalog, train, tests, a.eval_files, a.skip_evaluation)


def grid_of(a: argparse.Namespace) -> dict[str, tuple]:
    return {k: tuple(type(v[0])(x.strip()) for x in getattr(a, k).split(",") if x.strip()) for k, v in GRID.items()}


def save_run(spark: SparkSession, run: Run, folder: str) -> None:
    """The artefacts of a run's model in ``folder``."""
    sinks.save_artefacts(spark, folder, run.fit.model, described(run.config), run.summary, run.trajectory)


def save_outcome(spark: SparkSession, out: Outcome, folder: str) -> None:
    """Rows and tables of all configurations, the artefacts of each, and the best's and the refit's in folders of their own."""
    for run in out.runs:
        if run.fit:
            save_run(spark, run, f"{folder}/model_artifacts/{run.config.name}")
        if run.evaluation:
            run.evaluation.draw(folder, run.config.name, "fit")
    if out.best:
        best = f"{folder}/best_grid_model"
        sinks.copy_folder(spark, f"{folder}/model_artifacts/{out.best.config.name}", best)
        sinks.save_json(spark, {"selected_from": "grid", "summary": out.selected}, f"{best}/selected_summary.json")
        if out.best_evaluation:
            out.best_evaluation.save(f"{best}/evaluation", out.best.summary, "fit")
    if out.refit:
        final = f"{folder}/final_refit"
        sinks.save_records(spark, [out.refit.summary], f"{final}/summary.csv")
        sinks.save_records(spark, out.refit.trajectory, f"{final}/trajectory.csv")
        if out.refit.fit:
            save_run(spark, out.refit, f"{final}/model")
            save_tables(out.refit.evaluation.named(out.refit.config.name), final)
            out.refit.evaluation.draw(final, out.refit.config.name, "train")
    sinks.save_records(spark, out.results, f"{folder}/summary.csv")
    sinks.save_records(spark, out.errors, f"{folder}/errors.csv")
    sinks.save_records(spark, out.trajectories, f"{folder}/trajectories.csv")
    tables: dict[str, list[DataFrame]] = {}
    for run in out.runs:
        for name, df in (run.evaluation.named(run.config.name) if run.evaluation else {}).items():
            tables.setdefault(name, []).append(df)
    save_tables({name: reduce(DataFrame.unionByName, parts) for name, parts in tables.items()}, folder)


def main(argv: list[str] | None = None) -> int:
    parser = options()
    a = parser.parse_args(argv)
    if a.evaluate_only and not a.trained_model:
        parser.error("--evaluate-only needs --trained-model")
    spark = SparkSession.builder.getOrCreate()
    folder = "/".join(x for x in (a.results_dir, a.run_tag or a.dataset) if x)
    splits = stored(read_splits(spark, a))
    for name, df in diagnostics.diagnostics(splits, a.top_entities).items():
        sinks.write_csv(df, f"{folder}/{name}.csv")
    if a.evaluate_only:
        found = evaluate_saved(spark, splits, a.trained_model)
        row = {"config": f"evaluate_{PurePosixPath(a.trained_model).stem}", "model": a.trained_model, "max_iter": 0, "evaluation_only": True}
        found.save(folder, row, next((n for n in ("fit", "train") if f"ap_{n}" in found.flat), None))
        sinks.save_json(spark, {"selected_from": "trained_model", "summary": row | found.flat}, f"{folder}/best_grid_model/selected_summary.json")
        return 0
    todo = configs(grid_of(a), a.limit_configs, step_power=a.step_power, model_length=a.model_length, dataset=a.dataset or "")
    out = search(spark, splits, todo, a.split_strategy, a.validation_fraction, a.split_seed, a.config_workers, a.final_max_iter, a.skip_evaluation, folder, a.stacked_configs)
    save_outcome(spark, out, folder)
    return 0


def main_table(families: tuple[str, ...] = ("hejret",), evaluation: str = "hejret_test,manakov_test,manakov_leftout", more: tuple[str, ...] = ()) -> int:
    """One run of the default grid for each training family, evaluated on the same splits."""
    for family in families:
        main(["--dataset", family, "--eval-splits", evaluation, "--run-tag", f"train_{family}_eval_all", *more])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
