"""Sinks: CSV folders, JSON files, the artefacts of a fit, drawings."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.model import Model, baseline_weights, save_model
from ..storage import stored


#: Rows that go into one file at most.
ONE_FILE = 1_000_000


def write_csv(df: DataFrame, path: str, order: tuple[str, ...] = (), one_file: int = ONE_FILE) -> bool:
    """A CSV folder with a header and sorted columns; nothing at all for no rows.

    The plan is run once. Up to ``one_file`` rows are one file, more stay in as many as there are ranges of ``order``
    or tasks; rows are in ``order`` within files and from one file to the next.
    """
    rows = stored(df.select(*(f"`{c}`" for c in sorted(df.columns))))
    n = rows.count()
    if not n:
        return False
    if n <= one_file:
        rows = rows.repartition(1)
    elif order:
        rows = rows.repartitionByRange(*order)
    rows = rows.sortWithinPartitions(*order) if order else rows
    rows.write.mode("overwrite").option("header", True).csv(path)
    return True


def save_records(spark: SparkSession, records: list[dict[str, Any]], path: str) -> bool:
    """A CSV folder of driver records, all as text; a column that a record lacks is empty."""
    columns = sorted(set().union(*records))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    plain = [[str(r[c]) if r.get(c) is not None else None for c in columns] for r in records]
    return bool(columns) and write_csv(spark.createDataFrame(plain, schema), path)


def encoded_json(value: Any) -> str:
    """``value`` as JSON: arrays as lists, other objects as text, values that aren't finite as null."""
    text = json.dumps(value, default=lambda x: x.tolist() if hasattr(x, "tolist") else str(x))
    return json.dumps(json.loads(text, parse_constant=lambda _: None), indent=2, sort_keys=True)


def save_json(spark: SparkSession, value: Any, path: str) -> None:
    """One JSON file in any file system that Spark writes to."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
    try:
        stream.write(bytearray(encoded_json(value).encode()))
    finally:
        stream.close()


def save_artefacts(spark: SparkSession, folder: str, model: Model, config: dict, summary: dict, trajectory: list[dict]) -> dict[str, str]:
    """The model, what led to it and how the fit went, each under its name in ``folder``; the names' paths."""
    start = Model(*baseline_weights(model.length), model.aligner)
    facts = {"config": config, "summary": summary, "start": start.facts(), "fitted": model.facts()}
    writers: dict[str, Callable[[str], Any]] = {
        "model.parquet": partial(save_model, spark, model),
        "parameters.json": partial(save_json, spark, facts),
        "trajectory": partial(save_records, spark, trajectory),
        "convergence.png": partial(draw, convergence(trajectory), str(config.get("config", ""))),
    }
    paths = {name: f"{folder}/{name}" for name in writers}
    for name, write in writers.items():
        write(paths[name])
    return paths


def copy_folder(spark: SparkSession, source: str, target: str) -> None:
    """Copies a folder; what stood at the target is replaced."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs_a, fs_b = a.getFileSystem(conf), b.getFileSystem(conf)
    if fs_b.exists(b):
        fs_b.delete(b, True)
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs_a, a, fs_b, b, False, conf)


#: A panel of a drawing: names of the axes, and points by legend.
Panel = tuple[str, str, dict[str, list[tuple[float, float]]]]


def convergence(trajectory: list[dict]) -> list[Panel]:
    """Likelihood and length of the subgradient by round."""
    series = lambda key: [(r["iteration"], r[key]) for r in trajectory if r.get(key) == r.get(key)]
    return [("round", name, {name: series(key)}) for name, key in (("log-likelihood", "loglik"), ("subgradient", "subgradient_l2")) if series(key)]


def curves(points: DataFrame, x: str, y: str, reference: str) -> dict[str, list[Panel]]:
    """A panel for each split of ``points(split, point_index, <x>, <y>)`` with the reference split's curve beside its own.

    A curve comes to the driver as at most 1,000 points, evenly chosen by place.
    """
    sizes = points.groupBy("split").agg(F.max("point_index").alias("last"))
    step = F.greatest(F.lit(1), F.ceil(F.col("last") / 998))
    few = points.join(sizes, "split").where((F.col("point_index") % step == 0) | (F.col("point_index") == F.col("last")))
    lines: dict[str, list[tuple[float, float]]] = {}
    for r in few.orderBy("split", "point_index").select("split", x, y).collect():  # bounded for each split
        lines.setdefault(r["split"], []).append((r[x], r[y]))
    return {s: [(x, y, {k: lines[k] for k in (reference, s)})] for s in lines if s != reference and reference in lines}


def draw(panels: list[Panel], title: str, path: str) -> bool:
    """A PNG with a panel above the other; False without a drawing library or points."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        return False
    if not panels:
        return False
    figure, axes = pyplot.subplots(len(panels), squeeze=False)
    for ax, (x, y, lines) in zip(axes[:, 0], panels, strict=True):
        for name, points in lines.items():
            ax.plot(*zip(*points, strict=True), label=name)
        ax.set(xlabel=x, ylabel=y)
        ax.legend()
    figure.suptitle(title)
    figure.savefig(path)
    pyplot.close(figure)
    return True
