"""Splits and samples by hashes of keys: the same for every partitioning and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diagnostics import ENTITIES

ATTEMPTS = 50


def seeded(seed: int | str, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def _border(keys: DataFrame, by: list[str], share: float, key: list[str]) -> DataFrame:
    """For each group the hash and key of the last of its first ``ceil(share * n)`` keys, as ``last``; no row where there is none.

    ``keys`` has ``h``. Counts by four hex digits lead to the digits of the last key, so that a task sorts one key in 65,536
    of a group. What is joined to the keys is a row a group, and broadcast.
    """
    head = F.substring("h", 1, 4)
    sums = keys.groupBy(*by, head.alias("at")).agg(F.count("*").alias("n"))
    over = Window.partitionBy(*by)
    sums = sums.withColumns({"before": F.sum("n").over(over.orderBy("at")) - F.col("n"), "goal": F.ceil(F.sum("n").over(over) * F.lit(share))})
    goal = sums.where("before < goal and goal <= before + n").select(*by, "at", (F.col("goal") - F.col("before")).alias("left"))
    near = keys.join(F.broadcast(goal), by).where(head == F.col("at"))
    placed = near.withColumn("r", F.row_number().over(over.orderBy("h", *key)))
    return placed.where(F.col("r") == F.col("left")).select(*by, F.struct("h", *key).alias("last"))


def stratified_split(pairs: DataFrame, fraction: float, seed: int, key: list[str]) -> DataFrame:
    """``pairs`` with ``held_out``: of each label the first ``ceil(fraction * n)`` keys in seeded order.

    ``key`` names columns that identify a row; rows of one label that share them stay together.
    """
    h = seeded(seed, *key)
    border = _border(pairs.select("label", *key).distinct().withColumn("h", h), ["label"], fraction, key)
    held = F.coalesce(F.struct(h.alias("h"), *key) <= F.col("last"), F.lit(False))
    return pairs.join(F.broadcast(border), "label", "left").withColumn("held_out", held).select(*pairs.columns, "held_out")


def group_split(pairs: DataFrame, group: str, fraction: float, seed: int, attempts: int = ATTEMPTS) -> DataFrame:
    """``pairs`` with ``held_out``, whole groups ('mirna' or 'gene') on one side.

    Attempts are seeded orders of the groups; the first that leaves both labels on
    both sides is taken.
    """
    column = ENTITIES[group]
    per = pairs.groupBy(column).agg(F.max((F.col("label") == 1).cast("int")).alias("has1"), F.max((F.col("label") == 0).cast("int")).alias("has0")).persist()
    try:
        for attempt in range(attempts):
            chosen = _chosen_groups(per, column, fraction, f"{seed}:{attempt}" if attempt else str(seed))
            sides = per.join(chosen, column, "left").groupBy(F.col("held_out").isNotNull().alias("side")).agg(F.max("has1").alias("a"), F.max("has0").alias("b")).collect()
            if len(sides) == 2 and all(s["a"] and s["b"] for s in sides):
                return pairs.join(chosen, column, "left").withColumn("held_out", F.coalesce("held_out", F.lit(False))).select(*pairs.columns, "held_out")
    finally:
        per.unpersist()
    raise ValueError(f"no split of {group} groups has both labels on both sides after {attempts} attempts")


def _chosen_groups(per: DataFrame, column: str, fraction: float, seed: str) -> DataFrame:
    keys = per.select(column).withColumn("h", seeded(seed, column)).withColumn("one", F.lit(0))
    near = keys.join(F.broadcast(_border(keys, ["one"], fraction, [column])), "one")
    return near.where(F.struct("h", column) <= F.col("last")).select(column).withColumn("held_out", F.lit(True))


def sample_rows(rows: DataFrame, k: int, seed: int, key: list[str]) -> DataFrame:
    """``k`` rows without replacement, in seeded order."""
    return rows.orderBy(seeded(seed, *key), *key).limit(k)
