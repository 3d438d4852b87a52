"""Helpers shared by the corpus operators: lineage cuts, batches, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import shared_dir
from ..storage import stored as stash

#: Rows to an Arrow batch; long texts make larger batches too heavy for an executor.
ARROW_ROWS = 1000


def free(columns: list[str]) -> Callable[[str], str]:
    """Names for an operator's own columns beside ``columns``, whatever those are called."""
    taken, mark = [c.lower() for c in columns], "__"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return lambda name: f"{mark}{name}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def light_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches unless the session already has its own bound."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


#: What an operator keeps in a worker's process from one task to the next.
_kept: dict[str, object] = {}


def kept(owner: str | None, make: Callable[[], object] | None = None) -> object:
    """What ``owner`` keeps in this process. What others keep is dropped, as workers outlive their operators."""
    for other in [k for k in _kept if k != owner]:
        del _kept[other]
    if owner is not None and make is not None and owner not in _kept:
        _kept[owner] = make()
    return _kept.get(owner)


def pieces(batches, column: str = "text", most: int = 1 << 20, owner: str | None = None):
    """Slices of record batches with at most ``most`` bytes of ``column``, one row at least."""
    kept(owner)
    try:
        yield from _pieces(batches, column, most)
    finally:
        trim()


def _pieces(batches, column: str, most: int):
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def trim() -> None:
    """Gives memory that a task has freed back to the system, as its worker may lie idle for long."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges_of(spark: SparkSession, size: int | None, held: int = 32 << 20) -> int:
    """A power of two of ranges by which the records of ``size`` bytes of text are grouped, each about ``held`` bytes at most."""
    least = max(64, 2 * partitions(spark), (size or 0) // held)
    return 1 << (least - 1).bit_length()


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its rows counted from 0 in ``order``.

    Counts come from sorted ranges and the number of rows in the ranges before, so
    that no task holds all rows. Rows equal in ``order`` may get either's count.
    """
    ranges = stash(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = ranges.groupBy("__part").agg(F.count("*").alias("n"))  # a row to a range
    before = counts.select("__part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__part")) - F.col("n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranges.join(before, "__part").withColumn(name, F.col("__before") + within - 1).drop("__part", "__before")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)``: ``(node, root)``, root the least node.

    Alternating large-star and small-star rounds; every round is one aggregation
    and one join by node, checkpointed, until the edges no longer change. Nodes
    may be of any orderable type. Nodes without an edge to another are left out.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
