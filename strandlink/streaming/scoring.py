"""Streams of pairs. An extension: the batch engine that this one matches has no streams.

Scores and alignments work on each row alone, so the batch functions serve streams
as they are. Metrics over a stream keep a histogram of scores for each window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.align import scored
from ..operators.model import Model
from ..sources.pairs import normalized, prepared, violations


def usable(length: int) -> Column:
    """Whether a normalized row can be aligned with weights of so many positions; never null."""
    first, gene = F.col("noncodingRNA"), F.col("gene")
    return F.coalesce(first.rlike("^[ACGT]+$") & gene.rlike("^[ACGT]*$") & F.col("label").isin(0, 1) & (F.length(first) <= length), F.lit(False))


def scored_stream(pairs: DataFrame, model: Model) -> DataFrame:
    """A stream of pairs with ``score`` and ``logit``; rows that can't be aligned are left to ``rejected_stream``."""
    return scored(prepared(normalized(pairs).where(usable(model.length))), model)


def rejected_stream(pairs: DataFrame, model: Model) -> DataFrame:
    """The rows that ``scored_stream`` leaves out, with ``column, reason, value, bad``: one for each thing that is wrong."""
    rows = normalized(pairs).where(~usable(model.length))
    n = F.length("noncodingRNA")
    sized = rows.where((n == 0) | (n > model.length))
    reason = F.when(n == 0, "empty first sequence").otherwise("first sequence longer than the model")
    sized = sized.withColumns({"column": F.lit("noncodingRNA"), "reason": reason, "value": F.col("noncodingRNA"), "bad": F.lit("")})
    return violations(rows).unionByName(sized)


def score_histogram(stream: DataFrame, time: str, window: str = "10 minutes", late: str = "10 minutes", width: float = 1.0) -> DataFrame:
    """Positives and rows by window and score bin, with a watermark for late rows."""
    rows = stream.withWatermark(time, late)
    return rows.groupBy(F.window(time, window), F.floor(F.col("score") / width).alias("bin")).agg(F.sum(F.col("label").cast("long")).alias("positives"), F.count("*").alias("n"))
