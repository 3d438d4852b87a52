"""Mixing sources to target weights by capped water-filling.

All words of all sources are shared out by weight. A source takes
``most_epochs`` times its size at most; what is above is shared again among the
others by weight until none is above. Every document is then taken a whole
number of times, and in a seeded order documents take one repetition more until
the source has its target; the document at the border gives only the words that
are still missing.

Null texts have size 0, null sources are a source of their own (the last in
order), and columns other than ``doc_id``, ``source`` and ``text`` are not read.
Rows that repeat a ``doc_id`` are taken separately. A source without words has
target 0; of an empty table nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_tools import free, ranked, stash

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the seeded order that one round of the search for the border looks at.
DIGITS = 3


def n_words(text: Column) -> Column:
    """The number of words of ``text``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """``source, source_size, rank``: rank counts sources by code point from 0, null last."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    return ranked(sources, [F.col("source").asc_nulls_last()], "rank")


def water_level(sources: DataFrame, most_epochs: int) -> float:
    """Words to a unit of weight, of ``sources(source_size, weight)``, once the capped sources are full.

    Each round clamps the sources that are above at the present level; the level
    only rises, so the rounds end when no further source is clamped.
    """
    level, clamped = 0.0, None
    total = F.sum("source_size")
    while True:
        above = F.col("weight") * F.lit(level) > F.col("source_size") * most_epochs
        row = sources.agg(
            total.alias("words"),
            F.sum(F.when(above, F.col("source_size") * most_epochs).otherwise(0)).alias("full"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight"),
            F.count(F.when(above, 1)).alias("clamped"),
        ).first()
        if not row["words"] or row["clamped"] == clamped:
            return level
        if not row["weight"]:
            return float("inf")
        clamped, level = row["clamped"], (row["words"] - row["full"]) / row["weight"]


def seeded_order(seed: int) -> Column:
    """Hex digits by which the documents of a source take their last repetition."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, seed: int = 7) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of ``docs(doc_id, source, text)``.

    Sources in code point order have the ``weights`` in turn.
    """
    size = n_words(F.col("text").cast("string")).alias("size")
    return taken_of(stash(docs.select("doc_id", "source", size, seeded_order(seed).alias("order"))), weights, most_epochs)


def taken_of(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``source_size, target, taken`` to ``sizes(doc_id, source, size, order, *keep)``, which is read more than once."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stash(ranked_sources(sizes).withColumn("weight", weight))
    level = water_level(sources, most_epochs)
    target = F.least(F.col("source_size") * F.lit(float(most_epochs)), F.col("weight") * F.lit(level))
    target = F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0))
    sources = sources.withColumn("target", target)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    # The words still missing once each document is taken a whole number of times.
    sources = stash(sources.withColumn("whole", whole.cast("long")).withColumn("missing", (F.round("target") - F.col("whole") * F.col("source_size")).cast("long")))
    keyed = sources.select(F.col("source").alias("s"), "source_size", "target", "whole", "missing")
    rows = sizes.join(keyed, sizes["source"].eqNullSafe(F.col("s"))).drop("s")

    # Two rounds narrow the border down to the documents of one bucket of the order.
    border = keyed.select("s", F.lit("").alias("at"), F.col("missing").alias("left"))
    for k in range(2):
        inside = sizes.join(border, sizes["source"].eqNullSafe(border["s"])).where(F.col("order").startswith(F.col("at")))
        digits = F.substring("order", 1, (k + 1) * DIGITS).alias("bucket")
        sums = inside.groupBy("s", digits).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        over = F.sum("words").over(Window.partitionBy("s").orderBy("bucket"))
        sums = sums.withColumn("before", over - F.col("words")).where((F.col("before") < F.col("left")) & (F.col("left") <= F.col("before") + F.col("words")))
        border = stash(sums.select("s", F.col("bucket").alias("at"), (F.col("left") - F.col("before")).alias("left")))

    border = border.withColumnRenamed("s", "b")
    rows = rows.join(border, rows["source"].eqNullSafe(border["b"]), "left").drop("b")
    head = F.substring("order", 1, 2 * DIGITS)
    where = F.when(F.col("at").isNull(), 0).when(head < F.col("at"), 1).when(head == F.col("at"), 2).otherwise(0)
    rows = rows.withColumn("where", where)
    sure = rows.where("where < 2").select("*", F.when(F.col("where") == 1, F.col("size")).otherwise(F.lit(0)).cast("long").alias("extra"))
    near = rows.where("where = 2").withColumn("before", F.sum("size").over(Window.partitionBy("source").orderBy("order", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    near = near.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("left") - F.col("before"))).cast("long")).drop("before")
    rows = sure.unionByName(near)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"), *keep)


def repeated(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, seed: int = 7) -> DataFrame:
    """``docs`` mixed: each row as often as the mix takes it whole, then the words that it
    takes in part, as a row whose text ends with the last of them (and whose ``n_chars``,
    where that column exists, is its own).

    Rows equal in ``doc_id``, ``source`` and ``text`` are one document here. Documents
    without words come as often as every document of their source at least. The
    columns are those of ``docs``, whatever their names.
    """
    columns, own = docs.columns, free(docs.columns)
    once = docs.dropDuplicates(["doc_id", "source", "text"]).withColumn(own("size"), n_words(F.col("text").cast("string"))).withColumn(own("text"), F.xxhash64("text"))
    sizes = stash(once.select("doc_id", "source", F.col(own("size")).alias("size"), F.col(own("text")).alias("h"), seeded_order(seed).alias("order")))
    plan = taken_of(sizes, weights, most_epochs, keep=("h",))
    least = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(least).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    plan = plan.select(F.col("doc_id").alias(own("id")), F.col("h").alias(own("h")), whole.alias(own("whole")), rest.alias(own("rest"))).where((F.col(own("whole")) > 0) | (F.col(own("rest")) > 0))
    rows = once.join(plan, once["doc_id"].eqNullSafe(F.col(own("id"))) & once[own("text")].eqNullSafe(F.col(own("h"))))
    copies = F.concat(F.array_repeat(F.lit(0), F.col(own("whole"))), F.filter(F.array(own("rest")), lambda r: r > 0))
    rows = rows.withColumn(own("part"), F.explode(copies))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col(own("part"))), "")
    out = {"text": F.when(F.col(own("part")) > 0, head).otherwise(F.col("text"))}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.col(own("part")) > 0, F.length(head)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(out[c].alias(c) if c in out else F.col(c) for c in columns))
