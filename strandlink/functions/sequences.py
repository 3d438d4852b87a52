"""Column functions on sequences, scores and labels; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases in the order of their codes.
BASES = "ATCG"
#: Least positive normal double; probabilities are clipped to it before a logarithm.
TINY = 2.2250738585072014e-308


def normalize_sequence(c: Column) -> Column:
    """Upper-case text."""
    return F.upper(c.cast("string"))


def is_sequence(c: Column) -> Column:
    """Whether only A, C, G and T occur; the empty sequence counts, null doesn't."""
    return F.coalesce(c.rlike("^[ACGT]*$"), F.lit(False))


def unsupported_bases(c: Column) -> Column:
    """The sorted distinct characters other than A, C, G, T."""
    return F.filter(F.array_sort(F.array_distinct(F.split(F.translate(c, "ACGT", ""), ""))), lambda x: x != "")


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGT", "TGCA"))


def base_code(c: Column) -> Column:
    """0 to 3 for A, T, C, G; 4 for the gap sign."""
    return F.when(c == "-", 4).otherwise(F.instr(F.lit(BASES), c) - 1)


def code_base(c: Column) -> Column:
    """The base of a code, the gap sign for 4."""
    return F.substring(F.lit(BASES + "-"), c + 1, F.lit(1))


def sigmoid(x: Column) -> Column:
    """Logistic function; never overflows to NaN."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def clip_probability(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(TINY))


def interaction_probability(score: Column, alpha: Column | float) -> Column:
    return sigmoid(score + alpha)


def label_posterior(score: Column, label: Column, alpha: float, observed: list[list[float]]) -> Column:
    """``struct<p0, p1>``: probabilities of the true label, given the observed one.

    ``observed[t][o]`` is the probability of observing ``o`` when ``t`` is true.
    """
    p = interaction_probability(score, alpha)
    zero = (1 - p) * F.when(label == 1, observed[0][1]).otherwise(observed[0][0])
    one = p * F.when(label == 1, observed[1][1]).otherwise(observed[1][0])
    return F.struct((zero / (zero + one)).alias("p0"), (one / (zero + one)).alias("p1"))


def frequency_bin(count: Column) -> Column:
    """How often an entity occurs in the reference split, in five bins."""
    return F.when(F.coalesce(count, F.lit(0)) <= 0, "unseen").when(count == 1, "singleton").when(count <= 5, "low_2_5").when(count <= 20, "medium_6_20").otherwise("high_gt20")


def csv_items(c: Column) -> Column:
    """Trimmed, non-blank items of a comma-separated list."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def length_normalised(score: Column, columns: Column) -> Column:
    """``struct<root5, root14, log35>``: a score by three measures of its alignment's length."""
    return F.struct((score / F.pow(columns, 0.2)).alias("root5"), (score / F.pow(columns, 0.07)).alias("root14"), (score / F.ln(columns + 35)).alias("log35"))


def likelihood_bands(probability: Column, label: Column) -> dict[str, Column]:
    """Conditions that single out badly and well fitted rows of either label."""
    return {
        "positive_low": (label == 1) & (probability < 0.7),
        "positive_high": (label == 1) & (probability > 0.9),
        "negative_high": (label == 0) & (probability > 0.5),
        "negative_low": (label == 0) & (probability < 0.15),
    }


def conflicting(label: Column, best_positive: Column, best_negative: Column, limit: float = 25.0) -> Column:
    """Rows that another dataset contradicts: a negative much like other positives, or the reverse."""
    return ((label == 0) & (best_positive > limit)) | ((label == 1) & (best_negative > limit))


def pretty_alignment(mir: Column, gene: Column) -> Column:
    """Three lines: the first row, ``|`` under matches, the second row."""
    bars = F.transform(F.arrays_zip(F.split(mir, "").alias("a"), F.split(gene, "").alias("b")), lambda x: F.when((x["a"] == x["b"]) & (x["a"] != "-"), "|").otherwise(" "))
    return F.concat_ws("\n", mir, F.array_join(bars, ""), gene)
