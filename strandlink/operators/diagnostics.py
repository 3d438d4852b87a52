"""Profiles of pair tables: summaries, frequencies, leaders, overlap, slices, weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import frequency_bin
from ..storage import stored
from .metrics import ranking_metrics

ENTITIES = {"mirna": "noncodingRNA", "gene": "gene"}
WEIGHTINGS = ("none", "mirna_balanced", "gene_balanced", "pair_balanced", "mirna_gene_sqrt")


def dataset_summary(pairs: DataFrame) -> DataFrame:
    """Counts of each split, whole (``length`` 'all') and by length of the first sequence.

    Distinct entities are counted from the distinct pairs, which are found in one pass for
    both levels and both kinds of entity; a split without rows has no row.
    """
    length = F.length("noncodingRNA").cast("string")
    unit = pairs.groupBy("split", length.alias("own"), "noncodingRNA", "gene").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("p"))
    kinds = F.array(F.struct(F.lit(True).alias("is_gene"), F.col("gene").alias("entity")), F.struct(F.lit(False).alias("is_gene"), F.col("noncodingRNA").alias("entity")))
    sums = (F.sum("pairs").alias("pairs"), F.sum("n").alias("n"), F.sum("p").alias("p"))
    each = unit.select("split", "own", F.explode(kinds).alias("e"), F.lit(1).alias("pairs"), "n", "p").groupBy("split", "own", "e.is_gene", "e.entity").agg(*sums)
    each = each.select("split", F.explode(F.array(F.lit("all"), "own")).alias("length"), "is_gene", "entity", "pairs", "n", "p").groupBy("split", "length", "is_gene", "entity").agg(*sums)
    gene = lambda c: F.when(F.col("is_gene"), c)
    out = each.groupBy("split", "length").agg(
        F.sum(gene(F.col("n"))).alias("num_pairs"),
        F.count_if(~F.col("is_gene") & F.col("entity").isNotNull()).alias("num_mirnas"),
        F.count_if("is_gene").alias("num_genes"),
        F.sum(gene(F.col("pairs"))).alias("num_unique_pairs"),
        F.avg(gene(F.col("pairs"))).alias("mean_mirnas_per_gene"),
        F.sum(gene(F.col("p"))).alias("positives"),
    )
    return out.select("split", "length", "num_pairs", "num_mirnas", "num_genes", "num_unique_pairs", "mean_mirnas_per_gene", "positives", (F.col("num_pairs") - F.col("positives")).alias("negatives"))


def entity_counts(pairs: DataFrame) -> DataFrame:
    """Pairs of each entity, by split, kind of entity and label scope ('all' and each label)."""
    scope = F.array(F.lit("all"), F.col("label").cast("string"))
    kinds = F.array(*(F.struct(F.lit(kind).alias("entity_type"), F.col(c).alias("entity")) for kind, c in ENTITIES.items()))
    one = pairs.groupBy("split", "noncodingRNA", "gene", "label").agg(F.count("*").alias("n"))
    rows = one.select("split", F.explode(kinds).alias("e"), scope.alias("scopes"), "n").select("split", "e.*", F.explode("scopes").alias("label_scope"), "n")
    return rows.groupBy("split", "entity_type", "label_scope", "entity").agg(F.sum("n").alias("pairs"))


def entity_frequency(pairs: DataFrame) -> DataFrame:
    """How pairs spread over entities: number, mean, median, 95th percentile, most."""
    counts = entity_counts(pairs)
    return counts.groupBy("split", "entity_type", "label_scope").agg(
        F.count("*").alias("entities"),
        F.avg("pairs").alias("mean_pairs"),
        F.percentile("pairs", 0.5).alias("median_pairs"),
        F.percentile("pairs", 0.95).alias("p95_pairs"),
        F.max("pairs").alias("max_pairs"),
    )


def top_entities(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` entities of most pairs in each scope, ranked from 1; ties by name. None for ``n`` of 0 or less."""
    w = Window.partitionBy("split", "entity_type", "label_scope").orderBy(F.desc("pairs"), "entity")
    return entity_counts(pairs).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(n, 0))


def value_counts(rows: DataFrame, column: str, more_than: int = 0) -> DataFrame:
    """Values that occur more than so often, and how often."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def most_common(rows: DataFrame, column: str, k: int = 14) -> DataFrame:
    return value_counts(rows, column).orderBy(F.desc("n"), column).limit(k)


def split_overlap(pairs: DataFrame) -> DataFrame:
    """Shared keys of every two splits in order: counts, overlap, and both shares (NaN for an empty side)."""
    keys = F.array(
        F.struct(F.lit("mirna").alias("entity_type"), F.col("noncodingRNA").alias("a"), F.lit("").alias("b")),
        F.struct(F.lit("gene").alias("entity_type"), F.col("gene").alias("a"), F.lit("").alias("b")),
        F.struct(F.lit("pair").alias("entity_type"), F.col("noncodingRNA").alias("a"), F.col("gene").alias("b")),
    )
    each = pairs.select("split", "split_ord", "noncodingRNA", "gene").distinct().select("split", "split_ord", F.explode(keys).alias("k")).select("split", "split_ord", "k.*").distinct()
    # Splits are few, so a key's splits are a short list, and its shared pairs of splits come from that list.
    owners = each.groupBy("entity_type", "a", "b").agg(F.array_sort(F.collect_list(F.struct("split_ord", "split"))).alias("s"))
    two = owners.where(F.size("s") > 1).select("entity_type", F.explode(F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y["split_ord"] > x["split_ord"]), lambda y: F.struct(x["split"].alias("left_split"), y["split"].alias("right_split")))))).alias("p"))
    shared = two.groupBy("entity_type", "p.left_split", "p.right_split").agg(F.count("*").alias("overlap"))
    sizes = each.groupBy("entity_type", "split", "split_ord").agg(F.count("*").alias("n"))
    left = sizes.select("entity_type", F.col("split").alias("left_split"), F.col("split_ord").alias("lo"), F.col("n").alias("left_count"))
    right = sizes.select("entity_type", F.col("split").alias("right_split"), F.col("split_ord").alias("ro"), F.col("n").alias("right_count"))
    out = left.join(right, "entity_type").where("lo < ro").join(shared, ["entity_type", "left_split", "right_split"], "left")
    overlap = F.coalesce("overlap", F.lit(0))
    share = lambda n: F.when(F.col(n) > 0, overlap / F.col(n)).otherwise(float("nan"))
    return out.select("left_split", "right_split", "entity_type", "left_count", "right_count", overlap.alias("overlap"), share("left_count").alias("left_fraction"), share("right_count").alias("right_fraction"))


def sample_weights(pairs: DataFrame, kind: str = "none", times: str | None = None) -> DataFrame:
    """``pairs`` with ``weight``: all alike, or balanced over an entity, with mean 1.

    ``times`` names a column that tells how many pairs a row stands for. Such rows are few for a pair, so
    a pair's are counted where they lie; if they were grouped by pair, that takes no further shuffle.

    Counts of entities are stored before they are joined back. So Spark knows their size and broadcasts
    them if they are small; else both sides are plain shuffles, and a frequent entity's rows are split over tasks.
    """
    if kind not in WEIGHTINGS:
        raise ValueError(f"unknown weighting {kind!r}; one of {', '.join(WEIGHTINGS)}")
    if kind == "none":
        return pairs.withColumn("weight", F.lit(1.0))
    keys = {"mirna_balanced": ["noncodingRNA"], "gene_balanced": ["gene"], "pair_balanced": ["noncodingRNA", "gene"]}
    number = F.sum(times) if times else F.count("*")
    if kind == "pair_balanced" and times:
        rows = pairs.withColumn("__c", number.over(Window.partitionBy(*keys[kind])))
        total = pairs.groupBy(*keys[kind]).agg(number.alias("__c")).agg(F.sum("__c").alias("__n"), F.count("*").alias("__u"))
        return rows.crossJoin(F.broadcast(total)).withColumn("weight", F.col("__n") / (F.col("__u") * F.col("__c"))).select(*pairs.columns, "weight")
    if kind in keys:
        counts = stored(pairs.groupBy(*keys[kind]).agg(number.alias("__c")))
        total = counts.agg(F.sum("__c").alias("__n"), F.count("*").alias("__u"))
        rows = pairs.join(counts, keys[kind]).crossJoin(total)
        return rows.withColumn("weight", F.col("__n") / (F.col("__u") * F.col("__c"))).select(*pairs.columns, "weight")
    m = stored(pairs.groupBy("noncodingRNA").agg(number.alias("__m")))
    g = stored(pairs.groupBy("gene").agg(number.alias("__g")))
    rows = pairs.join(m, "noncodingRNA").join(g, "gene").withColumn("__w", 1 / F.sqrt(F.col("__m") * F.col("__g")))
    mean = rows.agg((F.sum(F.col("__w") * F.col(times)) / number if times else F.avg("__w")).alias("__mean"))
    return rows.crossJoin(mean).withColumn("weight", F.col("__w") / F.col("__mean")).select(*pairs.columns, "weight")


def with_reference(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """``rows`` with counts, seen marks and frequency bins of their entities in ``reference``; counts are stored, see ``sample_weights``."""
    m = stored(reference.groupBy(F.col("noncodingRNA").alias("__m")).agg(F.count("*").alias("mirna_count")))
    g = stored(reference.groupBy(F.col("gene").alias("__g")).agg(F.count("*").alias("gene_count")))
    out = rows.join(m, F.col("noncodingRNA") == F.col("__m"), "left").join(g, F.col("gene") == F.col("__g"), "left").drop("__m", "__g")

    def seen(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), "seen").otherwise("unseen")

    out = out.withColumns({"mirna_seen": seen("mirna_count"), "gene_seen": seen("gene_count"), "mirna_frequency_bin": frequency_bin(F.col("mirna_count")), "gene_frequency_bin": frequency_bin(F.col("gene_count"))})
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("mirna_count", "gene_count")})


SLICES = ("mirna_length", "mirna_seen", "gene_seen", "mirna_frequency_bin", "gene_frequency_bin")


def metric_slices(scored: DataFrame, reference: DataFrame | None) -> DataFrame | None:
    """Metrics of each split by slice of its entities; nothing without a reference."""
    if reference is None:
        return None
    rows = with_reference(scored, reference).withColumn("mirna_length", F.length("noncodingRNA").cast("string"))
    slices = F.array(*(F.struct(F.lit(s).alias("slice_type"), F.col(s).alias("slice_value")) for s in SLICES))
    rows = rows.select("split", "label", "score", F.explode(slices).alias("s")).select("split", "s.*", "label", "score")
    return ranking_metrics(rows, ["split", "slice_type", "slice_value"])


def histogram(rows: DataFrame, column: str, by: list[str], bins: int = 10) -> DataFrame:
    """Counts in equal bins from the least to the greatest value of all rows; the last bin is closed.

    Rows are counted by value first, and stored so, because the bins follow from the counts: ``rows`` are read once.
    """
    rows = stored(rows.groupBy(*by, column).agg(F.count("*").alias("__n")))
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    placed = rows.crossJoin(ends)
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    placed = placed.where(F.col(column).isNotNull()).withColumn("bin", b.cast("int"))
    return placed.groupBy(*by, "bin").agg(F.sum("__n").alias("n"))


def diagnostics(pairs: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    return {"dataset_summary": dataset_summary(pairs), "entity_frequency": entity_frequency(pairs), "top_entities": top_entities(pairs, top), "split_overlap": split_overlap(pairs)}


def union_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """One table with ``split`` and its place ``split_ord``."""
    rows = [df.withColumns({"split": F.lit(name), "split_ord": F.lit(k)}) for k, (name, df) in enumerate(splits.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
