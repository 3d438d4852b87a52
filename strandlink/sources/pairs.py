"""Sources of pair tables: catalog, delimited files, splits; validation."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import is_sequence, normalize_sequence, reverse_complement, unsupported_bases
from ..operators.diagnostics import union_splits

REQUIRED = ("noncodingRNA", "gene", "label")
RESERVED = ("fit", "validation", "train")  #: names of splits that the workflow makes itself


#: Fixed names of the public benchmark's datasets and splits by alias.
ALIASES = {
    "hejret_train": ("AGO2_CLASH_Hejret2023", "train"),
    "hejret_test": ("AGO2_CLASH_Hejret2023", "test"),
    "klimentova_test": ("AGO2_eCLIP_Klimentova2022", "test"),
    "manakov_train": ("AGO2_eCLIP_Manakov2022", "train"),
    "manakov_test": ("AGO2_eCLIP_Manakov2022", "test"),
    "manakov_leftout": ("AGO2_eCLIP_Manakov2022", "leftout"),
}


class Catalog:
    """Named datasets: alias to (dataset, split), each read by a function of the session."""

    def __init__(self):
        self.entries: dict[str, tuple[str, str, Callable[[SparkSession], DataFrame]]] = {}

    def add(self, alias: str, dataset: str, split: str, read: Callable[[SparkSession], DataFrame]) -> None:
        self.entries[alias] = (dataset, split, read)

    def add_parquet(self, alias: str, dataset: str, split: str, path: str) -> None:
        self.add(alias, dataset, split, lambda spark: spark.read.parquet(path))

    @classmethod
    def of_folder(cls, folder: str) -> Catalog:
        """The public datasets, each a Parquet table ``<folder>/<dataset>/<split>``; read when they are asked for."""
        out = cls()
        for alias, (dataset, split) in ALIASES.items():
            out.add_parquet(alias, dataset, split, f"{folder}/{dataset}/{split}")
        return out

    def resolve(self, alias: str) -> tuple[str, str]:
        if alias not in self.entries:
            raise ValueError(f"unknown dataset alias {alias!r}; known: {', '.join(sorted(self.entries))}")
        return self.entries[alias][:2]

    def read(self, spark: SparkSession, alias: str) -> DataFrame:
        self.resolve(alias)
        return self.entries[alias][2](spark)

    def listing(self, spark: SparkSession) -> DataFrame:
        rows = [(a, d, s) for a, (d, s, _) in sorted(self.entries.items())]
        return spark.createDataFrame(rows, "alias string, dataset string, split string")

    def describe(self, spark: SparkSession, alias: str) -> DataFrame:
        """Count, mean, deviation, least and greatest of each column."""
        return self.read(spark, alias).summary("count", "mean", "stddev", "min", "max")


def required_columns(df: DataFrame) -> None:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def normalized(df: DataFrame) -> DataFrame:
    """Upper-case sequences and whole-number labels (cut off towards zero, null where there is none)."""
    return df.withColumns({"noncodingRNA": normalize_sequence(F.col("noncodingRNA")), "gene": normalize_sequence(F.col("gene")), "label": F.expr("try_cast(try_cast(label as double) as int)")})


def violations(df: DataFrame) -> DataFrame:
    """Rows of a normalized table that can't be used: ``column, reason, value, bad``."""
    bad = F.array(
        *(F.struct(F.lit(c).alias("column"), F.lit("unsupported nucleotide").alias("reason"), F.col(c).alias("value"), F.array_join(unsupported_bases(F.col(c)), "").alias("bad"), (~is_sequence(F.col(c))).alias("is")) for c in ("noncodingRNA", "gene")),
        F.struct(F.lit("label").alias("column"), F.lit("label is neither 0 nor 1").alias("reason"), F.col("label").cast("string").alias("value"), F.lit("").alias("bad"), (~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("is")),
    )
    return df.select("*", F.explode(F.filter(bad, lambda x: x["is"])).alias("v")).select(*df.columns, F.col("v.column").alias("column"), F.col("v.reason").alias("reason"), F.col("v.value").alias("value"), F.col("v.bad").alias("bad"))


def validated(df: DataFrame, name: str = "pairs", allow_empty: bool = True) -> DataFrame:
    """The normalized table; raises on missing columns, bad labels or bases, and on no rows unless allowed."""
    required_columns(df)
    rows = normalized(df)
    if not allow_empty and rows.isEmpty():
        raise ValueError(f"{name} has no rows")
    first = violations(rows).select("column", "reason", "value", "bad").head(1)
    if first:
        v = first[0]
        raise ValueError(f"{name}: {v['reason']} in {v['column']}: {v['value']!r}" + (f" ({v['bad']})" if v["bad"] else ""))
    return rows


def prepared(df: DataFrame) -> DataFrame:
    """With ``target_rc``, the reverse complement that is aligned with the first sequence."""
    return df.withColumn("target_rc", reverse_complement(F.col("gene")))


def read_delimited(spark: SparkSession, path: str, allow_empty: bool = True) -> DataFrame:
    """A pair table from a file with a header: tabs for ``.tsv`` and ``.tab``, else commas. Other columns are dropped."""
    tabs = PurePosixPath(path).suffix.lower() in (".tsv", ".tab")
    df = spark.read.option("header", True).option("sep", "\t" if tabs else ",").csv(path)
    required_columns(df)
    return validated(df.select(*REQUIRED), path, allow_empty)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated table of scores against other datasets, with a header; types as Spark reads them."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def parse_named(text: str) -> dict[str, str]:
    """``name=path,...`` as a dict; a bare path is named by its stem. Blank items are dropped."""
    out: dict[str, str] = {}
    for item in (x.strip() for x in text.split(",")):
        if not item:
            continue
        name, sep, path = item.partition("=")
        name, path = (name.strip(), path.strip()) if sep else (PurePosixPath(item).stem, item)
        if not name or not path:
            raise ValueError(f"{item!r} is no name=path")
        if name in out:
            raise ValueError(f"the name {name!r} is given twice")
        out[name] = path
    return out


def read_named(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    return {name: read_delimited(spark, path) for name, path in parse_named(text).items()}


def load_splits(spark: SparkSession, catalog: Catalog, train: str | None, tests: list[str] | None = None, files: str = "", skip_evaluation: bool = False) -> DataFrame:
    """One table with ``split`` and ``split_ord``: training, test datasets of the catalog, files.

    ``train`` of None is for evaluation only. Without ``tests`` the dataset's own test split is taken.
    """
    splits: dict[str, DataFrame] = {}
    if train is not None:
        dataset, _ = catalog.resolve(train)
        splits["train"] = validated(catalog.read(spark, train), train)
        if tests is None:
            tests = [a for a, (d, s, _) in catalog.entries.items() if d == dataset and s == "test"]
    if not skip_evaluation:
        for alias in tests or []:
            catalog.resolve(alias)
            splits[alias] = validated(catalog.read(spark, alias), alias)
        for name, df in read_named(spark, files).items():
            if name in splits or name in RESERVED:
                raise ValueError(f"the name {name!r} is taken by another split")
            splits[name] = df
    if not splits:
        raise ValueError("no split to load")
    return union_splits({k: v.select(*REQUIRED) for k, v in splits.items()})


def longest(*frames: DataFrame) -> int:
    """The greatest length of a first sequence; raises if there is none."""
    found = [f.agg(F.max(F.length("noncodingRNA"))).first()[0] for f in frames]
    found = [x for x in found if x]
    if not found:
        raise ValueError("no sequence to take a length from")
    return max(found)


def of_length(df: DataFrame, n: int = 22) -> DataFrame:
    return df.where(F.length("noncodingRNA") == n)
