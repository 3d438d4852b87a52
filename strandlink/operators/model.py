"""Alignment models: weights, intercept, label noise; starting points; storage."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import BASES, Weights

#: The fitted uniform alignment that every fit starts from.
BASELINE_MATCH = 0.724709
BASELINE_MISMATCH = -0.647892
BASELINE_GAP = -0.901264
BASELINE_ALPHA = -5.226262
#: Match, mismatch and gap of the plain uniform aligner.
UNIFORM = (5.0, -4.0, -6.0)

ALIGNERS = ("local", "glocal")
#: Named label priors: pseudo-counts by true and observed label.
LABEL_PRIORS: dict[str, list[list[float]] | None] = {
    "none": None,
    "symmetric_95_5": [[950.0, 50.0], [50.0, 950.0]],
    "symmetric_90_10": [[900.0, 100.0], [100.0, 900.0]],
    "symmetric_80_20": [[800.0, 200.0], [200.0, 800.0]],
}


def uniform_weights(length: int, match: float, mismatch: float, gap: float) -> Weights:
    table = np.where(np.eye(4, dtype=bool), match, mismatch)
    return Weights(np.repeat(table[:, :, None], length, 2), np.full(length - 1, gap), np.full(length, gap))


def baseline_weights(length: int) -> tuple[Weights, float]:
    """The starting weights for first sequences of up to ``length`` bases, and the intercept."""
    return uniform_weights(length, BASELINE_MATCH, BASELINE_MISMATCH, BASELINE_GAP), BASELINE_ALPHA


def starting_point(pairs: DataFrame, length: int | None = None) -> tuple[Weights, float]:
    """The baseline for the longest first sequence of ``pairs``, unless a length is given."""
    if length is None:
        length = pairs.agg(F.max(F.length("noncodingRNA"))).first()[0]
        if not length:
            raise ValueError("no pairs to take a length from")
    return baseline_weights(length)


def label_prior(name: str) -> list[list[float]] | None:
    if name not in LABEL_PRIORS:
        raise ValueError(f"unknown label prior {name!r}; one of {', '.join(LABEL_PRIORS)}")
    return LABEL_PRIORS[name]


def check_aligner(name: str) -> str:
    if name not in ALIGNERS:
        raise ValueError(f"unknown aligner {name!r}; one of {', '.join(ALIGNERS)}")
    return name


@dataclass
class Model:
    weights: Weights
    alpha: float
    aligner: str = "local"
    label_observation: list[list[float]] | None = None
    history: list[dict] = field(default_factory=list)

    @property
    def length(self) -> int:
        return self.weights.length

    @property
    def local(self) -> bool:
        return check_aligner(self.aligner) == "local"

    def facts(self) -> dict:
        """What the model is, but for its substitution weights."""
        w = self.weights
        return {"aligner": self.aligner, "positions": w.length, "alpha": self.alpha, "gap_first": w.gap_first, "gap_second": w.gap_second, "label_observation": self.label_observation}


def model_params(spark: SparkSession, model: Model) -> DataFrame:
    """The weights as rows ``param, pos, mir_nt, gene_nt, value``."""
    w = model.weights
    rows = [("match", p, BASES[a], BASES[b], float(w.match[a, b, p])) for p in range(w.length) for a in range(4) for b in range(4)]
    rows += [("gap_first", p, None, None, float(v)) for p, v in enumerate(w.gap_first)]
    rows += [("gap_second", p, None, None, float(v)) for p, v in enumerate(w.gap_second)]
    rows.append(("alpha", None, None, None, float(model.alpha)))
    return spark.createDataFrame(rows, "param string, pos int, mir_nt string, gene_nt string, value double")


def mean_weights(params: DataFrame) -> DataFrame:
    """The one mean of all match and of all mismatch weights: ``kind, mean``."""
    kind = F.when(F.col("mir_nt") == F.col("gene_nt"), "match").otherwise("mismatch")
    return params.where("param = 'match'").groupBy(kind.alias("kind")).agg(F.avg("value").alias("mean"))


def position_stats(params: DataFrame) -> DataFrame:
    """Mean and population deviation of match and mismatch weights by position."""
    kind = F.when(F.col("mir_nt") == F.col("gene_nt"), "match").otherwise("mismatch")
    return params.where("param = 'match'").groupBy("pos", kind.alias("kind")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """Writes one Parquet row with all values; the aligner by name."""
    w = model.weights
    observed = None if model.label_observation is None else [[float(x) for x in r] for r in model.label_observation]
    row = (model.aligner, w.length, w.match.ravel().tolist(), w.gap_first.tolist(), w.gap_second.tolist(), float(model.alpha), observed)
    schema = "aligner string, model_length int, match array<double>, gap_first array<double>, gap_second array<double>, alpha double, label_observation array<array<double>>"
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(path).head(2)
    if len(rows) != 1 or "match" not in rows[0]:
        raise ValueError(f"{path} doesn't hold one model")
    r = rows[0]
    w = Weights(np.array(r["match"]).reshape(4, 4, r["model_length"]), np.array(r["gap_first"]), np.array(r["gap_second"]))
    return Model(w, r["alpha"], r["aligner"], r["label_observation"])


def from_coefficients(coefficients: dict[str, float], length: int) -> tuple[Weights, float]:
    """Weights of a logistic regression on positional features (``{i}_is_match`` ...); absent ones are 0."""
    get = lambda name: float(coefficients.get(name, 0.0))
    match = np.zeros((4, 4, length))
    for p in range(length):
        match[:, :, p] = np.where(np.eye(4, dtype=bool), get(f"{p}_is_match"), get(f"{p}_is_mismatch"))
    return Weights(match, np.full(length - 1, get("Gap_miR")), np.full(length, get("Gap_gene"))), get("intercept")


def rescaled(coefficients: np.ndarray, like: np.ndarray) -> np.ndarray:
    """``coefficients`` scaled to the norm of ``like``."""
    return coefficients * (np.linalg.norm(like) / np.linalg.norm(coefficients))
