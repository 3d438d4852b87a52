"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal.

Features of a text are hashed into ``2**BITS`` places:

* its word uni- and bigrams;
* the uni- and bigrams of its words' shapes (runs of capitals, small letters,
  digits, and every other character as it is), which carry over to unseen words;
* one feature for the share of distinct word trigrams, in tenths.

Counts enter as ``1 + ln(count)``, and each of the first two groups is scaled to
length one. The model is one vector, so the score of a text is a sparse dot
product; texts without words have the bias only.

Training takes ``sample`` labelled rows at most, chosen by a hash of ``doc_id``:
the bound keeps the one sequential task small. Rows whose label, id or text is
null aren't learnt from. Rows that repeat are learnt from and scored each; columns of ``docs``
beside ``doc_id`` and ``text`` aren't read, whatever their names. Without labels of both kinds every score is the share
of label 1 (0.5 without any label).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .spark_tools import light_batches, pieces, record

BITS = 18
SAMPLE = 6000  #: labelled documents learnt from at most
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4

#: Byte classes: small letters and all of UTF-8's multi-byte characters, capitals, digits, the rest as is.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = 97
SHAPE[128:] = 97
SHAPE[65:91] = 65
SHAPE[48:58] = 48


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text with runs of one class inside a word shortened to one byte."""
    classes = SHAPE[data]
    kept = np.ones(len(data), bool)
    kept[1:] = classes[1:] != classes[:-1]
    kept |= kernel.SPACE[data]
    first = offsets[:-1][offsets[:-1] < len(data)]
    kept[first] = True
    return classes[kept], np.concatenate([[0], np.cumsum(kept)])[offsets]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values and the n + 1 offsets of the texts' sparse vectors."""
    data, offsets = kernel.text_bytes(texts)
    n = len(texts)
    groups = []
    for k, (bytes_, at) in enumerate(((data, offsets), _shapes(data, offsets))):
        starts, ends, by_doc = kernel.words(bytes_, at)
        hashes = kernel.spans(kernel.prefix(bytes_), starts, ends)
        found = []
        for size in (1, 2):
            grams, counts, places = kernel.distinct(*kernel.ngrams(hashes, by_doc, size))
            found.append((kernel.mix(grams + np.uint64(4 * k + size)), counts, np.repeat(np.arange(n), np.diff(places))))
        place, count, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        value = 1 + np.log(count)
        norm = np.sqrt(np.bincount(doc, value * value, minlength=n))
        groups.append((place, value / norm[doc], doc))
        if k == 0:
            grams, places = kernel.ngrams(hashes, by_doc, 3)
            total = np.diff(places)
            share = np.diff(kernel.distinct(grams, places)[2]) / np.maximum(total, 1)
            tenth = kernel.mix((share * 10).astype(np.uint64) + np.uint64(1000))
            some = np.flatnonzero(total)
            groups.append((tenth[some], np.ones(len(some)), some))
    place, value, doc = (np.concatenate(x) for x in zip(*groups, strict=True))
    order = np.argsort(doc, kind="stable")
    return (place[order] >> np.uint64(64 - BITS)).astype(np.int64), value[order], np.searchsorted(doc[order], np.arange(n + 1))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights, and the bias as the last, by follow-the-regularised-leader updates row after row."""
    z, q = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(q[i])) / ALPHA + L2))

    for _ in range(epochs):
        for place, value, label in rows:
            w = weights(place)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            sigma = (np.sqrt(q[place] + g * g) - np.sqrt(q[place])) / ALPHA
            z[place] += g - sigma * w
            q[place] += g * g
    return weights(np.arange(len(z)))


MODEL = pa.schema([("model", pa.binary())])


def _train(batches):
    rows = []
    for piece in pieces(batches):
        place, value, at = features(piece.column("text"))
        for label, a, b in zip(piece.column("label").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            # Places that two features share are one, so that each is updated once.
            p, inverse = np.unique(place[a:b], return_inverse=True)
            rows.append((np.append(p, 1 << BITS), np.append(np.bincount(inverse, value[a:b], minlength=len(p)), 1.0), label))
    if not rows:
        return
    order = np.random.default_rng(11).permutation(len(rows))
    labels = {r[2] for r in rows}
    if len(labels) == 1:
        model = np.zeros((1 << BITS) + 1)
        model[-1] = 35.0 if labels == {1} else -35.0
    else:
        model = ftrl([rows[i] for i in order])
    yield record(MODEL, pa.array([model.astype("<f4").tobytes()], pa.binary()))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from ``labels(doc_id, <label>)`` of documents that aren't held out."""
    light_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("label"))
    # The bound is on ids, so that no text moves for rows that aren't chosen.
    chosen = known.orderBy(F.xxhash64(F.col("__id").cast("string"), F.lit(5)), "__id", "label").limit(sample)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    rows = rows.select("doc_id", "label", "text").repartition(1).sortWithinPartitions("doc_id", "label", F.xxhash64("text"))
    found = rows.mapInArrow(_train, "model binary").collect()  # one vector of fixed size
    return np.frombuffer(found[0]["model"], "<f4").astype(np.float64) if found else np.zeros((1 << BITS) + 1)


def probability(spark: SparkSession, text: Column, model: np.ndarray) -> Column:
    """The probability of label 1 of a text column."""
    light_batches(spark)
    held = spark.sparkContext.broadcast(model.astype(np.float32))  # 1 MB, whatever the input

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        w = held.value.astype(np.float64)
        out = []
        for piece in pieces([pa.RecordBatch.from_arrays([texts], ["text"])]):
            place, value, at = features(piece.column("text"))
            total = np.add.reduceat(np.append(w[place] * value, 0.0), at[:-1])
            total = np.where(np.diff(at) > 0, total, 0.0) + w[-1]
            out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return of(text.cast("string"))


def scored(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """``doc_id, text`` of every row of ``docs`` and ``score``, the probability of label 1."""
    return docs.select("doc_id", "text", probability(docs.sparkSession, F.col("text"), model).alias("score"))


def kept(docs: DataFrame, model: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose probability of label 1 is ``threshold`` at least, with all their columns."""
    mark = next(f"__p{k}" for k in range(len(docs.columns) + 1) if f"__p{k}" not in docs.columns)
    return docs.withColumn(mark, probability(docs.sparkSession, F.col("text"), model)).where(F.col(mark) >= threshold).drop(mark)


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` (1 from ``threshold`` on) of every row of ``docs(doc_id, text)``."""
    rows = scored(docs, fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
