"""SimHash fingerprints of documents and exact search within a Hamming radius.

The terms of a text are its word bigrams (its only word, where there is one).
A term weighs ``1 + ln(count)``; the signed bits of its 64-bit hash vote with
that weight, and a bit of the fingerprint is set where the votes are positive.
A text without words has the fingerprint 0. Null texts count as empty.

Rows that repeat get equal results each; other columns aren't read (``fingerprinted``
keeps them, and raises if one has the name of its result).

``neighbours`` finds all fingerprints within a radius by permuted block tables:
the 64 bits are cut into blocks, and two fingerprints that differ in at most
``radius`` bits agree in at least ``blocks - radius`` blocks, so they meet in the
table that leads with those blocks.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import kernel
from .spark_tools import light_batches, partitions, pieces, record

BITS = 64
HOT = 1000  #: fingerprints of a block from which it is split by the bits that are left
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1


def fingerprints(texts: pa.Array) -> np.ndarray:
    """A 64-bit fingerprint of each text."""
    data, offsets = kernel.text_bytes(texts)
    starts, ends, by_doc = kernel.words(data, offsets)
    terms, counts, places = kernel.distinct(*kernel.ngrams(kernel.spans(kernel.prefix(data), starts, ends), by_doc, 2))
    doc = np.repeat(np.arange(len(texts)), np.diff(places))
    weight = 1 + np.log(counts)
    out = np.zeros(len(texts), np.uint64)
    # The votes of a byte's eight bits: a histogram of its values, times their signs.
    for k in range(8):
        byte = (terms >> np.uint64(8 * k)) & np.uint64(255)
        held = np.bincount(doc * 256 + byte.astype(np.int64), weight, minlength=256 * len(texts)).reshape(-1, 256)
        bits = np.packbits(held @ _SIGNS > 0, axis=1)[:, 0]
        out |= bits.astype(np.uint64) << np.uint64(8 * k)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits, 0 to 1."""
    return 1 - np.bitwise_count(a ^ b) / BITS


def fingerprinted(docs: DataFrame, column: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the 64-bit fingerprint of ``column`` as a signed long."""
    light_batches(docs.sparkSession)

    @arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = [fingerprints(p.column("text")) for p in pieces([pa.RecordBatch.from_arrays([texts], ["text"])])]
        return pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))

    if out in docs.columns:
        raise ValueError(f"there is a column {out!r} already; name another")
    return docs.withColumn(out, of(F.col(column).cast("string")))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(places: list[list[int]], agree: int) -> list[int]:
    """For each choice of ``agree`` of the blocks of bit places, the bits of those."""
    return [_signed(sum(1 << x for block in chosen for x in block)) for chosen in combinations(places, agree)]


def near_prints(queries: DataFrame, table: DataFrame, radius: int = 3, blocks: int = 6, hot: int = HOT) -> DataFrame:
    """All ``(a, b, distance)`` of distinct fingerprints of ``queries(fingerprint)`` and ``table(fingerprint)``
    that differ in at most ``radius`` bits, by one block table for each choice of ``blocks - radius`` blocks.

    Fingerprints that share a block with more than ``hot`` others meet there only where they also agree in
    as many blocks of the bits that are left.
    """
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    places = [list(range(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    masks, finer = _masks(places, blocks - radius), []
    for chosen in combinations(range(blocks), blocks - radius):
        left = [x for k in range(blocks) if k not in chosen for x in places[k]]
        cuts = [len(left) * k // blocks for k in range(blocks + 1)]
        finer.append(_masks([left[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], blocks - radius))

    def placed(df: DataFrame, name: str) -> DataFrame:
        only = df.where("fingerprint is not null").select(F.col("fingerprint").alias(name)).distinct()
        keys = F.array(*(F.struct(F.lit(i).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)))
        return only.select(name, F.explode(keys).alias("k")).select(name, "k.t", "k.v")

    def again(df: DataFrame, name: str) -> DataFrame:
        more = F.get(F.array(*(F.array(*map(F.lit, m)) for m in finer)), F.col("t"))
        return df.select(name, "t", "v", F.posexplode(more).alias("s", "m")).select(name, "t", "v", "s", F.col(name).bitwiseAND(F.col("m")).alias("w"))

    asked, held = placed(queries, "a"), placed(table, "b")
    often = held.groupBy("t", "v").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("t", "v", F.lit(True).alias("often"))
    # Neither the tables nor their hot blocks have a bounded size, so all joins shuffle.
    asked, held = (df.join(often.hint("merge"), ["t", "v"], "left") for df in (asked, held))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    few = asked.where("often is null").drop("often").join(held.where("often is null").drop("often").hint("merge"), ["t", "v"])
    many = again(asked.where("often"), "a").join(again(held.where("often"), "b").hint("merge"), ["t", "v", "s", "w"])
    near = few.select("a", "b").where(distance <= radius).unionByName(many.select("a", "b").where(distance <= radius))
    return near.distinct().withColumn("distance", distance)


def neighbours(queries: DataFrame, table: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs ``(query_id, id, distance)`` of ``queries(id, fingerprint)`` and ``table(id, fingerprint)``
    whose fingerprints differ in at most ``radius`` bits; an id isn't paired with itself.

    Ids that share a fingerprint are one row of a block table. Rows without id or
    fingerprint take no part.
    """
    near = near_prints(queries.where("id is not null"), table.where("id is not null"), radius, blocks)
    q = queries.select(F.col("id").alias("query_id"), F.col("fingerprint").alias("a"))
    return near.join(q, "a").join(table.select("id", F.col("fingerprint").alias("b")), "b").where("query_id <> id").select("query_id", "id", "distance")


def counted_neighbours(rows: DataFrame, every: int = 20, radius: int = 3) -> DataFrame:
    """``rows(doc_id, bits)`` with ``n_near``: of rows whose id ``every`` divides, how many other
    rows of all lie within ``radius`` bits; null for the rest. ``rows`` is read more than once."""
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    held = rows.groupBy(F.col("bits").alias("fingerprint")).agg(F.count("*").alias("copies"))
    near = near_prints(rows.where(asked).select(F.col("bits").alias("fingerprint")), held, radius)
    counts = near.join(held.hint("merge"), near["b"] == held["fingerprint"]).groupBy("a").agg((F.sum("copies") - 1).alias("others"))
    found = rows.where(asked).join(counts.hint("merge"), F.col("bits") == F.col("a"), "left")
    found = found.select(*rows.columns, F.coalesce("others", F.lit(0)).alias("n_near"))
    return found.unionByName(rows.where(~asked).withColumn("n_near", F.lit(None).cast("long")))


EDITED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("bits", pa.int64())])


def _hex(prints: np.ndarray) -> list[str]:
    return [f"{x:016x}" for x in prints.tolist()]


def _compare(rows: list[tuple]) -> pa.RecordBatch:
    """Rows: (doc_id, text, next text)."""
    texts, nexts = [r[1] for r in rows], [r[2] for r in rows]
    edited = [t[: len(t) - (k := len(t) // 3)] + n[:k] for t, n in zip(texts, nexts, strict=True)]
    own, other, then = (fingerprints(pa.array(x, pa.large_string())) for x in (texts, edited, nexts))
    return record(EDITED, pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), [hashlib.sha256(e.encode()).hexdigest() for e in edited], _hex(own), _hex(other), likeness(own, other), likeness(own, then), own.view(np.int64))


def _in_order(batches):
    """Rows come sorted by (bucket, lead, order); each is compared with the next of its bucket."""
    bucket, last, rows, size = None, None, [], 0
    for batch in pieces(batches):
        for b, tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")), strict=True):
            if b == bucket and last is not None:
                rows.append((*last, text))
                size += len(last[1]) + len(text)
                if size > 1 << 20:
                    yield _compare(rows)
                    rows, size = [], 0
            bucket, last = b, None if tail else (doc_id, text)
    if rows:
        yield _compare(rows)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next, in descending ``doc_id``.

    The edited text has the last third (rounded down) of the code points replaced
    by the first as many, or all, of the next document; after the last comes the
    first. Null ids come last, rows of one id in the order of their texts' hashes.

    ``bits`` is the fingerprint as a signed long.

    Rows are dealt into buckets of consecutive ids; the first row of a bucket goes
    to the bucket before as well, so that one shuffle of the texts is enough.
    """
    spark = docs.sparkSession
    light_batches(spark)
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    @arrow_udf("int")
    def bucket_of(ids: pa.Array) -> pa.Array:
        """0 for the largest ids, the last bucket for the ids that are null."""
        known = len(cuts) - np.searchsorted(cuts, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), "right")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), len(cuts) + 1, known), pa.int32())

    dealt = rows.withColumn("bucket", bucket_of("doc_id")).withColumn("h", F.xxhash64("text"))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")
    # A row to a bucket, and so to a partition.
    tops = dealt.groupBy("bucket").agg(F.max(key).alias("top")).orderBy("bucket").collect()
    heads = {(t["bucket"], t["top"]["doc_id"], t["top"]["h"]): tops[i - 1]["bucket"] for i, t in enumerate(tops)}

    @arrow_udf("int")
    def also_in(bucket: pa.Array, ids: pa.Array, h: pa.Array) -> pa.Array:
        """For the first row of a bucket, the bucket before."""
        return pa.array([heads.get(x) for x in zip(bucket.to_pylist(), ids.to_pylist(), h.to_pylist(), strict=True)], pa.int32())

    home = F.struct("bucket", F.lit(False).alias("tail"))
    guest = F.struct(F.col("guest").alias("bucket"), F.lit(True).alias("tail"))
    places = F.when(F.col("guest").isNull(), F.array(home)).otherwise(F.array(home, guest))
    spread = dealt.withColumn("guest", also_in("bucket", "doc_id", "h")).select("doc_id", "text", F.explode(places).alias("p")).select("p.bucket", "p.tail", "doc_id", "text")
    ordered = spread.repartition(n, "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())
    return ordered.mapInArrow(_in_order, _schema())


def _schema() -> str:
    return "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bits long"
