r"""Importance resampling of documents towards a target: hashed n-gram features, Gumbel scores, exact top k.

Texts are lower-cased (A-Z) and cut into words of letters, digits and characters beyond ASCII; features are all
runs of one to ``longest`` words, hashed by CRC-32 into buckets. A bucket's gain is the log ratio of its share in
the target and in all documents, both smoothed by one. A document's weight is the sum of its features' gains, its
score the weight plus a seeded Gumbel number: the documents of the highest scores are a draw without replacement
by weight.

Features are counted and scored as arrays over the words of many texts: the CRC of a run follows from those of its
words by the linearity of CRC. One pass counts, one scores; both only read the texts. The k-th highest key is found
by a distributed radix selection: each pass counts one digit of the composite key (score falling, then ``doc_id``
rising, then a hash of the text) of the rows that agree with the digits found so far, and brings at most 65,536
counts to the driver. Only the rows up to that key are sorted into ranges and ranked.

Null texts have no features and weight 0; a null ``doc_id`` is the empty word in the seed and comes after all
others; rows of one score and ``doc_id`` stand in the order of their texts' hashes, and equal rows are drawn one by
one. An empty table, or one without enough words, draws nothing. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .spark_tools import light_batches, pieces, ranked, record, stash

BUCKETS = 10_000
LONGEST = 3
#: Words of more bytes are rare: theirs are hashed one by one.
LONG_WORD = 64
#: Bytes of a text whose words are looked at together.
STRETCH = 1 << 22
DIGIT = 16  #: bits of a digit of the selection

OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """What a byte makes of the register (the reflected polynomial of CRC-32)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


TABLE = _byte_table()
_SHIFTS: list[np.ndarray] = []


def _shift_tables() -> list[np.ndarray]:
    """What up to ``LONG_WORD`` + 1 zero bytes make of each of a register's four bytes."""
    if not _SHIFTS:
        now = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
        tables = []
        for _ in range(LONG_WORD + 2):
            tables.append(np.stack(now))
            now = [TABLE[x & 255] ^ (x >> np.uint32(8)) for x in now]
        _SHIFTS.extend(np.ascontiguousarray(np.stack(tables)[:, k].ravel()) for k in range(4))
    return _SHIFTS


def shifted(register: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each register after so many zero bytes."""
    register, zeros = register.copy(), zeros.astype(np.int64)
    most = LONG_WORD + 1
    while len(far := np.flatnonzero(zeros > most)):
        # A run of zeros that the tables don't hold is taken in squares of their longest.
        times = zeros[far] // most
        register[far] = _powered(register[far], times)
        zeros[far] -= times * most
    tables, at = _shift_tables(), zeros * 256
    out = tables[0][at + (register & 255)]
    for k in range(1, 4):
        out ^= tables[k][at + ((register >> np.uint32(8 * k)) & 255)]
    return out


def _powered(register: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Each register after ``times`` runs of ``LONG_WORD`` + 1 zero bytes, by squaring."""
    step = [t[(LONG_WORD + 1) * 256 : (LONG_WORD + 2) * 256] for t in _shift_tables()]

    def applied(tables, x):
        return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]

    times = times.copy()
    while times.any():
        odd = (times & 1).astype(bool)
        register[odd] = applied(step, register[odd])
        step = [applied(step, t) for t in step]
        times >>= 1
    return register


def word_registers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The register of each word, begun with zero."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-size, kind="stable")
    long = int(np.count_nonzero(size > LONG_WORD))
    for i in order[:long].tolist():
        out[i] = ~np.uint32(zlib.crc32(data[starts[i] : ends[i]].tobytes()))
    if long:
        some = order[:long]
        out[some] ^= shifted(np.full(long, ONES), size[some])
    order = order[long:]
    from_start, lengths = starts[order], size[order]
    register = np.zeros(len(order), np.uint32)
    # Words stand by falling length, so those that still have a byte come first.
    counts = np.searchsorted(-lengths, -np.arange(1, (int(lengths[0]) if len(lengths) else 0) + 1), side="right")
    for p, n in enumerate(counts.tolist()):
        register[:n] = TABLE[(register[:n] ^ data[from_start[:n] + p]) & 255] ^ (register[:n] >> np.uint32(8))
    out[order] = register
    return out


def features(data: np.ndarray, offsets: np.ndarray, before: int = 0, buckets: int = BUCKETS, longest: int = LONGEST):
    """For runs of 1, 2 ... words: which words of the texts end one, and the runs' buckets; and the n + 1 offsets of the texts' words.

    ``before`` words at the start belong to a stretch before: no run that ends with them counts.
    """
    starts, ends, by_text = kernel.words(data, offsets, OUTSIDE)
    size = ends - starts
    own = word_registers(data, starts, ends)
    space = TABLE[np.full(len(starts), 0x20)]
    joined = shifted(space, size) ^ own  # a space and the word
    number = np.arange(len(starts)) - np.repeat(by_text[:-1], np.diff(by_text))
    register = shifted(np.full(len(starts), ONES), size) ^ own
    places = np.arange(len(starts))
    out = []
    for n in range(1, longest + 1):
        if n > 1:
            last = number[places] >= n - 1
            places = places[last]
            # The run of one word fewer that ends one word earlier, then a space and this word.
            register = shifted(held[places - 1], size[places] + 1) ^ joined[places]
        held = np.zeros(len(starts), np.uint32)
        held[places] = register
        keep = places >= before
        out.append((places[keep], ((register[keep] ^ ONES) % np.uint32(buckets)).astype(np.int64)))
    return out, by_text


def stretches(data: np.ndarray, longest: int = LONGEST, most: int = STRETCH):
    """One text in parts of about ``most`` bytes that end between words: the part, begun with the last words of the part before, and how many those are."""
    start, lead, before = 0, 0, 0
    while start < len(data):
        end = min(start + most, len(data))
        while end < len(data) and not OUTSIDE[data[end]]:
            gap = np.flatnonzero(OUTSIDE[data[end : end + most]])
            end = end + int(gap[0]) if len(gap) else min(end + most, len(data))
        yield data[lead:end], before
        firsts, _, _ = kernel.words(data[lead:end], np.array([0, end - lead]), OUTSIDE)
        before = min(longest - 1, len(firsts))
        start, lead = end, lead + int(firsts[-before]) if before else end


def _parts(batches, column: str, longest: int, stretch: int):
    """Texts a piece at a time, long ones in stretches: bytes, offsets, words that don't count, and which rows of the piece they are."""
    for piece in pieces(batches, column):
        data, offsets = kernel.text_bytes(piece.column(column))
        data = kernel.LOWER[data]
        if piece.num_rows == 1 and len(data) > stretch:
            yield piece, ((part, np.array([0, len(part)]), before) for part, before in stretches(data, longest, stretch))
        else:
            yield piece, [(data, offsets, 0)]


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, stretch: int = STRETCH) -> np.ndarray:
    """How many features of all texts fall into each bucket; at most ``buckets`` rows a task, summed in Spark."""
    light_batches(texts.sparkSession)
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for _, parts in _parts(batches, column, longest, stretch):
            for data, offsets, before in parts:
                for _, b in features(data, offsets, before, buckets, longest)[0]:
                    sums += np.bincount(b, minlength=buckets)
        some = np.flatnonzero(sums)
        yield record(schema, some, sums[some])

    found = texts.select(F.col(column).cast("string").alias(column)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # a row to a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Each bucket's log ratio of target and source share, smoothed by one, in whole parts of 1 / ``scale``."""
    n, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(scale * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(digits: int, scale: int = 1000) -> int:
    """A Gumbel number of 32 seeded bits, in whole parts of 1 / ``scale``."""
    return math.floor(-scale * math.log(-math.log((digits + 0.5) / 4294967296)))


SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()), ("tie", pa.int64())])


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 42, longest: int = LONGEST, stretch: int = STRETCH) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row, and ``tie``, a hash of the text."""
    light_batches(docs.sparkSession)

    def score(batches):
        for piece, parts in _parts(batches, "text", longest, stretch):
            n = piece.num_rows
            words, count, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for data, offsets, before in parts:
                runs, by_text = features(data, offsets, before, len(gain), longest)
                words += np.diff(by_text) - before
                each, number = np.zeros(by_text[-1] + 1, np.int64), np.zeros(by_text[-1] + 1, np.int64)
                for places, b in runs:
                    each[places + 1] += gain[b]
                    number[places + 1] += 1
                weight += np.diff(np.cumsum(each)[by_text])
                count += np.diff(np.cumsum(number)[by_text])
            ids = piece.column("doc_id").to_pylist()
            seeds = [int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) for i in ids]
            noise = np.array([gumbel(h) for h in seeds], np.int64)
            yield record(SCORED, ids, words, count, weight, weight + noise, piece.column("tie"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long, tie long")


def lowest(rows: DataFrame, order: list[Column], k: int) -> list[tuple[Column, int]] | None:
    """Digits of the ``k``-th least key, as (digit, value) from the first; those that decide nothing more are left out.

    ``order`` are columns of whole numbers, rising, not null. None if there are fewer than ``k`` rows, or ``k`` is 0.
    """
    least = rows.agg(F.count("*").alias("n"), *(x for i, c in enumerate(order) for x in (F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")))).first()
    if k < 1 or least["n"] < k:
        return None
    found: list[tuple[Column, int]] = []
    left = k
    for i, c in enumerate(order):
        width = least[f"b{i}"] - least[f"a{i}"]
        if not width:
            continue
        # Where the difference takes all 64 bits, the sign is turned instead of taking the least value away.
        for shift in range(max(0, -(-width.bit_length() // DIGIT) - 1) * DIGIT, -1, -DIGIT):
            rest = F.shiftrightunsigned(c - F.lit(least[f"a{i}"]), shift) if width < 1 << 63 else F.shiftrightunsigned(c.bitwiseXOR(F.lit(-(1 << 63))), shift)
            digit = rest.bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int")
            same = F.lit(True)
            for d, value in found:
                same = same & (d == value)
            counts = sorted((r["d"], r["n"]) for r in rows.where(same).groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect())  # at most 2**DIGIT rows
            for value, n in counts:
                if left <= n:
                    break
                left -= n
            found.append((digit, value))
            if left == n:
                return found
    return found


def until(digits: list[tuple[Column, int]]) -> Column:
    """Whether a row's key isn't above the one that the digits describe."""
    below, same = F.lit(False), F.lit(True)
    for digit, value in digits:
        below = below | (same & (digit < value))
        same = same & (digit == value)
    return below | same


def resampled(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, longest: int = LONGEST, stretch: int = STRETCH) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs(doc_id, text)``; ``target`` has ``text``.

    Of the N rows of ``least_words`` words or more the floor(N * share) of highest score are drawn and ranked from
    1; the others have a null rank. Texts of more than ``stretch`` bytes are worked on in parts.
    """
    source, aim = (bucket_counts(t, "text", buckets, longest, stretch) for t in (docs, target))
    rows = stash(scored(docs, gains(source, aim), seed, longest, stretch))
    fit = rows.where(F.col("n_words") >= least_words)
    k = fit.count() * share[0] // share[1]
    order = [-F.col("score"), F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.col("doc_id").isNull().cast("long"), F.col("tie")]
    digits = lowest(fit, order, k)
    names = ("doc_id", "n_features", "weight", "score")
    if digits is None:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & until(digits)
    # Equal rows may share the last key; they get different ranks, and those beyond k aren't drawn.
    top = ranked(rows.where(drawn), [c.asc() for c in order], "rank").withColumn("rank", (F.col("rank") + 1).cast("long"))
    top = top.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    rest = rows.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return top.select(*names, "rank").unionByName(rest.select(*names, "rank"))
