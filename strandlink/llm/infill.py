"""Fill-in-middle transformation: a text is cut at two seeded places and its parts are put into another order.

Places are counted in units (lines, words or characters). Between two units there is a boundary, which two
adjacent bytes show. A text is decomposed into chunks that overlap by one byte, so that every pair of adjacent
bytes lies in one chunk. Each chunk counts its boundaries and code points by itself, whole arrays at a time;
sums over the chunks before it give the ranks of its boundaries, which route both cuts to the chunks that hold
them; only those two are scanned again. What is held besides the text are two numbers a chunk. Texts are
dealt out by Spark as the table is read; nothing is shuffled.

Forms: ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix, middle),
each part behind its sentinel. A text that is empty or holds a sentinel is plain, so that ``restored`` gives
every text back. Null texts count as empty, a null ``doc_id`` as the empty word in the seed; rows that repeat
are transformed alike; an empty table gives none. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .spark_tools import light_batches, pieces, record

#: Bytes of a chunk, but for the one that it shares with the next.
CHUNK = 1 << 16
SENTINELS = ("<P>", "<S>", "<M>")

#: Whether a unit ends between two adjacent bytes.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "line": lambda left, right: left == 0x0A,
    "word": lambda left, right: kernel.SPACE[left] & ~kernel.SPACE[right],
    "char": lambda left, right: (right & 0xC0) != 0x80,
}


def starts_character(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


class Chunked:
    """One text in chunks: boundaries and code points before each."""

    def __init__(self, data: np.ndarray, unit: str, size: int = CHUNK):
        self.data, self.between, self.size = data, UNITS[unit], size
        self.starts = range(0, len(data), size)
        self.boundaries = np.cumsum([0, *(np.count_nonzero(self._boundaries(s)) for s in self.starts)])
        self.points = np.cumsum([0, *(np.count_nonzero(starts_character(data[s : s + size])) for s in self.starts)])
        self.units = int(self.boundaries[-1]) + (len(data) > 0)

    def _boundaries(self, start: int) -> np.ndarray:
        chunk = self.data[start : start + self.size + 1]
        return self.between(chunk[:-1], chunk[1:])

    def place(self, rank: int) -> tuple[int, int]:
        """Where the first ``rank`` units end, in bytes and in code points."""
        if rank <= 0:
            return 0, 0
        if rank >= self.units:
            return len(self.data), int(self.points[-1])
        owner = int(np.searchsorted(self.boundaries, rank)) - 1
        start = self.starts[owner]
        within = int(np.flatnonzero(self._boundaries(start))[rank - 1 - self.boundaries[owner]]) + 1
        return start + within, int(self.points[owner]) + int(np.count_nonzero(starts_character(self.data[start : start + within])))


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Raises unless no sentinel begins with the end of one, so that texts without them can be told apart from them."""
    if len(sentinels) != 3 or not all(sentinels):
        raise ValueError("three sentinels that aren't empty are needed")
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if any(a.endswith(b[:k]) for k in range(1, len(b) + (i != j))) or i != j and b in a:
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")


OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("output", pa.large_string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])
OUT_SQL = "doc_id long, n long, form string, output string, prefix_chars long, middle_chars long"


def transformed(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n, form, output, prefix_chars, middle_chars`` of every row of ``docs(doc_id, text)``.

    ``n`` is the number of units. Of the texts that can be cut ``rate`` percent are, and of those ``spm`` percent
    as ``spm``. Cuts, rate and form follow the first four groups of eight hex digits of the SHA-256 of
    ``<seed>:<doc_id>``. Lengths are code points, null for plain texts.
    """
    check_sentinels(sentinels)
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}; one of {', '.join(UNITS)}")
    light_batches(docs.sparkSession)
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    held = F.lit(False)
    for s in sentinels:
        held = held | F.contains("text", F.lit(s))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", *(F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)), held.alias("held"))
    p, s, m = (x.encode() for x in sentinels)

    def cut(batches):
        for piece in pieces(batches):
            data, offsets = kernel.text_bytes(piece.column("text"))
            h1, h2, h3, h4, held = (piece.column(c).to_pylist() for c in ("h1", "h2", "h3", "h4", "held"))
            out = []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                text = Chunked(data[a:b], unit, chunk)
                if held[k] or a == b or h3[k] % 100 >= rate:
                    out.append((text.units, "plain", text.data.tobytes(), None, None))
                    continue
                first, last = sorted((h1[k] % (text.units + 1), h2[k] % (text.units + 1)))
                (i, before), (j, until) = text.place(first), text.place(last)
                prefix, middle, suffix = text.data[:i].tobytes(), text.data[i:j].tobytes(), text.data[j:].tobytes()
                form = "spm" if h4[k] % 100 < spm else "psm"
                output = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
                out.append((text.units, form, b"".join(output), before, until - before))
            n, form, output, before, middle = zip(*out, strict=True)
            yield record(OUT, piece.column("doc_id"), n, form, pa.array(output, pa.large_binary()).cast(pa.large_string()), before, middle)

    return rows.mapInArrow(cut, OUT_SQL)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``transformed`` made ``output`` of."""
    check_sentinels(sentinels)
    # Parts lie behind their sentinels, so the first of the list is empty.
    parts = F.split(output, "|".join(map(re.escape, sentinels)))
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
