"""Exact removal of repeated byte strings with a sparse suffix array.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier
(in a document of smaller id, or earlier in the same document). Two windows of
that length are equal only if they have the same anchor (the leftmost of its
``ANCHOR``-byte pieces with the least hash) at the same place, so it is enough to
compare the windows of anchors with equal pieces:

1. *Anchors.* Of anchors that are equal in a stretch of texts in all that their
   windows span, the first travels, packed, to the range of its hash; the others
   are repeats as a whole. There, anchors alone with their piece are done, and those
   whose span is equal to an earlier anchor's are repeats as a whole (by a 32-byte
   piece and a span that agree in two hashes of 64 bits).
2. *Suffixes.* The anchors that are left send the bytes that their windows span.
   What stands right of them, and reversed what stands left, is sorted deep and
   shallow: multikey quicksort to a shallow depth (by eight bytes a time), then
   blind tries for the groups that still agree. The longest common prefixes of
   neighbours in both orders say which windows are equal, byte for byte. A piece
   in very many surroundings (the border of a common passage) is split by further
   bytes: the windows that begin 0 to 34 bytes before the anchor all hold the 66 bytes
   from it, the others the 35 bytes before it, and so on by halves, until a group is
   small enough for one task; windows that stay together to the end are grouped by
   their bytes.
3. *Removal.* Every document is joined with the starts of its repeated windows.

Null texts count as empty. Rows of one ``doc_id`` are ordered by their texts'
hashes, null ids come last; rows equal in both are one document and get equal
results. Texts shorter than ``LENGTH`` keep every byte. Other columns aren't read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .spark_tools import light_batches, pieces, ranges_of, ranked, record, release, stash

LENGTH, ANCHOR = 100, 32
REACH = LENGTH - ANCHOR  #: bytes of a window before its anchor at most
SHALLOW = 32  #: depth of the multikey quicksort
HOT = 5000  #: different surroundings of a piece from which it is split by further bytes
STRETCH = 1 << 19  #: anchors of a task among which equal ones are found before they travel
PLACE = 28  #: bits of a place, beside the high bits of the hash
STARTS = 1 << 22  #: windows whose anchors are chosen at a time; with a window more they must fit in ``PLACE`` bits


def anchors(data: np.ndarray, offsets: np.ndarray, starts: int = STARTS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a batch: text, place, first and last start of their windows (all in the batch), and prefix sums.

    Places are chosen for ``starts`` windows at a time, so neither the bits of a place nor the room for
    the choice grow with a text.
    """
    sums = kernel.prefix(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    found = [none, *(_chosen(sums, offsets, a, min(a + starts, len(data) - LENGTH + 1)) for a in range(0, len(data) - LENGTH + 1, starts))]
    text, place, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    # An anchor whose windows stand on both sides of a border is one.
    fresh = np.flatnonzero(_changes(text, place))
    return text[fresh], place[fresh], first[fresh], last[np.append(fresh[1:], len(text)) - 1] if len(fresh) else last, sums


def _changes(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(text), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    return fresh


def _chosen(sums: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows that start from ``a`` to before ``b``: text, place, first and last start."""
    at = np.arange(a, b + REACH)
    least = (kernel.spans(sums, at, at + ANCHOR) >> np.uint64(PLACE) << np.uint64(PLACE)) | (at - a).astype(np.uint64)
    width = 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    place = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64) + a
    # Windows that lie within one text.
    text = np.searchsorted(offsets, np.arange(a, b), "right") - 1
    start = np.flatnonzero(np.arange(a, b) + LENGTH <= offsets[1:][text])
    text, place = text[start], place[start]
    first = np.flatnonzero(_changes(text, place))
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    return text[first], place[first], start[first] + a, start[last] + a


PARTS = pa.schema([("r", pa.int64()), ("body", pa.binary())])
#: What travels of an anchor: low bits of its piece's hash, hash of all that its windows span, document, place, and its windows' first and last start from it.
ANCHOR_TYPE = np.dtype([("piece", "<u4"), ("span", "<u8"), ("ord", "<i8"), ("at", "<u4"), ("left", "u1"), ("right", "u1")])
FLAGS = pa.schema([("whole", pa.bool_()), ("hot", pa.bool_()), ("ord", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
FLAGS_SQL = "whole boolean, hot boolean, ord long, at int, first int, last int"


RUN_TYPE = np.dtype([("ord", "<i8"), ("first", "<i4"), ("last", "<i4")])


def _range_of(hashed: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each anchor. Hashes of anchors are the least of many, so they are mixed once more."""
    return (kernel.mix(hashed) >> np.uint64(64 - (ranges.bit_length() - 1))).astype(np.int64)


def _parted(names: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Rows packed by name; ``names`` are sorted."""
    found, starts = np.unique(names, return_index=True)
    ends = np.append(starts[1:], len(names))
    return record(PARTS, found, pa.array([rows[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()))


def _sorted_out(hashed: np.ndarray, rows: np.ndarray, ranges: int):
    """Of a stretch: the first of equal anchors by range of hash, and the windows of the others as runs, by document, in ranges below 0."""
    order = np.lexsort((rows["at"], rows["ord"], rows["span"], hashed))
    hashed, rows = hashed[order], rows[order]
    again = np.append(False, (hashed[1:] == hashed[:-1]) & (rows["span"][1:] == rows["span"][:-1]))
    names = _range_of(hashed[~again], ranges)
    by = np.argsort(names, kind="stable")
    yield _parted(names[by], rows[~again][by])
    if again.any():
        some = rows[again]
        runs = np.zeros(len(some), RUN_TYPE)
        at = some["at"].astype(np.int64)
        runs["ord"], runs["first"], runs["last"] = some["ord"], at - some["left"], at + some["right"] - REACH
        runs = runs[np.lexsort((runs["first"], runs["ord"]))]
        fresh = np.append(True, (runs["ord"][1:] != runs["ord"][:-1]) | (runs["first"][1:] > runs["last"][:-1] + 1))
        edges = np.flatnonzero(fresh)
        last = runs["last"][np.append(edges[1:], len(runs)) - 1]
        runs = runs[edges]
        runs["last"] = last
        names = -1 - (kernel.mix(runs["ord"].view(np.uint64).copy()) % np.uint64(ranges)).astype(np.int64)
        by = np.argsort(names, kind="stable")
        yield _parted(names[by], runs[by])


def _scan(ranges: int, stretch: int):
    def of(batches):
        hashes, waiting, held = [], [], 0
        for piece in pieces(batches):
            data, offsets = kernel.text_bytes(piece.column("text"))
            text, place, first, last, sums = anchors(data, offsets)
            if not len(text):
                continue
            hashed = kernel.spans(sums, place, place + ANCHOR)
            rows = np.zeros(len(text), ANCHOR_TYPE)
            rows["piece"] = (hashed & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows["left"], rows["right"] = place - first, last + REACH - place
            rows["span"] = kernel.mix(kernel.spans(sums, first, last + LENGTH) + rows["left"].astype(np.uint64))
            rows["ord"] = piece.column("ord").to_numpy(zero_copy_only=False)[text]
            rows["at"] = place - offsets[:-1][text]
            hashes.append(hashed)
            waiting.append(rows)
            held += len(rows)
            if held >= stretch:
                yield from _sorted_out(np.concatenate(hashes), np.concatenate(waiting), ranges)
                hashes, waiting, held = [], [], 0
        if held:
            yield from _sorted_out(np.concatenate(hashes), np.concatenate(waiting), ranges)

    return of


def _flagged(hot: int):
    """Of one range: anchors whose windows are all repeats, and those whose bytes must be compared."""

    def of(table: pa.Table) -> pa.Table:
        bodies = table.column("body").to_pylist()
        if table.column("r")[0].as_py() < 0:
            runs = np.concatenate([np.frombuffer(b, RUN_TYPE) for b in bodies])
            yes, no = pa.array(np.ones(len(runs), bool)), pa.array(np.zeros(len(runs), bool))
            return pa.Table.from_batches([record(FLAGS, yes, no, runs["ord"].copy(), runs["first"].copy(), runs["first"].copy(), runs["last"].copy())], schema=FLAGS)
        rows = np.concatenate([np.frombuffer(b, ANCHOR_TYPE) for b in bodies])
        rows = rows[np.lexsort((rows["at"], rows["ord"], rows["span"], rows["piece"]))]
        piece = np.append(True, rows["piece"][1:] != rows["piece"][:-1])
        span = piece | np.append(True, rows["span"][1:] != rows["span"][:-1])
        # Pieces with several spans: the first of each span is to be compared.
        group = np.cumsum(piece) - 1
        spans = np.bincount(group, span)
        keep = ~span | (spans > 1)[group]
        rows, whole, often = rows[keep], ~span[keep], (spans > hot)[group][keep]
        at = rows["at"].astype(np.int32)
        first = at - rows["left"]
        last = at + rows["right"] - REACH
        return pa.Table.from_batches([record(FLAGS, pa.array(whole), pa.array(often), rows["ord"].copy(), at, first.astype(np.int32), last.astype(np.int32))], schema=FLAGS)

    return of


#: An anchor with the bytes that its windows span, and the least and most bytes before it with which they are compared.
SPANS = pa.schema([("r", pa.int64()), ("ord", pa.int64()), ("at", pa.int32()), ("left", pa.int32()), ("bytes", pa.binary()), ("low", pa.int32()), ("high", pa.int32())])
#: As they are sent: with whether the anchor's piece is in very many surroundings.
SENT = SPANS.append(pa.field("hot", pa.bool_()))
SENT_SQL = "r long, ord long, at int, left int, bytes binary, low int, high int, hot boolean"


def _sent(ranges: int):
    """The bytes that the windows of the flagged anchors span, to the range of the anchor's piece."""

    def of(batches):
        for piece in pieces(batches):
            data, offsets = kernel.text_bytes(piece.column("text"))
            sums = kernel.prefix(data)
            asked = piece.column("asked")
            owner = np.repeat(np.arange(piece.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
            at, first, last = (asked.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            base = offsets[:-1][owner]
            r = _range_of(kernel.spans(sums, base + at, base + at + ANCHOR), ranges)
            raw = data.tobytes()
            held = [raw[a:b] for a, b in zip((base + first).tolist(), (base + last + LENGTH).tolist(), strict=True)]
            often = pc.fill_null(asked.flatten().field(3), False)
            yield record(SENT, r, piece.column("ord").take(pa.array(owner)), at.astype(np.int32), (at - first).astype(np.int32), pa.array(held, pa.binary()), np.zeros(len(at), np.int32), np.full(len(at), REACH, np.int32), often)

    return of


class BlindTrie:
    """Orders strings of one length: nodes know only how deep they branch and by which byte."""

    def __init__(self, strings: list[bytes], depth: int):
        self.strings, self.depth = strings, depth
        self.root: list | None = None  # [depth, {byte: child}]; a leaf is a list of places with depth -1
        for i in range(len(strings)):
            self._insert(i)

    @staticmethod
    def _common(a: bytes, b: bytes, low: int) -> int:
        high = len(a)
        if a == b:
            return high
        while low < high - 1:
            middle = (low + high) // 2
            if a[low:middle] == b[low:middle]:
                low = middle
            else:
                high = middle
        return low if a[low : low + 1] != b[low : low + 1] else low + 1

    def _insert(self, i: int) -> None:
        new = self.strings[i]
        if self.root is None:
            self.root = [-1, [i]]
            return
        # Blind descent: by branching bytes alone, to any leaf below.
        node = self.root
        while node[0] >= 0:
            child = node[1].get(new[node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        same = self._common(new, self.strings[node[1][0]], self.depth)
        if same == len(new):
            node[1].append(i)
            return
        # Down again, to the edge on which the strings part.
        above, node = None, self.root
        while 0 <= node[0] < same:
            above, node = node, node[1][new[node[0]]]
        if node[0] == same:
            node[1][new[same]] = [-1, [i]]
            return
        some = node
        while some[0] >= 0:
            some = next(iter(some[1].values()))
        split = [same, {self.strings[some[1][0]][same]: node, new[same]: [-1, [i]]}]
        if above is None:
            self.root = split
        else:
            above[1][new[above[0]]] = split

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out += node[1]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(rows: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """The order of the rows of a byte matrix."""
    n = len(rows)
    order, group = np.arange(n), np.zeros(n, np.int64)
    for k in range(0, shallow, 8):
        word = np.ascontiguousarray(rows[order, k : k + 8]).view(">u8")[:, 0].astype(np.uint64)
        by = np.lexsort((word, group))
        order, group, word = order[by], group[by], word[by]
        group = np.cumsum(np.append(False, (word[1:] != word[:-1]) | (group[1:] != group[:-1])))
    if not n:
        return order
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    ends = np.append(edges[1:], n)
    for a, b in zip(edges[ends - edges > 1].tolist(), ends[ends - edges > 1].tolist(), strict=True):
        some = order[a:b]
        order[a:b] = some[BlindTrie([r.tobytes() for r in rows[some]], shallow).order()]
    return order


def common(rows: np.ndarray) -> np.ndarray:
    """The longest common prefix of each row with the row before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 50_000):
        b = min(a + 50_000, len(rows))
        differ = rows[a:b] != rows[a - 1 : b - 1]
        out[a:b] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = deep_shallow(rows)
    return order, common(rows[order])


def _compared(table: pa.Table) -> pa.Table:
    """Of one range: the windows that repeat an earlier one, as runs of starts."""
    table = table.sort_by([("ord", "ascending"), ("at", "ascending")])
    at, left, low, high = (table.column(c).to_numpy().astype(np.int64) for c in ("at", "left", "low", "high"))
    held = table.column("bytes").combine_chunks()
    data, offsets = kernel.text_bytes(held)
    size = np.diff(offsets)
    n = len(at)
    j = np.arange(LENGTH)
    padded = np.append(data, np.zeros(2 * LENGTH, np.uint8))
    right = padded[(offsets[:-1] + left)[:, None] + j]
    right[j >= (size - left)[:, None]] = 0
    j = np.arange(72)
    behind = (offsets[:-1] + left)[:, None] - 1 - j
    before = padded[np.maximum(behind, 0)]
    before[j >= left[:, None]] = 0
    orders = [(*_classes(m),) for m in (right, before)]
    # A window has this many bytes before the anchor at least, and at most.
    least, most = np.maximum(LENGTH - (size - left), low), np.minimum(left, high)
    repeated = np.zeros((n, REACH + 3), bool)
    for k in range(REACH + 1):
        chosen = np.flatnonzero((least <= k) & (k <= most))
        if len(chosen) < 2:
            continue
        ids = []
        for (order, lcp), need in zip(orders, (LENGTH - k, k), strict=True):
            name = np.empty(n, np.int64)
            name[order] = np.cumsum(lcp < need)
            ids.append(name[chosen])
        both = ids[0] * (n + 1) + ids[1]
        _, first = np.unique(both, return_index=True)
        later = np.ones(len(chosen), bool)
        later[first] = False
        repeated[chosen[later], k + 1] = True
    edge = np.diff(repeated.astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    # k bytes before the anchor: the window starts at at - k; low and high - 1 are the run's least and largest k.
    o = table.column("ord").to_numpy()[row]
    return pa.Table.from_batches([record(FLAGS, pa.array(np.ones(len(row), bool)), pa.array(np.zeros(len(row), bool)), o, at[row].astype(np.int32), (at[row] - high + 1).astype(np.int32), (at[row] - low).astype(np.int32))], schema=FLAGS)


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def removed_mask(n: int, starts) -> np.ndarray:
    """Bytes covered by windows; ``starts``: pairs of a run's first and last start."""
    change = np.zeros(n + 1, np.int64)
    for first, last in starts:
        change[first] += 1
        change[last + LENGTH] -= 1
    return np.cumsum(change[:-1]) > 0


def _kept(texts: bool):
    def of(batches):
        for piece in pieces(batches):
            rows = []
            for text, runs in zip(piece.column("text").to_pylist(), piece.column("runs").to_pylist(), strict=True):
                raw = (text or "").encode()
                gone = removed_mask(len(raw), [(x["first"], x["last"]) for x in runs or ()])
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                rows.append((len(raw), int(gone.sum()), spans, kept if texts else hashlib.sha256(kept).hexdigest()))
            schema = KEPT.set(4, pa.field("kept", pa.binary())) if texts else KEPT
            yield record(schema, piece.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types[1:], strict=True)))

    return of


def _asked(source: DataFrame, flags: DataFrame, ranges: int) -> DataFrame:
    """The bytes that the windows of the anchors in ``flags`` span. It moves the texts, so all anchors ask at once."""
    asked = flags.groupBy("ord").agg(F.collect_list(F.struct("at", "first", "last", "hot")).alias("asked")).withColumnRenamed("ord", "o")
    # Always by sorted shuffles, so that what is moved grows as the input does.
    rows = source.join(asked.hint("merge"), source["ord"] == F.col("o")).select("ord", "text", "asked")
    return rows.mapInArrow(_sent(ranges), SENT_SQL)


def _split(sent: DataFrame, ranges: int, hot: int) -> DataFrame:
    """Repeated windows of anchors whose pieces are in more than ``hot`` surroundings, as runs.

    Windows with ``low`` to ``high`` bytes before the anchor share the bytes from ``low`` before it to
    ``LENGTH - high`` after it, so anchors that differ in those share none of them. Groups
    of at most ``hot`` anchors are compared in a task; larger ones are halved.
    """

    def halves(rows: DataFrame) -> DataFrame:
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        both = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))
        rows = rows.select("ord", "at", "left", "bytes", F.explode(both).alias("x")).select("ord", "at", "left", "bytes", "x.*")
        least = F.greatest(F.lit(0), LENGTH - (F.length("bytes") - F.col("left")))
        return rows.where((F.col("low") <= F.col("left")) & (F.col("high") >= least))

    def held(size: Column) -> Column:
        return F.substring(F.col("bytes"), F.col("left") - F.col("low") + 1, size)

    rows, found = sent.drop("r"), []
    for _ in range(REACH.bit_length()):
        rows = halves(rows.where("low < high")).withColumn("name", F.xxhash64("low", held(LENGTH - (F.col("high") - F.col("low")))))
        rows = stash(rows)
        sizes = rows.groupBy("name").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("name", "n")
        rows = stash(rows.join(sizes, F.col("name") == F.col("n")).drop("n"))
        small = rows.where(F.col("size") <= hot).withColumn("r", F.pmod("name", F.lit(ranges)))
        found.append(stash(small.select(*SPANS.names).groupBy("r").applyInArrow(_compared, FLAGS_SQL)))
        rows = rows.where(F.col("size") > hot).drop("name", "size")
        last = rows.where("low = high").select("ord", (F.col("at") - F.col("low")).alias("start"), held(F.lit(LENGTH)).alias("window"))
        # Tasks sum up their own windows before they travel.
        first = last.groupBy(F.col("window").alias("w")).agg(F.min(F.struct("ord", "start")).alias("first"))
        later = last.join(first, F.col("window") == F.col("w")).where(F.struct("ord", "start") != F.col("first"))
        yes = F.lit(True)
        found.append(stash(later.select(yes.alias("whole"), yes.alias("hot"), "ord", F.col("start").alias("at"), F.col("start").alias("first"), F.col("start").alias("last"))))
        if rows.where("low < high").isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def deduplicated(docs: DataFrame, texts: bool = True, hot: int = HOT, stretch: int = STRETCH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` and the bytes ``kept`` of every row of ``docs(doc_id, text)``.

    With ``texts=False``, ``kept_sha256`` in place of ``kept``.
    """
    spark = docs.sparkSession
    light_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    count = rows.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = ranges_of(spark, count["bytes"])
    if count["rows"] == count["ids"]:
        rows = rows.withColumn("ord", F.col("doc_id"))
    else:
        key = rows.select("doc_id", F.xxhash64("text").alias("h"))
        places = ranked(key.distinct(), [F.col("doc_id").asc_nulls_last(), F.col("h")], "ord").select(F.col("doc_id").alias("i"), F.col("h").alias("g"), "ord")
        rows = rows.join(places, rows["doc_id"].eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("g"))).select("doc_id", "text", "ord")
    source = rows.select("ord", "text") if count["rows"] == count["ids"] else rows.select("ord", "text").dropDuplicates(["ord"])
    flags = stash(source.mapInArrow(_scan(ranges, stretch), "r long, body binary").groupBy("r").applyInArrow(_flagged(hot), FLAGS_SQL))
    release(spark)
    sent = _asked(source, flags.where("not whole"), ranges)
    often = not flags.where("not whole and hot").isEmpty()
    if often:
        sent = stash(sent)
        release(spark)
    runs = stash(sent.where("not hot").select(*SPANS.names).groupBy("r").applyInArrow(_compared, FLAGS_SQL))
    release(spark)
    if often:
        runs = runs.unionByName(_split(sent.where("hot").select(*SPANS.names), ranges, hot))
        release(spark)
    runs = flags.where("whole").unionByName(runs).groupBy("ord").agg(F.collect_list(F.struct("first", "last")).alias("runs")).withColumnRenamed("ord", "o")
    joined = rows.join(runs.hint("merge"), rows["ord"] == F.col("o"), "left").select("doc_id", "text", "runs")
    last = "kept binary" if texts else "kept_sha256 string"
    return joined.mapInArrow(_kept(texts), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")
