"""Exact n-gram Jaccard self-join by prefix trees.

Documents are sets of word n-gram hashes in one global order (by hash). Equal
sets are one node. The join keeps every link and never lists the pairs of a
group:

1. *Bound.* A document of ``n`` shingles of which ``u`` occur nowhere else can
   overlap another in ``n - u`` at most; below ``threshold * n`` it links with
   nothing. Shingles travel as packed bytes, one record to a batch and range of
   hashes, each shingle once a batch.
2. *Rounds.* What is left is grouped by a min-hash, large groups dealt into
   blocks, and each block joined by counts of shared shingles or, if small, by
   a prefix tree; documents already connected are not compared again. This
   joins large groups of near copies cheaply.
3. *Completion.* A shingle that only one component holds counts as private now.
   Documents that can still link outside their component meet under every
   shingle of their prefix (prefix filter); those that shingles connect are a
   family and share a tree. In large families every shingle has its own, blocks
   of a large bucket against each other, so that no link is lost.

``docs`` should be a stored table (a scan reads it in the same order when a task
runs again). Nulls and texts without words have empty sets and link with nothing. Null or
repeated ``doc_id`` values keep their rows. Columns other than ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .spark_tools import components, free, light_batches, partitions, pieces, ranges_of, record, release, stash, trim

BLOCK = 2000  #: documents that are joined in one place at most
FEW = 16  #: documents of a block below which a prefix tree joins them
HELD = 4_000_000  #: shingles of a block beyond which a prefix tree does, set by set
PIVOTS = 8  #: sets of a block that are compared with all others first
COUNTED = 4096  #: shingles whose holders are counted together
SEGMENT = 32  #: shingles to a tree node; bounds are tested at each
MANY = 0xFFFF  #: in place of a document: several of the batch hold the shingle
LOW = np.uint64(0xFFFFFFFF)


class PrefixTree:
    """Sorted sets on paths from the root; finds links of a set with all sets held.

    Sets are given with a label; sets whose labels are connected (by ``join``)
    are not compared, and a subtree of connected sets is skipped as a whole.
    """

    __slots__ = ("root", "parent", "num", "den")

    def __init__(self, num: int = 80, den: int = 100):
        self.root = Node((), None)
        self.parent: dict = {}
        self.num, self.den = num, den

    def find(self, x):
        up = self.parent
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def add(self, tokens: list[int], label) -> list:
        """Joins ``label`` with all labels that it links to, and keeps the set. Returns the new links."""
        links, seen = [], []
        n, own = len(tokens), frozenset(tokens)
        num, den = self.num, self.den
        both = num + den
        stack = [(self.root, 0, 0)]
        while stack:
            node, shared, length = stack.pop()
            if node.hi * den < num * n or node.lo * num > den * n or (node.uniform and self.find(node.some) == self.find(label)):
                continue
            if node.tokens:
                shared += len(node.held & own)
                length += len(node.tokens)
                left = n - bisect_right(tokens, node.tokens[-1])
                if both * (shared + min(left, node.hi - length)) < num * (n + max(node.lo, length)):
                    continue
            seen.append(node)
            if node.ends and both * shared >= num * (n + length):
                for other in node.ends:
                    if self.join(label, other):
                        links.append((label, other))
            for child in node.children.values():
                stack.append((child, shared, length))
        for node in reversed(seen):
            node.settle(self)
        self._insert(tokens, label)
        return links

    def _insert(self, tokens: list[int], label) -> None:
        node, at, n = self.root, 0, len(tokens)
        while True:
            node.widen(n, label, self)
            if at == n:
                node.ends.append(label)
                return
            child = node.children.get(tokens[at])
            if child is None:
                child = Node(tuple(tokens[at : at + SEGMENT]), label)
                node.children[tokens[at]] = child
                node, at = child, at + len(child.tokens)
                continue
            same = 1
            for a, b in zip(child.tokens[1:], tokens[at + 1 : at + len(child.tokens)]):
                if a != b:
                    break
                same += 1
            if same < len(child.tokens):
                node.children[tokens[at]] = child.split(same)
                child = node.children[tokens[at]]
            node, at = child, at + same


class Node:
    __slots__ = ("tokens", "held", "children", "ends", "lo", "hi", "some", "uniform")

    def __init__(self, tokens: tuple, some):
        self.tokens, self.held, self.children, self.ends = tokens, frozenset(tokens), {}, []
        self.lo, self.hi, self.some, self.uniform = 1 << 62, 0, some, True

    def widen(self, n: int, label, tree: PrefixTree) -> None:
        self.lo, self.hi = min(self.lo, n), max(self.hi, n)
        if self.some is None:
            self.some = label
        self.uniform = self.uniform and tree.find(self.some) == tree.find(label)

    def settle(self, tree: PrefixTree) -> None:
        if not self.uniform and self.some is not None:
            root = tree.find(self.some)
            self.uniform = all(tree.find(x) == root for x in self.ends) and all(c.uniform and tree.find(c.some) == root for c in self.children.values())

    def split(self, at: int) -> Node:
        top = Node(self.tokens[:at], self.some)
        top.lo, top.hi, top.uniform = self.lo, self.hi, self.uniform
        self.tokens = self.tokens[at:]
        self.held = frozenset(self.tokens)
        top.children[self.tokens[0]] = self
        return top


def block_links(sets: list[np.ndarray], labels: list, num: int = 80, den: int = 100) -> list[tuple]:
    """Links that connect the labels of ``sets`` that ``PrefixTree`` connects, by counts of shared shingles.

    A few sets are compared with all others first, which finds what surrounds them. Two sets that then belong to different
    components aren't both in the largest, so the sets outside it are counted against all others, by the lists of sets
    that hold each shingle.
    """
    tree, links = PrefixTree(num, den), []
    sizes = np.array([len(s) for s in sets])
    tokens, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])
    names = {x: k for k, x in enumerate(dict.fromkeys(labels))}
    label = np.array([names[x] for x in labels])
    known = list(names)

    def roots() -> np.ndarray:
        return np.array([names[tree.find(x)] for x in known])[label]

    def join(i: int, shared: np.ndarray) -> None:
        near = np.flatnonzero((num + den) * shared >= num * (sizes[i] + sizes))
        for k in np.unique(label[near]).tolist():
            if tree.join(labels[i], known[k]):
                links.append((labels[i], known[k]))

    seen = np.zeros(len(sets), bool)
    for _ in range(PIVOTS):
        root = roots()
        left = np.flatnonzero(~seen)
        if not len(left):
            break
        i = int(left[len(left) // 2])
        own = sets[i]
        same = own[np.minimum(np.searchsorted(own, tokens), len(own) - 1)] == tokens
        join(i, np.add.reduceat(same, at[:-1], dtype=np.int64))
        root = roots()
        seen |= root == root[i]
    root = roots()
    outside = np.flatnonzero(root != np.bincount(root).argmax())
    if not len(outside):
        return links
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(tokens[order]) != 0))
    held = np.diff(np.append(first, len(tokens)))
    number = np.empty(len(tokens), np.int64)
    number[order] = np.repeat(np.arange(len(first)), held)
    holders = owner[order]
    for i in outside.tolist():
        own = number[at[i] : at[i + 1]]
        own = own[held[own] > 1]
        count = held[own]
        shared = np.zeros(len(sets), np.int64)
        # A bounded number of places at a time.
        for k in range(0, len(own), COUNTED):
            some, n = own[k : k + COUNTED], count[k : k + COUNTED]
            places = np.repeat(first[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared += np.bincount(holders[places], minlength=len(sets))
        join(i, shared)
    return links


PARTS = pa.schema([("r", pa.int64()), ("batch", pa.int64()), ("body", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary())])
PARTS_SQL = "r long, batch long, body binary, keys binary, sizes binary"


def _pack(ranges: int, batch: int, docs: list, every: int):
    """Records of a batch: its shingles by range of hashes, and one with its keys and sizes.

    ``docs``: (key, owner, sorted hashes). Only hashes divisible by ``every`` travel
    (an even choice of shingles, the same for each document; the bound stays valid).
    """
    sizes = np.array([len(s) for _, _, s in docs], np.int64)
    tokens = np.concatenate([s for _, _, s in docs] or [np.zeros(0, np.uint64)])
    doc = np.repeat(np.arange(len(docs)), sizes)
    owner = np.array([o for _, o, _ in docs], np.uint64)
    if every > 1:
        chosen = tokens % np.uint64(every) == 0
        tokens, doc = tokens[chosen], doc[chosen]
    order = np.argsort(tokens, kind="stable")
    tokens, doc = tokens[order], doc[order]
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
    own = owner[doc]
    mixed = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first) if len(first) else np.zeros(0, bool)
    mixed = np.repeat(mixed, np.diff(np.append(first, len(tokens))))
    lead = np.zeros(len(tokens), bool)
    lead[first] = True
    kept = lead | ~mixed
    doc = np.where(mixed, MANY, doc)[kept].astype("<u2")
    tokens, own = tokens[kept], own[kept]
    shift = np.uint64(64 - (ranges.bit_length() - 1))
    cuts = np.searchsorted(tokens, np.arange(1, ranges, dtype=np.uint64) << shift)
    low = ((tokens >> np.uint64(1)) & LOW).astype("<u4")
    edges = np.concatenate([[0], cuts, [len(tokens)]])
    r, body = [], []
    for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if a < b:
            r.append(i)
            body.append(low[a:b].tobytes() + doc[a:b].tobytes() + own[a:b].astype("<u8").tobytes() * (every == 1))
    r.append(ranges + batch % ranges)
    n = len(r)
    keys, held = [None] * (n - 1) + [b"".join(k for k, _, _ in docs)], [None] * (n - 1) + [sizes.astype("<i4").tobytes()]
    return record(PARTS, pa.array(r, pa.int64()), pa.array([batch] * n, pa.int64()), pa.array([*body, None], pa.binary()), pa.array(keys, pa.binary()), pa.array(held, pa.binary()))


def _private(ranges: int, owned: bool):
    """For one range: which documents' shingles have a single owner, one record to a batch."""

    def of(table: pa.Table) -> pa.Table:
        r = table.column("r")[0].as_py()
        if r >= ranges:
            return table
        batches, tokens, docs, owners = [], [], [], []
        for batch, body in zip(table.column("batch").to_pylist(), table.column("body").to_pylist(), strict=True):
            n = len(body) // (14 if owned else 6)
            tokens.append(np.frombuffer(body, "<u4", n))
            docs.append(np.frombuffer(body, "<u2", n, 4 * n))
            batches.append(np.full(n, batch, np.int64))
            owners.append(np.frombuffer(body, "<u8", n, 6 * n) if owned else (np.uint64(batch) << np.uint64(16)) + docs[-1])
        token, doc, batch, owner = map(np.concatenate, (tokens, docs, batches, owners))
        order = np.argsort(token, kind="stable")
        token, doc, batch, owner = token[order], doc[order], batch[order], owner[order]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        mixed = (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)) | (np.maximum.reduceat(doc, first) == MANY)
        private = ~np.repeat(mixed, np.diff(np.append(first, len(token))))
        doc, batch = doc[private], batch[private]
        if not len(doc):
            return PARTS.empty_table()
        order = np.argsort(batch, kind="stable")
        doc, batch = doc[order], batch[order]
        names, at = np.unique(batch, return_index=True)
        ends = np.append(at[1:], len(batch))
        body = [doc[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
        n = len(names)
        return pa.Table.from_batches([record(PARTS, pa.array(np.full(n, r)), pa.array(names), pa.array(body, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()))], schema=PARTS)

    return of


KEPT = pa.schema([("key", pa.binary())])


def _survivors(num: int, den: int):
    def of(table: pa.Table) -> pa.Table:
        keys, sizes, private = b"", np.zeros(0, np.int64), None
        bodies = []
        for body, k, s in zip(*(table.column(c).to_pylist() for c in ("body", "keys", "sizes")), strict=True):
            if k is None:
                bodies.append(np.frombuffer(body, "<u2"))
            else:
                keys, sizes = k, np.frombuffer(s, "<i4").astype(np.int64)
        private = np.bincount(np.concatenate(bodies), minlength=len(sizes)) if bodies else np.zeros(len(sizes), np.int64)
        left = np.flatnonzero((den * (sizes - private) >= num * sizes) & (sizes > 0)).tolist()
        return pa.table([pa.array([keys[16 * i : 16 * i + 16] for i in left], pa.binary())], schema=KEPT)

    return of


def _bounded(parts: DataFrame, ranges: int, owned: bool, num: int, den: int) -> DataFrame:
    """Keys that have enough shingles of several owners."""
    shared = parts.groupBy("r").applyInArrow(_private(ranges, owned), PARTS_SQL)
    return shared.groupBy("batch").applyInArrow(_survivors(num, den), "key binary").distinct()


def _scan(n: int, ranges: int):
    """Packs the shingles of texts, about two million to a batch."""

    def of(batches):
        task, count, docs, held = TaskContext.get().partitionId(), 0, [], 0
        for piece in pieces(batches):
            sets, places = kernel.shingle_sets(piece.column("text"), n)
            for i, key in enumerate(kernel.set_keys(sets, places)):
                if key is not None:
                    docs.append((key, len(docs), sets[places[i] : places[i + 1]]))
            held += len(sets)
            if held > 2_000_000 or len(docs) > 50_000:
                yield from _packed(ranges, (task << 24) + count, docs)
                docs, held, count = [], 0, count + len(docs) // 60_000 + 1
        if docs:
            yield from _packed(ranges, (task << 24) + count, docs)

    return of


def _packed(ranges: int, batch: int, docs: list):
    for k in range(0, len(docs), 60_000):
        yield _pack(ranges, batch + k // 60_000, [(key, i, s) for i, (key, _, s) in enumerate(docs[k : k + 60_000])], 2)


def _describe(n: int, marks: tuple[str, ...] = ()):
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), *((m, pa.int64()) for m in marks)])

    def of(batches):
        for piece in pieces(batches):
            sets, places = kernel.shingle_sets(piece.column("text"), n)
            yield record(out, piece.column("doc_id").cast(pa.int64()), np.diff(places), pa.array(kernel.set_keys(sets, places), pa.binary()), *(piece.column(m) for m in marks))

    return of


SETS = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("m1", pa.int64()), ("m2", pa.int64()), ("body", pa.binary())])
SETS_SQL = "key binary, n long, m1 long, m2 long, body binary"


def _sets(n: int):
    """The sets of texts that have the wanted key, with two min-hashes."""

    def of(batches):
        for piece in pieces(batches):
            sets, places = kernel.shingle_sets(piece.column("text"), n)
            rows = []
            for i, (key, wanted) in enumerate(zip(kernel.set_keys(sets, places), piece.column("wanted").to_pylist(), strict=True)):
                if key == wanted:
                    s = sets[places[i] : places[i + 1]]
                    rows.append((key, len(s), int(kernel.mix(s ^ np.uint64(1)).min().view(np.int64)), int(kernel.mix(s ^ np.uint64(2)).min().view(np.int64)), s.astype("<u8").tobytes()))
            if rows:
                yield record(SETS, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SETS.types, strict=True)))

    return of


EDGES = pa.schema([("u", pa.binary()), ("v", pa.binary())])


def _joined(num: int, den: int, group: tuple[str, ...]):
    """Joins of rows sorted by ``group``; labels are ``comp``. Yields links between labels.

    A group's sets are counted against each other; few ones, and what would take too much memory, go into a prefix tree.
    """

    def treed(tree: PrefixTree, rows: list) -> list:
        return [link for body, comp in rows for link in tree.add(np.frombuffer(body, "<u8").tolist(), comp)]

    def ended(rows: list) -> list:
        if len(rows) < 2:
            return []
        if len(rows) < FEW:
            return treed(PrefixTree(num, den), rows)
        return block_links([np.frombuffer(body, "<u8") for body, _ in rows], [comp for _, comp in rows], num, den)

    def of(batches):
        last, tree, links, rows, held = None, None, [], [], 0
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in group), strict=True))
            comps, bodies = batch.column("comp").to_pylist(), batch.column("body").to_pylist()
            for name, comp, body in zip(names, comps, bodies, strict=True):
                if name != last:
                    links += ended(rows)
                    last, tree, rows, held = name, None, [], 0
                rows.append((body, comp))
                held += len(body) // 8
                if tree is not None or held > HELD:
                    tree = tree or PrefixTree(num, den)
                    links += treed(tree, rows)
                    rows = []
            if len(links) > 10_000:
                yield record(EDGES, *(pa.array(c, pa.binary()) for c in zip(*links, strict=True)))
                links = []
        links += ended(rows)
        if links:
            yield record(EDGES, *(pa.array(c, pa.binary()) for c in zip(*links, strict=True)))
        tree = None
        trim()

    return of


def _owner_pack(ranges: int):
    def of(batches):
        task, count, docs, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for key, comp, body in zip(*(batch.column(c).to_pylist() for c in ("key", "comp", "body")), strict=True):
                docs.append((key, int.from_bytes(comp[:8], "big"), np.frombuffer(body, "<u8")))
                held += len(body) // 8
                if held > 2_000_000 or len(docs) > 50_000:
                    yield _pack(ranges, (task << 24) + count, docs, 1)
                    docs, held, count = [], 0, count + 1
        if docs:
            yield _pack(ranges, (task << 24) + count, docs, 1)

    return of


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``.

    Documents link when ``den * |intersection| >= num * |union|`` of their sets of
    ``n``-word shingles; ``component_id`` is the least ``doc_id`` reachable by links.
    """
    spark = docs.sparkSession
    light_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = stash(texts.mapInArrow(_describe(n), "doc_id long, n_shingles long, key binary"))
    roots = _rooted(texts, described, F.min("doc_id"), n, num, den)
    low = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(low, "root").select("key", "component_id")
    return described.join(named, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _rooted(texts: DataFrame, described: DataFrame, least: Column, n: int, num: int, den: int) -> DataFrame:
    """``key, root, least`` of every set key: the key that names its component, and the aggregate ``least`` of its rows."""
    links = _links(texts, described, n, num, den)
    rows = described.where("key is not null").groupBy("key").agg(least.alias("least"))
    return rows.join(components(links), rows["key"] == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("root"), "least")


def _candidates(texts: DataFrame, described: DataFrame, ranges: int, n: int, num: int, den: int) -> DataFrame:
    """The sets, one to a key, that the bound leaves."""
    held = _bounded(texts.mapInArrow(_scan(n, ranges), PARTS_SQL), ranges, False, num, den)
    reps = described.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("id"))
    ids = stash(held.join(reps, "key").select("id", F.col("key").alias("wanted"))).hint("shuffle_hash")
    release(texts.sparkSession)
    sets = texts.join(ids, texts["doc_id"].eqNullSafe(ids["id"])).select("wanted", "text").mapInArrow(_sets(n), SETS_SQL)
    row = described.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    return stash(sets if row["rows"] == row["ids"] else sets.dropDuplicates(["key"]))


def _round(sets: DataFrame, m: str, num: int, den: int) -> DataFrame:
    """Links of the sets that share the min-hash ``m``, within blocks of each group."""
    large = sets.groupBy(m).count().where(F.col("count") > BLOCK).select(F.col(m).alias("large"), F.ceil(F.col("count") / BLOCK).alias("blocks"))
    large = stash(large)
    block = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("key", F.lit(m)), F.col("blocks")))
    rows = sets.join(large, sets[m] == large["large"], "left").select("key", "n", m, "body", F.col("key").alias("comp"), block.alias("block"))
    rows = rows.repartition(partitions(sets.sparkSession), m, "block").sortWithinPartitions(m, "block", "n", "key")
    return stash(rows.mapInArrow(_joined(num, den, (m, "block")), "u binary, v binary"))


def _links(texts: DataFrame, described: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links between set keys that connect what the join connects."""
    spark = texts.sparkSession
    ranges = ranges_of(spark, described.agg(F.sum("n_shingles") * 8).first()[0])
    sets = _candidates(texts, described, ranges, n, num, den)
    release(spark)
    found = components(_round(sets, "m1", num, den).unionByName(_round(sets, "m2", num, den)))
    found = stash(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    release(spark)
    return found.unionByName(_completion(sets, found, ranges, num, den))


def _completion(sets: DataFrame, found: DataFrame, ranges: int, num: int, den: int) -> DataFrame:
    """The links between components of ``found`` that the rounds haven't met."""
    labelled = sets.join(found.hint("shuffle_hash"), sets["key"] == F.col("u"), "left").select("key", "n", "body", F.coalesce("v", "key").alias("comp"))
    # In a fixed order, so that a task that runs again packs the same batches.
    labelled = labelled.sortWithinPartitions("key")
    outer = _bounded(labelled.mapInArrow(_owner_pack(ranges), PARTS_SQL), ranges, True, num, den)
    outer = outer.join(found, outer["key"] == F.col("u"), "left").select(F.col("key").alias("k"), F.coalesce("v", "key").alias("comp"))
    outer = stash(outer)
    rest = sets.join(outer.hint("shuffle_hash"), sets["key"] == outer["k"]).select("key", "n", "body", "comp")
    exploded = stash(rest.mapInArrow(_tokens, "token long, key binary, comp binary, n long"))
    shared = exploded.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("df")).where("a <> b").select("token", "df")
    counts = exploded.join(shared, "token").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("tokens"), F.first("n").alias("n"), F.first("comp").alias("comp"))
    # The prefix takes private shingles first, then rare ones, so that common passages aren't in it.
    least = F.expr(f"(n * {num} + {den - 1}) div {den}")
    prefix = counts.where(F.size("tokens") >= least).select("key", "n", "comp", F.explode(F.slice("tokens.token", F.lit(1), (F.size("tokens") - least + 1).cast("int"))).alias("token"))
    prefix = stash(prefix)
    # Shingles that the same documents hold are one bucket.
    buckets = prefix.groupBy("token").agg(F.count("*").alias("size"), F.min("comp").alias("a"), F.max("comp").alias("b"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("who")).where("a <> b")
    buckets = buckets.groupBy("who", "size").agg(F.min("token").alias("token")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    placed = stash(prefix.join(buckets, "token").select("token", "blocks", F.col("key").alias("k"), "comp"))
    # Documents that buckets connect are a family, and a small family one tree; in a
    # large one every bucket is, blocks of a large bucket each against each other.
    heads = placed.groupBy("token").agg(F.min("k").alias("v"))
    families = components(placed.join(heads, "token").select(F.col("k").alias("u"), "v"))
    families = stash(families.unionByName(families.select(F.col("root").alias("node"), "root").distinct()))
    sizes = families.groupBy("root").agg(F.count("*").alias("members"))
    placed = placed.join(families.join(sizes, "root"), F.col("k") == F.col("node"))
    small = placed.where(F.col("members") <= BLOCK).select(F.col("root").alias("name"), "k", "comp", F.lit(0).alias("i"), F.lit(0).alias("j")).distinct()
    large = placed.where(F.col("members") > BLOCK).withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    large = large.select("token", "k", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    large = large.select(F.col("token").cast("string").cast("binary").alias("name"), "k", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    placed = stash(small.unionByName(large))
    release(sets.sparkSession)
    rows = sets.join(placed.hint("shuffle_hash"), sets["key"] == placed["k"]).select("name", "i", "j", "n", "key", "comp", "body")
    rows = rows.repartition(partitions(sets.sparkSession), "name", "i", "j").sortWithinPartitions("name", "i", "j", "n", "key")
    return stash(rows.mapInArrow(_joined(num, den, ("name", "i", "j")), "u binary, v binary"))


TOKENS = pa.schema([("token", pa.int64()), ("key", pa.binary()), ("comp", pa.binary()), ("n", pa.int64())])


def _tokens(batches):
    for batch in batches:
        for key, comp, n, body in zip(*(batch.column(c).to_pylist() for c in ("key", "comp", "n", "body")), strict=True):
            tokens = np.frombuffer(body, "<u8").view(np.int64)
            k = len(tokens)
            yield record(TOKENS, pa.array(tokens), pa.array([key] * k, pa.binary()), pa.array([comp] * k, pa.binary()), pa.array(np.full(k, n)))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component, and all rows without words.

    The row of least ``doc_id`` stays, nulls last; of several, the one of least
    hash over all columns but maps. So it is the same row however ``docs`` is dealt.
    Columns may have any names.
    """
    light_batches(docs.sparkSession)
    own = free(docs.columns)
    marks = (own("a"), own("b"))
    plain = [F.col(c) for c, t in docs.dtypes if "map<" not in t]
    seen = [*plain, *(c.isNull() for c in plain)]  # nulls don't change a hash
    rows = docs.withColumns({m: F.xxhash64(F.lit(k), *seen) for k, m in enumerate(marks)})
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *marks)
    described = stash(marked.mapInArrow(_describe(n, marks), f"doc_id long, n_shingles long, key binary, {marks[0]} long, {marks[1]} long"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *marks))
    roots = _rooted(texts, described, first, n, num, den)
    chosen = roots.groupBy("root").agg(F.min("least").alias("least")).select(*(F.col(f"least.{m}").alias(m) for m in marks))
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # Rows that are equal in all columns have equal marks, and one of them stays.
    kept = rows.where(worded).join(chosen, [*marks], "left_semi").dropDuplicates([*marks]).drop(*marks)
    return kept.unionByName(docs.where(~worded))
