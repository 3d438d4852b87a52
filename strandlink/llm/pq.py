"""Near-duplicate vectors by product quantisation.

Coarse lists and the residuals' codebooks are fitted on a bounded sample; every
vector is indexed, in the list of its nearest centroid, with a code of its
residual. As a query it looks into every list that may hold a partner: a list is
left out when its cell begins farther away than ``slack`` link distances; a half is enough
for every pair to be met from one side at least. In a list, tables
of the query's distances to the code words give each member's approximate distance
(asymmetric: the query isn't coded); members that are near enough, given the
error of their own code, are compared exactly.

Vectors that are equal after scaling are one member with a count. Lists are dealt
into blocks of members and of queries, so that no task holds a whole list; each
block of queries meets each block of members.

Only vectors with equal, non-null labels are compared. Null vectors, vectors with
null or non-finite components and zero vectors link with nothing. Vectors of each
length have their own sample, codebook and lists. Rows that repeat a ``vec_id`` are vectors
of their own, each counted; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import components, light_batches, partitions, record, stash

SAMPLE, SUBSPACES, WORDS = 20_000, 8, 64
LIST, MOST_LISTS = 2048, 1024  #: members of a list that are aimed at, and lists of a codebook at most
BLOCK = 4096  #: members of a list that one task compares queries with at a time
AT_ONCE = 1 << 20  #: table sums that are held at a time


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of ``x``, by Lloyd's rounds from a seeded choice of rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (centres @ x.T - (centres**2).sum(1)[:, None] / 2).argmax(0)
        count = np.bincount(near, minlength=len(centres))
        for c in np.flatnonzero(count):
            centres[c] = x[near == c].mean(0)
    return centres


class Codebook:
    """Coarse centroids, and the code words of the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, rows: int = 0, first: int = 0):
        self.dim = sample.shape[1]
        self.first = first  # number of its first list
        # The lists grow in number as the rows do, as far as the sample can place them.
        self.coarse = kmeans(sample, max(1, min(MOST_LISTS, len(sample), max(int(len(sample) ** 0.5), rows // LIST))))
        rest = sample - self.coarse[self.lists(sample)]
        edges = np.linspace(0, self.dim, SUBSPACES + 1).astype(int)
        self.parts = [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b > a]
        self.words = [kmeans(rest[:, a:b], WORDS) for a, b in self.parts]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of each row to each coarse centroid."""
        d = (x**2).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse**2).sum(1)
        return np.sqrt(np.maximum(d, 0))

    def lists(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x).argmin(1)

    def codes(self, rest: np.ndarray) -> np.ndarray:
        return np.stack([(w @ rest[:, a:b].T - (w**2).sum(1)[:, None] / 2).argmax(0) for (a, b), w in zip(self.parts, self.words, strict=True)], 1).astype(np.uint8)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([w[codes[:, k]] for k, w in enumerate(self.words)], 1)

    def tables(self, rest: np.ndarray) -> list[np.ndarray]:
        """Squared distances of queries' residuals (rows) to the code words of each subspace."""
        out = []
        for (a, b), w in zip(self.parts, self.words, strict=True):
            x = rest[:, a:b]
            out.append(np.maximum((x**2).sum(1)[:, None] - 2 * x @ w.T + (w**2).sum(1), 0))
        return out


UNITS = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("key", pa.binary()), ("unit", pa.binary())])


def _units(batches):
    """Vectors scaled to length one, with a key that equal ones share; null where a vector links with nothing."""
    for batch in batches:
        ids, labels, vectors = batch.column("vec_id"), batch.column("label"), batch.column("v")
        n = batch.num_rows
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        label = pc.fill_null(labels, 0).to_numpy(zero_copy_only=False).astype("<i8")
        known = ~labels.is_null().to_numpy(zero_copy_only=False)
        keys: list[bytes | None] = [None] * n
        units: list[bytes | None] = [None] * n
        for size in np.unique(sizes[known & (sizes > 0)]).tolist():
            some = np.flatnonzero(known & (sizes == size))
            # Null components are NaN here, and so link with nothing.
            x = vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            good = np.isfinite(x).all(1) & x.any(1)
            some, x = some[good], x[good]
            x = x / np.abs(x).max(1, keepdims=True)
            x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] + 0.0
            for i, raw in zip(some.tolist(), x.astype("<f8"), strict=True):
                units[i] = raw.tobytes()
                keys[i] = blake2b(units[i] + label[i].tobytes(), digest_size=16).digest()
        yield record(UNITS, ids, labels, pa.array(keys, pa.binary()), pa.array(units, pa.binary()))


INDEXED = pa.schema([("label", pa.int64()), ("list", pa.int32()), ("probe", pa.bool_()), ("key", pa.binary()), ("unit", pa.binary()), ("codes", pa.binary()), ("error", pa.float64()), ("copies", pa.int64()), ("lists", pa.binary())])


def _indexed(held, reach: float):
    """Each vector as a member of its list, and as a query of every list that can hold a partner.

    ``lists``: of a member those that it asks as a query, of a query its own. So whether a
    pair meets from both sides is looked up, not worked out again.
    """

    def of(batches):
        books = held.value
        gaps = {size: book.distances(book.coarse) for size, book in books.items()}
        for batch in batches:
            keys, labels, copies = (batch.column(c).to_pylist() for c in ("key", "label", "copies"))
            raw = batch.column("unit").to_pylist()
            sizes = np.array([len(u) for u in raw])
            for size in np.unique(sizes).tolist():
                book, right = books[size], np.flatnonzero(sizes == size).tolist()
                unit = np.stack([np.frombuffer(raw[i], "<f8") for i in right])
                far = book.distances(unit)
                own = far.argmin(1)
                rest = unit - book.coarse[own]
                codes = book.codes(rest)
                error = np.sqrt(((rest - book.decoded(codes)) ** 2).sum(1))
                # How far the border between the own cell and another is away.
                border = (far**2 - (far.min(1) ** 2)[:, None]) / np.maximum(2 * gaps[size][own], 1e-12)
                asked = border <= reach + 1e-9
                places = [np.flatnonzero(x).astype("<i4") for x in asked]
                rows = [(labels[i], book.first + int(own[k]), False, keys[i], raw[i], codes[k].tobytes(), float(error[k]), copies[i], places[k].tobytes()) for k, i in enumerate(right)]
                mine = [x.tobytes() for x in own.astype("<i4")]
                rows += [(labels[i], book.first + c, True, keys[i], raw[i], None, None, copies[i], mine[k]) for k, i in enumerate(right) for c in places[k].tolist()]
                for a in range(0, len(rows), 5000):
                    yield record(INDEXED, *(pa.array(c, t) for c, t in zip(zip(*rows[a : a + 5000], strict=True), INDEXED.types, strict=True)))

    return of


FOUND = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("n", pa.int64())])


class Block:
    """Members of a list that are compared at a time."""

    def __init__(self, book: Codebook, place: int, rows: list):
        self.keys = [r[0] for r in rows]
        self.units = np.stack([np.frombuffer(r[1], "<f8") for r in rows])
        self.codes = np.stack([np.frombuffer(r[2], np.uint8) for r in rows])
        self.error = np.array([r[3] for r in rows])
        self.counts = np.array([r[4] for r in rows], np.int64)
        self.names = {k: i for i, k in enumerate(self.keys)}
        asked = [np.frombuffer(r[5], "<i4") for r in rows]
        self.asked = np.repeat(np.arange(len(rows)), [len(x) for x in asked]) * len(book.coarse) + np.concatenate(asked)
        self.chain = np.arange(len(rows))
        self.book, self.place = book, place

    def near(self, units: np.ndarray, cosine: float):
        """For queries (rows) the members with at least that cosine, by tables first, then exactly: places of queries and members."""
        reach = np.sqrt(max(2 - 2 * cosine, 0)) + self.error + 1e-6
        step = max(1, AT_ONCE // len(self.keys))
        for a in range(0, len(units), step):
            some = units[a : a + step]
            tables = self.book.tables(some - self.book.coarse[self.place])
            about = tables[0][:, self.codes[:, 0]]
            for k in range(1, len(tables)):
                about = about + tables[k][:, self.codes[:, k]]
            q, m = np.nonzero(about <= reach**2)
            for c in range(0, len(q), 100_000):
                i, j = q[c : c + 100_000], m[c : c + 100_000]
                good = np.einsum("ij,ij->i", some[i], self.units[j]) >= cosine
                yield i[good] + a, j[good]

    def one_sided(self, own: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Of pairs of queries and members, those whose member doesn't ask the query's own list."""
        return np.flatnonzero(~np.isin(m * len(self.book.coarse) + own[q], self.asked))

    def links(self, key: bytes, found: np.ndarray) -> list[bytes]:
        """Members that ``key`` must be linked to so that it and ``found`` are connected."""
        chains = np.unique(self.chain[found])
        self.chain[np.isin(self.chain, chains)] = chains[0]
        own = self.names.get(key)
        return [self.keys[c] for c in chains.tolist() if c != own]


def _searched(held, cosine: float):
    """Rows come sorted by list and block, members first. Yields for each query the number of
    vectors that it links to, for each member that of the queries whose lists it doesn't probe itself,
    and enough links to connect them."""

    def of(batches):
        books = held.value
        name, members, block, waiting, rows = None, [], None, [], []

        def answer():
            units = np.stack([np.frombuffer(u, "<f8") for _, u, _, _ in waiting])
            own_lists = np.frombuffer(b"".join(x for _, _, _, x in waiting), "<i4").astype(np.int64)
            pairs = list(block.near(units, cosine))
            q, m = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
            alone = block.one_sided(own_lists, q, m)
            back = np.bincount(m[alone], np.array([n for _, _, n, _ in waiting])[q[alone]], minlength=len(block.keys))
            rows.extend((block.keys[k], None, int(back[k])) for k in np.flatnonzero(back).tolist())
            order = np.argsort(q, kind="stable")
            edges = np.searchsorted(q[order], np.arange(len(waiting) + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                key, found = waiting[k][0], m[order[edges[k] : edges[k + 1]]]
                own = block.names.get(key)
                others = found if own is None else found[found != own]
                if len(others):
                    rows.append((key, None, int(block.counts[others].sum())))
                    rows.extend((key, v, 0) for v in block.links(key, others if own is None else np.append(others, own)))
            waiting.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("label", "list", "block", "queries", "probe", "key", "unit", "codes", "error", "copies", "lists")]
            for label, place, part, queries, probe, key, unit, codes, error, copies, lists in zip(*columns, strict=True):
                if (label, place, part, queries) != name:
                    if waiting:
                        answer()
                    name, members, block = (label, place, part, queries), [], None
                if not probe:
                    members.append((key, unit, codes, error, copies, lists))
                    continue
                if not members:
                    continue
                if block is None:
                    book = books[len(unit)]
                    block = Block(book, place - book.first, members)
                waiting.append((key, unit, copies, lists))
                if len(waiting) == 1024:
                    answer()
                if len(rows) > 20_000:
                    yield record(FOUND, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FOUND.types, strict=True)))
                    rows.clear()
        if waiting:
            answer()
        if rows:
            yield record(FOUND, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FOUND.types, strict=True)))

    return of


def near_links(vectors: DataFrame, cosine: float = 0.98, slack: float = 0.5) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding, label)``.

    ``slack``: lists are probed whose cell begins within this share of the link
    distance. Of two linked vectors the distances to the border between their cells add up
    to the link distance at most, so with half of it one of them probes the other's list; a
    pair that only one of them meets counts for both. Below a half links may be missed.
    """
    spark = vectors.sparkSession
    light_batches(spark)
    tasks = partitions(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = stash(rows.mapInArrow(_units, "vec_id long, label long, key binary, unit binary"))
    members = rows.where("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    members = stash(members)
    named = members.select("key", "least", "copies")
    books: dict[int, Codebook] = {}
    first = 0
    for size, count in members.groupBy(F.length("unit").alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect():  # lengths are few
        alike = members.where(F.length("unit") == size)
        chosen = alike.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("unit").toArrow().column(0).to_pylist()  # a bounded sample
        books[size] = Codebook(np.stack([np.frombuffer(u, "<f8") for u in chosen]), count, first)
        first += len(books[size].coarse)
    if books:
        held = spark.sparkContext.broadcast(books)  # of a size that SAMPLE bounds, for each length
        reach = slack * float(np.sqrt(max(2 - 2 * cosine, 0)))
        index = stash(members.mapInArrow(_indexed(held, reach), "label long, list int, probe boolean, key binary, unit binary, codes binary, error double, copies long, lists binary"))
        sizes = index.groupBy("label", "list").agg(F.sum((~F.col("probe")).cast("long")).alias("held"), F.sum(F.col("probe").cast("long")).alias("asked"))
        sizes = stash(sizes.where("held > 0").select(F.col("label").alias("l"), F.col("list").alias("c"), F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asked") / (4 * BLOCK)).cast("int").alias("turns")))
        dealt = index.join(sizes, (F.col("label") == F.col("l")) & (F.col("list") == F.col("c")))
        mine = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        block = F.explode(F.when(F.col("probe"), every("blocks")).otherwise(F.array(mine("blocks"))))
        dealt = dealt.withColumn("block", block).withColumn("queries", F.explode(F.when(F.col("probe"), F.array(mine("turns"))).otherwise(every("turns"))))
        dealt = dealt.drop("l", "c", "blocks", "turns").repartition(tasks, "label", "list", "block", "queries").sortWithinPartitions("label", "list", "block", "queries", "probe", "key")
        found = stash(dealt.mapInArrow(_searched(held, cosine), "u binary, v binary, n long"))
        counts = found.groupBy(F.col("u").alias("k")).agg(F.sum("n").alias("n"))
        roots = components(found.where("v is not null").select("u", "v"))
        named = named.join(counts, F.col("key") == F.col("k"), "left").join(roots, F.col("key") == F.col("node"), "left").select("key", "copies", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "key").alias("root"))
    else:
        named = named.select("key", "copies", "least", F.lit(0).alias("n"), F.col("key").alias("root"))
    low = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(low, "root").select("key", (F.col("n") + F.col("copies") - 1).cast("long").alias("links"), "component")
    out = rows.select("vec_id", "key").join(named, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
