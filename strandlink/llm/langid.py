"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased; every letter and mark is a character of its own (those beyond
U+FFFF share 2,048), and every run of other characters is one space. Each language has a
model of 4-grams with one absolute discount an order, whose lower orders count in how
many contexts a gram occurs. Grams are counted over every document learnt from; none
is dropped.

Models are sorted arrays of hashes: 16 bits of the characters before, 8 of the last
(a-z apart), so that a language takes 2**24 entries an order at most, whatever is read.
Each language is a broadcast of its own; driver and workers hold a few languages at a time, so
that their memory doesn't grow with the number of languages. A
text goes to the language of least cross-entropy by character; the score is a softmax over
the languages, whose temperature is fitted on all documents learnt
from, as are the limits beyond which a text is ``rejected`` (like no language learnt).

Texts that are null or have no letter are ``und`` with score 0, and so are all
texts when there is nothing to learn from. Of languages with equal entropies the first by
name wins. Rows that repeat count and are answered each;
rows of null ``lang`` aren't learnt from; other columns aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .quality import held_out
from .spark_tools import kept, light_batches, pieces, record, stash

ORDER, WIDTH = 4, 16  #: characters of a gram, bits of each
LAST = 8  #: bits of the last character in a hash
CLASSES = 1 << LAST
GRID = [2.0**k for k in range(-2, 7)]  #: temperatures that are tried
HELD = 8  #: languages whose models a process holds at a time
CHUNK = 16  #: pieces of texts that are scored by some languages before the next are loaded

_tables: list[np.ndarray] = []


def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The character of every code point (0: none), the class of every character as the last of a gram, and which code points are letters."""
    if not _tables:
        points = np.arange(0x110000, dtype=np.uint64)
        letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        kept = letters | np.fromiter((category(chr(i))[0] == "M" for i in range(0x110000)), bool, 0x110000)
        # Surrogates are no characters, so their places are free.
        own = np.where(points < 0x10000, points, 0xD800 + kernel.mix(points) % np.uint64(2048))
        last = (27 + kernel.mix(points[:0x10000]) % np.uint64(CLASSES - 27)).astype(np.uint32)
        last[97:123] = np.arange(1, 27)
        last[0] = 0
        _tables.extend([np.where(kept, own, 0).astype(np.uint64), last, letters])
    return _tables[0], _tables[1], _tables[2]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each character of the texts, and the texts' n + 1 offsets. A text without a letter has none, whatever its marks."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = characters()[0][points]
    kept = kinds > 0
    kept[1:] |= kinds[:-1] > 0
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered], dtype=np.int64)])
    before = np.concatenate([[0], np.cumsum(characters()[2][points])])
    kept &= np.repeat(np.diff(before[bounds]) > 0, np.diff(bounds))
    at = np.concatenate([[0], np.cumsum(kept)])[bounds]
    seq = kinds[kept]
    gram = seq.copy()
    for k in range(1, ORDER):
        gram[k:] |= seq[:-k] << np.uint64(WIDTH * k)
    # What stands before a text is not its context.
    for k in range(ORDER - 2):
        first = at[:-1] + k
        first = first[first < at[1:]]
        gram[first] &= np.uint64((1 << (WIDTH * (k + 2))) - 1)
    return gram, at


def shorter(gram: np.ndarray, order: int) -> np.ndarray:
    """The last characters of each gram."""
    return gram if order == ORDER else gram & np.uint64((1 << (WIDTH * order)) - 1)


def hashes(gram: np.ndarray, order: int) -> np.ndarray:
    """24 bits of each gram's last characters: of those before the last, and of the last."""
    last = characters()[1][(gram & np.uint64((1 << WIDTH) - 1)).astype(np.int64)]
    if order == 1:
        return last
    before = kernel.mix((shorter(gram, order) >> np.uint64(WIDTH)) + np.uint64(order)) >> np.uint64(48)
    return (before.astype(np.uint32) << np.uint32(LAST)) | last


COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _count(batches):
    names: dict[str, int] = {}
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        u, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return u, np.bincount(inverse, np.concatenate([n for _, n in parts]), minlength=len(u)).astype(np.int64)

    for piece in pieces(batches):
        gram, at = grams(piece.column("text").to_pylist())
        lang = np.array([names.setdefault(x, len(names)) for x in piece.column("lang").to_pylist()], np.int64)
        owner = np.repeat(lang, np.diff(at))
        for i in np.unique(owner).tolist():
            u, n = np.unique(gram[owner == i], return_counts=True)
            waiting.setdefault(i, []).append((u, n))
            if len(waiting[i]) == 16:
                waiting[i] = [merged(waiting[i])]
    for name, i in names.items():
        keys, counts = merged(waiting.get(i, []))
        for a in range(0, len(keys), 50_000):
            k = keys[a : a + 50_000]
            yield record(COUNTS, [name] * len(k), k.view(np.int64), counts[a : a + 50_000])


CODED = pa.schema([("lang", pa.string()), ("three", pa.int64()), ("two", pa.int64()), *((f"c{k}", pa.int32()) for k in range(1, ORDER + 1)), ("n", pa.int64())])
CODED_SQL = "lang string, three long, two long, c1 int, c2 int, c3 int, c4 int, n long"


def _coded(batches):
    """Grams with their shorter ones and all their hashes."""
    for batch in batches:
        gram = batch.column("gram").to_numpy().view(np.uint64)
        codes = [hashes(gram, k).view(np.int32) for k in range(1, ORDER + 1)]
        yield record(CODED, batch.column("lang"), shorter(gram, 3).view(np.int64), shorter(gram, 2).view(np.int64), *codes, batch.column("n"))


class KneserNey:
    """One language's probabilities, by order from 1: sorted hashes of grams and contexts, and their parts."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.parts = []
        for code, n in tables:
            by = np.argsort(code)
            code, n = code[by], n[by]
            one, two = (n == 1).sum(), (n == 2).sum()
            discount = one / (one + 2 * two) if one and two else 0.75
            context, inverse = np.unique(code >> LAST, return_inverse=True)
            total = np.bincount(inverse, n)
            kinds = np.bincount(inverse)
            own = np.maximum(n - discount, 0) / total[inverse]
            self.parts.append((code.astype(np.uint32), own, context.astype(np.uint32), discount * kinds / total))

    @staticmethod
    def _find(known, values, keys, missing):
        if not len(known):
            return np.full(len(keys), missing)
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[place] == keys, values[place], missing)

    def log2(self, codes: list[np.ndarray]) -> np.ndarray:
        """log2 of the probability of grams' last characters after the others; their hashes by order from 1."""
        p = np.full(len(codes[0]), 1 / CLASSES)
        for code, (known, own, contexts, rest) in zip(codes, self.parts, strict=True):
            p = self._find(known, own, code, 0.0) + self._find(contexts, rest, code >> np.uint32(LAST), 1.0) * p
        return np.log2(p)


class Models(Mapping):
    """Models by language, each a broadcast of its own."""

    def __init__(self, parts: dict[str, Broadcast]):
        self.parts = parts
        self.owner = f"langid-{uuid.uuid4().hex}"

    def __getitem__(self, lang: str) -> KneserNey:
        part = self.parts[lang]
        value = part.value
        # A broadcast read from a file would keep its value, and be read again without it.
        if "_path" in vars(part):
            vars(part).pop("_value", None)
        return value

    def __iter__(self) -> Iterator[str]:
        return iter(self.parts)

    def __len__(self) -> int:
        return len(self.parts)

    def only(self, langs: list[str]) -> list[KneserNey]:
        """The models of ``langs``; this process lets go of all others."""
        held = kept(self.owner, dict)
        for lang in [x for x in held if x not in langs]:
            del held[lang]
        for lang in langs:
            if lang not in held:
                held[lang] = self[lang]
        return [held[x] for x in langs]


class Identifier:
    def __init__(self, models: Models):
        self.langs = sorted(models)
        self.models = models
        self.temperature = 1.0
        self.limits = dict.fromkeys(self.langs, float("inf"))

    def entropies(self, pieces: list[list[str | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each list of texts: bits by character of each text (rows) in each language, and the texts' numbers of grams.

        ``HELD`` languages at a time score all lists.
        """
        out = [np.zeros((len(texts), len(self.langs))) for texts in pieces]
        n = [np.zeros(len(texts), np.int64) for texts in pieces]
        for a in range(0, len(self.langs), HELD):
            models = self.models.only(self.langs[a : a + HELD])
            for i, texts in enumerate(pieces):
                gram, at = grams(texts)
                n[i] = np.diff(at)
                some = np.flatnonzero(n[i])
                if len(some):
                    distinct, place = np.unique(gram, return_inverse=True)
                    codes = [hashes(distinct, k) for k in range(1, ORDER + 1)]
                    for k, model in enumerate(models, a):
                        out[i][some, k] = -np.add.reduceat(model.log2(codes)[place], at[:-1][some]) / n[i][some]
        return zip(out, n)

    def scored(self, batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Pieces of record batches with what ``entropies`` says of their ``text``."""
        some = []
        for piece in pieces(batches, owner=self.models.owner):
            some.append(piece)
            if len(some) == CHUNK:
                yield from self._scored(some)
                some = []
        yield from self._scored(some)

    def _scored(self, some):
        for piece, (bits, n) in zip(some, self.entropies([p.column("text").to_pylist() for p in some]), strict=True):
            yield piece, bits, n


def fit(docs: DataFrame) -> Identifier:
    """Models of ``docs(doc_id, text, lang)``, learnt from rows that aren't held out."""
    light_batches(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    counts = known.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    coded = stash(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).mapInArrow(_coded, CODED_SQL))
    # How often a whole gram occurs; of a shorter one, how many different grams end in it.
    tables = [
        coded.select("lang", "two", "c1").distinct().groupBy("lang", F.col("c1").alias("code")).agg(F.count("*").alias("n")),
        coded.select("lang", "three", "c2").distinct().groupBy("lang", F.col("c2").alias("code")).agg(F.count("*").alias("n")),
        coded.groupBy("lang", F.col("c3").alias("code")).agg(F.count("*").alias("n")),
        coded.groupBy("lang", F.col("c4").alias("code")).agg(F.sum("n").alias("n")),
    ]
    tables = [stash(t.sortWithinPartitions("lang")) for t in tables]  # so that a language's scans skip the others' row groups
    parts = {}
    for (lang,) in tables[0].select("lang").distinct().orderBy("lang").collect():
        # The hashes of one language at a time, 2**24 an order at most.
        own = [t.where(F.col("lang") == lang).select("code", "n").toArrow() for t in tables]
        model = KneserNey([(t.column("code").to_numpy().astype(np.int64), t.column("n").to_numpy()) for t in own])
        parts[lang] = docs.sparkSession.sparkContext.broadcast(model)
    found = Identifier(Models(parts))
    if parts:
        _calibrate(found, known)
    return found


SUMS = pa.schema([("lang", pa.int32()), ("n", pa.int64()), ("bits", pa.float64()), ("squares", pa.float64()), *((f"loss{k}", pa.float64()) for k in range(len(GRID)))])


def _calibrate(found: Identifier, known: DataFrame) -> None:
    """Temperature and limits from sums over all documents learnt from: a row a language and task."""
    number = {lang: k for k, lang in enumerate(found.langs)}

    def of(batches):
        sums = np.zeros((len(number), 3 + len(GRID)))
        for piece, bits, n in found.scored(batches):
            some = np.flatnonzero(n)
            right = np.array([number[x] for x in piece.column("lang").take(pa.array(some)).to_pylist()], np.int64)
            bits, every = bits[some], np.arange(len(some))
            own = bits[every, right]
            losses = [-np.log(np.maximum(softmax(bits, t)[every, right], 1e-12)) for t in GRID]
            for k, values in enumerate([np.ones(len(some)), own, own**2, *losses]):
                sums[:, k] += np.bincount(right, values, minlength=len(number))
        yield record(SUMS, np.arange(len(number), dtype=np.int32), sums[:, 0].astype(np.int64), *sums[:, 1:].T)

    names = [name for name in SUMS.names if name != "lang"]
    parts = known.select("lang", "text").mapInArrow(of, ", ".join(f"{x.name} {'int' if x.name == 'lang' else 'long' if x.name == 'n' else 'double'}" for x in SUMS))
    sums = parts.groupBy("lang").agg(*(F.sum(name).alias(name) for name in names)).orderBy("lang").collect()  # a row a language
    if not sum(r["n"] for r in sums):
        return
    found.temperature = GRID[int(np.argmin([sum(r[f"loss{k}"] for r in sums) for k in range(len(GRID))]))]
    for r in sums:
        if r["n"] > 1:
            mean = r["bits"] / r["n"]
            found.limits[found.langs[r["lang"]]] = float(mean + 4 * np.sqrt(max(r["squares"] / r["n"] - mean**2, 0.0)))


def softmax(bits: np.ndarray, temperature: float) -> np.ndarray:
    x = -temperature * (bits - bits.min(1, keepdims=True))
    e = np.exp(x)
    return e / e.sum(1, keepdims=True)


def identified(docs: DataFrame, model: Identifier) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row of ``docs(doc_id, text)``."""
    light_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def of(batches):
        limits = np.array([model.limits[x] for x in model.langs])
        for piece, bits, n in model.scored(batches):
            rows = piece.num_rows
            lang, score, rejected = ["und"] * rows, np.zeros(rows), np.zeros(rows, bool)
            if model.langs:
                best = bits.argmin(1)
                some = n > 0
                score = np.where(some, softmax(bits, model.temperature)[np.arange(rows), best], 0.0)
                lang = [model.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                rejected = some & (bits[np.arange(rows), best] > limits[best])
            yield record(out, piece.column("doc_id"), piece.column("held_out"), lang, score, rejected)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(of, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
