"""Byte-level BPE by DuckDB recursive queries.

Texts are split by the vocabulary's pattern. Every partition keeps the words it
has met; the new words of a batch go to DuckDB as one row to a byte. A word that is
a token is that token. For the others a recursive query joins neighbouring tokens
with the merges, contracts each word's leftmost pair of least rank, and repeats
until no pair of any word is a merge. The tokens' bytes, ordered by word and place
and joined, decode them.

The query takes a round for each contraction, so that a word's cost grows with the
square of its length. Words of ``LONG`` bytes or more (runs of letters or marks without
any break) are contracted in the same order with a heap.

Null texts count as empty and have no ids. Rows that repeat get equal results each,
columns beside ``doc_id`` and ``text`` aren't read, an empty table gives no rows.
Lone surrogates can't occur in UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import kept, light_batches, pieces, record

#: Words of each of the two generations that a worker remembers; words, and squares of their bytes, that one recursive query takes.
REMEMBERED, AT_ONCE, SQUARES = 150_000, 50_000, 50_000_000
LONG = 512  #: bytes from which a word isn't contracted by rounds

#: ``step`` holds each word's tokens in every round: rows to a token and place join the
#: merges, and a word goes on as long as one of its pairs is among them.
ENCODE = """
WITH RECURSIVE step AS (
  SELECT word, list(v.rank ORDER BY pos) AS ids, 0 AS round FROM bytes AS b JOIN single AS v ON v.byte = b.byte GROUP BY word
  UNION ALL
  SELECT s.word, s.ids[: (k.best & 4294967295) - 1] || [(k.best >> 32)::INTEGER] || s.ids[(k.best & 4294967295) + 2 :], s.round + 1
  FROM (
    SELECT p.word, min(m.rank * 4294967296 + p.pos) AS best
    FROM (SELECT word, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b, generate_subscripts(ids[:-2], 1) AS pos FROM step) AS p
    JOIN merges AS m ON m.a = p.a AND m.b = p.b
    GROUP BY p.word
  ) AS k JOIN step AS s ON s.word = k.word
)
SELECT word, arg_max(ids, round) AS ids FROM step GROUP BY word
"""

TEXTS = "SELECT word, len(ids) AS n, array_to_string(ids, ' ') AS ids FROM encoded ORDER BY word"
DECODE = """
SELECT v.token
FROM (SELECT word, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM encoded) AS i
JOIN vocabulary AS v ON v.rank = i.id
ORDER BY word, pos
"""

#: What the classes of a pattern are among the ASCII characters, outside and inside brackets.
ASCII = {r"\p{L}": ("[A-Za-z]", "A-Za-z"), r"\p{N}": ("[0-9]", "0-9"), r"\s": ("[\t-\r ]", "\t-\r "), r"\S": ("[^\t-\r ]", None)}


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of ``pattern`` in a text. Where it allows, ASCII texts have a form of it without Unicode's classes."""
    full = regex.compile(pattern).findall
    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part[0] == "\\" and part[1:2].isalpha():
            plain = ASCII.get(part, (None, None))[inside]
            if plain is None:
                return full
            out.append(plain)
            continue
        inside = part == "[" or (inside and part != "]")
        out.append(part)
    quick = re.compile("".join(out)).findall
    return lambda text: quick(text) if text.isascii() else full(text)


def contracted(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of one word, its leftmost pair of least rank always first. A heap holds the pairs."""
    ends = list(range(1, len(data) + 1))  # of the token at a place; 0 where none begins any more
    before = list(range(-1, len(data) - 1))
    heap = []

    def offer(at: int) -> None:
        if at >= 0 and ends[at] < len(data):
            end = ends[ends[at]]
            if (rank := ranks.get(data[at:end])) is not None:
                heapq.heappush(heap, (rank, at, end))

    for at in range(len(data)):
        offer(at)
    while heap:
        _, at, end = heapq.heappop(heap)
        middle = ends[at]
        if not middle or middle >= len(data) or ends[middle] != end:
            continue  # one of its tokens has gone
        ends[at], ends[middle] = end, 0
        if end < len(data):
            before[end] = at
        offer(at)
        offer(before[at])
    return [data[at:end] for at, end in enumerate(ends) if end]


class Encoder:
    """The words of one worker, encoded and decoded by DuckDB."""

    def __init__(self, path: str, pattern: str):
        self.split = splitter(pattern)
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        ranks = pa.table({"token": [base64.b64decode(t) for t, _ in pairs], "rank": pa.array([int(r) for _, r in pairs], pa.int64())})
        self.db.register("given", ranks)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.db.unregister("given")
        # Every way to cut a token of the vocabulary into two.
        self.ranks = {base64.b64decode(t): int(r) for t, r in pairs}
        ranks = self.ranks
        cuts = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, rank = (pa.array(c, pa.int32()) for c in zip(*cuts, strict=True))
        for name, table in (("merges", pa.table({"a": a, "b": b, "rank": rank.cast(pa.int64())})), ("single", pa.table({"byte": pa.array(range(256), pa.uint8()), "rank": pa.array([ranks[bytes([i])] for i in range(256)], pa.int32())}))):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def learn(self, words: list[str]) -> None:
        some, held = [], 0
        for w in words:
            data = w.encode()
            if (rank := self.ranks.get(data)) is not None:
                self.known[w] = (str(rank), 1, data)
            elif len(data) >= LONG:
                tokens = contracted(data, self.ranks)
                self.known[w] = (" ".join([str(self.ranks[t]) for t in tokens]), len(tokens), b"".join(tokens))
            else:
                if len(some) == AT_ONCE or held > SQUARES:
                    self._by_rounds(some)
                    some, held = [], 0
                some.append((w, data))
                held += len(data) ** 2
        if some:
            self._by_rounds(some)

    def _by_rounds(self, some: list[tuple[str, bytes]]) -> None:
        data = [b for _, b in some]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        word = np.repeat(np.arange(len(some), dtype=np.int32), sizes)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.db.register("bytes", pa.table({"word": word, "pos": pos.astype(np.int32), "byte": np.frombuffer(b"".join(data), np.uint8)}))
        self.db.register("encoded", self.db.sql(ENCODE).to_arrow_table())
        found = self.db.sql(TEXTS).to_arrow_table()
        tokens = self.db.sql(DECODE).to_arrow_table().column("token").combine_chunks()
        n = found.column("n").to_numpy()
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        back = pc.binary_join(pa.ListArray.from_arrays(ends, tokens), b"").to_pylist()
        self.known.update(zip([w for w, _ in some], zip(found.column("ids").to_pylist(), n.tolist(), back, strict=True), strict=True))

    def encode(self, texts: list[str]) -> list[tuple[str, int, bytes]]:
        """Ids joined by a space, their number, and the decoded bytes, of each text."""
        parts = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for w in set().union(*parts).difference(known):
            if w in older:
                known[w] = older[w]
            else:
                new.append(w)
        self.learn(new)
        out = []
        for words in parts:
            ids, n, back = zip(*map(known.__getitem__, words), strict=True) if words else ((), (), ())
            out.append((" ".join(ids), sum(n), b"".join(back)))
        return out


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this process; its words stay for the next task that encodes."""
    return kept(f"bpe {path} {pattern}", lambda: Encoder(path, pattern))


def encoded(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row; ``ids`` is the list of token ids, ``decoded`` binary.

    With ``ids=False`` both are left out and their SHA-256 sums given as hex:
    ``ids_sha256`` of the decimal ids joined by one space, ``decoded_sha256``.
    ``path`` is a rank file that every executor can read.
    """
    light_batches(docs.sparkSession)
    if ids:
        out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
    else:
        out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def of(batches):
        own = encoder(path, pattern)
        for piece in pieces(batches, most=2 << 20, owner=f"bpe {path} {pattern}"):
            got = own.encode(piece.column("text").to_pylist())
            n = pa.array([g[1] for g in got], pa.int64())
            if ids:
                lists = [list(map(int, g[0].split())) for g in got]
                yield record(out, piece.column("doc_id"), n, pa.array(lists, out.field(2).type), pa.array([g[2] for g in got], pa.binary()))
            else:
                yield record(out, piece.column("doc_id"), n, [hashlib.sha256(g[0].encode()).hexdigest() for g in got], [hashlib.sha256(g[2]).hexdigest() for g in got])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(of, "doc_id long, n_tokens long, ids array<int>, decoded binary" if ids else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
