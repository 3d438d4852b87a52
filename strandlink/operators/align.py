"""Alignment of pair tables by Arrow functions over the batch kernel.

Scores are scalar functions, so filters and column pruning go below them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import code_base
from ..storage import stored
from . import jvm, kernels
from .kernels import Weights
from .model import Model

#: What every alignment tells of itself; ``first_mir`` is null in an empty one.
NUMBERS = {"score": pa.float64(), **dict.fromkeys(("columns", "first_mir", "matches", "mismatches", "gaps", "gap_mir", "gap_gene"), pa.int32())}
#: What it tells if asked: both rows, places of their bases, and what it does at each position (see ``kernels.Traces``).
DETAILS = {"mir_aln": pa.string(), "gene_aln": pa.string(), **dict.fromkeys(("mir_idx", "gene_idx", "state", "gap_after", "kind"), pa.list_(pa.int32()))}
ALL = tuple(name for name in DETAILS if name != "kind")
_SQL = {pa.float64(): "double", pa.int32(): "int", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}


def score_column(first: Column, second: Column, weights: Weights, local: bool = True) -> Column:
    """The alignment score of two sequence columns."""

    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(kernels.scores(a, b, weights, local))

    return score(first, second)


def score_expression(first: Column, second: Column, weights: Weights, local: bool = True) -> Column:
    """The alignment score as one expression, without Python: a fold over the antidiagonals, whose cells follow from the two before.

    Equal to ``score_column`` to the last bit. A cell is one step of an interpreted expression, so it is for places where
    Python isn't to be had.
    """
    value = lambda x: F.lit(float(x))
    zero, length = F.lit(0.0), weights.length
    codes = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.instr(F.lit(kernels.BASES), x) - 1)
    table = F.array(*map(value, weights.match.transpose(2, 0, 1).ravel()))  # by position, then both bases
    ups = F.array(*map(value, weights.gap_second))
    lefts = F.array(*map(value, [*weights.gap_first, 0.0]))
    last_left = value(kernels.LAST_ROW_GAP if local else -np.inf)
    a, b = codes(first), codes(second)
    rows = F.transform(a, lambda x, i: i * 16 + x * 4)  # where the table has each position's base
    own_lefts = F.concat(F.slice(lefts, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(last_left))

    def whole(given: Column) -> Column:
        rows, b, table, ups, lefts, n, m = (given[x] for x in ("rows", "b", "table", "ups", "lefts", "n", "m"))

        def diagonal(acc: Column, k: Column) -> Column:
            one, two, d, low = acc["one"], acc["two"], k + 1, acc["low"]
            # Cells run from ``low`` on, those of the diagonals before from ``low1`` and ``low2``.
            low1, low2 = F.greatest(k - m, F.lit(0)), F.greatest(k - 1 - m, F.lit(0))

            def cell(i: Column) -> Column:
                r = i - 1
                up = F.get(one, r - low1) + F.get(ups, r)
                score = F.greatest(F.get(two, r - low2) + F.get(table, F.get(rows, r) + F.get(b, k - i)), up, F.get(one, i - low1) + F.get(lefts, r), *([zero] if local else []))
                return F.when(i == 0, zero).when(i == d, zero if local else up).otherwise(score)

            def after(cells: Column) -> Column:
                rounded = cells.cast("array<float>").cast("array<double>")
                reached = F.array_max(cells) if local else F.when(d >= n, F.get(rounded, n - low))
                return F.struct(rounded.alias("one"), one.alias("two"), F.greatest(d + 1 - m, F.lit(0)).alias("low"), F.greatest(acc["best"], reached).alias("best"))

            return _let(F.transform(F.sequence(low, F.least(n, d)), cell), after)

        begin = F.struct(F.array(zero).alias("one"), F.array(zero).alias("two"), F.greatest(1 - m, F.lit(0)).alias("low"), (zero if local else F.when(n == 0, zero)).alias("best"))
        # Long first sequences have no weights.
        checked = F.when(n > length, F.raise_error(F.lit(f"a first sequence is longer than the weights, which have {length} positions")).cast("double"))
        return checked.otherwise(F.aggregate(_counting(n + m), begin, diagonal, lambda acc: acc["best"]))

    return _let(F.struct(rows.alias("rows"), b.alias("b"), table.alias("table"), ups.alias("ups"), own_lefts.alias("lefts"), F.size(a).alias("n"), F.size(b).alias("m")), whole)


def _counting(n: Column) -> Column:
    """0 to n - 1."""
    return F.filter(F.sequence(F.lit(0), n), lambda k: k < n)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def path_column(first: Column, second: Column, weights: Weights, local: bool = True, fields: tuple[str, ...] = ALL) -> Column:
    """The alignment of two sequence columns: its ``NUMBERS``, and those of its ``DETAILS`` that ``fields`` names."""
    types = NUMBERS | {name: DETAILS[name] for name in fields}

    @F.arrow_udf(f"struct<{', '.join(f'{name}: {_SQL[t]}' for name, t in types.items())}>")
    def path(a: pa.Array, b: pa.Array) -> pa.Array:
        # Pairs come back by shape and are put into the order of the batch.
        order, parts = [np.zeros(0, np.int64)], [pa.array([], pa.struct(types.items()))]
        for places, t in kernels.traces(a, b, weights, local):
            order.append(places)
            parts.append(_structs(t, types))
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order))))

    return path(first, second)


FOOT = "struct<score: double, slots: binary>"


def footprint_column(first: Column, second: Column, weights: Weights, local: bool = True) -> Column:
    """The score of the alignment of two sequence columns, and the slots of the weights that it uses, two bytes each.

    That is all a gradient needs of an alignment, in about 50 bytes; see ``kernels.slots``.
    """
    size = kernels.slot_type(weights.length).itemsize

    @F.arrow_udf(FOOT)
    def foot(a: pa.Array, b: pa.Array) -> pa.Array:
        order, scores, parts = [np.zeros(0, np.int64)], [np.zeros(0)], [pa.array([], pa.binary())]
        for places, score, slots, offsets in kernels.footprint_slots(a, b, weights, local):
            order.append(places)
            scores.append(score)
            parts.append(pa.BinaryArray.from_buffers(pa.binary(), len(score), [None, pa.array(offsets * size, pa.int32()).buffers()[1], pa.py_buffer(slots.tobytes())]))
        back = pa.array(np.argsort(np.concatenate(order)))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores)).take(back), pa.concat_arrays(parts).take(back)], names=["score", "slots"])

    return foot(first, second)


def footprinted(pairs: DataFrame, model: Model) -> DataFrame:
    """``pairs`` with ``score`` and the ``slots`` of its alignment, aligned by the JVM where it can."""
    given = (F.col("noncodingRNA"), F.col("target_rc"), model.weights, model.local)
    foot = jvm.footprint(pairs.sparkSession, *given)
    if foot is None:
        foot = footprint_column(*given)
    return pairs.withColumn("foot", foot).select(*pairs.columns, F.col("foot.score").alias("score"), F.col("foot.slots").alias("slots"))


def slots_of(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The slots of a batch's alignments, one after the other, and which alignment each belongs to."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).astype(np.int64), np.repeat(np.arange(len(column)), np.diff(offsets) // dtype.itemsize)


def _structs(t: kernels.Traces, types: dict[str, pa.DataType]) -> pa.Array:
    offsets = pa.array(t.offsets, pa.int32())
    whole = lambda x, **more: pa.array(x.astype(np.int32), pa.int32(), **more)
    lists = lambda x: pa.ListArray.from_arrays(offsets, whole(x))
    strings = lambda x: pa.StringArray.from_buffers(len(t.score), offsets.buffers()[1], pa.py_buffer(x.tobytes()))
    rows = lambda x: pa.ListArray.from_arrays(whole(np.arange(len(x) + 1) * t.length), whole(x.ravel()))
    columns = np.diff(t.offsets)

    def first_mir() -> pa.Array:
        at = np.minimum(t.offsets[:-1], max(len(t.of) - 1, 0))
        return whole(t.first_at[at] if len(t.of) else np.zeros(len(columns)), mask=columns == 0)

    found = {
        "score": lambda: pa.array(t.score, pa.float64()),
        "columns": lambda: whole(columns),
        "first_mir": first_mir,
        "matches": lambda: whole(t.number(t.equal)),
        "mismatches": lambda: whole(t.number((t.step == kernels.DIAGONAL) & ~t.equal)),
        "gaps": lambda: whole(t.number(t.step != kernels.DIAGONAL)),
        "gap_mir": lambda: whole(t.number(t.inner)),
        "gap_gene": lambda: whole(t.number(t.step == kernels.UP)),
        "mir_aln": lambda: strings(t.first),
        "gene_aln": lambda: strings(t.second),
        "mir_idx": lambda: lists(t.first_at),
        "gene_idx": lambda: lists(t.second_at),
        "state": lambda: rows(t.state),
        "gap_after": lambda: rows(t.after),
        "kind": lambda: rows(t.kind),
    }
    return pa.StructArray.from_arrays([found[name]() for name in types], fields=[pa.field(*x) for x in types.items()])


COLUMNS = "score double, place int, mir_idx int, gene_idx int, mir string, gene string"
_COLUMNS = pa.schema([("score", pa.float64()), ("place", pa.int32()), ("mir_idx", pa.int32()), ("gene_idx", pa.int32()), ("mir", pa.string()), ("gene", pa.string())])


def path_table(model: Model, carried: str):
    """A table function of the columns of alignments, for ``spark.udtf.register`` and ``SELECT ... FROM name(TABLE(pairs))``.

    ``pairs`` has ``noncodingRNA`` and ``target_rc``, and the columns that ``carried`` declares, which come back with each
    column of a pair's alignment: its ``place`` from 0, the places of its bases from 0 (null in a gap) and its letters
    (``-`` in a gap). An empty alignment has no row; a null sequence counts as empty. Whole Arrow batches are aligned,
    where they lie: the call needs no shuffle. Carried names must differ from those of ``COLUMNS``.
    """

    @F.arrow_udtf(returnType=f"{carried}, {COLUMNS}" if carried else COLUMNS)
    class AlignPath:
        def eval(self, batch: pa.RecordBatch):
            given = [n for n in batch.schema.names if n not in ("noncodingRNA", "target_rc")]
            first, second = ([x or "" for x in batch.column(n).to_pylist()] for n in ("noncodingRNA", "target_rc"))
            for places, t in kernels.traces(first, second, model.weights, model.local):
                owner = t.of
                own = batch.take(pa.array(places[owner]))
                letters = lambda x: pa.StringArray.from_buffers(len(x), pa.array(np.arange(len(x) + 1), pa.int32()).buffers()[1], pa.py_buffer(x.tobytes()))
                at = lambda x: pa.array(x, pa.int32(), mask=x < 0)
                found = [pa.array(t.score[owner]), pa.array(np.arange(len(owner)) - t.offsets[owner], pa.int32()), at(t.first_at), at(t.second_at), letters(t.first), letters(t.second)]
                yield pa.Table.from_arrays([*(own.column(n) for n in given), *found], names=[*given, *_COLUMNS.names])

    return AlignPath


def scored(pairs: DataFrame, model: Model, python: bool = True) -> DataFrame:
    """``pairs`` with ``score`` and ``logit`` = score + alpha; ``target_rc`` is what is aligned with ``noncodingRNA``.

    Without ``python`` the scores are one expression of the JVM.
    """
    score = score_column if python else score_expression
    out = pairs.withColumn("score", score(F.col("noncodingRNA"), F.col("target_rc"), model.weights, model.local))
    return out.withColumn("logit", F.col("score") + F.lit(float(model.alpha)))


def aligned(pairs: DataFrame, model: Model, fields: tuple[str, ...] = ALL) -> DataFrame:
    """``pairs`` with the struct ``aln``: see ``path_column``. What isn't asked for isn't handed from task to task."""
    return pairs.withColumn("aln", path_column(F.col("noncodingRNA"), F.col("target_rc"), model.weights, model.local, fields))


def align_local(pairs: DataFrame, model: Model, fields: tuple[str, ...] = ALL) -> DataFrame:
    return aligned(pairs, Model(model.weights, model.alpha, "local"), fields)


def align_glocal(pairs: DataFrame, model: Model, fields: tuple[str, ...] = ALL) -> DataFrame:
    return aligned(pairs, Model(model.weights, model.alpha, "glocal"), fields)


def alignment_attributes(rows: DataFrame) -> DataFrame:
    """Score, number of columns and first aligned place of the first sequence."""
    return rows.withColumns({"aln_score": F.col("aln.score"), "aln_columns": F.col("aln.columns"), "first_mir": F.col("aln.first_mir")})


def counted(rows: DataFrame) -> DataFrame:
    """Matches, mismatches and gaps of each alignment, and the intercept."""
    return rows.withColumns({name: F.col(f"aln.{name}") for name in ("matches", "mismatches", "gaps")} | {"intercept": F.lit(1)})


def positional_features(rows: DataFrame, length: int) -> DataFrame:
    """``{i}_is_match``, ``{i}_is_mismatch`` of each position, ``Gap_miR``, ``Gap_gene`` and ``intercept``, from alignments with ``kind``."""
    out = {}
    for i in range(length):
        here = F.get("aln.kind", F.lit(i))
        out[f"{i}_is_match"] = F.coalesce((here == 1).cast("int"), F.lit(0))
        out[f"{i}_is_mismatch"] = F.coalesce((here == 0).cast("int"), F.lit(0))
    return rows.withColumns(out | {"Gap_miR": F.col("aln.gap_mir"), "Gap_gene": F.col("aln.gap_gene"), "intercept": F.lit(1)})


def without_empty_features(rows: DataFrame, names: list[str], drop: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Drops features that are 0 in every row, and those named in ``drop``; ``rows`` are stored, so that they are worked out once."""
    rows = stored(rows)
    totals = rows.agg(*(F.sum(F.abs(F.col(f"`{n}`"))).alias(n) for n in names)).first()
    kept = [n for n in names if totals[n] and n not in drop]
    return rows.select(*(c for c in rows.columns if c not in names or c in kept)), kept


def footprint_counts(pairs: DataFrame, model: Model) -> DataFrame:
    """How often each base stands opposite each position and base of the first sequence. A task adds up its own alignments."""
    length = model.weights.length
    schema = pa.schema([("pos", pa.int32()), ("mir", pa.int32()), ("gene", pa.int32()), ("n", pa.int64())])

    def partial(batches):
        total = np.zeros(length * 20, np.int64)
        for batch in batches:
            for _, t in kernels.traces(batch.column("noncodingRNA"), batch.column("target_rc"), model.weights, model.local):
                some = t.step != kernels.LEFT
                total += np.bincount((((t.i - 1) * 4 + (t.both >> 2)) * 5 + t.opposite)[some], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((some // 20, some // 5 % 4, some % 5, total[some]), schema.types, strict=True)], schema=schema)

    sums = pairs.select("noncodingRNA", "target_rc").mapInArrow(partial, "pos int, mir int, gene int, n long").groupBy("pos", "mir", "gene").agg(F.sum("n").alias("n"))
    return sums.select("pos", code_base(F.col("mir")).alias("mir_nt"), code_base(F.col("gene")).alias("gene_nt"), "n")
