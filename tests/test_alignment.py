"""The batch kernel against a cell-by-cell version, footprints, and the model's storage."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlink.operators import kernels, model
from strandlink.operators.kernels import Weights


def plain(a, b, w, local):
    """One pair, one cell at a time."""
    n, m = len(a), len(b)
    code = {c: i for i, c in enumerate(kernels.BASES)}
    h = np.zeros((n + 1, m + 1), np.float32)
    step = np.zeros((n + 1, m + 1), int)
    best, end = 0.0, (0, 0)
    for i in range(1, n + 1):
        last = -1.0 if local else -np.inf
        gap = last if i == n else w.gap_first[i - 1]
        if not local:
            h[i, 0] = np.float64(h[i - 1, 0]) + w.gap_second[i - 1]
        for j in range(1, m + 1):
            d = np.float64(h[i - 1, j - 1]) + w.match[code[a[i - 1]], code[b[j - 1]], i - 1]
            left = np.float64(h[i, j - 1]) + gap
            up = np.float64(h[i - 1, j]) + w.gap_second[i - 1]
            if local:
                s, k = 0.0, 0
                for v, name in ((d, 1), (left, 2), (up, 3)):
                    if v > s:
                        s, k = v, name
                if s > best:
                    best, end = s, (i, j)
            elif d >= left and d >= up:
                s, k = d, 1
            else:
                s, k = (left, 2) if left >= up else (up, 3)
            h[i, j], step[i, j] = s, k
    if not local:
        j = int(h[n].argmax())
        best, end = float(h[n, j]), (n, j)
    return best, end, step


bases = st.text("ACGT", min_size=1, max_size=9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(bases, st.text("ACGT", max_size=12)), min_size=1, max_size=8), st.booleans(), st.integers(0, 5))
def test_kernel_equals_plain(pairs, local, seed):
    rng = np.random.default_rng(seed)
    w = Weights(rng.normal(0, 2, (4, 4, 9)), rng.normal(-1, 1, 8), rng.normal(-1, 1, 9))
    a, b = map(list, zip(*pairs))
    got = kernels.scores(a, b, w, local)
    for x, y, g, p in zip(a, b, got, kernels.paths(a, b, w, local)):
        assert g == plain(x, y, w, local)[0] == p.score
        assert p.first.replace("-", "") in x and p.second.replace("-", "") in y
        assert len(p.first) == len(p.second) == len(p.first_at)


@settings(max_examples=40, deadline=None)
@given(bases, st.text("ACGT", max_size=14), st.booleans())
def test_score_is_sum_over_path(a, b, local):
    w = model.uniform_weights(9, 5, -4, -6)
    p = kernels.paths([a], [b], w, local)[0]
    total = 0
    for x, y, i in zip(p.first, p.second, p.first_at):
        if x == "-":
            before = [k for k in p.first_at[: p.first_at.index(-1) + 1] if k >= 0]
            total += -1 if local and before and before[-1] == len(a) - 1 else -6
        else:
            total += -6 if y == "-" else 5 if x == y else -4
    assert p.score == total


def test_glocal_gap_and_empty_target():
    w = model.uniform_weights(22, 5, -4, -6)
    p = kernels.paths(["A" * 22], ["A" * 21], w, False)[0]
    assert "-" in p.second and len(p.first) == len(p.second)
    assert kernels.scores(["AC"], [""], w, True)[0] == 0
    assert kernels.scores(["AC"], [""], w, False)[0] == -12


def test_footprint():
    state, after = kernels.footprints(4, kernels.encode(["ATG"]), np.array([[0, 1, -1, 2]]), np.array([[0, -1, 1, 2]]))
    assert state.tolist() == [[0, 4, 3, -1]] and after.tolist() == [[0, 1, 0, 0]]


def test_too_long_and_bad_base():
    w = model.uniform_weights(3, 5, -4, -6)
    with pytest.raises(ValueError, match="weights"):
        kernels.scores(["ACGT"], ["A"], w)
    with pytest.raises(ValueError, match="nucleotide"):
        kernels.scores(["ACN"], ["A"], w)


def test_baseline():
    w, alpha = model.baseline_weights(22)
    assert w.match.shape == (4, 4, 22) and w.gap_first.shape == (21,) and w.gap_second.shape == (22,)
    assert w.match[0, 0, 3] == 0.724709 and w.match[0, 1, 3] == -0.647892 and alpha == -5.226262
    with pytest.raises(ValueError):
        Weights(np.zeros((4, 4, 5)), np.zeros(5), np.zeros(5))


def test_model_storage(spark, tmp_path):
    w, alpha = model.baseline_weights(5)
    m = model.Model(w, alpha, "glocal", [[0.9, 0.1], [0.2, 0.8]])
    model.save_model(spark, m, str(tmp_path / "m"))
    back = model.load_model(spark, str(tmp_path / "m"))
    assert np.array_equal(back.weights.match, w.match) and back.aligner == "glocal" and back.label_observation == m.label_observation


def test_partitioning_does_not_matter(spark):
    from strandlink.operators import align

    rows = spark.createDataFrame([("ACGTAC", "GTACGT"), ("TTT", "AAATTT"), ("ACG", "")] * 5, "noncodingRNA string, target_rc string")
    m = model.Model(model.uniform_weights(6, 5, -4, -6), 1.0)
    one, many = (sorted(r["logit"] for r in align.scored(rows.repartition(k), m).collect()) for k in (1, 7))
    assert one == many


@pytest.mark.parametrize("local", [True, False])
def test_expression_equals_kernel(spark, local):
    from strandlink.operators import align

    rng = np.random.default_rng(6)
    text = lambda n: "".join(rng.choice(list("ACGT"), n))
    rows = [(text(rng.integers(1, 8)), text(rng.integers(0, 14))) for _ in range(60)] + [("", "ACG"), ("", ""), ("ACG", "")]
    pairs = spark.createDataFrame(rows, "noncodingRNA string, target_rc string")
    m = model.Model(Weights(rng.normal(0.4, 2, (4, 4, 8)), rng.normal(-0.7, 1, 7), rng.normal(-0.7, 1, 8)), 0.5, "local" if local else "glocal")
    both = align.scored(pairs, m, python=False).withColumnRenamed("score", "plain").withColumn("score", align.score_column(F.col("noncodingRNA"), F.col("target_rc"), m.weights, local)).collect()
    assert len(both) == 63 and all(r["plain"] == r["score"] and r["logit"] == r["plain"] + 0.5 for r in both)
    with pytest.raises(Exception, match="longer than the weights"):
        align.scored(spark.createDataFrame([("A" * 9, "A")], pairs.schema), m, python=False).collect()


def test_logits_of_tables_are_aligned_in_batches(spark, sf):
    """A cell of the JVM's expression is interpreted, which no table of pairs stands."""
    from strandlink.plans.queries import QUERIES

    plan = QUERIES["align_logits_jvm"](spark, sf)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan.lower().replace("hashaggregate(", "")


@pytest.mark.parametrize("local", [True, False])
def test_path_table(spark, local):
    """A row to an alignment column, with carried columns; empty alignments and null sequences have none."""
    from strandlink.operators import align

    rng = np.random.default_rng(3)
    text = lambda n: "".join(rng.choice(list("ACGT"), n))
    rows = [(k, f"p{k % 7}", text(rng.integers(1, 9)), text(rng.integers(1, 14))) for k in range(80)] + [(90, None, "AAA", "AAA"), (90, None, "AAA", "AAA"), (91, "x", "AAA", "CCC"), (92, "x", None, "A"), (93, "x", "", "")]
    m = model.Model(Weights(rng.normal(0.4, 2, (4, 4, 9)), rng.normal(-0.7, 1, 8), rng.normal(-0.7, 1, 9)), 0.0, "local" if local else "glocal")
    pairs = spark.createDataFrame(rows, "key int, other string, noncodingRNA string, target_rc string").repartition(5)
    spark.udtf.register("align_path_test", align.path_table(m, "key int, other string"))
    pairs.createOrReplaceTempView("pairs_of_test")
    got = sorted(map(tuple, spark.sql("SELECT key, other, score, place, mir_idx, gene_idx, mir, gene FROM align_path_test(TABLE(pairs_of_test))").collect()), key=repr)
    want = []
    none = lambda i: None if i < 0 else i
    for (key, other, *_), p in zip(rows, kernels.paths([r[2] or "" for r in rows], [r[3] or "" for r in rows], m.weights, local)):
        want += [(key, other, p.score, c, none(i), none(j), x, y) for c, (x, y, i, j) in enumerate(zip(p.first, p.second, p.first_at, p.second_at))]
    assert len(want) > 100 and got == sorted(want, key=repr)
    assert spark.sql("SELECT key, other, place FROM align_path_test(TABLE(SELECT * FROM pairs_of_test WHERE key < 0))").count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(bases, st.text("ACGT", max_size=12)), min_size=1, max_size=8), st.booleans(), st.integers(0, 5))
def test_whole_weights_equal_plain(pairs, local, seed):
    """Whole weights take whole cells; alike by position, or not."""
    rng = np.random.default_rng(seed)
    other = Weights(rng.integers(-5, 6, (4, 4, 9)).astype(float), rng.integers(-4, 2, 8).astype(float), rng.integers(-4, 2, 9).astype(float))
    a, b = map(list, zip(*pairs))
    for w in (model.uniform_weights(9, 5, -4, -6), other):
        assert kernels._whole(w, 30) and kernels.scores(a, b, w, local).tolist() == [plain(x, y, w, local)[0] for x, y in pairs]


def test_counts_come_with_alignments(spark):
    """Numbers of an alignment are those of its rows, also when its rows aren't asked for."""
    from strandlink.operators import align

    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("ACGT"), n))
    pairs = spark.createDataFrame([(text(rng.integers(1, 10)), text(rng.integers(0, 20))) for _ in range(50)], "noncodingRNA string, target_rc string")
    m = model.Model(model.uniform_weights(10, 5, -4, -6), 0.0)
    for r in align.counted(align.align_local(pairs, m)).collect():
        both = list(zip(r["aln"]["mir_aln"], r["aln"]["gene_aln"]))
        want = (sum(x == y for x, y in both), sum(x != y and "-" not in (x, y) for x, y in both), sum("-" in (x, y) for x, y in both), len(both))
        assert (r["matches"], r["mismatches"], r["gaps"], r["aln"]["columns"]) == want
    few = align.align_local(pairs, m, ()).schema["aln"].dataType.names
    assert "mir_aln" not in few and "matches" in few


def test_split_joins_no_keys_by_label(spark):
    """All keys of a label never meet in one task."""
    from strandlink.operators.splits import stratified_split

    rows = spark.range(1000).selectExpr("CAST(id % 2 AS INT) AS label", "CAST(id AS STRING) AS a")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = stratified_split(rows, 0.3, 7, ["a"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert {(r["label"], r["n"]) for r in found.where("held_out").groupBy("label").agg(F.count("*").alias("n")).collect()} == {(0, 150), (1, 150)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
