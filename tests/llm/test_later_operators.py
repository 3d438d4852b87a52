"""Fill-in-middle, resampling and repeated lines against plain versions, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlink.llm import infill, jaccard, kernel, langid, line_dedup, mixing, pii, resample

ROWS = [
    (1, "one\ntwo\nthree\n"),
    (2, "no line end"),
    (3, None),
    (4, ""),
    (5, "\n\n\n"),
    (6, "é🎉\nünï \n" * 40),
    (7, "holds <S> a sentinel\nand more"),
    (8, "ends in <\nP> and <P\n<M\n"),
    (9, "\tShared Line \r\nown nine\n\nshared line\n  "),
    (10, " shared line\nown ten\nSHARED LINE"),
    (10, "another text of id ten\nshared line"),
    (None, "no id\nshared line\nlast"),
    (None, "no id, other text\nshared line"),
    (2, "no line end"),
    (11, "x" * 5000 + "\n" + "words " * 3000),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, and columns of the names that the operators make."""
    rows = spark.createDataFrame(ROWS, "doc_id long, text string")
    return rows.withColumns({c: F.lit("x") for c in ("key", "place", "version", "runs", "held", "h1", "n", "form", "tie", "rank", "__part", "d", "v")}).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# --- fill-in-middle


def plain_fim(doc_id, text, units, seed=7, rate=100, spm=50, sentinels=infill.SENTINELS):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in sentinels) or h3 % 100 >= rate:
        return n, "plain", text, None, None
    x, y, z = sentinels
    return (n, "spm", y + s + x + p + z + m, len(p), len(m)) if h4 % 100 < spm else (n, "psm", x + p + y + s + z + m, len(p), len(m))


UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*?(?=[^\x20\x09-\x0D]|\Z)|[\x20\x09-\x0D]+\Z", "char": r"(?s)."}


def lines(text):
    return re.findall(UNIT["line"], text or "")


@pytest.mark.parametrize("chunk", [infill.CHUNK, 1, 7])
@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0)])
def test_infill(docs, chunk, rate, spm):
    found = infill.transformed(docs, rate=rate, spm=spm, chunk=chunk)
    found = found.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *plain_fim(i, t, lines(t), rate=rate, spm=spm), t or "") for i, t in ROWS]
    assert sorted(map(tuple, [(r["doc_id"], r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"], r["back"]) for r in found]), key=repr) == sorted(want, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n\té🎉", max_size=60), st.sampled_from(sorted(UNIT)), st.integers(1, 9))
def test_places_of_units(text, unit, size):
    data = np.frombuffer(text.encode(), np.uint8)
    chunked = infill.Chunked(data, unit, size)
    if unit == "word":
        edges = [i for i in range(1, len(text)) if text[i - 1] in " \t\n" and text[i] not in " \t\n"]
    else:
        edges = [sum(map(len, re.findall(UNIT[unit], text)[:k])) for k in range(1, len(re.findall(UNIT[unit], text)))]
    places = [0, *edges, len(text)] if text else [0]
    assert chunked.units == len(places) - 1
    assert [chunked.place(k) for k in range(len(places))] == [(len(text[:p].encode()), p) for p in places]


def test_infill_sentinels_and_empty_table(docs, empty):
    assert infill.transformed(empty).count() == 0
    own = ("<|pre|>", "<|suf|>", "<|mid|>")
    rows = infill.transformed(docs, unit="char", sentinels=own).withColumn("back", infill.restored(F.col("output"), F.col("form"), own)).collect()
    assert sorted(r["back"] for r in rows) == sorted(t or "" for _, t in ROWS) and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for bad in (("<P>", "<P>", "<M>"), ("aba", "x", "y"), ("ab", "bc", "z"), ("", "a", "b"), ("abc", "b", "z")):
        with pytest.raises(ValueError, match="sentinels"):
            infill.transformed(docs, sentinels=bad)
    with pytest.raises(ValueError, match="unit"):
        infill.transformed(docs, unit="page")


# --- resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def runs(text, longest=3):
    w = WORD.findall(low(text))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, share, least, buckets=10_000):
    def counts(texts):
        return Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in runs(t)[1])

    s, t = counts(x for _, x in docs), counts(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1.0) * (all_s + buckets) / ((s[k] + 1.0) * (all_t + buckets)))) for k in range(buckets)]
    rows = []
    for i, text in docs:
        n, grams = runs(text)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in grams)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: len(fit) * share[0] // share[1]]
    return sorted([(*r[:4], next((k + 1 for k, d in enumerate(drawn) if d is r), None)) for r in rows], key=repr)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abzAZ09 -é🎉\n", max_size=40), min_size=1, max_size=5), st.integers(1, 4), st.integers(0, 1))
def test_feature_buckets(texts, longest, long):
    texts = [t + " " + "w" * 70 + t for t in texts] if long else texts
    data = [low(t).encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    found, by_text = resample.features(np.frombuffer(b"".join(data), np.uint8), offsets, 0, 997, longest)
    assert np.diff(by_text).tolist() == [runs(t)[0] for t in texts]
    assert Counter(b for _, some in found for b in some.tolist()) == Counter(zlib.crc32(g.encode()) % 997 for t in texts for g in runs(t, longest)[1])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "ccc", "w" * 80, "é"]), max_size=40), st.integers(1, 12))
def test_features_of_stretches(words, most):
    text = np.frombuffer(" ".join(words).encode(), np.uint8)
    held = Counter()
    for part, before in resample.stretches(text, 3, most):
        for _, some in resample.features(part, np.array([0, len(part)]), before)[0]:
            held.update(some.tolist())
    assert held == Counter(zlib.crc32(g.encode()) % 10_000 for g in runs(" ".join(words))[1])


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=20), st.integers(0, 5000))
def test_register_after_zeros(data, zeros):
    register = np.array([~np.uint32(zlib.crc32(data))])
    assert int(~resample.shifted(register, np.array([zeros]))[0]) == zlib.crc32(data + bytes(zeros))


def test_resampling(spark, docs, empty, sf):
    target = spark.createDataFrame([("shared line of words",), (None,), ("words words",)], "text string")
    rows = [*ROWS, *((100 + k, f"shared line number {k % 7} of words " * (k % 5)) for k in range(60))]
    both = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for share, least in (((5, 100), 1), ((50, 100), 3), ((1, 1), 0)):
        found = resample.resampled(both, target, share, least)
        # Rows equal in all but the rank may have each other's.
        assert sorted(map(tuple, found.collect()), key=repr) == plain_resample(rows, ["shared line of words", "", "words words"], share, least)
    assert resample.resampled(empty, target).count() == 0
    assert resample.resampled(docs, target, least_words=10**9).where("rank is not null").count() == 0
    assert resample.resampled(docs, empty.select("text"), (1, 2), 0).where("rank is not null").count() == len(ROWS) // 2


@pytest.mark.parametrize("k", [1, 2, 17, 250, 251, 999, 1000])
def test_radix_selection(spark, k):
    rng = np.random.default_rng(1)
    values = [(int(a) * 70_000, int(b), int(c)) for a, b, c in zip(rng.integers(-3, 3, 1000), rng.integers(-(1 << 62), 1 << 62, 1000), rng.integers(-(1 << 63), (1 << 63) - 1, 1000))]
    values = values[:500] + [(x[0], 7, x[2]) for x in values[500:]]
    rows = spark.createDataFrame(values, "a long, b long, c long").repartition(3).cache()
    digits = resample.lowest(rows, [F.col("a"), F.col("b"), F.col("c")], k)
    assert sorted(map(tuple, rows.where(resample.until(digits)).collect())) == sorted(values)[:k]
    assert resample.lowest(rows, [F.col("a")], 0) is None and resample.lowest(rows, [F.col("a")], 1001) is None


def test_long_texts_are_scored_in_stretches(spark):
    text = " ".join(f"w{k % 91}" for k in range(5000))
    rows = [(1, text), (2, "short text")]
    parts = list(resample.stretches(np.frombuffer(text.encode(), np.uint8), 3, 1000))
    assert len(parts) > 15 and max(len(p) for p, _ in parts) < 1020
    docs, target = (spark.createDataFrame(x, s).repartition(2) for x, s in ((rows, "doc_id long, text string"), ([("w1 w2 w3",)], "text string")))
    found = resample.resampled(docs, target, (1, 1), 1, stretch=1000)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_resample(rows, ["w1 w2 w3"], (1, 1), 1)


# --- repeated lines


def plain_lines(rows, min_docs, min_chars):
    def key(line):
        return low(line.strip(" \t\n\x0b\x0c\r"))

    held = {}
    for i, t in set(rows):
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add((i, t or ""))
    often = {k for k, d in held.items() if len(d) >= min_docs and len(k) >= min_chars}
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if key(x) not in often]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs,min_chars", [(2, 1), (3, 1), (2, 12), (1, 0), (6, 1), (7, 1)])
def test_line_dedup(docs, min_docs, min_chars):
    found = line_dedup.deduplicated(docs, min_docs, min_chars)
    assert sorted(map(tuple, found.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=repr) == plain_lines(ROWS, min_docs, min_chars)


def test_line_bitmaps(docs, empty, spark):
    assert line_dedup.deduplicated(empty, 2).count() == 0 and line_dedup.drop_bitmaps(empty, 2).count() == 0
    found = {(r["doc_id"], r["kept"]): r["runs"] for r in line_dedup.deduplicated(docs, 2).collect()}
    assert found[9, "own nine\n\n  "] == [(0, 1), (3, 1)] and found[1, ROWS[0][1]] is None
    many = "\n".join(["same"] * 3000 + ["own"] + ["same"] * 3000)
    rows = spark.createDataFrame([(1, many), (2, "same")], "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.deduplicated(rows, 2).select("doc_id", "n_dropped", "runs", "kept").collect())) == [(1, 6000, [(0, 3000), (3001, 3000)], "own"), (2, 1, [(0, 1)], "")]


def test_line_dedup_moves_no_text_and_runs_no_python(docs):
    records = line_dedup.line_records(docs)
    assert records.columns == ["key", "doc_id", "version", "place", "first"]
    plan = line_dedup.deduplicated(docs, 2)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert kernel.SPACE[[ord(c) for c in line_dedup.SPACE]].all()


# --- names that clash, words that collide

OWN = [f"{m}{n}" for m in ("__", "___") for n in ("size", "text", "id", "h", "whole", "rest", "part", "spans", "t", "new", "a", "b", "before", "where", "at")]


def test_operators_keep_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "one two three a@b.example.com five six", "en", "x"), (2, "one two three a@b.example.com five six", "en", "y"), (None, None, None, None), (3, "", "en", "x")], "doc_id long, text string, lang string, source string")
    rows = rows.withColumns({c: F.lit(f"own {c}") for c in OWN})
    for made in (mixing.repeated(rows), pii.masked(rows), jaccard.keep_one(rows)):
        assert made.columns == rows.columns and made.count() > 0
        assert all({r[c] for r in made.collect()} == {f"own {c}"} for c in OWN)
    assert "<EMAIL>" in {r["doc_id"]: r["text"] for r in pii.masked(rows).collect()}[1]
    assert sorted(r["doc_id"] for r in jaccard.keep_one(rows).where("doc_id is not null").collect()) == [1, 3]
    assert langid.identified(rows, langid.fit(rows)).count() == 4


def test_long_words_do_not_collide(spark):
    a, b = b"a", b"b"
    for _ in range(11):
        a, b = a + b, b + a
    docs = spark.createDataFrame([(1, a.decode()), (2, b.decode()), (3, a.decode()), (4, f"{a.decode()} {b.decode()}")], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert found == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (1, 4)}
    data = np.frombuffer(a + b" " + b, np.uint8)
    starts, ends, _ = kernel.words(data, np.array([0, len(data)]))
    assert len(set(kernel.word_hashes(data, starts, ends).tolist())) == 2


def test_language_calibrates_on_all_documents(spark):
    """Limits are those of every document learnt from, also beyond the first thousands."""
    from strandlink.llm import langid
    from strandlink.llm.quality import held_out

    rows = [(k, ("eine kleine katze schlief" if k % 2 else "the small cat was asleep") + f" {chr(97 + k % 7)}{chr(97 + k % 11)}", "de" if k % 2 else "en") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.fit(docs)
    known = docs.where(~held_out(F.col("doc_id"))).select("text", "lang").collect()
    assert len(known) > 4000
    bits = next(iter(found.entropies([[r["text"] for r in known]])))[0]
    for k, lang in enumerate(found.langs):
        own = bits[[r["lang"] == lang for r in known], k]
        assert found.limits[lang] == pytest.approx(own.mean() + 4 * own.std())
