"""Queries by SQL, the pipeline's stages against plain versions."""

import duckdb
import numpy as np
import pytest
from compare import duck, same
from pyspark.sql import functions as F
from test_operators import plain_components, plain_pii

import corpus_pipeline
from strandlink.llm import mixing, pq, quality
from strandlink.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), duck(sf), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_table(spark, sf, name):
    df = QUERIES[name](spark, sf)
    read = "pages" if name.startswith("op3") else "embeddings" if name.startswith("op8") else "documents"
    assert df.count() == spark.read.parquet(f"{sf}/{read}.parquet").count()


def test_linked_vectors_equal_sql(spark, tmp_path):
    """Groups of near vectors, copies and scaled copies, in several labels, against the SQL."""
    rng = np.random.default_rng(7)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.normal(size=24)
            rows += [(len(rows) + k, [float(np.float32(x)) for x in base + rng.normal(size=24) * 0.08], label) for k in range(5)]
            rows += [(len(rows), rows[-1][1], label), (len(rows) + 1, [2 * x for x in rows[-1][1]], label)]
    rows += [(len(rows), None, 0), (len(rows) + 1, [0.0] * 24, 0), (len(rows) + 2, [float("nan")] * 24, 1), (len(rows) + 3, [1.0, 2.0], 1), (len(rows) + 4, [1.0, 2.01], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    same(pq.near_links(spark.read.parquet(str(tmp_path / "embeddings.parquet"))), con, ORACLE_SQL["op8_embedding_pq"])
    assert con.sql("select count(*) from (" + ORACLE_SQL["op8_embedding_pq"] + ") where n_links > 0").fetchall()[0][0] > 100


def test_odd_documents(spark, sf, tmp_path):
    """Every stage over null, empty, repeated and very long rows and clashing columns, and over no rows."""
    real = spark.read.parquet(f"{sf}/documents.parquet")
    text = "A sentence of some length that a reader would call good. " * 12
    odd = [(None, text + "one", "en", "a"), (None, text + "one", "en", "a"), (None, None, None, None), (7, text + "two", "en", None), (7, "another text under the same id " + text[:200], "en", "b"), (8, "", "en", "b"), (9, None, "en", "b"), (10, "word " * 300_000, "en", "a"), (11, "write to a.b@c.example.com or 10.0.0.1", "en", "a")]
    rows = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    names = {c: F.lit(1) for c in ("score", "key", "label", "held_out", "h", "n", "size", "taken", "__p0")}
    docs = real.unionByName(rows).withColumns(names)
    docs.write.parquet(str(tmp_path / "docs"))
    for start in (spark.read.parquet(str(tmp_path / "docs")), spark.read.parquet(str(tmp_path / "docs")).limit(0)):
        now, empty = start, start.isEmpty()
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, sf)
            path = str(tmp_path / f"{name}-{empty}")
            out.write.parquet(path)
            now = spark.read.parquet(path)
            if k < 4:
                assert now.columns == start.columns and now.where("score <> 1").count() == 0
            assert empty == now.isEmpty()


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], sf)
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if k < 4:
            assert out.columns == docs.columns
    _, good, one, masked, mixed, tokens = seen
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.scored(docs, model).where("score >= 0.7").select("doc_id").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept
    plain = plain_components([(r["doc_id"], r["text"]) for r in good.collect()])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(d for d, _, c in plain if d == c)
    assert not any(plain_pii(r["text"]) for r in masked.collect())
    assert masked.count() == one.count()
    words = lambda df: sum(r[0] or 0 for r in df.select(mixing.n_words(df["text"])).collect())
    assert words(mixed) == pytest.approx(words(masked), abs=20)
    assert tokens.count() == mixed.count()
    assert corpus_pipeline.run(spark, sf).count() == tokens.count()
