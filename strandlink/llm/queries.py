"""The queries ``opN_<name>`` over whole tables, and the SQL that states them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; ``n_near`` counts, for every
    document whose id 20 divides, all others within three bits."""
    from .simhash import counted_neighbours, edited_likeness
    from .spark_tools import release, stash

    rows = stash(edited_likeness(table(spark, sf_dir, "documents")))
    release(spark)
    return counted_neighbours(rows, every=20, radius=3).drop("bits")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by weights 1, 2, 3 of their sources, three epochs at most."""
    from .mixing import mixed

    return mixed(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most_epochs=3).drop("source")


OP2_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat('7:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS ord
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS weight
  FROM sizes GROUP BY source),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS words,
         CAST(coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_before,
         CAST(sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight_left
  FROM sources),
levels AS (
  SELECT *, CAST(words - full_before AS DOUBLE) / CAST(weight_left AS DOUBLE) AS level FROM filled),
chosen AS (SELECT max(level) AS level FROM levels WHERE level * weight <= 3 * source_size),
targets AS (
  SELECT source, source_size,
         CASE WHEN source_size > 0 THEN least(CAST(3 * source_size AS DOUBLE), weight * coalesce((SELECT level FROM chosen), CAST('inf' AS DOUBLE))) ELSE 0.0::DOUBLE END AS target
  FROM sources),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
rows AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, CAST(round(p.target) AS BIGINT) - p.whole * p.source_size AS missing,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.doc_id NULLS FIRST, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS before
  FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, missing - before)) AS BIGINT) AS taken FROM rows
"""


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    from .html_text import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    from .pii import report

    return report(table(spark, sf_dir, "documents"))


def op5_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    from .quality import classified

    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of Jaccard similarity 0.8 or more."""
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=5, num=80, den=100)


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
  FROM words),
sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, s FROM sets),
held AS (SELECT doc_id, n_shingles AS n, unnest(s) AS g FROM sized),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM held a JOIN held b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reached(doc_id, spot) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON r.spot = l.x)
SELECT doc_id, any_value(n_shingles) AS n_shingles, min(spot) AS component_id FROM sized JOIN reached USING (doc_id) GROUP BY doc_id
"""


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 100-byte strings that also start earlier."""
    from .suffix import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"), texts=False)


#: Every window of 100 bytes of every text in hex; a maximal run of windows that are not the first of their kind is a span.
OP7_SQL = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
sums AS (SELECT doc_id, list_transform(range(0, greatest(n - 99, 0)), lambda s: md5(substr(h, CAST(2 * s + 1 AS BIGINT), 200))) AS w FROM texts),
windows AS (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS place FROM (SELECT doc_id, unnest(w) AS w, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS s FROM sums)),
later AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM windows WHERE place > 1),
runs AS (SELECT doc_id, s, sum(CASE WHEN s <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM later),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM runs GROUP BY doc_id, run),
edges AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM (SELECT * FROM spans UNION ALL SELECT doc_id, n, n FROM texts)),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * e.a + 1 AS BIGINT), CAST(2 * (e.b - e.a) AS BIGINT)), '' ORDER BY e.a, e.b) AS h FROM edges e JOIN texts USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM texts JOIN kept k USING (doc_id) LEFT JOIN gone USING (doc_id)
"""


def op8_embedding_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.98 within their labels."""
    from .pq import near_links

    return near_links(table(spark, sf_dir, "embeddings"), cosine=0.98)


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
good AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id < b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reached(vec_id, spot) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.y FROM reached r JOIN links l ON r.spot = l.x),
counts AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, any_value(coalesce(n, 0)) AS n_links, min(spot) AS component_id, min(spot) = vec_id AS kept FROM reached LEFT JOIN counts USING (vec_id) GROUP BY vec_id
"""


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    from .langid import fit, identified

    docs = table(spark, sf_dir, "documents")
    return identified(docs, fit(docs))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and the bytes decoded from them, as sums."""
    import public_tokenizers

    from .bpe import encoded

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into lines and put into fill-in-middle order, as sums, and what is restored from that."""
    from pyspark.sql import functions as F

    from .infill import restored, transformed

    rows = transformed(table(spark, sf_dir, "documents"), unit="line", seed=7, rate=100, spm=50)
    sums = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *(c.alias(k) for k, c in sums.items()))


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256(concat('7:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h FROM documents),
cuts AS (
  SELECT *, len(u) AS n, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) % (len(u) + 1) AS c1, CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) % (len(u) + 1) AS c2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST(concat('0x', substr(h, 17, 8)) AS BIGINT) % 100 >= 100 THEN 'plain'
         WHEN CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM texts),
parts AS (
  SELECT *, coalesce(array_to_string(u[1 : least(c1, c2)], ''), '') AS p, coalesce(array_to_string(u[least(c1, c2) + 1 : greatest(c1, c2)], ''), '') AS m,
    coalesce(array_to_string(u[greatest(c1, c2) + 1 : n], ''), '') AS s FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN concat('<S>', s, '<P>', p, '<M>', m) ELSE concat('<P>', p, '<S>', s, '<M>', m) END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored towards the benchmark's texts, and the ranks of the best five in a hundred."""
    from .resample import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=(5, 100), least_words=20, seed=42)


#: The table of CRC-32 from its rule, then the register of every distinct run of words byte by byte.
OP12_SQL = r"""
WITH bytes AS (
  SELECT list(list_reduce([k]::UBIGINT[] || range(8)::UBIGINT[], lambda r, x: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END) ORDER BY k) AS c
  FROM (SELECT unnest(range(256))::UBIGINT AS k)),
texts AS (SELECT true AS own, doc_id AS id, row_number() OVER () AS place, text FROM documents UNION ALL SELECT false, item_id, row_number() OVER (), text FROM benchmark),
words AS (
  SELECT own, id, place, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT own, place, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM words),
counted AS (SELECT own, place, g, count(*) AS n FROM runs GROUP BY ALL),
kinds AS (SELECT DISTINCT g FROM counted),
spelt AS (SELECT g, list_transform(range(1, 2 * octet_length(encode(g)), 2), lambda i: CAST(concat('0x', substr(hex(encode(g)), i, 2)) AS UBIGINT)) AS b FROM kinds),
hashed AS (SELECT g, CAST(xor(list_reduce([4294967295::UBIGINT] || b, lambda r, x: xor(r >> 8, c[(xor(r, x) & 255)::INT + 1])), 4294967295::UBIGINT) % 10000 AS INT) AS bucket FROM spelt, bytes),
held AS (SELECT own, place, bucket, sum(n) AS n FROM counted JOIN hashed USING (g) GROUP BY ALL),
shares AS (
  SELECT k AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t, CAST(sum(coalesce(s, 0)) OVER () AS BIGINT) AS all_s, CAST(sum(coalesce(t, 0)) OVER () AS BIGINT) AS all_t
  FROM (SELECT unnest(range(10000))::INT AS k) LEFT JOIN (SELECT bucket, CAST(sum(n) FILTER (own) AS BIGINT) AS s, CAST(sum(n) FILTER (NOT own) AS BIGINT) AS t FROM held GROUP BY bucket) ON k = bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM shares),
weights AS (SELECT place, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM held JOIN gains USING (bucket) WHERE own GROUP BY place),
scores AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('42:', coalesce(CAST(id AS VARCHAR), ''))), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (place) WHERE own),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) FILTER (n_words >= 20) OVER () AS fit FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * fit // 100 THEN r END AS rank FROM placed
"""


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten documents share, as sums."""
    from pyspark.sql import functions as F

    from .line_dedup import deduplicated

    rows = deduplicated(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS place FROM split),
keyed AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (o.key IS NOT NULL) AS n_dropped, sha256(coalesce(string_agg(CASE WHEN o.key IS NULL THEN line END, chr(10) ORDER BY place), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON k.key = o.key GROUP BY doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_source_mix": op2_source_mix,
    "op3_main_text": op3_main_text,
    "op4_personal_data": op4_personal_data,
    "op5_quality_ftrl": op5_quality_ftrl,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_suffix_array": op7_suffix_array,
    "op8_embedding_pq": op8_embedding_pq,
    "op9_language": op9_language,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_infill": op11_infill,
    "op12_resample": op12_resample,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_source_mix": OP2_SQL,
    "op6_ngram_jaccard": OP6_SQL,
    "op7_suffix_array": OP7_SQL,
    "op8_embedding_pq": OP8_SQL,
    "op11_infill": OP11_SQL,
    "op12_resample": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}
