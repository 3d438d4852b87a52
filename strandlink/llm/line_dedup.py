r"""Lines that many documents share, found from hashes alone; DataFrame functions only.

A line's key is the line without white space at its ends, A-Z lower-cased; SHA-256, cut to 128 bits, stands for
it. What travels are records of a key, a document and a place, never the text: they are dealt into ranges of
key and document and sorted by key, document and place, so that a key of very many lines spreads over ranges by
its documents. Streaming through a range marks the first record of a key in each document; marks are summed
within the range before they meet those of other ranges. Keys of ``min_docs`` documents or more lose their
lines. The result is a bitmap a document, run-length coded: stretches of dropped lines, in order.

A document is what has one ``doc_id`` and one text: rows that repeat both count once and get the same bitmap;
rows of one ``doc_id`` (null too) and different texts are different documents. Null texts are one empty line.
A line whose key has fewer than ``min_chars`` code points stays. Only ``doc_id`` and ``text`` are read; an empty
table gives none. Records of one key in one document stand in one range: no more than one text has lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_tools import stash

#: White space that is stripped from the ends of a line.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOC = ["doc_id", "version"]


def short_hash(text: Column) -> Column:
    """The first 128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, version, text``: ``version`` tells texts of one ``doc_id`` apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).select("doc_id", short_hash(F.col("text")).alias("version"), "text")


def line_records(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``key, doc_id, version, place, first``: each line of a document once, stored in sorted ranges of keys and documents.

    ``first`` marks the first line of its key in the document.
    """
    lines = identified(docs).select(*DOC, F.posexplode(F.split("text", "\n")).alias("place", "line")).select(*DOC, "place", line_key(F.col("line")).alias("key"))
    records = lines.where(F.length("key") >= min_chars).select(short_hash(F.col("key")).alias("key"), *DOC, "place").distinct()
    ranges = records.repartitionByRange("key", *DOC).sortWithinPartitions("key", *DOC, "place")
    # The ranges hold all records of a key and document, so this window moves none.
    place = F.row_number().over(Window.partitionBy("key", *DOC).orderBy("place"))
    return stash(ranges.withColumn("first", (place == 1).cast("long")))


def frequent_keys(records: DataFrame, min_docs: int) -> DataFrame:
    """``key, n_docs`` of the keys that so many documents hold; stored, so that a join may split a hot key's records."""
    counts = records.groupBy("key").agg(F.sum("first").alias("n_docs"))
    return stash(counts.where(F.col("n_docs") >= min_docs))


def drop_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``doc_id, version, n_dropped, runs`` of the documents that lose lines; ``runs`` are ``(start, n)``, by start."""
    records = line_records(docs, min_chars)
    gone = records.join(frequent_keys(records, min_docs), "key", "left_semi").select(*DOC, "place")
    # Places that follow each other differ from their numbers by the same amount.
    island = F.col("place") - F.row_number().over(Window.partitionBy(*DOC).orderBy("place"))
    runs = gone.withColumn("island", island).groupBy(*DOC, "island").agg(F.min("place").alias("start"), F.count("*").cast("int").alias("n"))
    return runs.groupBy(*DOC).agg(F.sum("n").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("start", "n"))).alias("runs"))


def without_runs(text: Column, runs: Column) -> Column:
    """``text`` without the lines of ``runs``; what stays is sliced out between them, so each line is touched once."""

    def kept(lines: Column, runs: Column) -> Column:
        def between(k: Column) -> Column:
            last = F.get(runs, k - 1)
            start = F.when(k == 0, F.lit(0)).otherwise(last["start"] + last["n"])
            end = F.when(k == F.size(runs), F.size(lines)).otherwise(F.get(runs, k)["start"])
            return F.slice(lines, start + 1, end - start)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), between)), "\n")

    # The outer function gives the lists a name: written in place they would be split anew for each run.
    pair = F.array(F.struct(F.split(text, "\n").alias("lines"), runs.alias("runs")))
    return F.get(F.transform(pair, lambda x: kept(x["lines"], x["runs"])), F.lit(0))


def deduplicated(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``doc_id, n_lines, n_dropped, runs, kept`` of every row of ``docs``: the bitmap and the text that it leaves."""
    found = drop_bitmaps(docs, min_docs, min_chars).select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "n_dropped", "runs")
    rows = identified(docs)
    rows = rows.join(found, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["version"] == F.col("v")), "left")
    n_lines = (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long")
    kept = F.when(F.col("runs").isNull(), F.col("text")).otherwise(without_runs(F.col("text"), F.col("runs")))
    return rows.select("doc_id", n_lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "runs", kept.alias("kept"))
