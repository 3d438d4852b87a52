"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Base entities (email, ip, card, phone) are matched by fixed patterns. They and long
mixed tokens (``secret``: 32 or more letters and digits, both of them) seed a graph between
*patterns* and *instances*. Instances are identifier-like strings: addresses with an at
sign, groups of digits joined by single marks or spaces (7 digits at least), tokens of
8 or more characters with 4 digits. The patterns of an occurrence are its words in small letters,
digits as 0: the two words before with the marks between, the one before, the one after, and
those two together, so that what a longer pattern saw too rarely a shorter one can carry.

A pattern's confidence for a kind is the mean belief in its distinct instances as such; seeds
of another kind count as 0. The belief in an instance that is no seed is ``PASSED_ON`` times the
confidence of its best pattern, for the kinds that its form allows. As less than all is passed on,
there is one solution: scores iterated from no belief rise to it, those from full belief fall to
it, and each round takes the same share off the distance at least. Rounds end when both sides agree
which patterns have high confidence; those, where enough different seeds support
them, give the identifiers that the base patterns miss.

Everything is a DataFrame expression; no row leaves the JVM. Null texts count as
empty. Rows that are equal in ``doc_id`` and ``text`` get equal results. Offsets
are code points, ends exclusive. Contexts are whole words, however long. Of kinds of equal
confidence (from below) the first as listed is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_tools import free, stash

KINDS = ("email", "ip", "card", "phone")
#: The same matches as the plain patterns, written so that no run of characters is
#: tried from each of its places and no repetition can be undone where that is of no use.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Addresses, digits in groups, and single tokens with a digit; no run is tried from each of its places.
CANDIDATE = (
    r"(?<![A-Za-z0-9._%@+-])(?:[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++"
    r"|[+(]{0,2}+[0-9]++(?:[)]?+[\x20./-]?+[(]?+[0-9]++)++(?![A-Za-z0-9_@])"
    r"|(?=[A-Za-z._+-]*+[0-9])[A-Za-z0-9._+-]++)"
)
#: Kinds of discovered spans, and the forms that they may have.
NAMES = (*KINDS, "secret")
FORMS = (r"^[^@]+@[^@]+$", r"^[0-9]+(?:[.:][0-9]+){2,}$", r"^[0-9][0-9\x20-]*$", r"^[+(]*[0-9][0-9\x20()./-]*$", r"^(?=.*[A-Za-z])[A-Za-z0-9_.+-]+$")
SECRET = r"^(?=[A-Za-z_+-]*[0-9])(?=[0-9_+-]*[A-Za-z])[A-Za-z0-9_+-]{32,}$"

MATCHES = 256  #: matches of a text that are put together at a time
LONG_CONTEXT = 128  #: code points from which a hash stands for the words of a pattern
PASSED_ON = 0.85  #: share of a pattern's confidence that its instances pass on
CLOSE = 1e-6  #: distance of the two sides from which scores count as settled
BELIEVED = 0.8  #: a pattern's least confidence
SUPPORT = {"two": 3, "around": 3, "before": 5, "after": 5}  #: different seeds that a pattern needs


def found(text: Column, pattern: str, context: bool = False) -> Column:
    """All matches as ``array<struct<start, end, value[, before, after]>>``, in order.

    The pieces between the matches and the matches themselves give the offsets.
    ``before`` (reversed) and ``after``: the nearest words of the pieces next to the match,
    up to two spaces away.
    """
    pieces = F.split(text, pattern, -1)
    zipped = [pieces.alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value")]
    if context:
        zipped.append(F.transform(F.slice(pieces, 2, F.size(pieces)), nearest).alias("after"))
    extra = ", before string, after string" if context else ""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<start int, end int, value string{extra}>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(x["piece"])
        last = first + F.coalesce(F.length(x["value"]), F.lit(0))
        fields = [first.alias("start"), last.alias("end"), x["value"].alias("value")]
        if context:
            fields += [nearest(F.reverse(x["piece"])).alias("before"), x["after"].alias("after")]
        return F.struct(last.alias("at"), F.when(x["value"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.struct(*fields)))).alias("spans"))

    def shifted(s: Column, by: Column) -> Column:
        names = ["value", "before", "after"] if context else ["value"]
        return F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), *(s[n].alias(n) for n in names))

    def counted(z: Column) -> Column:
        """Offsets within blocks of matches, then of the blocks, as an array grows by copies."""
        blocks = F.transform(block_starts(F.size(z)), lambda k: F.aggregate(F.slice(z, k, F.lit(MATCHES)), start, step))
        none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<struct<start int, end int, value string{extra}>>>").alias("spans"))
        more = lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["spans"], F.array(F.transform(x["spans"], lambda s: shifted(s, acc["at"])))).alias("spans"))
        return F.flatten(F.aggregate(blocks, none, more, lambda acc: acc["spans"]))

    return F.when(F.rlike(text, F.lit(pattern)), bound(F.arrays_zip(*zipped), counted)).otherwise(start["spans"])


def nearest(text: Column) -> Column:
    """The first words of a text: what stands before the third of its spaces."""
    return F.regexp_extract(text, r"^\S*+(?:\s++\S++){0,2}+", 0)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def block_starts(size: Column) -> Column:
    """The places from 1 at which blocks of ``MATCHES`` of an array that isn't empty begin."""
    return F.sequence(F.lit(1), size, F.lit(MATCHES))


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """The base entities as ``array<struct<start, kind, end, value>>``; kind counts ``KINDS`` from 0."""

    def digits(s: Column) -> Column:
        return F.length(F.regexp_replace(s["value"], "[^0-9]", ""))

    has_digit = text.rlike("[0-9]")
    empty = F.array().cast("array<struct<start int, end int, value string>>")
    kinds = [
        F.when(text.contains("@"), found(text, EMAIL)).otherwise(empty),
        F.when(has_digit, F.filter(found(text, IP), lambda s: s["value"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))).otherwise(empty),
        F.when(has_digit, F.filter(found(text, CARD), lambda s: digits(s).between(12, 19) & luhn(s["value"]))).otherwise(empty),
        F.when(text.contains("+"), F.filter(found(text, PHONE), lambda s: digits(s).between(9, 15))).otherwise(empty),
    ]

    def marked(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    return F.array_sort(F.concat(*(marked(spans, k) for k, spans in enumerate(kinds))))


CANDIDATES = "array<struct<start int, end int, value string, kind int, patterns array<struct<form string, words string>>>>"


def candidates(text: Column, base: Column) -> Column:
    """Identifier-like strings with their patterns; ``kind`` is that of a base entity they overlap, or secret, else null."""

    def likely(c: Column) -> Column:
        digits = F.length(F.regexp_replace(c["value"], "[^0-9]", ""))
        grouped = c["value"].rlike(r"^[0-9\x20()./+-]+$")
        return c["value"].contains("@") | F.when(grouped, digits >= 7).otherwise((F.length(c["value"]) >= 8) & (digits >= 4))

    def patterns_of(c: Column) -> Column:
        plain = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]+", "0"), r"\s+", " ")
        two = plain(F.reverse(F.regexp_extract(c["before"], r"^\S*+(?:\s++\S++){2}", 0)))
        one = plain(F.reverse(F.regexp_extract(c["before"], r"^\S*+(?:\s++\S++)?+", 0)))
        after = plain(F.regexp_extract(c["after"], r"^\S*+(?:\s++\S++)?+", 0))
        both = F.when(one.rlike(r"\p{L}") & after.rlike(r"\p{L}"), F.concat_ws(" _ ", one, after)).otherwise("")
        named = F.array(*(F.struct(F.lit(k).alias("form"), v.alias("words")) for k, v in (("two", two), ("before", one), ("after", after), ("around", both))))
        worded = F.filter(named, lambda x: x["words"].rlike(r"\p{L}"))
        short = lambda words: F.when(F.length(words) < LONG_CONTEXT, words).otherwise(F.concat(F.lit("sha256 "), F.sha2(words, 256)))
        return F.transform(worded, lambda x: F.struct(x["form"].alias("form"), short(x["words"]).alias("words")))

    def kind(c: Column) -> Column:
        of_base = F.get(F.filter(base, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])), F.lit(0))["kind"]
        return F.coalesce(F.when(F.size(base) > 0, of_base), F.when(c["value"].rlike(SECRET), len(KINDS)))

    near = F.filter(found(text, CANDIDATE, context=True), likely)
    out = F.transform(near, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), kind(c).alias("kind"), patterns_of(c).alias("patterns")))
    return F.when(text.rlike("[0-9@]"), out).otherwise(F.array().cast(CANDIDATES))


def allowed(value: Column) -> Column:
    """The kinds that a string's form allows."""
    return F.filter(F.array(*(F.when(value.rlike(f), F.lit(k)) for k, f in enumerate(FORMS))), lambda k: k.isNotNull())


def patterns(occurrences: DataFrame, believed: float = BELIEVED, support: dict[str, int] | None = None) -> DataFrame:
    """``form, words, kind, confidence`` of high confidence, from ``occurrences(form, words, value, kind)``; ``kind`` marks the seeds."""
    least = F.create_map(*(F.lit(x) for item in (support or SUPPORT).items() for x in item))
    edges = stash(occurrences.groupBy("form", "words", "value").agg(F.min("kind").alias("seed")))
    values = edges.groupBy("value").agg(F.min("seed").alias("seed"))
    seeds = values.where("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("belief"))
    open_ = stash(values.where("seed is null").select("value", F.explode(allowed(F.col("value"))).alias("kind")))
    sizes = edges.groupBy("form", "words").agg(F.count("*").alias("n"))
    # Only patterns with enough seeds of a kind can come to be believed in.
    held = edges.join(seeds.drop("belief"), "value").groupBy("form", "words", "kind").agg(F.count("*").alias("sure"))
    held = stash(held.where(F.col("sure") >= least[F.col("form")]).join(sizes, ["form", "words"]))
    reached = stash(edges.where("seed is null").select("form", "words", "value").join(held.select("form", "words", "kind", "sure", "n"), ["form", "words"]).join(open_, ["value", "kind"]))
    sides = {"low": 0.0, "high": 1.0}
    belief = open_.select("value", "kind", *(F.lit(v).alias(side) for side, v in sides.items()))
    while True:
        more = reached.join(belief, ["value", "kind"]).groupBy("form", "words", "kind").agg(*(F.sum(side).alias(side) for side in sides))
        scored = held.join(more, ["form", "words", "kind"], "left")
        scored = stash(scored.select("form", "words", "kind", *(((F.col("sure") + F.coalesce(side, F.lit(0.0))) / F.col("n")).alias(side) for side in sides)))
        if scored.where((F.col("low") < believed) & (F.col("high") >= believed) & (F.col("high") - F.col("low") > CLOSE)).isEmpty():
            return scored.where(F.col("low") >= believed - CLOSE).select("form", "words", "kind", F.col("low").alias("confidence"))
        belief = reached.select("form", "words", "value", "kind").join(scored, ["form", "words", "kind"]).groupBy("value", "kind")
        belief = belief.agg(*((PASSED_ON * F.max(side)).alias(side) for side in sides))


def spotted(docs: DataFrame) -> DataFrame:
    """``doc_id, h, base, spans`` of every row of ``docs(doc_id, text)``.

    ``h`` hashes the text; ``base`` and ``spans`` are ``array<struct<start, kind, end>>``
    by start and kind, ``spans`` with the discovered identifiers.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), "text", base_spans(F.col("text")).alias("base"))
    # One projection above the other would evaluate the spans once for each use.
    rows = rows.select("doc_id", "h", "base", candidates(F.col("text"), F.col("base")).alias("near"))
    rows = rows.select("doc_id", "h", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base"), "near")
    rows = stash(rows)
    seen = rows.select("doc_id", "h", F.explode("near").alias("c")).select("doc_id", "h", "c.*")
    occurrences = seen.select("start", "end", "doc_id", "h", "value", "kind", F.explode("patterns").alias("p")).select("doc_id", "h", "start", "end", "value", "kind", "p.*")
    good = stash(patterns(occurrences.select("form", "words", "value", "kind"))).withColumnRenamed("kind", "named")
    by_pattern = occurrences.where("kind is null").join(good, ["form", "words"]).where(F.array_contains(allowed(F.col("value")), F.col("named")))
    by_form = seen.where(F.col("kind") == len(KINDS)).select("doc_id", "h", "start", "end", F.col("kind").alias("named"), F.lit(1.0).alias("confidence"))
    new = by_pattern.select("doc_id", "h", "start", "end", "named", "confidence").unionByName(by_form)
    # Of an occurrence, the kind of its best pattern.
    new = new.groupBy("doc_id", "h", "start", "end").agg(F.max(F.struct("confidence", (-F.col("named")).alias("no"))).alias("best"))
    new = new.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", (-F.col("best.no")).alias("kind"), "end")).alias("new"))
    new = new.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "new")
    joined = rows.join(new, rows["doc_id"].eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), "left")
    spans = F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "new")))
    return joined.select("doc_id", "h", "base", spans.alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base entities, the digest of their spans, and all spans."""
    rows = spotted(docs)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(len(KINDS))]
    return rows.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans by the first's.

    ``n_chars``, where that column exists, follows the text. Null texts stay null;
    other columns stay as they are, whatever their names.
    """
    columns, own = docs.columns, free(docs.columns)
    plan = spotted(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias(own("id")), F.col("h").alias(own("h")), F.col("spans").alias(own("spans"))).distinct()
    rows = docs.withColumn(own("t"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = rows.join(plan, rows["doc_id"].eqNullSafe(F.col(own("id"))) & (F.col(own("t")) == F.col(own("h"))), "left")
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in NAMES))
    text = F.col("text")

    def masked_in(chunk: Column, base: Column):
        """Of a chunk of the text that begins at ``base``: the pieces between its spans and their names."""

        def step(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            piece = F.concat(F.substring(chunk, acc["at"] - base + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

        return step

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def block(acc: Column, k: Column) -> Column:
        """A block of spans, over the part of the text that it needs: to find a place takes steps in proportion to it."""
        some = F.slice(own("spans"), k, F.lit(MATCHES))
        last = F.array_max(F.transform(some, lambda s: s["end"]))
        from_ = F.struct(acc["at"].alias("at"), start["out"].alias("out"))

        def use(chunk: Column) -> Column:
            done = F.aggregate(some, from_, masked_in(chunk, acc["at"]), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(x["out"], ""))).alias("out")))
            return done

        return bound(F.substring(text, acc["at"] + 1, F.greatest(last - acc["at"], F.lit(0))), use)

    new = F.aggregate(block_starts(F.size(own("spans"))), start, block, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    rows = rows.withColumn(own("new"), F.when(F.col(own("spans")).isNull(), text).otherwise(new))
    out = {"text": F.col(own("new"))}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.col(own("spans")).isNull(), F.col("n_chars")).otherwise(F.length(own("new"))).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(out[c].alias(c) if c in out else F.col(c) for c in columns))
