"""Each corpus operator against a plain version, on small tables with odd rows."""

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlink.llm import bpe, html_text, jaccard, kernel, langid, mixing, pii, pq, quality, simhash, spark_tools, suffix

PLAIN = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it all " * 6, "en", "a"),
    (2, "The Quick brown fox jumps over the lazy dog and runs away from it all " * 6, "en", "a"),
    (3, "the quick brown fox jumps over the lazy dog and runs away from it all " * 5 + "now", "en", "b"),
    (4, None, "en", None),
    (5, "", None, "b"),
    (6, "  \t\n", "de", "c"),
    (7, "one two", "de", "c"),
    (8, "one two", "de", "c"),
    (9, "é🎉 ünï " * 50 + "x" * 3000, "fr", "a"),
    (10, "+1 (523) 555-1055 mail a.b@c.example.com 10.0.0.1 or 4111 1111 1111 1111", "fr", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, a repeated row, null and repeated ids, and a column of a name that operators use inside."""
    rows = [*PLAIN, (10, PLAIN[-1][1], "fr", "d"), (None, "no id at all", "fr", "d"), (7, "another text of id seven", "de", "c")]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit("x"), "n": F.lit(1), "score": F.lit(2), "n_chars": F.length("text").cast("long")}).repartition(3).cache()


@pytest.fixture(scope="module")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


# --- kernel


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n=5):
    w = words_of(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab cD\n\x0bé", max_size=40)), max_size=6))
def test_shingle_sets(texts):
    sets, places = kernel.shingle_sets(pa.array(texts, pa.string()))
    plain = [shingles(t) for t in texts]
    assert np.diff(places).tolist() == list(map(len, plain))
    keys = kernel.set_keys(sets, places)
    for i in range(len(texts)):
        for j in range(i):
            assert (keys[i] == keys[j]) == (plain[i] == plain[j])


# --- 1


def test_simhash_edits(real):
    got = {r["doc_id"]: r for r in simhash.edited_likeness(real).collect()}
    order = sorted(((r["doc_id"], r["text"] or "") for r in real.collect()), reverse=True)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(t)
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.95


def test_simhash_odd_rows(docs, empty):
    out = simhash.edited_likeness(docs).collect()
    assert len(out) == docs.count()
    by_text = {}
    for r in out:
        by_text.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert simhash.edited_likeness(empty).count() == 0
    assert simhash.fingerprinted(docs).columns[-1] == "fingerprint"


def plain_print(text):
    """Each distinct word bigram votes with its weight on every bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    terms = [tuple(words[k : k + 2]) for k in range(max(len(words) - 1, min(len(words), 1)))]
    votes = np.zeros(64)
    for term in set(terms):
        data, offsets = kernel.text_bytes(pa.array([" ".join(term)]))
        starts, ends, by_doc = kernel.words(data, offsets)
        h = int(kernel.ngrams(kernel.spans(kernel.prefix(data), starts, ends), by_doc, 2)[0][0])
        votes += np.array([1 if h >> b & 1 else -1 for b in range(64)]) * (1 + np.log(terms.count(term)))
    return sum(1 << b for b in range(64) if votes[b] > 1e-9), votes


def test_simhash_votes(real):
    texts = [None, "", "one", "two words", "a b a b a b c " * 30, *(r["text"] for r in real.limit(60).collect())]
    for text, got in zip(texts, simhash.fingerprints(pa.array(texts, pa.string())).tolist(), strict=True):
        want, votes = plain_print(text)
        near_ties = sum(1 << b for b in range(64) if abs(votes[b]) < 1e-9)
        assert got & ~near_ties == want & ~near_ties


def test_simhash_long_text():
    text = "many words of a long text " * 200_000
    assert simhash.fingerprints(pa.array([text, text + "x"])).tolist()[0] == simhash.fingerprints(pa.array([text])).tolist()[0]


@pytest.mark.parametrize("hot", [simhash.HOT, 0, 3])
def test_simhash_neighbours(spark, hot):
    rng = np.random.default_rng(1)
    prints = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 60)]
    for p in prints[:20]:
        for k in (1, 3, 4):
            q = p
            for b in rng.choice(64, k, replace=False):
                q ^= 1 << int(b)
            prints.append(q - (1 << 64) if q >= 1 << 63 else q)
    prints += prints[:5]
    table = spark.createDataFrame(list(enumerate(prints)), "id long, fingerprint long")
    prints_only = table.select("fingerprint")
    near = {(r["a"], r["b"]) for r in simhash.near_prints(prints_only, prints_only, 3, hot=hot).collect()}
    assert near == {(a, b) for a in prints for b in prints if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3}
    got = set(map(tuple, simhash.neighbours(table, table, 3).collect()))
    distance = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    assert got == {(i, j, distance(a, b)) for i, a in enumerate(prints) for j, b in enumerate(prints) if i != j and distance(a, b) <= 3}


def test_simhash_counts(real):
    rows = spark_tools.stash(simhash.edited_likeness(real)).select("doc_id", "bits")
    all_rows = rows.collect()
    for r in simhash.counted_neighbours(rows).collect():
        expected = sum(bin((r["bits"] ^ x["bits"]) & ((1 << 64) - 1)).count("1") <= 3 for x in all_rows) - 1
        assert r["n_near"] == (expected if r["doc_id"] % 20 == 0 else None)


# --- 2


def plain_targets(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    left, full, out = float(sum(sizes.values())), set(), {}
    while True:
        w = sum(weight[s] for s in names if s not in full)
        out = {s: most * sizes[s] if s in full else left * weight[s] / w for s in names}
        above = {s for s in names if s not in full and out[s] > most * sizes[s]}
        if not above:
            return out
        full |= above
        left = float(sum(sizes.values())) - sum(most * sizes[s] for s in full)


def test_mixing(docs, empty, real):
    for df in (docs, real):
        out = mixing.mixed(df).collect()
        assert len(out) == df.count()
        sizes, taken, target = {}, {}, {}
        for r in out:
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
            target[r["source"]] = r["target"]
            assert 0 <= r["taken"] <= 3 * r["size"]
        expected = plain_targets(sizes)
        for s in sizes:
            assert target[s] == pytest.approx(expected[s]) and abs(taken[s] - target[s]) <= 1
        assert rows_of(mixing.mixed(df.repartition(2)), "doc_id", "size", "taken") == rows_of(mixing.mixed(df), "doc_id", "size", "taken")
    assert mixing.mixed(empty).count() == 0


def test_mixing_repeats(docs):
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    words = out.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n"))
    once = docs.dropDuplicates(["doc_id", "source", "text"])
    plan = mixing.mixed(once).groupBy("source").agg(F.sum("taken").alias("n"))
    assert rows_of(words.where("n > 0"), "source", "n") == rows_of(plan.where("n > 0"), "source", "n")
    assert out.where("n_chars <> length(text)").count() == 0


# --- 3

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<nav><ul><li><a href=x>menu</a></li></ul></nav><header>site</header><div class="cookie-notice">we use</div>
<div class="ad">buy</div><article><h1>Head &amp; line</h1><p>First   par&auml;graph
with <b>bold</b> text.<p>Second one<br>broken<!-- c --></p><form><label>f</label><input></form><div id="comments"><p>reader</p></div></article>
<aside>side</aside><footer>&copy; foot</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line First paräGRAPH with bold text. Second one broken".replace("GRAPH", "graph")
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == ""
    plain = "<div><div class=menu><a href=x>l1</a></div><p>One long paragraph of text that goes on.</p><p>Two more of them, as long as it is.</p></div>"
    assert html_text.main_text(plain) == "One long paragraph of text that goes on. Two more of them, as long as it is."


LONG = "Words of the text go on and on for quite a while in this line of the page. " * 4


@pytest.mark.parametrize(
    "inner",
    [
        "<article><section><p>{0}</p><p>{0}</p><p>{0}</p><p>{0}</p><p>{0}</p><p>{0}</p></section><section><p>{0}</p></section></article>",
        "<article><h1>Title</h1><div class=body><p>{0}</p><p>{0}</p><p>{0}</p></div><p>The end.</p></article>",
        "<main><article><section><p>{0}</p><p>{0}</p></section><section><h2>More</h2><p>Brief.</p></section></article></main>",
        "<div><div><p>{0}</p><p>{0}</p><p>{0}</p><p>{0}</p><p>{0}</p></div><div><p>{0}</p></div></div>",
        "<p>So.</p><p>{0}</p><p>{0}</p><p><a href=x>A line that is a link as a whole</a></p><p>{0}</p><p>The end.</p>",
    ],
)
def test_main_text_drops_no_line_of_the_text(inner):
    inner = inner.format(LONG)
    menu = "<ul>" + "<li><a href=x>menu</a></li>" * 12 + "</ul>"
    assert html_text.main_text(f"<html><body>{menu}{inner}{menu}</body></html>") == " ".join(re.sub(r"<[^>]*>", " ", inner).split())


def plain_main_text(lines, sigma=html_text.SIGMA):
    """Lines as (text, tags, characters in links): the upper of two clusters of smoothed ratios, by plain loops."""
    ratios = [(len(t) - n) / max(tags, 1) for t, tags, n in lines]
    reach = int(3 * sigma)
    weights = [np.exp(-(d**2) / (2 * sigma**2)) for d in range(-reach, reach + 1)]
    at = lambda k: ratios[min(max(k, 0), len(ratios) - 1)]
    smooth = [sum(w * at(k + d) for w, d in zip(weights, range(-reach, reach + 1), strict=True)) / sum(weights) for k in range(len(ratios))]
    limit = np.mean(smooth)
    for _ in range(50):
        low, high = [x for x in smooth if x < limit], [x for x in smooth if x >= limit]
        if not low or not high:
            return [True] * len(lines)
        new = (np.mean(low) + np.mean(high)) / 2
        if abs(new - limit) < 1e-9:
            break
        limit = new
    limit = limit if np.mean(high) > html_text.APART * np.mean(low) else min(smooth)
    return [x >= limit for x in smooth]


def test_main_text_clusters():
    rng = np.random.default_rng(2)
    for _ in range(50):
        lines = [("x" * int(rng.choice([3, 20, 300])), int(rng.integers(0, 6)), 0, 0, False) for _ in range(int(rng.integers(1, 60)))]
        lines = [(t, tags, int(rng.integers(0, 2)) * len(t), h, p) for t, tags, _, h, p in lines]
        ratios = html_text.smoothed(html_text.ratios_of(lines))
        assert (ratios >= html_text.threshold(ratios)).tolist() == plain_main_text([x[:3] for x in lines])


#: Pages without a name or tag that tells what isn't content: only the ratios can.
BARE = [
    "<body>{menu}<div><h2>Head</h2><p>{0}</p><p>{0}</p><p>{0}</p></div>{menu}</body>",
    "<body><article>{menu}</article><article><p>{0}</p><p>{0}</p><p>Short end.</p></article><article>{menu}</article></body>",
    "<body><table><tr><td>{menu}</td><td><p>{0}</p><p>{0}</p><p>{0}</p></td><td>{menu}</td></tr></table></body>",
]


@pytest.mark.parametrize("page", BARE)
def test_main_text_is_chosen_by_ratios(monkeypatch, page):
    menu = "<div>" + "".join(f"<div><b>go</b> <i>{i}</i> <u>now</u> <a href=x>x</a></div>" for i in range(14)) + "</div>"
    page = page.replace("{0}", LONG).replace("{menu}", menu)
    words = lambda x: " ".join(re.sub(r"<[^>]*>", " ", x).split())
    assert html_text.main_text(page) == words(page.replace(menu, ""))
    # Without ratios the same page gives something else.
    monkeypatch.setattr(html_text, "ratios_of", lambda lines: np.ones(len(lines)))
    assert html_text.main_text(page) != words(page.replace(menu, ""))


MENU = "<ul>" + "<li><a href=x>menu</a></li>" * 9 + "</ul>"
ASIDES = "<div class='newsletter-signup'><p>Subscribe now please to get our letters.</p></div><div class='related-posts'><p><a href=x>Other stories</a></p></div><div class=ad><p>Buy now.</p></div>"


@pytest.mark.parametrize("name", ["long-form", "free-form", "form-factor-guide", "ad-hoc-analysis", "notice-and-comment", "content-has-sidebar", "main-content-with-sidebar", "sidebar-form", "ads", "comments"])
def test_main_text_is_kept_whatever_its_class(name):
    inner = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>Short.</p>"
    want = " ".join(re.sub(r"<[^>]*>", " ", inner).split())
    assert html_text.main_text(f"<body>{MENU}<div class='{name}'>{inner}</div>{ASIDES}</body>") == want
    assert html_text.main_text(f"<body>{MENU}<div class='{name}'><article>{inner}{ASIDES}</article></div>{ASIDES}</body>") == want


def test_main_text_leaves_out_suspects_beside_an_article():
    article = f"<article><h1>Head</h1><p>{LONG}</p></article>"
    want = f"Head {LONG.strip()}"
    for n in (1, 40):  # reader comments may be longer than what they are about
        for comment in ("<p>{0}</p>", "<article><p>{0}</p></article>"):
            assert html_text.main_text(f"<body>{article}<div id=comments>{comment.format(LONG) * n}</div></body>") == want
            assert html_text.main_text(f"<body><main>{article}<div id=comments>{comment.format(LONG) * n}</div></main></body>") == want


def test_main_text_leaves_out_lists_of_links_without_names():
    links = "".join(f"<li><a href=x>Story {k} is to be found here</a>" for k in range(4))
    page = f"<body><article><h1>Head</h1><p>{LONG}</p><div><h3>More</h3><ul>{links}</ul></div><p>{LONG}</p><p>The <a href=x>end</a>.</p></article></body>"
    assert html_text.main_text(page) == f"Head {LONG.strip()} {LONG.strip()} The end."


def test_main_text_takes_bounded_steps():
    import time

    began = time.perf_counter()
    for page in ("<div>" * 50_000 + "deep", "<body><article>" + "<b>" * 20_000 + "x</div>" * 20_000, "<ul>" + "<li>item " * 50_000, "<p>long " * 200_000):
        html_text.main_text(page)
    assert time.perf_counter() - began < 30


def test_main_text_rows(spark, sf):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE), (3, "w", "<p>" * 2000 + "deep")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = html_text.extracted(pages).collect()
    assert len(out) == 5 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert html_text.extracted(pages.limit(0)).count() == 0
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in html_text.extracted(pages).join(pages, "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        import html as lib

        assert r["text"] == " ".join(lib.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


# --- 4

KINDS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_pii(text):
    out = []
    for k, pattern in enumerate(KINDS):
        for m in pattern.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
            if (k != 1 or all(int(p) < 256 for p in m[0].split("."))) and (k != 2 or 12 <= len(d) <= 19 and luhn) and (k != 3 or 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii(spark, docs, empty, real):
    odd = ["a@b.c%x@d.e f@g", "x@y.z@w.v aaa@@b.c 1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1", "é🎉 4111 1111-1111 1111 +1 (523) 555-1055 +12 3", "+1+1 +1 (706) 555-3138 170-", "a." * 2000 + "@x.y", "1" * 5000 + " 12", "4" * 16 + " 4111111111111111"]
    extra = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for df in (extra, docs, real):
        texts = {}
        for r in df.collect():
            texts.setdefault(r["doc_id"], set()).add(plain_pii(r["text"]))
        out = pii.report(df).collect()
        assert len(out) == df.count()
        for r in out:
            sums = {hashlib.sha256(t.encode()).hexdigest(): t for t in texts[r["doc_id"]]}
            assert r["base_sha256"] in sums
            base = sums[r["base_sha256"]]
            assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
            assert r["n_email"] == base.count("email:") and r["n_card"] == base.count("card:")
    assert pii.report(empty).count() == 0


def test_pii_bootstraps(spark):
    ok = lambda i: f"{4111111111110000 + i}"
    good = [x for x in map(ok, range(2000)) if plain_pii(x)][:6]
    rows = [(i, f"please use card number {v} today") for i, v in enumerate(good)]
    rows += [(100, "please use card number 9999-8888-77 today"), (101, "the year of 1999-2000-11 was good"), (102, None)]
    out = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100]["spans"] == "card:23:35" and out[100]["n_card"] == 0
    assert out[101]["spans"] == "" and out[102]["spans"] == ""


def test_pii_finds_what_was_hidden(spark):
    """A third of the numbers and addresses are in forms that no base pattern matches; contexts of the others find them."""
    rng = np.random.default_rng(9)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "lambda", "zeta"]
    rows, hidden = [], set()
    for i in range(300):
        filler = " ".join(rng.choice(words, 8))
        seen = i % 3 > 0
        if i % 2:
            value = f"+49 {digits(3)} {digits(7)}" if seen else f"0{digits(3)} {digits(3)} {digits(4)}"
            text, kind = f"{filler} please ring {value} after noon {filler}", "phone"
        else:
            value = f"u{digits(3)}@host.example.org" if seen else f"u{digits(3)}@intranet"
            text, kind = f"{filler} write to {value} for details {filler}", "email"
        rows.append((i, text))
        if not seen:
            hidden.add((i, f"{kind}:{text.index(value)}:{text.index(value) + len(value)}"))
    rows += [(1000 + i, f"{' '.join(rng.choice(words, 6))} version {digits(4)}-{digits(4)} {' '.join(rng.choice(words, 6))}") for i in range(100)]
    out = pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    base = {(i, s) for i, t in rows for s in filter(None, plain_pii(t).split(","))}
    found = {(r["doc_id"], s) for r in out for s in filter(None, r["spans"].split(","))} - base
    assert len(found & hidden) >= 0.95 * len(hidden)  # recall
    assert len(found & hidden) >= 0.95 * len(found)  # precision


def test_pii_kinds_of_equal_confidence(spark):
    """A pattern that seeds of two kinds support alike gives neither; of two patterns that say different kinds the first kind is taken."""
    card = [x for x in (f"{4111111111110000 + i}" for i in range(400)) if plain_pii(x)][:12]
    rows = [(i, f"the number {v} here") for i, v in enumerate(card[:6])] + [(20 + i, f"the number +1 223 555 {1000 + i} here") for i in range(6)] + [(50, "the number 1234-5678-99 here")]
    out = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[50] == ""
    rows = [(i, f"my card {v} x{i}") for i, v in enumerate(card)] + [(20 + i, f"y{i} +1 223 555 {1000 + i} call me") for i in range(12)] + [(50, "my card 1234-5678-99 call me")]
    out = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[50] == "card:8:20"


def test_pii_contexts_are_whole_words(spark):
    """Words that differ only 60 code points away are different patterns, and a long word is one however long."""
    card = [x for x in (f"{4111111111110000 + i}" for i in range(400)) if plain_pii(x)][:8]
    long, other = "a" + "x" * 3000, "b" + "x" * 3000
    rows = [(i, f"{long} {v}") for i, v in enumerate(card)] + [(50, f"{long} 1234-5678-99"), (51, f"{other} 1234-5678-98"), (52, "y" * 1_000_000 + " 1234-5678-97")]
    out = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[50] == "card:3002:3014" and out[51] == out[52] == ""


def plain_patterns(occurrences, believed):
    """The solution by many rounds from no belief."""
    edges = {}
    for form, words, value, kind in occurrences:
        edges.setdefault((form, words), {}).setdefault(value, set()).add(kind)
    seeds = {}
    for held in edges.values():
        for value, kinds in held.items():
            if kinds - {None}:
                seeds[value] = min(kinds - {None} | {seeds.get(value, 9)})
    names = {(p, k) for p, held in edges.items() for k in range(5) if sum(seeds.get(v) == k for v in held) >= 1}
    score, belief = {}, {}
    for _ in range(400):
        for p, k in names:
            score[p, k] = sum(1.0 if seeds.get(v) == k else 0.0 if v in seeds else belief.get((v, k), 0.0) for v in edges[p]) / len(edges[p])
        belief = {}
        for (p, k), c in score.items():
            for v in (v for v in edges[p] if re.match(pii.FORMS[k], v)):
                belief[v, k] = max(belief.get((v, k), 0.0), pii.PASSED_ON * c)
    return {(*p, k) for (p, k), c in score.items() if c >= believed - 1e-6}


def test_pii_beliefs_settle(spark):
    """Both sides meet in the one solution of the scores, whatever the shares of seeds."""
    rng = np.random.default_rng(3)
    kinds = [(None, 3, 4)[int(k)] for k in rng.choice(3, 150, p=[0.5, 0.3, 0.2])]
    rows = []
    for w in range(40):
        near = rng.permutation(150)
        if w % 2:  # mostly of one kind, or open
            near = [v for v in near if kinds[v] != 4]
        rows += [("two", f"w{w}", f"+{v:03d} 55 66 77", kinds[v]) for v in near[: 3 + w // 3]]
    allowed_ = [k for k, f in enumerate(pii.FORMS) if re.match(f, rows[0][2])]
    assert allowed_ == [3]
    df = spark.createDataFrame(rows, "form string, words string, value string, kind int")
    sizes = []
    for believed in (0.6, 0.8, 0.9):
        out = pii.patterns(df, believed, dict.fromkeys(pii.SUPPORT, 1)).collect()
        got = {(r["form"], r["words"], r["kind"]) for r in out}
        assert got == plain_patterns(rows, believed)
        sizes.append(len(got))
    assert sizes[0] > sizes[1] > sizes[2] > 0


def test_pii_secrets_and_long_texts(spark):
    token = "ab12" * 10
    rows = [(1, f'token = "{token}" and so on'), (2, "1.2.3.4 " * 3000 + "x" * 1_000_000), (3, "no numbers"), (4, None)]
    out = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["spans"] == "secret:9:49" and out[2]["n_ip"] == 3000 and out[3]["spans"] == out[4]["spans"] == ""


def test_pii_many_matches_in_one_text(spark, monkeypatch):
    """More matches than are put together at a time, in blocks of every size."""
    texts = [" ".join(f"é{'x' * (i % 5)} 10.0.{i % 256}.{i % 7} a{i}@b.c +1{i:010d}" for i in range(n)) for n in (1, 2, 3, 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (1, 2, 7, 256):
        monkeypatch.setattr(pii, "MATCHES", most)
        for r in pii.report(df).collect():
            assert r["base_sha256"] == hashlib.sha256(plain_pii(texts[r["doc_id"]]).encode()).hexdigest()
        for r in pii.masked(df).collect():
            expected, at = [], 0
            for kind, a, b in (x.split(":") for x in plain_pii(texts[r["doc_id"]]).split(",")):
                if int(a) >= at:
                    expected.append(texts[r["doc_id"]][at : int(a)] + f"<{kind.upper()}>")
                at = max(at, int(b))
            assert r["text"] == "".join(expected) + texts[r["doc_id"]][at:]
    import time

    began = time.perf_counter()
    long = spark.createDataFrame([(1, "10.0.0.1 x y z w " * 40_000)], "doc_id long, text string")
    assert pii.masked(long).first()["text"] == "<IP> x y z w " * 40_000
    assert time.perf_counter() - began < 120


def test_pii_masks(docs):
    out = pii.masked(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    masked = out.where("doc_id = 10").first()
    assert masked["text"] == "<PHONE> mail <EMAIL> <IP> or <CARD>" and masked["n_chars"] == len(masked["text"])


# --- 5, 9


def test_quality(spark, sf, docs, empty, real):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.classified(real, labels)
    joined = out.join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in joined]) > 0.9
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out.collect())
    assert np.mean([(r["score"] >= 0.7) == r["quality"] for r in joined if r["held_out"]]) > 0.9
    named = docs.withColumns({"held_out": F.lit("h"), "predicted": F.lit("p"), "__p0": F.lit(1), "label": F.lit(9)})
    got = quality.classified(named, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    model = quality.fit(real, labels)
    good = quality.kept(named, model)
    assert good.columns == named.columns and {r["score"] for r in good.collect()} <= {2.0}
    assert good.count() == quality.scored(named, model).where("score >= 0.7").count()
    assert quality.scored(docs.sparkSession.createDataFrame([(1, "long text " * 300_000)], "doc_id long, text string"), model).count() == 1
    assert quality.classified(empty, labels).count() == 0
    none = quality.classified(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_quality_by_plain_updates():
    """Follow-the-regularised-leader by its definition, a coordinate at a time, and the score as a sum over features."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["good", "bad", "fine", "Text", "x1"], int(rng.integers(1, 12)))) for _ in range(30)]
    place, value, at = quality.features(pa.array(texts))
    rows = []
    for k in range(len(texts)):
        x = {}
        for p, v in zip(place[at[k] : at[k + 1]].tolist(), value[at[k] : at[k + 1]].tolist()):
            x[p] = x.get(p, 0.0) + v
        rows.append((x | {1 << quality.BITS: 1.0}, int(rng.integers(0, 2))))
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= quality.L1:
            return 0.0
        return -(zi - np.sign(zi) * quality.L1) / ((quality.BETA + np.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    packed = [(np.array(sorted(x)), np.array([x[i] for i in sorted(x)]), y) for x, y in rows]
    model = quality.ftrl(packed)
    assert np.allclose(model[sorted(z)], [weight(i) for i in sorted(z)], atol=1e-9)


def test_quality_learns_nothing_from_held_out(spark, sf, real):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(real, labels), quality.fit(real, turned))


def test_language(docs, empty, real):
    model = langid.fit(real)
    out = langid.identified(real, model).join(real, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out if r["held_out"]]) > 0.95
    got = langid.identified(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (4, 5, 6)} == {"und"}
    assert langid.identified(empty, langid.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identified(docs, langid.fit(empty)).collect()} == {"und"}


def test_language_keeps_every_gram(spark):
    """A language of many grams doesn't push the grams of a small one out of the models."""
    letters = np.array([chr(i) for i in range(0x4E00, 0x4E00 + 400)] + list("abcdefghijklmnopqrstuvwxyz"))
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(letters, 100_000)), "aa") for i in range(64)] + [(100 + i, "xyzzy plugh " * 3 + "plover", "zz") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    kept = {r[0] for r in docs.where(~quality.held_out(F.col("doc_id"))).select("doc_id").collect()}
    model = langid.fit(docs)
    assert model.langs == ["aa", "zz"]
    for lang in model.langs:
        gram = np.unique(np.concatenate([langid.grams([t])[0] for i, t, x in rows if x == lang and i in kept]))
        for order, part in enumerate(model.models[lang].parts, 1):
            assert np.array_equal(part[0], np.unique(langid.hashes(gram, order)))
    assert len(model.models["aa"].parts[3][0]) > 2_000_000
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identified(docs, model).collect()}
    assert all(out[i] == lang for i, _, lang in rows)


def plain_model(texts):
    """Tables of hashed grams by order from 1, counted by plain loops over characters."""
    letters = characters_of
    four = {}
    for t in texts:
        seq = letters(t)
        for k in range(len(seq)):
            g = tuple(([0] * 4 + seq[: k + 1])[-4:])
            four[g] = four.get(g, 0) + 1
    ends = [{g[3 - k :] for g in four} for k in range(4)]  # distinct 1- to 4-grams
    counts = [{}, {}, {}, four]
    for k in range(3):
        for g in ends[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    return counts


def characters_of(text):
    out = []
    for c in (text or "").lower() + "\n":
        kept = langid.characters()[0][ord(c)]
        if kept or (out and out[-1]):
            out.append(int(kept))
    return out


def hash_of(gram):
    packed = np.array([sum(c << (langid.WIDTH * (len(gram) - 1 - k)) for k, c in enumerate(gram))], np.uint64)
    return int(langid.hashes(packed, len(gram))[0])


def plain_bits(counts, text):
    """Cross-entropy by character of interpolated Kneser-Ney, by its definition."""
    hashed = []
    for table in counts:
        out = {}
        for g, n in table.items():
            out[hash_of(g)] = out.get(hash_of(g), 0) + n
        hashed.append(out)

    def probability(seq, k):
        p = 1 / langid.CLASSES
        for order, table in enumerate(hashed, 1):
            one, two = (sum(n == m for n in table.values()) for m in (1, 2))
            d = one / (one + 2 * two) if one and two else 0.75
            code = hash_of(tuple(([0] * 4 + seq[: k + 1])[-order:]))
            alike = [n for c, n in table.items() if c >> langid.LAST == code >> langid.LAST]
            if alike:
                p = max(table.get(code, 0) - d, 0) / sum(alike) + d * len(alike) / sum(alike) * p
        return p

    seq = characters_of(text)
    return -np.mean([np.log2(probability(seq, k)) for k in range(len(seq))])


def test_language_by_plain_entropy(spark):
    texts = {"aa": ["abracadabra and a banana band", "cab, 12 bands!"], "bb": ["été à la plage", "où est-il allé ?"], "cc": ["привет как дела", "дела идут"]}
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = {r["doc_id"] for r in docs.where(~langid.held_out(F.col("doc_id"))).collect()}
    model = langid.fit(docs)
    asked = ["a banana", "la plage", "как идут", "zzz 𝒜", "x"]
    bits, n = next(model.entropies([asked]))
    for j, lang in enumerate(model.langs):
        counts = plain_model([t for i, t, x in rows if x == lang and i in learnt])
        assert bits[:, j] == pytest.approx([plain_bits(counts, t) for t in asked])
    assert n.tolist() == [len(characters_of(t)) for t in asked]


def test_language_marks_alone(spark):
    """A text of marks without a letter has no language, beside texts of letters and marks."""
    texts = ["\u0301\u0302 \u0301", "e\u0301te\u0301", "12 \u0301", "", None, "\u0e31", "e\u0301"]
    assert np.diff(langid.grams(texts)[1]).tolist() == [0, 6, 0, 0, 0, 0, 3]
    docs = spark.createDataFrame([(k, t, "fr") for k, t in enumerate(texts * 2)], "doc_id long, text string, lang string")
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identified(docs, langid.fit(docs)).collect()}
    assert {k for k, x in out.items() if x == ("und", 0.0)} == {0, 2, 3, 4, 5, 7, 9, 10, 11, 12}
    assert all(out[k][0] == "fr" for k in (1, 6, 8, 13))


def test_language_models_in_turn(spark, real, monkeypatch):
    """A process that holds one language at a time gives what it gives with all; of equal languages the first by name wins."""
    model = langid.fit(real)
    texts = [[r["text"] for r in real.select("text").limit(n).collect()] for n in (7, 1, 20)]
    whole = [(b.copy(), n) for b, n in model.entropies(texts)]
    assert len(model.langs) > 2 and set(spark_tools.kept(model.models.owner)) == set(model.langs)
    monkeypatch.setattr(langid, "HELD", 1)
    for (bits, n), (b, m) in zip(whole, model.entropies(texts), strict=True):
        assert np.array_equal(bits, b) and np.array_equal(n, m)
    assert set(spark_tools.kept(model.models.owner)) == {model.langs[-1]}
    assert not any("_value" in vars(p) for p in model.models.parts.values())
    two = spark.createDataFrame([(i, "same words here", lang) for i in range(12) for lang in ("yy", "xx")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identified(two, langid.fit(two)).collect()} == {"xx"}


def test_vectors_asked_lists():
    """Whether a member asks a query's list is what its row says, however close the border."""
    book = pq.Codebook(np.random.default_rng(2).normal(size=(200, 6)), 0, 0)
    unit = np.ones(6).tobytes()
    code = bytes(len(book.words))
    rows = [(bytes([k]), unit, code, 0.0, 1, np.array(asked, "<i4").tobytes()) for k, asked in enumerate([[0, 3], [3], [], [1, 2, 3]])]
    block = pq.Block(book, 3, rows)
    own = np.array([0, 2])
    q, m = (x.ravel() for x in np.meshgrid([0, 1], [0, 1, 2, 3], indexing="ij"))
    alone = {(int(q[i]), int(m[i])) for i in block.one_sided(own, q, m)}
    assert alone == {(0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2)}


def test_language_rejects(spark, real):
    model = langid.fit(real)
    odd = spark.createDataFrame([(1, "ξένος κόσμος χωρίς γλώσσα " * 9), (2, "qqqq zzzz xxxx jjjj " * 20), (3, "1234"), (4, "word " * 300_000)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in langid.identified(odd, model).collect()}
    assert out[1]["rejected"] and out[2]["rejected"] and not out[3]["rejected"]
    assert np.mean([r["rejected"] for r in langid.identified(real, model).collect()]) < 0.05


def test_language_tells_alphabets_apart(spark):
    """Languages of one alphabet beyond a-z, held out."""
    words = {"ru": "это очень хорошая книга которую я читал вчера вечером дома", "uk": "це дуже гарна книга яку я читав учора ввечері вдома", "el": "αυτό είναι ένα πολύ καλό βιβλίο που διάβασα χθες το βράδυ"}
    rng = np.random.default_rng(1)
    rows = [(len(words) * k + j, " ".join(rng.choice(words[w].split(), 8)), w) for k in range(40) for j, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identified(docs, langid.fit(docs)).join(docs, "doc_id").where("held_out").collect()
    assert out and all(r["lang_pred"] == r["lang"] for r in out)


def test_kneser_ney_sums_to_one():
    texts = ["abracadabra and a banana band", "cab"]
    tables = []
    for table in plain_model(texts):
        out = {}
        for g, n in table.items():
            out[hash_of(g)] = out.get(hash_of(g), 0) + n
        tables.append((np.array(list(out)), np.array(list(out.values()))))
    model = langid.KneserNey(tables)
    for context in ((0, 0, 0), (97, 98, 114), (1, 2, 3), (97, 110, 97)):
        codes = []
        for order in range(1, 5):
            before = hash_of((*context, 97)[-order:]) >> langid.LAST
            codes.append(((before << langid.LAST) | np.arange(langid.CLASSES)).astype(np.uint32))
        assert (2.0 ** model.log2(codes)).sum() == pytest.approx(1.0)


# --- 6


def plain_components(rows, num=80, den=100):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)), key=repr)


def near_copies(seed=1, groups=12):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    passage = list(rng.choice(vocabulary, 30))
    rows = []
    for _ in range(groups):
        base = list(rng.choice(vocabulary, int(rng.integers(4, 60)))) + passage * int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 9))):
            text = list(base)
            for _ in range(int(rng.integers(0, 4))):
                text[int(rng.integers(0, len(text)))] = "edit" + str(rng.integers(0, 5))
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("block", [2000, 3])
def test_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies() + [(1000 + i, t) for i, (_, t, *_) in enumerate(PLAIN)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = spark_tools.stash(df)
    assert rows_of(jaccard.jaccard_components(df), "doc_id", "n_shingles", "component_id") == plain_components(rows)


def test_jaccard_odd_rows(docs, empty, real):
    got = rows_of(jaccard.jaccard_components(spark_tools.stash(docs)), "doc_id", "n_shingles", "component_id")
    assert got == plain_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert jaccard.jaccard_components(empty).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in real.collect()]
    assert rows_of(jaccard.jaccard_components(real), "doc_id", "n_shingles", "component_id") == plain_components(rows)


def test_keep_one_with_null_and_repeated_ids(spark):
    """Of each component one row stays, whatever its id; rows that link with nothing all stay."""
    text = lambda k, more="": " ".join(f"w{k}x{i}" for i in range(40)) + more
    groups = [
        [(None, text(0), "a")],
        [(None, text(1), "a")],
        [(5, text(2), "a")],
        [(5, text(3), "a"), (3, text(3), "b")],
        [(5, text(4), "c"), (7, text(4, " more"), "c")],
        [(None, text(5), "a"), (None, text(5), "a"), (9, text(5, " end"), "z")],
        [(None, text(6), "a"), (None, text(6, " end"), "b")],
        [(8, text(7), "a"), (8, text(7), "b"), (8, text(7), "b")],
        *([(i, t, "a")] for i, t in [(None, None), (None, None), (None, " "), (5, ""), (1, None)]),
    ]
    rows = [r for g in groups for r in g]
    got = []
    for parts in (1, 3):
        df = spark_tools.stash(spark.createDataFrame(rows[::-1] if parts == 3 else rows, "doc_id long, text string, source string").repartition(parts))
        got.append(rows_of(jaccard.keep_one(df), "doc_id", "text", "source"))
    assert got[0] == got[1] and len(got[0]) == len(groups)
    for g in groups:
        best = min((r[0] for r in g), key=lambda d: (d is None, d or 0))
        assert any(r in got[0] for r in g if r[0] == best)
    assert got[0].count((None, None, "a")) == 2


def test_prefix_tree_finds_all_links():
    rng = np.random.default_rng(5)
    sets = [sorted(set(rng.integers(0, 60, rng.integers(1, 60)).tolist())) for _ in range(60)]
    sets += [sorted(set(s) ^ {int(rng.integers(0, 60))}) or [1] for s in sets]
    tree = jaccard.PrefixTree()
    for i, s in enumerate(sets):
        tree.add(s, i)
    parent = jaccard.PrefixTree()
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(set(a) & set(sets[j])) >= 80 * len(set(a) | set(sets[j])):
                parent.join(i, j)
    assert [tree.find(i) for i in range(len(sets))] == [parent.find(i) for i in range(len(sets))]


# --- 7


def plain_removed(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - suffix.LENGTH + 1):
            w = raw[s : s + suffix.LENGTH]
            if w in seen:
                gone[s : s + suffix.LENGTH] = True
            seen.add(w)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((i, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("hot,stretch", [(suffix.HOT, suffix.STRETCH), (1, 1), (2, 300)])
def test_suffix(spark, real, hot, stretch):
    line = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(400))
    rows = [(1, "ab" * 500), (2, "x" * 1000), (3, None), (4, ""), (5, "x" * 99), (6, "x" * 100), (7, "And " * 300 + "é" * 200), (8, "q" + "ab" * 200 + "é" * 150), (9, line), (10, "zz" + line[50:350] + "yy"), (11, line[60:200] + "\0" * 150), (12, "\0" * 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(suffix.deduplicated(df, texts=False, hot=hot, stretch=stretch), *COLUMNS) == plain_removed(rows)
    sample = [(r["doc_id"], r["text"]) for r in real.collect()]
    assert rows_of(suffix.deduplicated(real, texts=False, hot=hot, stretch=stretch), *COLUMNS) == plain_removed(sample)


@pytest.mark.parametrize("starts", [1, 7, 100, 1000])
def test_anchors_of_any_stretch(starts):
    """Anchors don't depend on how many windows are looked at together."""
    rng = np.random.default_rng(2)
    texts = [b"", b"x" * 99, b"x" * 500, bytes(rng.integers(97, 100, 700).astype(np.uint8)), b"", bytes(rng.integers(0, 255, 1300).astype(np.uint8)), b"ab" * 200]
    data, offsets = kernel.text_bytes(pa.array(texts, pa.binary()))
    whole = suffix.anchors(data, offsets, len(data))
    for a, b in zip(suffix.anchors(data, offsets, starts), whole, strict=True):
        assert a.tolist() == b.tolist()
    text, place, first, last, _ = whole
    windows = [(i, s) for i, t in enumerate(texts) for s in range(offsets[i], offsets[i] + len(t) - suffix.LENGTH + 1)]
    assert windows == [(i, s) for i, a, b in zip(text, first, last, strict=True) for s in range(a, b + 1)]
    assert ((first <= place) & (place <= first + suffix.REACH) & (last <= place)).all()
    with_none = suffix.anchors(data[:50], np.array([0, 50]), starts)
    assert all(len(x) == 0 for x in with_none[:4])


def test_suffix_splits_a_common_border(spark):
    """One passage in many different surroundings is split by further bytes, down to single windows."""
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage = word(260)
    rows = [(i, word(150) + passage[int(rng.integers(0, 2)) * 30 :] + word(120)) for i in range(40)]
    rows += [(100, passage), (101, passage + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot in (3, 12):
        assert rows_of(suffix.deduplicated(df, texts=False, hot=hot, stretch=50), *COLUMNS) == plain_removed(rows)


def test_suffix_moves_texts_once_for_all_anchors(spark, monkeypatch):
    """Pieces in many surroundings don't make the texts travel again."""
    rng = np.random.default_rng(7)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage, other = word(200), word(130)
    rows = [(i, word(60) + passage + word(70)) for i in range(20)] + [(30, word(9) + other), (31, other + word(9))]
    calls, asked = [], suffix._asked
    monkeypatch.setattr(suffix, "_asked", lambda *a: calls.append(a) or asked(*a))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(suffix.deduplicated(df, texts=False, hot=5), *COLUMNS) == plain_removed(rows)
    assert len(calls) == 1


def test_suffix_odd_rows(docs, empty):
    out = suffix.deduplicated(docs).collect()
    assert len(out) == docs.count() and suffix.deduplicated(empty).count() == 0
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=40, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=30), st.integers(0, 32))
def test_deep_shallow_sorts(strings, shared):
    strings = [strings[0][:shared] + s[shared:] for s in strings]
    rows = np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), 40)
    order = suffix.deep_shallow(rows)
    assert [strings[i] for i in order] == sorted(strings) and sorted(order.tolist()) == list(range(len(strings)))


# --- 8


@pytest.mark.parametrize("slack", [1.0, 0.5, 0.2])
def test_vectors(spark, monkeypatch, slack):
    monkeypatch.setattr(pq, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = []
    for k in range(400):
        v = base[rng.integers(0, 60)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.3])
        rows.append((k, [float(np.float32(x)) for x in v * rng.choice([1, 3])], int(rng.integers(0, 3))))
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, rows[0][1], None), (1004, [1.0, 2.0], 1), (1005, [1.0, None] * 8, 1), (1006, rows[0][1], rows[0][2]), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit(0))
    got = {r["vec_id"]: r for r in pq.near_links(df, slack=slack).collect()}
    usable = [(i, np.array(v, float), c) for i, v, c in rows if i not in (1000, 1001, 1002, 1003, 1004, 1005)]
    n, links = len(usable), np.zeros(len(usable), int)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            x, y = usable[a][1], usable[b][1]
            if usable[a][2] == usable[b][2] and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(usable):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    found = sum(got[u[0]]["n_links"] for u in usable)
    assert found >= 0.9 * links.sum() and all(got[u[0]]["n_links"] <= links[k] for k, u in enumerate(usable))
    for k, (i, _, _) in enumerate(usable):
        if got[i]["n_links"] == links[k] == 0:
            assert got[i]["component_id"] == i and got[i]["kept"]
    if slack >= 0.5:
        assert found == links.sum()
        assert all(got[u[0]]["component_id"] == least[find(k)] for k, u in enumerate(usable))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(1000, 1006))
    assert pq.near_links(df.limit(0)).count() == 0


# --- 10


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    rows = []
    for dim, groups in ((8, 12), (5, 6), (3, 1)):
        for _ in range(groups):
            base = rng.normal(size=dim)
            rows += [(len(rows) + k, (base + k * 1e-3).tolist(), 1) for k in range(2)]
    got = {r["vec_id"]: r for r in pq.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long"), slack=1.0).collect()}
    for i, v, _ in rows:
        n = sum(j != i and len(w) == len(v) and np.dot(v, w) >= 0.98 * np.linalg.norm(v) * np.linalg.norm(w) for j, w, _ in rows)
        assert n and got[i]["n_links"] == n


def test_bpe(docs, empty, real):
    import public_tokenizers as tok
    import tiktoken

    path = tok.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, real):
        texts = {}
        for r in df.collect():
            texts.setdefault(r["doc_id"], []).append(plain.encode_ordinary(r["text"] or ""))
        out = bpe.encoded(df, path, tok.PATTERN).collect()
        assert len(out) == df.count()
        for r in out:
            assert r["ids"] in texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
            assert bytes(r["decoded"]) == plain.decode_bytes(r["ids"])
    assert bpe.encoded(empty, path, tok.PATTERN).count() == 0
    # Long words, on both sides of the bound; texts of a megabyte.
    rng = np.random.default_rng(8)
    runs = ["".join(rng.choice(list(letters), n)) for letters in ("acgt", "abcdefghijklmnop", "äöжд漢", "=") for n in (bpe.LONG - 1, bpe.LONG, 3000)]
    own = bpe.Encoder(path, tok.PATTERN)
    for text in [*runs, "word next " * 100_000, "\n" * 100_000]:
        ids, n, back = own.encode([text])[0]
        assert list(map(int, ids.split())) == plain.encode_ordinary(text) and n == len(ids.split()) and back == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=127), st.sampled_from("'sdl \n\x1c\x85é")), max_size=40))
def test_bpe_splits(text):
    import public_tokenizers as tok
    import regex

    assert bpe.splitter(tok.PATTERN)(text) == regex.findall(tok.PATTERN, text)


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=30))
def test_bpe_heap_takes_the_leftmost_least_pair(text):
    ranks = {t: k for k, t in enumerate([b"a", b"b", b"ba", b"bab", b"aa", b"ab", b"aab", b"baa", b"aba", b"aabb"])}
    tokens = [bytes([x]) for x in text.encode()]
    while pairs := [(ranks[a + b], k) for k, (a, b) in enumerate(zip(tokens, tokens[1:])) if a + b in ranks]:
        k = min(pairs)[1]
        tokens[k : k + 2] = [tokens[k] + tokens[k + 1]]
    assert bpe.contracted(text.encode(), ranks) == tokens


# --- shared


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(i, i + 1) for i in range(200, 260)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, spark_tools.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_blocks_by_counts_connect_what_prefix_trees_connect():
    rng = np.random.default_rng(11)
    for case in range(12):
        base = [rng.integers(0, 1 << 63, int(rng.integers(20, 90)), np.uint64) for _ in range(4)]
        sets = []
        for _ in range(90):
            own = base[int(rng.integers(0, 4))]
            kept = own[rng.random(len(own)) > (0.02, 0.08, 0.2)[case % 3]]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, int(rng.integers(1, 9)), np.uint64)])))
        labels = [f"{int(rng.integers(0, 30)) if case % 2 else k}".encode() for k in range(len(sets))]
        links = jaccard.block_links(sets, labels)
        tree, other = jaccard.PrefixTree(), jaccard.PrefixTree()
        for a, b in links:
            assert other.join(a, b)
        for s, x in zip(sets, labels, strict=True):
            tree.add(s.tolist(), x)
        group = lambda t: {x: min(y for y in labels if t.find(y) == t.find(x)) for x in labels}  # noqa: E731, B023
        assert group(tree) == group(other)


def test_blocks_of_unlinked_sets_take_no_pairwise_walk():
    import time

    rng = np.random.default_rng(12)
    common = rng.integers(0, 1 << 63, 300, np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(common)[:210], rng.integers(0, 1 << 63, 90, np.uint64)])) for _ in range(500)]
    began = time.perf_counter()
    assert jaccard.block_links(sets, [k.to_bytes(4, "big") for k in range(500)]) == []
    by_counts, began = time.perf_counter() - began, time.perf_counter()
    tree = jaccard.PrefixTree()
    assert not any(tree.add(s.tolist(), k) for k, s in enumerate(sets))
    assert by_counts < (time.perf_counter() - began) / 3
