"""Text and address functions: known pairs, and columns against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import plain, text as X, urls as U
from waymark.operators import proposals as P
from waymark.plans import queries as Q

STEMS = [("integrations", "integration"), ("guides", "guide"), ("boxes", "box"), ("churches", "church"), ("policies", "policy"), ("cities", "city"), ("abilities", "ability"), ("class", "class"), ("running", "runn"), ("red", "red"), ("used", "used"), ("linked", "link"), ("ties", "tie"), ("pricing", "pric"), ("bus", "bus"), ("buses", "bus")]


@pytest.mark.parametrize("word,want", STEMS)
def test_stem(word, want):
    assert plain.stem(word) == want


SAMPLES = ["", " ", "Pricing – Acme", "Docs | Acme Inc | Guide", "The API and the faq: getting started.", "One. Two! three? Four (five) \"Six\" 3.5 e.g. no.", "getting-started_sdks.html", "A B c", "It’s ‘quoted’", "Explore Our Services Pages", "of the and", "Élan vital ß", "x - y - zz", "API FAQ of US", "Menu"]


def test_columns_equal_plain_python(spark):
    rng = random.Random(4)
    texts = SAMPLES + ["".join(rng.choice("aB sing.ed-_|–'! é ") for _ in range(rng.randrange(40))) for _ in range(150)]
    pairs = [(i, t, rng.choice(texts)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(pairs, "i int, a string, b string")
    rows = df.select(
        "i", "a", "b",
        X.tokenize("a").alias("tokens"), X.content_tokens("a").alias("content"), X.similarity("a", "b").alias("sim"), X.coverage("a", "b").alias("cov"),
        X.strip_brand_suffix("a").alias("brandless"), X.strip_brand_suffix("a", F.lit("Acme")).alias("no_acme"), X.sentences("a").alias("sentences"),
        X.title_case("a").alias("title"), X.humanize("a").alias("human"), X.tidy_label("a", "b", F.lit("Acme")).alias("label"), X.reads_as_prose("a").alias("prose"),
    ).collect()
    for r in rows:
        assert r.tokens == plain.tokenize(r.a)
        assert r.content == [plain.stem(t) for t in plain.tokenize(r.a) if t not in X.W.STOPWORDS]
        assert r.sim == pytest.approx(plain.similarity(r.a, r.b)) and r.cov == pytest.approx(plain.coverage(r.a, r.b))
        assert r.brandless == plain.strip_brand_suffix(r.a) and r.no_acme == plain.strip_brand_suffix(r.a, "Acme")
        assert r.sentences == plain.sentences(r.a) and r.title == plain.title_case(r.a) and r.human == plain.humanize(r.a)
        assert r.label == plain.tidy_label(r.a, r.b, "Acme") and r.prose == plain.reads_as_prose(r.a)


def test_measures():
    assert plain.similarity("Our integrations", "Integration") == 1
    assert plain.coverage("pricing", "pricing and plans") == 1 and plain.coverage("pricing and plans", "pricing") == 0.5
    assert plain.coverage("of the", "x") == 1 and plain.similarity("of the", "of the") == 0
    assert plain.strip_brand_suffix("Pricing – Acme Inc", "Acme") == "Pricing"
    assert plain.humanize("getting-started") == "Getting Started" and plain.humanize("api_reference") == "API Reference" and plain.humanize("sdks") == "SDKs"
    assert plain.title_case("agents and tools of API") == "Agents and Tools of API"


CANONICAL = [
    ("https://x.com/docs/", "https://x.com/docs"), ("https://X.com:443/docs#top", "https://x.com/docs"), ("/docs/?utm_source=a", "https://x.com/docs"),
    ("docs/index.html", "https://x.com/docs"), ("https://x.com", "https://x.com/"), ("https://x.com/?gclid=1&hsa_x=2", "https://x.com/"),
    ("/a?my_source=1&id=3", "https://x.com/a?id=3"), ("/a?q=a%20b&ref=z", "https://x.com/a?q=a+b"), ("/a?q=a%20b", "https://x.com/a?q=a%20b"),
    ("/w/index.php?title=X", "https://x.com/w/index.php?title=X"), ("/w/index.php?title=X&action=edit", None), ("/a?oldid=3", None), ("/a?action=show", "https://x.com/a?action=show"),
    ("/logo.PNG", None), ("mailto:a@b.c", None), ("javascript:void(0)", None), ("/a/../b/./c", "https://x.com/b/c"), ("//y.org/é x", "https://y.org/%C3%A9%20x"),
    ("http://", None), ("https://x.com/a//", "https://x.com/a/"), ("?page=2", "https://x.com/?page=2"), ("https://x.com:8080/", "https://x.com:8080/"),
]


@pytest.mark.parametrize("href,want", CANONICAL)
def test_canonicalize(href, want):
    got = U.canonicalize(href, "https://x.com/")
    assert got == want
    assert got is None or U.canonicalize(got, "https://x.com/") == (got[:-1] if got.endswith("a/") else got)


def test_normalize():
    assert U.normalize(" example.com/a/?utm_source=x#y ") == "https://example.com/a/"
    assert U.normalize("ftp://example.com") is None and U.normalize("") is None and U.normalize("http://") is None


def test_address_columns(spark):
    df = spark.createDataFrame([("https://a.com/en/docs/api%20x?b=1#c",), ("http://a.com",)], "url string")
    rows = df.select(U.path_segments("url").alias("s"), U.raw_segments("url").alias("r"), U.path_key("url").alias("k"), U.display_url("url").alias("d"), U.query_of("url").alias("q"), U.decode_slug(F.lit("a%20b+c")).alias("x"), U.decode_slug(F.lit("%zz")).alias("y")).collect()
    assert rows[0].s == ["docs", "api%20x"] and rows[0].r == ["en", "docs", "api%20x"] and rows[0].k == "https://a.com/en/docs/api%20x" and rows[0].q == "?b=1"
    assert rows[1].d == "a.com" and rows[1].s == [] and rows[0].x == "a b+c" and rows[0].y == "%zz"


@pytest.mark.parametrize("ip,want", [("10.1.2.3", True), ("172.15.0.1", False), ("172.31.9.9", True), ("100.64.0.1", True), ("8.8.8.8", False), ("::1", True), ("fd00::1", True), ("::ffff:127.0.0.1", True), ("2001:db8::1", False)])
def test_private(spark, ip, want):
    assert spark.range(1).select(U.is_private_address(F.lit(ip)).alias("p")).first().p is want


def test_lines_are_held_against_the_line_before_in_one_pass(spark, tmp_path):
    texts = ["Red widgets\nThe red widget\n\nred rings and widgets\n", None, "", "ééé\n‘tis Red's"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r.doc_id, r.n): (r.l, r.similarity, r.coverage) for r in Q._lines(spark, str(tmp_path)).collect()}
    want = {}
    for doc, text in enumerate(texts):
        lines = [] if text is None else text.split("\n")
        for n, (before, line) in enumerate(zip(["", *lines], lines), 1):
            want[doc, n] = (line, plain.similarity(line, before), plain.coverage(line, before))
    assert rows == want and rows[0, 2][1] == 1.0 and len(rows) == 8


def test_cleaned_notes_are_made_once(spark):
    plan = spark.range(1).select(P.accept_note(F.col("id").cast("string"), covered=F.lit(0.0)).alias("x"))
    assert plan._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 3


def test_stems_by_ending_equal_those_by_pattern(spark):
    words = sorted({start + middle + end for start in ("", "a", "ab", "abs", "ach", "x'") for middle in ("", "s", "z", "sh", "i", "it") for end in ("ities", "ies", "es", "s", "ss", "ing", "ed", "")})
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.stem("w").alias("s")).collect()
    assert {r.w: r.s for r in rows} == {w: plain._stem(w) for w in words}


def test_plain_addresses_are_read_as_any_other():
    base = U.parse("https://u@A.com:81/x/y?q#f")
    hrefs = ["https://a.com", "http://a-b.c/", "https://a.com/p/q.html", "https://a.com/a//b", "https://a.com/../b", "https://a.com/.well", "https://A.com/p", "https://a.com:8/p", "/p/q", "/p/q/#top", "/p#", "//b.com/p", "/./p", "/p/..", "/p.", "/é", "/p?x=1", "", "#x", "p", "https://a.com/p\n", "/p\n", "https:///a.com/p", "https://a.com/%41"]
    assert [U.parse(x, b) for x in hrefs for b in (base, None)] == [U._parse(x, b) for x in hrefs for b in (base, None)]
