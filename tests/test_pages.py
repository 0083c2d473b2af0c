"""Trees and single-page site maps on pages of several kinds."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waymark.functions import plain as T
from waymark.functions._udf import SLICE_BYTES, in_slices, slices
from waymark.operators.extract import choose_depth, extract, extractions, group_key, page_meta
from waymark.sources import html as H
from waymark.sources.html import Page, decode_entities

DOCS = """<!doctype html><html><head><title>Docs | Kestrel</title><meta name="description" content="Kestrel moves files between clouds. It is quick.">
<link rel="canonical" href="/start?x=1"></head><body><nav><h2>Guides</h2><a href="/docs/guides/a">Alpha guide</a><a href="/docs/guides/b">Beta guide</a>
<a href="/docs/guides/c">Gamma guide</a></nav><main><h1>Welcome</h1><p>Kestrel copies and checks files wherever they are kept, and it tells you about every one of them in turn.</p>
<div class="card"><a href="/docs/reference/cli">CLI</a><p>Every command of the tool with its options and an example of each.</p></div>
<div><a href="/docs/reference/http/">HTTP interface</a><a href="/docs/reference/http#top">Http</a></div><a href="/privacy">Privacy</a><a href="/docs/guides/c">here</a></main>
<footer><a href="https://other.example/">Other</a></footer></body></html>"""


def test_tree_of_tag_soup():
    page = Page("<div><p>one<p>two<b>x</b><ul><li>a<li>b</ul></span></div><script>if (a < b) '</p>'</script><p>c<br/>d")
    spans = [(page.tag[n], page.clean(n)) for n in page.elements()]
    assert ("p", "one") in spans and ("p", "two x") in spans and ("li", "a") in spans and ("ul", "a b") in spans
    assert [page.tag[n] for n in page.elements() if page.parent[n] == 0] == ["div", "script", "p"]
    assert page.clean(0).endswith("c d") and "if" not in page.clean(0)


def test_raw_text_without_an_end_takes_the_rest():
    assert Page("<p>a</p><style>x<p>b").clean(0) == "a"


@pytest.mark.parametrize("text,want", [("&amp;&lt;&#65;&#x42;&nbsp;&mdash;", "&<AB —"), ("&copy; &bogus; &#0; &#x110000;", "&copy; &bogus; &#0; &#x110000;")])
def test_entities(text, want):
    assert decode_entities(text) == want


def test_attributes_and_spacing():
    page = Page("<a HREF='/x' href=\"/y\" checked data-a=1>see <em>this</em>, ( now )</a>")
    assert page.attrs[1] == {"href": "/y", "checked": "", "data-a": "1"} and page.clean(1) == "see this, (now)"
    assert page.link_density(0) == 1.0 and Page("").link_density(0) == 1.0


def test_docs_page():
    x = extract(DOCS, "https://www.kestrel.dev/")
    assert x["site_name"] == "Kestrel" and x["summary"] == "Kestrel moves files between clouds." and not x["client_rendered"]
    assert x["prose"] == ["Kestrel copies and checks files wherever they are kept, and it tells you about every one of them in turn."]
    names = {s["name"]: [(e["title"], e["note"]) for e in s["links"]] for s in x["sections"]}
    assert names["Guides"] == [("C", None), ("Beta guide", None), ("Alpha guide", None)]  # "here" names nothing, so the slug does, and it is shorter
    assert names["Reference"][0] == ("CLI", "Every command of the tool with its options and an example of each")
    assert [e["title"] for e in x["optional"]] == ["Privacy"]


def test_shell_and_small_page():
    shell = extract("<html><body><div id=root></div><script src=x></script></body></html>", "https://a.com/")
    assert shell["client_rendered"] and shell["sections"] == [] and shell["site_name"] == "a.com"
    assert not extract("<h1>Example</h1><p>For use in documents.</p>", "https://a.com/")["client_rendered"]


def test_depth():
    assert choose_depth([["docs", "a", "x"], ["docs", "b", "y"]]) == 1 and choose_depth([["a"], ["b"]]) == 0
    assert choose_depth([["a", "x"], ["b", "y"], ["c", "z"]]) == 0 and group_key(["docs", "a", "x"], 1) == "a" and group_key(["x"], 1) == ""


def test_columns_of_pages(spark):
    pages = spark.createDataFrame([(1, "https://www.kestrel.dev/", DOCS), (2, "https://a.com/", None), (3, None, "<p>x"), (4, "nonsense", "<p>y")], "page_id long, url string, html string")
    meta = {r.page_id: r for r in page_meta(pages).collect()}
    assert meta[1].url == "https://www.kestrel.dev/start?x=1" and meta[1].title == "Kestrel" and len(meta[1].links) == 9
    assert meta[2].title == "" and meta[2].links == [] and 3 not in meta
    found = {r.page_id: r.extraction for r in extractions(pages).collect()}
    assert found[1].site_name == "Kestrel" and found[2].site_name == "a.com" and found[4].site_name is None
    table = H.nodes(pages)
    assert H.meta_content(table, ["og:title", "description"]).collect()[0].content == "Kestrel moves files between clouds. It is quick."
    density = {(r.page_id, r.tag): r.density for r in H.link_density(table, F.col("tag").isin("nav", "main", "h1")).collect()}
    page = Page(DOCS)
    for tag in ("nav", "main", "h1"):
        n = page.tag.index(tag)
        assert density[1, tag] == pytest.approx(page.link_density(n))
    kept = H.outside_chrome(table, table.filter("tag = 'a'").select("page_id", "node_id")).count()
    assert kept == 5


def test_pages_are_read_in_slices_of_bounded_size(spark):
    batch = pa.RecordBatch.from_pydict({"n": range(6), "html": ["x" * 40, None, "y" * 70, "é" * 60, "", "z"]})
    assert [part.column("n").to_pylist() for part in slices(batch, "html", 100)] == [[0, 1], [2], [3], [4, 5]]
    rows = spark.createDataFrame([(n, "<p>" * (n + 1)) for n in range(3_000)], "page_id long, html string").coalesce(1)
    held = in_slices(rows, "html", lambda part: {"rows": [part.num_rows], "bytes": [sum(map(len, part.column("html").to_pylist()))]}, StructType.fromDDL("rows long, bytes long")).collect()
    assert sum(r.rows for r in held) == 3_000 and max(r.bytes for r in held) <= SLICE_BYTES and len(held) > 10


def test_long_texts_are_not_remembered():
    before = T._remembered.cache_info().currsize
    assert T.coverage("word " * 100, "words and more of them " * 50) == 1.0 and T._remembered.cache_info().currsize == before
