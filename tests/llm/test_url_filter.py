"""Rules and segmentation against slow versions, the method on names it was not trained on."""

import itertools
import math
import re
from collections import Counter

import pytest

from waymark.llm.url_filter import BLOCK_EXAMPLES, ALLOW_EXAMPLES, RULES, NaiveBayes, Segmenter, example_counts, filter_urls, op9_url_filter


def slow_rule(host, path):
    found = [(len(d + p), v == "block", v, d + p) for v, d, p in RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return max(found)[2:] if found else (None, None)


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]


def test_query_follows_rules(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op9_url_filter(spark, sf).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path) == slow_parts(urls[r.page_id])
        verdict, rule = slow_rule(r.host, r.path)
        assert r.rule == rule and r.verdict == (verdict or ("block" if r.score > 0 else "allow"))


ODD = [None, "", "nourl", "http://", "HTTP://Example.NET", "http://example.net/en/x", "http://a.example.net/en", "x://net/a?b#c", "http://EXAMPLE.com/de/?q", "http://notexample.com/de/", "https://x.org/fr/a#b", "a://b://c/d", "http://É.net/é", "http://x.net\n/y", "http://cheapcasinopills.com/win", "http://citylibrary.org/en/1", "http://" + "ab" * 50_000 + ".com/", "://x.net/"]


def test_odd_urls(spark):
    docs = spark.createDataFrame([(i, u, "<p>the city library in the city</p>", "clash") for i, u in enumerate(ODD)] + [(None, None, None, "clash")], "page_id long, url string, html string, verdict string")
    rows = {r.page_id: r for r in filter_urls(docs).collect()}
    assert len(rows) == len(ODD) + 1
    for i, u in enumerate(ODD):
        assert (rows[i].host, rows[i].path) == slow_parts(u)
        verdict, rule = slow_rule(rows[i].host, rows[i].path)
        assert rows[i].rule == rule and (verdict is None or rows[i].verdict == verdict)
    assert rows[ODD.index("http://cheapcasinopills.com/win")].verdict == "block"
    assert rows[ODD.index("http://citylibrary.org/en/1")].verdict == "allow"
    assert filter_urls(docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["cheappills", "citybank", "onlinecasino", "abcxyz", "newsnews", "a", "freebetsnow"])
def test_segmentation_is_the_best_of_all(name):
    segmenter = Segmenter({**example_counts(), "ban": 3, "new": 2})
    cost = lambda words: sum(max(segmenter.known.get(w, -math.inf), segmenter.unknown(len(w))) for w in words)
    splits = []
    for cuts in itertools.product([0, 1], repeat=len(name) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(name)]
        splits.append([name[a:b] for a, b in zip(at, at[1:])])
    assert math.isclose(cost(segmenter.split(name)), max(map(cost, splits)))


def slow_verdicts(pages):
    """Words of all pages, every split of every name by trying all cuts, and the model, without a table."""
    words = Counter(w for _, _, html in pages for w in re.findall("[a-z]+", re.sub(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html or "", flags=re.S | re.I).lower()))
    words = Counter({w: n for w, n in words.items() if len(w) > 1})
    scale = max(1, sum(words.values()) // 20_000)
    for w, n in example_counts().items():
        words[w] += n * scale
    total = sum(words.values())
    known = {}

    def split(name):
        if name not in known:
            best = [(0.0, [])]
            for end in range(1, len(name) + 1):
                offers = []
                for start in range(end):
                    piece = name[start:end]
                    costs = [math.log(10 / total) - len(piece) * math.log(10)] + ([math.log(words[piece] / total)] if piece in words else [])
                    offers.append((best[start][0] + max(costs), start, best[start][1] + [piece]))
                value, _, found = max(offers)
                best.append((value, found))
            known[name] = best[-1]
        return known[name]

    hosts = sorted({slow_parts(u)[0] for _, u, _ in pages if slow_parts(u)[0]})
    bags = {h: [w for n in re.findall("[a-z]+", h.lower()) for w in split(n)[1]] for h in hosts}
    model = NaiveBayes(BLOCK_EXAMPLES, ALLOW_EXAMPLES, [bags[h] for h in hosts if bags[h]])
    out = {}
    for i, u, _ in pages:
        host, path = slow_parts(u)
        score = model.score([w for text in (host, path) for n in re.findall("[a-z]+", text.lower()) for w in split(n)[1]])
        verdict, rule = slow_rule(host, path)
        out[i] = (rule, verdict or ("block" if score > 0 else "allow"), score)
    return out


def test_verdicts_equal_a_slow_version(spark, sf):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    want = slow_verdicts(pages)
    rows = op9_url_filter(spark, sf).collect()
    assert len(rows) == len(pages) and {"allow", "block"} == {r.verdict for r in rows if r.rule is None}
    for r in rows:
        assert (r.rule, r.verdict) == want[r.page_id][:2] and r.score == pytest.approx(want[r.page_id][2], abs=1e-6)


def test_words_that_go_with_telling_ones_tell():
    """Names without a label teach new words of either kind, and words on both sides tell nothing."""
    bags = [["casino", "zorbo", "www"]] * 20 + [["library", "quiet", "www"]] * 20 + [["other", "name", "www"]] * 40
    model = NaiveBayes(BLOCK_EXAMPLES, ALLOW_EXAMPLES, bags)
    assert model.ratio["zorbo"] > 1 and model.ratio["quiet"] < -1 and abs(model.ratio["www"]) < 0.3 and abs(model.ratio["other"]) < 0.1
    assert "zorbo" not in NaiveBayes(BLOCK_EXAMPLES, ALLOW_EXAMPLES).ratio


def test_no_name_or_word_is_cut(spark):
    """A word of forty letters that pages have is found at the end of a name of thousands."""
    word = "abcdefghij" * 4
    rows = [(1, "http://" + "xq" * 1500 + word + "casino.example/", f"<p>{word} {word} and {word}</p>"), (2, "http://" + "z" * 300 + "casinojackpot.example/", "")]
    got = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block"}
    assert Segmenter({word: 3, "casino": 2}).split("xq" * 50 + word + "casino")[-2:] == [word, "casino"]


def test_leave_one_out_accuracy():
    """Names whose words occur in other examples are told apart without their own example."""
    right = total = 0
    for label, own, other in ((1, BLOCK_EXAMPLES, ALLOW_EXAMPLES), (0, ALLOW_EXAMPLES, BLOCK_EXAMPLES)):
        for k, example in enumerate(own):
            rest = own[:k] + own[k + 1 :]
            if not any(w in e.split() for w in example.split() for e in rest):
                continue
            model = NaiveBayes(rest, other) if label else NaiveBayes(other, rest)
            right += (model.score(example.split()) > 0) == bool(label)
            total += 1
    assert total > 30 and right / total > 0.85
