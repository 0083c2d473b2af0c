"""Which urls to block: rules by host and path, and for the rest the words of host and path.

Hosts are often words run together. Unigram Viterbi splits each name, a run of letters,
into words by the words' frequencies in the text of all pages, and a multinomial naive
Bayes model scores the words of host and path. A rule that fits decides instead; of
those that fit, the longest.

Word frequencies are counted over all pages, and nothing is left out: the different names
are exploded into their substrings, which join the table of all words, so each name meets
the few words that it can hold. Names are split whole, once each, and so are pages' hosts
and paths scored.

The model learns from labelled examples and from the names of a bounded sample of hosts
without labels: at most TRAIN_HOSTS, those with the smallest hash. Such a host counts
towards either class by what the examples' words in it tell, half to each if it has none, at
a weight of UNLABELLED, so words that go with telling ones tell something themselves.
There is one round: in further ones words that all hosts share would drift with their own
verdicts. The classes' counts are of one size, so a word that tells nothing adds nothing.

Defined results: a null url, or one without ``://``, has an empty host and path, no
rule, and the verdict of the prior (allow). Of fitting rules of one length a
blocking one decides. Letters are a-z; others separate names. Repeated rows are judged
each. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waymark.llm._arrow import columns
from waymark.llm._sample import lowest
from waymark.scratch import Scratch

MAX_RULES = 1000
PRIOR_BLOCK = 0.3
#: Added to every count; small, since each example word is telling.
SMOOTH = 0.1
#: Hosts without labels that the model learns from, their weight, and the longest name that a host may have.
TRAIN_HOSTS, UNLABELLED, HOST_CHARS = 2000, 0.1, 253
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (verdict, host, path) of the query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Training examples, the words of names that are typical of each class.
BLOCK_EXAMPLES = [
    "cheap pills online", "buy cheap viagra", "discount pharmacy pills", "online pharmacy meds", "casino win", "online casino bonus",
    "poker slots jackpot", "free bets", "sports betting tips", "best betting odds", "adult x", "xxx adult video", "sex cams live",
    "porn tube free", "escort girls", "spam farm", "link farm seo", "ads track", "ad tracker click", "popup ads banner",
    "free download crack", "warez keygen torrent", "win prize", "payday loans fast", "cheap loans credit", "rich quick scheme",
    "replica watches sale", "weight loss pills", "click free money", "phishing login verify", "malware virus scam", "gambling lottery win",
    "adult dating hookup", "nude pics", "cheap replica bags", "forex crypto profit", "traffic exchange clicks", "ads server tracking pixel",
]
ALLOW_EXAMPLES = [
    "city library", "public school", "university press", "daily news", "science journal", "open data", "health ministry", "art museum",
    "weather service", "travel guide", "garden club", "music school", "local history", "book review", "food recipes", "sports news",
    "software docs", "developer blog", "code forum", "help center", "company home", "product support", "research lab", "nature photos",
    "family doctor", "city bank", "town hall", "film festival", "chess club", "language course", "mobile site", "web mail",
    "contact page", "page article post", "html index wiki", "wiki article",
]

_LETTERS = re.compile(r"[a-z]+")
_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(verdict, rule), or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    # Each branch stands before the ones added earlier, so the longest is tried first.
    for verdict, domain, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(domain + prefix).alias("rule"))).otherwise(out)
    return out


class Segmenter:
    """Most probable split of a name into words, by unigram frequencies; an unknown word of n letters has the
    frequency 10 / 10^n."""

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        total = max(1, sum(counts.values()) if total is None else total)
        self.known = {w: math.log(n / total) for w, n in counts.items()}
        self.lengths = sorted({len(w) for w in counts})
        self.begin, self.letter = math.log(10 / total), math.log(10)

    def unknown(self, n: int) -> float:
        return self.begin - n * self.letter

    def split(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        # The best place for an unknown word to begin, whatever its end: its letters cost the same each.
        start, worth = 0, 0.0
        for end in range(1, len(name) + 1):
            value, at = worth + self.unknown(end), start
            for n in self.lengths:
                if n > end:
                    break
                known = self.known.get(name[end - n : end])
                if known is not None and best[end - n] + known >= value:
                    value, at = best[end - n] + known, end - n
            best.append(value)
            back.append(at)
            if value + end * self.letter >= worth:
                start, worth = end, value + end * self.letter
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


class NaiveBayes:
    """Multinomial, smoothed by SMOOTH, from examples of both classes and lists of words without a label."""

    def __init__(self, block: list[str], allow: list[str], unlabelled: list[list[str]] = (), prior: float = PRIOR_BLOCK) -> None:  # noqa: B006
        told = [Counter(w for e in examples for w in e.split()) for examples in (allow, block)]
        size = sum(c.total() for c in told) / 2
        told = [{w: n * size / max(1, c.total()) for w, n in c.items()} for c in told]
        self.prior = math.log(prior / (1 - prior))
        self.vocabulary = {*told[0], *told[1]}
        self.ratio = self._ratio(told)
        self.vocabulary |= {w for ws in unlabelled for w in ws}
        if unlabelled:
            counts = [Counter(t) for t in told]
            for words in unlabelled:
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.evidence(words)))))
                for w in words:
                    counts[0][w] += UNLABELLED * (1 - p)
                    counts[1][w] += UNLABELLED * p
            sizes = [sum(c.values()) for c in counts]
            self.ratio = self._ratio([{w: n * max(sizes) / c for w, n in x.items()} for x, c in zip(counts, sizes)])

    def _ratio(self, counts: list[dict[str, float]]) -> dict[str, float]:
        sizes = [sum(c.values()) + SMOOTH * len(self.vocabulary) for c in counts]
        return {w: math.log((counts[1].get(w, 0) + SMOOTH) / sizes[1]) - math.log((counts[0].get(w, 0) + SMOOTH) / sizes[0]) for w in self.vocabulary}

    def evidence(self, words: list[str]) -> float:
        return sum(self.ratio.get(w, 0.0) for w in words)

    def score(self, words: list[str]) -> float:
        """Log-odds of block."""
        return self.prior + self.evidence(words)


def example_counts() -> Counter:
    return Counter(w for e in BLOCK_EXAMPLES + ALLOW_EXAMPLES for w in e.split())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for (texts,) in columns(batch, "html"):
            for html in texts:
                counts.update(_LETTERS.findall(_MARKUP.sub(" ", html or "").lower()))
        if len(counts) > 500_000:
            yield _counted(counts)
            counts = Counter()
    yield _counted(counts)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def names_in(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)


def _substrings(lengths: list[int]):
    """(name, word): the different substrings of each name that have a word's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                found = list({name[i : i + n] for n in lengths if n <= len(name) for i in range(len(name) - n + 1)})
                for at in range(0, len(found), 50_000):
                    part = found[at : at + 50_000]
                    yield pa.record_batch([pa.array([name] * len(part), pa.string()), pa.array(part, pa.string())], ["name", "word"])

    return run


def _split(total: int, examples: dict[str, int]):
    """(name, words) from (name, found, counts); examples' words have their own counts on top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for name, found, n in zip(*(batch.column(c).to_pylist() for c in ("name", "found", "counts"))):
                counts = Counter(dict(zip(found or [], n or [])))
                for w, extra in examples.items():
                    if w in name:
                        counts[w] += extra
                words.append(Segmenter(counts, total).split(name))
            yield pa.record_batch([batch.column("name"), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return run


def _told(model: NaiveBayes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [model.evidence(ws) for ws in batch.column("words").to_pylist()]
            yield pa.record_batch([batch.column("name"), pa.array(told, pa.float64())], ["name", "told"])

    return run


def segmented(names: DataFrame, pages: DataFrame, html_col: str, scratch: Scratch) -> DataFrame:
    """``name, words`` of different names, by the words of all pages."""
    counts = pages.select(F.col(html_col).alias("html")).mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts, "words")
    # Single letters are left to the model of unknown words.
    spelt = counts.filter(F.length("word") > 1)
    own = example_counts()
    lengths = sorted({r.n for r in spelt.select(F.length("word").alias("n")).distinct().collect()} | set(map(len, own)))
    all_words = spelt.agg(F.sum("n")).first()[0] or 0
    scale = max(1, all_words // 20_000)
    parts = scratch.keep(names.mapInArrow(_substrings(lengths), "name string, word string"), "substrings")
    held = parts.join(spelt, "word").groupBy("name").agg(F.collect_list("word").alias("found"), F.collect_list("n").alias("counts"))
    examples = {w: n * scale for w, n in own.items()}
    split = names.join(held, "name", "left").mapInArrow(_split(all_words + sum(examples.values()), examples), "name string, words array<string>")
    return scratch.keep(split, "segmented")


def _unlabelled(hosts: DataFrame, split: DataFrame) -> list[list[str]]:
    """The words of a bounded sample of hosts."""
    some = lowest(hosts.filter(F.length("host").between(1, HOST_CHARS)).select(F.col("host").alias("doc_id"), F.lit(1).alias("k")), "k", TRAIN_HOSTS, 1)
    rows = some.select(F.col("doc_id").alias("host"), F.posexplode(names_in(F.col("doc_id"))).alias("at", "name")).join(split, "name").collect()
    words: dict[str, list[tuple[int, list[str]]]] = {}
    for r in rows:
        words.setdefault(r.host, []).append((r.at, r.words))
    return [[w for _, ws in sorted(words[h]) for w in ws] for h in sorted(words)]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for each row; the score is the log-odds of block."""
    scratch = Scratch(pages.sparkSession, "url-filter")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    addresses = scratch.keep(rows.select("host", "path").distinct(), "addresses")
    named = addresses.select("host", "path", F.explode(F.concat(names_in(F.col("host")), names_in(F.col("path")))).alias("name"))
    split = segmented(scratch.keep(named.select("name").distinct(), "names"), pages, html_col, scratch)
    model = NaiveBayes(BLOCK_EXAMPLES, ALLOW_EXAMPLES, _unlabelled(addresses.select("host").distinct(), split))
    told = split.mapInArrow(_told(model), "name string, told double").filter("told <> 0")
    # Written, so that either side of a join is a plain exchange and a name or address of many rows can be split.
    told = scratch.keep(told, "told")
    scores = scratch.keep(named.join(told, "name").groupBy("host", "path").agg(F.sum("told").alias("told")), "scores")
    scored = rows.join(scores, ["host", "path"], "left").withColumn("score", F.lit(model.prior) + F.coalesce("told", F.lit(0.0)))
    hit = scored.withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return hit.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"), "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 9).alias("score"))
