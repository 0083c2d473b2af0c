"""Text measures and clean-up as column expressions: no Python in the rows' way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark.config import LIMITS
from waymark.functions import words as W

SPACE = "[" + W.SPACE + "]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _words(*values: str) -> Column:
    return F.array(*map(F.lit, values))


def trim(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), f"^{SPACE}+|{SPACE}+$", "")


def collapse(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), SPACE + "+", " ")


def matches(x: Column | str, pattern: str, ignore_case: bool = True) -> Column:
    return _c(x).rlike(("(?i)" if ignore_case else "") + pattern)


# -- tokens --------------------------------------------------------------------


def tokenize(x: Column | str) -> Column:
    """Lower-cased runs of a-z, 0-9 and apostrophes; anything else separates."""
    return F.filter(F.split(F.translate(F.lower(_c(x)), "‘’", "''"), "[^a-z0-9']+"), lambda t: t != "")


def stem(x: Column | str) -> Column:
    """Crude suffix stripping: the first rule of ``words.SUFFIXES`` that fits a word of over three letters, told
    from its ending and length, since every word of every text passes here."""
    w, n = _c(x), F.length(_c(x))
    cut = lambda k, put="": F.concat(F.left(w, n - k), F.lit(put)) if put else F.left(w, n - k)
    es = F.lit(False)
    for ending in ("ses", "xes", "zes", "ches", "shes"):
        es = es | w.endswith(ending)
    plural = F.when(w.endswith("ities"), cut(5, "ity")).when(w.endswith("ies") & (n > 4), cut(3, "y")).when(es, cut(2)).when(w.endswith("ss"), w).otherwise(cut(1))
    return F.when(n <= 3, w).when(w.endswith("s"), plural).when(w.endswith("ing") & (n > 5), cut(3)).when(w.endswith("ed") & (n > 4), cut(2)).otherwise(w)


def content_tokens(x: Column | str) -> Column:
    return F.transform(F.filter(tokenize(x), lambda t: ~t.isin(*W.STOPWORDS)), stem)


def stem_counts(texts: DataFrame, column: str) -> DataFrame:
    """``stem, n``: content tokens over all texts. Tokens are counted as they are and the different ones stemmed."""
    tokens = texts.select(F.explode(tokenize(column)).alias("t")).filter(~F.col("t").isin(*W.STOPWORDS))
    return tokens.groupBy("t").agg(F.count(F.lit(1)).alias("n")).groupBy(stem("t").alias("stem")).agg(F.sum("n").alias("n"))


def token_similarity(a: Column | str, b: Column | str) -> Column:
    """Jaccard overlap of two arrays of content tokens; 0 if either is empty."""
    shared = F.size(F.array_intersect(_c(a), _c(b)))
    return F.when((F.size(_c(a)) == 0) | (F.size(_c(b)) == 0), F.lit(0.0)).otherwise(shared / F.size(F.array_union(_c(a), _c(b))))


def token_coverage(part: Column | str, whole: Column | str) -> Column:
    """The share of one array's tokens that the other has; 1 if the first is empty."""
    own = F.array_distinct(_c(part))
    return F.when(F.size(own) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(own, _c(whole))) / F.size(own))


def similarity(a: Column | str, b: Column | str) -> Column:
    return token_similarity(content_tokens(a), content_tokens(b))


def coverage(part: Column | str, whole: Column | str) -> Column:
    return token_coverage(content_tokens(part), content_tokens(whole))


# -- titles, sentences, names ----------------------------------------------------


def title_parts(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(x), f"{SPACE}+[|–—·•-]{SPACE}+"), trim), lambda p: p != "")


def strip_brand_suffix(title: Column | str, brand: Column | str | None = None) -> Column:
    """The page's own part of a title: the parts that don't hold the brand, else the longest."""
    parts = title_parts(title)
    longest = F.aggregate(parts, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))
    kept = longest
    if brand is not None:
        tokens = content_tokens(brand)
        own = F.filter(parts, lambda p: token_coverage(tokens, content_tokens(p)) < 0.8)
        kept = F.when(F.coalesce(_c(brand), F.lit("")).eqNullSafe("") | (F.size(own) == 0), longest).otherwise(F.array_join(own, " - "))
    return F.when(F.size(parts) < 2, trim(title)).otherwise(kept)


def sentences(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(x), rf'(?<=[.!?]){SPACE}+(?=[A-Z"(])'), trim), lambda s: s != "")


def title_case(x: Column | str) -> Column:
    """Words begin in upper case, but for minor words after the first; acronyms stay."""

    def one(word: Column, n: Column) -> Column:
        raised = F.concat(F.upper(word.substr(1, 1)), word.substr(F.lit(2), F.length(word)))
        return F.when(word.rlike("^[A-Z0-9]{2,}$"), word).when((n > 0) & F.lower(word).isin(*W.MINOR_WORDS), F.lower(word)).otherwise(raised)

    return F.array_join(F.transform(F.filter(F.split(_c(x), SPACE + "+"), lambda w: w != ""), one), " ")


def humanize(slug: Column | str) -> Column:
    """getting-started to Getting Started, api_reference to API Reference."""
    acronym = f"(?i)^({'|'.join(W.ACRONYMS)})s?$"

    def one(word: Column) -> Column:
        plural = F.lower(word).endswith("s") & F.lower(word.substr(F.lit(1), F.length(word) - 1)).isin(*W.ACRONYMS)
        upper = F.when(plural, F.concat(F.upper(word.substr(F.lit(1), F.length(word) - 1)), F.lit("s"))).otherwise(F.upper(word))
        return F.when(word.rlike(acronym), upper).otherwise(word)

    parts = F.filter(F.split(F.regexp_replace(_c(slug), r"(?i)\.[a-z0-9]+$", ""), "[-_]+"), lambda w: w != "")
    return title_case(F.array_join(F.transform(parts, one), " "))


def tidy_label(label: Column | str, fallback: Column | str, site_name: Column | str | None = None) -> Column:
    """A noun for a section: no leading instruction, no trailing furniture, not the site's own name."""
    lead = F.regexp_replace(_c(label), f"(?i)^(?:(?:{W.LABEL_LEAD}){SPACE}+)+", "")
    cleaned = trim(F.regexp_replace(lead, f"(?i){SPACE}+({W.LABEL_TRAIL})$", ""))
    out = title_case(F.when(cleaned == "", _c(fallback)).otherwise(cleaned))
    if site_name is None:
        return out
    return F.when(F.coalesce(similarity(cleaned, site_name), F.lit(0.0)) > 0.5, title_case(fallback)).otherwise(out)


def reads_as_prose(x: Column | str) -> Column:
    return (F.size(F.split(_c(x), SPACE + "+")) < 4) | matches(x, W.bounded("|".join(W.FUNCTION_WORDS)))


def is_generic_label(x: Column | str) -> Column:
    return matches(x, W.GENERIC_LABEL)


def is_deictic(x: Column | str) -> Column:
    """A label that points ("here", "read more") instead of naming."""
    return matches(x, W.DEICTIC)


def is_optional(path: Column | str, title: Column | str, crawled: bool = True) -> Column:
    """Legal, account and careers pages: they go to the Optional section."""
    pattern = W.bounded(W.OPTIONAL_CRAWL if crawled else W.OPTIONAL_PAGE)
    return F.lower(_c(path)).rlike(pattern) | F.lower(_c(title)).rlike(pattern)


def truncate_note(x: Column | str, limit: int = LIMITS.note_chars) -> Column:
    x = _c(x)
    return F.when(F.length(x) > limit, F.concat(F.regexp_replace(F.substring(x, 1, limit), f"{SPACE}+$", ""), F.lit("…"))).otherwise(x)


def truncate_text(x: Column | str, limit: int = 6000, marker: str = "\n… (truncated)") -> Column:
    return F.when(F.length(_c(x)) > limit, F.concat(F.left(_c(x), F.lit(limit)), F.lit(marker))).otherwise(_c(x))


# -- escapes and digests -----------------------------------------------------------


def escape_inline(x: Column | str) -> Column:
    return trim(collapse(x))


def escape_link_text(x: Column | str) -> Column:
    return trim(F.regexp_replace(collapse(x), r"([\[\]\\])", r"\\$1"))


def escape_block(x: Column | str) -> Column:
    return trim(F.regexp_replace(_c(x), rf"(?m)^([ \t]*)(#{{1,6}})({SPACE})", r"$1\\$2$3"))


def unescape(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"\\(.)", "$1")


def hash_content(x: Column | str) -> Column:
    return F.substring(F.sha2(_c(x), 256), 1, 32)


# -- labels --------------------------------------------------------------------------


def age_label(then: Column | str, now: Column | str) -> Column:
    minutes = F.greatest(F.lit(0), F.floor((F.unix_millis(_c(now)) - F.unix_millis(_c(then))) / 60_000 + 0.5)).cast("long")
    hours = F.floor(minutes / 60 + 0.5)
    return (
        F.when(minutes < 1, F.lit("just now"))
        .when(minutes < 60, F.concat(minutes, F.lit(" min ago")))
        .when(hours < 24, F.concat(hours, F.lit("h ago")))
        .otherwise(F.concat(F.floor(hours / 24 + 0.5), F.lit("d ago")))
    )


def refreshed_label(checked: Column | str, generated: Column | str, now: Column | str) -> Column:
    return age_label(F.coalesce(_c(checked), _c(generated)), now)


def report_label(notes: Column | str, renamed: Column | str, chunks_failed: Column | str) -> Column:
    changes = F.concat_ws(
        ", ",
        F.when(_c(notes) > 0, F.concat(_c(notes), F.lit(" notes"))),
        F.when(_c(renamed) > 0, F.concat(_c(renamed), F.lit(" sections renamed"))),
    )
    failed = F.when(_c(chunks_failed) > 0, F.concat(F.lit(", "), _c(chunks_failed), F.lit(" chunks failed"))).otherwise(F.lit(""))
    return F.when(changes == "", F.lit("the models added nothing")).otherwise(F.concat(changes, failed))
