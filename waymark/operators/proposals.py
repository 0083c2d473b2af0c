"""What a model proposes for a site map, and what of it is let through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from waymark.config import LIMITS
from waymark.functions import text as X, words as W
from waymark.operators import markdown as M

REPLY = "summary string, sections map<string,string>, notes map<string,string>"


def parse_reply(reply: Column) -> Column:
    """The outermost braces of a reply as proposals; null where there are none or they don't parse."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.when(body != "", F.from_json(body, REPLY, {"mode": "PERMISSIVE"}))


def _if(made: Column, rule: Callable[[Column], Column]) -> Column:
    """``made`` if it keeps the rule. It is bound to a name, so that it is made once however often the rule asks for it."""
    return F.transform(F.array(made), lambda x: F.when(rule(x), x))[0]


def accept_note(note: Column, title: Column | None = None, covered: Column | None = None) -> Column:
    """A note that is fit beside ``title``. ``covered``: the share of its words that the title has, where it is at hand; cleaning
    leaves a text's words as they are."""
    cleaned = F.regexp_replace(X.escape_inline(note), f"[.{X.W.SPACE}]+$", "")
    said = lambda c: X.coverage(c, title) if covered is None else covered
    return _if(cleaned, lambda c: (F.length(c) >= 10) & ~c.contains("](") & (F.size(F.split(c, X.SPACE + "+")) <= LIMITS.note_words) & (said(c) <= 0.75))


def accept_summary(summary: Column, site_name: Column | None = None, alike: Column | None = None) -> Column:
    """A summary that says more than ``site_name``. ``alike``: the overlap of their words, where it is at hand."""
    said = lambda c: X.similarity(c, site_name) if alike is None else alike
    return _if(X.escape_inline(summary), lambda c: F.length(c).between(20, LIMITS.summary_chars) & ~c.rlike("https?://") & (said(c) <= 0.8))


def accept_section_name(name: Column) -> Column:
    """A fit name in title case; whether it is taken depends on the other sections."""
    cleaned = X.escape_inline(name)
    locale = f"(?i)^({'|'.join(W.NAME_LOCALES)})([-_][a-z]{{2}})?$"
    ok = F.length(cleaned).between(2, LIMITS.section_name_chars) & ~cleaned.rlike(locale) & ~cleaned.rlike(r"[#\[\]()]")
    return F.when(ok, X.title_case(cleaned))


def rename_sections(sections: DataFrame, proposed: DataFrame) -> DataFrame:
    """``site, section, section_ord, new_name``; sections (site, section, section_ord) in order, each giving up
    its name before it takes another, so an exchange depends on the order. A site has few sections."""
    rows = sections.join(proposed.withColumnRenamed("name", "proposal"), ["site", "section"], "left")
    entry = F.struct("section_ord", "section", accept_section_name(F.col("proposal")).alias("fit"), F.col("proposal").isNotNull().alias("asked"))
    per_site = rows.groupBy("site").agg(F.array_sort(F.collect_list(entry)).alias("s"))
    start = F.struct(F.transform("s", lambda x: F.lower(x["section"])).alias("taken"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, x: Column) -> Column:
        own = F.lower(x["section"])
        others = F.when(x["asked"], F.filter(acc["taken"], lambda t: t != own)).otherwise(acc["taken"])
        free = x["asked"] & x["fit"].isNotNull() & ~F.array_contains(others, F.lower(F.coalesce(x["fit"], F.lit(""))))
        name = F.when(free, x["fit"]).otherwise(x["section"])
        return F.struct(F.array_append(others, F.lower(name)).alias("taken"), F.array_append(acc["names"], name).alias("names"))

    names = F.aggregate("s", start, step)["names"]
    out = per_site.select("site", F.explode(F.arrays_zip("s", names.alias("new_name"))).alias("x"))
    return out.select("site", F.col("x.s.section").alias("section"), F.col("x.s.section_ord").alias("section_ord"), F.col("x.new_name").alias("new_name"))


def apply_notes(links: DataFrame, notes: DataFrame) -> DataFrame:
    """``links`` with accepted notes in place of their own; notes (site, url, note, chunk), of several for
    a link the last chunk's."""
    last = notes.groupBy("site", "url").agg(F.max_by("note", "chunk").alias("offer"))
    met = links.join(last, ["site", "url"], "left")
    return met.withColumn("note", F.coalesce(accept_note(F.col("offer"), F.col("title")), F.col("note"))).drop("offer").select(*links.columns)


def note_report(links: DataFrame, notes: DataFrame) -> DataFrame:
    """``site, accepted, rejected``: a note for an address that was never extracted is rejected."""
    titles = links.groupBy("site", "url").agg(F.max_by("title", "section_ord").alias("title"))
    met = notes.join(titles, ["site", "url"], "left").withColumn("ok", F.col("title").isNotNull() & accept_note(F.col("note"), F.col("title")).isNotNull())
    return met.groupBy("site").agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))


def keep_valid(old: DataFrame, new: DataFrame, n_issues: DataFrame) -> DataFrame:
    """``site, llms_txt, enhanced``: the new text where it conforms, else the old."""
    rows = old.withColumnRenamed("llms_txt", "old").join(new.withColumnRenamed("llms_txt", "new"), "site", "left").join(n_issues.withColumnRenamed("name", "site"), "site", "left")
    good = F.col("new").isNotNull() & (F.col("n_issues") == 0)
    return rows.select("site", F.when(good, F.col("new")).otherwise(F.col("old")).alias("llms_txt"), good.alias("enhanced"))


def enhance(heads: DataFrame, links: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heads and links (see ``markdown.render``) with what is let through of the replies (site, chunk, reply):
    a summary and section names of the last reply that has them, and notes by address."""
    read = replies.select("site", "chunk", parse_reply(F.col("reply")).alias("p")).filter("p IS NOT NULL")
    notes = read.select("site", "chunk", F.explode("p.notes").alias("url", "note"))
    names = read.select("site", "chunk", F.explode("p.sections").alias("section", "name")).groupBy("site", "section").agg(F.max_by("name", "chunk").alias("name"))
    said = read.filter("p.summary IS NOT NULL").groupBy("site").agg(F.max_by("p.summary", "chunk").alias("offer"))
    noted = apply_notes(links, notes)
    sections = links.filter("section_ord >= 0").select("site", "section", "section_ord").distinct()
    renamed = rename_sections(sections, names).select("site", "section_ord", "new_name")
    out = noted.join(renamed, ["site", "section_ord"], "left").withColumn("section", F.coalesce("new_name", "section")).select(*links.columns)
    summed = heads.join(said, "site", "left")
    summary = F.coalesce(accept_summary(F.col("offer"), F.col("site_name")), F.col("summary"))
    return summed.withColumn("summary", summary).select(*heads.columns), out


NO_PROPOSALS, UNREADABLE, BREAKS_GRAMMAR = "no proposals in the reply", "unreadable proposals", "the result breaks the grammar"


def enhanced_files(heads: DataFrame, links: DataFrame, replies: DataFrame) -> DataFrame:
    """``site, llms_txt, enhanced, reason``: files with what is let through of the replies, and why one stayed as it was."""
    before = M.render(heads, links)
    after = M.render(*enhance(heads, links, replies)).withColumnRenamed("site", "name").withColumnRenamed("llms_txt", "text")
    read = replies.select("site", F.col("reply").rlike(r"(?s)\{.*\}").alias("offered"), _has_proposals(parse_reply(F.col("reply"))).alias("read"))
    heard = read.groupBy("site").agg(F.bool_or("offered").alias("offered"), F.bool_or("read").alias("read"))
    kept = keep_valid(before, after.select(F.col("name").alias("site"), F.col("text").alias("llms_txt")), M.validate(after)).join(heard, "site", "left")
    reason = F.when(~F.coalesce("offered", F.lit(False)), NO_PROPOSALS).when(~F.coalesce("read", F.lit(False)), UNREADABLE).when(~F.col("enhanced"), BREAKS_GRAMMAR)
    return kept.select("site", "llms_txt", reason.isNull().alias("enhanced"), reason.alias("reason"))


def _has_proposals(p: Column) -> Column:
    return p.isNotNull() & (p["summary"].isNotNull() | p["sections"].isNotNull() | p["notes"].isNotNull())


def failure_report(calls: DataFrame) -> DataFrame:
    """``site, kind, n`` of calls (site, status) that failed."""
    return calls.groupBy("site", failure_kind(F.col("status")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def propose(skeletons: DataFrame, proposer: Callable[[Iterator], Iterator]) -> DataFrame:
    """``site, reply`` from a pluggable callable over batches; there is none by default."""
    return skeletons.mapInPandas(proposer, "site string, reply string")


# -- failures of calls ---------------------------------------------------------------


def failure_kind(status: Column) -> Column:
    return (
        F.when(status == 402, "credits").when(status == 429, "rate-limited").when(status.isin(401, 403), "auth").when(status >= 500, "upstream").otherwise("unknown")
    )


def is_retryable(kind: Column) -> Column:
    return kind.isin("rate-limited", "upstream")


def is_fatal(kind: Column) -> Column:
    return kind.isin("credits", "auth")


def retry_after_ms(header: Column, now: Column, cap: int = 30_000) -> Column:
    """Seconds or an HTTP date, capped; null where it is neither."""
    seconds = header.try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(header, r"^\w+, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.when(date.isNotNull(), F.greatest(F.lit(0), F.unix_millis(date) - F.unix_millis(now)).cast("double"))
    found = F.when(seconds >= 0, seconds * 1000).otherwise(wait)
    return F.when(found.isNotNull(), F.least(found, F.lit(float(cap))))


def backoff_ceiling_ms(attempt: Column, base: int = 400) -> Column:
    """The longest wait before a further try; the wait itself is drawn evenly below it."""
    return F.lit(base) * F.pow(F.lit(2), attempt)
