"""The Markdown file of a site: writing it, reading it back, and what is wrong with one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.functions import text as X
from waymark.functions.urls import escape_url

#: What a departure from the grammar is called.
SECOND_H1 = "A second H1: the file names the site once, at the top."
EMPTY_H1 = "The H1 is empty."
EARLY_HEADING = "A heading before the H1 title."
DEEP_HEADING = "H{} used; sections are delimited by H2, and nothing deeper is defined."
UNNAMED_H2 = "An H2 with no section name."
EARLY_CONTENT = "Content before the H1: the title comes first."
NO_LINK = "A section holds a file list; this line is not a list item with a link."
UNNAMED_LINK = "A link with no name."
NO_H1 = "No H1: the file must name the site."

LIST_ITEM = rf"^[-*+]{X.SPACE}+\[((?:\\.|[^\]\\])*)\]\(([^){X.SPACE[1:]}+)\){X.SPACE}*(?::{X.SPACE}*(.*))?$"


def link_line(url: Column, title: Column, note: Column) -> Column:
    notes = F.when(F.coalesce(note, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(": "), X.escape_inline(note)))
    return F.concat(F.lit("- ["), X.escape_link_text(title), F.lit("]("), escape_url(url), F.lit(")"), notes)


def render(heads: DataFrame, links: DataFrame) -> DataFrame:
    """``site, llms_txt`` from heads (site, home_url, site_name, summary, prose, client_rendered) and links
    (site, section, section_ord, link_ord, url, title, note; section_ord -1 is Optional)."""
    ordered = F.array_sort(F.collect_list(F.struct("link_ord", link_line(F.col("url"), F.col("title"), F.col("note")).alias("line"))))
    blocks = links.groupBy("site", "section_ord", "section").agg(ordered.alias("lines"))
    title = F.when(F.col("section_ord") < 0, "Optional").otherwise(X.escape_inline("section"))
    body = F.concat(F.array(F.concat(F.lit("## "), title), F.lit("")), F.transform("lines", lambda x: x["line"]), F.array(F.lit("")))
    place = F.when(F.col("section_ord") < 0, F.lit(1 << 30)).otherwise(F.col("section_ord"))
    per_site = blocks.select("site", place.alias("place"), body.alias("body")).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("place", "body"))).alias("blocks"))
    rows = heads.join(per_site, "site", "left")
    name = X.escape_inline(F.coalesce("site_name", F.lit("")))
    host = F.regexp_extract("home_url", r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    first = F.array(F.concat(F.lit("# "), F.when(name == "", host).otherwise(name)), F.lit(""))
    summary = F.when(F.coalesce(F.col("summary"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("> "), X.escape_inline("summary")), F.lit("")))
    prose = F.flatten(F.transform(F.coalesce("prose", F.array().cast("array<string>")), lambda p: F.array(X.escape_block(p), F.lit(""))))
    shell = F.concat(F.lit("_"), F.col("home_url"), F.lit(" returned an application shell; its links are added by JavaScript, which a single fetch does not run._"))
    none = F.concat(F.lit("_No links to other pages were found on "), F.col("home_url"), F.lit("._"))
    nothing = F.array(X.escape_block(F.when(F.col("client_rendered"), shell).otherwise(none)), F.lit(""))
    sections = F.coalesce(F.flatten(F.transform("blocks", lambda b: b["body"])), nothing)
    return rows.select("site", F.array_join(F.concat(first, summary, prose, sections), "\n").alias("llms_txt"))


def read_lines(files: DataFrame) -> DataFrame:
    """Lines of files (name, text) with what each is: the grammar's states as running windows.

    A file has a title, then quotes, then free text, then sections; the state before a line
    follows from the first H1, the first line after it that is no quote, and the last H2.
    """
    raw = files.select("name", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "^﻿", ""), "\n")).alias("i", "raw"))
    line = F.regexp_replace("raw", X.SPACE + "+$", "")
    heading = rf"^(#{{1,6}})(?:{X.SPACE}+(.*))?$"
    rows = raw.select("name", (F.col("i") + 1).alias("line"), line.alias("text"))
    rows = rows.withColumn("level", F.when(F.col("text").rlike(heading), F.length(F.regexp_extract("text", heading, 1))).otherwise(0))
    rows = rows.withColumn("heading", X.trim(F.regexp_extract("text", heading, 2))).withColumn("blank", X.trim("text") == "")
    before = Window.partitionBy("name").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("name").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("name")
    rows = rows.withColumn("h1", F.min(F.when(F.col("level") == 1, F.col("line"))).over(whole))
    # An H2 opens the sections even where no H1 has come, and an H1 after it is then a second one.
    rows = rows.withColumn("h2", F.min(F.when(F.col("level") == 2, F.col("line"))).over(whole))
    title_line = F.when(F.col("h2").isNull() | (F.col("h1") < F.col("h2")), F.col("h1"))
    rows = rows.withColumn("title_line", title_line)
    rows = rows.withColumn("section_no", F.count(F.when(F.col("level") == 2, True)).over(upto))
    content = ~F.col("blank") & (F.col("level") == 0)
    after_title = F.col("line") > F.col("title_line")
    free = after_title & content & ~F.col("text").startswith(">") & (F.col("section_no") == 0)
    rows = rows.withColumn("past_quotes", F.coalesce(F.max(F.when(free, True).otherwise(False)).over(before), F.lit(False)))
    stage = (
        F.when(F.col("section_no") > 0, "sections")
        .when(F.col("title_line").isNull() | (F.col("line") <= F.col("title_line")), "title")
        .when(F.col("past_quotes") | free, "details")
        .otherwise("summary")
    )
    return rows.withColumn("stage", stage).withColumn("item", F.when((F.col("stage") == "sections") & content, F.regexp_replace("text", f"^{X.SPACE}+", "")))


def issues(lines: DataFrame) -> DataFrame:
    """``name, line, message`` of every departure, several on a line in the order they are noticed."""
    level, text = F.col("level"), F.col("item")
    first = (level == 1) & (F.col("line") == F.col("title_line"))
    early = F.col("title_line").isNull() | (F.col("line") < F.col("title_line"))
    no_section = early & (F.col("section_no") - (level == 2).cast("int") == 0)
    when = lambda cond, message: F.when(cond, message)
    found = F.array(
        when((level == 1) & ~F.coalesce(first, F.lit(False)), F.lit(SECOND_H1)),
        when(first & (F.col("heading") == ""), F.lit(EMPTY_H1)),
        when((level >= 2) & no_section, F.lit(EARLY_HEADING)),
        when(level > 2, F.concat(F.lit(DEEP_HEADING.split("{}")[0]), level, F.lit(DEEP_HEADING.split("{}")[1]))),
        when((level == 2) & (F.col("heading") == ""), F.lit(UNNAMED_H2)),
        when((level == 0) & ~F.col("blank") & (F.col("stage") == "title"), F.lit(EARLY_CONTENT)),
        when(text.isNotNull() & ~text.rlike(LIST_ITEM), F.lit(NO_LINK)),
        when(text.rlike(LIST_ITEM) & (X.trim(F.regexp_extract(text, LIST_ITEM, 1)) == ""), F.lit(UNNAMED_LINK)),
    )
    per_line = lines.select("name", "line", F.posexplode(F.filter(found, lambda m: m.isNotNull())).alias("n", "message")).select("name", "line", "message")
    title = F.max(F.when(F.col("line") == F.col("title_line"), F.col("heading")))
    untitled = lines.groupBy("name").agg(title.alias("title")).filter("coalesce(title, '') = ''")
    return per_line.unionByName(untitled.select("name", F.lit(1).alias("line"), F.lit(NO_H1).alias("message")))


def links_of(lines: DataFrame) -> DataFrame:
    """``name, section_no, section, line, title, url, notes`` of the list items that parse."""
    section = F.last(F.when(F.col("level") == 2, F.col("heading")), True).over(Window.partitionBy("name").orderBy("line"))
    rows = lines.withColumn("section", section).filter(F.col("item").rlike(LIST_ITEM))
    part = lambda k: F.regexp_extract("item", LIST_ITEM, k)
    notes = X.trim(part(3))
    return rows.select("name", "section_no", "section", "line", X.trim(X.unescape(part(1))).alias("title"), part(2).alias("url"), F.when(notes != "", notes).alias("notes"))


def documents(lines: DataFrame) -> DataFrame:
    """``name, title, summary, details``: the parts above the sections."""
    quote = (F.col("stage") == "summary") & F.col("text").startswith(">")
    quotes = F.array_sort(F.collect_list(F.when(quote, F.struct("line", X.trim(F.regexp_replace("text", rf"^>{X.SPACE}?", "")).alias("q")))))
    detail = (F.col("stage") == "details") & (F.col("level") == 0)
    # Paragraphs are runs between blank lines.
    run = F.count(F.when(F.col("blank"), True)).over(Window.partitionBy("name").orderBy("line"))
    parts = lines.withColumn("run", run).filter(detail & ~F.col("blank")).groupBy("name", "run").agg(F.min("line").alias("line"), X.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")).alias("d"))
    details = parts.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "d"))), lambda x: x["d"]).alias("details"))
    heads = lines.groupBy("name").agg(F.coalesce(F.max(F.when(F.col("line") == F.col("title_line"), F.col("heading"))), F.lit("")).alias("title"), F.array_join(F.transform(quotes, lambda x: x["q"]), " ").alias("summary"))
    rows = heads.join(details, "name", "left")
    return rows.select("name", "title", F.when(F.col("summary") != "", F.col("summary")).alias("summary"), F.coalesce("details", F.array().cast("array<string>")).alias("details"))


def validate(files: DataFrame) -> DataFrame:
    """``name, n_issues``: 0 where a file conforms."""
    found = issues(read_lines(files)).groupBy("name").agg(F.count(F.lit(1)).alias("n_issues"))
    return files.select("name").join(found, "name", "left").select("name", F.coalesce("n_issues", F.lit(0)).alias("n_issues"))
