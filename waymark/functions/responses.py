"""What came back when a page was asked for, and how a run tells of it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from waymark.functions import words as W

BLOCK = "struct<kind:string,detail:string>"


def _block(kind: str, detail: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(detail).alias("detail"))


def _sample(body: Column) -> Column:
    return F.lower(F.left(F.coalesce(body, F.lit("")), F.lit(4000)))


def _marked(sample: Column) -> Column:
    return F.exists(F.array(*map(F.lit, W.CHALLENGE_MARKERS)), lambda m: F.contains(sample, m))


def detect_block(status: Column, headers: Column, body: Column) -> Column:
    """Whether a site refused a page, as kind and detail, or null. Words of a challenge count only where the status is a refusal."""
    sample = _sample(body)
    challenged = F.coalesce(headers["cf-mitigated"] == "challenge", F.lit(False)) | (status.isin(401, 403, 429, 503) & _marked(sample))
    return (
        F.when(challenged, _block("bot-challenge", "The site answered with an anti-bot challenge rather than the page."))
        .when((status == 401) | ((status == 403) & sample.rlike("sign in|log ?in|unauthorized")), _block("login-required", "The page is behind a sign-in."))
        .when(status == 403, _block("forbidden", "The site refused the request."))
        .when(status == 429, _block("rate-limited", "The site is rate limiting requests."))
    )


def classify_empty(body: Column, link_count: Column) -> Column:
    """A second look where nothing was found: a verification page that was served as a success."""
    sample = _sample(body)
    hit = _marked(sample) | sample.rlike("client challenge|are you a robot")
    return F.when((link_count == 0) & hit, _block("bot-challenge", "The site answered with a verification page instead of the page."))


def explain(kind: Column, url: Column) -> Column:
    host = F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")), F.lit("that site"))
    return (
        F.when(kind == "bot-challenge", F.concat(host, F.lit(" is behind an anti-bot challenge, so it serves a verification page instead of its content. A site that went to that trouble cannot be read by a program, and the challenge page is not something to describe as if it were the site.")))
        .when(kind == "login-required", F.concat(host, F.lit(" keeps that page behind a sign-in, so there is nothing public to read.")))
        .when(kind == "rate-limited", F.concat(host, F.lit(" is rate limiting us. Waiting a little and trying again usually works.")))
        .when(kind == "forbidden", F.concat(host, F.lit(" refused the request even when asked as a browser would.")))
    )


def adopt_rendered(plain_links: Column, rendered_links: Column) -> Column:
    """A rendered page replaces the plain one only if it shows more links."""
    return F.coalesce(rendered_links, F.lit(-1)) > plain_links


def render_failure(reason: Column, ms: Column, detail: Column) -> Column:
    seconds = F.floor(ms / 1000 + 0.5)
    return (
        F.when(reason == "no-browser", "no browser available to render with")
        .when(reason == "timeout", F.concat(F.lit("the page did not finish loading within "), seconds, F.lit("s")))
        .otherwise(detail)
    )


def access_gate(configured: Column, signed_in: Column) -> Column:
    return F.when(~configured, 503).when(~signed_in, 401).otherwise(200)


#: Stages of a run, their weights and labels.
STAGES = [
    ("fetching", 5, "Fetching the page"),
    ("rendering", 15, "Site needs a browser to read it - rendering the page"),
    ("checking-published", 5, "Checking whether the site already publishes an llms.txt"),
    ("crawling", 40, "Crawling the site"),
    ("summarizing", 5, "Writing the summary and section names"),
    ("annotating", 25, "Writing a note for each link"),
    ("saving", 5, "Saving the result"),
]


def describe_progress(stage: Column, done: Column, total: Column) -> Column:
    """struct(percent, label): counted stages by their share, the others at their half."""
    out, at = F.struct(F.lit(0).cast("long").alias("percent"), F.lit("Working").alias("label")), 0
    share = F.when(total > 0, F.least(F.lit(1.0), done / total)).otherwise(0.0)
    for name, weight, label in STAGES:
        counted = name in ("crawling", "annotating")
        part = share if counted else F.lit(0.5)
        text = F.lit(label)
        if counted:
            noun = "pages" if name == "crawling" else "groups"
            text = F.when(total > 0, F.concat(F.lit(label + " - "), done, F.lit(" of "), total, F.lit(f" {noun}"))).otherwise(text)
        out = F.when(stage == name, F.struct(F.floor(at + weight * part + 0.5).alias("percent"), text.alias("label"))).otherwise(out)
        at += weight
    return out
