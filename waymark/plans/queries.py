"""Queries over the given tables, one or more for each operator, and the SQL each must match.

The pages table stands for a crawl: a site is a host, a page's place in the table is
its place in the site's sitemap. Where the data lack something (status codes, robots
rules, snapshots) a query derives it from ids by a rule that its SQL repeats.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from waymark.config import LIMITS
from waymark.functions import plain as L, responses as R, text as X, urls as U
from waymark.functions._udf import in_slices
from waymark.operators import curate as C, evaluation as V, extract as E, markdown as M, merge as G, monitor as N, proposals as P
from waymark.plans import crawl as K
from waymark.scratch import Scratch
from waymark.sources import html as H, robots as B, sitemaps as S, store as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- shared pieces of SQL ------------------------------------------------------------

HOST = r"lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"
PATH = r"regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
#: Canonical form of the addresses in the table: no fragment, no tracking keys, no closing slash.
CANON = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '[?&]+$', ''), '([^/])/$', '\1'), '^([a-z]+://[^/?]+)$', '\1/')"
)
_RAW_TITLE = r"replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"')"
TITLE = rf"trim(regexp_replace(regexp_replace(regexp_replace({_RAW_TITLE}, '\s+', ' ', 'g'), ' +([,.;:!?)\]])', '\1', 'g'), '([(\[]) +', '\1', 'g'))"
_PARTS = rf"list_filter(list_transform(regexp_split_to_array({TITLE}, '\s+[|–—·•-]\s+'), lambda p: trim(p)), lambda p: p <> '')"
#: A title without the site's name: the longest of its parts, the first of those.
OWN_TITLE = f"CASE WHEN len({_PARTS}) < 2 THEN {TITLE} ELSE list_filter({_PARTS}, lambda p: length(p) = list_max(list_transform({_PARTS}, lambda q: length(q))))[1] END"
SEGMENTS = f"list_filter(string_split({PATH}, '/'), lambda s: s <> '')"
STEM = (
    "CASE WHEN length(w) <= 3 THEN w WHEN w LIKE '%ities' THEN w[:-6] || 'ity' WHEN w LIKE '%ies' AND length(w) > 4 THEN w[:-4] || 'y' "
    "WHEN regexp_matches(w, '(s|x|z|ch|sh)es$') THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] "
    "WHEN w LIKE '%ing' AND length(w) >= 6 THEN w[:-4] WHEN w LIKE '%ed' AND length(w) >= 5 THEN w[:-3] ELSE w END"
)
TOKENS = "list_filter(regexp_split_to_array(replace(replace(lower({0}), '‘', ''''), '’', ''''), '[^a-z0-9'']+'), lambda t: t <> '')"
STOP = ", ".join(f"'{w}'" for w in X.W.STOPWORDS)
CONTENT = "list_transform(list_filter(" + TOKENS + f", lambda t: t NOT IN ({STOP})), lambda w: {STEM})"
SPACES = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


# -- scans, trees and page facts ---------------------------------------------------------


@query(f"SELECT page_id, {TITLE} AS title FROM pages WHERE {TITLE} <> ''")
def page_titles(spark, d):
    """First title of each page, from the node table."""
    return H.first_text(H.nodes(_table(spark, d, "pages")), "title").withColumnRenamed("text", "title")


@query(r"SELECT page_id, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS charset FROM pages WHERE html LIKE '%<meta charset=%'")
def page_meta_charset(spark, d):
    rows = H.nodes(_table(spark, d, "pages")).filter((F.col("tag") == "meta") & F.col("attrs")["charset"].isNotNull())
    return rows.select("page_id", F.col("attrs")["charset"].alias("charset"))


@query(
    r"""SELECT page_id, CAST(generate_subscripts(h, 1) AS BIGINT) AS n, unnest(h) AS href
    FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1) AS h FROM pages)"""
)
def anchor_list(spark, d):
    rows = H.anchors(H.nodes(_table(spark, d, "pages")))
    return rows.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")).cast("long").alias("n"), "href")


@query(r"SELECT tag, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '<!--[\s\S]*?-->', '', 'g'), '<(script|style)[^>]*>[\s\S]*?</(script|style)>', '<\1>', 'g'), '<([a-zA-Z][a-zA-Z0-9-]*)', 1))) AS tag FROM pages) GROUP BY tag")
def tag_histogram(spark, d):
    return H.nodes(_table(spark, d, "pages")).filter("kind = 'el'").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def host_page_counts(spark, d):
    return _table(spark, d, "pages").groupBy(U.host_of("url").alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""SELECT page_id, length(html) > 1200 AS truncated, regexp_matches(html, '(?i)^\s*<(!doctype|html)') AS html,
    left(html, 20) AS head FROM pages"""
)
def body_checks(spark, d):
    """Is a body HTML, and was it cut at a limit (here a small one)."""
    p = _table(spark, d, "pages")
    return p.select("page_id", H.is_truncated(F.col("html"), 1200).alias("truncated"), H.is_html(F.lit(None).cast("string"), F.col("html")).alias("html"), F.left("html", F.lit(20)).alias("head"))


_NO_RAW = r"regexp_replace(regexp_replace(html, '<!--[\s\S]*?-->', '', 'g'), '<(script|style)[^>]*>[\s\S]*?</(script|style)>', '', 'g')"


def _decoded_sql(text: str) -> str:
    """Entities by name, the ampersand last, so that what it makes is not read again."""
    for name, sign in [*((n, c) for n, c in X.W.ENTITIES.items() if n != "amp"), ("amp", "&")]:
        text = f"replace({text}, '&{name};', '" + sign.replace("'", "''") + "')"
    return text


def _tidy_sql(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({text}, '{SPACES}+', ' ', 'g'), ' +([,.;:!?)\]])', '\1', 'g'), '([(\[]) +', '\1', 'g'))"


_PIECES = rf"list_transform(list_filter(string_split(regexp_replace(seg, '<[^>]*>', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '{SPACES}+', '', 'g') <> ''), lambda x: {_decoded_sql('x')})"


@query(
    rf"""WITH h AS (SELECT page_id, {_NO_RAW} AS h FROM pages), s AS (SELECT page_id, tag, regexp_extract(h, '<' || tag || '[^>]*>([\s\S]*?)</' || tag || '>', 1) AS seg FROM h, (SELECT unnest(['nav', 'article', 'footer']) AS tag) WHERE contains(h, '<' || tag)),
    t AS (SELECT page_id, tag, length({_tidy_sql(f"array_to_string({_PIECES}, ' ')")}) AS chars, coalesce(list_sum(list_transform(regexp_extract_all(seg, '<a [^>]*>([^<]*)</a>', 1), lambda x: length({_tidy_sql(_decoded_sql('x'))}))), 0) AS link_chars FROM s)
    SELECT page_id, tag, CAST(chars AS INT) AS chars, CAST(link_chars AS BIGINT) AS link_chars, round(CASE WHEN chars = 0 THEN 1 ELSE least(1, link_chars / chars) END, 9) AS density FROM t"""
)
def node_link_density(spark, d):
    """Text, link text and density of each nav, article and footer, by interval joins within pages."""
    rows = H.link_density(H.nodes(_table(spark, d, "pages")), F.col("tag").isin("nav", "article", "footer"))
    return rows.select("page_id", "tag", "chars", "link_chars", F.round("density", 9).alias("density"))


@query(
    rf"""WITH h AS (SELECT page_id, regexp_replace({_NO_RAW}, '<nav>[\s\S]*?</nav>|<footer>[\s\S]*?</footer>|<div class="ad">[\s\S]*?</div>', '', 'g') AS h FROM pages)
    SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(h, '<(h1|h2|p)[ >]', 1)) AS tag FROM h) GROUP BY 1, 2"""
)
def content_outside_chrome(spark, d):
    """Headings and paragraphs that lie in no furniture."""
    table = H.nodes(_table(spark, d, "pages"))
    rows = table.filter(F.col("tag").isin("h1", "h2", "p")).select("page_id", "node_id", "tag")
    return H.outside_chrome(table, rows).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query()
def page_extractions(spark, d):
    """Each page's own site map."""
    return E.extractions(_table(spark, d, "pages")).select("page_id", "url", "extraction.*")


@query(
    f"""SELECT page_id, url AS page_url, url, {OWN_TITLE} AS title, nullif(regexp_extract(html, '<meta name=\"description\" content=\"([^\"]*)\"', 1), '') AS description, array_to_string(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1), ' ') AS links FROM pages"""
)
def page_metadata(spark, d):
    """What a crawl keeps of each page."""
    return E.page_meta(_table(spark, d, "pages")).withColumn("links", F.array_join("links", " "))


# -- addresses ---------------------------------------------------------------------------


@query(f"SELECT page_id, {CANON} AS canonical FROM pages")
def canonical_urls(spark, d):
    return _table(spark, d, "pages").select("page_id", U.canonicalize_url("url", "url").alias("canonical"))


@query(
    r"""SELECT key, regexp_matches(key, '^(utm_.*|ref)$') AS tracking, count(*) AS n
    FROM (SELECT unnest(list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: regexp_extract(p, '^([^=]*)', 1))) AS key FROM pages)
    GROUP BY 1, 2"""
)
def tracking_param_histogram(spark, d):
    keys = _table(spark, d, "pages").select(F.explode(U.query_keys("url")).alias("key"))
    return keys.groupBy("key", U.is_tracking("key").alias("tracking")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT page_id, array_to_string({SEGMENTS}, '|') AS raw, array_to_string(list_filter({SEGMENTS}, lambda s: s NOT IN ('en','fr','de','es')), '|') AS stripped FROM pages")
def path_segments_locale(spark, d):
    return _table(spark, d, "pages").select("page_id", F.array_join(U.raw_segments("url"), "|").alias("raw"), F.array_join(U.path_segments("url"), "|").alias("stripped"))


@query(
    r"""SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '') AS display, regexp_extract(url, '^([^?#]*)', 1) AS path_key,
    replace(replace(url || '(x y)', '(', '%28'), ')', '%29') AS u0, 1 AS one FROM pages""".replace("AS u0", "AS escaped").replace("replace(replace(url || '(x y)'", "replace(replace(replace(url || '(x y)', ' ', '%20')").replace(", 1 AS one", "")
)
def url_scalars(spark, d):
    return _table(spark, d, "pages").select("page_id", U.display_url("url").alias("display"), U.path_key("url").alias("path_key"), U.escape_url(F.concat("url", F.lit("(x y)"))).alias("escaped"))


IP = "concat_ws('.', CAST(o_orderkey % 256 AS VARCHAR), CAST((o_orderkey * 7) % 256 AS VARCHAR), CAST(o_custkey % 256 AS VARCHAR), CAST((o_custkey * 3) % 256 AS VARCHAR))"


@query(
    """SELECT o_orderkey, ip, a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) AS private
    FROM (SELECT o_orderkey, {0} AS ip, o_orderkey % 256 AS a, (o_orderkey * 7) % 256 AS b FROM orders)""".format(IP)
)
def private_addresses(spark, d):
    """Made-up addresses from order keys, held against the ranges that are not public."""
    part = lambda c: (c % 256).cast("string")
    ip = F.concat_ws(".", part(F.col("o_orderkey")), part(F.col("o_orderkey") * 7), part(F.col("o_custkey")), part(F.col("o_custkey") * 3))
    return _table(spark, d, "orders").select("o_orderkey", ip.alias("ip"), U.is_private_address(ip).alias("private"))


# -- text ----------------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)")
def token_counts(spark, d):
    rows = _table(spark, d, "documents").select("doc_id", X.tokenize("text").alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"SELECT stem, count(*) AS n FROM (SELECT unnest({CONTENT.format('text')}) AS stem FROM documents) GROUP BY stem")
def stem_distribution(spark, d):
    return X.stem_counts(_table(spark, d, "documents"), "text")


LINES = "lines AS (SELECT doc_id, n, l, coalesce(lag(l) OVER (PARTITION BY doc_id ORDER BY n), '') AS before FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS n FROM documents))"


def _compared(part: pa.RecordBatch) -> dict:
    rows = {name: [] for name in ("doc_id", "n", "l", "similarity", "coverage")}
    for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
        before: frozenset[str] = frozenset()
        for n, line in enumerate([] if text is None else text.split("\n"), 1):
            own = L.content_set(line)
            both = len(own & before)
            rows["doc_id"].append(doc)
            rows["n"].append(n)
            rows["l"].append(line)
            rows["similarity"].append(both / (len(own) + len(before) - both) if own and before else 0.0)
            rows["coverage"].append(both / len(own) if own else 1.0)
            before = own
    return rows


def _lines(spark, d) -> DataFrame:
    """``doc_id, n, l, similarity, coverage``: every line of every document, from 1, against the line before it.

    A line's words are taken once, for itself and for the next line: as expressions over arrays this was some
    microseconds for each word, twice.
    """
    rows = _table(spark, d, "documents").select("doc_id", "text")
    return in_slices(rows, "text", _compared, StructType([rows.schema["doc_id"], *StructType.fromDDL("n int, l string, similarity double, coverage double").fields]))


_OVERLAP = "CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END"
_COVERED = "CASE WHEN len(a) = 0 THEN 1 ELSE len(list_intersect(a, b)) / len(a) END"
_SETS = f"sets AS (SELECT *, list_distinct({CONTENT.format('l')}) AS a, list_distinct({CONTENT.format('before')}) AS b FROM lines)"


@query(f"WITH {LINES}, {_SETS} SELECT doc_id, n, round({_OVERLAP}, 9) AS similarity, round({_COVERED}, 9) AS coverage FROM sets")
def title_similarity(spark, d):
    """Each line of a document against the one before."""
    return _lines(spark, d).select("doc_id", "n", F.round("similarity", 9).alias("similarity"), F.round("coverage", 9).alias("coverage"))


@query(
    rf"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n, sha256(array_to_string(s, '|')) AS digest FROM (
      SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?]){SPACES}+([A-Z"(])', '\1' || chr(1) || '\2', 'g'), '([.!?]){SPACES}+([A-Z"(])', '\1' || chr(1) || '\2', 'g'), chr(1)),
        lambda x: regexp_replace(x, '^{SPACES}+|{SPACES}+$', '', 'g')), lambda x: x <> '') AS s FROM documents)"""
)
def sentence_split(spark, d):
    rows = _table(spark, d, "documents").select("doc_id", X.sentences("text").alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("digest"))


MINOR = ", ".join(f"'{w}'" for w in X.W.MINOR_WORDS)


@query(
    rf"""SELECT doc_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN regexp_matches(x, '^[A-Z0-9]{{2,}}$') THEN x WHEN i > 1 AND lower(x) IN ({MINOR}) THEN lower(x) ELSE replace(upper(x[1]), 'ẞ', 'SS') || x[2:] END), ' ') AS title
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACES}+'), lambda x: x <> '') AS w FROM documents)"""
)
def title_cased(spark, d):
    return _table(spark, d, "documents").select("doc_id", X.title_case("text").alias("title"))


ACR = ", ".join(f"'{w}'" for w in X.W.ACRONYMS)


@query(
    rf"""SELECT page_id, array_to_string(list_transform(w, lambda x: CASE WHEN lower(x) IN ({ACR}) THEN upper(x) WHEN lower(x) LIKE '%s' AND lower(x)[:-2] IN ({ACR}) THEN upper(x[:-2]) || 's' ELSE upper(x[1]) || x[2:] END), ' ') AS name
    FROM (SELECT page_id, list_filter(regexp_split_to_array(regexp_replace('api-' || replace(regexp_extract({HOST}, '([a-z-]+)\.example', 1), '.', '-') || '_sdks.html', '(?i)\.[a-z0-9]+$', ''), '[-_]+'), lambda x: x <> '') AS w FROM pages)"""
)
def humanized_hosts(spark, d):
    host = F.regexp_extract(U.host_of("url"), r"([a-z-]+)\.example", 1)
    slug = F.concat(F.lit("api-"), F.replace(host, F.lit("."), F.lit("-")), F.lit("_sdks.html"))
    return _table(spark, d, "pages").select("page_id", X.humanize(slug).alias("name"))


@query("SELECT doc_id, left(sha256(text), 32) AS digest FROM documents")
def content_hash_docs(spark, d):
    return _table(spark, d, "documents").select("doc_id", X.hash_content("text").alias("digest"))


@query(
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '{SPACES}+', ' ', 'g'), '([\[\]\\])', '\\\1', 'g')) AS link_text,
    CASE WHEN length(text) > 160 THEN regexp_replace(left(text, 160), '{SPACES}+$', '') || '…' ELSE text END AS note FROM documents"""
)
def escapes(spark, d):
    return _table(spark, d, "documents").select("doc_id", X.escape_link_text("text").alias("link_text"), X.truncate_note("text").alias("note"))


@query(
    """SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min ago' WHEN h < 24 THEN h || 'h ago' ELSE CAST(floor(h / 24 + 0.5) AS BIGINT) || 'd ago' END AS age, due
    FROM (SELECT event_id, m, CAST(floor(m / 60 + 0.5) AS BIGINT) AS h, due FROM (
      SELECT event_id, CAST(greatest(0, floor((epoch_ms(TIMESTAMP '2024-02-01') - epoch_ms(ts)) / 60000 + 0.5)) AS BIGINT) AS m,
             ts IS NULL OR epoch_ms(TIMESTAMP '2024-02-01') - epoch_ms(ts) >= 6 * 3600000 AS due FROM events))"""
)
def ages_and_due(spark, d):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    return _table(spark, d, "events").select("event_id", X.age_label(ts, now).alias("age"), N.is_due(ts.cast("string"), now).alias("due"))


STAGE_SQL = " ".join(f"WHEN {n} THEN '{s}'" for n, (s, _, _) in enumerate(R.STAGES))


def _progress_sql() -> str:
    at, cases = 0, []
    for name, weight, label in R.STAGES:
        if name in ("crawling", "annotating"):
            share = "CASE WHEN total > 0 THEN least(1.0, done / total) ELSE 0.0 END"
            noun = "pages" if name == "crawling" else "groups"
            text = f"CASE WHEN total > 0 THEN '{label} - ' || done || ' of ' || total || ' {noun}' ELSE '{label}' END"
        else:
            share, text = "0.5", f"'{label}'"
        cases.append((name, f"CAST(floor({at} + {weight} * ({share}) + 0.5) AS BIGINT)", text))
        at += weight
    percent = " ".join(f"WHEN '{n}' THEN {p}" for n, p, _ in cases)
    label = " ".join(f"WHEN '{n}' THEN {t}" for n, _, t in cases)
    return f"""SELECT id, CASE stage {percent} END AS percent, CASE stage {label} END AS label FROM (
      SELECT o_orderkey AS id, CASE o_orderkey % 7 {STAGE_SQL} END AS stage, o_orderkey % 11 AS done, o_custkey % 9 AS total FROM orders)"""


@query(_progress_sql())
def progress_labels(spark, d):
    names = F.array(*[F.lit(s) for s, _, _ in R.STAGES])
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.get(names, (F.col("o_orderkey") % 7).cast("int")).alias("stage"), (F.col("o_orderkey") % 11).alias("done"), (F.col("o_custkey") % 9).alias("total"))
    return rows.select("id", R.describe_progress(F.col("stage"), F.col("done"), F.col("total")).alias("p")).select("id", "p.percent", "p.label")


@query("SELECT o_custkey, list_sort(list(o_orderkey))[count(*) // 2 + 1] AS middle, count(*) AS n FROM orders GROUP BY o_custkey")
def upper_medians(spark, d):
    """The middle order of each customer, as the median of a few runs is taken."""
    return _table(spark, d, "orders").groupBy("o_custkey").agg(V.upper_median("o_orderkey").alias("middle"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT round(avg(quality), 9) AS quality, round(avg(toxic), 9) AS toxic, round(avg(quality + toxic), 9) AS total,
    (SELECT round(avg(abs(quality - doc_id % 2) + abs(toxic - doc_id % 3)), 9) FROM labels) AS noise FROM labels"""
)
def judgement_means(spark, d):
    """Labels as two axes of a judgement; a second judgement is made up from ids."""
    rows = _table(spark, d, "labels").withColumn("q2", F.col("doc_id") % 2).withColumn("t2", F.col("doc_id") % 3)
    noise = rows.agg(F.round(V.judge_noise(["quality", "toxic"], ["q2", "t2"]), 9).alias("noise"))
    means = V.axis_means(rows, ["quality", "toxic"])
    return means.select(*[F.round(c, 9).alias(c) for c in means.columns]).join(noise)


# -- responses ---------------------------------------------------------------------------------

MARK = " OR ".join(f"contains(s, '{m}')" for m in X.W.CHALLENGE_MARKERS)


@query(
    f"""SELECT page_id, CASE WHEN page_id % 13 = 0 OR (status IN (401, 403, 429, 503) AND ({MARK})) THEN 'bot-challenge'
      WHEN status = 401 OR (status = 403 AND regexp_matches(s, 'sign in|log ?in|unauthorized')) THEN 'login-required'
      WHEN status = 403 THEN 'forbidden' WHEN status = 429 THEN 'rate-limited' END AS kind
    FROM (SELECT page_id, [200, 401, 403, 429, 503, 403][1 + CAST(page_id % 6 AS INT)] AS status,
      lower(left(CASE WHEN page_id % 5 = 0 THEN 'Just a moment ' WHEN page_id % 5 = 1 THEN 'Please LOG IN ' ELSE '' END || html, 4000)) AS s FROM pages)"""
)
def block_classification(spark, d):
    """Statuses and words of refusals put on the pages by id."""
    p = _table(spark, d, "pages")
    status = F.get(F.array(*map(F.lit, (200, 401, 403, 429, 503, 403))), (F.col("page_id") % 6).cast("int"))
    lead = F.when(F.col("page_id") % 5 == 0, "Just a moment ").when(F.col("page_id") % 5 == 1, "Please LOG IN ").otherwise("")
    headers = F.when(F.col("page_id") % 13 == 0, F.create_map(F.lit("cf-mitigated"), F.lit("challenge"))).otherwise(F.create_map(F.lit("server"), F.lit("x")))
    return p.select("page_id", R.detect_block(status, headers, F.concat(lead, F.col("html")))["kind"].alias("kind"))


@query(
    f"""SELECT page_id, kind, CASE kind WHEN 'login-required' THEN {HOST} || ' keeps that page behind a sign-in, so there is nothing public to read.'
      WHEN 'rate-limited' THEN {HOST} || ' is rate limiting us. Waiting a little and trying again usually works.' ELSE {HOST} || ' refused the request even when asked as a browser would.' END AS said
    FROM (SELECT page_id, url, ['login-required', 'rate-limited', 'forbidden'][1 + CAST(page_id % 3 AS INT)] AS kind FROM pages)"""
)
def block_explanations(spark, d):
    kind = F.get(F.array(*map(F.lit, ("login-required", "rate-limited", "forbidden"))), (F.col("page_id") % 3).cast("int"))
    return _table(spark, d, "pages").select("page_id", kind.alias("kind"), R.explain(kind, F.col("url")).alias("said"))


@query(
    """SELECT status, CASE WHEN status = 402 THEN 'credits' WHEN status = 429 THEN 'rate-limited' WHEN status IN (401, 403) THEN 'auth' WHEN status >= 500 THEN 'upstream' ELSE 'unknown' END AS kind,
    status = 429 OR status >= 500 AS retryable, status IN (401, 402, 403) AS fatal, count(*) AS n FROM (SELECT 395 + o_orderkey % 120 AS status FROM orders) GROUP BY 1, 2, 3, 4"""
)
def failure_kinds(spark, d):
    rows = _table(spark, d, "orders").select((395 + F.col("o_orderkey") % 120).alias("status"))
    kind = P.failure_kind(F.col("status"))
    return rows.groupBy("status", kind.alias("kind"), P.is_retryable(kind).alias("retryable"), P.is_fatal(kind).alias("fatal")).agg(F.count(F.lit(1)).alias("n"))


# -- discovery and planning ----------------------------------------------------------------------


@query(
    f"""SELECT site, url, inbound, rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY inbound DESC, url) AS rank
    FROM (SELECT site, url, count(*) AS inbound FROM (
      SELECT {HOST} AS site, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || array_to_string(list_transform(string_split(regexp_replace(h, '^(.+)/$', '\\1'), ''), lambda c: CASE WHEN ord(c) > 127 THEN url_encode(c) ELSE c END), '') AS url
      FROM (SELECT url, unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) AS h FROM pages)) GROUP BY 1, 2)) WHERE rank <= 10"""
)
def link_inbound_topk(spark, d):
    """The ten most linked addresses of each site: parse, resolve, count, rank."""
    counts = K.linked_addresses(H.hrefs(_table(spark, d, "pages")))
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.col("inbound").desc(), "url"))
    return counts.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= 10)


def _candidates(spark, d) -> DataFrame:
    """A site's pages as its sitemap: canonical addresses, each as often as the table has it."""
    rows = _table(spark, d, "pages").select(U.host_of("url").alias("site"), U.canonicalize_url("url", "url").alias("url"), F.col("page_id").alias("sitemap_position"), F.col("page_id").alias("ord"))
    return K.candidates_from(rows)


CANDIDATES = f"""candidates AS (SELECT site, url, min(page_id) AS pos, count(*) AS inbound, {SEGMENTS} AS seg FROM (SELECT page_id, {HOST} AS site, {CANON} AS url FROM pages) GROUP BY site, url)"""
QUOTAS = """sizes AS (SELECT site, coalesce(seg[1], '') AS section, count(*) AS size FROM candidates GROUP BY 1, 2),
s1 AS (SELECT *, count(*) OVER (PARTITION BY site) AS sections, sum(size) OVER (PARTITION BY site) AS total, row_number() OVER (PARTITION BY site ORDER BY size DESC, section) AS by_size FROM sizes),
s2 AS (SELECT *, floor(({0} - sections) * size / total) AS whole, ({0} - sections) * size / total - floor(({0} - sections) * size / total) AS rest FROM s1),
s3 AS (SELECT *, {0} - sections - sum(whole) OVER (PARTITION BY site) AS spare, row_number() OVER (PARTITION BY site ORDER BY rest DESC, section) AS by_rest FROM s2),
quotas AS (SELECT site, section, size, CAST(CASE WHEN sections >= {0} THEN CASE WHEN by_size <= {0} THEN 1 ELSE 0 END ELSE 1 + whole + CASE WHEN by_rest <= spare THEN 1 ELSE 0 END END AS BIGINT) AS quota FROM s3)"""


@query(f"WITH {CANDIDATES}, {QUOTAS.format(10)} SELECT site, section, size, quota FROM quotas")
def section_quota(spark, d):
    """Slots of a crawl of ten pages by section. The SQL has the same arithmetic; a test has a loop."""
    sizes = K.rank_candidates(_candidates(spark, d)).groupBy("site", "section").agg(F.count(F.lit(1)).alias("size"))
    return K.section_quotas(sizes, 10)


@query(
    f"""WITH {CANDIDATES}, {QUOTAS.format(10)},
ranked AS (SELECT c.*, coalesce(seg[1], '') AS section, row_number() OVER (PARTITION BY site, coalesce(seg[1], '') ORDER BY inbound DESC, len(seg), pos, url) AS nth FROM candidates c),
met AS (SELECT r.site, r.url, r.section, nth > quota AS beyond, CASE WHEN nth > quota THEN nth - least(quota, size) ELSE nth END AS turn FROM ranked r JOIN quotas q ON r.site = q.site AND r.section = q.section),
placed AS (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY beyond, turn, section) AS plan_pos FROM met)
SELECT site, plan_pos, url FROM placed WHERE plan_pos <= 10"""
)
def crawl_plan(spark, d):
    return K.plan(_candidates(spark, d), 10).withColumn("plan_pos", F.col("plan_pos").cast("long"))


@query()
def crawl_waves(spark, d):
    """Waves over the corpus from each site's first page, its pages as sitemap."""
    pages = _table(spark, d, "pages")
    sites = pages.withColumn("site", U.host_of("url"))
    seeds = sites.groupBy("site").agg(F.min_by("url", "page_id").alias("url"))
    order = F.row_number().over(Window.partitionBy("site").orderBy("page_id")) - 1
    listed = sites.select("site", "url", order.alias("position"))
    return K.crawl(pages, seeds, listed).select("site", "wave", "plan_pos", "page_id", "url", "title", F.size("links").alias("n_links"))


ROBOTS = "User-agent: *\nDisallow: /\n\nUser-agent: waymark\nUser-agent: other\nDisallow: /en/\nAllow: /en/1\nDisallow: /*.html$\nAllow: /fr/ # comment\nDisallow: /fr/\nCrawl-delay: 30\nSitemap: https://x.example/sitemap.xml\n"


@query(
    rf"""SELECT page_id, path, CASE WHEN regexp_matches(path, '^/.*\.html$') AND NOT (path LIKE '/en/1%' AND 5 > 8) THEN false WHEN path LIKE '/en/1%' THEN true WHEN path LIKE '/en/%' THEN false ELSE true END AS allowed
    FROM (SELECT page_id, {PATH} AS path FROM pages)"""
)
def robots_allowed(spark, d):
    """Pages' paths under one robots.txt on every site: the longest rule decides, allow on a tie."""
    pages = _table(spark, d, "pages").select("page_id", U.host_of("url").alias("site"), U.path_of("url").alias("path"))
    texts = pages.select("site").distinct().withColumn("text", F.lit(ROBOTS))
    return B.allowed(pages, B.rules(B.lines(texts))).select("page_id", "path", "allowed")


@query(f"SELECT {HOST} AS site, url, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1 AS position FROM pages")
def sitemap_entries(spark, d):
    """Sitemaps made of each site's pages, behind an index, and read back."""
    pages = _table(spark, d, "pages").withColumn("site", U.host_of("url"))
    loc = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", loc.alias("x")))), lambda s: s["x"]), "")
    maps = pages.groupBy("site").agg(body.alias("b")).select("site", F.lit("a.xml").alias("sitemap_url"), F.concat(F.lit("<urlset>"), "b", F.lit("</urlset>")).alias("text"))
    index = maps.select("site", F.lit("index.xml").alias("sitemap_url"), F.lit("<sitemapindex><loc>missing.xml</loc><loc>a.xml</loc></sitemapindex>").alias("text"))
    return S.read_sitemaps(maps.unionByName(index), most_children=None).filter("sitemap_url = 'index.xml'").select("site", "url", F.col("position").cast("long").alias("position"))


@query(
    f"""SELECT page_id, 'https://' || h || '/' || s || '/llms.txt|https://' || h || '/llms.txt' AS published, 'https://' || h || '/sitemap.xml' AS sitemaps
    FROM (SELECT page_id, {HOST} AS h, {SEGMENTS}[1] AS s FROM pages)"""
)
def well_known_candidates(spark, d):
    p = _table(spark, d, "pages")
    origin = F.concat(F.lit("https://"), U.host_of("url"))
    none = F.lit(None).cast("string")
    return p.select("page_id", F.array_join(S.published_candidates(origin, U.path_of("url"), none), "|").alias("published"), F.array_join(S.sitemap_candidates(origin, F.array().cast("array<string>")), "|").alias("sitemaps"))


# -- site maps ---------------------------------------------------------------------------------------


def _pages_as_links(spark, d) -> DataFrame:
    """``site, ord, url, title, description``: each site's pages at their canonical address, the first of each path."""
    # Written once: pages are parsed here and the rows are read by several branches.
    meta = Scratch(spark, "page-meta").keep(E.page_meta(_table(spark, d, "pages")).drop("links"), "meta")
    rows = meta.select("page_id", U.host_of("page_url").alias("site"), U.canonicalize_url("page_url", "page_url").alias("url"), "title", "description")
    return C.first_wins(rows.withColumn("k", U.path_key("url")).withColumnRenamed("page_id", "ord"), ["site", "k"]).drop("k")


LINKS = f"""links AS (SELECT site, page_id AS ord, url, title, seg FROM (
  SELECT *, row_number() OVER (PARTITION BY site, regexp_extract(url, '^([^?#]*)', 1) ORDER BY page_id) AS n
  FROM (SELECT page_id, {HOST} AS site, {CANON} AS url, {OWN_TITLE} AS title, {SEGMENTS} AS seg FROM pages)) WHERE n = 1)"""


@query(
    """WITH t AS (SELECT user_id, count(*) AS n_pages FROM events GROUP BY user_id), v AS (SELECT user_id, event_type AS value, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT CAST(user_id AS VARCHAR) AS site, value, n, n_pages FROM v JOIN t USING (user_id) WHERE n >= greatest(3, ceil(n_pages * 0.2))"""
)
def repeated_values(spark, d):
    """What a user does in a fifth of the events, as a site says its template's words."""
    rows = _table(spark, d, "events").select(F.col("user_id").cast("string").alias("site"), "event_type")
    return G.repeated(rows, "event_type")


@query(
    f"""WITH {LINKS}, deep AS (SELECT site, seg[1] AS k0, seg[least(2, len(seg) - 1)] AS k1 FROM links WHERE len(seg) > 1),
    tops AS (SELECT site, k0, count(*) AS n FROM deep GROUP BY 1, 2),
    agg AS (SELECT site, count(DISTINCT k0) AS shallow, count(DISTINCT k1) AS deeper, count(*) AS n FROM deep GROUP BY site),
    depths AS (SELECT l.site, CASE WHEN (shallow <= 1 AND deeper > 1) OR (n >= 5 AND (SELECT max(n) FROM tops t WHERE t.site = l.site) >= 0.6 * n AND deeper > shallow) THEN 1 ELSE 0 END AS depth
      FROM (SELECT DISTINCT site FROM links) l LEFT JOIN agg USING (site))
    SELECT l.site, l.url, depth, CASE WHEN len(seg) <= 1 THEN '' ELSE seg[least(depth, len(seg) - 2) + 1] END AS section_key FROM links l JOIN depths USING (site)"""
)
def section_groups(spark, d):
    """Depth and group of each link, here with locales left in so that there are groups."""
    rows = _pages_as_links(spark, d).withColumn("segments", U.raw_segments("url"))
    depth = C.choose_depth(rows)
    return rows.join(depth, "site").select("site", "url", "depth", C.group_key(F.col("segments"), F.col("depth")).alias("section_key"))


def _curated(spark, d) -> DataFrame:
    rows = _pages_as_links(spark, d).withColumn("section_key", F.element_at(U.raw_segments("url"), 1)).withColumn("note", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("About "), "title")))
    rows = rows.withColumn("section", X.title_case("section_key"))
    order = C.order_sections(rows).select("site", "section", "section_ord")
    return C.curate(rows.join(order, ["site", "section"]))


CURATED = f"""{LINKS}, noted AS (SELECT site, ord, url, title, seg[1] AS key, upper(seg[1][1]) || seg[1][2:] AS section, CASE WHEN ord % 3 = 0 THEN 'About ' || title END AS note FROM links),
sized AS (SELECT *, count(*) OVER (PARTITION BY site, key) AS n, min(ord) OVER (PARTITION BY site, key) AS first FROM noted),
secs AS (SELECT *, dense_rank() OVER (PARTITION BY site ORDER BY -n, first) AS so FROM sized),
folded AS (SELECT *, n = 1 AS orphan, CASE WHEN n = 1 THEN 1000000 ELSE so END AS so2, CASE WHEN n = 1 THEN 'Pages' ELSE section END AS sec FROM secs),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY site ORDER BY so2) AS nth FROM folded),
lim AS (SELECT *, row_number() OVER (PARTITION BY site, nth ORDER BY note IS NULL, so, ord) AS lo FROM ranked WHERE nth <= 12),
bud AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY nth, lo) AS b FROM lim WHERE lo <= 25),
curated AS (SELECT site, sec AS section, nth - 1 AS section_ord, lo - 1 AS link_ord, url, title, note FROM bud WHERE b <= 150)"""


@query(f"WITH {CURATED} SELECT * FROM curated")
def curated_links(spark, d):
    """Orphans folded, sections ordered, limits kept, notes first; every third page has a note."""
    c = _curated(spark, d)
    return c.select("site", "section", F.col("section_ord").cast("long").alias("section_ord"), F.col("link_ord").cast("long").alias("link_ord"), "url", "title", "note")


@query(f"WITH {CURATED} SELECT site, section, url, (row_number() OVER (PARTITION BY site, section_ord ORDER BY link_ord) - 1) // 10 AS chunk_no FROM curated")
def link_chunks(spark, d):
    return C.chunk_links(_curated(spark, d)).select("site", "section", "url", F.col("chunk_no").cast("long").alias("chunk_no"))


@query(
    f"""WITH {CURATED} SELECT site, section, section_ord, array_to_string(list(title ORDER BY link_ord)[1:6], ', ') || CASE WHEN count(*) > 6 THEN ', ...' ELSE '' END AS sample FROM curated GROUP BY 1, 2, 3"""
)
def section_skeletons(spark, d):
    return C.skeleton(_curated(spark, d)).withColumn("section_ord", F.col("section_ord").cast("long"))


@query(
    f"""WITH {CURATED}, lines AS (SELECT site, section_ord, section, '## ' || section || chr(10) || chr(10) || string_agg('- [' || trim(regexp_replace(regexp_replace(title, '{SPACES}+', ' ', 'g'), '([\\[\\]\\\\])', '\\\\\\1', 'g')) || '](' || url || ')' || CASE WHEN coalesce(note, '') = '' THEN '' ELSE ': ' || trim(regexp_replace(note, '{SPACES}+', ' ', 'g')) END, chr(10) ORDER BY link_ord) || chr(10) AS block FROM curated GROUP BY 1, 2, 3)
    SELECT site, sha256('# ' || site || chr(10) || chr(10) || '> All of ' || site || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY section_ord)) AS digest FROM lines GROUP BY site"""
)
def rendered_maps(spark, d):
    links = _curated(spark, d)
    heads = links.select("site").distinct().select("site", F.concat(F.lit("https://"), "site", F.lit("/")).alias("home_url"), F.col("site").alias("site_name"), F.concat(F.lit("All of "), "site").alias("summary"), F.array().cast("array<string>").alias("prose"), F.lit(False).alias("client_rendered"))
    return M.render(heads, links).select("site", F.sha2("llms_txt", 256).alias("digest"))


@query(f"WITH {LINKS} SELECT DISTINCT site, 0 AS n_issues FROM links")
def rendered_maps_conform(spark, d):
    """What is rendered parses without an issue."""
    links = _curated(spark, d)
    heads = links.select("site").distinct().select("site", F.concat(F.lit("https://"), "site", F.lit("/")).alias("home_url"), F.col("site").alias("site_name"), F.lit(None).cast("string").alias("summary"), F.array(F.lit("# not a heading")).alias("prose"), F.lit(False).alias("client_rendered"))
    files = M.render(heads, links).select(F.col("site").alias("name"), F.col("llms_txt").alias("text"))
    return M.validate(files).select(F.col("name").alias("site"), F.col("n_issues").cast("int").alias("n_issues"))


@query(
    rf"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)
    SELECT doc_id, count(*) FILTER (WHERE regexp_replace(l, '{SPACES}+$', '') <> '') + 1 AS n_issues FROM lines GROUP BY doc_id"""
)
def prose_is_no_map(spark, d):
    """Documents read as site maps: no title, so every line that says something comes too early."""
    files = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), "text")
    return M.validate(files).select(F.col("name").cast("long").alias("doc_id"), F.col("n_issues").cast("long").alias("n_issues"))


@query(
    rf"""SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9_])({X.W.OPTIONAL_CRAWL})($|[^a-z0-9_])') OR doc_id % 50 = 0 AS optional FROM documents"""
)
def optional_router(spark, d):
    """Titles that send a page to the Optional section; every fiftieth path does."""
    path = F.when(F.col("doc_id") % 50 == 0, "/legal/sign-up").otherwise("/x/legalese")
    return _table(spark, d, "documents").select("doc_id", X.is_optional(path, F.col("text")).alias("optional"))


@query(
    rf"""WITH {LINES}, cleaned AS (SELECT doc_id, n, regexp_replace(trim(regexp_replace(l, '{SPACES}+', ' ', 'g')), '([.]|{SPACES})+$', '') AS l, before FROM lines), {_SETS.replace('FROM lines', 'FROM cleaned')}
    SELECT doc_id, n, CASE WHEN length(l) >= 10 AND len(regexp_split_to_array(l, '{SPACES}+')) <= 12 AND NOT contains(l, '](') AND len(a) > 0 AND {_COVERED} <= 0.75 THEN l END AS note FROM sets"""
)
def accepted_notes(spark, d):
    """Each line of a document offered as a note for the one before."""
    return _lines(spark, d).select("doc_id", "n", P.accept_note(F.col("l"), covered=F.col("coverage")).alias("note"))


@query(
    rf"""WITH {LINES}, cleaned AS (SELECT doc_id, n, trim(regexp_replace(l, '{SPACES}+', ' ', 'g')) AS l, before FROM lines), {_SETS.replace('FROM lines', 'FROM cleaned')}
    SELECT doc_id, n, CASE WHEN length(l) BETWEEN 20 AND 200 AND NOT regexp_matches(l, 'https?://') AND {_OVERLAP} <= 0.8 THEN l END AS summary FROM sets"""
)
def accepted_summaries(spark, d):
    """Each line offered as a summary of what the one before names: a repeated line says no more."""
    return _lines(spark, d).select("doc_id", "n", P.accept_summary(F.col("l"), alike=F.col("similarity")).alias("summary"))


# -- monitoring and the store ----------------------------------------------------------------------------

STRUCTURE = "SELECT site, left(sha256(site || chr(10) || string_agg(e, chr(10) ORDER BY e)), 32) AS structure_hash FROM (SELECT site, url || chr(9) || title AS e FROM links{0}) GROUP BY site"


def _structure(rows: DataFrame) -> DataFrame:
    return N.structure_hash(rows.select("site").distinct().withColumn("site_name", F.col("site")), rows)


@query(f"WITH {LINKS} {STRUCTURE.format('')}")
def structure_hash_by_site(spark, d):
    return _structure(_pages_as_links(spark, d))


@query(f"SELECT site, left(sha256(string_agg(url, chr(10) ORDER BY url)), 32) AS sitemap_hash FROM (SELECT {HOST} AS site, url FROM pages) GROUP BY site")
def sitemap_hash_by_site(spark, d):
    return N.sitemap_hash(_table(spark, d, "pages").select(U.host_of("url").alias("site"), "url"))


@query(
    f"""WITH {LINKS}, old AS ({STRUCTURE.format(' WHERE ord % 40 <> 0')}), new AS ({STRUCTURE.format('')}),
    c AS (SELECT site, old.structure_hash AS o, new.structure_hash AS n, row_number() OVER (PARTITION BY o IS NOT DISTINCT FROM n OR o IS NULL ORDER BY site) AS k FROM new LEFT JOIN old USING (site))
    SELECT site AS url, CASE WHEN o = n THEN 'unchanged' WHEN o IS NULL THEN 'baseline' WHEN k <= 2 THEN 'changed' ELSE 'deferred' END AS result,
      o IS NOT NULL AND o <> n AND k <= 2 AS changed, CASE WHEN o <> n AND k > 2 THEN o ELSE n END AS structure_hash FROM c"""
)
def snapshot_diff(spark, d):
    """The sites as they were without every fortieth page, checked against what they are now."""
    rows = _pages_as_links(spark, d)
    now = _structure(rows)
    stored = now.select("site").join(_structure(rows.filter("ord % 40 <> 0")), "site", "left").select(
        F.col("site").alias("url"), F.lit("generated").alias("source"), F.lit(None).cast("string").alias("content_hash"), "structure_hash", F.lit(None).cast("string").alias("sitemap_hash"), F.lit(None).cast("timestamp").alias("last_checked_at")
    )
    current = now.select(F.col("site").alias("url"), F.lit(None).cast("string").alias("sitemap_hash"), "structure_hash", F.lit(True).alias("usable"), F.lit(None).cast("string").alias("published_text"))
    return N.check(stored, current).select("url", "result", "changed", "structure_hash")


def _generations(spark, d) -> DataFrame:
    return _table(spark, d, "pages").select("url", F.col("html").alias("llms_txt"), F.timestamp_seconds(1_700_000_000 + F.col("page_id") * 60).alias("generated_at"), F.when(F.col("page_id") % 4 > 0, F.timestamp_seconds(1_700_000_000 + F.col("page_id") * 977 % 50_000)).alias("last_checked_at"), F.lit(None).cast("timestamp").alias("changed_at"), F.lit("generated").alias("source"))


@query("SELECT url FROM pages ORDER BY page_id DESC, url LIMIT 100")
def latest_files(spark, d):
    """A top list: the hundred newest rows of the store."""
    return T.list_latest(_generations(spark, d)).select("url")


@query(
    """SELECT url FROM (SELECT url, page_id, CASE WHEN page_id % 4 > 0 THEN 1700000000 + page_id * 977 % 50000 END AS seen FROM pages ORDER BY seen ASC NULLS FIRST, url LIMIT 80)
    WHERE seen IS NULL OR 1700040000 - seen >= 21600 ORDER BY seen ASC NULLS FIRST, url LIMIT 40"""
)
def due_files(spark, d):
    """A run's worth of rows that are due, the longest unchecked first."""
    return N.due_rows(_generations(spark, d), F.timestamp_seconds(F.lit(1_700_040_000))).select("url")


@query(r"SELECT page_id FROM pages WHERE contains(lower(regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '')), 'blog') AND contains(lower(url), 'example.c')")
def catalog_search(spark, d):
    return _table(spark, d, "pages").filter(T.matches_address(F.col("url"), F.lit("  example.C BLOG "))).select("page_id")


@query("""SELECT '{"stage":"crawling","done":' || page_id || ',"total":250}' AS value FROM pages""")
def progress_ndjson(spark, d):
    rows = _table(spark, d, "pages").select(F.col("page_id").alias("seq"), F.lit("crawling").alias("stage"), F.col("page_id").alias("done"), F.lit(250).alias("total"))
    return T.to_ndjson(rows, "seq")


@query()
def site_maps(spark, d):
    """The whole run: a home page's links and its site's pages merged, grouped, limited, rendered."""
    pages = _table(spark, d, "pages").withColumn("site", U.host_of("url"))
    homes = pages.join(pages.groupBy("site").agg(F.min("page_id").alias("page_id")), ["site", "page_id"]).select("page_id", "url", "html", "site")
    found = Scratch(spark, "extractions").keep(E.extractions(homes).withColumn("site", U.host_of("url")), "homes")
    home_links = E.site_links(found, "site").filter("section_ord >= 0").select("site", (F.col("section_ord") * 1000 + F.col("link_ord")).cast("long").alias("ord"), "url", "title", "note")
    heads = found.select("site", F.col("url").alias("home_url"), "extraction.site_name", "extraction.summary", "extraction.prose", "extraction.client_rendered")
    crawled = _pages_as_links(spark, d)
    links = G.build_from_crawl(home_links, crawled, heads)
    return M.render(heads, links)


FLAGSHIP = link_inbound_topk
