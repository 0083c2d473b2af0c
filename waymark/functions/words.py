"""Word lists and patterns that results depend on, as text."""

STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "of", "to", "in", "on", "at", "for", "with", "from", "by", "is", "are", "was",
    "were", "be", "been", "our", "your", "their", "its", "it", "this", "that", "these", "those", "as", "how", "what",
    "why", "when", "all", "you", "we", "us", "about", "into", "more", "get", "getting", "new", "page", "home", "learn",
    "read",
]

MINOR_WORDS = [
    "a", "an", "the", "and", "or", "but", "for", "nor", "of", "on", "in", "to", "with", "at", "by", "from", "as", "per",
    "via",
]

ACRONYMS = [
    "api", "faq", "sdk", "cli", "ui", "ux", "ai", "llm", "seo", "url", "css", "html", "json", "rss", "cdn", "db",
]

LOCALES = [
    "en", "fr", "de", "es", "it", "ja", "zh", "ko", "pt", "ru", "nl", "pl", "tr", "vi", "id", "hi", "ar", "sv", "da",
    "no", "fi", "cs", "el", "he", "th", "uk",
]

#: The shorter list that names of sections are held against.
NAME_LOCALES = [
    "en", "fr", "de", "es", "it", "ja", "zh", "ko", "pt", "ru", "nl", "pl", "tr", "vi", "id", "hi", "ar",
]

FUNCTION_WORDS = [
    "the", "a", "an", "and", "or", "to", "for", "with", "of", "in", "on", "that", "your", "you", "it", "is", "are",
    "from", "by", "as",
]

CHROME_WORDS = (
    "nav|navbar|menu|header|footer|sidebar|side-?bar|breadcrumb|cookie|consent|banner|social|share|skip|toolbar|topbar|"
    "subscribe|newsletter|modal|popup|widget|pagination|toc|table-of-contents|on-this-page|related|advert|ads?"
)

#: Pages for the Optional section, as a page's own links are matched: without spaces.
OPTIONAL_PAGE = (
    "privacy|terms|tos|legal|cookie|gdpr|imprint|impressum|disclaimer|accessibility|careers?|jobs|press|media-?kit|"
    "changelog|archive|sitemap|login|log-?in|signin|sign-?up|register|account|cart|checkout|rss|feed"
)
#: The same as crawled pages are matched: with spaces.
OPTIONAL_CRAWL = (
    "privacy|terms|tos|legal|cookie|gdpr|imprint|impressum|disclaimer|accessibility|careers?|jobs|press|media-?kit|"
    "changelog|archive|sitemap|login|log[- ]?in|signin|sign[- ]?up|register|account|cart|checkout|rss|feed"
)

GENERIC_LABEL = r"^(home|menu|more|links?|pages?|site|main|other|misc|navigation|explore)$"

#: Tags and roles of page furniture.
CHROME_TAGS = ["nav", "header", "footer", "aside", "form"]
CHROME_ROLES = ["navigation", "banner"]
#: Tags that may hold the name of a group of links, and those that may hold an article.
HEADING_TAGS = ["h2", "h3", "h4", "h5", "h6", "summary", "strong", "legend", "button"]
ARTICLE_TAGS = ["article", "section", "div", "body"]

#: Link texts that point instead of naming.
DEICTIC = (
    r"^((this|that|these|those|the|our|it|here)(?![A-Za-z0-9_])|"
    r"(read|learn|find out|see|click|get started|start|continue|view|browse)(?![A-Za-z0-9_]).{0,20}$|"
    r".{0,12}(here|more|link)$)"
)

#: Suffixes in order, and what takes their place; the first that fits a word of over three letters is cut.
SUFFIXES = [
    ("ities$", "ity"),
    ("(?<=..)ies$", "y"),
    ("(?<=[sxz])es$|(?<=[cs]h)es$", ""),
    ("(?<!s)s$", ""),
    ("(?<=...)ing$", ""),
    ("(?<=...)ed$", ""),
]

#: Instructions before a label and furniture after it.
LABEL_LEAD = "explore|browse|view|see|discover|all|our|the"
LABEL_TRAIL = "pages?|links?|menu|section|navigation"

NON_PAGE = (
    r"\.(png|jpe?g|gif|svg|webp|avif|ico|css|js|mjs|json|xml|rss|atom|zip|gz|tgz|pdf|docx?|xlsx?|pptx?|mp[34]|webm|mov|woff2?|ttf|eot)$"
)

TRACKING = (
    r"^(utm_|hsa_|hstk_|gad_|vector_|_hs|ref$|referrer$|source$|fbclid$|gclid$|dclid$|gbraid$|wbraid$|msclkid$|twclid$|ttclid$|"
    r"igshid$|yclid$|epik$|mc_cid$|mc_eid$|s_kwcid$|li_fat_id$|.*_(source|medium|campaign|term|content)$)"
)

OPERATION_KEY = r"^(printable|mobileaction|veaction|redlink|useparsoid|diff|oldid|replytoc)$"
OPERATION_ACTION = r"^(edit|history|info|raw|purge|delete|watch|unwatch|render|submit|rollback|revert|credits)$"

CHALLENGE_MARKERS = [
    "challenge-platform", "_cf_chl", "cf-browser-verification", "just a moment", "attention required",
    "enable javascript and cookies", "checking your browser", "px-captcha", "/_incapsula_", "captcha-delivery",
]

ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–",
    "hellip": "…", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“",
}

#: White space as browsers see it; Java's \s is ASCII only.
SPACE = "\\s\\x0B\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def bounded(words: str) -> str:
    """``words`` between ASCII word boundaries; Java's \\b knows other letters as well."""
    return f"(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])"
