"""Addresses: parsing as browsers do it, one canonical form for a page, and parts of it.

Resolving and canonicalising need a URL parser, so they run in Arrow-batched UDFs;
what starts from a canonical address is built from column expressions.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import parse_qsl, quote, unquote, urlencode

import pandas as pd
from pyspark.sql import Column, functions as F

from waymark.functions._udf import batched
from waymark.functions import words as W
from waymark.functions.text import _c

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_NON_PAGE = re.compile(W.NON_PAGE, re.I)
_TRACKING = re.compile(W.TRACKING, re.I | re.S)
_OPERATION_KEY = re.compile(W.OPERATION_KEY, re.I)
_OPERATION_ACTION = re.compile(W.OPERATION_ACTION, re.I)
_INDEX = re.compile(r"/index\.(html?|php)$", re.I)
_BAD_HOST = re.compile(r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]")
_PORTS = {"http": "80", "https": "443"}
#: What most addresses look like: nothing in them is escaped, resolved or rewritten.
_PLAIN_PATH = r"((?:/[A-Za-z0-9_~-][A-Za-z0-9_~.-]*)*/?)"
_PLAIN = re.compile(rf"(https?)://([a-z0-9-]+(?:\.[a-z0-9-]+)*){_PLAIN_PATH}")
_ROOTED = re.compile(rf"(?=/){_PLAIN_PATH}(?:#([A-Za-z0-9_-]*))?")
LOCALE_SEGMENT = f"^({'|'.join(W.LOCALES)})([-_][a-z]{{2}})?$"


@dataclass(frozen=True)
class Address:
    scheme: str
    user: str
    host: str  # with its port
    path: str
    query: str | None = None
    fragment: str | None = None

    @property
    def hostname(self) -> str:
        return self.host.rsplit(":", 1)[0] if re.search(r":\d+$", self.host) else self.host

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}"

    @property
    def search(self) -> str:
        return f"?{self.query}" if self.query else ""

    def text(self) -> str:
        tail = ("" if self.query is None else f"?{self.query}") + ("" if self.fragment is None else f"#{self.fragment}")
        return f"{self.scheme}://{self.user}{self.host}{self.path}{tail}"


def _path(segments: list[str]) -> str:
    out: list[str] = []
    for n, segment in enumerate(segments):
        plain, last = segment.lower().replace("%2e", "."), n == len(segments) - 1
        if plain == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(quote(segment, safe="!$%&'()*+,-./:;=@_~[]|\\^"))
    return "/" + "/".join(out)


def _authority(scheme: str, text: str) -> tuple[str, str] | None:
    user, at, host = text.rpartition("@")
    port = ""
    if m := re.fullmatch(r"(\[[0-9A-Fa-f:.]+\]|[^:\[\]]*)(?::(\d*))?", host):
        host, port = m[1], m[2] or ""
    else:
        return None
    if not host.startswith("["):
        host = unquote(host).lower()
        if not host.isascii():
            try:
                host = host.encode("idna").decode()
            except UnicodeError:
                return None
        if not host or _BAD_HOST.search(host):
            return None
    if port and int(port) > 65535:
        return None
    port = "" if not port or str(int(port)) == _PORTS[scheme] else f":{int(port)}"
    return user + at, host.lower() + port


def parse(text: str, base: Address | None = None) -> Address | None:
    """An http(s) address, resolved against ``base``; None if it is none."""
    if m := _PLAIN.fullmatch(text):
        return Address(m[1], "", m[2], m[3] or "/")
    if base is not None and (m := _ROOTED.fullmatch(text)):
        return Address(base.scheme, base.user, base.host, m[1], None, m[2])
    return _parse(text, base)


def _parse(text: str, base: Address | None) -> Address | None:
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    scheme = _SCHEME.match(text)
    relative = False
    if scheme:
        name = scheme[1].lower()
        if name not in _PORTS:
            return None
        text = text[scheme.end() :]
        relative = base is not None and base.scheme == name and not text.startswith(("/", "\\"))
        if not relative:
            text = "//" + text.lstrip("/\\")
    elif base is None:
        return None
    else:
        name, relative = base.scheme, not text.replace("\\", "/").startswith("//")
    text, hash_, fragment = text.partition("#")
    fragment = quote(fragment, safe="!#$%&'()*+,-./:;=?@_~[]|\\^{}") if hash_ else None
    text, mark, query = text.partition("?")
    query = quote(query, safe="!$%&()*+,-./:;=?@_~[]|\\^`{}") if mark else None
    text = text.replace("\\", "/")
    if not relative:
        rest = text[2:]
        cut = rest.find("/")
        authority, path = (rest, "/") if cut < 0 else (rest[:cut], rest[cut:])
        found = _authority(name, authority)
        return found and Address(name, *found, _path(path[1:].split("/")), query, fragment)
    if not text:
        return Address(base.scheme, base.user, base.host, base.path, query if mark else base.query, fragment)
    segments = text[1:].split("/") if text.startswith("/") else base.path[1:].split("/")[:-1] + text.split("/")
    return Address(base.scheme, base.user, base.host, _path(segments), query, fragment)


@lru_cache(maxsize=4096)
def _base(text: str) -> Address | None:
    return parse(text)


def _pairs(query: str | None) -> list[tuple[str, str]]:
    return parse_qsl(query or "", keep_blank_values=True, max_num_fields=None)


def _without_tracking(query: str | None) -> str | None:
    """The query without keys that name a referrer; written anew only if one went."""
    pairs = _pairs(query)
    kept = [p for p in pairs if not _TRACKING.match(p[0])]
    if len(kept) == len(pairs):
        return query
    return urlencode(kept, safe="*") or None


def canonicalize(href: str | None, base: str | None) -> str | None:
    """One address for a page, or None where the link leads to no page."""
    if href is None:
        return None
    found = parse(href, _base(base) if base and not _PLAIN.fullmatch(href) else None)
    if found is None or _NON_PAGE.search(found.path):
        return None
    pairs = _pairs(found.query)
    first = dict(reversed(pairs))
    for key, _ in pairs:
        if _OPERATION_KEY.match(key) or (key.lower() == "action" and _OPERATION_ACTION.match(first[key])):
            return None
    query = _without_tracking(found.query)
    path = found.path
    if not query:
        path, query = _INDEX.sub("/", path), None
    if len(path) > 1 and path.endswith("/"):
        path = path[:-1]
    return Address(found.scheme, found.user, found.host, path, query).text()


def normalize(text: str | None) -> str | None:
    """What a person typed, as an address: https by default, other schemes refused."""
    text = (text or "").strip()
    if not text:
        return None
    scheme = _SCHEME.match(text)
    if scheme and scheme[1].lower() not in _PORTS:
        return None
    found = parse(text if scheme else f"https://{text}")
    return found and Address(found.scheme, found.user, found.host, found.path, _without_tracking(found.query) or None).text()


def resolve(href: str | None, base: str | None) -> str | None:
    found = parse(href, _base(base) if base else None) if href else None
    return found.text() if found else None


@batched("string")
def canonicalize_url(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([canonicalize(h, b) for h, b in zip(href, base)], dtype=object)


@batched("string")
def normalize_url(text: pd.Series) -> pd.Series:
    return pd.Series([normalize(t) for t in text], dtype=object)


@batched("string")
def resolve_url(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve(h, b) for h, b in zip(href, base)], dtype=object)


# -- parts of absolute addresses, as expressions -----------------------------------


def host_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#]*)", 1))


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)


def query_of(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), r"^[^?#]*(\?[^#]*)", 1)


def path_key(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), r"^([^?#]*)", 1)


def raw_segments(url: Column | str) -> Column:
    """Path segments with locales: what a crawl calls a section is the first of them."""
    return F.filter(F.split(path_of(url), "/"), lambda s: s != "")


def path_segments(url: Column | str) -> Column:
    """Path segments without locales, on which links are grouped."""
    return F.filter(raw_segments(url), lambda s: ~s.rlike("(?i)" + LOCALE_SEGMENT))


def query_keys(url: Column | str) -> Column:
    pairs = F.filter(F.split(F.regexp_extract(_c(url), r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.regexp_extract(p, "^([^=]*)", 1))


def is_tracking(key: Column | str) -> Column:
    return _c(key).rlike("(?i)" + W.TRACKING)


def is_page(path: Column | str) -> Column:
    return ~_c(path).rlike("(?i)" + W.NON_PAGE)


def display_url(url: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(url), "^https?://", ""), "/$", "")


def escape_url(url: Column | str) -> Column:
    out = F.replace(F.replace(_c(url), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
    for code in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0xA0):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:X}"))
    return out


def decode_slug(slug: Column | str) -> Column:
    """Percent-decoding that leaves a malformed slug, and plus signs, as they are."""
    decoded = F.try_url_decode(F.replace(_c(slug), F.lit("+"), F.lit("%2B")))
    return F.when(_c(slug).rlike("%(?![0-9A-Fa-f]{2})"), _c(slug)).otherwise(F.coalesce(decoded, _c(slug)))


def path_allowed(path: Column | str, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Path-prefix filters of a crawl."""
    out = F.lit(True)
    for prefix in exclude or []:
        out = out & ~_c(path).startswith(prefix)
    if include:
        hit = F.lit(False)
        for prefix in include:
            hit = hit | _c(path).startswith(prefix)
        out = out & hit
    return out


#: Address ranges that are not public.
PRIVATE_V4 = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10"]


def is_private_address(ip: Column | str) -> Column:
    """IPv4 ranges as whole numbers; IPv6 by prefix, an IPv4 address inside it by its own."""
    text = F.lower(_c(ip))
    v4 = F.when(text.rlike(r"^::ffff:\d+\.\d+\.\d+\.\d+$"), F.regexp_replace(text, "^::ffff:", "")).otherwise(text)
    parts = F.transform(F.split(v4, r"\."), lambda p: p.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    inside = F.lit(False)
    for net in map(ipaddress.ip_network, PRIVATE_V4):
        inside = inside | number.between(int(net.network_address), int(net.broadcast_address))
    v6 = (text == "::1") | text.startswith("fc") | text.startswith("fd") | text.startswith("fe8")
    return F.when(v4.rlike(r"^\d+\.\d+\.\d+\.\d+$"), inside).otherwise(F.coalesce(v6, F.lit(False)))
