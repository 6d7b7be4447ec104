"""Addresses: extraction, normal form, identities and invites."""

from __future__ import annotations

import re
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import col
from .text import collapse

#: Endings of addresses that are files of a page and not pages; query keys that only track; how pages write some signs.
ASSETS = r"(?i)\.(png|jpg|jpeg|gif|webp|svg|css|js|wasm|ico|woff|woff2|ttf|eot)(\?.*)?$"
TRACKING = r"(?i)^utm_|^(fbclid|gclid|ref|feature)$"
WRITTEN = ((r"(?i)\\/|\\u002f|%2f", "/"), (r"(?i)\\u003a|%3a", ":"), (r"(?i)\\u0026|&amp;", "&"))


def extract(x, excluded: tuple[str, ...] = ()) -> Column:
    """Distinct http addresses of a text or page, in order, without trailing punctuation, assets and excluded hosts.

    The text is parted at what no address holds; of each part what starts with a scheme is an address.
    """
    parts = F.split(reduce(lambda t, w: F.regexp_replace(t, *w), WRITTEN, col(x)), r"""[\s"'<>)\\]+""")
    found = F.transform(parts, lambda t: F.regexp_replace(F.regexp_extract(t, r"(?is)https?://.+", 0), r"[.,;:]+$", ""))
    unwanted = lambda u: reduce(lambda a, b: a | b, [F.contains(F.lower(u), F.lit(h)) for h in excluded], u.rlike(ASSETS))
    return F.array_distinct(F.filter(found, lambda u: u.rlike(r"(?i)^https?://.") & ~unwanted(u)))


def plain(x) -> Column:
    """Scheme and host in lower case, no fragment, no trailing slash: T19 without its query part, for SQL."""
    host = F.lower(F.regexp_extract(col(x), r"(?i)^https?://([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(col(x), r"(?i)^https?://[^/?#]+([^?#]*)", 1), r"/$", "")
    return F.when(host != "", F.concat(F.lit("https://"), host, path))


def _parts(url: Column) -> Column:
    """Scheme, host, port, path and query of an absolute address; empty strings where there is none."""
    piece = lambda pattern, k=1: F.regexp_extract(url, rf"(?is)^{pattern}", k)
    at = F.regexp_replace(piece("[a-z]+://([^/?#]*)"), "^.*@", "")
    return F.struct(
        F.lower(piece("([a-z]+)://")).alias("scheme"),
        F.lower(F.regexp_replace(at, ":[0-9]*$", "")).alias("host"),
        F.regexp_extract(at, ":([0-9]+)$", 1).alias("port"),
        piece("[a-z]+://[^/?#]*([^?#]*)").alias("path"),
        piece(r"[^?#]*\?([^#]*)").alias("query"),
    )


def _pairs(query: Column) -> Column:
    """Decoded keys and values of a query, in order."""
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    return F.transform(F.filter(F.split(query, "&"), lambda kv: kv != ""), lambda kv: F.struct(decoded(F.substring_index(kv, "=", 1)).alias("key"), decoded(F.when(F.contains(kv, F.lit("=")), F.regexp_replace(kv, "^[^=]*=", "")).otherwise("")).alias("value")))


def _of(host: Column, names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [(host == n) | host.endswith("." + n) for n in names], F.lit(False))


def normalized(x, wrappers: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> Column:
    """The normal form of an address (T19): redirects of wrappers unwrapped, host in ASCII, tracking keys, fragment and trailing slash gone.

    Null for what is no http address, has a host without a dot, or one of wrappers or excluded. International names are the
    platform's own IDN conversion; no Python runs.
    """
    raw = col(x)
    own = _parts(F.when(raw.rlike(r"(?i)^[a-z]+://"), raw).otherwise(F.concat(F.lit("https://"), raw)))
    target = F.try_element_at(F.filter(_pairs(own["query"]), lambda kv: kv["key"] == "q"), F.lit(-1))["value"]
    for _ in range(2):
        target = F.coalesce(F.try_url_decode(target), target)
    wrapped = (own["path"] == "/redirect") & _of(own["host"], wrappers)
    u = F.when(wrapped, _parts(target)).otherwise(own)
    host = u["host"]
    ok = u["scheme"].isin("http", "https") & F.contains(host, F.lit(".")) & ~host.rlike(r"[\[\]\s]") & ~_of(host, (*wrappers, *excluded))
    ascii_host = F.when(host.rlike(r"^[\x00-\x7f]*$"), host).otherwise(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host))
    kept = F.filter(_pairs(u["query"]), lambda kv: ~kv["key"].rlike(TRACKING))
    query = F.array_join(F.transform(kept, lambda kv: F.concat(F.url_encode(kv["key"]), F.lit("="), F.url_encode(kv["value"]))), "&")
    path = F.regexp_replace(u["path"], "/$", "")
    out = F.concat(u["scheme"], F.lit("://"), ascii_host, F.when(u["port"] != "", F.concat(F.lit(":"), u["port"])).otherwise(""), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when((raw != "") & ok, out)


def locator(x, site: str) -> Column:
    """(kind, identity) of an address of a video site or of any other page."""
    s, at = F.trim(col(x)), re.escape(site)
    channel = F.regexp_extract(s, rf"(?i){at}/channel/(UC[A-Za-z0-9_-]{{22}})", 1)
    handle = F.regexp_extract(s, rf"(?i){at}/@([A-Za-z0-9_.-]+)", 1)
    video = F.regexp_extract(s, rf"(?i){at}/(?:watch\?v=|embed/)([A-Za-z0-9_-]{{11}})", 1)
    host = F.lower(F.regexp_extract(s, r"^https?://([^/?#:]+)", 1))
    path = F.regexp_extract(s, r"^https?://[^/?#]+([^?#]*)", 1)
    pair = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("identity"))
    return F.when(channel != "", pair("CHANNEL_ID", channel)).when(handle != "", pair("HANDLE", F.concat(F.lit("@"), F.lower(handle)))).when(video != "", pair("VIDEO_ID", video)).when(host != "", pair("EXTERNAL_EVIDENCE", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path))))


def noise_reason(host, title, domains: tuple[str, ...], titles: str) -> Column:
    """Why a search result is noise: its domain, its title, or null."""
    h = F.lower(col(host))
    bad = F.array_contains(F.array(*map(F.lit, domains)), h) | F.exists(F.array(*map(F.lit, domains)), lambda d: h.endswith(F.concat(F.lit("."), d)))
    return F.when(bad, "EXCLUDED_DOMAIN").when(col(title).rlike(titles), "NOISE_TITLE")


#: Path words that are no invite codes; hosts of invites, of redirects to them, and of their directory.
RESERVED = tuple("channels guilds store download nitro login register api widget terms privacy branding jobs before after next prev index home about contact faq support invite oauth2 template".split())
INVITE_HOSTS = (
    ("NATIVE_INVITE", r"(?:discord\.gg|discord\.com/invite|discordapp\.com/invite|discord\.app/invite)"),
    ("ALTERNATIVE_REDIRECT", r"(?:dsc\.gg|discord\.me|discord\.io)"),
    ("DIRECTORY_PAGE", r"disboard\.org/server"),
)


def invites(x) -> Column:
    """Distinct (kind, locator, code) of the invites that a text has (T21): native ones by their code, 2 to 128 characters and no
    reserved word; alternative and directory ones by their address, without a code. Natives come first."""
    clean = reduce(lambda t, w: F.regexp_replace(t, *w), WRITTEN, col(x))
    code = lambda u: F.lower(F.substring_index(u, "/", -1))
    row = lambda kind, locator, code: F.struct(F.lit(kind).alias("kind"), locator.alias("locator"), code.alias("code"))
    at = {kind: F.regexp_extract_all(clean, F.lit(rf"(?i)((?:https?://)?(?:www\.)?{host}/[^\s\"'<>)\\/?#&]+)"), F.lit(1)) for kind, host in INVITE_HOSTS}
    native, *others = at
    good = F.filter(at[native], lambda u: F.length(code(u)).between(2, 128) & ~code(u).isin(*RESERVED))
    found = [F.transform(good, lambda u: row(native, F.concat(F.lit("discord:"), code(u)), code(u)))]
    for kind in others:
        found.append(F.transform(at[kind], partial(_bare, row, kind)))
    return F.array_distinct(F.concat(*found))


def _bare(row, kind: str, u: Column) -> Column:
    return row(kind, F.lower(u), F.lit(None).cast("string"))


def identifier(namespace, value) -> Column:
    """An identifier in its namespace's form: addresses plain, handles with a sign, mail in lower case."""
    v, n = F.trim(col(value)), col(namespace)
    return F.when(n == "url", F.coalesce(plain(v), F.lower(v))).when(n == "handle", F.concat(F.lit("@"), F.lower(F.regexp_replace(v, "^@+", "")))).when(n == "domain", F.regexp_replace(F.lower(v), r"^www\.|\.$", "")).otherwise(collapse(v))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("target", "kind", "context")])))
def relationships(s: pd.Series) -> pd.Series:
    """Handles and addresses that a text names, with 40 characters on either side."""
    pattern = re.compile(r"(?P<handle>(?<![\w.])@[A-Za-z0-9_.-]{3,})|(?P<url>https?://[^\s\"'<>)]+)")

    def one(t):
        return [{"target": m.group().lower() if m.lastgroup == "handle" else m.group(), "kind": m.lastgroup, "context": t[max(0, m.start() - 40) : m.end() + 40]} for m in pattern.finditer(t or "")]

    return s.map(one)


def surface_score(surface, has_context, has_hint, is_hub, is_platform, is_custom_domain, is_affiliate, is_broker) -> Column:
    """How promising a page is for a community link."""
    base = F.when(col(surface) == "CHANNEL_LINKS", 65).when(col(surface) == "ABOUT", 50).when(col(surface) == "PINNED", 45).when(col(surface) == "VIDEO", 10).otherwise(0)
    add = lambda flag, n: F.when(col(flag), n).otherwise(0)
    return base + add(has_context, 120) + add(has_hint, 70) + add(is_hub, 60) + add(is_platform, 55) + add(is_custom_domain, 20) + add(is_affiliate, -75) + add(is_broker, -45)
