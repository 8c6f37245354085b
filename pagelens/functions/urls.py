"""URLs: standard resolution, origins, parameters, page types and categories."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPECIAL = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
ASSET = r"(?i)\.(?:jpg|jpeg|png|gif|svg|webp|ico|css|js|pdf|zip|mp4|webm|woff2?|ttf|eot|xml|json)(?:\?|$)"
TRACKING = r"(?i)^(?:utm_|gclid|fbclid|mc_|_ga|sessionid|sid|ref)"
#: Page types by URL and categories by path, first fit first; fixed values.
PAGE_TYPES = [
    ("blog", r"/blog/|/article/|/post/|/news/"),
    ("product", r"/product/|/shop/|/store/"),
    ("faq", r"/faq|/preguntas|/help"),
    ("local", r"/contact|/contacto|/store-locator"),
    ("about", r"/about|/nosotros|/sobre"),
]
CATEGORIES = [
    ("optional", r"/(?:privacy|privacidad|terms|terminos|cookies|legal|sitemap|404)"),
    ("blog", r"/(?:blog|noticias|news|articles?|posts?|recursos|resources)"),
    ("about", r"/(?:about|sobre|nosotros|equipo|team|company|empresa|contact|contacto|careers|empleo)"),
    ("products", r"/(?:products?|productos?|services?|servicios?|features?|funcionalidades?|soluciones?|solutions?|pricing|precios|planes)"),
]
_PATH = frozenset(' "#<>?^`{}')
_QUERY = frozenset(' "#<>')
_FRAGMENT = frozenset(' "<>`')
_USER = _PATH | frozenset("/:;=@[\\]|")
_BAD_HOST = re.compile(r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]")


def _quote(text: str, reserved: frozenset[str]) -> str:
    return "".join(c if "\x20" <= c <= "\x7e" and c not in reserved else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _ipv4(host: str) -> str | None:
    """Dotted form of a host that ends in a number; None for a name. ValueError if it is no address."""
    parts = host.rstrip(".").split(".") if host.endswith(".") else host.split(".")
    if not re.fullmatch(r"[0-9]+|0[xX][0-9a-fA-F]*", parts[-1] or "x"):
        return None
    if len(parts) > 4:
        raise ValueError("too many parts")
    numbers = []
    for p in parts:
        if not re.fullmatch(r"0[xX][0-9a-fA-F]*|[0-9]+", p):
            raise ValueError("not a number")
        numbers.append(int(p[2:] or "0", 16) if p[:2].lower() == "0x" else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p))
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise ValueError("out of range")
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def _ascii_name(name: str) -> str:
    """A host in other than ASCII letters by the non-transitional rules of UTS 46: sharp s, final sigma and joiners stay.

    Characters are folded and normalised by this Python's Unicode tables, which lack joining types: a zero-width
    non-joiner without a virama before it passes between right-to-left letters.
    """
    kept = "\u00df\u03c2\u200c\u200d"
    folded = "".join(c if c in kept else "\u00df" if c == "\u1e9e" else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold()) for c in name if c not in "\u00ad\u200b\u2060\ufeff" and not "\ufe00" <= c <= "\ufe0f")
    labels = [_decoded(x) if x.startswith("xn--") else x for x in re.split("[.\u3002]", unicodedata.normalize("NFC", folded))]
    bidi = any(unicodedata.bidirectional(c) in ("R", "AL", "AN") for c in "".join(labels))
    for label in labels:
        _check_label(label, bidi)
    return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels)


def _decoded(label: str) -> str:
    """The letters of a label in Punycode, which must be what these letters are written as. ValueError."""
    plain = label[4:].encode("ascii").decode("punycode")
    if not plain or plain.isascii() or plain.encode("punycode").decode() != label[4:] or unicodedata.normalize("NFKC", plain).casefold() != plain.replace("\u00df", "ss").replace("\u03c2", "\u03c3"):
        raise ValueError("not Punycode")
    return plain


def _check_label(label: str, bidi: bool) -> None:
    """Validity of a label by UTS 46: characters, joiners in context and, in a name with right-to-left letters, RFC 5893."""
    if label and (unicodedata.category(label[0])[0] == "M" or any(unicodedata.category(c) in ("Cc", "Cs", "Co", "Cn", "Zs", "Zl", "Zp") for c in label)):
        raise ValueError("disallowed character")
    for i, c in enumerate(label):
        if c in "\u200c\u200d" and not (i and unicodedata.combining(label[i - 1]) == 9):
            sides = [unicodedata.bidirectional(x) for x in label[i - 1 : i] + label[i + 1 : i + 2]] if i else []
            if c == "\u200d" or sides != ["AL", "AL"]:
                raise ValueError("joiner out of context")
    if not bidi or not label:
        return
    kinds = [unicodedata.bidirectional(c) for c in label]
    end = next((k for k in reversed(kinds) if k != "NSM"), "")
    if kinds[0] in ("R", "AL"):
        good = set(kinds) <= {"R", "AL", "AN", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"} and end in ("R", "AL", "EN", "AN") and not {"EN", "AN"} <= set(kinds)
    else:
        good = kinds[0] == "L" and set(kinds) <= {"L", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"} and end in ("L", "EN")
    if not good:
        raise ValueError("mixed directions")


def _host(raw: str, special: bool) -> str:
    if raw.startswith("["):
        if not raw.endswith("]"):
            raise ValueError("unclosed bracket")
        return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]"
    if not special:
        if re.search(r"[\x00\t\n\r #/:<>?@\[\\\]^|]", raw):
            raise ValueError("forbidden character")
        return _quote(raw, frozenset())
    name = re.sub(rb"%([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), raw.encode()).decode("utf-8").lower()
    if not name.isascii() or re.search(r"(?:^|\.)xn--", name):
        name = _ascii_name(name)
    if not name or _BAD_HOST.search(name):
        raise ValueError("bad host")
    return _ipv4(name) or name


DRIVE = re.compile(r"[A-Za-z][:|]")


def _segments(path: str, special: bool, base: list[str], file: bool = False) -> list[str]:
    """Path segments with dots resolved; a drive letter at the start of a ``file`` path is kept and written with a colon."""
    out = list(base)
    parts = re.split(r"[/\\]" if special else "/", path)
    for i, p in enumerate(parts):
        plain, last = re.sub("(?i)%2e", ".", p), i == len(parts) - 1
        if plain == "..":
            if out and not (file and len(out) == 1 and DRIVE.fullmatch(out[0])):
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        elif file and not out and DRIVE.fullmatch(p):
            out.append(f"{p[0]}:")
        else:
            out.append(_quote(p, _PATH))
    return out


@lru_cache(maxsize=50_000)
def _parse(url: str, base: tuple | None = None) -> tuple:
    """(scheme, authority or None, path segments or opaque text, query, fragment) by the WHATWG rules; ValueError."""
    url = re.sub(r"[\t\n\r]", "", re.sub(r"^[\x00-\x20]+|[\x00-\x20]+$", "", url))
    rest, _, fragment = url.partition("#")
    fragment = _quote(fragment, _FRAGMENT) if "#" in url else None
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", rest)
    scheme = m[1].lower() if m else None
    if scheme:
        rest = rest[m.end() :]
    elif base is None:
        raise ValueError("no scheme")
    elif isinstance(base[2], str):
        if rest:
            raise ValueError("the base can't be extended")
        return (*base[:4], fragment)
    special = (scheme or base[0]) in SPECIAL
    slash = "/\\" if special else "/"
    relative = scheme is None or base is not None and special and scheme == base[0] and rest[:1] not in slash and scheme != "file" or scheme and special and base is not None and scheme == base[0] and rest[:1] and rest[:1] in slash and rest[1:2] not in slash
    scheme = scheme or base[0]
    rest, mark, query = rest.partition("?")
    query = _quote(query, _QUERY | frozenset("'") if special else _QUERY) if mark else None
    two = len(rest) >= 2 and rest[0] in slash and rest[1] in slash
    if not (two or special and not relative and scheme != "file"):
        if relative and base is not None:
            if rest[:1] and rest[0] in slash:
                return scheme, base[1], tuple(_segments(rest[1:], special, [])), query, fragment
            if rest:
                return scheme, base[1], tuple(_segments(rest, special, list(base[2][:-1]))), query, fragment
            return scheme, base[1], base[2], query if mark else base[3], fragment
        if scheme == "file":
            return scheme, "", tuple(_segments(rest.lstrip(slash), special, [], True)), query, fragment
        if rest.startswith("/"):
            return scheme, None, tuple(_segments(rest[1:], False, [])), query, fragment
        return scheme, None, "".join(c if " " <= c <= "~" else _quote(c, frozenset()) for c in rest), query, fragment
    rest = rest.lstrip(slash) if special and scheme != "file" else rest[2:]
    cut = re.search(r"[/\\]" if special else "/", rest)
    authority, path = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    if scheme == "file" and DRIVE.fullmatch(authority):
        authority, path = "", f"/{rest}"
    user, at, host = authority.rpartition("@")
    name, port = host, ""
    if m := re.search(r":([0-9]*)$", host) if not host.endswith("]") else None:
        name, port = host[: m.start()], m[1]
    elif re.search(r":[^\]]*$", host) and not host.startswith("["):
        raise ValueError("bad port")
    if port and int(port) > 65535:
        raise ValueError("bad port")
    name = "" if scheme == "file" and name in ("", "localhost") else _host(name, special) if name or special else ""
    if at:
        who, colon, word = user.partition(":")
        user = _quote(who, _USER) + (":" + _quote(word, _USER) if word else "")
        user = user + "@" if user else ""
    where = f":{int(port)}" if port and int(port) != SPECIAL.get(scheme) else ""
    segments = tuple(_segments(path[1:], special, [], scheme == "file")) if path else ("",) if special else ()
    return scheme, f"{user}{name}{where}", segments, query, fragment


def resolve_one(href: str | None, base: str | None = None) -> str | None:
    """The absolute form of ``href`` against ``base``, null where the standard fails."""
    if href is None:
        return None
    try:
        try:
            p = _parse(href, _parse(base) if base is not None else None)
        except RecursionError:
            return None
        scheme, authority, path, query, fragment = p
        out = f"{scheme}:" + (f"//{authority}" if authority is not None else "")
        if isinstance(path, str):
            out += path
        elif path:
            out += ("/." if authority is None and len(path) > 1 and path[0] == "" else "") + "/" + "/".join(path)
        return out + (f"?{query}" if query is not None else "") + (f"#{fragment}" if fragment is not None else "")
    except (ValueError, UnicodeError):
        return None


@F.pandas_udf(T.StringType())
def _normalize_odd(url: pd.Series) -> pd.Series:
    return url.map(resolve_one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _resolve_odd(base: pd.Series, hrefs: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else [resolve_one(x, b if b is not None else "") for x in h] for b, h in zip(base, hrefs)], dtype=object)


#: http(s) URLs that are their own standard form but for an empty path: lower-case names whose last label has a letter
#: and isn't a number in hexadecimal, no user, no port, no dot segments, no character that is quoted.
_NAME = r"(?:(?!xn--)[a-z0-9_](?:[a-z0-9_-]*+[a-z0-9_])?+\.)*+(?!xn--)(?!0x)[a-z0-9_-]*[a-z][a-z0-9_-]*+"
_PLAIN_PATH = r"(?:/(?!\.|%2[eE])[A-Za-z0-9._~!$&()*+,;=:@%'\[\]|-]*+)*+"
_PLAIN_QUERY = r"(?:\?[A-Za-z0-9._~!$&()*+,;=:@%/?\[\]|^`{}-]*+)?+"
_PLAIN_HASH = r"(?:#[A-Za-z0-9._~!$&()*+,;=:@%/?#\[\]|^{}'-]*+)?+"
PLAIN = rf"^https?://{_NAME}{_PLAIN_PATH}{_PLAIN_QUERY}{_PLAIN_HASH}\z"
#: References that only need what precedes them in a plain base: paths from the root, queries, fragments, and paths from
#: the base's directory whose first segment has no colon.
PLAIN_ROOT = rf"^(?=/)(?!//){_PLAIN_PATH}{_PLAIN_QUERY}{_PLAIN_HASH}\z"
PLAIN_NEAR = rf"^(?!\.|%2[eE])[A-Za-z0-9._~!$&()*+,;=@%'\[\]|-]++{_PLAIN_PATH}{_PLAIN_QUERY}{_PLAIN_HASH}\z"
PLAIN_QUERY, PLAIN_HASH = rf"^\?{_PLAIN_QUERY[5:-3]}{_PLAIN_HASH}\z", rf"^#{_PLAIN_HASH[4:-3]}\z"


def _rooted(url: Column) -> Column:
    """A plain URL with '/' where its path is empty."""
    return F.regexp_replace(url, r"^(https?://[^/?#]++)(?=[?#]|\z)", "$1/")


def _plain(href: Column, base: Column) -> Column:
    """``href`` against a plain ``base`` by expressions alone; null where that isn't sure to be the standard's result."""
    site, folder = F.regexp_extract(base, "^https?://[^/?#]+", 0), F.regexp_extract(_rooted(base), "^https?://[^?#]*/", 0)
    page, asked = F.regexp_extract(_rooted(base), "^[^?#]*", 0), F.regexp_extract(_rooted(base), "^[^#]*", 0)
    return (
        F.when(href.rlike(PLAIN), _rooted(href))
        .when(href.rlike(PLAIN_ROOT), F.concat(site, href))
        .when(href.rlike(PLAIN_NEAR), F.concat(folder, href))
        .when(href.rlike(PLAIN_QUERY), F.concat(page, href))
        .when(href.rlike(PLAIN_HASH), F.concat(asked, href))
    )


def normalize(url: Column | str) -> Column:
    """Absolute URLs in their standard form; null where invalid.

    Plain ones by expressions; only the others go to Python, which sees null in the place of a plain one.
    """
    url = F.col(url) if isinstance(url, str) else url
    easy = url.rlike(PLAIN)
    return F.coalesce(F.when(easy, _rooted(url)), _normalize_odd(F.when(~easy, url)))


def resolve_all(base: Column | str, hrefs: Column | str) -> Column:
    """Every href of a page against the page's URL; null elements where invalid.

    Plain ones by expressions; Python gets the distinct others of a page, null for a page that has none.
    """
    base, hrefs = (F.col(c) if isinstance(c, str) else c for c in (base, hrefs))
    unsolved = F.transform(hrefs, lambda h: F.lit(None).cast("string"))
    found = F.when(F.coalesce(base.rlike(PLAIN), F.lit(False)), F.transform(hrefs, lambda h: _plain(h, base))).otherwise(unsolved)
    left = F.array_distinct(F.filter(F.zip_with(hrefs, found, lambda h, f: F.when(f.isNull(), h)), lambda h: h.isNotNull()))
    odd = F.when(F.size(left) > 0, left)

    def pick(o: Column) -> Column:
        at = lambda h: F.get(o["out"], (F.array_position(o["odd"], h) - 1).cast("int"))
        return F.zip_with(hrefs, found, lambda h, f: F.coalesce(f, at(h)))

    some = F.element_at(F.transform(F.array(F.struct(odd.alias("odd"), _resolve_odd(base, odd).alias("out"))), pick), 1)
    return F.when(hrefs.isNotNull(), F.when(F.size(left) > 0, some).otherwise(found))


def target(url: Column) -> Column:
    """A target as typed, with https:// in front where it has no http scheme. normalize() tells if it is valid."""
    return F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def strip_hash(url: Column) -> Column:
    """A standard URL without its fragment."""
    return F.regexp_replace(url, "#.*$", "")


def origin(url: Column) -> Column:
    """Origin of a standard URL; 'null' for schemes without one, null for null."""
    pattern = r"^((?:https?|wss?|ftp)://)(?:[^/?#]*@)?([^/?#@]+)"
    return F.when(url.isNotNull(), F.when(url.rlike(pattern), F.concat(F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2))).otherwise("null"))


def path(url: Column) -> Column:
    """Path of a standard URL, '' where it has none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)


def is_asset(url: Column) -> Column:
    return url.rlike(ASSET)


def params(url: Column) -> Column:
    """Parameters of a standard URL: names decoded, in order, duplicates kept; those that track; fragment; depth."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    named = F.filter(F.split(query, "&"), lambda p: p != "")
    names = F.transform(named, lambda p: F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)))
    return F.when(
        url.isNotNull(),
        F.struct(
            (F.size(named) > 0).alias("has_params"),
            F.size(named).alias("param_count"),
            names.alias("params"),
            F.filter(names, lambda n: n.rlike(TRACKING)).alias("tracking_params"),
            url.rlike("#.").alias("has_fragment"),
            F.size(F.filter(F.split(path(url), "/"), lambda s: s != "")).alias("depth"),
        ),
    )


def _ladder(s: Column, steps: list[tuple[str, str]], otherwise: Column) -> Column:
    out = otherwise
    for name, pattern in reversed(steps):
        out = F.when(s.rlike(pattern), name).otherwise(out)
    return out


def page_type(url: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", "unknown").otherwise(_ladder(F.lower(url), PAGE_TYPES, F.lit("home")))


def category(url: Column, word_count: Column) -> Column:
    """Section of a site's guide that a page belongs to; the home page is in ``main``."""
    p = F.lower(path(url))
    segments = F.size(F.filter(F.split(p, "/"), lambda s: s != ""))
    deep = F.when(segments == 1, "main").when(word_count > 300, "blog").otherwise("optional")
    return F.when(p.isin("/", ""), "main").otherwise(_ladder(p, CATEGORIES, deep))
