"""Reading tags in time that follows a page's length, whatever it leaves open.

A pattern such as ``<meta[^>]+name=...`` looks from each opener to the next '>', so openers that nothing closes cost the
square of the page. But between two '>' only the first opener counts: what matches from a later one matches from the
first too. So every pattern here is tried at the first opener of such a stretch; where it fails, the stretch is passed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first

Q = "[\"']"


def _or_pass(opener: str, rest: str) -> str:
    return f"(?i)(?:({opener}{rest}))|{opener}[^>]*+"


def matches(html: Column, opener: str, rest: str, group: int = 0) -> Column:
    """What ``opener + rest`` captures in each match, from left to right; group 0 is the match. ``rest`` can't begin before '>' is over.

    ``rest`` starts in the tag: all before its first '>' is ``[^>]``. A group that a match leaves empty isn't told from
    a stretch without match and is left out.
    """
    return F.filter(F.regexp_extract_all(html, F.lit(_or_pass(opener, rest)), F.lit(group + 1)), lambda x: x != "")


def pairs(html: Column, opener: str, rest: str, names: tuple[str, str]) -> Column:
    """matches() of groups 1 and 2 side by side; neither may be empty in a match."""
    a, b = (F.regexp_extract_all(html, F.lit(_or_pass(opener, rest)), F.lit(g)) for g in (2, 3))
    return F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias(names[0]), y.alias(names[1]))), lambda p: p[names[0]] != "")


def has(html: Column, opener: str, rest: str) -> Column:
    return F.size(matches(html, opener, rest)) > 0


def bodies(html: Column, opener: str, rest: str) -> Column:
    """Group 1 of each match, also where it is empty."""
    return F.transform(matches(html, opener, rest), lambda x: F.regexp_extract(x, f"(?i)^{opener}{rest}", 1))


def first_body(html: Column, opener: str, rest: str) -> Column:
    """Group 1 of the first match, which may be empty; null without a match."""
    return F.get(bodies(html, opener, rest), F.lit(0))


def stretches(html: Column, opener: str) -> Column:
    """The text behind the first opener of each stretch up to '>', where attributes are read with value() and marked().

    A value that the '>' cuts through goes on to its quote, and what follows to the next '>' with it.
    """
    cut = f"[^>]*={Q}[^\"'>]*+>[^\"']*+{Q}[^>]*+"
    return F.regexp_extract_all(html, F.lit(f"(?i){opener}(?=({cut}|[^>]*+))[^>]*+"), F.lit(1))


def marked(found: Column, mark: str) -> Column:
    """True if a stretch holds ``mark``, a pattern without '>', behind a character at least."""
    return F.exists(found, lambda x: x.rlike(f"(?i)^[^>]+{mark}"))


def value(found: Column, attribute: str, least: int = 0) -> Column:
    """The attribute's last value of ``least`` characters or more in the first stretch that has one; null without one."""
    return _first(F.transform(found, lambda x: first(x, f"(?i)^[^>]+{attribute}={Q}([^\"']{{{least},}}){Q}")))


def value_beside(found: Column, attribute: str, mark: str, least: int = 0) -> Column:
    """Value of the attribute in the first stretch where ``mark`` stands before it, else in the first where it stands after.

    Of several the last that has the mark before it, or after it. Each stretch is read a fixed number of times.
    """
    some = f"[^\"']{{{least},}}"

    def behind(x: Column) -> Column:
        before = F.regexp_extract(x, f"(?i)^([^>]*){attribute}={Q}{some}{Q}", 1)
        return F.when(before.rlike(f"(?i)^[^>]+{mark}"), F.regexp_extract(x, f"(?i)^[^>]*{attribute}={Q}({some}){Q}", 1))

    def ahead(x: Column) -> Column:
        before = F.regexp_extract(x, f"(?i)^([^>]*){mark}", 1)
        over = first(x, f"(?i)^[^>]+{attribute}={Q}([^\"'>]*>[^\"']*){Q}[^>]*{mark}")  # a value that a '>' cuts through
        return F.coalesce(over, first(before, f"(?i)^[^>]+{attribute}={Q}({some}){Q}"))

    return F.coalesce(_first(F.transform(found, behind)), _first(F.transform(found, ahead)))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))
