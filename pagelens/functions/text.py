"""Text rules that page audits share: browser white space, UTF-16 lengths, entities, tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' scripts see it, for use inside a character class.
WS = r"\t\n\x0B\f\r \x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Word boundaries by ASCII letters, digits and underscore.
START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Entities that are decoded, in this order, one after the other.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&apos;", "'"), ("&nbsp;", " ")]


def trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{WS}]+|(?<![{WS}])[{WS}]+$", "")  # a run of white space is looked at once


def units(s: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.length(s) + F.regexp_count(s, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("int")


def half_up(x: Column) -> Column:
    """Nearest whole number, halves up."""
    return F.floor(x.cast("double") + 0.5)


def decode(s: Column) -> Column:
    for entity, char in ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(char))
    return s


def strip_tags(s: Column, by: str = "") -> Column:
    """Every tag replaced; behind the last '>' no tag can begin, so what isn't closed there is read once and kept."""
    if not by:
        return F.regexp_replace(s, r"<[^>]+>|(<[^>]*\z)", "$1")

    def cut(x: Column) -> Column:
        tail = F.substring_index(x, ">", -1)
        return F.concat(F.regexp_replace(F.substring(x, F.lit(1), F.length(x) - F.length(tail)), "<[^>]+>", by), tail)

    return let(s, cut)


def closed(html: Column, name: str) -> Column:
    """``html`` up to its last closing tag of that name, empty without one.

    No element that begins later is closed, so patterns that end in the closing tag need only look here. Elsewhere each
    opener would have them search to the end of the page, in time that grows with the square of its length.
    """
    return F.regexp_extract(html, f"(?is)^.*</{name}>", 0)


def without_elements(html: Column, name: str, pattern: str) -> Column:
    """Elements replaced by a space; ``pattern`` ends in the closing tag of that name."""
    rest = lambda x, head: F.substring(x, F.length(head) + 1, F.length(x))
    return let(html, lambda x: let(closed(x, name), lambda head: F.concat(F.regexp_replace(head, pattern, " "), rest(x, head))))


def first(s: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without a match (an empty group is empty text)."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def every(s: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(group))


def count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def filled(s: Column) -> Column:
    """True where a text is there and not empty."""
    return F.coalesce(s, F.lit("")) != ""


def no_strings() -> Column:
    return F.expr("cast(array() as array<string>)")
