"""HTML read with column functions: entities, attributes, plain text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from harvestry import rules
from harvestry.functions.text import squeeze


def unescape(c: Column) -> Column:
    """The named and numeric entities of ``rules.ENTITIES`` as characters; the ampersand last."""
    return reduce(lambda text, e: F.regexp_replace(text, e[0], e[1]), rules.ENTITIES, c)


def plain_text(c: Column) -> Column:
    """Text between the tags, blanks collapsed."""
    return squeeze(unescape(F.regexp_replace(c, r"(?s)<!--.*?-->|<[^>]*>", " ")))


def inline_text(c: Column) -> Column:
    """As ``plain_text``, but tags leave no blank: ``<b>1</b>2`` is ``12``."""
    return squeeze(unescape(F.regexp_replace(c, r"(?s)<!--.*?-->|<[^>]*>", "")))


def attribute(inside: Column, name: str) -> Column:
    """Value of an attribute from the inside of a tag: any case, either quote or none; NULL without it."""
    pattern = rf"""(?is)(?:^|\s)({name})\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    found = F.concat(*(F.regexp_extract(inside, pattern, i) for i in (2, 3, 4)))
    return F.when(F.regexp_extract(inside, pattern, 1) != "", unescape(found))


def links(html: Column, until: str = "") -> Column:
    """Anchors in order: array of (inside of the tag, content, ``until`` as a pattern behind the end tag)."""
    pattern = F.lit(rf"(?is)<a(\s[^>]*)>(.*?)</a\s*>({until})" if until else r"(?is)<a(\s[^>]*)>(.*?)(?:</a\s*>|(?=<a\s)|$)()")
    return F.transform(
        F.arrays_zip(*(F.regexp_extract_all(html, pattern, F.lit(i)).alias(n) for i, n in ((1, "inside"), (2, "content"), (3, "rest")))),
        lambda a: F.struct(a["inside"].alias("inside"), a["content"].alias("content"), a["rest"].alias("rest")))
