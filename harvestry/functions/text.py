"""Scalar text and number functions; everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from harvestry import rules


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def contains_ci(c: Column | str, needle: str) -> Column:
    """Case-insensitive literal containment; no pattern characters."""
    return F.contains(F.lower(_col(c)), F.lower(F.lit(needle)))


def metric_text(c: Column | str, decimal: bool = False) -> Column:
    """Value as text, None staying None; scores get the stored four decimals."""
    c = _col(c)
    return (c.cast("decimal(10,4)") if decimal else c).cast("string")


def ids_hash(ids: Column | str) -> Column:
    """sha256 of the comma-joined ids of an array."""
    return F.sha2(F.array_join(F.transform(_col(ids), lambda x: x.cast("string")), ","), 256)


def trigrams_of(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, two blanks before and one after each."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(
            F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3))
        )

    return F.array_distinct(F.flatten(F.transform(words, grams)))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    """Shared trigrams divided by all trigrams of the two texts."""
    left, right = trigrams_of(_col(a)), trigrams_of(_col(b))
    shared = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - shared
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))


def decimal_in_text(c: Column | str) -> Column:
    """First ``digits.digits`` as a number; integers alone give NULL."""
    return blank_to_null(F.regexp_extract(_col(c), r"\d+\.\d+", 0)).try_cast("double")


def clean_number(c: Column | str) -> Column:
    """First run of digits and dots; placeholder texts and unparsable runs give NULL."""
    text = F.trim(_col(c))
    digits = blank_to_null(F.regexp_extract(text, r"[\d.]+", 0)).try_cast("double")
    return F.when(~text.isin(*rules.NULL_NUMBERS), digits)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def join_distinct(parts: Sequence[Column], limit: int = 120) -> Column:
    """Compact the parts, keep the first of equal ones, join with `` / `` and compact again."""
    texts = F.array_compact(F.transform(F.array(*parts), lambda p: compact_text(p, limit)))
    return let(F.array_join(F.array_distinct(texts), " / "), lambda t: compact_text(t, limit))


def squeeze(c: Column | str) -> Column:
    """Inner blanks as one blank, outer ones removed; blanks are those of Unicode."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def strip(c: Column | str) -> Column:
    """Outer blanks of Unicode removed."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def compact_text(c: Column | str, limit: int = 90) -> Column:
    """Trimmed text, blank as NULL, cut at ``limit`` characters with a trailing ``...``."""
    text = blank_to_null(strip(c))
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit("..."))
    )


def page_math(n: Column | str) -> Column:
    """Pages of ten and the size of the last page, as a struct."""
    n = _col(n)
    size = F.lit(rules.PAGE_SIZE)
    pages = F.when(n > 0, F.ceil(n / size)).otherwise(0).cast("long")
    last = F.when(n > 0, F.pmod(n - 1, size) + 1).otherwise(0).cast("long")
    return F.struct(pages.alias("total_pages"), last.alias("last_page_count"))


def field_label(c: Column | str) -> Column:
    """Label without trailing colons and blanks, inner blanks as underscores."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"(?U)^\s+|[\s:：]+$", ""), r"(?U)\s+", "_")


def lenient_int(c: Column | str, default: int = 0) -> Column:
    """Whole number of a number (fractions cut) or of a text that is one; anything else is the default."""
    text = strip(_col(c).cast("string"))
    # a double writes itself as 5.0 or 1.0E7, a decimal as 5.00; in texts these are not whole numbers
    number = F.when(F.typeof(_col(c)) != "string", text.try_cast("decimal(38,6)").try_cast("long"))
    return F.coalesce(number, F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long")), F.lit(default).cast("long"))


def time_after_label(c: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` after a label's colon; anything else gives NULL."""
    text = strip(F.regexp_replace(strip(c), r"^[：:]+", ""))
    shaped = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), text)
    return shaped.try_cast("timestamp_ntz")


def first_integer(c: Column | str) -> Column:
    return blank_to_null(F.regexp_extract(_col(c), r"\d+", 0)).try_cast("long")


def rating_band(c: Column | str) -> Column:
    """high from 4, medium from 2 or without a number, low below, blank without a rating."""
    text, score = blank_to_null(_col(c)), first_integer(c)
    return (
        F.when(text.isNull(), "")
        .when(score.isNull(), "medium")
        .when(score >= 4, "high")
        .when(score >= 2, "medium")
        .otherwise("low")
    )


_DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column | str) -> Column:
    """Name-based UUID (version 5) in the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_DNS_NAMESPACE)), F.encode(_col(name), "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex((nibble.bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )
