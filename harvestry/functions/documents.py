"""Functions over semi-structured documents held as JSON text."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from harvestry import rules
from harvestry.functions.text import (
    blank_to_null, compact_text, decimal_in_text, join_distinct, let,
)

# possessive loops: they run in constant stack space on texts of any length
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_REST = r"-?\d[\d.eE+-]*|true|false|null"
# one JSON string (a key when a colon follows), number, word or comma
_TOKEN = rf"{_STRING}(?:\s*:)?|{_REST}|,"
_SCALAR = f"{_STRING}|{_REST}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sql_path(key: str) -> str:
    return '$["' + key.replace('"', '\\"') + '"]'


def _unquote(token: Column) -> Column:
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    parsed = F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(F.contains(token, F.lit("\\")), parsed).otherwise(plain)


def canonical_json(cols: Mapping[str, Column]) -> Column:
    """Record as JSON with sorted keys, ``", "`` and ``": "`` separators, text values or null."""
    parts: list[Column] = []
    for i, key in enumerate(sorted(cols)):
        lead = "{" if i == 0 else ", "
        listed = F.to_json(F.array(cols[key].cast("string")))
        parts.append(F.lit(f"{lead}{json.dumps(key, ensure_ascii=False)}: "))
        parts.append(F.substring(listed, F.lit(2), F.length(listed) - 2))
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def record_hash(record: Column) -> Column:
    return F.sha2(record, 256)


# --- objects -----------------------------------------------------------------------------

def is_object(doc: Column | str) -> Column:
    return F.coalesce(F.json_object_keys(_col(doc)).isNotNull(), F.lit(False))


def is_empty_doc(doc: Column | str) -> Column:
    """No document, or one that holds nothing (null, empty object, list or text, 0, false)."""
    text = F.trim(_col(doc))
    empty = text.isin("", "null", "{}", "[]", '""', "0", "0.0", "false") | text.rlike(r"^[\[{]\s*[\]}]$")
    return text.isNull() | empty


def doc_keys(doc: Column | str) -> Column:
    """Distinct top-level keys (NULL when the document is not an object)."""
    return F.array_distinct(F.json_object_keys(_col(doc)))


def doc_map(doc: Column | str) -> Column:
    """Top level as map<string,string>; nested values stay JSON text, the last duplicate wins."""
    entries = F.map_entries(F.from_json(_col(doc), "map<string,string>"))
    return F.map_from_entries(_last_of_each(entries))


def _last_of_each(entries: Column) -> Column:
    """Map entries with only the last one of equal keys."""
    def keep(newest_first: Column) -> Column:
        def pick(keys: Column) -> Column:
            return F.filter(newest_first, lambda e, i: F.array_position(keys, e["key"]) == i + 1)

        return let(F.transform(newest_first, lambda e: e["key"]), pick)

    return F.reverse(let(F.reverse(entries), keep))


def doc_field(doc: Column | str, field: str) -> Column:
    """Text of a top-level field (nested values as JSON text, JSON null as NULL)."""
    entries = F.map_entries(F.from_json(_col(doc), "map<string,string>"))
    hit = F.filter(entries, lambda e: e["key"] == field)
    return F.try_element_at(hit, F.lit(-1))["value"]


def has_field(doc: Column | str, field: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(_col(doc)), field), F.lit(False))


def has_any_key(keys: Column, names: Sequence[str]) -> Column:
    """True when a key equals one of ``names``, ignoring case."""
    wanted = F.array(*[F.lit(n.lower()) for n in names])
    return F.coalesce(F.arrays_overlap(F.transform(keys, F.lower), wanted), F.lit(False))


def merge_docs(old: Column | str, new: Column | str) -> Column:
    """Top-level merge where the new document wins; key order of the old one is kept."""
    def as_map(doc: Column) -> Column:
        parsed = F.from_json(F.coalesce(doc, F.lit("{}")), "map<string,variant>")
        listed = _last_of_each(F.map_entries(parsed))
        return F.coalesce(F.map_from_entries(listed), F.from_json(F.lit("{}"), "map<string,variant>"))

    def merged(both: Column) -> Column:
        was, now = both["was"], both["now"]
        replaced = F.transform_values(
            was, lambda k, v: F.when(F.map_contains_key(now, k), F.try_element_at(now, k)).otherwise(v))
        added = F.map_filter(now, lambda k, v: ~F.map_contains_key(was, k))
        return F.to_json(F.map_concat(replaced, added))

    pair = F.struct(as_map(_col(old)).alias("was"), as_map(_col(new)).alias("now"))
    return let(pair, merged)


def _if_possible(text: Column, needles: Sequence[Column], found: Column) -> Column:
    """``found``, looked up only where the raw text has a needle or an escape that may hide one."""
    possible = F.contains(text, F.lit("\\"))
    for needle in needles:
        possible = possible | F.contains(text, needle)
    return F.coalesce(F.when(possible, found), F.lit(False))


# --- text of any depth ------------------------------------------------------------------------

def contains_anywhere(doc: Column | str, needle: str) -> Column:
    """Case-insensitive match on any key or scalar value at any depth."""
    scalars = F.regexp_extract_all(_col(doc), F.lit(_SCALAR), F.lit(0))
    wanted = F.lower(F.lit(needle))

    def text(t: Column) -> Column:
        return F.when(F.startswith(t, F.lit('"')), _unquote(t)).otherwise(t)

    found = F.exists(scalars, lambda t: F.contains(F.lower(text(t)), wanted))
    return _if_possible(F.lower(_col(doc)), [wanted], found)


def has_marker(doc: Column | str, markers: Sequence[str]) -> Column:
    """True when a string value (not a key) at any depth contains one of ``markers``."""
    tokens = F.regexp_extract_all(_col(doc), F.lit(_TOKEN), F.lit(0))
    values = F.filter(tokens, lambda t: F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"')))

    def marked(t: Column) -> Column:
        text = _unquote(t)
        hit = F.lit(False)
        for marker in markers:
            hit = hit | F.contains(text, F.lit(marker))
        return hit

    return _if_possible(_col(doc), [F.lit(m) for m in markers], F.exists(values, marked))


def summary_text(doc: Column | str) -> Column:
    """``key: value`` pairs and list items joined by `` / `` at every depth."""
    tokens = F.regexp_extract_all(_col(doc), F.lit(_TOKEN), F.lit(0))

    def spoken(t: Column) -> Column:
        is_text = F.startswith(t, F.lit('"'))
        key = F.regexp_replace(t, r"\s*:$", "")
        return (
            F.when(t == ",", F.lit(" / "))
            .when(is_text & F.endswith(t, F.lit('"')), _unquote(t))
            .when(is_text, F.concat(_unquote(key), F.lit(": ")))
            .when(t == "true", "True").when(t == "false", "False").when(t == "null", "None")
            .otherwise(t)
        )

    return F.array_join(F.transform(tokens, spoken), "")


def parse_maybe_json(c: Column | str) -> Column:
    """Struct (json, text): ``json`` only for valid objects and lists, else the text; blank is NULL."""
    def split(raw: Column) -> Column:
        bare = blank_to_null(F.trim(raw))
        shaped = bare.rlike(r"(?s)^[\[{].*[\]}]$")
        parses = F.try_parse_json(bare).isNotNull() | F.json_object_keys(bare).isNotNull()
        valid = F.coalesce(shaped & parses, F.lit(False))
        return F.struct(
            F.when(valid, bare).alias("json"), F.when(bare.isNotNull() & ~valid, raw).alias("text")
        )

    return let(_col(c), split)


def _is_kind(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _first_row(doc: Column) -> Column:
    """First table row of a variant document, as a variant."""
    def row_of(t: Column) -> Column:
        listed = F.filter(t.try_cast("array<variant>"), lambda x: _is_kind(x, "OBJECT"))
        return F.when(_is_kind(t, "OBJECT"), t).otherwise(F.get(listed, F.lit(0)))

    tables = F.try_variant_get(doc, "$.tables", "array<variant>")
    rows = F.filter(F.transform(tables, row_of), lambda x: x.isNotNull())
    return F.coalesce(F.get(rows, F.lit(0)), F.parse_json(F.lit("{}")))


def first_row(doc: Column | str) -> Column:
    """First table row (an object) in ``tables``: an object itself or the first one in a list."""
    return F.to_json(_first_row(F.try_parse_json(_col(doc))))


def _field_text(doc: Column, key: str) -> Column:
    """Text of a field of a variant, NULL when absent or null."""
    value = F.try_variant_get(doc, _sql_path(key), "variant")
    return let(value, lambda v: F.when(~F.is_variant_null(v), summary_text(F.to_json(v))))


def _first_filled(doc: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(*[blank_to_null(_field_text(doc, k)) for k in keys])


def _summary(c: Column | str, parts: Callable[[Column, Column], list[Column]]) -> Column:
    def from_object(doc: Column) -> Column:
        return let(_first_row(doc), lambda row: join_distinct(parts(doc, row)))

    def spoken(raw: Column) -> Column:
        bare = F.trim(raw)
        looks = bare.rlike(r"(?s)^[\[{].*[\]}]$")

        def by_kind(doc: Column) -> Column:
            return (
                F.when(doc.isNotNull() & F.startswith(bare, F.lit("{")), from_object(doc))
                .when(doc.isNotNull(), let(summary_text(bare), compact_text))
                .otherwise(compact_text(raw))
            )

        return let(F.when(looks, F.try_parse_json(bare)), by_kind)

    return let(_col(c), spoken)


def summarize_jcr(c: Column | str) -> Column:
    return _summary(c, lambda doc, row: [
        _field_text(doc, "text"), *[_field_text(row, k) for k in rules.JCR_ROW_KEYS],
    ])


def summarize_citescore(c: Column | str) -> Column:
    def parts(doc: Column, row: Column) -> list[Column]:
        score = blank_to_null(_field_text(row, "CiteScore"))
        ranks = F.try_variant_get(row, _sql_path(rules.CITESCORE_RANKS), "array<variant>")
        first = F.get(ranks, F.lit(0))
        return [
            F.concat(F.lit("CiteScore "), score),
            *[_field_text(first, k) for k in rules.CITESCORE_RANK_KEYS],
        ]

    return _summary(c, parts)


def summarize_partition(c: Column | str) -> Column:
    return _summary(c, lambda doc, row: [
        _field_text(doc, "text"), *[_first_filled(row, keys) for keys in rules.PARTITION_ROW_KEYS],
    ])


# --- canonical fields -----------------------------------------------------------------------

def canonical_fields(
    labels: Column | str, label_rules: Sequence[tuple[str, str]] = rules.LABEL_RULES_FIXED
) -> Column:
    """Raw label map plus canonical names: first matching rule per label, last label per name."""
    def target(label: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(None).cast("string"))
        for pattern, name in label_rules:
            chain = chain.when(label.rlike(f"(?i)(?:{pattern})"), F.lit(name))
        return chain

    def with_value(pair: Column) -> Column:
        number = decimal_in_text(pair["value"]).cast("string")
        value = F.when(pair["key"].isin(*rules.DECIMAL_TARGETS), number).otherwise(pair["value"])
        return F.struct(pair["key"].alias("key"), value.alias("value"))

    def named(raw: Column) -> Column:
        pairs = F.transform(raw, lambda e: F.struct(target(e["key"]).alias("key"), e["value"].alias("value")))
        known = F.filter(pairs, lambda p: p["key"].isNotNull())
        return F.map_from_entries(_last_of_each(F.concat(raw, F.transform(known, with_value))))

    return let(F.map_entries(_col(labels)), named)


def effective_id(extra: Column | str, own: Column | str) -> Column:
    """Fetch id, else resolved id, else the own id; unusable extra data means the own id."""
    def positive(field: str) -> Column:
        text = F.get_json_object(_col(extra), f"$.{field}")
        return F.when(~text.isin("", "0", "false"), text)

    chosen = F.coalesce(positive("fetch_journal_id"), positive("resolved_journal_id"))
    return F.coalesce(F.trim(chosen).try_cast("long"), _col(own).try_cast("long"))
