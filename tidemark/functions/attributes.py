"""Attribute maps: building, reading, packing to text and parsing back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The packed form is a#1$b#2.
PAIR_SEPARATOR = "$"
VALUE_SEPARATOR = "#"
KEY_ATTRIBUTE = "key"


def attribute_map(attributes: Mapping[str, Column]) -> Column:
    """Text map of the given columns; null columns are left out."""
    parts: list[Column] = []
    for name, column in attributes.items():
        parts += [F.lit(name), column.cast("string")]
    return F.map_filter(F.create_map(*parts), lambda _, value: value.isNotNull())


def row_attributes(columns: Sequence[str]) -> Column:
    """The whole row as an attribute map."""
    return attribute_map({name: F.col(name) for name in columns})


def json_attributes(text: Column) -> Column:
    """A JSON object as an attribute map."""
    return F.from_json(text, "map<string,string>")


def attribute(values: Column, name: str) -> Column:
    """One attribute, null when absent."""
    return F.try_element_at(values, F.lit(name))


def with_key(values: Column, key: Column) -> Column:
    """``values`` plus the key as attribute ``key``, which replaces an attribute of that name."""
    own = F.map_filter(values, lambda name, _: name != F.lit(KEY_ATTRIBUTE))
    return F.map_concat(own, F.create_map(F.lit(KEY_ATTRIBUTE), key))


def pack(values: Column) -> Column:
    """``{b: 2, a: 1}`` as ``a#1$b#2``, ordered by attribute; an empty map packs to ``''``."""
    pairs = F.transform(
        F.array_sort(F.map_entries(values)),
        lambda entry: F.concat(entry["key"], F.lit(VALUE_SEPARATOR), entry["value"]),
    )
    return F.array_join(pairs, PAIR_SEPARATOR)


def parse(packed: Column) -> Column:
    """Packed text as a map; a piece without ``#`` makes the whole text null.

    The first ``#`` of a piece ends the attribute name, and of two pieces with one name the later
    wins (this needs the last-wins map setting of :func:`tidemark.session.tune`).
    """
    parsed = F.str_to_map(packed, F.lit("[$]"), F.lit(VALUE_SEPARATOR))
    broken = F.exists(F.map_values(parsed), lambda value: value.isNull())
    return F.when(~broken, parsed)
