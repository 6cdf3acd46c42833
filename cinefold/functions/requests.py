"""Expressions that read and write request and document JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinefold.schemas import DOCUMENT, REQUEST

_END = "end"
# Texts that a falsy JSON number, boolean, array or object has once read as a string.
_FALSY_TEXT = r"^(-?0(\.0*)?([eE][+-]?[0-9]+)?|false|\[\s*\]|\{\s*\})$"


def to_document(record: Column) -> Column:
    """A record as JSON text that keeps its null fields."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def from_document(text: Column | str) -> Column:
    return F.from_json(text, DOCUMENT)


def request_pair(value: Column) -> Column:
    """The text parsed as the first of two array elements, the second being a marker.

    The parser stops after the first complete value and would accept text behind it; inside
    an array such text is an error, or makes the marker move.
    """
    wrapped = F.concat(F.lit("["), value, F.lit(f',{{"request_id":"{_END}"}}]'))
    return F.from_json(
        wrapped, f"array<{REQUEST.simpleString()}>", {"allowSingleQuotes": "false"}
    )


def request_record(pair: Column) -> Column:
    """The request as a struct of strings; null unless the text is one JSON object.

    `pair` should be a column made by `request_pair`, not the expression, which would then
    be evaluated for each of its uses.
    """
    whole = (F.size(pair) == 2) & (F.get(pair, F.lit(1))["request_id"] == _END)
    return F.when(whole, F.get(pair, F.lit(0)))


def is_blank(text: Column, value: Column, field: str) -> Column:
    """Whether a request field is missing, null, empty, zero, false or an empty container.

    As a string "0" counts as present and the number 0 does not; only texts that could be
    either are parsed once more, for their type.
    """
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(value), f"$.{field}", "variant"))
    return (
        F.when(text.isNull() | (text == ""), True)
        .when(text.rlike(_FALSY_TEXT), F.coalesce(kind != "STRING", F.lit(False)))
        .otherwise(False)
    )
