"""Strict JSON decoding: a payload either has the expected shape throughout or counts as bad.

Leaves are decoded as variants, so that a number never silently becomes a string, and the body is
parsed inside brackets, so that trailing text after the first value makes it bad as well. Single
quotes and bare NaN are bad too. A repeated key is bad only where it is read: a variant refuses it anywhere, so a body
that fails as a variant but is well formed goes by its keys, level by level, which a map keeps as they come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodwire.functions.binding import let


_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parse_typed(body: Column, ddl: str, repeats: Callable[[Column], Column]) -> Column:
    """The one value in ``body`` as ``ddl``, else null; ``repeats(body)`` says whether a key that is read comes twice.

    It is asked only for a body that some repeated key keeps from being a variant.
    """
    whole = in_brackets(body)
    by_key = F.when(well_formed(body) & ~repeats(body), _only(F.from_json(whole, f"array<{ddl}>", _STRICT)))
    return let(F.try_parse_json(whole), lambda v: F.when(v.isNotNull(), _sole(v, ddl)).otherwise(by_key))


def plain_decode(body: Column, ddl: str) -> Column:
    """``body`` as ``ddl``, whose leaves are all texts; to be trusted only where ``is_plain`` holds."""
    return F.from_json(body, ddl, _STRICT)


def is_plain(body: Column, decoded: Column) -> Column:
    """Whether ``body`` is just what its plain decode is written as, without a null.

    Then no key is repeated, left out or unknown, no leaf is other than a text and nothing trails, so the strict decode
    has the same parts. Bodies written in another way may be good as well, but only the strict decode can tell.
    """
    return (F.to_json(decoded, {"ignoreNullFields": "false"}) == body) & ~F.contains(body, F.lit("null"))


def in_brackets(body: Column) -> Column:
    return F.concat(F.lit("["), body, F.lit("]"))


def well_formed(body: Column) -> Column:
    """Whether ``body`` is JSON, keys repeated or not."""
    return F.from_json(in_brackets(body), "array<string>", _STRICT).isNotNull()


def objects(text: Column) -> Column:
    """Objects of the JSON array ``text`` as maps that keep repeated keys; null when it is no such array."""
    return F.from_json(text, "array<map<string,string>>", _STRICT)


def twice(keys: Column, names: list[str]) -> Column:
    """Whether one of ``names`` is a repeated key of a map of ``objects``."""
    return F.exists(
        F.array(*[F.lit(n) for n in names]),
        lambda name: F.size(F.filter(F.map_keys(keys), lambda k: k == name)) > 1,
    )


def any_of(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(items, test), F.lit(False))


def read_as(text: Column, ddl: str) -> Column:
    """``text`` as ``ddl``, the last of repeated keys counting; parts of another shape are null."""
    return F.from_json(text, ddl, _STRICT)


def parse_variant(body: Column) -> Column:
    """The one value in ``body`` as a variant, else null."""
    return let(F.try_parse_json(in_brackets(body)), lambda v: _sole(v, "variant"))


def _sole(values: Column, ddl: str) -> Column:
    """The one element of a variant array as ``ddl``; parts of another shape are null."""
    return _only(F.try_variant_get(values, "$", f"array<{ddl}>"))


def _only(values: Column) -> Column:
    return let(values, lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))))


def as_array(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def at(v: Column, path: str) -> Column:
    """Sub-value, SQL null when the path is missing; a JSON null stays a variant."""
    return F.try_variant_get(v, path, "variant")


def type_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_string(v: Column) -> Column:
    return F.coalesce(type_of(v) == "STRING", F.lit(False))


def is_number(v: Column) -> Column:
    return F.coalesce(F.rlike(type_of(v), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")), F.lit(False))


def is_object(v: Column) -> Column:
    """Any object is some row of a struct; spelling out its type would walk through all that it holds."""
    return F.try_variant_get(v, "$", "struct<_:variant>").isNotNull()


def absent_or_null(v: Column) -> Column:
    return F.coalesce(type_of(v), F.lit("VOID")) == "VOID"


def optional_string(v: Column) -> Column:
    return F.coalesce(type_of(v), F.lit("VOID")).isin("VOID", "STRING")


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def number_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")
