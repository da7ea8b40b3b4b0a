"""Column predicates on parsed JSON (VARIANT) values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators.
_BLANK = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Trim white space of any kind on both sides."""
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def is_blank(text: Column) -> Column:
    return text.rlike(rf"(?U)^{_BLANK}*$")


def field(value: Column, path: str) -> Column:
    return F.variant_get(value, path, "variant")


def _as(value: Column, type_name: str) -> Column:
    return F.try_variant_get(value, "$", type_name)


def is_array(value: Column) -> Column:
    """True only if the value is present and a JSON array."""
    return _as(value, "array<variant>").isNotNull()


def is_object(value: Column) -> Column:
    """True only if the value is present and a JSON object."""
    return _as(value, "map<string,variant>").isNotNull()


def is_string(value: Column) -> Column:
    # A cast would also accept numbers, so ask for the stored type.
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def is_boolean(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "BOOLEAN", F.lit(False))


def elements(value: Column) -> Column:
    """A JSON array as ``array<variant>``; SQL null unless the value is an array."""
    return _as(value, "array<variant>")


def has_key(value: Column, *names: str) -> Column:
    """True if the object holds every one of the keys, whatever their values.

    A key holding JSON null is present: its variant is not SQL null.
    """
    test = is_object(value)
    for name in names:
        test = test & field(value, f"$.{name}").isNotNull()
    return test
