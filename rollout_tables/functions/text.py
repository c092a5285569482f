"""Small string helpers with Python ``str`` semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Unicode white space: what \s matches in a (?U) pattern
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def py_strip(c: Column) -> Column:
    """``str.strip()``: all leading and trailing whitespace, not just spaces.
    Trimmed from both ends: a pattern tries every place of the text."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def strip_chars(c: Column, chars: str) -> Column:
    """``str.strip(chars)``."""
    return F.btrim(c, F.lit(chars))


def variant_type(v: Column) -> Column:
    """Type name of a variant value: STRING, BIGINT, ARRAY<STRING>, VOID, ..."""
    return F.schema_of_variant(v)


def variant_as_py_str(v: Column) -> Column:
    """``str(value)`` of a parsed JSON value, close enough for comparisons:
    strings as is, null as ``None``, booleans capitalised, other values as
    their JSON text (numbers print the same; containers never match a label)."""
    t = variant_type(v)
    return (F.when(v.isNull(), F.lit(None))
            .when(t == "STRING", F.try_variant_get(v, "$", "string"))
            .when(t == "VOID", F.lit("None"))
            .when(t == "BOOLEAN",
                  F.when(F.try_variant_get(v, "$", "boolean"), F.lit("True")).otherwise(F.lit("False")))
            .when(t.startswith("ARRAY") | t.startswith("OBJECT"), F.to_json(v))
            .otherwise(F.try_variant_get(v, "$", "string")))

