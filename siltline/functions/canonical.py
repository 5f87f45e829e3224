"""Canonical JSON text of columns: sorted keys, two spaces, ASCII escapes, a line break at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Signs with a short escape, beside the quote and the backslash.
SHORT = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quoted(text: Column) -> Column:
    """A string with quotes; signs beyond ASCII go as UTF-16 escapes. Each different sign is replaced once in the whole text."""

    def escaped(c: Column) -> Column:
        own = F.when(F.lit(False), c)
        for sign, by in SHORT.items():
            own = own.when(c == sign, by)
        return own.otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1"))

    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    signs = F.array_distinct(F.regexp_extract_all(text, F.lit("[^ -~]"), F.lit(0)))
    return F.concat(F.lit('"'), F.aggregate(signs, plain, lambda done, c: F.replace(done, c, escaped(c))), F.lit('"'))


def number(value: Column) -> Column:
    """A double as Python spells it: plain from 1e-4 to below 1e16, else with a signed exponent of two digits.

    The digits are the JVM's shortest, which for a few doubles beyond 1e16 has one digit more than need be.
    """
    text = value.cast("string")
    sign, mantissa, power = F.regexp_extract(text, "^(-?)", 1), F.regexp_extract(text, r"^-?([0-9.]+)E", 1), F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(mantissa, r"\.0$|\.", "")
    whole = F.concat(F.rpad(digits, power + 1, "0"), F.lit(".0"))
    split = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(40)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    science = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), "0"))
    plain = F.when(power.between(0, 15), F.when(F.length(digits) <= power + 1, whole).otherwise(split)).when(power.between(-4, -1), small).otherwise(science)
    return F.when(F.isnan(value), "NaN").when(F.abs(value) == float("inf"), F.concat(sign, F.lit("Infinity"))).when(text.contains("E"), F.concat(sign, plain)).otherwise(text)


def value(column: Column, kind: T.DataType, depth: int = 0) -> Column:
    """JSON text of a column of that type, nested ``depth`` levels deep; null is null."""
    inner, outer = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f'"{f.name}": '), value(column[f.name], f.dataType, depth + 1)) for f in sorted(kind, key=lambda f: f.name)]
        text = F.concat(F.lit("{" + inner), F.concat_ws("," + inner, *parts), F.lit(outer + "}")) if parts else F.lit("{}")
    elif isinstance(kind, T.ArrayType):
        parts = F.transform(column, lambda x: value(x, kind.elementType, depth + 1))
        text = F.when(F.size(column) == 0, "[]").otherwise(F.concat(F.lit("[" + inner), F.array_join(parts, "," + inner), F.lit(outer + "]")))
    elif isinstance(kind, T.MapType):
        parts = F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), value(e["value"], kind.valueType, depth + 1)))
        text = F.when(F.size(column) == 0, "{}").otherwise(F.concat(F.lit("{" + inner), F.array_join(parts, "," + inner), F.lit(outer + "}")))
    elif isinstance(kind, T.DoubleType | T.FloatType):
        text = number(column.cast("double"))
    elif isinstance(kind, T.IntegralType | T.BooleanType):
        text = column.cast("string")
    else:
        text = quoted(column.cast("string"))
    return F.when(column.isNull(), "null").otherwise(text)


def document(column: Column, kind: T.DataType) -> Column:
    return F.concat(value(column, kind), F.lit("\n"))


def digest(column: Column, kind: T.DataType) -> Column:
    return F.sha2(document(column, kind), 256)
