"""Canonical JSON of nested rows, compiled from their schema into one expression: sorted keys, no blanks, ASCII with
escapes, numbers as they are shortest, no NaN or infinity."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The short escapes of JSON.
ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _hex(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def _escaped(char: Column) -> Column:
    code = F.ascii(char).cast("bigint")
    far = code - 0x10000
    pair = F.concat(_hex(F.shiftright(far, 10) + 0xD800), _hex(far.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
    known = reduce(lambda out, e: out.when(char == e[0], F.lit(e[1])), ESCAPES.items(), F.when(F.lit(False), char))
    return known.when(code.between(0x20, 0x7E), char).when(code > 0xFFFF, pair).otherwise(_hex(code))


def text(x: Column) -> Column:
    """A quoted string; only one that has something to escape is taken apart."""
    apart = F.array_join(F.transform(F.split(x, ""), _escaped), "")
    return F.concat(F.lit('"'), F.when(F.rlike(x, F.lit(r'^[ !#-\[\]-~]*$')), x).otherwise(apart), F.lit('"'))


def number(x: Column) -> Column:
    """A double with the digits that tell it apart: plain from 1e-4 up to 1e16, else with a signed exponent of two
    digits at least."""
    s = F.abs(x).cast("string")
    cut = F.split(s, "E")
    mantissa, exponent = cut[0], F.coalesce(F.get(cut, F.lit(1)).cast("int"), F.lit(0))
    whole, part = F.split(mantissa, r"\.")[0], F.regexp_replace(F.split(mantissa, r"\.")[1], "0+$", "")
    digits = F.concat(whole, part)
    sized = F.concat(
        F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part)), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")),
    )
    large = F.when(F.length(part) > exponent, F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.lit(400)))).otherwise(F.concat(F.rpad(digits, exponent + 1, F.lit("0")), F.lit(".0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    plain = F.when(exponent == 0, F.when(part == "", F.concat(whole, F.lit(".0"))).otherwise(F.concat(whole, F.lit("."), part)))
    out = plain.when((exponent > 0) & (exponent < 16), large).when((exponent < 0) & (exponent >= -4), small).otherwise(sized)
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    refused = F.raise_error(F.lit("numbers that are not finite have no canonical form")).cast("string")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), refused).otherwise(F.concat(sign, out))


def document(x: Column, kind: T.DataType) -> Column:
    """The canonical JSON of a value of the type. Dates and times are ISO text, decimals text as they stand; a
    map has string keys."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [y for i, f in enumerate(fields) for y in (F.lit(f"{',' if i else ''}{json.dumps(f.name)}:"), document(x.getField(f.name), f.dataType))]
        out = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda y: document(y, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.map_keys(x))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda k: F.concat(text(k), F.lit(":"), document(F.element_at(x, k), kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = number(x.cast("double"))
    elif isinstance(kind, (*WHOLE, T.BooleanType)):
        out = x.cast("string")
    elif isinstance(kind, (T.StringType, T.DecimalType, T.DateType)):
        out = text(x.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = text(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss") if isinstance(kind, T.TimestampNTZType) else F.date_format(F.to_utc_timestamp(x, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    else:
        raise TypeError(f"no canonical form of {kind.simpleString()}")
    return F.when(x.isNull(), "null").otherwise(out)


def document_hash(x: Column, kind: T.DataType) -> Column:
    return F.sha2(document(x, kind), 256)
