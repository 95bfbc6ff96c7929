"""Types from short text, without a JVM to parse it."""

from __future__ import annotations

from pyspark.sql import types as T

_SIMPLE = {
    "boolean": T.BooleanType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "long": T.LongType(), "float": T.FloatType(),
    "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "decimal(20,0)": T.DecimalType(20, 0),
}


def data_type(text: str) -> T.DataType:
    """A type from its short text; the process that describes a source has no JVM to parse it."""
    text = text.strip()
    if text.startswith("array<"):
        return T.ArrayType(data_type(text[6:-1]))
    if text.startswith("struct<"):
        return fields_of(text[7:-1], ":")
    return _SIMPLE[text]


def fields_of(text: str, mark: str = " ") -> T.StructType:
    """A struct from "name type, ..." (or with colons)."""
    out, depth, start = T.StructType(), 0, 0
    for i, c in enumerate(text + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            name, _, kind = text[start:i].strip().partition(mark)
            out.add(name, data_type(kind))
            start = i + 1
    return out
