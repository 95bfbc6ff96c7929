"""Geometries on their way to Python: a form without null lists, and back.

Spark asks for the size of an Arrow batch before each row it adds, for which it walks the offsets of a null list from
where the last full one stood. With lists that are always null (most geometries have no z, m or times) a batch of n rows
takes time in n squared, so lists are empty on the way, and bits say which of them were null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lists of a part, in the order of their bits.
LISTS = ("path", "ends", "xy", "z", "m", "t", "tm")


def dense(geometry: Column | str) -> Column:
    """struct<type, had, parts array<struct<had, path, type, ends, xy, z, m, t, tm>>>. Bits of `had` say what isn't null: of the geometry, itself (1) and its parts (2); of a part, its lists."""
    g = F.col(geometry) if isinstance(geometry, str) else geometry
    parts = g["parts"]
    return F.struct(g["type"].alias("type"), _bits(g, parts).alias("had"), F.coalesce(F.transform(parts, _part), F.array()).alias("parts"))


def _bits(*columns: Column) -> Column:
    flags = [F.when(c.isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns)]
    return sum(flags[1:], flags[0]).cast("tinyint")


def _part(p: Column) -> Column:
    path, *others = [F.coalesce(p[n], F.array()).alias(n) for n in LISTS]
    return F.struct(_bits(*[p[n] for n in LISTS]).alias("had"), path, p["type"].alias("type"), *others)


def restored(geometry: pa.StructArray) -> pa.StructArray:
    """The Arrow column that dense() was made of; one that isn't dense as it is."""
    if geometry.type.get_field_index("had") < 0:
        return geometry
    if geometry.offset:  # lists of a slice can't be given a mask
        geometry = geometry.take(pa.array(np.arange(len(geometry))))
    lists, bits = geometry.field("parts"), np.asarray(geometry.field("had"))
    flat = lists.values
    inner = np.asarray(flat.field("had"))
    of = lambda a, there: pa.ListArray.from_arrays(a.offsets, a.values, mask=pa.array(~there))
    names = ("path", "type", *LISTS[1:])
    part = pa.StructArray.from_arrays([of(flat.field(n), inner & 1 << LISTS.index(n) > 0) if n in LISTS else flat.field(n) for n in names], names=names)
    parts = pa.ListArray.from_arrays(lists.offsets, part, mask=pa.array(bits & 2 == 0))
    return pa.StructArray.from_arrays([geometry.field("type"), parts], names=["type", "parts"], mask=pa.array(bits & 1 == 0))
