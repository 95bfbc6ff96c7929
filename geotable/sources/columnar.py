"""Features of the binary layout to Arrow and back, a batch at a time.

Offsets of all features of a batch are followed together, as NumPy gathers over one block of bytes. This covers what
most files hold: geometries of one part with x, y and optionally z and m, and every attribute type. For anything
else, or if any offset looks wrong, `decode` gives nothing and the caller reads the batch feature by feature.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

from geotable.sources import layout as L

_FIXED = {0: "<i1", 1: "<u1", 2: "<u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<i8", 8: "<u8", 9: "<f4", 10: "<f8"}


class _Block:
    """Views of a block by which any position can be read as any type; gathers at positions out of it fail."""

    def __init__(self, raw: bytes):
        self.n = len(raw)
        padded = raw + bytes(8)
        self._views = {k: np.ndarray((self.n + 1,), k, padded, strides=(1,)) for k in ("<u1", "<i1", "<u2", "<i2", "<u4", "<i4", "<u8", "<i8", "<f4", "<f8")}

    def get(self, kind: str, at: np.ndarray) -> np.ndarray:
        return self._views[kind][at]

    def u4(self, at: np.ndarray) -> np.ndarray:
        return self._views["<u4"][at].astype(np.int64)


class _Odd(Exception):
    """A batch that isn't plain."""


def _need(ok) -> None:
    if not np.all(ok):
        raise _Odd


def _slots(b: _Block, at: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> list[np.ndarray]:
    """Positions of the first n fields of tables at `at`; 0 for those that are absent."""
    _need((at >= start) & (at + 4 <= end))
    vt = at - b.get("<i4", at).astype(np.int64)
    _need((vt >= start) & (vt + 4 <= end))
    size = b.get("<u2", vt).astype(np.int64)
    _need((size >= 4) & (vt + size <= end))
    out = []
    for i in range(n):
        o = 4 + 2 * i
        has = size >= o + 2
        rel = np.where(has, b.get("<u2", np.where(has, vt + o, vt)), 0).astype(np.int64)
        pos = np.where(rel > 0, at + rel, 0)
        _need((pos == 0) | (pos + 1 <= end))
        out.append(pos)
    return out


def _vectors(b: _Block, field: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, length) of the vectors that fields refer to; length -1 for absent ones."""
    has = field > 0
    _need(~has | (field + 4 <= end))
    at = np.where(has, field + b.u4(np.where(has, field, 0)), 0)
    _need(~has | (at + 4 <= end))
    n = np.where(has, b.u4(at), -1)
    _need(~has | (at + 4 + n * width <= end))
    return at + 4, n


def _flat(first: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Positions of all elements of vectors, one after the other."""
    n = np.maximum(n, 0)
    before = np.cumsum(n) - n
    return np.repeat(first - before * width, n) + np.arange(int(n.sum())) * width


def _offsets(n: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.maximum(n, 0))]).astype(np.int32))


def _lists(values: np.ndarray, n: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = pa.array(values).cast(kind.value_type)
    return pa.ListArray.from_arrays(_offsets(n), flat, type=kind, mask=pa.array(n < 0))


def boxes_of(xy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boxes (rows, 4) of points given one row's after the other's, n of them a row, and which rows have one; NaN ordinates are ignored."""
    out = np.full((len(n), 4), np.nan)
    some = np.flatnonzero(n > 0)
    if len(some):
        at = (np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0))[some]
        x, y = xy[0::2], xy[1::2]
        with np.errstate(invalid="ignore"):
            out[some] = np.stack([np.fmin.reduceat(x, at), np.fmin.reduceat(y, at), np.fmax.reduceat(x, at), np.fmax.reduceat(y, at)], axis=1)
    return out, ~np.isnan(out).any(axis=1)


def _properties(b: _Block, first: np.ndarray, n: np.ndarray, columns: list[L.Column], wanted: dict[str, int], schema: pa.Schema) -> dict[str, pa.Array]:
    """Arrow columns of the wanted attributes, with the features' pairs of column and value followed in step."""
    rows, names = len(first), {i: name for name, i in wanted.items()}
    values = {i: np.zeros(rows, _FIXED[columns[i].type]) for i in names if columns[i].type in _FIXED}
    spans = {i: np.full((rows, 2), -1, np.int64) for i in names if columns[i].type not in _FIXED}
    valid = {i: np.zeros(rows, bool) for i in names}
    pos, stop = first.copy(), first + np.maximum(n, 0)
    while names and len(at := np.flatnonzero(pos + 2 <= stop)):
        which = b.get("<u2", pos[at])
        for c in np.unique(which).tolist():
            _need(c < len(columns))
            r = at[which == c]
            p, kind = pos[r] + 2, columns[c].type
            if kind in _FIXED:
                width = np.dtype(_FIXED[kind]).itemsize
                _need(p + width <= stop[r])
                if c in values:
                    values[c][r] = b.get(_FIXED[kind], p)
                    valid[c][r] = True
                pos[r] = p + width
            else:
                _need(kind <= 14)
                _need(p + 4 <= stop[r])
                size = b.u4(p)
                _need(p + 4 + size <= stop[r])
                if c in spans:
                    spans[c][r] = np.stack([p + 4, size], axis=1)
                    valid[c][r] = True
                pos[r] = p + 4 + size
    out = {}
    for i, name in names.items():
        kind, mask = schema.field(name).type, ~valid[i]
        if i in values:
            got = values[i] != 0 if columns[i].type == 2 else values[i]
            out[name] = pa.array(got, mask=mask).cast(kind)
        else:
            size = np.where(valid[i], spans[i][:, 1], 0)
            raw = b.get("<u1", _flat(spans[i][:, 0], size, 1))
            bits = pa.array(valid[i]).buffers()[1]
            base = pa.binary() if columns[i].type == 14 else pa.string()
            array = pa.Array.from_buffers(base, rows, [bits, _offsets(size).buffers()[1], pa.py_buffer(raw.tobytes())])
            try:
                array.validate(full=True)
            except pa.ArrowInvalid as e:
                raise _Odd from e
            out[name] = array.cast(kind)
    return out


def decode(raw: bytes, start: np.ndarray, size: np.ndarray, fid: np.ndarray, header: L.Header, wanted: dict[str, int], schema: pa.Schema, rect) -> pa.RecordBatch | None:
    """The features whose flat buffers stand at `start` of a block, `size` bytes each; None if they aren't plain, or malformed."""
    try:
        return _decoded(raw, start, size, fid, header, wanted, schema, rect)
    except (_Odd, IndexError):
        return None


def _decoded(raw, start, size, fid, header, wanted, schema, rect):
    b, end = _Block(raw), start + size
    _need((size >= 4) & (end <= b.n))
    geometry, props = _slots(b, start + b.u4(start), start, end, 2)
    has = geometry > 0
    _need(~has | (geometry + 4 <= end))
    g = np.where(has, geometry + b.u4(np.where(has, geometry, 0)), 0)
    rows = np.flatnonzero(has)
    slots = [np.zeros(len(start), np.int64) for _ in range(8)]
    for whole, some in zip(slots, _slots(b, g[rows], start[rows], end[rows], 8), strict=True):
        whole[rows] = some
    ends_, xy_, z_, m_, t_, tm_, type_, parts_ = slots
    _need((parts_ == 0) & (t_ == 0) & (tm_ == 0))
    code = np.where(type_ > 0, b.get("<u1", type_), 0) if not header.geometry_type else np.full(len(start), header.geometry_type)
    _need(~has | ~np.isin(code, L.NESTED))
    at, n2 = _vectors(b, xy_, end, 8)
    _need((n2 < 0) | (n2 % 2 == 0))
    xy, n = b.get("<f8", _flat(at, n2, 8)), np.where(n2 < 0, 0, n2 // 2)
    box, boxed = boxes_of(xy, n)
    arrays: dict[str, pa.Array] = {"fid": pa.array(fid)}
    if "bbox" in schema.names:
        kind = schema.field("bbox").type
        arrays["bbox"] = pa.StructArray.from_arrays([pa.array(box[:, i]) for i in range(4)], fields=list(kind), mask=pa.array(~boxed))
    ends_at, ends_n = _vectors(b, ends_, end, 4)
    ends = b.u4(_flat(ends_at, ends_n, 4))
    if len(ends):  # they rise within a feature and stay within its points
        of = np.repeat(np.arange(len(start)), np.maximum(ends_n, 0))
        _need((np.diff(ends) >= 0) | (np.diff(of) > 0))
        _need(ends <= n[of])
    extra = {k: _vectors(b, f, end, 8) for k, f in (("z", z_), ("m", m_))}
    for _, count in extra.values():
        _need((count <= 0) | (count == n))
    if "geometry" in schema.names:
        kind = schema.field("geometry").type
        part = kind.field("parts").type.value_type
        one = lambda name, values, count: _lists(values, count[rows], part.field(name).type)
        none = np.full(len(rows), -1)
        columns = {
            "path": _lists(np.zeros(0, np.int32), np.zeros(len(rows), np.int64), part.field("path").type), "type": pa.array(code[rows]).cast(part.field("type").type), "ends": one("ends", ends, ends_n), "xy": one("xy", xy, n2),
            **{k: one(k, b.get("<f8", _flat(f, c, 8)), c) for k, (f, c) in extra.items()}, **{k: pa.ListArray.from_arrays(_offsets(none), pa.array([], part.field(k).type.value_type), type=part.field(k).type, mask=pa.array(none < 0)) for k in ("t", "tm")},
        }
        parts = pa.StructArray.from_arrays([columns[f.name] for f in part], fields=list(part))
        parts = pa.ListArray.from_arrays(_offsets(has.astype(np.int64)), parts, type=kind.field("parts").type)
        arrays["geometry"] = pa.StructArray.from_arrays([pa.array(code).cast(kind.field("type").type), parts], fields=list(kind), mask=pa.array(~has))
    if wanted:
        arrays |= _properties(b, *_vectors(b, props, end, 1), header.columns, wanted, schema)
    out = pa.RecordBatch.from_arrays([arrays[f.name] for f in schema], schema=schema)
    if rect is not None:
        with np.errstate(invalid="ignore"):
            meets = boxed & (box[:, 0] <= rect[2]) & (box[:, 2] >= rect[0]) & (box[:, 1] <= rect[3]) & (box[:, 3] >= rect[1])
        out = out.filter(pa.array(meets))
    return out


# -- writing -------------------------------------------------------------------------------------

# size, root, two vtables (feature; geometry, two bytes of padding), then the feature's and the geometry's table, 72 bytes in all
_HEAD = struct.Struct("<II4H9H2xiIIiIIIIB3x")
_NO_GEOMETRY = struct.Struct("<II4HiII")


def _pad(n: int, to: int) -> bytes:
    return bytes(-n % to)


def encoded(code: int, xy: bytes, n: int, z: bytes | None, m: bytes | None, ends: bytes | None, props: bytes) -> bytes:
    """A size-prefixed feature with a geometry of one part; its doubles lie at multiples of 8."""
    at, body, place = 72, [], {}
    for name, raw, count, width in (("xy", xy, 2 * n, 8), ("z", z, len(z or b"") // 8, 8), ("m", m, len(m or b"") // 8, 8), ("ends", ends, 0 if ends is None else len(ends) // 4, 4), ("props", props or None, len(props), 1)):
        if raw is None:
            place[name] = 0
            continue
        gap = _pad(at + 4, 8) if width == 8 else _pad(at, 4)
        body += [gap, struct.pack("<I", count), raw]
        place[name] = at + len(gap)
        at += len(gap) + 4 + len(raw)
    tail = _pad(at, 8)
    ref = lambda name, field: place[name] - field if place[name] else 0
    slot = lambda name, o: o if place[name] else 0
    head = _HEAD.pack(
        at + len(tail) - 4, 32, 8, 12, 4, slot("props", 8), 18, 24, slot("ends", 4), slot("xy", 8), slot("z", 12), slot("m", 16), 0, 0, 20,
        28, 8, ref("props", 44), 32, ref("ends", 52), ref("xy", 56), ref("z", 60), ref("m", 64), code,
    )
    return b"".join([head, *body, tail])


def encoded_without_geometry(props: bytes) -> bytes:
    at = 28
    body = struct.pack("<I", len(props)) + props if props else b""
    tail = _pad(at + len(body), 8)
    return _NO_GEOMETRY.pack(at + len(body) + len(tail) - 4, 12, 8, 12, 0, 8 if props else 0, 8, 0, 4 if props else 0) + body + tail


def property_bytes(batch: pa.RecordBatch, columns: list[L.Column]) -> list[bytes]:
    """The pairs of column and value of each row of a batch; nulls are left out."""
    out: list[list[bytes]] = []
    for i, c in enumerate(columns):
        array = batch.column(batch.schema.get_field_index(c.name))
        if not array.null_count == len(array) and c.type in _FIXED and (pa.types.is_integer(array.type) or pa.types.is_floating(array.type) or pa.types.is_boolean(array.type)) and c.type != 8:
            pairs = np.zeros(len(array), np.dtype([("c", "<u2"), ("v", _FIXED[c.type])]))
            pairs["c"] = i
            valid = np.asarray(array.is_valid())
            pairs["v"] = np.asarray(array.fill_null(False if pa.types.is_boolean(array.type) else 0))
            raw, k = pairs.tobytes(), pairs.dtype.itemsize
            out.append([raw[j * k : j * k + k] if v else b"" for j, v in enumerate(valid.tolist())])
        else:
            out.append([L.write_property(i, v, c) for v in array.to_pylist()])
    return [b"".join(p) for p in zip(*out, strict=True)] if out else [b""] * batch.num_rows


def plain(geometry: pa.StructArray) -> np.ndarray:
    """Which rows of a geometry column `encoded` can write: those of one part without time, and nulls."""
    parts = geometry.field("parts")
    sizes = np.asarray(parts.value_lengths().fill_null(0))
    ok = np.asarray(geometry.is_null()) | (sizes == 1) & ~np.isin(np.asarray(geometry.field("type").fill_null(0)), L.NESTED)
    return ok


def encode(batch: pa.RecordBatch, columns: list[L.Column], promote: bool = False) -> tuple[list[bytes | None], np.ndarray, np.ndarray, set[int], dict[str, bool]]:
    """(size-prefixed features, None where a row isn't plain; boxes; which rows have a box; types; flags of z and m). To `promote`, lines become multi-lines; polygons, which get nested, aren't plain."""
    g = batch.column(batch.schema.get_field_index("geometry"))
    null, ok = np.asarray(g.is_null()), plain(g)
    if promote:
        ok &= null | (np.asarray(g.field("type").fill_null(0)) != 3)
    props = property_bytes(batch, columns)
    rows: list[bytes | None] = [None] * batch.num_rows
    boxes, boxed = np.full((batch.num_rows, 4), np.nan), np.zeros(batch.num_rows, bool)
    for i in np.flatnonzero(null).tolist():
        rows[i] = encoded_without_geometry(props[i])
    some = np.flatnonzero(ok & ~null)
    flags, types = {"z": False, "m": False}, set()
    if not len(some):
        return rows, boxes, boxed, types, flags
    kept = g.take(pa.array(some))
    parts = kept.field("parts").flatten()
    odd = np.zeros(len(some), bool)
    for k in ("t", "tm"):
        odd |= np.asarray(parts.field(k).value_lengths().fill_null(0)) > 0
    odd |= np.asarray(parts.field("path").value_lengths().fill_null(0)) > 0
    odd |= np.asarray(parts.field("type").fill_null(0)) != np.asarray(kept.field("type").fill_null(0))
    vectors = {}
    for k, t in (("xy", "<f8"), ("z", "<f8"), ("m", "<f8"), ("ends", "<u4")):
        a = parts.field(k)
        n = np.asarray(a.value_lengths().fill_null(0)).astype(np.int64)
        flat = a.flatten()
        odd |= False if not flat.null_count else True
        vectors[k] = (np.ascontiguousarray(np.asarray(flat.fill_null(0)), dtype=t), n, np.asarray(a.is_null()))
    xy, n2, no_xy = vectors["xy"]
    odd |= n2 % 2 == 1
    box, has = boxes_of(xy, np.where(odd, 0, n2 // 2)) if not odd.any() else (np.full((len(some), 4), np.nan), np.zeros(len(some), bool))
    if odd.any():  # rare: such batches are written feature by feature
        return [r if null[i] else None for i, r in enumerate(rows)], boxes, boxed, types, flags
    boxes[some], boxed[some] = box, has
    codes = [5 if promote and c == 2 else c for c in np.asarray(kept.field("type").fill_null(0)).tolist()]
    cut = {}
    for k, (flat, n, absent) in vectors.items():
        raw, w = flat.tobytes(), flat.dtype.itemsize
        stops = (np.cumsum(n) * w).tolist()
        cut[k] = [None if gone and k != "xy" else raw[e - c * w : e] for e, c, gone in zip(stops, n.tolist(), absent.tolist(), strict=True)]
    for j, i in enumerate(some.tolist()):
        ends = cut["ends"][j]
        z, m = cut["z"][j], cut["m"][j]
        rows[i] = encoded(codes[j], cut["xy"][j], int(n2[j]) // 2, z, m, ends if ends is not None and len(ends) > 4 else None, props[i])
    types |= set(codes)
    flags["z"], flags["m"] = bool((vectors["z"][1] > 0).any()), bool((vectors["m"][1] > 0).any())
    return rows, boxes, boxed, types, flags
