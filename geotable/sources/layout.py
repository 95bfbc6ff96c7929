"""The binary feature layout: eight magic bytes, a header, an optional packed tree, then features.

Header and features are size-prefixed flat buffers; the tree is 40-byte nodes, root first. This module
reads and writes those bytes; it knows nothing of Spark. Input is not trusted: every offset is checked
against the buffer, sizes have limits, and what doesn't fit raises Malformed.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field, replace

import flatbuffers
import numpy as np

from geotable.operators.index import level_bounds, tree_bytes
from geotable.operators.lifecycle import ATTRIBUTES

MAGIC = bytes.fromhex("6667620366676201")
HEADER_LIMIT = FEATURE_LIMIT = 10 << 20
NODE = np.dtype([("minx", "<f8"), ("miny", "<f8"), ("maxx", "<f8"), ("maxy", "<f8"), ("offset", "<u8")])
NESTED = (6, 7, 9, 10, 11, 12, 15, 16)
DEPTH_LIMIT = 32
#: Boxes whose curve indexes are computed together.
CHUNK = 1 << 18


class Malformed(ValueError):
    """Bytes that break the layout."""


@dataclass
class Column:
    name: str
    type: int = 11
    title: str | None = None
    description: str | None = None
    width: int = -1
    precision: int = -1
    scale: int = -1
    nullable: bool = True
    unique: bool = False
    primary_key: bool = False
    metadata: str | None = None


@dataclass
class Crs:
    org: str | None = None
    code: int = 0
    name: str | None = None
    description: str | None = None
    wkt: str | None = None
    code_string: str | None = None


@dataclass
class Header:
    name: str | None = None
    envelope: list[float] | None = None
    geometry_type: int = 0
    has_z: bool = False
    has_m: bool = False
    has_t: bool = False
    has_tm: bool = False
    columns: list[Column] = field(default_factory=list)
    features_count: int = 0
    index_node_size: int = 16
    crs: Crs | None = None
    title: str | None = None
    description: str | None = None
    metadata: str | None = None


# -- flat buffers, read --------------------------------------------------------------------------


class Table:
    """A table in a buffer; fields are found by their number."""

    __slots__ = ("buf", "pos", "vt", "n")

    def __init__(self, buf: bytes, pos: int):
        self.buf, self.pos = buf, pos
        self.vt = pos - _get("<i", buf, pos)
        self.n = _get("<H", buf, self.vt)

    @classmethod
    def root(cls, buf: bytes) -> Table:
        return cls(buf, _get("<I", buf, 0))

    def at(self, i: int) -> int:
        o = 4 + 2 * i
        if o + 2 > self.n:
            return 0
        rel = _get("<H", self.buf, self.vt + o)
        return self.pos + rel if rel else 0

    def scalar(self, i: int, kind: str, default):
        at = self.at(i)
        return _get(kind, self.buf, at) if at else default

    def _ref(self, i: int) -> int:
        at = self.at(i)
        return at + _get("<I", self.buf, at) if at else 0

    def table(self, i: int) -> Table | None:
        at = self._ref(i)
        return Table(self.buf, at) if at else None

    def tables(self, i: int) -> list[Table]:
        at = self._ref(i)
        if not at:
            return []
        n = _get("<I", self.buf, at)
        if at + 4 + 4 * n > len(self.buf):
            raise Malformed("a vector exceeds its buffer")
        return [Table(self.buf, p + _get("<I", self.buf, p)) for p in range(at + 4, at + 4 + 4 * n, 4)]

    def vector(self, i: int, kind: str) -> np.ndarray | None:
        at = self._ref(i)
        if not at:
            return None
        n, size = _get("<I", self.buf, at), np.dtype(kind).itemsize
        if at + 4 + n * size > len(self.buf):
            raise Malformed("a vector exceeds its buffer")
        return np.frombuffer(self.buf, kind, n, at + 4)

    def text(self, i: int) -> str | None:
        raw = self.vector(i, "u1")
        try:
            return None if raw is None else raw.tobytes().decode("utf-8")
        except UnicodeDecodeError as e:
            raise Malformed(str(e)) from e


def _get(kind: str, buf: bytes, at: int):
    if at < 0:
        raise Malformed("an offset lies before its buffer")
    try:
        return struct.unpack_from(kind, buf, at)[0]
    except struct.error as e:
        raise Malformed("an offset lies beyond its buffer") from e


def check_magic(raw: bytes) -> None:
    """Accepts major versions up to 3 and any patch level."""
    if len(raw) < 8 or raw[:3] != MAGIC[:3] or raw[4:7] != MAGIC[4:7] or raw[3] > MAGIC[3]:
        raise Malformed("not a feature file")


def check_header_size(n: int) -> int:
    if not 8 <= n <= HEADER_LIMIT:
        raise Malformed(f"a header of {n} bytes")
    return n


def column_of(t: Table) -> Column:
    return Column(
        t.text(0) or "", t.scalar(1, "<B", 0), t.text(2), t.text(3), t.scalar(4, "<i", -1), t.scalar(5, "<i", -1), t.scalar(6, "<i", -1),
        bool(t.scalar(7, "<B", 1)), bool(t.scalar(8, "<B", 0)), bool(t.scalar(9, "<B", 0)), t.text(10),
    )


def read_header(buf: bytes) -> Header:
    """A header from its flat buffer (without size prefix)."""
    t = Table.root(buf)
    envelope, crs = t.vector(1, "<f8"), t.table(10)
    return Header(
        name=t.text(0), envelope=None if envelope is None else envelope.tolist(), geometry_type=t.scalar(2, "<B", 0),
        has_z=bool(t.scalar(3, "<B", 0)), has_m=bool(t.scalar(4, "<B", 0)), has_t=bool(t.scalar(5, "<B", 0)), has_tm=bool(t.scalar(6, "<B", 0)),
        columns=[column_of(c) for c in t.tables(7)], features_count=t.scalar(8, "<Q", 0), index_node_size=t.scalar(9, "<H", 16),
        crs=crs and Crs(crs.text(0), crs.scalar(1, "<i", 0), crs.text(2), crs.text(3), crs.text(4), crs.text(5)),
        title=t.text(11), description=t.text(12), metadata=t.text(13),
    )


def tree_size(h: Header) -> int:
    return tree_bytes(h.features_count, h.index_node_size) if h.index_node_size and h.features_count else 0


def _part(t: Table, code: int, path: list[int]) -> dict:
    arrays = {n: t.vector(i, k) for n, i, k in (("ends", 0, "<u4"), ("xy", 1, "<f8"), ("z", 2, "<f8"), ("m", 3, "<f8"), ("t", 4, "<f8"), ("tm", 5, "<u8"))}
    xy = arrays["xy"]
    n = 0 if xy is None else len(xy) // 2
    if xy is not None and len(xy) % 2:
        raise Malformed("an odd number of ordinates")
    ends = arrays["ends"]
    if ends is not None and len(ends) and (int(ends[-1]) > n or (ends[1:] < ends[:-1]).any()):
        raise Malformed("ends fall or exceed the points")
    for k in ("z", "m", "t", "tm"):
        if arrays[k] is not None and len(arrays[k]) not in (0, n):
            raise Malformed(f"{k} has another length than the points")
    return {"path": path, "type": code} | arrays


def read_geometry(t: Table, header_type: int) -> dict:
    """{type, parts} of a geometry; nested ones become parts with paths."""
    code = header_type or t.scalar(6, "<B", 0)
    parts: list[dict] = []
    left = [len(t.buf) // 4]  # tables that the buffer has room for: parts that refer to each other end here

    def walk(t: Table, code: int, path: list[int]) -> None:
        left[0] -= 1
        if len(path) > DEPTH_LIMIT or left[0] < 0:
            raise Malformed("geometries nest too deep")
        inner = t.tables(7) if code in NESTED else []
        if not inner:
            if code not in NESTED or t.vector(1, "<f8") is not None:
                parts.append(_part(t, code, path))
            return
        for i, p in enumerate(inner):
            walk(p, 3 if code == 6 else p.scalar(6, "<B", 0), [*path, i])

    walk(t, code, [])
    return {"type": code, "parts": parts}


_FIXED = {0: "<b", 1: "<B", 2: "<?", 3: "<h", 4: "<H", 5: "<i", 6: "<I", 7: "<q", 8: "<Q", 9: "<f", 10: "<d"}


def read_properties(raw: bytes, columns: list[Column], wanted: set[int] | None = None) -> dict[int, object]:
    """Values by column number; what isn't there is null, the last of repeated ones wins. Stops once `wanted` is complete only at the end, since later pairs win."""
    out: dict[int, object] = {}
    at, n = 0, len(raw)
    while at + 2 <= n:
        i = _get("<H", raw, at)
        at += 2
        if i >= len(columns):
            raise Malformed(f"column {i} of {len(columns)}")
        code = columns[i].type
        if code in _FIXED:
            v = _get(_FIXED[code], raw, at)
            at += struct.calcsize(_FIXED[code])
        elif code < len(ATTRIBUTES):
            size = _get("<I", raw, at)
            at += 4
            if at + size > n:
                raise Malformed("a value exceeds its buffer")
            v = bytes(raw[at : at + size])
            at += size
            if code != 14:
                try:
                    v = v.decode("utf-8")
                except UnicodeDecodeError as e:
                    raise Malformed(str(e)) from e
        else:
            raise Malformed(f"unknown column type {code}")
        if wanted is None or i in wanted:
            out[i] = v
    return out


def read_feature(buf: bytes, header: Header, geometry: bool = True, wanted: set[int] | None = None) -> tuple[dict | None, dict[int, object]]:
    """(geometry or None, properties) of a feature's flat buffer (without size prefix)."""
    t = Table.root(buf)
    g = t.table(0)
    raw = t.vector(1, "u1")
    props = {} if raw is None or wanted == set() else read_properties(raw.tobytes(), header.columns, wanted)
    return (read_geometry(g, header.geometry_type) if geometry and g is not None else None), props


def box_of(geometry: dict | None) -> tuple[float, float, float, float] | None:
    """The box of all coordinates; NaN ordinates are ignored."""
    if geometry is None:
        return None
    xs = [p["xy"][0::2] for p in geometry["parts"] if p["xy"] is not None and len(p["xy"])]
    ys = [p["xy"][1::2] for p in geometry["parts"] if p["xy"] is not None and len(p["xy"])]
    if not xs:
        return None
    x, y = np.concatenate(xs), np.concatenate(ys)
    x, y = x[~np.isnan(x)], y[~np.isnan(y)]
    return (float(x.min()), float(y.min()), float(x.max()), float(y.max())) if len(x) and len(y) else None


# -- the tree ------------------------------------------------------------------------------------


def search_tree(raw: bytes, n: int, node_size: int, rect) -> list[int]:
    """Leaf numbers whose box meets the rectangle, ascending. Children are counted, offsets of inner nodes are not trusted."""
    nodes = np.frombuffer(raw, NODE)
    bounds = level_bounds(n, node_size)
    meets = (nodes["minx"] <= rect[2]) & (nodes["maxx"] >= rect[0]) & (nodes["miny"] <= rect[3]) & (nodes["maxy"] >= rect[1])
    kept = np.array([0])
    for level in range(len(bounds) - 1, -1, -1):
        start, end = bounds[level]
        kept = kept[meets[start + kept]]
        if level:
            below = bounds[level - 1][1] - bounds[level - 1][0]
            kept = (kept[:, None] * node_size + np.arange(node_size)).ravel()
            kept = kept[kept < below]
    return kept.tolist()


def search_levels(read, n: int, node_size: int, rect, gap: int, most: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, offsets, ends) of the leaves that meet the rectangle, reading no more of a tree than the search visits; an end of -1 is the last leaf's.

    `read(at, n)` gives bytes of the tree. Children that lie at most `gap` bytes apart are read together; with `most`, so are
    others, nearest first, until the leaves are at most most[0] reads and any level above most[1].
    """
    bounds = level_bounds(n, node_size)
    kept = np.array([0], dtype=np.int64)
    for level in range(len(bounds) - 1, -1, -1):
        start, end = bounds[level]
        if level < len(bounds) - 1:
            kept = (kept[:, None] * node_size + np.arange(node_size)).ravel()
            kept = kept[kept < end - start]
        last = np.minimum(kept + 1, end - start - 1)  # a leaf ends where the next one starts
        nodes, after = nodes_at(read, start, kept, gap, last if level == 0 else None, most and most[level > 0])
        meets = (nodes["minx"] <= rect[2]) & (nodes["maxx"] >= rect[0]) & (nodes["miny"] <= rect[3]) & (nodes["maxy"] >= rect[1])
        if not level:
            ends = np.where(kept[meets] + 1 < n, after["offset"][meets].astype(np.int64), -1)
            return kept[meets], nodes["offset"][meets].astype(np.int64), ends
        kept = kept[meets]
    raise AssertionError


def breaks(gaps: np.ndarray, gap: int, most: int | None = None) -> np.ndarray:
    """Places of the gaps above `gap` by which runs are kept apart; with `most`, of the widest ones, so that there are at most so many runs."""
    out = np.flatnonzero(gaps > gap)
    return out if most is None or len(out) < most else np.sort(out[np.argsort(-gaps[out], kind="stable")[: most - 1]])


def nodes_at(read, start: int, numbers: np.ndarray, gap: int, after: np.ndarray | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a level by number (rising), and those of `after`; a run of near ones is one read, and there are at most `most`."""
    out, more = np.zeros(len(numbers), NODE), np.zeros(len(numbers), NODE)
    if not len(numbers):
        return out, more
    cuts = breaks((np.diff(numbers) - 1) * NODE.itemsize, gap, most) + 1
    for part in np.split(np.arange(len(numbers)), cuts):
        a, b = int(numbers[part[0]]), int((numbers if after is None else after)[part[-1]]) + 1
        block = np.frombuffer(read((start + a) * NODE.itemsize, (b - a) * NODE.itemsize), NODE)
        if len(block) < b - a:
            raise Malformed("the index is cut short")
        out[part] = block[numbers[part] - a]
        if after is not None:
            more[part] = block[after[part] - a]
    return out, more


def leaf_offsets(raw: bytes, n: int, node_size: int) -> np.ndarray:
    start, end = level_bounds(n, node_size)[0]
    return np.frombuffer(raw, NODE)["offset"][start:end].astype(np.int64)


def build_tree(boxes: np.ndarray, offsets: np.ndarray, node_size: int) -> bytes:
    return tree_nodes(boxes, offsets, node_size).tobytes()


def tree_nodes(boxes: np.ndarray, offsets: np.ndarray, node_size: int) -> np.ndarray:
    """Nodes root first; boxes (n, 4) and offsets are in leaf order."""
    bounds = level_bounds(len(boxes), node_size)
    nodes = np.zeros(bounds[0][1], NODE)
    for level, (start, end) in enumerate(bounds):
        if level:
            below, stop = bounds[level - 1]
            firsts = np.arange(below, stop, node_size)
            children = nodes[below:stop]
            for k, fold in (("minx", np.minimum), ("miny", np.minimum), ("maxx", np.maximum), ("maxy", np.maximum)):
                nodes[k][start:end] = fold.reduceat(children[k], firsts - below)
            nodes["offset"][start:end] = firsts
        else:
            for i, k in enumerate(("minx", "miny", "maxx", "maxy")):
                nodes[k][start:end] = boxes[:, i]
            nodes["offset"][start:end] = offsets
    return nodes


def hilbert_order(boxes: np.ndarray) -> np.ndarray:
    """Indexes of boxes by falling curve index of their centres in the common extent; ties keep their order."""
    low, high = boxes[:, :2].min(axis=0), boxes[:, 2:].max(axis=0)
    falling = np.empty(len(boxes), np.int64)
    for k in range(0, len(boxes), CHUNK):
        falling[k : k + CHUNK] = -_hilbert(boxes[k : k + CHUNK], low, high - low)
    return np.argsort(falling, kind="stable")


def _hilbert(boxes: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    from geotable.functions.hilbert import MAX

    with np.errstate(all="ignore"):
        grid = np.where(size == 0, 0, np.floor(MAX * ((boxes[:, :2] + boxes[:, 2:]) / 2 - low) / size))
    grid = np.clip(np.nan_to_num(grid), 0, MAX).astype(np.int64)
    x, y = grid[:, 0], grid[:, 1]
    d, swap, flip = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for level in range(15, -1, -1):
        bx, by = x >> level & 1, y >> level & 1
        rx, ry = np.where(swap, by, bx) ^ flip, np.where(swap, bx, by) ^ flip
        d = d << 2 | (3 * rx) ^ ry
        turn = ry == 0
        flip = np.where(turn, flip ^ rx, flip)
        swap = np.where(turn, swap ^ 1, swap)
    return d


# -- flat buffers, written -----------------------------------------------------------------------


def _strings(b: flatbuffers.Builder, values: list[str | None]) -> list[int]:
    return [0 if v is None else b.CreateString(v) for v in values]


def _vector(b: flatbuffers.Builder, values, kind: str) -> int:
    return 0 if values is None else b.CreateNumpyVector(np.ascontiguousarray(values, dtype=kind))


def _offsets(b: flatbuffers.Builder, values: list[int]) -> int:
    b.StartVector(4, len(values), 4)
    for v in reversed(values):
        b.PrependUOffsetTRelative(v)
    return b.EndVector()


def _refs(b: flatbuffers.Builder, refs: dict[int, int]) -> None:
    for i, r in refs.items():
        if r:
            b.PrependUOffsetTRelativeSlot(i, r, 0)


def _column(b: flatbuffers.Builder, c: Column) -> int:
    name, title, description, metadata = _strings(b, [c.name, c.title, c.description, c.metadata])
    b.StartObject(11)
    _refs(b, {0: name, 2: title, 3: description, 10: metadata})
    b.PrependUint8Slot(1, c.type, 0)
    for i, v in ((4, c.width), (5, c.precision), (6, c.scale)):
        b.PrependInt32Slot(i, v, -1)
    for i, v, d in ((7, c.nullable, True), (8, c.unique, False), (9, c.primary_key, False)):
        b.PrependBoolSlot(i, v, d)
    return b.EndObject()


def write_header(h: Header) -> bytes:
    """A header as a size-prefixed flat buffer."""
    b = flatbuffers.Builder(1024)
    columns = _offsets(b, [_column(b, c) for c in h.columns]) if h.columns else 0
    crs = 0
    if h.crs:
        org, name, description, wkt, code = _strings(b, [h.crs.org, h.crs.name, h.crs.description, h.crs.wkt, h.crs.code_string])
        b.StartObject(6)
        _refs(b, {0: org, 2: name, 3: description, 4: wkt, 5: code})
        b.PrependInt32Slot(1, h.crs.code, 0)
        crs = b.EndObject()
    name, title, description, metadata = _strings(b, [h.name, h.title, h.description, h.metadata])
    envelope = _vector(b, h.envelope, "<f8")
    b.StartObject(14)
    b.PrependUint64Slot(8, h.features_count, 0)
    _refs(b, {0: name, 1: envelope, 7: columns, 10: crs, 11: title, 12: description, 13: metadata})
    b.PrependUint8Slot(2, h.geometry_type, 0)
    for i, v in ((3, h.has_z), (4, h.has_m), (5, h.has_t), (6, h.has_tm)):
        b.PrependBoolSlot(i, v, False)
    b.PrependUint16Slot(9, h.index_node_size, 16)
    b.FinishSizePrefixed(b.EndObject())
    return bytes(b.Output())


def _geometry(b: flatbuffers.Builder, code: int, parts: list[dict], with_type: bool) -> int:
    """A geometry from parts whose paths start below it."""
    inner = 0
    leaf = next((p for p in parts if not p["path"]), None)
    if leaf is None and parts:
        groups: dict[int, list[dict]] = {}
        for p in parts:
            groups.setdefault(p["path"][0], []).append(p | {"path": p["path"][1:]})
        members = []
        for i in sorted(groups):
            g = groups[i]
            members.append(_geometry(b, g[0]["type"] if not g[0]["path"] else 6 if all(p["type"] == 3 for p in g) else 7, g, True))
        inner = _offsets(b, members)
    arrays = {}
    if leaf is not None:
        ends = leaf.get("ends")
        arrays = {i: _vector(b, leaf.get(n), k) for n, i, k in (("xy", 1, "<f8"), ("z", 2, "<f8"), ("m", 3, "<f8"), ("t", 4, "<f8"), ("tm", 5, "<u8"))}
        arrays[0] = _vector(b, ends if ends is not None and len(ends) > 1 else None, "<u4")
    b.StartObject(8)
    _refs(b, arrays | {7: inner})
    if with_type:
        b.PrependUint8Slot(6, code, 0)
    return b.EndObject()


def write_properties(values: list, columns: list[Column]) -> bytes:
    """Pairs of column number and value; nulls are left out."""
    return b"".join(write_property(i, v, c) for i, (v, c) in enumerate(zip(values, columns, strict=True)))


def write_property(i: int, v, c: Column) -> bytes:
    if v is None:
        return b""
    if c.type in _FIXED:
        return struct.pack("<H" + _FIXED[c.type][1], i, float(v) if c.type in (9, 10) else bool(v) if c.type == 2 else int(v))
    raw = bytes(v) if isinstance(v, bytes | bytearray) else (v if isinstance(v, str) else v.isoformat() if hasattr(v, "isoformat") else str(v)).encode("utf-8")
    return struct.pack("<HI", i, len(raw)) + raw


def write_feature(geometry: dict | None, values: list, columns: list[Column], header_type: int = 0) -> bytes:
    """A feature as a size-prefixed flat buffer."""
    b = flatbuffers.Builder(256)
    g = _geometry(b, geometry["type"], geometry["parts"], not header_type) if geometry else 0
    raw = write_properties(values, columns)
    props = b.CreateByteVector(raw) if raw else 0
    b.StartObject(3)
    _refs(b, {0: g, 1: props})
    b.FinishSizePrefixed(b.EndObject())
    return bytes(b.Output())


def with_count(h: Header, n: int, envelope: list[float] | None, node_size: int) -> Header:
    return replace(h, features_count=n, envelope=envelope, index_node_size=node_size)
