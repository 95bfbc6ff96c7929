"""Mutated bytes raise Malformed or decode to something; nothing else comes out of the reader."""

from __future__ import annotations

import random

import numpy as np

from geotable.sources import layout as L

COLUMNS = [L.Column("a", 5), L.Column("b", 11), L.Column("c", 14), L.Column("d", 8)]


def feature() -> bytes:
    parts = [{"path": [i], "type": 3, "ends": [4, 8], "xy": np.arange(16.0), "z": np.arange(8.0)} for i in range(2)]
    return L.write_feature({"type": 6, "parts": parts}, [7, "text", b"\x00\x01", 2**64 - 1], COLUMNS)[4:]


def test_mutated_features():
    rng, good = random.Random(1), feature()
    header = L.Header(columns=COLUMNS)
    for _ in range(3000):
        raw = bytearray(good)
        for _ in range(rng.randrange(1, 4)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        if rng.random() < 0.2:
            raw = raw[: rng.randrange(len(raw))]
        try:
            g, _ = L.read_feature(bytes(raw), header)
            L.box_of(g)
        except L.Malformed:
            pass


def test_mutated_headers():
    rng, good = random.Random(2), L.write_header(L.Header("n", [0.0, 0.0, 1.0, 1.0], 3, columns=COLUMNS, features_count=9, crs=L.Crs(code=4326)))[4:]
    for _ in range(3000):
        raw = bytearray(good)
        for _ in range(rng.randrange(1, 4)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        try:
            L.tree_size(L.read_header(bytes(raw)))
        except (L.Malformed, ValueError):
            pass
