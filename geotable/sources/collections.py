"""GeoJSON collections cut into their members by brackets, a block of bytes at a time; nothing here knows Spark."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

BLOCK = 4 << 20
_QUOTE, _BACK = 34, 92
_STEP = np.zeros(256, np.int8)
_STEP[[91, 123]], _STEP[[93, 125]] = 1, -1
#: The key at the end of the text before an array.
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.S)


class _Depth:
    """Nesting from block to block: brackets within strings don't count."""

    def __init__(self) -> None:
        self.depth, self.inside, self.escaped = 0, False, False

    def of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places of the brackets of a block, and the depth after each."""
        b = np.frombuffer(raw, np.uint8)
        quote = np.flatnonzero(b == _QUOTE)
        back = np.flatnonzero(b == _BACK)
        if len(back) or self.escaped:
            first = np.concatenate([[True], np.diff(back) > 1]) if len(back) else np.zeros(0, bool)
            run = np.maximum.accumulate(np.where(first, np.arange(len(back)), 0)) if len(back) else np.zeros(0, int)
            length = np.arange(len(back)) - run + 1
            if self.escaped and len(back) and back[0] == 0:  # a run that began in the last block
                length = length + (run == 0)
            odd = np.zeros(len(b) + 1, bool)
            odd[back + 1] = length % 2 == 1
            odd[0] |= self.escaped and not (len(back) and back[0] == 0)
            quote = quote[~odd[quote]]
            last = bool(len(back)) and back[-1] == len(b) - 1
            self.escaped = bool(last and length[-1] % 2 == 1)
        at = np.flatnonzero(_STEP[b] != 0)
        outside = (np.searchsorted(quote, at) + self.inside) % 2 == 0
        self.inside = bool((len(quote) + self.inside) % 2)
        at = at[outside]
        depth = self.depth + np.cumsum(_STEP[b[at]], dtype=np.int64)
        if len(depth):
            self.depth = int(depth[-1])
        return at, depth


def pieces(read: Callable[[int], bytes], least: int) -> list[tuple[int, int]]:
    """[start, end) of runs of whole members of the array `features` of a collection, `least` bytes or more each but for the last; all of a text that has no such array; nothing of one that is cut short."""
    state, base, head, array, start, end = _Depth(), 0, b"", -1, -1, -1
    out: list[tuple[int, int]] = []
    while raw := read(BLOCK):
        at, depth = state.of(raw)
        if array < 0:
            head += raw
            for p in (base + at[(depth == 2) & (_STEP[np.frombuffer(raw, np.uint8)[at]] == 1)]).tolist():
                key = _KEY.search(head, max(0, p - 200), p)
                if head[p : p + 1] == b"[" and key and key[1] == b"features":
                    array, head = p, b""
                    break
        if array >= 0 and end < 0:
            closes = _STEP[np.frombuffer(raw, np.uint8)[at]] == -1
            over = base + at[(depth == 1) & closes & (base + at > array)]
            stop = int(over[0]) if len(over) else base + len(raw)
            firsts = base + at[(depth == 3) & ~closes]
            lasts = base + at[(depth == 2) & closes] + 1
            firsts, lasts = firsts[(firsts > array) & (firsts < stop)], lasts[(lasts > array) & (lasts <= stop)]
            if start < 0 and len(firsts):
                start = int(firsts[0])
            for b in lasts.tolist():
                if start >= 0 and b - start >= least:
                    out.append((start, b))
                    k = int(np.searchsorted(firsts, b))
                    start = int(firsts[k]) if k < len(firsts) else -1
            if len(over):
                end = stop
                if start >= 0:
                    out.append((start, stop))
                start = -1
        base += len(raw)
    if state.depth or state.inside:
        return []
    return [(0, base)] if array < 0 and head.strip() else out


def members(raw: bytes) -> list[bytes]:
    """The values of the outermost brackets of a piece."""
    at, depth = _Depth().of(raw)
    step = _STEP[np.frombuffer(raw, np.uint8)[at]]
    firsts, lasts = at[(depth == 1) & (step == 1)], at[(depth == 0) & (step == -1)] + 1
    return [raw[a:b] for a, b in zip(firsts.tolist(), lasts.tolist(), strict=False)]
