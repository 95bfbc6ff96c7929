"""Files by byte ranges: local paths, object stores (through pyarrow), and HTTP servers that know ranges.

A request fetches at least what is asked for and is kept until the next, so reads that follow each other share one.
Over HTTP a range that is read in pieces is one request whose reply is read on. Requests, bytes fetched and bytes used are counted.
"""

from __future__ import annotations

import os
import urllib.request
from dataclasses import dataclass

from pyarrow import fs

#: Bytes that the first request of a file fetches: a header of usual size, and the upper three levels of an index with 16 children a node.
HEADER_GUESS = 2024
PREFETCH = HEADER_GUESS + (1 + 16 + 256) * 40


def is_http(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Usage:
    """What a file's reader has asked for, and how much of it was of use."""

    requests: int = 0
    fetched: int = 0
    used: int = 0


class _Http:
    """One range a request; `headers` go with each."""

    def __init__(self, url: str, headers: dict[str, str] | None = None):
        self.url, self.headers, self.size = url, headers or {}, None
        self._reply, self._next, self._until = None, 0, 0

    def start(self, at: int, until: int) -> None:
        """Asks for a range that read_on() takes in pieces."""
        self.close()
        asked = urllib.request.Request(self.url, headers=self.headers | {"Range": f"bytes={at}-{until - 1}"})
        reply = urllib.request.urlopen(asked, timeout=120)  # noqa: S310
        if reply.status == 206:
            self.size = int(reply.headers["Content-Range"].rpartition("/")[2])
            self._reply, self._next, self._until = reply, at, until
        else:  # a server without ranges sends everything
            reply.close()

    def goes_on(self, at: int, n: int) -> bool:
        return self._reply is not None and self._next == at and at + n <= self._until

    def read_on(self, n: int) -> bytes:
        out = self._reply.read(n)
        self._next += len(out)
        return out

    def read_at(self, n: int, at: int) -> bytes:
        asked = urllib.request.Request(self.url, headers=self.headers | {"Range": f"bytes={at}-{at + n - 1}"})
        try:
            with urllib.request.urlopen(asked, timeout=120) as reply:  # noqa: S310
                raw = reply.read()
                if reply.status == 206:
                    self.size = int(reply.headers["Content-Range"].rpartition("/")[2])
                    return raw
                self.size = len(raw)  # a server without ranges sends everything
                return raw[at : at + n]
        except urllib.error.HTTPError as e:
            if e.code != 416:
                raise
            self.size = int((e.headers.get("Content-Range") or "*/0").rpartition("/")[2])
            return b""

    def close(self) -> None:
        if self._reply is not None:
            self._reply.close()
            self._reply = None


class Ranged:
    """`get` reads bytes of a file; beyond its end they are cut short."""

    def __init__(self, path: str, headers: dict[str, str] | None = None):
        self.usage = Usage()
        self._at, self._block = 0, b""
        if is_http(path):
            self._file: object = _Http(path, headers)
        else:
            system, inner = filesystem(path)
            self._file = system.open_input_file(inner)

    @property
    def size(self) -> int:
        if not isinstance(self._file, _Http):
            return self._file.size()
        if self._file.size is None:
            self.get(0, 1, PREFETCH)
        return self._file.size

    def hold(self, at: int, n: int) -> None:
        """Bytes that will be asked for piece by piece, in one request."""
        if not self._holds(at, n):
            self._fetch(at, n)

    def get(self, at: int, n: int, least: int = 0, until: int = 0) -> bytes:
        """`n` bytes from `at`; if they aren't held, a request fetches `least` or more. With `until`, a reader goes on to there."""
        if n <= 0:
            return b""
        if not self._holds(at, n):
            if until >= at + n and isinstance(self._file, _Http):
                self._read_on(at, n, until)
            if not self._holds(at, n):
                self._fetch(at, max(n, least))
        out = self._block[at - self._at : at - self._at + n]
        self.usage.used += len(out)
        return out

    def _holds(self, at: int, n: int) -> bool:
        return self._at <= at <= at + n <= self._at + len(self._block)

    def _fetch(self, at: int, n: int) -> None:
        self._block, self._at = self._file.read_at(n, at), at
        self.usage.requests += 1
        self.usage.fetched += len(self._block)

    def _read_on(self, at: int, n: int, until: int) -> None:
        kept = self._block[at - self._at :] if self._at <= at <= self._at + len(self._block) else b""
        if not self._file.goes_on(at + len(kept), n - len(kept)):
            kept = b""
            self._file.start(at, until)
            self.usage.requests += 1
        if self._file.goes_on(at + len(kept), n - len(kept)):
            more = self._file.read_on(n - len(kept))
            self.usage.fetched += len(more)
            self._block, self._at = kept + more, at

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()
