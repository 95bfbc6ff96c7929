"""Byte-level BPE over whole texts, exactly as the vocabulary's own library gives it.

A text is split into pre-tokens by the published pattern; each pre-token is encoded by itself. Texts
with characters for which two regular-expression engines could differ (rare scripts, unusual spaces)
go to the `tokenizers` library whole, so results are the library's in every case.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

#: Letters, digits, marks and spaces that every engine classifies alike.
SAFE = r"[^\n\r\t -~¡-ſΑ-ΡΣ-ωА-я‐-‧ぁ-ゔァ-ヺ一-龥가-힣]"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """One worker's encoder; `get` keeps one for each vocabulary file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        self.plain = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not spec.get("normalizer")
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.bytes_to_id = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special} if self.plain else {}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.unsafe = regex.compile(SAFE)
        self._ranked = None

    def ranked(self):
        """The same vocabulary in the library for rank files: ids in merge order are ranks."""
        if self._ranked is None:
            import public_tokenizers
            import tiktoken

            self._ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.bytes_to_id, special_tokens={})
        return self._ranked

    def simple(self, text: str) -> bool:
        """Whether the pattern splits this text as the library does."""
        return bool(self.plain) and not any(s in text for s in self.special) and (text.isascii() and text.isprintable() or self.unsafe.search(text) is None)

    def ids(self, text: str) -> list[int]:
        if self.simple(text):
            return self.ranked().encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=4)
def get(path: str) -> Bpe:
    return Bpe(path)
