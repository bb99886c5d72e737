"""Hashes of words, kept per worker process in tables of bounded size."""

from __future__ import annotations

import hashlib


class WordHashes(dict):
    """word (bytes) -> unsigned integer of ``bits`` bits; starts anew when full."""

    def __init__(self, bits: int, salt: bytes = b"", most: int = 150_000) -> None:
        self.shift, self.salt, self.most = 64 - bits, salt, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.salt).digest(), "little") >> self.shift
        self[word] = value
        return value
