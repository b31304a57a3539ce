"""Bounded per-worker cache from byte strings to what a tokenizer makes of them."""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import Any

#: Longer byte strings are encoded but never kept.
KEEP_BYTES = 64


class WordCache(dict):
    """cache[word] is encode(word); at most two generations of `limit` words are kept over a fixed first tier.

    A word found in the old generation moves to the young one; when the young one is full, `turn` makes it
    the old one. Memory is bounded however many different words a worker meets, and frequent words stay.
    """

    def __init__(self, encode: Callable[[bytes], object], first: dict[bytes, object] | None = None, limit: int = 250_000):
        super().__init__(first or {})
        self.encode, self.first, self.limit, self.old = encode, first or {}, limit, {}

    def __missing__(self, word: bytes) -> object:
        got = self.old.get(word)
        if got is None:
            got = self.encode(word)
        if len(word) <= KEEP_BYTES:
            self[word] = got
        return got

    def turn(self) -> None:
        """To be called between texts."""
        if len(self) > self.limit + len(self.first):
            self.old = dict(self)
            self.clear()
            self.update(self.first)


_ALIVE: dict[str, Any] = {}


def worker_cache(key: str, make: Callable[[], Any]) -> Any:
    """The worker's cache of this key. A worker holds one at a time: it outlives a stage, and the caches of
    the stages before would add up."""
    if key not in _ALIVE:
        import pyarrow as pa

        _ALIVE.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _ALIVE[key] = make()
    return _ALIVE[key]
