"""Per-process memo of work on single words.  It changes speed only: a full memo starts anew."""
from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value
