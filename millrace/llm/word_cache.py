"""A bounded cache of results per word that keeps the frequent ones."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class WordCache(dict):
    """Results of ``make`` by word. When full, only what is used again stays: two generations, the older is dropped."""

    def __init__(self, make: Callable[[str], Any], size: int):
        super().__init__()
        self.make, self.size = make, size
        self.older: dict = {}

    def __missing__(self, word: str) -> Any:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        self[word] = found
        return found
