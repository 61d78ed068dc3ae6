"""A bounded cache of encoded words for tokenizers that treat a text word by word."""

from __future__ import annotations

from collections.abc import Callable


#: Characters of the longest key that a cache holds.
LONGEST = 64


class WordCache(dict):
    """word -> value, made by `make` on first use; keys longer than LONGEST are made each time, so that the number of entries bounds the bytes. Two generations: once `most` words are held, they age, and aged words that are used again come back; at most 2 * most are kept, and what is dropped is only made again."""

    def __init__(self, make: Callable[[str], object], most: int = 300_000):
        super().__init__()
        self.make, self.most, self.aged = make, most, {}

    def __missing__(self, word: str) -> object:
        value = self.aged.get(word)
        if value is None:
            value = self.make(word)
            if isinstance(word, str) and len(word) > LONGEST:
                return value
        if len(self) >= self.most:
            self.aged = dict(self)
            self.clear()
        self[word] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.aged = {}
