"""Byte-level BPE: encoding by contiguous rank arrays, and decoding.

A word is held as a list of its parts and a list with the rank of each adjacent pair. The smallest rank is looked
for again and again; the boundary it stands for is deleted and the two ranks beside it are refreshed. Long words
take a heap instead of the scan, by the same rule: smallest rank first, leftmost among equals.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
from array import array
from functools import cache

import numpy as np
import regex

from millrace.llm.word_cache import WordCache

#: Fixed value of the byte-level scheme: words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NO_RANK = 1 << 62
SHORT_WORD = 256
_SPACE_BEFORE_SPACE = re.compile(r" \s")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, then the rest."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(byte): byte for byte in printable}
    others = (byte for byte in range(256) if byte not in set(printable))
    return letters | {chr(256 + k): byte for k, byte in enumerate(others)}


class ByteBpe:
    """Ids of texts, equal to those of the ``tokenizers`` library without added special tokens."""

    def __init__(self, path: str, cached_words: int = 300_000):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary, letters = content["model"]["vocab"], byte_letters()
        self.bytes_of: dict[int, bytes] = {}
        for token, token_id in vocabulary.items():
            self.bytes_of[token_id] = bytes(letters[letter] for letter in token)
        self.special: dict[str, int] = {}
        for added in content["added_tokens"]:
            self.special[added["content"]] = added["id"]
            self.bytes_of[added["id"]] = added["content"].encode()
        self.byte_id = [vocabulary[letter] for letter, _ in sorted(letters.items(), key=lambda item: item[1])]
        # Of a pair of ids, as one integer: rank and merged id, as one integer that orders by rank.
        self.rank: dict[int, int] = {}
        for rank, merge in enumerate(content["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[vocabulary[left] << ID_BITS | vocabulary[right]] = rank << ID_BITS | vocabulary[left + right]
        self.words = regex.compile(PATTERN)
        self.splits = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.ids_of_word = WordCache(lambda word: self._packed(self.word_ids(word.encode())), cached_words)
        self.ids_after_space = WordCache(lambda chunk: self._chunk(" " + chunk), cached_words)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.ids_of_word.__getitem__, self.words.findall(chunk)))

    def word_ids(self, word: bytes) -> list[int]:
        ids = [self.byte_id[byte] for byte in word]
        return self._by_scan(ids) if len(ids) <= SHORT_WORD else self._by_heap(ids)

    def _by_scan(self, ids: list[int]) -> list[int]:
        find = self.rank.get
        ranks = [find(left << ID_BITS | right, NO_RANK) for left, right in zip(ids, ids[1:], strict=False)]
        ranks.append(NO_RANK)
        while (least := min(ranks)) != NO_RANK:
            at = ranks.index(least)
            merged = least & ID_MASK
            ids[at] = merged
            del ids[at + 1], ranks[at]
            if at + 1 < len(ids):
                ranks[at] = find(merged << ID_BITS | ids[at + 1], NO_RANK)
            if at:
                ranks[at - 1] = find(ids[at - 1] << ID_BITS | merged, NO_RANK)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        size = len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        alive = [True] * size
        heap = []

        def push(at: int) -> None:
            if at >= 0 and after[at] < size:
                pair = ids[at] << ID_BITS | ids[after[at]]
                if pair in self.rank:
                    heapq.heappush(heap, (self.rank[pair], at, pair))

        for at in range(size - 1):
            push(at)
        while heap:
            rank, at, pair = heapq.heappop(heap)
            follower = after[at]
            if not alive[at] or follower >= size or ids[at] << ID_BITS | ids[follower] != pair:
                continue
            ids[at], alive[follower] = rank & ID_MASK, False
            after[at] = after[follower]
            if after[at] < size:
                before[after[at]] = at
            push(at)
            push(before[at])
        return [token for token, living in zip(ids, alive, strict=True) if living]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; strings of special tokens are those tokens."""
        if self.splits is None or not any(special in text for special in self.special):
            return self._plain(text)
        pieces = self.splits.split(text)
        return b"".join(
            self._packed([self.special[piece]]) if k % 2 else self._plain(piece) for k, piece in enumerate(pieces)
        )

    def _plain(self, text: str) -> bytes:
        """Cut before single spaces, where a word of ``PATTERN`` always begins: most chunks are one or two words.

        A space ends the word before it if that is no white space, and begins the next word if what follows is
        none; only a space between white space is uncertain, and then the whole text is cut by the pattern.
        """
        if text.endswith(" ") or _SPACE_BEFORE_SPACE.search(text):
            return b"".join(map(self.ids_of_word.__getitem__, self.words.findall(text)))
        first, *rest = text.split(" ")
        return self._chunk(first) + b"".join(map(self.ids_after_space.__getitem__, rest))

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cache
def byte_bpe(path: str) -> ByteBpe:
    """One encoder per worker process."""
    return ByteBpe(path)
