"""Prefix-free parsing of texts into phrases, by a rolling hash.

Within every window of ``length`` bytes the place with the least rolling hash (of ``gram`` bytes) is its trigger, the
leftmost of equals. Consecutive windows with one trigger are a phrase. Equal windows have equal triggers at equal
places, whatever is around them; so windows can only be equal if their phrases have equal keys, the trigger's hash.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

CHUNK = 1 << 18
PLACE_BITS = 24
_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Phrases:
    """Per phrase: number of the text, first window, number of windows, key."""

    text: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    key: np.ndarray


def rolling_hash(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from every place, by doubling."""
    power, size, level = _ODD, 1, data.astype(np.uint64) + np.uint64(1)
    whole, covered = None, 0
    levels = []
    while size <= gram:
        levels.append((size, level, power))
        if size * 2 <= gram:
            level = level[:-size] * np.uint64(power) + level[size:]
            power = power * power % (1 << 64)
        size *= 2
    for size, level, power in reversed(levels):
        if gram & size:
            if whole is None:
                whole, covered = level, size
            else:
                shared = len(level) - covered
                whole = whole[:shared] * np.uint64(power) + level[covered:]
                covered += size
    whole = whole * _MIX
    whole ^= whole >> np.uint64(32)
    return whole * _MIX


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size, least = 1, values
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - size :]) if size < width else least


def parse(texts: Iterable[bytes], length: int, gram: int) -> Phrases:
    """Phrases of all texts, in order; texts shorter than ``length`` have none."""
    found: list[Phrases] = []
    for numbers, places, chunk in _chunks(texts, length):
        found.append(_parse_chunk(numbers, places, chunk, length, gram))
    names = ("text", "first", "windows", "key")
    kinds = (np.int64, np.int64, np.int64, np.uint64)
    return Phrases(*(np.concatenate([getattr(f, name) for f in found] or [np.zeros(0, kind)]) for name, kind in zip(names, kinds, strict=True)))


def _chunks(texts: Iterable[bytes], length: int):
    """Texts put together to about ``CHUNK`` bytes; longer ones are cut with an overlap, so that each window is in one."""
    numbers: list[int] = []
    places: list[int] = []
    parts: list[bytes] = []
    size = 0
    for number, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), CHUNK):
            part = text if len(text) <= CHUNK else text[at : at + CHUNK + length - 1]
            numbers.append(number)
            places.append(at)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield numbers, places, parts
                numbers, places, parts, size = [], [], [], 0
    if parts:
        yield numbers, places, parts


def _parse_chunk(numbers: list[int], places: list[int], parts: list[bytes], length: int, gram: int) -> Phrases:
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(part) for part in parts])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    hashes = rolling_hash(data, gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    ranked = hashes & ~low | np.arange(len(hashes), dtype=np.uint64)
    trigger = (sliding_least(ranked, length - gram + 1) & low).astype(np.int64)
    inside = np.ones(len(trigger), bool)
    for end in (begins + sizes)[:-1]:
        inside[max(0, end - length + 1) : end] = False
    window = np.flatnonzero(inside)
    trigger = trigger[window]
    change = np.concatenate([[0], np.flatnonzero(trigger[1:] != trigger[:-1]) + 1])
    first = window[change]
    part = np.searchsorted(begins, first, side="right") - 1
    return Phrases(
        np.array(numbers)[part],
        first - begins[part] + np.array(places)[part],
        np.diff(np.append(change, len(window))),
        hashes[trigger[change]],
    )
