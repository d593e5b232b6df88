"""Word shingles of texts as 64-bit hashes, computed for many documents at once on their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
_SEED = np.random.default_rng(20240229)
# byte values: each of 256 bytes gets a random odd number; A-Z get those of a-z, and blanks are 0
_VALUE = _SEED.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _SEED.integers(1, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS = _powers(1024)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` (runs of bytes other than ASCII blanks, A-Z lower-cased), and each text's number of words."""
    global _POWERS
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = _BLANK[data]
    word = ~blank
    first = word.copy()
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    sizes = np.array([len(t) + 1 for t in texts])
    begins = np.cumsum(sizes) - sizes
    counts = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    letters = np.flatnonzero(word)
    first_letter = np.searchsorted(letters, starts) if len(letters) < len(data) // 4 else np.cumsum(word)[starts] - 1
    lengths = np.diff(np.append(first_letter, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first_letter, lengths)
    if (most := int(lengths.max())) > len(_POWERS):
        _POWERS = _powers(2 * most)
    return mixed(np.add.reduceat(_VALUE[data[letters]] * _POWERS[place], first_letter)), counts


def shingle_rows(words: np.ndarray) -> np.ndarray:
    """The hash of the shingle that begins at each word of one text; of the whole text if it has fewer than five words."""
    n = len(words)
    if n >= WORDS:
        out = words[: n - WORDS + 1] * _PLACE[0]
        for k in range(1, WORDS):
            out += words[k : n - WORDS + 1 + k] * _PLACE[k]
        return mixed(out)
    if n:
        return mixed((words * _PLACE[:n]).sum(keepdims=True) + np.uint64(n))
    return words


def in_groups(texts: list[str | None], limit: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of ``texts`` in UTF-8 of about ``limit`` bytes, with their first place."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "replace"))
        size += len(held[-1])
        if size >= limit:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def shingles_in_order(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text, its shingles' hashes in order of place, repeated ones too."""
    for _, group in in_groups(texts):
        words, counts = word_hashes(group)
        ends = np.cumsum(counts)
        for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
            yield shingle_rows(words[end - n : end])


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text, its distinct shingles' hashes in ascending order."""
    for rows in shingles_in_order(texts):
        if len(rows) > 1:
            rows = np.sort(rows)
            rows = rows[np.concatenate([[True], rows[1:] != rows[:-1]])]
        yield rows
