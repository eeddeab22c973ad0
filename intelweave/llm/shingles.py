"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WIDTH = 5


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is part of a word (a letter or digit), and its lower case."""
    part = np.array([chr(c).isalnum() for c in range(0x110000)])
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(part).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    return part, lower


def shingles(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, one text after the other, and how many each has.

    A text of fewer words than width, but not none, has one shingle: all its words.
    """
    part, lower = _letters()
    size = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    inside = part[points]
    text_ends = np.cumsum(size)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    firsts = (text_ends - size)[size > 0]
    start[firsts] = inside[firsts]
    number = np.cumsum(start) - 1
    begin = np.flatnonzero(start)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    # hash of a word: its mixed code points, weighted by their place in it
    at = np.flatnonzero(inside)
    word = number[at]
    place = (at - begin[word]).astype(np.uint64)
    weighted = mix(lower[points[at]].astype(np.uint64) + np.uint64(1)) * (mix(place + np.uint64(77)) | np.uint64(1))
    cut = np.concatenate([[True], word[1:] != word[:-1]])
    words = mix(np.add.reduceat(weighted, np.flatnonzero(cut)))
    of = np.searchsorted(text_ends, begin, "right")
    n = np.bincount(of, minlength=len(texts))
    stop = np.cumsum(n)
    runs = []
    owners = []
    m = len(words) - width + 1
    if m > 0:
        whole = np.flatnonzero(of[:m] == of[width - 1 :])
        h = np.zeros(len(whole), np.uint64)
        for k in range(width):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[whole + k])
        runs.append(h)
        owners.append(of[whole])
    for t in np.flatnonzero((n > 0) & (n < width)).tolist():
        h = np.array([np.uint64(n[t])], np.uint64)
        for w in words[stop[t] - n[t] : stop[t]]:
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w)
        runs.append(h)
        owners.append(np.array([t]))
    values, owner = np.concatenate(runs), np.concatenate(owners)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])])
    return values[new], np.bincount(owner[new], minlength=len(texts))
