"""Hashes of all words of a block of text at once, by tabulation hashing."""

from __future__ import annotations

import numpy as np

A, B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PLACES = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * A
    x = (x ^ (x >> np.uint64(27))) * B
    return x ^ (x >> np.uint64(31))


TABLE = mixed(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: A-Z to lower case, ASCII that is neither letter nor digit to a space, but for the line end.
WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or c == 10 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def segment_sums(b: np.ndarray, starts: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums, from cut to cut, of the random numbers that bytes look up by their
    place after the last start and their value."""
    first = np.zeros(len(b), dtype=np.int32)
    first[starts] = starts
    place = np.arange(len(b), dtype=np.int32) - np.maximum.accumulate(first)
    value = TABLE[((place & (PLACES - 1)) << 8) | b]
    if len(place) and place.max() >= PLACES:
        value *= (2 * (place // PLACES) + 1).astype(np.uint64)
    return np.add.reduceat(value, cuts)


def hash_segments(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each segment of the bytes, from one start to the next."""
    return mixed(segment_sums(b, starts, starts) + np.diff(np.append(starts, len(b))).astype(np.uint64))


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, start byte) of every word of a translated text.

    Each byte looks up a random number by its place in the word and its value;
    a word's hash is their sum, mixed with its length.
    """
    b = np.frombuffer(data, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], b > 32, [False]]).view(np.int8)))
    if not len(edges):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    starts, ends = edges[::2], edges[1::2]
    length = ends - starts
    cuts = edges if edges[-1] < len(b) else edges[:-1]
    sums = segment_sums(b, starts, cuts)[::2]
    return mixed(sums + length.astype(np.uint64)), starts
