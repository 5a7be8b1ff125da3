"""Words, their hashes and hashed shingles, in numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words whose hashes a Python worker keeps; then it starts afresh.
CACHED_WORDS = 150_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_known = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word `[^\\x20\\x09-\\x0D]+` of the text, A-Z lower-cased."""
    # On bytes, lower() and split() know ASCII letters and ASCII white space only.
    words = (text or "").encode("utf-8", "replace").lower().split()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n neighbouring words, in order; none if there are fewer words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    found = np.full(count, n, np.uint64)
    for k in range(n):
        found = found * _PRIME + hashes[k : k + count]
    return mix(found)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The n-grams; with fewer words the whole sequence as one, and none without words."""
    return ngrams(hashes, min(n, len(hashes))) if len(hashes) else np.zeros(0, np.uint64)


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers as byte planes, so that leading zeros cost next to nothing once compressed."""
    numbers = np.ascontiguousarray(numbers, dtype="<u8")
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    planes = numbers.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + planes.T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def pack_sorted(numbers: np.ndarray) -> bytes:
    """Ascending whole numbers as packed differences."""
    numbers = np.asarray(numbers, np.uint64)
    return pack(np.diff(numbers, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... (count of them) of all pairs, one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)
