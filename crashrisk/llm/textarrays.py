"""NumPy views of text batches: bytes, words and 64-bit hashes, without a loop over words.

Hashes are polynomial sums over a fixed table of random 64-bit byte values, taken
modulo 2**64 and then mixed. Equal texts give equal hashes on every worker.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words: space and U+0009 to U+000D.
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))  # a new array, which the other steps change in place
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        have = np.ones(size, dtype=np.uint64)
        have[1:] = np.uint64(base)
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def give_back() -> None:
    """Return freed memory to the system: workers live on, and their C library keeps what large arrays held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, row after the last, UTF-8 texts) for runs of rows of about ``most_bytes``.

    A null is an empty text. A text longer than ``most_bytes`` is a run of its own.
    """
    blobs = pc.fill_null(texts.cast(pa.large_binary()), b"")
    sizes = pc.binary_length(blobs).to_numpy(zero_copy_only=False)
    first = 0
    while first < len(sizes):
        last, total = first + 1, int(sizes[first])
        while last < len(sizes) and total + sizes[last] <= most_bytes and last - first < 4096:
            total += int(sizes[last])
            last += 1
        yield first, last, blobs.slice(first, last - first).to_pylist()
        first = last
    give_back()


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with one line feed after each text, and where each text starts (one more at the end)."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=starts[1:])
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    return data, starts


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last; ``data`` ends with white space."""
    inside = ~WHITE[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``range_hashes`` takes the hash of any byte range."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(_BASE, len(data)), out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each byte range; equal bytes give equal hashes wherever they stand."""
    back = powers(_UNBASE, len(sums))
    return mix((sums[ends] - sums[starts]) * back[starts])


def gram_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """``range_hashes`` of the ``width`` bytes from each place on, without looking places up."""
    n = max(0, len(sums) - width)
    out = sums[width:] - sums[:n]
    out *= powers(_UNBASE, len(sums))[:n]
    return mix(out)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` neighbouring items, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j, factor in enumerate(powers(0xD1342543DE82EF95, width)):
        out += hashes[j:j + n] * factor
    return mix(out)


def owner_bounds(word_starts: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """For each text the number of its first word (one more at the end)."""
    return np.searchsorted(word_starts, text_starts)
