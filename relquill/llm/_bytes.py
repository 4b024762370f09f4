"""Word splitting and hashing over whole batches of UTF-8 texts in numpy.

All hashes are functions of the bytes alone, so results do not depend on batch borders, and texts are
worked on in runs of bounded size (a single text may exceed the run, and is then a run of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_BINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i below n."""
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << max(16, (n - 1).bit_length())
        f = np.full(size, _B)
        f[0] = 1
        g = np.full(size, _BINV)
        g[0] = 1
        with np.errstate(over="ignore"):
            _pow, _inv = np.cumprod(f, dtype=np.uint64), np.cumprod(g, dtype=np.uint64)
    return _pow[:n], _inv[:n]


def runs(texts: list, most: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, encoded texts) in runs of about ``most`` bytes; null texts count as empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else (t or b"" if isinstance(t, bytes) else b"")
        if held and size + len(b) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, held


def words(parts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the run, start and end of each word, and the index of its text."""
    raw = b"\n".join(parts)
    buf = np.frombuffer(raw.lower() if lower else raw, np.uint8)
    is_word = np.zeros(len(buf) + 2, bool)
    is_word[1:-1] = ~SPACE[buf]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1])
    start, end = edge[0::2], edge[1::2]
    offsets = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
    return buf, start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    power, inverse = powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLE[buf] * power[: len(buf)], dtype=np.uint64, out=total[1:])
        h = (total[end] - total[start]) * inverse[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
