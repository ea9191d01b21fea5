"""Word shingles as sorted sets of 63-bit hashes, computed over whole batches with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

U = np.uint64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C17
_STEP = U(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 12)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, U(b))
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of UTF-8 bytes, A-Z as a-z, and where each word starts."""
    raw = np.frombuffer(data.translate(_LOWER), np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, U), start
    up, down = _power(len(raw) + 1)
    total = np.empty(len(raw) + 1, U)
    total[0] = 0
    np.cumsum(_TABLE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start


def combine(words: np.ndarray, size: int) -> np.ndarray:
    """One 63-bit hash for each run of `size` words."""
    n = len(words) - size + 1
    h = words[:n].copy()
    for i in range(1, size):
        h = mix(h * _STEP + words[i : n + i])
    return (h >> U(1)).astype(np.int64)


def shingle_sets(texts: list[str | None], size: int, limit: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order; empty without words.

    A text with fewer than `size` words has its whole sequence as its one shingle.
    Texts are hashed together in slices of about `limit` bytes.
    """
    held: list[bytes] = []
    weight = 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        held.append(data)
        weight += len(data)
        if weight >= limit:
            yield from _sets(held, size)
            held, weight = [], 0
    yield from _sets(held, size)


def _sets(held: list[bytes], size: int) -> Iterator[np.ndarray]:
    words, start = word_hashes(b"\n".join(held))
    ends = np.cumsum([len(x) + 1 for x in held])
    cut = np.searchsorted(start, ends)
    runs = combine(words, size) if len(words) >= size else np.empty(0, np.int64)
    first = 0
    for last in cut:
        if last - first >= size:
            own = np.sort(runs[first : last - size + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif last > first:
            own = words[first:last]
            yield combine(np.concatenate((np.array([len(own)], U), own)), len(own) + 1)
        else:
            yield np.empty(0, np.int64)
        first = last


def digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole set, as two signed longs."""
    d = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """|A & B| for every A of left and B of right, as products of 0/1 matrices.

    Only elements on both sides become columns, `width` of them at a time.
    """
    out = np.zeros((len(left), len(right)), np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    row_a, row_b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    common = np.intersect1d(a, b)
    if not len(common):
        return out
    at_a, at_b = np.searchsorted(common, a), np.searchsorted(common, b)
    at_a[at_a == len(common)] = 0
    at_b[at_b == len(common)] = 0
    keep_a, keep_b = common[at_a] == a, common[at_b] == b
    at_a, row_a, at_b, row_b = at_a[keep_a], row_a[keep_a], at_b[keep_b], row_b[keep_b]
    for low in range(0, len(common), width):
        n = min(width, len(common) - low)
        x, y = np.zeros((len(left), n), np.float32), np.zeros((len(right), n), np.float32)
        pick = (at_a >= low) & (at_a < low + n)
        x[row_a[pick], at_a[pick] - low] = 1
        pick = (at_b >= low) & (at_b < low + n)
        y[row_b[pick], at_b[pick] - low] = 1
        out += np.rint(x @ y.T).astype(np.int64)
    return out
