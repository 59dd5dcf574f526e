"""Words of many texts as arrays: places in one run of bytes, and 64-bit hashes.

Texts are joined by a byte that cuts, so no run of words crosses two of them.
All classes are told by ASCII bytes, so UTF-8 sequences stay whole.
"""

from __future__ import annotations

import numpy as np

WORD, BLANK, CUT = 0, 1, 2
#: Bytes that are hashed at a time.
CHUNK = 1 << 18
U = np.uint64
_rng = np.random.default_rng(23)
VALUES = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse modulo 2^64 for each place of a chunk."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(CHUNK, b, dtype=np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return tuple(both)


POWERS = tuple(powers(b) for b in BASES)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def joined(texts: list[bytes], cut: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """The texts with A-Z lower-cased as one array, each followed by ``cut``, and where each begins."""
    raw = np.frombuffer((cut.join(texts) + cut).translate(LOWER), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    return raw, np.cumsum(sizes) - sizes


def runs(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start and end (exclusive) of each run of true values."""
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of the bytes of each word, wherever it stands."""
    h, (up, down) = np.zeros(len(start), dtype=np.uint64), POWERS[which]
    for at in range(0, len(raw), CHUNK):
        part = raw[at : at + CHUNK]
        lo, hi = np.searchsorted(end, at, side="right"), np.searchsorted(start, at + len(part))
        if lo == hi:
            continue
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(VALUES[which][part] * up[: len(part)], out=total[1:])
        s, e = np.maximum(start[lo:hi], at) - at, np.minimum(end[lo:hi], at + len(part)) - at
        own = (total[e] - total[s]) * down[s]
        if start[lo] < at:  # the word goes on from the chunk before
            own[:1] *= U(pow(BASES[which], int(at - start[lo]), 1 << 64))
        h[lo:hi] += own
    return mixed(h + (end - start).astype(np.uint64))


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of neighbours whose sizes come to ``most`` at most, but for a single larger one."""
    out, begin, total = [], 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > begin and total + size > most:
            out.append((begin, k))
            begin, total = k, 0
        total += size
    return [*out, (begin, len(sizes))] if len(sizes) else []
