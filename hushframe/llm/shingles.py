"""Word shingles of whole texts as 64-bit hashes, computed for a batch of documents at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_C1, _C2, _C3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x2545F4914F6CDD1D)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit integers."""
    h = (h ^ (h >> np.uint64(33))) * _C1
    h = (h ^ (h >> np.uint64(29))) * _C2
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def text_slices(b: pa.RecordBatch, column: int, rows: int = 256, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and, if of more than one, ``size`` bytes of text."""
    total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < b.num_rows:
        before = total[start - 1] if start else 0
        end = min(start + rows, max(start + 1, int(np.searchsorted(total, before + size, side="right"))))
        yield b.slice(start, end - start)
        start = end


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in order, and the place of each text's first word (and the end)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True))  # starts and ends of words in turn
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(buf))
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[buf]] * power, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    return hashes, np.searchsorted(starts, first)


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text of fewer words than ``size`` has its whole sequence as
    its only shingle; one without words, or null, has none.
    """
    w, at = words([(t or "").encode() for t in texts])
    n = max(0, len(w) - size + 1)
    g = w[:n] + np.uint64(size)
    for k in range(1, size):
        g = (g ^ (g >> np.uint64(31))) * _C3 + w[k : n + k]
    g = mix(g)
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s >= size:
            out.append(np.unique(g[s : e - size + 1]))
        elif e > s:
            h = w[s : s + 1] + np.uint64(e - s)
            for k in range(s + 1, e):
                h = (h ^ (h >> np.uint64(31))) * _C3 + w[k]
            out.append(mix(h))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def class_key(s: np.ndarray) -> int:
    """A 64-bit key of a shingle set: equal for equal sets; 0 for the empty one only."""
    if not len(s):
        return 0
    parts = np.array([s.sum(dtype=np.uint64), mix(s ^ _C3).sum(dtype=np.uint64)], dtype=np.uint64)
    key = mix(parts * np.array([_C1, _C2]) + np.uint64(len(s)))
    return int((key[:1] ^ (key[1:] * _C3)).astype(np.int64)[0]) or 1
