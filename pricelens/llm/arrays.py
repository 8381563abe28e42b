"""Numpy helpers for Arrow batches of text: bounded slices, rolling and word hashes.

A hash of bytes ``b[s:e]`` is ``sum(G[b[i]] * R**(i - s)) mod 2**64`` with a fixed random
table ``G``, read from one running sum per slice; :func:`mix` then spreads its bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

SLICE_BYTES = 1 << 19
_R = 0x9E3779B97F4A7C15
_G = np.random.Generator(np.random.PCG64(20240601)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64) + np.uint64((seed * 0xD1B54A32D192ED03 + _R) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int, inverse: bool) -> np.ndarray:
    key = "inverse" if inverse else "power"
    if key not in _powers or len(_powers[key]) <= n:
        base = np.full(max(n + 1, SLICE_BYTES * 2), pow(_R, -1, 2**64) if inverse else _R, dtype=np.uint64)
        base[0] = 1
        _powers[key] = np.multiply.accumulate(base)
    return _powers[key]


def running(data: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`spans` reads the hash of any span of ``data``."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_G[data] * _power(len(data), False)[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the spans ``[start, end)``."""
    return mix((sums[end] - sums[start]) * _power(len(sums), True)[start])


def slices(frames: Iterator[pd.DataFrame], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Pieces of the frames with about ``limit`` bytes of text at most (one longer text alone), and their UTF-8 bytes; null counts as empty."""
    for frame in frames:
        begin, texts, size = 0, [], 0
        for i, t in enumerate(frame[column]):
            own = b"" if t is None or t != t else t.encode("utf-8", "surrogatepass")
            if texts and size + len(own) > limit:
                yield frame.iloc[begin:i], texts
                begin, texts, size = i, [], 0
            texts.append(own)
            size += len(own) + 1
        if texts:
            yield frame.iloc[begin:], texts


def joined(texts: list[bytes], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts behind one another with ``gap`` after each, and where each starts and ends."""
    data = np.frombuffer(gap.join([*texts, b""]), dtype=np.uint8)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    start = np.concatenate([[0], np.cumsum(size + len(gap))[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    return data, start, start + size


def word_hashes(texts: list[bytes], breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every word of every text, A-Z lower-cased: its hash, text number, start and end in the joined bytes; and the joined bytes.

    ``breaks`` says which bytes part words (white space as ``[\\x20\\x09-\\x0D]``).
    """
    data, start, _ = joined(texts)
    inside = np.concatenate([[False], ~breaks[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    text = np.searchsorted(start, first, side="right") - 1
    return spans(running(_LOWER[data]), first, last), text, first, last, data


def counts_by_text(text: np.ndarray, n: int) -> np.ndarray:
    """How many items each of ``n`` texts has."""
    return np.bincount(text, minlength=n)
