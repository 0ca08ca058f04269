"""Texts as one array of bytes, with words and lines found by array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes worked on at once; a longer text is cut at marks into pieces whose results are combined.
BLOCK = 500_000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = 0x9E3779B97F4A7C15
_BACK = pow(_R, -1, 1 << 64)


def blocks(texts: list[str], mark: bytes, stay: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """(numbers of the texts, their bytes) in blocks; a text may be cut into several pieces, at marks alone.

    stay: bytes of the mark that belong to the piece before; if none do, the mark is left out. A text is
    never cut elsewhere, so that what is counted does not depend on BLOCK.
    """
    owner: list[int] = []
    parts: list[bytes] = []
    size = 0
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "replace")
        while len(raw) > BLOCK:
            cut = raw.rfind(mark, 0, BLOCK)
            cut = cut if cut >= 0 else raw.find(mark, BLOCK - len(mark))
            if cut < 0:
                break
            if parts:
                yield owner, parts
                owner, parts, size = [], [], 0
            yield [k], [raw[: cut + stay]]
            raw = raw[cut + (stay or len(mark)) :]
        owner.append(k)
        parts.append(raw)
        size += len(raw)
        if size >= BLOCK:
            yield owner, parts
            owner, parts, size = [], [], 0
    if parts:
        yield owner, parts


def powers(r: int, n: int) -> np.ndarray:
    """r**i mod 2**64 for i < n."""
    out = np.full(max(1, n), r, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from prefix sums; it depends on the bytes alone, not on their place."""
    h = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_R, len(data)))])
    x = (h[ends] - h[starts]) * powers(_BACK, len(data) + 1)[starts]
    x = mix64(x + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return x


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
