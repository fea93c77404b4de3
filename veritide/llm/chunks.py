"""Content-defined chunks of bytes: boundaries where a gear rolling hash has zero low bits."""

from __future__ import annotations

import numpy as np

#: Gear values: one pseudorandom 32-bit number for each byte.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)

#: Bytes that are hashed at a time.
PIECE = 1 << 20


def gear_hash(data: np.ndarray, window: int = 32) -> np.ndarray:
    """The gear hash after each byte: the sum of ``GEAR[b] << age`` over the last ``window`` bytes.

    ``window`` is a power of two up to 32, beyond which shifts leave the 32 bits anyway. The
    sums over 1, 2, 4, ... bytes double up, so a whole array takes a few passes.
    """
    h = GEAR[data]
    span = 1
    while span < window:
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h, span = longer, 2 * span
    return h


def cut_points(data: bytes, bits: int, longest: int, shortest: int = 1) -> np.ndarray:
    """Ends of the chunks of UTF-8 ``data``, ascending, the last being its length.

    A chunk ends after a byte whose hash has ``bits`` zero bits at the top (one byte in
    ``2 ** bits``), once it has ``shortest`` bytes, and never within a character. Chunks over
    ``longest`` bytes are cut at equal steps from their start. The hash sees the last 32 bytes
    only, so an insertion moves the boundaries next to it and no others.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    found = []
    for at in range(0, n, PIECE):
        low = max(0, at - 31)
        h = gear_hash(raw[low : at + PIECE])[at - low :]
        found.append(np.flatnonzero(h >> np.uint32(32 - bits) == 0) + at + 1)
    ends = np.concatenate(found)
    ends = ends[(ends < n)]
    ends = ends[(raw[ends] & 0xC0) != 0x80]
    out, last = [], 0
    for end in [*ends.tolist(), n]:
        if end - last < shortest and end < n:
            continue
        while end - last > longest:
            step = last + longest
            while raw[step] & 0xC0 == 0x80:
                step -= 1
            out.append(step)
            last = step
        out.append(end)
        last = end
    return np.array(out, np.int64)
