"""Equal byte spans of a batch under one number: an open-addressed numpy table with xxhash64 keys and byte verification."""

from __future__ import annotations

import numpy as np
import xxhash

# The primes of xxHash64.
P1, P2, P3, P4, P5 = (
    np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5),
)
#: From this length on xxHash64 works in stripes; spans that long are hashed one by one.
STRIPE = 32


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of ``buf`` on as one little-endian number; zeros follow its end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxhash64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lane: np.ndarray | None = None) -> np.ndarray:
    """xxHash64 (seed 0) of every span."""
    lane = lanes(buf) if lane is None else lane
    length = end - start
    h = P5 + length.astype(np.uint64)
    short = np.flatnonzero(length < STRIPE)
    at, rest = start[short], length[short]
    while len(short):
        more = rest >= 8
        if not more.any():
            break
        short8, at8 = short[more], at[more]
        h[short8] = _turn(h[short8] ^ (_turn(lane[at8] * P2, 31) * P1), 27) * P1 + P4
        at = at + 8 * more
        rest = rest - 8 * more
    half = rest >= 4
    if half.any():
        who = short[half]
        h[who] = _turn(h[who] ^ ((lane[at[half]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at, rest = at + 4 * half, rest - 4 * half
    for i in range(3):
        more = rest > i
        if not more.any():
            break
        who = short[more]
        h[who] = _turn(h[who] ^ ((lane[at[more] + i] & np.uint64(0xFF)) * P5), 11) * P1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(length >= STRIPE)
    if len(long):
        raw = memoryview(np.ascontiguousarray(buf))
        h[long] = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)), np.uint64, len(long))
    return h


def same_bytes(lane: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` bytes from ``a`` and from ``b`` on are equal, eight at a time."""
    ok = np.ones(len(a), bool)
    who, done = np.arange(len(a)), 0
    while len(who):
        rest = length[who] - done
        who, rest = who[rest > 0], rest[rest > 0]
        if not len(who):
            break
        beyond = np.uint64(8) * np.maximum(8 - rest, 0).astype(np.uint64)
        ok[who] &= ((lane[a[who] + done] ^ lane[b[who] + done]) << beyond) == 0
        who, done = who[ok[who] & (rest > 8)], done + 8
    return ok


def intern(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of every span among the different ones, and for each of those the first span that holds it.

    A span asks the place its hash names, and the next ones in turn. An empty place becomes its own; in a taken one it
    stays if the bytes are the same. At most half of the places are used, and all spans ask at once, in rounds.
    """
    n = len(start)
    bits = max(4, (2 * n - 1).bit_length() if n else 0)
    lane = lanes(buf)
    key = xxhash64(buf, start, end, lane)
    length = end - start
    owner = np.full(1 << bits, -1, np.int64)
    at = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    slot = np.zeros(n, np.int64)
    todo = np.arange(n)
    while len(todo):
        place = at[todo]
        free = np.flatnonzero(owner[place] < 0)[::-1]  # the first of those that ask for a place is written last
        owner[place[free]] = todo[free]
        who = owner[place]
        ok = (key[who] == key[todo]) & (length[who] == length[todo])
        ok[ok] = same_bytes(lane, start[who[ok]], start[todo[ok]], length[todo[ok]])
        slot[todo[ok]] = place[ok]
        todo = todo[~ok]
        at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
    used = np.flatnonzero(owner >= 0)
    number = np.zeros(1 << bits, np.int64)
    number[used] = np.arange(len(used))
    return number[slot], owner[used]
