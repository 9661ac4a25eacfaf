"""Names of substrings by doubling, and the anchors of 100-byte windows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

THRESHOLD = 100
ANCHOR = 32
SPAN = THRESHOLD - ANCHOR + 1      # anchors a window can choose from
SIDE = (THRESHOLD - ANCHOR) // 2   # every window holds an anchor and SIDE bytes left of it or right of it
CHUNK = 1 << 21                    # bytes handled at once

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S29, _S32 = np.uint64(29), np.uint64(32)


def _scramble(x: np.ndarray) -> np.ndarray:
    x ^= x >> _S32
    x *= _B
    x ^= x >> _S29
    return x


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Name of a pair of names."""
    x = left * _A
    x += right
    return _scramble(x)


class Names:
    """Names of all substrings of lengths 32, 66 and 100 of some bytes (100 at least).

    Each round pairs the name at a position with the name one length further on, which doubles
    the length; equal names mean equal substrings.
    """

    def __init__(self, data: bytes):
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)) * _A
        now, length = _scramble(eight), 8
        while length < 64:
            now = pair(now[:-length], now[length:])
            length *= 2
            if length == ANCHOR:
                self.short = now
        gap = ANCHOR + SIDE - length
        self.middle = pair(now[:-gap], now[gap:])
        gap = THRESHOLD - length
        self.window = pair(now[:-gap], now[gap:])

    def anchors(self) -> np.ndarray:
        """For every window the position of its anchor: its least name of length 32, the first if tied."""
        low = np.uint64((1 << 24) - 1)
        key = (self.short & ~low) | np.arange(len(self.short), dtype=np.uint64)
        size = 1
        while size * 2 <= SPAN:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        n = len(self.window)
        key = np.minimum(key[:n], key[SPAN - size:SPAN - size + n])
        return (key & low).astype(np.int64)


def buffers(texts: Iterable[tuple[object, bytes]]) -> Iterator[tuple[list, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of 100 bytes and more, joined into buffers: owners, bytes, first window, past window, offset.

    A text longer than a buffer comes in pieces; each of its windows lies in exactly one.
    """
    owners, parts, lo, hi, base, size = [], [], [], [], [], 0
    for owner, text in texts:
        for at in range(0, max(len(text) - THRESHOLD + 1, 0), CHUNK):
            piece = text[at:at + CHUNK + THRESHOLD - 1]
            owners.append(owner)
            parts.append(piece)
            lo.append(size)
            hi.append(size + len(piece) - THRESHOLD + 1)
            base.append(at - size)
            size += len(piece)
            if size >= CHUNK // 8:
                yield owners, b"".join(parts), np.array(lo), np.array(hi), np.array(base)
                owners, parts, lo, hi, base, size = [], [], [], [], [], 0
    if size:
        yield owners, b"".join(parts), np.array(lo), np.array(hi), np.array(base)


def runs(data: bytes, lo: np.ndarray, hi: np.ndarray):
    """Runs of windows with one anchor: text number, first window, windows, anchor, key, context.

    Equal runs of windows have equal keys and contexts: the key names the anchor, the context all
    bytes of the run and the place of the anchor in it.
    """
    names = Names(data)
    chosen = names.anchors()
    turn = np.ones(len(chosen), bool)
    turn[1:] = chosen[1:] != chosen[:-1]
    turn[lo] = True
    depth = np.zeros(len(chosen) + 1, np.int8)
    depth[lo] += 1
    np.subtract.at(depth, hi, 1)
    first = np.flatnonzero(turn & (np.cumsum(depth[:-1], dtype=np.int8) > 0))
    text = np.searchsorted(lo, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(chosen)), hi[text]) - 1
    at = chosen[first]
    shape = ((last - first) * 128 + (at - first)).astype(np.uint64)
    context = pair(pair(names.window[first], names.window[last]), shape)
    return text, first, last - first + 1, at, names.short[at].view(np.int64), context.view(np.int64)


def halves(data: bytes, first: np.ndarray, count: np.ndarray, anchor: np.ndarray):
    """Runs cut where the bytes right of the anchor outnumber those left of it.

    Yields (name of the 66 bytes that all windows of the half share, first window, window names).
    """
    names = Names(data)
    for s, n, a in zip(first.tolist(), count.tolist(), anchor.tolist()):
        cut = min(max(a - SIDE + 1, s), s + n)   # windows before it hold SIDE bytes left of the anchor
        if cut > s:
            yield int(names.middle[a - SIDE].view(np.int64)), s, names.window[s:cut].tobytes()
        if cut < s + n:
            yield int((~names.middle[a]).view(np.int64)), cut, names.window[cut:s + n].tobytes()
