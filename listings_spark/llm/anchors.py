"""Content-chosen anchors of all fixed-length windows of a text, with numpy.

Every window of WINDOW bytes has one anchor: the position of the least hash among its grams. Equal
windows have equal anchors wherever they stand, so strings of WINDOW bytes that repeat meet under
the hash of their anchor. Neighbouring windows mostly share an anchor; such a run of windows is one
record. A record's context is the bytes its windows cover.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

WINDOW = 50
GRAM = 16
SPAN = WINDOW - GRAM + 1  # grams in a window
SIDE = (WINDOW - GRAM) // 2
CHUNK = 1 << 18
PLACE = np.uint64((1 << 20) - 1)  # low bits of a gram's sort key hold its place in the chunk


def _odd(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


K1, K2, K3, K4, K5 = _odd(5, 50)
BYTE = _odd(256, 51)
BASE = int(_odd(1, 52)[0]) // 8 * 8 + 5
ROOM = CHUNK + 2 * WINDOW
POWER = _powers(BASE, ROOM + 1)
INVERSE = _powers(pow(BASE, -1, 1 << 64), ROOM + 1)


class Records(NamedTuple):
    """Runs of windows: anchor hash, context hash, document, first window, number of windows.

    `left` and `right` sign the SIDE bytes before and after the anchor's gram, 0 if the context does
    not reach so far. A window holds SIDE bytes on one side at least, so records of one anchor
    share a window only if they agree on one of them.
    """

    anchor: np.ndarray
    context: np.ndarray
    left: np.ndarray
    right: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    count: np.ndarray


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= K3
    x ^= x >> np.uint64(29)
    return x


def _chunk(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Records of windows inside the segments [start, end) of one chunk."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((n + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    grams = n - GRAM + 1
    hashes = _mixed((eight[:grams] * K1) ^ (eight[8 : 8 + grams] * K2))
    key = (hashes & ~PLACE) | np.arange(grams, dtype=np.uint64)
    for shift in (1, 2, 4, 8, 16, SPAN - 32):
        key = np.minimum(key[:-shift], key[shift:])
    place = (key & PLACE).astype(np.int64)
    edge = np.zeros(n + 1, dtype=np.int32)
    edge[np.maximum(starts, ends - WINDOW + 1)] += 1
    np.add.at(edge, ends, -1)
    valid = np.cumsum(edge)[: len(place)] == 0
    change = np.empty(len(place), dtype=bool)
    change[0] = True
    np.not_equal(place[1:], place[:-1], out=change[1:])
    change[1:] |= ~valid[:-1]
    first = np.flatnonzero(change & valid)
    stop = np.empty(len(place), dtype=bool)
    stop[-1] = True
    stop[:-1] = change[1:] | ~valid[1:]
    last = np.flatnonzero(stop & valid)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(BYTE[data] * POWER[:n])])
    at = place[first]
    context = (sums[last + WINDOW] - sums[first]) * INVERSE[first]
    context += (at - first).astype(np.uint64) * K4 + (last - first).astype(np.uint64) * K5
    owner = np.searchsorted(starts, first, side="right") - 1

    def signed(begin, inside):
        begin = np.where(inside, begin, 0)
        code = _mixed((sums[begin + SIDE] - sums[begin]) * INVERSE[begin]) >> np.uint64(40)
        return np.where(inside, code % np.uint64(255) + np.uint64(1), 0).astype(np.uint8)

    left = signed(at - SIDE, at - SIDE >= first)
    right = signed(at + GRAM, at + GRAM + SIDE <= last + WINDOW)
    return hashes[at], _mixed(context), left, right, owner, first, last - first + 1


def records(data: np.ndarray, offsets: np.ndarray) -> Records:
    """Records of documents that stand one after another in `data`, document i at offsets[i].

    Works through the bytes in chunks; a document longer than a chunk is cut so that the pieces'
    windows do not overlap, which can only split a record.
    """
    sizes = np.diff(offsets)
    step = CHUNK
    pieces = np.maximum(1, -(-(sizes - WINDOW + 1) // step))
    doc = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = offsets[:-1][doc] + nth * step
    end = np.minimum(begin + step + WINDOW - 1, offsets[1:][doc])
    usable = end - begin >= WINDOW
    doc, begin, end = doc[usable], begin[usable], end[usable]
    parts: list[tuple] = []
    i = 0
    while i < len(doc):
        total = np.cumsum(end[i : i + 4096] - begin[i : i + 4096])
        j = i + max(1, int(np.searchsorted(total, ROOM, side="right")))
        size = end[i:j] - begin[i:j]
        stop = np.cumsum(size)
        start = stop - size
        if (begin[i + 1 : j] == end[i : j - 1]).all():
            chunk = data[begin[i] : end[j - 1]]
        else:
            chunk = np.concatenate([data[b:e] for b, e in zip(begin[i:j], end[i:j], strict=True)])
        *codes, owner, first, count = _chunk(chunk, start, stop)
        shift = begin[i:j] - offsets[:-1][doc[i:j]] - start
        parts.append((*codes, doc[i:j][owner], first + shift[owner], count))
        i = j
    if not parts:
        kinds = (np.uint64, np.uint64, np.uint8, np.uint8, np.int64, np.int64, np.int64)
        return Records(*[np.zeros(0, dtype=k) for k in kinds])
    return Records(*[np.concatenate(p) for p in zip(*parts, strict=True)])
