"""Texts within a few edits of each other: what is left of both without some characters is equal. Numpy for one task."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np

LONGEST = 40  # characters of a text that is looked for by what is left of it: 821 texts without up to two of them
STEP = 1 << 22  # shortened texts, or candidates, that are held at once

_BASE = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_BASE, i, 1 << 64) for i in range(LONGEST + 1)], np.uint64)
_BACK = [np.uint64(pow(_BASE, -i, 1 << 64)) for i in range(LONGEST + 1)]


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a column a text, and the texts' lengths; what is beyond a text's end is never looked at."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    width = max(int(sizes.max(initial=0)), 1)
    return np.ascontiguousarray(np.array(texts, f"U{width}").view(np.uint32).reshape(len(texts), width).T), sizes


def shortened(codes: np.ndarray, sizes: np.ndarray, salt: np.ndarray, most: int, bits: int) -> np.ndarray:
    """Sorted numbers, one for each text without up to `most` of its characters: a hash, and in its last `bits` the text's place.

    Of a run of equal characters the first are taken out, as others would leave the same. A hash is a sum over the
    characters, so that taking some out moves the sums behind them; unequal texts that share one are told apart later.
    """
    width, n = codes.shape
    inside = np.arange(width)[:, None] < sizes
    fresh = inside.copy()
    fresh[1:] &= codes[1:] != codes[:-1]
    sums = np.zeros((width + 1, n), np.uint64)
    np.cumsum(np.where(inside, codes.astype(np.uint64) + np.uint64(1), np.uint64(0)) * _POWERS[:width, None], axis=0, out=sums[1:])
    found = []
    for some in range(most + 1):
        for gone in combinations(range(width), some):
            kept = inside[gone[-1]] & fresh[gone[0]] if gone else np.ones(n, bool)
            for a, b in pairwise(gone):
                if b > a + 1:
                    kept = kept & fresh[b]
            at = np.flatnonzero(kept)
            ends = [*gone, width]
            h = salt[at] + sums[ends[0], at]
            for k, (a, b) in enumerate(pairwise(ends), 1):
                h += (sums[b, at] - sums[a + 1, at]) * _BACK[k]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            found.append(h >> np.uint64(bits) << np.uint64(bits) | at.astype(np.uint64))
    return np.sort(np.concatenate(found))


def distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of pairs of texts, most + 1 where they're greater: only the cells near the diagonal are worked out."""
    n, beyond = a.shape[1], most + 1
    shift = lb - la
    ahead = range(-most, most + 1)
    row = [np.full(n, min(max(k, 0) if k >= 0 else beyond, beyond), np.uint8) for k in ahead]
    out = np.full(n, beyond, np.uint8)

    def take(i: int) -> None:
        done = la == i
        if done.any():
            for k, cells in zip(ahead, row, strict=True):
                at = done & (shift == k)
                out[at] = cells[at]

    take(0)
    for i in range(1, int(la.max(initial=0)) + 1):
        fresh: list[np.ndarray] = []
        for p, k in enumerate(ahead):
            j = i + k
            if j < 0:
                cell = np.full(n, beyond, np.uint8)
            elif j == 0:
                cell = np.full(n, min(i, beyond), np.uint8)
            else:
                cell = row[p] + (a[i - 1] != b[j - 1]) if j <= b.shape[0] else np.full(n, beyond, np.uint8)
                if p + 1 < len(row):
                    cell = np.minimum(cell, row[p + 1] + np.uint8(1))
                if fresh:
                    cell = np.minimum(cell, fresh[-1] + np.uint8(1))
                cell = np.minimum(cell, np.uint8(beyond))
            fresh.append(cell.astype(np.uint8, copy=False))
        row = fresh
        take(i)
    return out


def _slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of texts that leave about STEP shortened ones."""
    left = np.cumsum([sum(math.comb(int(s), k) for k in range(most + 1)) for s in range(LONGEST + 1)])
    left = np.diff(left, prepend=0)
    total = np.cumsum(left[sizes])
    begin = 0
    while begin < len(sizes):
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + STEP, side="right")))
        yield slice(begin, stop)
        begin = stop


def near(left: list[str], left_tile: np.ndarray, right: list[str], right_tile: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the (place, place, distance) of the pairs of a left and a right text of one tile within `most` edits, each pair once.

    Texts have LONGEST characters at most. Tiles are small numbers. All that is held at once is in proportion to STEP and the texts.
    """
    if not left or not right:
        return
    a, la = codes_of(left)
    b, lb = codes_of(right)
    bits = max(len(left), len(right)).bit_length()
    low = np.uint64((1 << bits) - 1)
    salts = [np.asarray(t).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) for t in (left_tile, right_tile)]
    for y in _slices(lb, most):
        held = shortened(b[:, y], lb[y], salts[1][y], most, bits)
        hashes = held >> np.uint64(bits)
        for x in _slices(la, most):
            mine = shortened(a[:, x], la[x], salts[0][x], most, bits)
            sought = mine >> np.uint64(bits)
            begin = np.searchsorted(hashes, sought, side="left")
            count = np.searchsorted(hashes, sought, side="right") - begin
            hit = np.flatnonzero(count)
            rows = (mine[hit] & low).astype(np.int64)
            order = np.argsort(rows, kind="stable")
            rows, begin, count = rows[order], begin[hit][order], count[hit][order]
            total = np.cumsum(count)
            at = 0
            while at < len(rows):
                # a left text's candidates stay together, so that none is found twice
                stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, side="right")))
                stop = int(np.searchsorted(rows, rows[stop - 1], side="right"))
                n = count[at:stop]
                places = np.repeat(begin[at:stop] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                pairs = np.unique(np.repeat(rows[at:stop], n) << bits | (held[places] & low).astype(np.int64))
                for k in range(0, len(pairs), STEP // 16):
                    i, j = (pairs[k : k + STEP // 16] >> bits) + x.start, (pairs[k : k + STEP // 16] & int(low)) + y.start
                    d = distances(a[:, i], la[i], b[:, j], lb[j], most)
                    good = np.flatnonzero((d <= most) & (left_tile[i] == right_tile[j]))
                    if len(good):
                        yield i[good], j[good], d[good]
                at = stop
