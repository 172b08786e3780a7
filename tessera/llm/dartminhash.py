"""DartMinHash signatures of weighted sets, in numpy.

Darts fall on each element's region of weight as a Poisson process in rank: in each unit of weight the gaps between
ranks are exponential, drawn from hashes of the element, the unit and the dart's number alone. A dart also has a place
inside the unit, below which the weight must reach, and one of k coordinates. The earliest dart of each coordinate is
the signature's value there; two sets agree on a coordinate with the probability of their weighted Jaccard similarity.
Only ranks up to a bound that lets k ln k + 2k darts through are looked at, and up to twice it again for the few sets
that leave a coordinate empty, so a set costs about its weight plus the darts.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers above 0 and up to 1."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def cells(doc: np.ndarray, element: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, fill) of each unit of weight; the last unit of an element is filled in part if the weight isn't whole."""
    if weight is None:
        return doc, mix64(element), np.ones(len(doc))
    units = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(doc)), units)
    number = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
    fill = np.minimum(weight[at] - number, 1.0)
    return doc[at], mix64(element[at] + number.astype(np.uint64) * _GOLD), fill


def signatures(doc: np.ndarray, element: np.ndarray, sets: int, k: int = 64, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A sets x k array of signatures, and which sets have one (those that aren't empty)."""
    out = np.zeros((sets, k), np.uint64)
    doc, key, fill = cells(np.asarray(doc, np.int64), np.asarray(element, np.uint64), weight)
    total = np.bincount(doc, weights=fill, minlength=sets)
    some = total > 0
    wanted = k * (np.log(k) + 2.0)
    bound = np.divide(wanted, total, out=np.zeros(sets), where=some)
    todo = some.copy()
    while todo.any():
        mine = np.flatnonzero(todo[doc])
        ranks = np.zeros(len(mine))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        number = 0
        while len(mine):
            draw = mix64(key[mine] + np.uint64((number + 1) * int(_GOLD) % (1 << 64)))
            limit = bound[doc[mine]]
            # most units have no dart below the bound: compare before taking logarithms
            u = _unit(draw)
            near = u >= np.exp(ranks - limit)
            mine, ranks, draw = mine[near], ranks[near] - np.log(u[near]), draw[near]
            dart = mix64(draw ^ _GOLD)
            place = _unit(mix64(dart + _GOLD))
            hit = place <= fill[mine]
            found.append((doc[mine[hit]] * k + (dart[hit] % np.uint64(k)).astype(np.int64), ranks[hit], dart[hit]))
            number += 1
        slot, rank, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        # the earliest dart of a coordinate is written last
        order = np.argsort(-rank, kind="stable")
        values = np.zeros(sets * k, np.uint64)
        taken = np.zeros(sets * k, bool)
        values[slot[order]] = dart[order]
        taken[slot] = True
        full = todo & taken.reshape(sets, k).all(axis=1)
        out[full] = values.reshape(sets, k)[full]
        todo &= ~full
        bound[todo] *= 2
    return out, some


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of a signature's coordinates; equal bands of different places have different keys."""
    rows = signature.shape[1] // bands
    keys = np.broadcast_to((np.arange(bands, dtype=np.uint64) + np.uint64(1)) * _GOLD, (len(signature), bands)).copy()
    parts = signature[:, : rows * bands].reshape(len(signature), bands, rows)
    for r in range(rows):
        keys = mix64(keys * np.uint64(5) + parts[:, :, r])
    return keys
