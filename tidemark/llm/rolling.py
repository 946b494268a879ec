"""Rolling hashes and content-chosen anchors over byte buffers, in numpy.

``Windows`` looks at every ``span``-byte window of the documents laid end to end in a buffer.
Each window picks the byte position whose ``gram``-byte string has the smallest hash (leftmost on
ties).  The choice depends on the window's bytes alone, so equal windows pick the same place, and
neighbouring windows mostly pick the same one: about one position in ``span / 2`` is an anchor.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION = _U(0xFFFFFFFF)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (xor-shift and multiply steps)."""
    values = values ^ (values >> _U(31))
    values = values * _U(0x7FB5D329728EA185)
    values = values ^ (values >> _U(27))
    values = values * _U(0x81DADEF4BC2DD44D)
    return values ^ (values >> _U(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    filled, step = 1, base & 0xFFFFFFFFFFFFFFFF
    while filled < n:  # out[filled:] = out[:filled] * base ** filled
        take = min(filled, n - filled)
        out[filled:filled + take] = out[:take] * _U(step)
        step = step * step & 0xFFFFFFFFFFFFFFFF
        filled += take
    return out


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
_tables: dict[str, np.ndarray] = {"up": _powers(_BASE, 1 << 12), "down": _powers(_INVERSE, 1 << 12)}


def _table(name: str, base: int, n: int) -> np.ndarray:
    if len(_tables[name]) < n:
        _tables[name] = _powers(base, 1 << (n - 1).bit_length())
    return _tables[name][:n]


class Hashes:
    """Prefix sums of one buffer; ``of(start, stop)`` hashes any of its byte strings."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        self.prefix = np.zeros(n + 1, _U)
        np.cumsum(_BYTES[buffer] * _table("up", _BASE, max(n, 1))[:n], out=self.prefix[1:])
        self.down = _table("down", _INVERSE, n + 1)

    def rolling(self, length: int) -> np.ndarray:
        """Unmixed hash of every string of this length."""
        m = len(self.prefix) - length
        return (self.prefix[length:] - self.prefix[:m]) * self.down[:m] if m > 0 else np.zeros(0, _U)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        raw = (self.prefix[stop] - self.prefix[start]) * self.down[start]
        return mix(raw ^ (np.asarray(stop - start).astype(_U) * _U(0xA24BAED4963EE407)))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


class Windows:
    """Runs of neighbouring windows that share an anchor.

    ``first`` and ``last`` are buffer positions of a run's first and last window, ``anchor`` the
    position they chose, ``doc`` the index of the document, ``gram_hash`` the anchor's string.
    """

    def __init__(self, buffer: np.ndarray, offsets: np.ndarray, span: int, gram: int):
        self.hashes = Hashes(buffer)
        n = len(buffer)
        starts, stops = offsets[:-1], offsets[1:]
        windows = n - span + 1
        if windows <= 0 or not len(starts):
            self.first = self.last = self.anchor = self.doc = np.zeros(0, np.int64)
            self.gram_hash = np.zeros(0, _U)
            return
        raw = mix(self.hashes.rolling(gram))
        place = np.arange(len(raw), dtype=_U)
        chosen = sliding_minimum((raw & ~_POSITION) | place, span - gram + 1)
        anchor = (chosen & _POSITION).astype(np.int64)
        # Windows that would run over the end of their document are left out.
        inside = np.zeros(windows + 1, np.int8)
        long = stops - starts >= span
        np.add.at(inside, starts[long], 1)
        np.add.at(inside, (stops - span + 1)[long], -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]))
        if not len(at):
            self.first = self.last = self.anchor = self.doc = np.zeros(0, np.int64)
            self.gram_hash = np.zeros(0, _U)
            return
        own = anchor[at]
        cut = np.flatnonzero((own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        self.first = at[np.concatenate(([0], cut))]
        self.last = at[np.concatenate((cut - 1, [len(at) - 1]))]
        self.anchor = own[np.concatenate(([0], cut))]
        self.gram_hash = raw[self.anchor]
        self.doc = np.searchsorted(offsets, self.first, "right") - 1
