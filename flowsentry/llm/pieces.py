"""Cache of encoded pieces of text, shared by the byte-level encoders."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from flowsentry.llm.blocks import eights, low_bytes, mix, ragged_index

#: Pieces up to this many bytes are held as two numbers, longer ones in a dictionary of bytes.
_NUMBERED = 16


class PieceCache:
    """Tokens of the pieces met last. A hit compares the whole piece, never a hash alone."""

    #: Slots for short pieces, and the tokens held before the cache starts anew.
    BITS = 20
    TOKENS = 1 << 22

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self._low, self._high = np.zeros(1 << self.BITS, dtype=np.uint64), np.zeros(1 << self.BITS, dtype=np.uint64)
        self._size, self._entry = np.full(1 << self.BITS, -1, dtype=np.int64), np.full(1 << self.BITS, -1, dtype=np.int64)
        self._long: dict[bytes, int] = {}
        self._starts, self._lens = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self._tokens = np.zeros(0, dtype=np.int32)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode: Callable) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pieces in order, count per piece); encode(data, starts, ends) does so for pieces not met before."""
        if len(self._tokens) > self.TOKENS:
            self._clear()
        at, lens = eights(data), ends - starts
        short = lens <= _NUMBERED
        low = low_bytes(at[starts], lens)
        high = low_bytes(at[np.minimum(starts + 8, len(data))], lens - 8)
        key = mix(mix(low) + high * np.uint64(0x9E3779B97F4A7C15) + lens.astype(np.uint64))
        slot = (key >> np.uint64(64 - self.BITS)).astype(np.int64)
        hit = (self._low[slot] == low) & (self._high[slot] == high) & (self._size[slot] == lens)
        entry = np.where(hit, self._entry[slot], -1)

        missed = np.flatnonzero(short & (entry < 0))
        _, where, inverse = np.unique(key[missed], return_index=True, return_inverse=True)
        first = missed[where]
        leader = first[inverse]
        same = (low[missed] == low[leader]) & (high[missed] == high[leader]) & (lens[missed] == lens[leader])
        alone = missed[~same]  # another piece has the same key: encoded for itself
        base = len(self._starts)
        entry[missed[same]] = base + inverse[same]
        entry[alone] = base + len(first) + np.arange(len(alone))
        new_long = []
        for i in np.flatnonzero(~short).tolist():
            name = data[starts[i] : ends[i]].tobytes()
            known = self._long.get(name)
            if known is None:
                known = self._long[name] = base + len(first) + len(alone) + len(new_long)
                new_long.append(i)
            entry[i] = known
        some = np.concatenate([first, alone, np.array(new_long, dtype=np.int64)])
        if len(some):
            tokens, counts = encode(data, starts[some], ends[some])
            self._starts = np.concatenate([self._starts, len(self._tokens) + np.cumsum(counts) - counts])
            self._lens = np.concatenate([self._lens, counts])
            self._tokens = np.concatenate([self._tokens, tokens])
            put = slot[first]
            self._low[put], self._high[put], self._size[put], self._entry[put] = low[first], high[first], lens[first], entry[first]
        counts = self._lens[entry]
        return self._tokens[ragged_index(self._starts[entry], counts)], counts
