"""Shingle sets and MinHash signatures of whole texts."""

from __future__ import annotations

import numpy as np

WIDTH = 5  # words of a shingle
ROWS, BANDS = 5, 25
N_HASHES = 128  # the last few serve comparison only

_SEEDS = (np.arange(1, N_HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Sets:
    """Distinct shingle hashes of each text: sorted within, at: where each text's begin."""

    def __init__(self, texts, width: int = WIDTH):
        from squall.llm.textcore import Words, grams, mix

        words = Words(texts, "space_lower")
        h = words.hashes()
        g, first = grams(h, words.at, width)
        row = np.searchsorted(words.at, first, "right") - 1
        sizes = np.diff(words.at)
        short = np.flatnonzero((sizes > 0) & (sizes < width))
        if len(short):  # fewer words: the whole sequence is the one shingle
            own = [mix(np.array([_fold(h[words.at[i] : words.at[i + 1]])], dtype=np.uint64))[0] for i in short]
            g, row = np.concatenate([g, np.array(own, dtype=np.uint64)]), np.concatenate([row, short])
        order = np.lexsort((g, row))
        g, row = g[order], row[order]
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        self.hashes, row = g[new], row[new]
        self.at = np.searchsorted(row, np.arange(len(sizes) + 1))

    def sizes(self) -> np.ndarray:
        return np.diff(self.at)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each set."""
        from squall.llm.textcore import mix

        out = []
        for salt in (0x1234567887654321, 0x0F0F1E2D3C4B5A69):
            total = np.zeros(len(self.hashes) + 1, dtype=np.uint64)
            np.cumsum(mix(self.hashes ^ np.uint64(salt)), dtype=np.uint64, out=total[1:])
            out.append(mix((total[self.at[1:]] - total[self.at[:-1]]) ^ np.uint64(salt)).view(np.int64))
        return out[0], out[1]

    def signatures(self) -> np.ndarray:
        """MinHash values (32 bits) of each nonempty set, row by row in order."""
        some = np.flatnonzero(self.sizes() > 0)
        out = np.empty((len(some), N_HASHES), dtype=np.uint32)
        starts = self.at[:-1][some]
        if len(some):
            folded = self.hashes ^ (self.hashes >> np.uint64(31))
            for k in range(N_HASHES):
                out[:, k] = np.minimum.reduceat(((folded * _SEEDS[k]) >> np.uint64(32)).astype(np.uint32), starts)
        return out


def _fold(h: np.ndarray) -> int:
    total = len(h)
    for x in h.tolist():
        total = (total * 0x100000001B3 ^ x) & 0xFFFFFFFFFFFFFFFF
    return total


def band_keys(signatures: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key per signature and band, unlike for equal values of two bands."""
    from squall.llm.textcore import mix

    s = signatures[:, : rows * bands].reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(0x51ED270B), s.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0x100000001B3) ^ s[:, :, r])
    return key.view(np.int64)
