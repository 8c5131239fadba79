"""Encoding many short pieces through a bounded cache."""
from __future__ import annotations

import numpy as np

from .common import gather_ranges


class Places(dict):
    """Places of pieces in order of first use; ``new`` holds those that have come since it was last emptied."""

    def __init__(self, names=()):
        super().__init__(zip(names, range(len(names))))
        self.new: list[str] = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


class PieceTable:
    """Token ids of pieces of text; distinct pieces are encoded once and kept.

    ``encode_many`` takes a list of pieces and returns flat ids and the number of ids of each piece. Beyond ``limit``
    pieces the table drops those that came once only, and all if too many are left; a dropped piece costs time, no result
    depends on it.
    """

    def __init__(self, encode_many, limit: int = 200_000):
        self.encode_many, self.limit = encode_many, limit
        self.clear()

    def clear(self):
        self.codes = Places()
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def shrink(self):
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > self.limit // 2:
            return self.clear()
        names = list(self.codes)  # in order of their codes
        self.codes = Places([names[i] for i in keep.tolist()])
        counts = self.counts[keep]
        flat = self.flat[gather_ranges(self.starts[keep], counts)]
        self.flat = np.concatenate([flat, np.zeros(1 << 16, np.int32)])
        self.used, self.counts, self.uses = len(flat), counts, np.zeros(len(keep), np.int64)
        self.starts = np.cumsum(counts) - counts

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all pieces in order, and the number of ids of each piece."""
        if len(self.codes) > self.limit:
            self.shrink()
        order = np.fromiter(map(self.codes.__getitem__, pieces), np.int64, len(pieces))
        new = self.codes.new
        if new:
            ids, counts = self.encode_many(new)
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(self.used + len(ids), np.int32)])
            self.flat[self.used:self.used + len(ids)] = ids
            ends = self.used + np.cumsum(counts)
            self.starts = np.concatenate([self.starts, ends - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
            self.used += len(ids)
            self.codes.new = []
        self.uses += np.bincount(order, minlength=len(self.uses))
        counts = self.counts[order]
        return self.flat[gather_ranges(self.starts[order], counts)], counts
