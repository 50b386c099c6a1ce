"""The best few of many scored candidates, kept over blocks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def sortable(column: pa.Array) -> np.ndarray:
    """Ids, integers or strings, as an array that numpy sorts as Spark does."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else np.array(column.to_pylist(), dtype=str)


class Best:
    """The best ``top`` (score, id) of each slot so far: higher scores first, then smaller ids. Scores are of one kind, ids sort."""

    def __init__(self, slots: int, top: int, kind=np.float64):
        self.top, self.slots = top, slots
        self.slot, self.score, self.id = np.empty(0, dtype=np.int64), np.empty(0, dtype=kind), None
        #: What a slot that is full asks for.
        self.bar = np.full(slots, -np.inf if kind is np.float64 else np.iinfo(kind).min, dtype=kind)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Takes candidates in; they are sorted in once there are as many as half of what is kept."""
        if len(slot):
            self.waiting.append((slot, score, ids))
            self.size += len(slot)
            if self.size >= max(1 << 14, len(self.slot) // 2):
                self._settle()

    def _settle(self) -> None:
        if not self.waiting:
            return
        held = [] if self.id is None else [(self.slot, self.score, self.id)]
        slot, score, ids = (np.concatenate(x) for x in zip(*held, *self.waiting, strict=True))
        self.waiting, self.size = [], 0
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = nth < self.top
        self.slot, self.score, self.id, nth = slot[kept], score[kept], ids[kept], nth[kept]
        full = nth == self.top - 1
        self.bar[self.slot[full]] = self.score[full]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, score, id) of all that is kept."""
        self._settle()
        return self.slot, self.score, np.empty(0, dtype=np.int64) if self.id is None else self.id


def few(scores: np.ndarray, ok: np.ndarray, top: int, off: float = 0.0) -> np.ndarray:
    """ok, where a row has many, narrowed to what is no worse than its ``top`` best, by scores that may be ``off`` by so much each."""
    if scores.shape[1] <= top or ok.sum() <= 4 * top * len(ok):
        return ok
    low = np.where(ok, scores, -np.inf)
    last = np.partition(low, low.shape[1] - top, axis=1)[:, low.shape[1] - top]
    return ok & (scores >= (last - 2 * off if off else last)[:, None])
