"""A priority queue of rows of 64-bit numbers that writes to disk what it can't hold."""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

#: Rows of a run that are read back at once.
READ_ROWS = 4096


class SpillingQueue:
    """push() rows of `width` whole numbers, pop() the smallest.

    At most `limit` rows are held. When there are more, the greater half is written in order as a run in the
    task's temporary folder, like any sort of Spark's that spills: a file without a name, gone with the task, and
    made again if the task is. Of each run one block is in memory.
    """

    def __init__(self, width: int, limit: int):
        self.width, self.limit = width, limit
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []  # (smallest row left of a run, number of the run, the rest of it)
        self.runs = 0

    def __len__(self) -> int:
        """Rows at hand; 0 only if there is none anywhere."""
        return len(self.heap) + len(self.heads)

    def push(self, row: tuple) -> None:
        heapq.heappush(self.heap, row)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        rows = sorted(self.heap)
        half = len(rows) // 2
        self.heap = rows[:half]  # sorted, so a heap
        file = tempfile.TemporaryFile()
        np.array(rows[half:], np.int64).tofile(file)
        self._advance(self._read(file), self.runs)
        self.runs += 1

    def _read(self, file) -> Iterator[tuple]:
        at = 0
        while True:
            file.seek(at)
            block = np.fromfile(file, np.int64, READ_ROWS * self.width).reshape(-1, self.width)
            if not len(block):
                file.close()
                return
            at += block.nbytes
            yield from map(tuple, block.tolist())

    def _advance(self, rows: Iterator[tuple], run: int) -> None:
        head = next(rows, None)
        if head is not None:
            heapq.heappush(self.heads, (head, run, rows))

    def least(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            row, run, rest = heapq.heappop(self.heads)
            self._advance(rest, run)
            return row
        return heapq.heappop(self.heap)
