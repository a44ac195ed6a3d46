"""Batches of a bounded query's rows, a partition at a time, for results larger than the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any, Self

from pyspark.sql import DataFrame

from sparrel.errors import ClosedError, ExecutionError, NotStartedError, ReusedError, SparrelError, ValueRefusedError


def batches(rows: Iterable, size: int) -> Iterator[list]:
    it = iter(rows)
    while batch := list(islice(it, size)):
        yield batch


class ChunkStream:
    """Lists of at most `size` decoded rows. Enter it once, then iterate; leaving it, also by break or
    error, ends it. Spark prefetches the next partition meanwhile."""

    def __init__(self, frame: Callable[[], DataFrame], turn: Callable[[Any], Any], size: int) -> None:
        if not isinstance(size, int) or isinstance(size, bool) or size < 1:
            raise ValueRefusedError(f"a chunk has 1 row or more, not {size!r}")
        self.frame, self.turn, self.size, self.state = frame, turn, size, "new"
        self._batches: Iterator[list] = iter(())

    def __enter__(self) -> Self:
        if self.state != "new":
            raise ReusedError("a stream is entered once")
        self.state = "open"
        self._batches = batches(self.frame().toLocalIterator(prefetchPartitions=True), self.size)
        return self

    def __exit__(self, *_: Any) -> None:
        self.state, self._batches = "closed", iter(())

    def __iter__(self) -> Self:
        return self

    def __next__(self) -> list:
        if self.state == "new":
            raise NotStartedError("enter the stream first")
        if self.state == "closed":
            raise ClosedError("the stream is closed")
        try:
            return [self.turn(r) for r in next(self._batches)]
        except (StopIteration, SparrelError):
            raise
        except Exception as e:
            raise ExecutionError(f"reading failed: {e}") from e
