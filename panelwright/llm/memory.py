"""Tables that a Python worker keeps from task to task: those of one operator at a time.

Spark's workers outlive a stage. What they learned there (hashes of words, ids of
pieces) would be held through all later stages of other operators.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_forget: dict[str, Callable[[], None]] = {}


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """Say how a process forgets the tables of ``owner``."""
    _forget[owner] = forget


def give_back() -> None:
    """Hand free memory back to the system; the allocators would keep it."""
    gc.collect()
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def keep_only(owner: str) -> None:
    """Forget the tables of all others; they learn afresh when their turn comes."""
    for name, forget in _forget.items():
        if name != owner:
            forget()
    give_back()


def with_tables_of(owner: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work``, for mapInArrow, in a worker that holds no tables but those of ``owner``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(owner)
        yield from work(batches)
        give_back()

    return run
