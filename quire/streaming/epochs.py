"""The epoch feed.

The reference streams rows to its trainer from a generator that is re-run
every epoch and reads the epoch from a global. Here an epoch is a parameter:
each epoch is an independent batch job written to its own folder, so epochs
can be built ahead, in parallel, or again after a failure, and always give
the same rows. (The reference has no event-time streaming, watermarks or
state; none is built.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from quire.sources.writers import write_epoch_rows


def write_epochs(
    build: Callable[[int], DataFrame | tuple[DataFrame, int]], epochs: Iterable[int], path: str, order: str = "row_pos"
) -> list[str]:
    """Materialise ``build(epoch)`` for each epoch under ``path/epoch=N``.

    ``build`` returns the rows, or the rows and how many there must be (for
    example ``PairSet.rows`` and ``PairSet.expected_rows``); an epoch of
    another size raises :class:`quire.sources.writers.RowCountMismatch`, is
    not committed, and leaves the epochs before it as they are. Read the
    finished epochs with :func:`quire.sources.writers.read_committed`."""
    out = []
    for e in epochs:
        built = build(int(e))
        rows, expected = built if isinstance(built, tuple) else (built, None)
        write_epoch_rows(rows, path, int(e), order, expected)
        out.append(f"{path}/epoch={int(e)}")
    return out
