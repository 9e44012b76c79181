"""Rows to Arrow batches of many rows, bounded in rows and bytes: a batch for each row costs more than small rows themselves."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows of a batch at most, and bytes of their binary values beyond which no further row is added.
ROWS, BYTES = 512, 4 << 20


def batched(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in their order; a row larger than the bound is a batch of its own, or ends one."""
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) if isinstance(v, bytes) else 16 * len(v) for v in row.values() if isinstance(v, bytes | list))
        if len(held) >= ROWS or size >= BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
