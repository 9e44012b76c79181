"""Grouped kernels over sorted partitions: many small groups share a batch, a large one is held whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def by_group(df: DataFrame, keys: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """What the kernel makes of the rows of each group of keys; rows come in order of the keys and of sort columns that follow them in df."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def groups(frame: pd.DataFrame, last: bool) -> Iterator[pd.DataFrame]:
            own = frame[keys]
            new = np.flatnonzero((own.ne(own.shift()) & ~(own.isna() & own.shift().isna())).any(axis=1).to_numpy())
            cuts = [0, *new[new > 0].tolist(), len(frame)]
            done = [kernel(frame.iloc[a:b].reset_index(drop=True)) for a, b in zip(cuts, cuts[1:] if last else cuts[1:-1], strict=False)]
            held[:] = [] if last else [frame.iloc[cuts[-2] :]]
            found = [x for x in done if x is not None and len(x)]
            if found:
                yield pd.concat(found, ignore_index=True)

        for frame in frames:
            if not len(frame):
                continue
            # a group that goes on through whole batches is put together once
            if held and (held[0][keys].iloc[0].astype(object).equals(frame[keys].iloc[-1].astype(object))):
                held.append(frame)
                continue
            yield from groups(pd.concat([*held, frame], ignore_index=True), last=False)
        if held:
            yield from groups(pd.concat(held, ignore_index=True), last=True)

    order = [c for c in df.columns if dict(df.dtypes)[c] in ("int", "bigint", "double", "string")]
    return df.repartition(*keys).sortWithinPartitions(*keys, *(c for c in order if c not in keys)).mapInPandas(run, schema)
