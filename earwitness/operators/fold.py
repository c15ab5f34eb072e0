"""Sequential folds over sorted groups with bounded memory.

For the few recurrences where each step needs the result of the one before,
rows of a group are streamed in order through a small state object. Spark does
the grouping and the sorting; a task holds one Arrow batch plus the state, never
a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from earwitness.session import spread


class Fold:
    """State for one group. ``feed`` and ``finish`` return output tuples."""

    def feed(self, row) -> Iterable[tuple]:
        raise NotImplementedError

    def finish(self) -> Iterable[tuple]:
        return ()


def sorted_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    make: Callable[[], Fold],
    schema: StructType,
) -> DataFrame:
    keys = list(keys)
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = None
        state: Fold | None = None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    if state is not None:
                        out.extend(state.finish())
                    current, state = key, make()
                out.extend(state.feed(row))
            if out:
                yield _frame(out, names)
        if state is not None:
            out = list(state.finish())
            if out:
                yield _frame(out, names)

    return spread(df, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def sorted_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    label: Callable[[pd.DataFrame], pd.DataFrame],
    schema: StructType,
) -> DataFrame:
    """Label the rows of many small groups. ``label`` gets one group at a time, rows in order.

    Groups are cut out of sorted batches, so a partition with a million tiny
    groups costs one Python call per group and no per-group transfer.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            ids = batch[keys]
            fresh = (ids != ids.shift()).any(axis=1).to_numpy()
            if held and len(batch):
                fresh[0] = tuple(ids.iloc[0]) != tuple(held[-1][keys].iloc[-1])
            starts = np.flatnonzero(fresh)
            if not len(starts):
                held.append(batch)
                continue
            head = batch.iloc[:starts[0]]
            whole = pd.concat([*held, head], ignore_index=True) if held else head
            out = [label(whole)] if len(whole) else []
            out += [label(batch.iloc[a:b]) for a, b in zip(starts, starts[1:])]
            held = [batch.iloc[starts[-1]:]]
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            yield label(pd.concat(held, ignore_index=True))

    return spread(df, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame.from_records(rows, columns=names).astype(object)
