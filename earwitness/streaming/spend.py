"""Incremental spend guard: per job, admit chunks until the budget would break."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "job_id string, seq long, spent_before long, runs boolean"


class SpendGuard(StatefulProcessor):
    """State per job: what was spent, whether it stopped, and the chunks already seen.

    A chunk delivered twice (same hash, model, provider) is ignored. Once a chunk
    breaks the budget, or has taken actual spend past it, the job stays stopped for
    all chunks after it, also across restarts. A job's arrivals of one micro-batch
    are gathered and taken in ``seq`` order; the trigger bounds how many those are.
    """

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "spent long, stopped boolean")
        self.seen = handle.getMapState("seen", "identity string", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        spent, stopped = self.spent.get() if self.spent.exists() else (0, False)
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            identity = (f"{r.chunk_sha256}/{r.model}/{r.provider_code}",)
            if self.seen.containsKey(identity):
                continue
            self.seen.updateValue(identity, (int(r.seq),))
            stopped = stopped or spent > self.cap or (not r.cached and r.estimated > max(0, self.cap - spent))
            out.append((key[0], int(r.seq), int(spent), not stopped))
            if not stopped and not r.cached:
                spent += int(r.actual)
        self.spent.update((int(spent), bool(stopped)))
        yield pd.DataFrame(out, columns=["job_id", "seq", "spent_before", "runs"])

    def close(self) -> None:
        pass


def guard_stream(chunks: DataFrame, cap: int) -> DataFrame:
    """``chunks``: streaming job_id, seq, chunk_sha256, model, provider_code, estimated, actual, cached.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return chunks.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=SpendGuard(cap), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
