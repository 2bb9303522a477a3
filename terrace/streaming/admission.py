"""Admission of samples on a stream, by the same step as the batch fold, state kept per source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terrace.operators.fold import TAKEN, verdict

OUT = "source string, at double, accepted boolean, reason string"


class Admission(StatefulProcessor):
    """Keeps the last accepted sample and the newest time of a source; samples older than that are ``out-of-order``."""

    def __init__(self, policy: dict[str, float]):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "at double, position double, newest double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        last = None if known is None or known[0] is None else (known[0], known[1])
        newest = None if known is None else known[2]
        out = []
        for row in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples(index=False):
            if newest is not None and row.at < newest:
                out.append((key[0], row.at, False, "out-of-order"))
                continue
            newest = row.at
            reason = verdict(last, (row.at, row.position, row.pending, row.depth, row.clipped, row.sharpness), self.policy)
            accepted = reason in TAKEN
            if accepted:
                last = (row.at, row.position)
            out.append((key[0], row.at, accepted, reason))
        self.state.update((*(last or (None, None)), newest))
        yield pd.DataFrame(out, columns=["source", "at", "accepted", "reason"])

    def close(self) -> None:
        pass


def admitted(stream: DataFrame, policy: dict[str, float]) -> DataFrame:
    """``OUT`` rows of a stream ``(source, at, position, pending, depth, clipped, sharpness)``; needs the RocksDB state store."""
    return stream.groupBy("source").transformWithStateInPandas(Admission(policy), OUT, "Append", "None")
