"""Structured Streaming form of the cooldown gate (an extension of the batch operator)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.operators.panel import COOLDOWN_DAYS


def streaming_cooldown(events: DataFrame, cooldown_days: int = COOLDOWN_DAYS, delay: str = "7 days") -> DataFrame:
    """Gate a stream ``symbol, ts, entry, loss``: each entry row comes out with ``blocked``.

    State is one date per symbol, the last loss, so it is bounded by the number of symbols.
    Rows of a micro-batch are put in order, losses before entries of the same moment; rows
    later than ``delay`` behind the watermark may be dropped by Spark.
    """

    def gate(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        rows = rows.sort_values(["ts", "loss"], ascending=[True, False])
        last = pd.Timestamp(state.get[0]) if state.exists else None
        out = []
        for row in rows.itertuples(index=False):
            if row.loss:
                last = row.ts if last is None else max(last, row.ts)
            if row.is_signal:
                near = last is not None and 0 <= (row.ts - last).days < cooldown_days
                out.append((key[0], row.ts, bool(row.entry) and not near, bool(row.entry) and near))
        if last is not None:
            state.update((last.to_pydatetime(),))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "ts", "entry", "blocked"])

    tidy = events.select(
        "symbol", "ts", F.coalesce("entry", F.lit(False)).alias("entry"), F.coalesce("loss", F.lit(False)).alias("loss"), F.col("entry").isNotNull().alias("is_signal")
    )
    return (
        tidy.withWatermark("ts", delay)
        .groupBy("symbol")
        .applyInPandasWithState(gate, "symbol string, ts timestamp, entry boolean, blocked boolean", "last timestamp", "append", "NoTimeout")
    )
