"""The newest answer of each key from a stream: reuse of answers without going over what is kept."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def distinct_within(stream: DataFrame, keys: list[str], stamp: str, age: str = "10 days") -> DataFrame:
    """Each key's first answer within ``age``; later ones are dropped and state older than that is let go."""
    return stream.withWatermark(stamp, age).dropDuplicatesWithinWatermark(keys)


def newest(stream: DataFrame, keys: list[str], stamp: str, value: str, age: str = "10 days") -> DataFrame:
    """Per key the newest answer so far, told whenever it changes: ``(keys, stamp, value)``; late answers never win.

    The state of a key is its newest stamp and value, however many answers came; of equal stamps the greater value wins.
    A key without news for ``age`` after its newest stamp is let go once the watermark has passed, which trails by ``age``:
    what comes later than that is dropped as late before it is seen, so state holds live keys only.
    """
    types = dict(stream.dtypes)
    out = ", ".join(f"{k} {types[k]}" for k in keys) + f", {stamp} {types[stamp]}, {value} {types[value]}"
    wait = int(pd.Timedelta(age).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old: Any = state.get if state.exists else None
        best = old
        for b in batches:
            r = b.sort_values([stamp, value]).iloc[-1]
            seen = (int(r[stamp].value), float(r[value]))
            if best is None or seen > best:
                best = seen
        if best is not None:
            state.update(best)
            state.setTimeoutTimestamp(max(best[0] // 1_000_000, state.getCurrentWatermarkMs()) + wait)
        if best is not None and best != old:
            yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, stamp: [pd.Timestamp(best[0])], value: [best[1]]})

    return stream.withWatermark(stamp, age).groupBy(*keys).applyInPandasWithState(step, out, "stamp long, value double", "update", GroupStateTimeout.EventTimeTimeout)


def active_windows(stream: DataFrame, keys: list[str], stamp: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Answers per key and time window, late ones counted as long as the watermark allows."""
    return stream.withWatermark(stamp, late).groupBy(F.window(stamp, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def run_once(df: DataFrame, mode: str, path: str) -> DataFrame:
    """Run a stream over what is there now and give its result as a table: the last state in complete mode, all updates in others."""
    spark = df.sparkSession

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")
