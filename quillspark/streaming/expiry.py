"""Results that expire a fixed time after they were made, over a stream of events.

A result is made for a key, replaces the one before, and can be read until its time
to live is over. Reading it doesn't make it live longer. State is one time stamp a key
and goes when the watermark passes its end, whether or not the key is seen again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: minutes that a result lives.
MINUTES = 15

READS = "key long, event_id long, ts timestamp, made_at timestamp, live boolean"


def reads(events: DataFrame, minutes: float = MINUTES, late: str = "0 seconds") -> DataFrame:
    """key, event_id, ts, made_at, live of each read, from a stream of key, event_id,
    ts, makes. made_at is when the key's last result before the read was made, null
    if there is none that lives; live is whether it can still be read. A result is live up to
    and with the instant its time ends. Within a micro-batch events are taken in the
    order of ts, then event_id; events of a key are expected in that order between
    batches. Rows with a null ts or key are left out."""
    life = pd.Timedelta(minutes=minutes)

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        made = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            if row.makes:
                made = row.ts
            else:
                live = made is not None and row.ts - made <= life
                out.append((key[0], row.event_id, row.ts, made if live else None, live))
        if made is not None:
            end = int((made + life).value // 1_000_000)
            if end > state.getCurrentWatermarkMs():
                state.update((int(made.value // 1000),))
                state.setTimeoutTimestamp(end + 1)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["key", "event_id", "ts", "made_at", "live"]).astype({"ts": "datetime64[ns]", "made_at": "datetime64[ns]", "live": bool})

    rows = events.where("ts is not null and key is not null").select("key", "event_id", "ts", F.coalesce("makes", F.lit(False)).alias("makes"))
    return rows.withWatermark("ts", late).groupBy("key").applyInPandasWithState(follow, READS, "made long", "append", GroupStateTimeout.EventTimeTimeout)


def reads_at_once(events: DataFrame, minutes: float = MINUTES) -> DataFrame:
    """The same of a table."""
    before = Window.partitionBy("key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    t = events.where("ts is not null and key is not null").withColumn("made_at", F.max(F.when(F.col("makes"), F.col("ts"))).over(before))
    live: Column = F.coalesce(F.col("ts") <= F.col("made_at") + F.make_dt_interval(mins=F.lit(int(minutes))), F.lit(False))
    return t.where(~F.coalesce("makes", F.lit(False))).select("key", "event_id", "ts", F.when(live, F.col("made_at")).alias("made_at"), live.alias("live"))


def written(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Run a stream over what is there now and append its rows to a Parquet folder."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(folder).awaitTermination()
