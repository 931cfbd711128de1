"""Structured Streaming forms of the repeated polls: daily bars, keyed merges, level alerts, replaced dates.

A merge keeps its table in buckets (sources/keyed_table.py): each batch rewrites
the buckets of its keys only, a batch that runs twice leaves the same table, and
readers never see half of one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import merge
from ..operators.portfolio import level_status
from ..shipping import ship_package
from ..sources.keyed_table import BUCKETS, KeyedTable


def daily_bars(ticks: DataFrame, late: str = "2 days") -> DataFrame:
    """ticks(symbol, ts, price, size, seq) to bars by day. Of ticks at one time the larger seq is the later. Rows later than `late` don't count here; keep_late stores them."""
    at = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", "1 day").alias("day"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
        .select("symbol", F.to_date("day.start").alias("date"), "open", "high", "low", "close", "volume")
    )


def keep_late(folder: str, late: str = "2 days") -> Callable[[DataFrame, int], None]:
    """For foreachBatch over the ticks of daily_bars: append the rows whose day was closed before they came to folder/late.

    A day is closed once a tick of an earlier batch is `late` or more behind its end, the watermark's own rule. Each batch leaves its
    newest time under folder/newest; a batch that runs again reads those of earlier batches only and replaces what it wrote.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.agg(F.max("ts").alias("ts")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/newest/batch={batch_id}")
        newest = spark.read.parquet(f"{folder}/newest").where(F.col("batch") < batch_id).agg(F.max("ts")).first()[0]
        closed = F.date_trunc("day", "ts") + F.expr(f"INTERVAL 1 DAY + INTERVAL {late}") <= F.lit(newest)
        rows = batch.where(closed) if newest is not None else batch.limit(0)
        rows.write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")

    return run


def merging(folder: str, keys: list[str], how: str = "upsert", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merge each batch into the keyed table of the folder. Of rows of one key in a batch the one of the largest seq counts.

    how is "upsert" (newer wins), "insert" (older wins) or "replace" (all rows of the batch's values of the first key, dates for instance, are replaced).
    """
    rules = {"upsert": lambda kept, new: merge.upsert(kept, new, keys), "insert": lambda kept, new: merge.insert_absent(kept, new, keys), "replace": lambda kept, new: merge.replace_dates(kept, new, keys[0])}

    def run(batch: DataFrame, batch_id: int) -> None:
        new = batch if how == "replace" else merge.dedupe(batch, keys, F.desc("seq") if how == "upsert" else F.col("seq"))
        KeyedTable(batch.sparkSession, folder, keys[:1] if how == "replace" else keys, buckets).merge(new, rules[how], batch_id)

    return run


#: What counts as a hit, and what a symbol's state is before its first.
HITS, NO_HIT = ("STOP_HIT", "TARGET_HIT"), "NONE"


def level_alerts(ticks: DataFrame, levels: DataFrame) -> DataFrame:
    """Stop and target hits of ticks(symbol, ts, price, seq) against a static level table: one alert whenever a symbol's status turns to a hit that it wasn't before.

    The state of a symbol is its last hit and the time and seq it was told at; it holds over batches. Of a batch the rows go by time, then seq;
    rows older than the state are late and change nothing. Leaving a level and hitting it again is a new alert.
    """
    ship_package(ticks.sparkSession)
    status = F.coalesce(level_status("price", "stop", "target"), F.lit(NO_HIT))
    x = ticks.join(levels, "symbol").select("symbol", "ts", "seq", "price", F.when(status.isin(*HITS), status).otherwise(NO_HIT).alias("status"))
    kind = x.schema["symbol"].dataType.simpleString()

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at, seq = state.get if state.exists else (NO_HIT, None, -1)
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        if at is not None:
            rows = rows[(rows["ts"] > at) | ((rows["ts"] == at) & (rows["seq"] > seq))]
        if not len(rows):
            return
        before = rows["status"].shift(fill_value=last)
        turned = rows[(rows["status"] != before) & (rows["status"] != NO_HIT)]
        end = rows.iloc[-1]
        state.update((end["status"], end["ts"].to_pydatetime(), int(end["seq"])))
        yield turned[["symbol", "ts", "price", "status"]]

    return x.groupBy("symbol").applyInPandasWithState(follow, f"symbol {kind}, ts timestamp, price double, status string", "status string, ts timestamp, seq long", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Work through what has landed, batch by batch, and stop."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
