"""Streams: an index that follows a folder, and commands that come as JSON lines."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata import api
from lodestrata.sources import stores


def follow(spark: SparkSession, root: str, folder: str, checkpoint: str, every: str = "500 milliseconds", done: Callable[[str], None] | None = None) -> StreamingQuery:
    """Keeps the index in ``folder`` up to date with the files below root.

    New files start a batch; a batch lists the files anew, since a file source sees neither changes nor removals, and builds what
    differs by content hash. A clock source makes batches come without new files too, so removals are seen in time.
    """
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def refresh(_: DataFrame, __: int) -> None:
        state, _tables = stores.index(stores.walk(spark, root), folder)
        if done:
            done(state)

    return clock.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def answer(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, space: api.Workspace, available_now: bool = True) -> StreamingQuery:
    """Runs the commands of JSON-line files that appear in ``inbox``; results go to ``outbox`` as JSON lines, once for each batch."""
    rows = spark.readStream.schema("value string").text(inbox)

    def respond(batch: DataFrame, number: int) -> None:
        results = api.batch(space, stores.parsed_commands(batch))
        made = [(json.dumps({k: v for k, v in r.items() if v is not None}, ensure_ascii=False, default=str),) for r in results]
        spark.createDataFrame(made, "value string").coalesce(1).write.mode("overwrite").text(f"{outbox}/batch={number}")

    query = rows.writeStream.foreachBatch(respond).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()


def telemetry_by_command(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Calls and bytes of each command in each window of a stream telemetry(at timestamp, command, actual_bytes, baseline_bytes); rows later than ``late`` are left out."""
    return events.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "command").agg(F.count("*").alias("calls"), F.sum("actual_bytes").alias("actual_bytes"), F.sum("baseline_bytes").alias("baseline_bytes")).select(F.col("w.start").alias("start"), "command", "calls", "actual_bytes", "baseline_bytes")
