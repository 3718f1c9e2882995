"""Polling, politeness and logging as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from weftline.operators.flow import rate_limited, seen_key


def poll_folder(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream of items."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def new_items(items: DataFrame, when: str = "fetched_at", late: str = "3 days") -> DataFrame:
    """Items whose link (else id) was not seen within the watermark; state of older ones is dropped.

    Where the seen set must be kept for ever, each batch meets the history instead.
    """
    return items.withColumn("seen_key", seen_key(F.col("link"), F.col("id"))).filter("seen_key is not null").withWatermark(when, late).dropDuplicatesWithinWatermark(["seen_key"])


class Politeness(StatefulProcessor):
    """Per authority: the delay doubles with every refusal (at most 300 s) and each request gets the time it may start."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pace", "delay double, free double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        delay, free = self.state.get() if self.state.exists() else (1.0, 0.0)
        out = []
        for b in rows:
            for r in b.sort_values("ts").itertuples():
                if r.limited:
                    delay = min(2 * delay, 300.0)
                at = max(float(r.ts), free)
                free = at + delay
                out.append((key[0], r.url, delay, at))
        self.state.update((delay, free))
        yield pd.DataFrame(out, columns=["authority", "url", "delay", "eligible_at"])

    def close(self) -> None:
        pass


def pace(requests: DataFrame) -> DataFrame:
    """authority, url, delay, eligible_at of a stream (authority, url, ts in seconds, status, snippet)."""
    r = requests.withColumn("limited", rate_limited(F.col("status"), F.col("snippet"))).select("authority", "url", "ts", "limited")
    return r.groupBy("authority").transformWithStateInPandas(Politeness(), "authority string, url string, delay double, eligible_at double", "Append", "None")


def log_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of entries to the log, each micro-batch once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_new(stream: DataFrame, call, checkpoint: str) -> StreamingQuery:
    """A function for every micro-batch of new articles (the hook for what follows)."""
    return stream.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
