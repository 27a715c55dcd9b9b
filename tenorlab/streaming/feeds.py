"""Structured Streaming: live last values, time bars and the throttled console sink."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from tenorlab.operators.bars import intraday_bars
from tenorlab.operators.live import FIELDS, last_values
from tenorlab.session import shared_path


def file_stream(spark: SparkSession, folder: str, schema, name: str = "*.parquet", files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream; a live feed is a source of the same columns."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(folder)


def live_last_values(updates: DataFrame, fields: Sequence[str] = FIELDS, order: Sequence[str] = ("event_ts", "seq")) -> DataFrame:
    """The last-value state of a stream; state is one row per security."""
    return last_values(updates, fields, order)


def live_bars(ticks: DataFrame, minutes: int = 5, late: str = "1 day", order: Sequence[str] = ("time",)) -> DataFrame:
    """Time bars of a stream; bars older than the watermark leave the state."""
    return intraday_bars(ticks.withWatermark("time", late), minutes, order)


def run_available(result: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run a stream over what is there and return its rows as a table: of each key the latest micro-batch's.

    Micro-batches are written under their number, so a batch that runs again overwrites itself.
    """
    spark = result.sparkSession
    path = shared_path(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = result.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(StructType([*result.schema, StructField("batch", LongType())])).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    latest = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return rows.withColumn("__r", F.row_number().over(latest)).where(F.col("__r") == 1).select(*result.columns)


def subscribed(updates: DataFrame, wanted: Mapping[str, Sequence[str]], fields: Sequence[str] = FIELDS) -> DataFrame:
    """The updates of the wanted securities, each with the fields wanted of it; others are null. Works on streams and tables."""
    asked = [f for f in fields if f in updates.columns]
    of = lambda f: F.col("security").isin([s for s, names in wanted.items() if f in names])
    return updates.where(F.col("security").isin(list(wanted))).withColumns({f: F.when(of(f), F.col(f)) for f in asked})


def stamped(updates: DataFrame) -> DataFrame:
    """The updates with arrival_ts, the time at which their micro-batch came in."""
    return updates.withColumn("arrival_ts", F.current_timestamp())


def throttled(result: DataFrame, show: Callable[[DataFrame, int], None], every: str = "1 second") -> StreamingQuery:
    """Hand the whole state to ``show`` at most once per interval."""
    place = shared_path(result.sparkSession, "feed")
    return result.writeStream.outputMode("complete").foreachBatch(show).option("checkpointLocation", place).trigger(processingTime=every).start()


class LiveFeed:
    """A running feed: the state goes to ``on_data`` at most once per interval, status events to ``on_status``. Starting and stopping twice does nothing."""

    def __init__(self, state: DataFrame, on_data: Callable[[DataFrame, int], None], every: str = "1 second", on_status: Callable[[str, object], None] | None = None):
        self._state, self._on_data, self._every = state, on_data, every
        self._listener = StatusListener(on_status) if on_status else None
        self._query: StreamingQuery | None = None

    @property
    def running(self) -> bool:
        return self._query is not None and self._query.isActive

    def start(self) -> LiveFeed:
        if not self.running:
            if self._listener:
                self._state.sparkSession.streams.addListener(self._listener)
            self._query = throttled(self._state, self._on_data, self._every)
        return self

    def stop(self) -> None:
        if self._query is not None:
            self._query.stop()
            self._query = None
            if self._listener:
                self._state.sparkSession.streams.removeListener(self._listener)

    def __enter__(self) -> LiveFeed:
        return self.start()

    def __exit__(self, *_) -> None:
        self.stop()


class StatusListener(StreamingQueryListener):
    """Routes status events to a callback, apart from the data."""

    def __init__(self, on_status: Callable[[str, object], None]):
        self._on_status = on_status

    def onQueryStarted(self, event):
        self._on_status("started", event)

    def onQueryProgress(self, event):
        self._on_status("progress", event)

    def onQueryIdle(self, event):
        self._on_status("idle", event)

    def onQueryTerminated(self, event):
        self._on_status("terminated", event)
