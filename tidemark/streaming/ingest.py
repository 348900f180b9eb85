"""Streams: incremental pulls, upserts on arrival, latest-wins labels, retry queues.

Every sink is idempotent: a batch that runs again after a failure leaves the same table.  Windows over events are an
extension; the store's own streams have no windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.operators.store import keep_last, upsert_entries
from tidemark.schemas import ENTRIES, KEY, REMOTE_LABELS
from tidemark.sources.snapshots import SnapshotTable


def landing(spark: SparkSession, folder: str, schema=ENTRIES, files_per_batch: int = 100, fmt: str = "json") -> DataFrame:
    """New files of a landing folder; the checkpoint is the cursor of the incremental pull."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)


def ingest_entries(stream: DataFrame, store: SnapshotTable, checkpoint: str, now: str) -> StreamingQuery:
    """Upsert every batch into the entry table; runs until the landing folder is empty."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        if store.version():
            base = store.read()
        else:
            base = batch.sparkSession.createDataFrame([], batch.schema)
        store.write(upsert_entries(base, batch, now))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_labels(stream: DataFrame, store: SnapshotTable, checkpoint: str) -> StreamingQuery:
    """Newest label of each key by its own time as text, whatever the order of arrival."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = batch if not store.version() else store.read().unionByName(batch)
        store.write(latest_labels(rows))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_labels(rows: DataFrame) -> DataFrame:
    """The newest row of each key; a missing time is the oldest."""
    return keep_last(rows, KEY, F.coalesce("labeled_at", F.lit("")).desc(), F.col("label"), F.coalesce("reasoning", F.lit("")))


def latest_labels_state(stream: DataFrame) -> DataFrame:
    """The same as running state, for a sink in update mode."""
    newest = F.max_by(F.struct(*[F.col(c) for c in REMOTE_LABELS.names if c not in KEY]), F.struct(F.coalesce("labeled_at", F.lit("")), "label"))
    return stream.groupBy(*KEY).agg(newest.alias("x")).select(*KEY, "x.*")


def retry_queue(stream: DataFrame, time: str, key: list[str] = KEY) -> DataFrame:
    """Queued sends, one a key: a later send replaces the one that waits (running state, for a sink in update mode).

    Of sends at one time the last by their values counts.
    """
    rest = [F.col(c) for c in stream.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col(time).cast("string"), F.lit("")), *rest))
    return stream.groupBy(*key).agg(last.alias("x")).select(*key, "x.*").select(*stream.columns)


def sent(queue: DataFrame, keys: DataFrame, key: list[str] = KEY) -> DataFrame:
    """A queue without what has been sent."""
    return queue.join(keys.select(*key).distinct(), key, "left_anti")


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """Event times as timestamps with zone (a watermark needs them); tables get no watermark."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    return e.withWatermark(time, late) if events.isStreaming else e


def tumbling(events: DataFrame, time: str = "ts", size: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums by window; works on streams and tables alike."""
    src = _timed(events, time, late)
    w = src.groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return w.select(F.col("w.start").alias("start"), by, "n", "total")


def sliding(events: DataFrame, time: str = "ts", size: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    src = _timed(events, time, late)
    return src.groupBy(F.window(time, size, step).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    src = _timed(events, time, late)
    s = src.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


class Progress(StreamingQueryListener):
    """Keeps what each query has done, for a job page."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.state: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.state[str(event.id)] = "running"

    def onQueryProgress(self, event) -> None:
        k = str(event.progress.id)
        self.rows[k] = self.rows.get(k, 0) + int(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.state[str(event.id)] = "failed" if event.exception else "done"
