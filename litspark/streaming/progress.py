"""Progress of streaming queries as rows of a table."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from litspark.sources.runs import table

ROWS = ("query_id string, run_id string, name string, batch_id bigint, at string, input_rows bigint, "
        "rows_per_second double, state_rows bigint, state_bytes bigint, late_rows bigint, watermark string")


class ProgressTable(StreamingQueryListener):
    """Listener that appends one row per micro-batch of every query to a Parquet table.

    Rows are written ``every`` events and when a query ends, so the driver holds
    at most ``every`` of them. ``names`` limits it to queries of these names.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 100, names: tuple[str, ...] | None = None) -> None:
        self._spark, self._path, self._every, self._names = spark, path, every, names
        self._rows: list[tuple] = []
        self._mine: set[str] = set()
        self._ended: dict[str, str | None] = {}
        self._changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        if self._names is None or event.name in self._names:
            with self._changed:
                self._mine.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._changed:
            if str(p.runId) not in self._mine:
                return
            state = p.stateOperators
            self._rows.append((
                str(p.id), str(p.runId), p.name, p.batchId, p.timestamp, p.numInputRows, float(p.processedRowsPerSecond),
                sum(s.numRowsTotal for s in state), sum(s.memoryUsedBytes for s in state),
                sum(s.numRowsDroppedByWatermark for s in state), p.eventTime.get("watermark")))
            if len(self._rows) >= self._every:
                self._flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            if str(event.runId) in self._mine:
                self._flush()
                self._ended[str(event.runId)] = event.exception
                self._changed.notify_all()

    def _flush(self) -> None:
        if self._rows:
            self._spark.createDataFrame(self._rows, ROWS).coalesce(1).write.mode("append").parquet(self._path)
            self._rows = []

    def wait(self, run_id: str, seconds: float = 60) -> bool:
        """Whether all rows of an ended query are written; events come after ``awaitTermination`` returns."""
        with self._changed:
            return self._changed.wait_for(lambda: str(run_id) in self._ended, seconds)

    def read(self) -> DataFrame:
        return table(self._spark, self._path, ROWS)
