"""The one checkpointed ingest query and its progress."""

import threading
import time

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from booklog.config import Ingest
from booklog.sinks.batch import write_batch


def start_query(records: DataFrame, ingest: Ingest) -> StreamingQuery:
    """Route every micro-batch of broker records to the datasets.

    Checkpointed offsets give a batch the same id and rows on every retry, and outputs are
    replaced per id, so each record counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, ingest.store)

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", ingest.checkpoint)
    if ingest.every is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=ingest.every).start()


class RowCount(StreamingQueryListener):
    """Input rows of one query, counted as its batches end.

    Register it with ``spark.streams.addListener`` before the query starts; the first query
    that starts then is the one it counts. The history of a query forgets old batches, while
    this keeps a sum, so it is complete however many there are. A batch reports in order and
    perhaps repeatedly; its last report counts.
    """

    def __init__(self) -> None:
        self._run_id, self._batch, self._rows, self._before = None, -1, 0, 0
        self._ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        self._run_id = self._run_id or event.runId

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        # An idle trigger repeats the id of the coming batch with no rows.
        if progress.runId != self._run_id or not progress.numInputRows:
            return
        if progress.batchId != self._batch:
            self._before += self._rows
        self._batch, self._rows = progress.batchId, progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self._run_id:
            self._ended.set()

    def total(self, timeout: float = 60.0) -> int:
        """Rows of all batches, once the query has ended; reports arrive a little later."""
        if not self._ended.wait(timeout):
            raise TimeoutError("the query has not reported its end")
        return self._before + self._rows


def rows_seen(progress: list) -> int:
    """Input rows over distinct batches; a batch may report its progress repeatedly."""
    return sum(_rows_by_batch(progress).values())


def _rows_by_batch(progress: list) -> dict[int, int]:
    """An idle trigger repeats the id of the coming batch with no rows; it does not count."""
    counted = ((int(entry["batchId"]), int(entry["numInputRows"])) for entry in progress)
    return {batch: rows for batch, rows in counted if rows}


def await_rows(query: StreamingQuery, expected: int, timeout: float = 180.0) -> int:
    """Wait until the query has read ``expected`` rows, then stop it."""
    deadline = time.monotonic() + timeout
    seen: dict[int, int] = {}
    try:
        while time.monotonic() < deadline:
            if query.exception() is not None:
                raise RuntimeError(str(query.exception()))
            # Progress is a bounded history, so it is folded into what was seen before.
            seen |= _rows_by_batch(query.recentProgress)
            if sum(seen.values()) >= expected:
                return sum(seen.values())
            time.sleep(0.2)
        raise TimeoutError(f"query saw {sum(seen.values())} of {expected} rows")
    finally:
        query.stop()
