"""Progress of streams, for whoever shows it. Survey: ST8."""

from __future__ import annotations

from collections import deque

from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener


class Progress(StreamingQueryListener):
    """Keeps the last events of all streams of a session: add it with spark.streams.addListener.

    Events are dicts: event (started, progress, failed or finished), id, name and, for progress, batch and rows.
    """

    def __init__(self, most: int = 1000):
        self.events: deque[dict] = deque(maxlen=most)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.events.append({"event": "started", "id": str(event.id), "name": event.name})

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        self.events.append({"event": "progress", "id": str(p.id), "name": p.name, "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.events.append({"event": "failed" if event.exception else "finished", "id": str(event.id), "name": None})
