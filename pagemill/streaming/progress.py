"""What a running stream says about itself: running, done or failed, and how far it came."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class RunState:
    """One run of a stream, as its events tell it; ``message`` is the error of a failed run."""

    status: str = "indexing"
    batch: int = -1
    rows: int = 0
    message: str = ""


class RunListener(StreamingQueryListener):
    """Follows the queries whose name is ``name``.

    Events come on a thread of their own and after the fact: ``ended`` waits for the last one.
    """

    def __init__(self, name: str) -> None:
        self.name = name
        self.state: RunState | None = None
        self._run: str | None = None
        self._over = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._over.clear()
            self._run, self.state = str(event.runId), RunState()

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if self.state is None or str(progress.runId) != self._run:
            return
        if progress.numInputRows:
            self.state.batch = max(self.state.batch, progress.batchId)
            self.state.rows += progress.numInputRows

    def onQueryIdle(self, event) -> None:
        """Waiting for files is running."""

    def onQueryTerminated(self, event) -> None:
        if self.state is None or str(event.runId) != self._run:
            return
        failed = event.exception is not None
        self.state.status, self.state.message = ("error", str(event.exception)) if failed else ("done", "")
        self._over.set()

    def ended(self, seconds: float = 30.0) -> RunState | None:
        """The state after the run's last event, waited for at most so long."""
        self._over.wait(seconds)
        return self.state
