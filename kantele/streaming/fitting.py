"""A run fed by the micro-batches of a streaming query, and a run in the background."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import checks
from ..plans.engine import Progress, Result, Steps


class StreamedFit:
    """Target of ``writeStream.foreachBatch``: each micro-batch is the data of the next iteration.

    ``begin`` makes the generator from the first batch; later ones are sent to it.
    Empty batches are passed over, and so is a batch that was seen before, so that a
    batch repeated after a failure counts once. After the run's end batches are
    ignored. ``progress`` is the last iteration's.
    """

    def __init__(self, begin: Callable[[DataFrame], Steps], on_progress: Callable[[Progress], None] | None = None):
        self.begin, self.on_progress = begin, on_progress
        self.steps: Steps | None = None
        self.progress: Progress | None = None
        self.ended: Result | None = None
        self.last_batch = -1

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.ended is not None or batch_id <= self.last_batch or batch.isEmpty():
            return
        try:
            if self.steps is None:
                self.steps = self.begin(batch)
                self.progress = next(self.steps)
            else:
                self.progress = self.steps.send(batch)
            if self.on_progress:
                self.on_progress(self.progress)
        except StopIteration as end:
            self.ended = end.value
        self.last_batch = batch_id

    def result(self) -> Result | None:
        """What the run has reached so far."""
        return self.ended or (self.progress.result() if self.progress else None)


class BackgroundRun:
    """A generator run on a thread of its own, under a job group that cancel() stops.

    ``signal`` is an event that ends the run when it is set, and may be shared by
    several runs. After ``seconds`` the run ends at its current iteration, with what it
    has reached as its result. ``reason`` is None while it goes on, then finished,
    budget, cancelled or failed; ``progress`` is the last iteration's.
    """

    def __init__(
        self, spark: SparkSession, steps: Steps, on_progress: Callable[[Progress], None] | None = None, group: str = "kantele",
        seconds: float | None = None, signal: threading.Event | None = None,
    ):
        self.spark, self.steps, self.on_progress, self.group = spark, steps, on_progress, group
        self.seconds = None if seconds is None else checks.number(seconds, "seconds", 0.0, above=True)
        self.value: Result | None = None
        self.error: BaseException | None = None
        self.progress: Progress | None = None
        self.reason: str | None = None
        self._stop = threading.Event() if signal is None else signal
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._watch = threading.Thread(target=self._watched, daemon=True)
        self._thread.start()
        self._watch.start()

    def _run(self) -> None:
        self.spark.sparkContext.setJobGroup(self.group, "iterations", interruptOnCancel=True)
        began = time.monotonic()
        try:
            while not self._stop.is_set():
                self.progress = next(self.steps)
                if self.on_progress:
                    self.on_progress(self.progress)
                if self.seconds is not None and time.monotonic() - began >= self.seconds:
                    self.value, self.reason = self.progress.result(), "budget"
                    self.steps.close()
                    return
            self.reason = "cancelled"
        except StopIteration as end:
            self.value, self.reason = end.value, "finished"
        except BaseException as error:  # handed to result()
            self.error, self.reason = error, "cancelled" if self._stop.is_set() else "failed"

    def _watched(self) -> None:
        """Stops the jobs of the current iteration when the signal comes."""
        while self._thread.is_alive():
            if self._stop.wait(0.1):
                self.spark.sparkContext.cancelJobGroup(self.group)
                return

    def cancel(self) -> None:
        """Ends the run, and others of its signal, after, or within, the current iteration."""
        self._stop.set()
        self.spark.sparkContext.cancelJobGroup(self.group)

    def result(self, timeout: float | None = None) -> Result | None:
        """The run's result; None if it was cancelled or is still going."""
        self._thread.join(timeout)
        if self.reason == "failed":
            raise self.error
        return self.value
