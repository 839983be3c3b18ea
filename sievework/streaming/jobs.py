"""One background job at a time: steps of Spark work under a job tag, with progress, cancelling and a fence."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

#: What may follow a state; the last three end a job.
NEXT = {"idle": {"running"}, "running": {"cancelling", "complete", "failed"}, "cancelling": {"cancelled", "failed"}, "complete": {"running"}, "failed": {"running"}, "cancelled": {"running"}}


class Busy(RuntimeError):
    """Another job is under way."""


@dataclass(frozen=True)
class Progress:
    """job is its tag; done of total steps are through; error is the message of a failed job."""

    job: str = ""
    name: str = ""
    state: str = "idle"
    done: int = 0
    total: int = 0
    error: str = ""


class Jobs:
    """Runs jobs of a session one after the other, each in a thread of its own.

    A job is a sequence of steps (a chunk each, say), called with a function that tells whether the job still holds. Between
    steps, and in Spark stages under way, cancelling takes effect: the job's tag is cancelled and no further step begins.
    A job that has been cancelled can't report anything any more, so a late step doesn't disturb the next job.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._lock, self._now, self._thread = spark, threading.Lock(), Progress(), None

    def progress(self) -> Progress:
        with self._lock:
            return self._now

    def _move(self, job: str, state: str, **facts) -> bool:
        """To another state of the job, if it is still the one under way and the state may follow."""
        with self._lock:
            if self._now.job != job or state not in NEXT[self._now.state] | {self._now.state}:
                return False
            self._now = replace(self._now, state=state, **facts)
            return True

    def start(self, name: str, steps: Sequence[Callable[[Callable[[], bool]], None]]) -> str:
        """Begin a job and return its tag; Busy where one is under way."""
        job = f"sievework-{uuid.uuid4().hex}"
        with self._lock:
            if "running" not in NEXT[self._now.state]:
                raise Busy(self._now.name)
            self._now = Progress(job, name, "running", 0, len(steps))
        holds = lambda: self.progress().job == job and self.progress().state == "running"

        def run() -> None:
            context = self._spark.sparkContext
            context.addJobTag(job)
            try:
                for n, step in enumerate(steps, 1):
                    if not holds():
                        break
                    step(holds)
                    if holds():
                        self._move(job, "running", done=n)
                self._move(job, "complete") or self._move(job, "cancelled")
            except Exception as e:  # noqa: BLE001 - told to whoever asks for progress
                stopped = self.progress().state == "cancelling"
                self._move(job, "cancelled" if stopped else "failed", error="" if stopped else str(e)[:500])
            finally:
                context.removeJobTag(job)

        self._thread = threading.Thread(target=inheritable_thread_target(self._spark)(run), name=job, daemon=True)
        self._thread.start()
        return job

    def cancel(self, job: str) -> bool:
        """Stop a job: True where it was under way."""
        if self.progress().job != job or not self._move(job, "cancelling"):
            return False
        self._spark.sparkContext.cancelJobsWithTag(job)
        return True

    def wait(self, seconds: float | None = None) -> Progress:
        if self._thread is not None:
            self._thread.join(seconds)
        return self.progress()
