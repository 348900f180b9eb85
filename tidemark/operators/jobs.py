"""Long-running work on the driver: state, log lines, progress and cancelling by Spark's job tags."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


class Cancelled(Exception):
    """Raised inside a job that was asked to stop."""


@dataclass
class Job:
    kind: str
    id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    state: str = "queued"
    done: int = 0
    total: int = 0
    result: object = None
    error: str | None = None
    logs: list[str] = field(default_factory=list)
    stop: threading.Event = field(default_factory=threading.Event)

    def log(self, line: str) -> None:
        self.logs.append(f"{time.strftime('%H:%M:%S', time.gmtime())} {line}")

    def step(self, done: int, total: int) -> None:
        """Report progress; between steps is where a cancelled job ends."""
        self.done, self.total = done, total
        if self.stop.is_set():
            raise Cancelled


class Jobs:
    """Registry of one driver. Every job's Spark work carries its tag, so cancelling stops its running stages too."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.jobs, self.lock = spark, {}, threading.Lock()

    def start(self, kind: str, work: Callable[[Job], object]) -> Job:
        job = Job(kind)
        with self.lock:
            self.jobs[job.id] = job

        def run() -> None:
            job.state = "running"
            self.spark.addTag(f"tidemark-{job.id}")
            try:
                job.result = work(job)
                job.state = "done"
            except Cancelled:
                job.state = "cancelled"
            except Exception as e:  # reported to whoever asks
                job.state = "cancelled" if job.stop.is_set() else "failed"
                job.error = f"{type(e).__name__}: {e}"[:500]
            finally:
                self.spark.removeTag(f"tidemark-{job.id}")

        job.thread = threading.Thread(target=run, daemon=True)
        job.thread.start()
        return job

    def cancel(self, job_id: str) -> bool:
        """Ask a job to stop; False for an unknown or ended one."""
        job = self.jobs.get(job_id)
        if job is None or job.state not in ("queued", "running"):
            return False
        job.stop.set()
        self.spark.interruptTag(f"tidemark-{job_id}")
        return True

    def get(self, job_id: str) -> Job | None:
        return self.jobs.get(job_id)


def until_stalled(remaining: Callable[[], int], work: Callable[[], None], rounds: int = 25, patience: int = 2) -> int:
    """Repeat ``work`` until nothing remains, at most ``rounds`` times, or ``patience`` rounds in a row have not lowered what remains."""
    left, stalled = remaining(), 0
    for _ in range(rounds):
        if not left or stalled >= patience:
            break
        work()
        now = remaining()
        stalled = stalled + 1 if now >= left else 0
        left = now
    return left
