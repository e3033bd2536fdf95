"""What runs around streams on the driver: a bounded queue, a breaker around calls that may fail, timers, health and metrics."""

from __future__ import annotations

import queue
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Full(RuntimeError):
    """The queue takes no more."""


class IngestQueue:
    """At most ``capacity`` tasks wait; ``submit`` refuses more, ``drain`` gives all that wait to a worker as one batch."""

    def __init__(self, capacity: int = 200):
        self._tasks: queue.Queue = queue.Queue(capacity)
        self.capacity = capacity
        self.closed = False

    def __len__(self) -> int:
        return self._tasks.qsize()

    def submit(self, task: dict) -> None:
        if self.closed:
            raise Full("the queue is closed")
        try:
            self._tasks.put_nowait(task)
        except queue.Full:
            raise Full(f"{self.capacity} tasks wait") from None

    def drain(self, work: Callable[[list[dict]], None]) -> int:
        """Calls ``work`` with all waiting tasks; on an error they wait again, in their order."""
        tasks = []
        while not self._tasks.empty():
            tasks.append(self._tasks.get_nowait())
        if tasks:
            try:
                work(tasks)
            except Exception:
                for t in tasks:
                    self._tasks.put_nowait(t)
                raise
        return len(tasks)

    def shutdown(self, work: Callable[[list[dict]], None]) -> int:
        """Takes no more, and works off what waits."""
        self.closed = True
        return self.drain(work)


class Open(RuntimeError):
    """The breaker lets no call through."""


@dataclass
class CircuitBreaker:
    """After ``failures`` errors in a row no call goes through for ``pause`` seconds; then one is tried, and its success closes the breaker."""

    failures: int = 5
    pause: float = 60.0
    clock: Callable[[], float] = time.monotonic
    _errors: int = 0
    _until: float | None = None

    @property
    def state(self) -> str:
        if self._until is None:
            return "closed"
        return "open" if self.clock() < self._until else "half-open"

    def call(self, work: Callable, *args):
        if self.state == "open":
            raise Open("too many failures")
        try:
            out = work(*args)
        except Exception:
            self._errors += 1
            if self._errors >= self.failures or self._until is not None:
                self._until = self.clock() + self.pause
            raise
        self._errors, self._until = 0, None
        return out


@dataclass
class Health:
    """How a worker does: an exponential mean of its latency, and a word for its state."""

    stalled_after: float = 300.0
    clock: Callable[[], float] = time.monotonic
    latency_ms: float = 0.0
    last: float | None = None
    done: int = 0
    failed: int = 0

    def success(self, latency_ms: float) -> None:
        self.latency_ms = 0.1 * latency_ms + 0.9 * self.latency_ms
        self.last, self.done = self.clock(), self.done + 1

    def failure(self) -> None:
        self.failed += 1

    def status(self, waiting: int, capacity: int, breaker: CircuitBreaker | None = None) -> str:
        """degraded (the breaker is open), stalled, backpressured or healthy, the first that holds."""
        if breaker is not None and breaker.state == "open":
            return "degraded"
        if waiting and self.last is not None and self.clock() - self.last > self.stalled_after:
            return "stalled"
        return "backpressured" if capacity and waiting > 0.8 * capacity else "healthy"


@dataclass
class Sweeps:
    """Which jobs are due: every job runs once in so many cycles, or when so many seconds have passed and something waits."""

    every: dict[str, int]
    seconds: float = 900.0
    clock: Callable[[], float] = time.monotonic
    _cycles: int = 0
    _last: dict[str, float] = field(default_factory=dict)

    def cycle(self) -> list[str]:
        """Counts a cycle; the jobs due after it, in their order."""
        self._cycles += 1
        return [name for name, n in self.every.items() if n > 0 and self._cycles % n == 0]

    def timer(self, waiting: dict[str, int]) -> list[str]:
        """The keys with something waiting whose last run is longer ago than ``seconds``; they count as run."""
        now = self.clock()
        due = sorted(k for k, n in waiting.items() if n > 0 and now - self._last.get(k, float("-inf")) >= self.seconds)
        self._last.update(dict.fromkeys(due, now))
        return due


def batch_metrics(rows: DataFrame, at: str, failed: str | None = None) -> DataFrame:
    """One row: rows, failures, first and last time of a batch, as a sink writes them beside it."""
    bad = F.count_if(F.coalesce(F.col(failed), F.lit(False))) if failed else F.lit(0).cast("long")
    return rows.agg(F.count("*").alias("rows"), bad.alias("failures"), F.min(at).alias("first"), F.max(at).alias("last"))


def stop_all(spark: SparkSession, timeout: float = 60.0) -> list[str]:
    """Lets every stream of the session finish what it has, then stops it; the names of those that were running."""
    names = []
    for q in spark.streams.active:
        names.append(q.name or q.id)
        q.processAllAvailable()
        q.stop()
        q.awaitTermination(timeout)
    return names
