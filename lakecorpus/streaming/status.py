"""Status and control of streams: progress as files that anyone may read, commands as a file that the stream takes between two batches.

In a folder: ``status.json``, the latest; ``history.jsonl``, the newest progress rows; ``control.json``, commands that wait. Reports are best effort: a store that fails delays
them, but stops no stream.
"""

from __future__ import annotations

import json
import math
import threading
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from lakecorpus.sources import store

COMMANDS = ("save", "eval", "stop")


def plain(value):
    """A value as JSON has it: what isn't finite is null, what isn't known is text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if value is None or isinstance(value, (str, int, bool)) else str(value)


def _quietly(f: Callable) -> bool:
    try:
        f()
        return True
    except Exception:  # noqa: BLE001 - a report must not end what it reports on
        return False


class ProgressLog(StreamingQueryListener):
    """Writes the progress of all streams of a session, or of those of a name, to ``folder``; the last ``keep`` rows of history stay, also of runs before."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2048, about: dict | None = None, name: str | None = None):
        if keep <= 0:
            raise ValueError("at least one row of history must stay")
        self.spark, self.folder, self.about, self.name, self.started = spark, folder, about or {}, name, time.time()
        self.rows: deque[str] = deque(maxlen=keep)
        _quietly(lambda: self.rows.extend(history_lines(spark, folder)))
        self.last: dict = {}
        self._names: dict[str, str | None] = {}
        self._ended: dict[str, str] = {}  # runs that are over, as their last progress may come later
        self.report("starting")

    def report(self, state: str, **facts) -> None:
        now = time.time()
        status = {"state": state, **self.last, "about": self.about, "started_at": self.started, "updated_at": now, "elapsed_s": now - self.started, **facts}
        _quietly(lambda: store.write_whole(self.spark, f"{self.folder}/status.json", json.dumps(plain(status))))

    def _mine(self, query_id, name: str | None = None) -> bool:
        return self.name is None or self._names.setdefault(str(query_id), name) == self.name

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if self._mine(event.id, event.name):
            self.report("running")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if not self._mine(p.id, p.name):
            return
        self.last = plain({"batch": p.batchId, "query": str(p.id), "name": p.name, "input_rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "durations_ms": dict(p.durationMs)})
        self.rows.append(json.dumps({"t": time.time(), **self.last}))
        self.report(self._ended.get(str(p.runId), "running"))
        _quietly(lambda: store.write_whole(self.spark, f"{self.folder}/history.jsonl", "".join(r + "\n" for r in self.rows)))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if self._mine(event.id):
            self._ended[str(event.runId)] = state = "failed" if event.exception else "finished"
            self.report(state, error=event.exception)


def history_lines(spark: SparkSession, folder: str) -> list[str]:
    path = f"{folder}/history.jsonl"
    return store.read(spark, path, 1 << 30).decode().splitlines() if store.exists(spark, path) else []


def read_history(spark: SparkSession, folder: str, last: int | None = None) -> list[dict]:
    """The newest rows of history; lines that are broken are left out."""
    out = []
    for line in history_lines(spark, folder):
        try:
            out.append(json.loads(line))
        except ValueError:
            continue
    return out[-last:] if last else out


def read_status(spark: SparkSession, folder: str) -> dict | None:
    try:
        return json.loads(store.read(spark, f"{folder}/status.json", 1 << 24))
    except Exception:  # noqa: BLE001 - not there, or not whole
        return None


def _waiting(spark: SparkSession, folder: str) -> list[str]:
    """Commands that wait, each once; unknown ones and a broken file count as none."""
    path = f"{folder}/control.json"
    try:
        commands = json.loads(store.read(spark, path, 1 << 20)).get("commands", []) if store.exists(spark, path) else []
    except Exception:  # noqa: BLE001
        return []
    return list(dict.fromkeys(c for c in commands if c in COMMANDS)) if isinstance(commands, list) else []


def request(spark: SparkSession, folder: str, *commands: str) -> None:
    """Adds commands to those that wait."""
    if unknown := [c for c in commands if c not in COMMANDS]:
        raise ValueError(f"unknown commands {unknown}; there are {COMMANDS}")
    all_ = list(dict.fromkeys([*_waiting(spark, folder), *commands]))
    store.write_whole(spark, f"{folder}/control.json", json.dumps({"commands": all_}))


def take_commands(spark: SparkSession, folder: str) -> list[str]:
    """The commands that wait; they are gone then."""
    commands = _waiting(spark, folder)
    _quietly(lambda: store.delete(spark, f"{folder}/control.json"))
    return commands


class Control:
    """Lets a stream of ``foreachBatch`` take commands after each batch: ``on`` has what to do with those other than stop."""

    def __init__(self, spark: SparkSession, folder: str, on: dict[str, Callable[[int], None]] | None = None):
        self.spark, self.folder, self.on = spark, folder, on or {}
        self.stopping, self.stopped = threading.Event(), threading.Event()
        self.last = -1

    def wrap(self, batch: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        def run(df: DataFrame, number: int) -> None:
            if self.stopping.is_set():  # the batch before was the last: this one is left to the next run
                self.stopped.wait(60)
                raise InterruptedError("stopped between batches")
            batch(df, number)
            for c in take_commands(self.spark, self.folder):
                if c == "stop":
                    self.last = number
                    self.stopping.set()
                elif c in self.on:
                    self.on[c](number)

        return run

    def wait(self, query: StreamingQuery, every: float = 0.2) -> bool:
        """Waits for the end of the stream; True if a command ended it, after the batch in which it was taken is committed."""
        while query.isActive:
            if self.stopping.is_set() and any(p.batchId >= self.last for p in query.recentProgress):
                query.stop()
                self.stopped.set()
                return True
            query.awaitTermination(every)
        return self.stopping.is_set()
