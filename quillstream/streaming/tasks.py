"""Reports of a task's progress, one sidecar a task, and a listener that reports streaming queries."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import subprocess
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

from ..functions.text import JSON_PAIRS, LINE_METRICS, RATIOS
from ..sources.jsonl import write_json

#: The folder of sidecars, unless a caller names one.
FOLDER = "PROGRESS_STATE_DIR"


def state_folder(folder: str | None = None) -> str:
    return folder or os.environ.get(FOLDER) or os.path.join(os.path.expanduser("~"), ".progress")


def alive(pid: int) -> bool:
    """Whether a process of this host is there."""
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


class Task:
    """A task that reports its state: update(), then finish() or fail(); as a context manager it does the latter by itself.

    Each report replaces the task's sidecar whole. ``clock`` gives seconds.
    """

    def __init__(self, name: str, total: float | None = None, unit: str = "items", task_id: str | None = None, folder: str | None = None, clock: Callable[[], float] = time.time) -> None:
        self.clock, self.began = clock, clock()
        made = re.sub(r"[^A-Za-z0-9_.-]+", "-", task_id or f"{name}-{os.getpid()}").strip("-.") or "task"
        self.path = os.path.join(state_folder(folder), made[:80] + ".json")
        self.state = {"id": made[:80], "name": name, "pid": os.getpid(), "status": "running", "current": 0.0, "total": total, "unit": unit, "message": "", "metrics": {}, "started_at": self._iso(self.began)}
        self._report()

    @staticmethod
    def _iso(at: float) -> str:
        return dt.datetime.fromtimestamp(at, dt.UTC).isoformat()

    def _report(self) -> None:
        now, current, total = self.clock(), self.state["current"], self.state["total"]
        share = max(0.0, min(100.0, 100 * current / total)) if total else None
        left = None if not total or current <= 0 and current < total else 0.0 if current >= total else (now - self.began) * (total - current) / current
        write_json(self.state | {"percent": share, "eta_seconds": left, "elapsed_seconds": now - self.began, "updated_at": self._iso(now)}, self.path)

    def update(self, current: float | None = None, message: str | None = None, metrics: dict | None = None, total: float | None = None) -> None:
        for k, v in (("current", current), ("message", message), ("total", total)):
            if v is not None:
                self.state[k] = v
        self.state["metrics"] = self.state["metrics"] | (metrics or {})
        self._report()

    def finish(self, message: str = "complete") -> None:
        self.state |= {"status": "complete", "message": message, "current": self.state["total"] or self.state["current"]}
        self._report()

    def fail(self, message: str) -> None:
        self.state |= {"status": "failed", "message": message}
        self._report()

    def __enter__(self) -> Task:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: object) -> None:
        if error is not None:
            self.fail(f"{kind.__name__}: {error}")
        elif self.state["status"] == "running":
            self.finish()


def read_line(line: str) -> tuple[float, float] | None:
    """What parse_progress() of functions.text says of one line, for lines that are read on the driver."""
    text = re.sub(r"\x1b\[[0-?]*[ -/]*[@-~]", "", line).strip()
    said = _object(text)
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    for a, b in JSON_PAIRS:
        if number(said.get(a)) and number(said.get(b)) and said[b] > 0:
            return float(said[a]), float(said[b])
    for pattern in RATIOS:
        m = re.search(pattern, text)
        if m and float(m[2]) > 0:
            return float(m[1]), float(m[2])
    m = re.search(r"(?:^|[^\d.])(100|\d{1,2})(?:\.\d+)?\s*%", text)
    return (float(m[1]), 100.0) if m else None


def _object(text: str) -> dict:
    try:
        value = json.loads(text)
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def run_tracked(command: list[str], name: str, folder: str | None = None, task_id: str | None = None, tail: int = 30) -> tuple[int, list[str]]:
    """Run a command, report what its output says about progress, and return its exit code and last lines."""
    last: deque[str] = deque(maxlen=tail)
    task = Task(name, folder=folder, task_id=task_id)
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, errors="replace") as child:
        for line in child.stdout:
            last.append(line.rstrip("\n"))
            at = read_line(line)
            metrics = {k: v for k, v in _object(line).items() if k in LINE_METRICS and isinstance(v, (int, float)) and not isinstance(v, bool)}
            task.update(*(at[:1] if at else ()), message=last[-1][:300], metrics=metrics, total=at[1] if at else None)
    if child.returncode:
        task.fail(f"exit code {child.returncode}: " + " | ".join(list(last)[-3:]))
    else:
        task.finish()
    return child.returncode, list(last)


class QueryReports(StreamingQueryListener):
    """Reports each streaming query's rows and state as a task; spark.streams.addListener(QueryReports(...))."""

    def __init__(self, folder: str | None = None) -> None:
        self.folder, self.tasks = folder, {}

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        self.tasks[str(event.runId)] = Task(event.name or "streaming query", unit="rows", task_id=f"query-{event.runId}", folder=self.folder)

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        p = event.progress
        task = self.tasks.get(str(p.runId))
        if task:
            task.update(task.state["current"] + p.numInputRows, f"batch {p.batchId}")

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        """Nothing to report."""

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        task = self.tasks.pop(str(event.runId), None)
        if task:
            task.fail(str(event.exception)[:300]) if event.exception else task.finish()
