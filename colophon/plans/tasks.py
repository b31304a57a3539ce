"""Scans as tasks: one at a time, with progress, cancellation and the pointer to the last result."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from colophon.functions.metadata import DEFAULT_THRESHOLD, LEAST_THRESHOLD, normalize_threshold
from colophon.operators.groups import RULES, index_preview, report_summary
from colophon.plans.scan import Scan, run_scan
from colophon.sources.catalog import load_records, read_report, write_latest, write_report

#: Fixed value: the most records that a scan may be asked for.
MAX_BOOKS = 10_000_000
#: The steps of a scan and the share of it, in percent, that is done when each ends.
STEPS = {"loaded": 5, "records": 15, "pairs": 70, "members": 85, "report": 95, "index": 98}


class Refused(ValueError):
    """A request that breaks a rule; its text is the rule's code."""


class Cancelled(Exception):
    """A scan was told to stop between two of its steps."""


def scope(records: DataFrame) -> dict:
    """What a scan may be asked for: the number of records and the limits."""
    total = records.count()
    return {"total_books": total, "max_books": MAX_BOOKS, "threshold": DEFAULT_THRESHOLD, "threshold_range": [LEAST_THRESHOLD, 1.0], "confidence": ["strong", "likely", "weak"], "keep_rules": list(RULES)}


@dataclass
class Task:
    task_id: str
    threshold: float
    status: str = "queued"
    error: str | None = None
    scan: Scan | None = None
    summary: dict = field(default_factory=dict)
    thread: threading.Thread | None = None
    #: The step that ended last, percent done, and rows counted so far by step.
    phase: str = "queued"
    progress: int = 0
    seen: dict = field(default_factory=dict)


class Tasks:
    """Starts scans of a raw catalog in the background; their reports and the pointer to the newest go to `home`."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home, self.last = spark, home, None
        self._one = threading.Lock()

    def running(self) -> bool:
        """A scan that is cancelling counts until it has ended: no second one starts beside it."""
        return self.last is not None and self.last.status in ("queued", "running", "cancelling")

    def start(self, raw: DataFrame, ids: list[int] | None = None, threshold: object = None, ignored: DataFrame | None = None) -> Task:
        """Starts a scan of all records, or of those with the ids; returns at once."""
        if ids is not None and any(isinstance(i, bool) or not isinstance(i, int) for i in ids):
            raise Refused("params.invalid")
        if ids is not None and len(ids) > MAX_BOOKS:
            raise Refused("scope.too_large")
        chosen = self.spark.createDataFrame([(i,) for i in ids], "id long") if ids else None
        with self._one:
            if self.running():
                raise Refused("task.running")
            task = self.last = Task(uuid.uuid4().hex, normalize_threshold(threshold))
        task.thread = InheritableThread(target=self._run, args=(task, raw, chosen, ignored), daemon=True)
        task.thread.start()
        return task

    def _run(self, task: Task, raw: DataFrame, chosen: DataFrame | None, ignored: DataFrame | None) -> None:
        self.spark.addTag(task.task_id)

        def step(name: str, rows: int | None = None) -> None:
            """A step has ended; one that was cancelled meanwhile goes no further, whether a job of it ran or not."""
            task.phase, task.progress = name, STEPS[name]
            if rows is not None:
                task.seen[name] = rows
            if task.status == "cancelling":
                raise Cancelled

        try:
            with self._one:
                task.status = "running" if task.status == "queued" else task.status
            records = load_records(raw, chosen)
            if records.isEmpty():
                raise Refused("scope.empty")
            step("loaded")
            task.scan = run_scan(records, task.threshold, ignored, step=step)
            path = f"{self.home}/{task.task_id}"
            write_report(task.scan.report, f"{path}/report")
            step("report")
            report = read_report(self.spark, f"{path}/report")
            write_report(index_preview(report), f"{path}/index")
            step("index")
            task.summary = report_summary(report, task.scan.stats()).first().asDict()
            with self._one:  # from here on it can't be cancelled
                if task.status == "cancelling":
                    raise Cancelled
                write_latest(self.spark, f"{self.home}/latest", task.task_id, str(task.threshold), path, task.summary["group_count"])
                task.status, task.phase, task.progress = "completed", "done", 100
        except Exception as e:  # the task's own record of how it ended
            with self._one:
                task.error = None if isinstance(e, Cancelled) else str(e)
                task.status = "cancelled" if task.status == "cancelling" else "failed"
        finally:
            self.spark.removeTag(task.task_id)

    def cancel(self) -> None:
        """Stops the scan: its running jobs now, and else before its next step."""
        with self._one:
            if not self.running():
                raise Refused("task.not_found")
            self.last.status = "cancelling"
        self.spark.interruptTag(self.last.task_id)

    def _within(self) -> float:
        """The share of the running jobs' tasks that have ended."""
        tracker = self.spark.sparkContext.statusTracker()
        done = total = 0
        for job in tracker.getActiveJobsIds():
            for stage in getattr(tracker.getJobInfo(job), "stageIds", ()):
                info = tracker.getStageInfo(stage)
                done, total = done + getattr(info, "numCompletedTasks", 0), total + getattr(info, "numTasks", 0)
        return done / total if total else 0.0

    def progress(self) -> dict:
        """Status of the last task; without one, the last report that was written, as restored.

        progress: percent by the steps that have ended, and inside a step by the tasks of its running jobs.
        """
        if self.last is not None:
            task = self.last
            done = task.progress
            if task.status in ("running", "cancelling"):
                after = min((p for p in STEPS.values() if p > done), default=99)
                done += int((after - done - 1) * self._within())
            data = {"phase": task.phase, **task.seen}
            return {"status": task.status, "progress": done, "progress_data": data, "task_id": task.task_id, "error": task.error, "summary": task.summary, "restored": False}
        try:
            marker = self.spark.read.json(f"{self.home}/latest").first()
        except Exception:  # no report was written yet
            marker = None
        if marker is None:
            raise Refused("task.not_found")
        return {"status": "completed", "progress": 100, "task_id": marker["task_id"], "error": None, "summary": {"group_count": marker["group_count"]}, "restored": True}
