"""Running a job by a schedule: at each time that it names, with one retry."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

from lumenfold.sources.ingest import next_fire

RETRY_SECONDS = 60.0


@dataclass(frozen=True)
class Run:
    """What became of one time: ok, retried (ok at the second try) or failed, with the last error."""

    due: datetime
    status: str
    error: str = ""


def run_once(job: Callable[[], object], due: datetime, wait: Callable[[float], None] = time.sleep) -> Run:
    """The job, tried again once after RETRY_SECONDS; then it has failed."""
    try:
        job()
        return Run(due, "ok")
    except Exception:  # noqa: BLE001 - whatever a job raises is an outcome here
        wait(RETRY_SECONDS)
    try:
        job()
        return Run(due, "retried")
    except Exception as e:  # noqa: BLE001
        return Run(due, "failed", f"{type(e).__name__}: {e}")


def run_by(schedule: str, job: Callable[[], object], now: Callable[[], datetime] = datetime.now, wait: Callable[[float], None] = time.sleep) -> Iterator[Run]:
    """Runs without end, one for each time of the schedule. Times that pass while a job runs are left out; a failed run doesn't end the loop."""
    while True:
        due = next_fire(schedule, now())
        wait(max(0.0, (due - now()).total_seconds()))
        yield run_once(job, due, wait)
