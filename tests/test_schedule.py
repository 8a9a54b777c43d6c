"""The scheduler, by a clock of its own."""

from datetime import datetime, timedelta
from itertools import islice

from lumenfold.streaming.schedule import run_by, run_once


class Clock:
    def __init__(self):
        self.at, self.waits = datetime(2026, 1, 1, 8, 59), []

    def now(self):
        return self.at

    def wait(self, seconds):
        self.waits.append(seconds)
        self.at += timedelta(seconds=seconds)


def failing(times):
    left = [times]

    def job():
        left[0] -= 1
        if left[0] >= 0:
            raise ValueError("no")

    return job


def test_one_retry():
    clock = Clock()
    assert [run_once(failing(n), clock.at, clock.wait).status for n in (0, 1, 2)] == ["ok", "retried", "failed"]
    assert clock.waits == [60.0, 60.0] and run_once(failing(2), clock.at, clock.wait).error == "ValueError: no"


def test_the_loop_goes_on():
    clock = Clock()
    runs = list(islice(run_by("0 * * * *", failing(2), clock.now, clock.wait), 3))
    assert [(r.due.hour, r.status) for r in runs] == [(9, "failed"), (10, "ok"), (11, "ok")]


def test_times_that_pass_while_a_job_runs_are_left_out():
    clock = Clock()
    runs = list(islice(run_by("*/10 * * * *", lambda: clock.wait(1500), clock.now, clock.wait), 2))
    assert [r.due.strftime("%H:%M") for r in runs] == ["09:00", "09:30"]
