"""Time limits: run an action as a job group and cancel the group when its time is over."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import SparkSession

R = TypeVar("R")


class OutOfTime(TimeoutError):
    pass


def within(spark: SparkSession, seconds: float, action: Callable[[], R]) -> R:
    """The action's result, or OutOfTime after its Spark jobs were cancelled."""
    group, result, error = uuid.uuid4().hex, [], []

    def work() -> None:
        spark.sparkContext.setJobGroup(group, "time-limited action", interruptOnCancel=True)
        try:
            result.append(action())
        except Exception as e:  # handed to the caller below
            error.append(e)

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        stop = threading.Event()
        while thread.is_alive() and not stop.wait(0.1):  # a job may start between two cancellations
            spark.sparkContext.cancelJobGroup(group)
            thread.join(0.5)
        raise OutOfTime(f"more than {seconds} s")
    if error:
        raise error[0]
    return result[0]
