"""Stages of a chain of jobs: side by side where they need nothing of each other, and not run again
where a run before has completed them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from cinefold.session import shared_dir

_POOL = "spark.scheduler.pool"


def side_by_side(spark: SparkSession, tasks: Mapping[str, Callable[[], Any]]) -> dict[str, Any]:
    """Run tasks at once, each in a thread and a scheduler pool of its own; their results by name.

    With `spark.scheduler.mode` FAIR, as `session` sets it, the pools share the executors; otherwise
    a later task gets what the earlier ones leave free. All tasks are waited for before the first
    error, in their order, is raised, so none is still writing when the caller goes on.
    """
    shared_dir(spark)  # Chosen once, not by each thread.

    def run(name: str) -> Any:
        spark.sparkContext.setLocalProperty(_POOL, name)
        return tasks[name]()

    if not tasks:
        return {}
    with ThreadPoolExecutor(len(tasks)) as threads:
        running = {name: threads.submit(inheritable_thread_target(spark)(run), name) for name in tasks}
    return {name: task.result() for name, task in running.items()}


class Stages:
    """Which stages of a chain are complete, as one small table per stage under `path`.

    A stage's mark holds the settings of the chain, a name of its own for this completion, and the
    names under which the stages it needs were complete. With `resume`, a stage is skipped if all of
    that still holds: another setting, or a needed stage that ran again, makes it run again too. The
    mark is taken away before a stage runs, so one that stops halfway counts as not complete. Inputs
    of the chain are taken to be unchanged.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Mapping[str, Any], resume: bool = False):
        self.spark, self.path, self.resume = spark, path.rstrip("/"), resume
        self.settings = json.dumps(settings, sort_keys=True)
        self.complete: dict[str, str] = {}
        self.skipped: list[str] = []

    def run(self, name: str, work: Callable[[], Any], needs: Sequence[str] = ()) -> None:
        """Run `work`, unless it is complete; `needs` must have been run or skipped before."""
        after = {n: self.complete[n] for n in needs}
        mark = self._read(name) if self.resume else None
        if mark and (mark["settings"], mark["after"]) == (self.settings, after):
            self.complete[name] = mark["completion"]
            self.skipped.append(name)
            return
        self._write(name, None)
        work()
        completion = uuid.uuid4().hex
        self._write(name, {"settings": self.settings, "after": after, "completion": completion})
        self.complete[name] = completion

    def _write(self, name: str, mark: dict[str, Any] | None) -> None:
        rows = [(json.dumps(mark),)] if mark else []
        marks = self.spark.createDataFrame(rows, "value string").coalesce(1)
        marks.write.mode("overwrite").text(f"{self.path}/{name}")

    def _read(self, name: str) -> dict[str, Any] | None:
        try:
            row = self.spark.read.text(f"{self.path}/{name}").first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return json.loads(row.value) if row else None
