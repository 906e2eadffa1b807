"""What a run is doing, on standard error: tasks of the running stages, and epochs with the time that is left."""

from __future__ import annotations

import sys
import threading
import time
from typing import TextIO

from pyspark.sql import SparkSession


class Progress:
    """While it is open, a thread asks the status tracker every few seconds and writes a line when something has moved."""

    def __init__(self, spark: SparkSession, every: float = 5.0, out: TextIO | None = None):
        self.tracker, self.every, self.out = spark.sparkContext.statusTracker(), every, out or sys.stderr
        self.began, self.epochs_began, self.lines = time.time(), None, []
        self._stop = threading.Event()

    def __enter__(self) -> Progress:
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._stop.set()
        self._thread.join()
        self.say("done")

    def say(self, text: str) -> None:
        line = f"[{time.time() - self.began:8.1f} s] {text}"
        self.lines.append(line)
        print(line, file=self.out, flush=True)

    def running(self) -> list[tuple[int, int, int]]:
        """Stage, tasks done and tasks of each running stage."""
        found = (self.tracker.getStageInfo(s) for s in sorted(self.tracker.getActiveStageIds()))
        return [(i.stageId, i.numCompletedTasks, i.numTasks) for i in found if i is not None]

    def _watch(self) -> None:
        last = None
        while not self._stop.wait(self.every):
            now = self.running()
            if now and now != last:
                self.say(", ".join(f"stage {s}: {done} of {n} tasks" for s, done, n in now))
                last = now

    def epoch(self, epoch: int, epochs: int, values: dict[str, float]) -> None:
        """An epoch that has ended."""
        now = time.time()
        if epoch == 1 or self.epochs_began is None:
            self.epochs_began = now
            left = ""
        else:
            left = f", about {(now - self.epochs_began) / (epoch - 1) * (epochs - epoch):.0f} s left"
        self.say(f"epoch {epoch} of {epochs}: " + ", ".join(f"{k} {v:.4g}" for k, v in values.items()) + left)
