"""Samples of a run of one's own: memory of driver and executors over time, and what every stage took, as tables."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SAMPLES = "run string, at double, executor string, heap_mb double, storage_mb double, active_tasks int"
STAGES = "run string, stage_id int, attempt int, stage string, status string, seconds double, input_mb double, shuffle_mb double, spilled_mb double, failed_tasks int"
_MB = 1 << 20


class Sampler:
    """``with Sampler(spark, path, "build") as s: ...`` appends to the tables ``path/samples`` and ``path/stages`` at the end, after
    a failure too; ``reporting.profile`` and ``reporting.stage_times`` read them.

    A thread of the driver asks Spark's own status store every ``seconds``. Once there are ``most`` samples every other
    one goes and the pace halves, so a run of any length gives a bounded number. An executor's heap is the peak it has
    reported so far, the driver's what it uses at the moment. ``with s.stage("chunking"): ...`` names the stages of jobs within.
    """

    def __init__(self, spark: SparkSession, path: str, run: str, seconds: float = 0.25, most: int = 4096):
        self.spark, self.path, self.run, self.seconds, self.most = spark, path.rstrip("/"), run, seconds, max(2, most)

    @property
    def _store(self):
        return self.spark.sparkContext._jsc.sc().statusStore()

    def _stages(self) -> list:
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        found = self._store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return [found.apply(k) for k in range(found.size())]

    def _sample(self) -> None:
        now, runtime = time.time(), self.spark._jvm.java.lang.Runtime.getRuntime()
        found = self._store.executorList(True)
        for k in range(found.size()):
            e = found.apply(k)
            peak = e.peakMemoryMetrics()
            if e.id() == "driver":
                heap = runtime.totalMemory() - runtime.freeMemory()
            else:
                heap = peak.get().getMetricValue("JVMHeapMemory") if peak.isDefined() else 0
            self.samples.append((self.run, now, e.id(), heap / _MB, e.memoryUsed() / _MB, e.activeTasks()))

    def _loop(self) -> None:
        while not self.done.wait(self.seconds):
            with self.lock:
                self._sample()
                if len(self.samples) > self.most:
                    times = sorted({s[1] for s in self.samples})
                    kept = {*times[::2], times[-1]}
                    self.samples, self.seconds = [s for s in self.samples if s[1] in kept], 2 * self.seconds

    def __enter__(self) -> Sampler:
        self.samples, self.done, self.lock = [], threading.Event(), threading.Lock()
        self.before = max((s.stageId() for s in self._stages()), default=-1)
        self._sample()
        self.thread = threading.Thread(target=self._loop, daemon=True)
        self.thread.start()
        return self

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        context = self.spark.sparkContext
        context.setJobDescription(name)
        try:
            yield
        finally:
            context.setJobDescription(None)

    def __exit__(self, kind, error, trace) -> None:
        self.done.set()
        self.thread.join()
        self._sample()
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        stages = []
        for s in self._stages():
            if s.stageId() > self.before:
                named = s.description()
                stages.append((self.run, s.stageId(), s.attemptId(), named.get() if named.isDefined() else s.name(), s.status().toString(), s.executorRunTime() / 1000, s.inputBytes() / _MB, (s.shuffleReadBytes() + s.shuffleWriteBytes()) / _MB, (s.memoryBytesSpilled() + s.diskBytesSpilled()) / _MB, s.numFailedTasks()))
        for rows, schema, name in ((self.samples, SAMPLES, "samples"), (stages, STAGES, "stages")):
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")
