"""A count sketch of fixed size over hashes, summed over all rows: it tells rare from common, for any corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.llm.words import U

#: Counters: 2 MB at the driver and in each task.
SLOTS = 1 << 20
CHUNK = 1 << 14
#: Partial sketches that one task adds up.
FAN_IN = 64
#: Counts above twice the mean by this many are common.
COMMON = 1 << 16
SCHEMA = "chunk int, task int, counts binary"


class Sketch:
    """The part of one task."""

    def __init__(self) -> None:
        self.counts = np.zeros(SLOTS, np.int64)

    def add(self, h: np.ndarray) -> None:
        self.counts += np.bincount((h & U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)

    def chunks(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        m = SLOTS // CHUNK
        parts = [c.astype(np.uint32).tobytes() for c in self.counts.reshape(m, CHUNK)]  # a task has fewer than 2**32 words
        return pa.array(np.arange(m, dtype=np.int32)), pa.array(np.full(m, TaskContext.get().partitionId(), np.int32)), pa.array(parts, pa.binary())


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, np.int64)
    for x in pdf["counts"]:
        total += np.frombuffer(x, np.uint32 if len(x) == 4 * CHUNK else np.int64)
    return pd.DataFrame({"chunk": pdf["chunk"][:1], "task": pdf["task"][:1] // FAN_IN, "counts": [total.tobytes()]})


class Counts:
    """The counters of all rows, 2 bytes each: on a scale of logarithms, which keeps their order for any corpus (steps of 0.07 percent)."""

    STEPS = 1023

    def __init__(self, counts: np.ndarray) -> None:
        self.scaled = self._scale(counts)
        #: Counts from here on stand out from what other hashes add to a slot.
        self.high = int(self._scale(2 * counts.mean() + COMMON))

    def _scale(self, counts: np.ndarray) -> np.ndarray:
        return np.round(np.log2(np.asarray(counts, np.float64) + 1) * self.STEPS).astype(np.uint16)

    def of(self, h: np.ndarray) -> np.ndarray:
        """Order of the counts."""
        return self.scaled[(h & U(SLOTS - 1)).astype(np.int64)]

    def common(self, h: np.ndarray) -> np.ndarray:
        """The count where it stands out, else 0."""
        x = self.of(h)
        return np.where(x >= self.high, np.exp2(x / self.STEPS), 0).astype(np.int64)


def summed(parts: DataFrame, tasks: int) -> Counts:
    """parts: (chunk, task, counts) of tasks with numbers below `tasks`."""
    while True:
        parts = parts.groupBy("chunk", F.expr(f"task div {FAN_IN}")).applyInPandas(_add, SCHEMA)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    out = np.zeros(SLOTS, np.int64)
    for r in parts.collect():  # SLOTS / CHUNK rows
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, np.int64)
    return Counts(out)


def sketch(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> Counts:
    """The sketch of all hashes of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Sketch()
        for batch in batches:
            for h in hashes(batch):
                part.add(h)
        yield pa.RecordBatch.from_arrays([*part.chunks()], names=["chunk", "task", "counts"])

    return summed(rows.mapInArrow(run, SCHEMA), max(1, rows.rdd.getNumPartitions()))
