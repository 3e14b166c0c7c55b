"""A replay buffer as a stateful stream.

Rows tell of prompts (kind ``tag``: a status, pending, running, finished or failure), ask for a
batch (``poll``, at a training step) or say that generation began anew (``restart``).  Per
partition the state holds the prompts in the buffer with their status and the step at which they
were born.  A poll first evicts what can't be trained on - failures and, with the ``drop`` strategy,
finished prompts older than the threshold - and asks for as many new prompts; then it
takes the oldest ``batch`` finished ones, if there are as many and, with ``wait``, no prompt in flight
has reached the threshold.  A restart has unfinished prompts born anew.  Rows of a micro-batch
are taken in order of (step, kind, seq), restarts first and polls last.

Where a poll finds too few, it is over; with ``poll_ms`` it stays open and is made again by a
processing-time timer until it succeeds or a later poll takes its place.  The state is as
large as the prompts in a partition's buffer, which those who generate keep bounded."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .queues import STATUSES

KINDS = ("restart", "tag", "poll")
#: fate: sampled, stale or failure of a prompt, with its age; go or wait of a poll, with how many were
#: ready; refill, with how many prompts to ask for.
SCHEMA = "partition_id bigint, step bigint, fate string, uid bigint, birth bigint, n bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Stateful processors need this store; queries started inside have it, others keep theirs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class ReplayBuffer(StatefulProcessor):
    def __init__(self, batch: int, threshold: int, strategy: str = "drop", poll_ms: int | None = None):
        if strategy not in ("drop", "wait"):
            raise ValueError(f"unknown strategy {strategy!r}")
        self.batch, self.threshold, self.strategy, self.poll_ms = batch, threshold, strategy, poll_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.prompts = handle.getMapState("prompts", "uid bigint", "status string, birth bigint")
        self.open = handle.getValueState("open", "step bigint")

    def _held(self) -> dict[int, tuple[str, int]]:
        return {int(k[0]): (v[0], int(v[1])) for k, v in self.prompts.iterator()} if self.prompts.exists() else {}

    def _keep(self, before: dict, now: dict) -> None:
        for uid in before.keys() - now.keys():
            self.prompts.removeKey((uid,))
        for uid, told in now.items():
            if before.get(uid) != told:
                self.prompts.updateValue((uid,), told)

    def _poll(self, held: dict[int, tuple[str, int]], key: int, step: int) -> tuple[list[tuple], bool]:
        """Rows that a poll gives, and whether it got a batch; ``held`` loses what it takes."""
        age = lambda uid: step - held[uid][1] + 1
        late = lambda uid: self.strategy == "drop" and age(uid) > self.threshold
        fate = {uid: "failure" if status == "failure" else "stale" for uid, (status, _) in held.items() if status == "failure" or (status == "finished" and late(uid))}
        out = [(key, step, f, uid, held[uid][1], age(uid)) for uid, f in fate.items()]
        if fate:
            out.append((key, step, "refill", None, None, len(fate)))
        ready = sorted((birth, uid) for uid, (status, birth) in held.items() if status == "finished" and uid not in fate)
        blocked = self.strategy == "wait" and any(status in ("pending", "running") and age(uid) >= self.threshold for uid, (status, _) in held.items())
        go = len(ready) >= self.batch and not blocked
        out.append((key, step, "go" if go else "wait", None, None, len(ready)))
        chosen = [uid for _, uid in ready[: self.batch]] if go else []
        out += [(key, step, "sampled", uid, held[uid][1], age(uid)) for uid in chosen]
        for uid in (*fate, *chosen):
            del held[uid]
        return out, go

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told = pd.concat(list(rows))
        told["order"] = told["kind"].map(KINDS.index)
        before, out = self._held(), []
        held = dict(before)
        for r in told.sort_values(["step", "order", "seq"]).itertuples():
            step = int(r.step)
            if r.kind == "poll":
                rows_, go = self._poll(held, int(key[0]), step)
                out += rows_
                self._later(None if go else step, timerValues)
            elif r.kind == "restart":
                held |= {uid: ("pending", step) for uid, (status, _) in held.items() if status in ("pending", "running")}
            elif r.status in STATUSES:
                uid = int(r.uid)
                held[uid] = (r.status, held[uid][1] if uid in held else step)
            else:
                raise ValueError(f"unknown status {r.status!r}")
        self._keep(before, held)
        yield _frame(out)

    def _later(self, step: int | None, timer_values: object) -> None:
        """Leave a poll open, or none."""
        if self.poll_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if step is None:
            self.open.clear()
        else:
            self.open.update((step,))
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.poll_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.open.exists():
            before = self._held()
            held, step = dict(before), int(self.open.get()[0])
            out, go = self._poll(held, int(key[0]), step)
            self._keep(before, held)
            self.open.clear()
            if not go:
                self.open.update((step,))
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.poll_ms)
            yield _frame([x for x in out if go or x[2] != "wait"])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names if c != "fate"})


def replay(rows: DataFrame, batch: int, threshold: int, strategy: str = "drop", poll_ms: int | None = None) -> DataFrame:
    """A stream of (partition_id, step, kind, seq, uid, status) through the buffer of each partition;
    start the query inside ``rocksdb``."""
    processor = ReplayBuffer(batch, threshold, strategy, poll_ms)
    return rows.groupBy("partition_id").transformWithStateInPandas(processor, SCHEMA, "append", "none" if poll_ms is None else "processingTime")
