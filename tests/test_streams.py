"""Queues, the replay buffer and late rows as streams that stop and go on from their checkpoints."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from rillmark.plans import q_stream
from rillmark.sources import queue as Q
from rillmark.streaming import replay as R


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_queue_keeps_order_and_drops_the_oldest(spark, folder):
    path = f"{folder}/q"
    for a in (0, 10, 20):
        q_stream.put(spark.range(a, a + 10, numPartitions=3).withColumn("x", F.lit("y")), path)
    read = lambda **o: [r["id"] for r in spark.read.format(Q.FORMAT).options(path=path, **o).load().collect()]
    assert read() == list(range(30)) and read(capacity="13") == list(range(17, 30)) and read(capacity="0") == []
    assert spark.read.format(Q.FORMAT).option("path", path).load().dtypes == [("id", "bigint"), ("x", "string")]
    assert Q.statistics(path, [(0, 1), (1, 3)], 13) == {"produced": 30, "consumed": 23, "dropped": 7, "size": 0}
    assert Q.statistics(path, [(0, 1)], 13) == {"produced": 30, "consumed": 10, "dropped": 7, "size": 13} and Q.statistics(path, []) == {"produced": 30, "consumed": 0, "dropped": 0, "size": 30}
    q_stream.put(spark.range(0).withColumn("x", F.lit("y")), path)
    assert len(read()) == 30 and Q.statistics(path, [(0, 4)])["size"] == 0
    Q.close(path)
    with pytest.raises(Exception, match="closed"):
        q_stream.put(spark.range(3).withColumn("x", F.lit("y")), path)
    with pytest.raises(Exception, match="only appended"):
        spark.range(3).write.format(Q.FORMAT).option("path", path).mode("overwrite").save()


def test_queue_passes_rows_once_over_restarts(spark, folder):
    """A copying stream is stopped, and made to run its last batch again: nothing comes twice."""
    Q.register(spark)

    def copy():
        rows = q_stream.of_queue(spark, f"{folder}/a", "id bigint")
        out = rows.writeStream.format(Q.FORMAT).option("path", f"{folder}/b").option("writer", "copy").option("checkpointLocation", f"{folder}/state")
        out.trigger(availableNow=True).start().awaitTermination()
        return sorted(r["id"] for r in spark.read.format(Q.FORMAT).option("path", f"{folder}/b").load().collect())

    q_stream.put(spark.range(5).toDF("id"), f"{folder}/a")
    assert copy() == list(range(5))
    q_stream.put(spark.range(5, 9).toDF("id"), f"{folder}/a")
    assert copy() == list(range(9)) and copy() == list(range(9))
    commits = sorted((int(x), x) for x in os.listdir(f"{folder}/state/commits") if x.isdigit())
    for name in (commits[-1][1], f".{commits[-1][1]}.crc"):  # as if it had stopped between writing and committing
        os.remove(f"{folder}/state/commits/{name}")
    assert copy() == list(range(9))
    held = Q.Folder(f"{folder}/b")
    assert [held.manifest(k)["rows"] for k in held.numbers()] == [5, 4] and len(os.listdir(f"{folder}/b/data")) == sum(len(held.manifest(k)["files"]) for k in held.numbers())


def plain_buffer(rows, batch, threshold, strategy):
    """The rules of the buffer, row by row."""
    out = []
    for p in sorted({r[0] for r in rows}):
        held = {}
        for _, step, kind, _, uid, status in sorted((r for r in rows if r[0] == p), key=lambda r: (r[1], R.KINDS.index(r[2]), r[3])):
            if kind == "tag":
                held[uid] = (status, held.get(uid, (None, step))[1])
            elif kind == "restart":
                held = {u: ("pending", step) if s in ("pending", "running") else (s, b) for u, (s, b) in held.items()}
            else:
                gone = 0
                for u, (s, b) in list(held.items()):
                    fate = "failure" if s == "failure" else "stale" if s == "finished" and strategy == "drop" and step - b + 1 > threshold else None
                    if fate:
                        out.append((p, step, fate, u, b, step - b + 1))
                        gone += 1
                        del held[u]
                if gone:
                    out.append((p, step, "refill", None, None, gone))
                ready = sorted((b, u) for u, (s, b) in held.items() if s == "finished")
                stuck = strategy == "wait" and any(s in ("pending", "running") and step - b + 1 >= threshold for s, b in held.values())
                go = len(ready) >= batch and not stuck
                out.append((p, step, "go" if go else "wait", None, None, len(ready)))
                for b, u in ready[:batch] if go else []:
                    out.append((p, step, "sampled", u, b, step - b + 1))
                    del held[u]
    return sorted(out, key=str)


@pytest.mark.parametrize(("strategy", "threshold"), [("drop", 2), ("wait", 3)])
def test_replay_buffer_goes_on_from_its_checkpoint(spark, sf_dir, folder, strategy, threshold):
    rows = q_stream.replay_rows(spark, sf_dir).cache()

    def run(steps):
        with R.rocksdb(spark):
            stream = R.replay(q_stream.of_queue(spark, f"{folder}/q", q_stream._REPLAY_COLUMNS), 2, threshold, strategy)
            running = q_stream.started(stream, folder, "out")
        for k in steps:
            q_stream.put(rows.where(F.col("step").isin(k)), f"{folder}/q")
            running.processAllAvailable()
        running.stop()

    run([[1, 2], [3]])
    run([[4], [5, 6, 7, 8]])  # a new query over the same state
    got = sorted((tuple(r) for r in spark.read.schema(R.SCHEMA).parquet(f"{folder}/out").collect()), key=str)
    want = plain_buffer([tuple(r) for r in rows.select("partition_id", "step", "kind", "seq", "uid", "status").collect()], 2, threshold, strategy)
    assert got == want and {r[2] for r in want} >= {"sampled", "failure", "refill", "go"}


def test_open_polls_are_made_again_by_a_timer(spark, folder):
    row = lambda *r: spark.createDataFrame([r], q_stream._REPLAY_COLUMNS)
    with R.rocksdb(spark):
        stream = R.replay(q_stream.of_queue(spark, f"{folder}/q", q_stream._REPLAY_COLUMNS), 1, 5, poll_ms=200)
        running = q_stream.started(stream, folder, "out")
    try:
        q_stream.put(row(0, 1, "poll", 1, None, None), f"{folder}/q")
        deadline = time.time() + 90
        found = lambda: [(r["fate"], r["uid"]) for r in spark.read.schema(R.SCHEMA).parquet(f"{folder}/out").collect()] if os.path.exists(f"{folder}/out/_spark_metadata") else []
        while ("wait", None) not in found() and time.time() < deadline:
            time.sleep(0.5)
        q_stream.put(row(0, 1, "tag", 2, 7, "finished"), f"{folder}/q")
        while ("sampled", 7) not in found() and time.time() < deadline:
            time.sleep(0.5)
        assert sorted(found(), key=str) == [("go", None), ("sampled", 7), ("wait", None)]
    finally:
        running.stop()


def test_unknown_strategies_and_files_of_a_queue(spark, folder):
    with pytest.raises(ValueError, match="strategy"):
        R.ReplayBuffer(1, 1, "other")
    q_stream.put(spark.range(3), f"{folder}/q")
    with open(f"{folder}/q/log/000000000000.json") as f:
        told = json.load(f)
    assert told["rows"] == 3 and Q.Folder(f"file://{folder}/q").numbers() == [0]
