"""Queries that run as streams, over queues that the tables are put into step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import queue as Q
from ..streaming import queues as S
from ..streaming import replay as R
from .base import query, r6, s6, scratch, table

#: Days of events that come in one step.
_DAYS = 4
_STEP = f"CAST(1 + (day(ts) - 1) // {_DAYS} AS BIGINT)"


def _events(spark, sf):
    step = (F.floor((F.dayofmonth(F.col("ts").cast("timestamp")) - 1) / _DAYS) + 1).cast("bigint")
    return table(spark, sf, "events").withColumns({"ts": F.col("ts").cast("timestamp"), "step": step})


def put(rows: DataFrame, path: str) -> None:
    """Rows as one more segment of a queue."""
    Q.register(rows.sparkSession)
    rows.write.format(Q.FORMAT).option("path", path).mode("append").save()


def of_queue(spark, path: str, schema: str, **options: str) -> DataFrame:
    Q.register(spark)
    return spark.readStream.format(Q.FORMAT).schema(schema).options(path=path, **options).load()


def started(stream: DataFrame, folder: str, name: str):
    """The stream being written as Parquet; its batches come as the queue does."""
    return stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").outputMode("append").start()


def step_by_step(rows: DataFrame, stream: DataFrame, folder: str, steps: list[int]) -> DataFrame:
    """What a stream over the queue ``folder``/queue makes of rows that come in steps."""
    running = None
    try:
        with R.rocksdb(rows.sparkSession):
            running = started(stream, folder, "out")
        for k in steps:
            put(rows.where(F.col("step") == k), f"{folder}/queue")
            running.processAllAvailable()
    finally:
        if running is not None:
            running.stop()
    return rows.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query("SELECT event_type AS partition_id, least(count(*), 8) AS size, greatest(count(*) - 8, 0) AS dropped FROM events GROUP BY 1")
def queue_stream(spark, sf):
    """Events streamed into a queue, and from it into a bounded queue per type, until there are no more."""
    path = scratch(spark, "queue")
    Q.register(spark)
    events = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf).select("event_id", "event_type")
    into = events.writeStream.format(Q.FORMAT).option("path", f"{path}/queue").option("writer", "events").option("checkpointLocation", f"{path}/in-state")
    into.trigger(availableNow=True).start().awaitTermination()
    rows = of_queue(spark, f"{path}/queue", "event_id bigint, event_type string").select(F.col("event_type").alias("partition_id"), F.col("event_id").alias("seq"))

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.format(Q.FORMAT).options(path=f"{path}/sizes", writer="sizes", batch=str(k)).mode("append").save()

    out = S.stream_queue(rows, 8).writeStream.outputMode("update").option("checkpointLocation", f"{path}/out-state").foreachBatch(keep)
    out.trigger(availableNow=True).start().awaitTermination()
    sizes = spark.read.format(Q.FORMAT).option("path", f"{path}/sizes").load()
    return sizes.groupBy("partition_id").agg(F.max_by("size", "dropped").alias("size"), F.max("dropped").alias("dropped"))


@query(f"SELECT count(*) AS produced, count(*) FILTER (WHERE event_type = 'error') AS errors, {s6('sum(value)')} AS total FROM events")
def queue_observed(spark, sf):
    """What went into a queue, counted by the same pass that wrote it."""
    path = scratch(spark, "observed")
    Q.register(spark)
    events = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf).select("event_id", "event_type", "value")
    counted = events.observe("queue", F.count(F.lit(1)).alias("produced"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("value").alias("total"))
    into = counted.writeStream.format(Q.FORMAT).option("path", f"{path}/queue").option("writer", "events").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    into.awaitTermination()
    seen = [p.observedMetrics["queue"] for p in into.recentProgress if "queue" in p.observedMetrics]  # a row for each micro-batch
    rows = [(int(r["produced"]), int(r["errors"]), float(r["total"] or 0)) for r in seen]
    return spark.createDataFrame(rows, "produced bigint, errors bigint, total double").agg(F.sum("produced").alias("produced"), F.sum("errors").alias("errors"), r6(F.sum("total")).alias("total"))


_READS = [(0, 2), (2, 3), (3, 8)]


@query(f"""WITH e AS (SELECT event_id, CASE WHEN {_STEP} <= 2 THEN 0 WHEN {_STEP} <= 3 THEN 1 ELSE 2 END AS r FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY event_id DESC) AS k, count(*) OVER () AS produced FROM e)
SELECT event_id, 'row' AS what, NULL::BIGINT AS n FROM n WHERE k <= 700 UNION ALL SELECT NULL, 'produced', count(*) FROM n UNION ALL SELECT NULL, 'consumed', count(*) FROM n WHERE k <= 700 UNION ALL SELECT NULL, 'dropped', count(*) FROM n WHERE k > 700 UNION ALL SELECT NULL, 'size', 0""")
def queue_bounded(spark, sf):
    """A queue that holds 700 rows and is read now and then: what its reader gets, and the counts."""
    folder, rows = scratch(spark, "bounded"), _events(spark, sf)
    for start, end in _READS:
        for k in range(start, end):
            put(rows.where(F.col("step") == k + 1).select("event_id").orderBy("event_id"), f"{folder}/queue")
        read = of_queue(spark, f"{folder}/queue", "event_id bigint", capacity="700").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        read.trigger(availableNow=True).start().awaitTermination()
    counts = Q.statistics(f"{folder}/queue", _READS, 700)
    counted = spark.createDataFrame([(None, k, n) for k, n in counts.items()], "event_id bigint, what string, n bigint")
    return spark.read.schema("event_id bigint").parquet(f"{folder}/out").select("event_id", F.lit("row").alias("what"), F.lit(None).cast("bigint").alias("n")).unionByName(counted)


_BATCH, _THRESHOLD, _RESTART = 3, 3, 5
_STATUS = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'finished' ELSE 'failure' END"


def _replay_sql(steps: int) -> str:
    """The buffer's rules, one step after the other."""
    out = [f"t AS MATERIALIZED (SELECT user_id AS uid, user_id % 3 AS p, {_STEP} AS step, arg_max({_STATUS}, event_id) AS status FROM events GROUP BY ALL)", "k0 AS (SELECT 0::BIGINT AS p, 0::BIGINT AS uid, '' AS status, 0 AS birth WHERE false)"]
    for k in range(1, steps + 1):
        open_ = f"status IN ('pending', 'running') AND {k} = {_RESTART} AND p IN (SELECT p FROM t WHERE step = {k})"
        out += [
            f"b{k} AS (SELECT p, uid, CASE WHEN {open_} THEN 'pending' ELSE status END AS status, CASE WHEN {open_} THEN {k} ELSE birth END AS birth FROM k{k - 1})",
            f"s{k} AS (SELECT p, uid, coalesce(l.status, b.status) AS status, coalesce(b.birth, {k}) AS birth FROM b{k} b FULL JOIN (SELECT p, uid, status FROM t WHERE step = {k}) l USING (p, uid))",
            f"a{k} AS (SELECT *, status = 'finished' AND {k} - birth + 1 <= {_THRESHOLD} AS ok, p IN (SELECT p FROM t WHERE step = {k}) AS polled FROM s{k})",
            f"r{k} AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY p) AS ready, row_number() OVER (PARTITION BY p, ok ORDER BY birth, uid) AS place FROM a{k})",
            f"f{k} AS MATERIALIZED (SELECT *, CASE WHEN NOT polled THEN 'kept' WHEN status = 'failure' THEN 'failure' WHEN status = 'finished' AND NOT ok THEN 'stale' WHEN ok AND ready >= {_BATCH} AND place <= {_BATCH} THEN 'sampled' ELSE 'kept' END AS fate FROM r{k})",
            f"k{k} AS (SELECT p, uid, status, birth FROM f{k} WHERE fate = 'kept')",
        ]
    told = []
    for k in range(1, steps + 1):
        told += [
            f"SELECT p, {k}, fate, uid, birth, {k} - birth + 1 FROM f{k} WHERE fate <> 'kept'",
            f"SELECT p, {k}, CASE WHEN max(ready) >= {_BATCH} THEN 'go' ELSE 'wait' END, NULL, NULL, max(ready) FROM f{k} WHERE polled GROUP BY p",
            f"SELECT p, {k}, 'refill', NULL, NULL, count(*) FROM f{k} WHERE fate IN ('failure', 'stale') GROUP BY p",
        ]
    return f"WITH {', '.join(out)} SELECT p AS partition_id, CAST(step AS BIGINT) AS step, fate, uid, CAST(birth AS BIGINT) AS birth, CAST(n AS BIGINT) AS n FROM ({' UNION ALL '.join(told)}) x(p, step, fate, uid, birth, n)"


_REPLAY_COLUMNS = "partition_id bigint, step bigint, kind string, seq bigint, uid bigint, status string"


def replay_rows(spark, sf) -> DataFrame:
    """Events as what prompts do, with a poll at the end of each step, and a restart."""
    e = _events(spark, sf)
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type").isin("signup", "click"), "running").when(F.col("event_type") == "purchase", "finished").otherwise("failure")
    tags = e.select((F.col("user_id") % 3).alias("partition_id"), "step", F.lit("tag").alias("kind"), F.col("event_id").alias("seq"), F.col("user_id").alias("uid"), status.alias("status"))
    each = tags.select("partition_id", "step").distinct()
    none = {"seq": F.lit(0).cast("bigint"), "uid": F.lit(None).cast("bigint"), "status": F.lit(None).cast("string")}
    polls, restart = each.withColumn("kind", F.lit("poll")).withColumns(none), each.where(F.col("step") == _RESTART).withColumn("kind", F.lit("restart")).withColumns(none)
    return tags.unionByName(polls).unionByName(restart)


@query(_replay_sql(8))
def replay_stream(spark, sf):
    """Eight training steps over a replay buffer per partition, each step a micro-batch."""
    folder, rows = scratch(spark, "replay"), replay_rows(spark, sf)
    stream = R.replay(of_queue(spark, f"{folder}/queue", _REPLAY_COLUMNS), _BATCH, _THRESHOLD)
    return step_by_step(rows, stream, folder, list(range(1, 9)))


# ---- event time, late rows

_LATE = f"""arrived AS MATERIALIZED (SELECT event_id, event_type, value, ts, least({_STEP} + CASE WHEN event_id % 7 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 1 ELSE 0 END, 8) AS step FROM events),
most AS (SELECT k AS step, (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '2 days' FROM arrived WHERE step < k) AS mark FROM range(1, 10) t(k))"""


def _late(spark, sf):
    """Events of which every seventh comes two steps late, and every fifth one."""
    e = _events(spark, sf)
    behind = F.when(F.col("event_id") % 7 == 0, 2).when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    return e.select("event_id", "event_type", "value", "ts", F.least(F.col("step") + behind, F.lit(8)).alias("step"))


_END = "2100-01-01 00:00:00"


def _in_steps(spark, rows: DataFrame, make, folder: str) -> DataFrame:
    """``make`` of the stream of rows; a last row of the far future closes all that is open."""
    schema = "event_id bigint, event_type string, value double, ts timestamp, step bigint"
    rows = rows.unionByName(spark.sql(f"SELECT -1L AS event_id, '' AS event_type, 0D AS value, TIMESTAMP '{_END}' AS ts, 9L AS step"))
    return step_by_step(rows, make(of_queue(spark, f"{folder}/queue", schema)), folder, list(range(1, 10)))


@query(f"""WITH {_LATE}, n AS (SELECT *, mark IS NOT NULL AND time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' <= mark AS late FROM arrived LEFT JOIN most m ON m.step = arrived.step)
SELECT epoch(time_bucket(INTERVAL '1 day', ts))::BIGINT AS start, event_type, count(*) AS n, {s6('sum(value)')} AS total FROM n WHERE NOT late GROUP BY ALL
UNION ALL SELECT NULL, 'dropped', count(*), 0.0 FROM n WHERE late""")
def window_late(spark, sf):
    """Daily counts under a watermark of two days, and how many rows came too late for their window."""
    folder, rows = scratch(spark, "late"), _late(spark, sf)
    w = _in_steps(spark, rows, lambda s: S.tumbling(s, "ts", "1 day", ["event_type"], "2 days"), folder).where("start < '2100-01-01'")
    out = w.select(F.unix_timestamp("start").alias("start"), "event_type", "n", r6("total").alias("total"))
    dropped = rows.agg(F.count(F.lit(1)).alias("all")).join(w.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept")), F.lit(True))
    return out.unionByName(dropped.select(F.lit(None).cast("bigint").alias("start"), F.lit("dropped").alias("event_type"), (F.col("all") - F.col("kept")).alias("n"), F.lit(0.0).alias("total")))


@query(f"""WITH {_LATE}, twice AS (SELECT event_id, ts, step FROM arrived UNION ALL SELECT event_id, ts, least(step + 1 + event_id % 3, 8) FROM arrived WHERE event_id % 4 = 0)
SELECT event_id FROM twice LEFT JOIN most m ON m.step = twice.step WHERE m.mark IS NULL OR ts > m.mark GROUP BY event_id""")
def duplicates_in_watermark(spark, sf):
    """Events of which every fourth is sent again some steps later: each once, unless it is too late."""
    rows = _late(spark, sf)
    again = rows.where("event_id % 4 = 0").withColumn("step", F.least(F.col("step") + 1 + F.col("event_id") % 3, F.lit(8)))
    folder = scratch(spark, "twice")
    once = _in_steps(spark, rows.unionByName(again), lambda s: S.once(s, ["event_id"], "ts", "2 days"), folder)
    return once.where("event_id >= 0").select("event_id")
