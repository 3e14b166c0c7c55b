"""Bounded queues, replay buffers and staleness, as batch rules and as streams.

The batch functions state the semantics over a log of events; the streaming ones keep the
same rules in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.batch import among_first

STATUSES = ("pending", "running", "finished", "failure")


def bounded_queue(events: DataFrame, order: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of a queue that drops its oldest when full and isn't read meanwhile.  ``order`` is a
    total one of numbers or times; the oldest row kept is looked for and none are gathered."""
    kinds = dict(events.dtypes)
    newest = among_first(events, [-(F.unix_micros(F.col(c).cast("timestamp")) if kinds[c].startswith("timestamp") else F.col(c)) for c in order], most)
    return events.where(newest), events.where(~newest)


def queue_statistics(events: DataFrame, most: int) -> DataFrame:
    n = F.count(F.lit(1))
    return events.agg(n.alias("produced"), F.least(n, F.lit(most)).alias("size"), F.greatest(n - most, F.lit(0)).alias("dropped"))


def latest_status(tags: DataFrame, key: str = "uid", status: str = "status", seq: str = "seq") -> DataFrame:
    """The status of each key by its last event; an unknown status is an error."""
    known = F.when(F.col(status).isin(*STATUSES), F.col(status)).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.col(status))))
    return tags.groupBy(key).agg(F.max_by(known, F.col(seq)).alias("status"), F.max(seq).alias("seq"))


def zero_variance(groups: DataFrame, uid: str, score: str) -> DataFrame:
    """Prompts with several trajectories whose scores are all equal."""
    return groups.groupBy(uid).agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("lo"), F.max(score).alias("hi")).where("n > 1 AND lo = hi").select(uid)


def stale(rows: DataFrame, step: int, birth: str, threshold: int) -> Column:
    return F.lit(step) - F.col(birth) + 1 > threshold


def evict(finished: DataFrame, step: int, birth: str, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(kept, evicted) finished prompts by logical age."""
    old = stale(finished, step, birth, threshold)
    return finished.where(~old), finished.where(old)


def eviction_metrics(evicted: DataFrame, step: int, birth: str) -> DataFrame:
    age = F.lit(step) - F.col(birth) + 1
    return evicted.agg(F.count(F.lit(1)).alias("evicted"), F.avg(age).alias("age_mean"), F.max(age).alias("age_max"), F.min(age).alias("age_min"))


def select_batch(ready: DataFrame, n: int, birth: str, uid: str) -> DataFrame:
    """The oldest n prompts."""
    return ready.orderBy(birth, uid).limit(n)


def materialise(chosen: DataFrame, trajectories: DataFrame, uid: str) -> DataFrame:
    return trajectories.join(chosen.select(uid), uid, "left_semi")


def refill_credits(dropped: int, failed: int, in_flight: int, most: int) -> int:
    """How many prompts to ask for: two for each group dropped, one for each failed, within the cap."""
    return max(0, min(2 * dropped + failed, most - in_flight))


def must_pause(in_flight: Column | int, queued: Column | int, batch: int, threshold: int, sync_step: int) -> Column | bool:
    """Whether as much is in flight and queued as may be, of numbers or columns."""
    return in_flight + queued >= batch * (threshold + 1) * sync_step


def sampling_state(prompts: DataFrame, step: int, threshold: int, need: int, strategy: str, by: str = "partition_id", birth: str = "birth", status: str = "status") -> DataFrame:
    """(partition, ready, blocked, go): whether each partition may be sampled.

    ``drop`` leaves out finished prompts that are older than the threshold.  ``wait`` has
    sampling wait while any prompt in flight has reached it, so that none is dropped."""
    if strategy not in ("drop", "wait"):
        raise ValueError(f"unknown strategy {strategy!r}")
    span = F.lit(step) - F.col(birth) + 1
    fresh = span <= threshold if strategy == "drop" else F.lit(True)
    late = F.col(status).isin("pending", "running") & (span >= threshold) if strategy == "wait" else F.lit(False)
    state = prompts.groupBy(by).agg(F.count_if((F.col(status) == "finished") & fresh).alias("ready"), F.coalesce(F.bool_or(late), F.lit(False)).alias("blocked"))
    return state.withColumn("go", ~F.col("blocked") & (F.col("ready") >= need))


def fan_out(prompts: DataFrame, sessions: int, uid: str = "uid") -> DataFrame:
    """Each prompt as so many sessions, which begin as pending; ``traj_key`` names them."""
    each = prompts.withColumn("session_id", F.explode(F.sequence(F.lit(0), F.lit(sessions - 1))))
    return each.withColumns({"traj_key": F.concat_ws("_", F.col(uid).cast("string"), F.col("session_id").cast("string")), "status": F.lit("pending")})


def group_status(sessions: DataFrame, uid: str = "uid", status: str = "status") -> DataFrame:
    """(uid, status) of prompts by their sessions': running until all have ended, then failed if
    any has, else finished; pending if none has begun."""
    some = lambda *names: F.bool_or(F.col(status).isin(*names))
    out = F.when(~some("running", "finished", "failure"), "pending").when(some("pending", "running"), "running").when(some("failure"), "failure").otherwise("finished")
    return sessions.groupBy(uid).agg(out.alias("status"))


def trigger_steps(rows: DataFrame, batch: int, sync: int, idx: str = "row_idx") -> DataFrame:
    """(step, trigger): a training batch as so many equal sub-batches, each sampled by itself
    before the weights are synchronised."""
    if batch % sync:
        raise ValueError(f"a batch of {batch} doesn't divide into {sync}")
    return rows.withColumns({"step": F.floor(F.col(idx) / batch).cast("int"), "trigger": F.floor(F.col(idx) % batch / (batch // sync)).cast("int")})


def refill(source: DataFrame, rows: int, start: int, n: int, batch: int, step: int, idx: str = "row_idx") -> DataFrame:
    """The next n prompts of a source that begins anew when it ends, with fresh ids and pending
    from this step on; n must be whole batches."""
    if n % batch:
        raise ValueError(f"{n} prompts aren't whole batches of {batch}")
    asked = source.sparkSession.range(n).select((F.col("id") + start).alias("_at")).withColumns({idx: F.col("_at") % rows, "epoch": F.floor(F.col("_at") / rows).cast("int")})
    uid = F.sha2(F.concat_ws(":", F.lit(step).cast("string"), F.col("_at").cast("string")), 256)
    return asked.join(source, idx).withColumns({"uid": uid, "status": F.lit("pending"), "birth": F.lit(step)}).drop("_at")


def reissue(prompts: DataFrame, trajectories: DataFrame, step: int, uid: str = "uid", status: str = "status", birth: str = "birth") -> tuple[DataFrame, DataFrame]:
    """After a restart: unfinished prompts are born anew and their trajectories deleted."""
    open_ = F.col(status).isin("pending", "running")
    again = prompts.withColumn(birth, F.when(open_, F.lit(step)).otherwise(F.col(birth))).withColumn(status, F.when(open_, "pending").otherwise(F.col(status)))
    return again, trajectories.join(prompts.where(open_).select(uid), uid, "left_anti")


def final_reward(rows: DataFrame, session: list[str], order: str, reward: str) -> DataFrame:
    """A session's last reward on all its rows."""
    w = Window.partitionBy(*session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn(reward, F.last(reward).over(w))


def running_load(events: DataFrame, order: list[str], started: Column, ended: Column, by: list[str]) -> DataFrame:
    """In-flight count after each event of a partition."""
    change = F.when(started, 1).when(ended, -1).otherwise(0)
    return events.withColumn("in_flight", F.sum(change).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def tumbling(events: DataFrame, ts: str, width: str, by: list[str], watermark: str | None = None) -> DataFrame:
    events = events.withWatermark(ts, watermark) if watermark else events
    return events.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def once(events: DataFrame, keys: list[str], ts: str, watermark: str) -> DataFrame:
    """The first row of each key; a key is forgotten when the watermark has passed its row, from when on
    rows as old are too late themselves."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def sliding(events: DataFrame, ts: str, width: str, slide: str, by: list[str]) -> DataFrame:
    return events.groupBy(F.window(ts, width, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, ts: str, gap: str, by: list[str]) -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("last")).select(*by, "start", "last", "n")


def stream_status(tags: DataFrame) -> DataFrame:
    """A streaming view (uid, status, step, n): the newest status of each prompt as events
    come, by applyInPandasWithState; older events don't move it back."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, status, n = state.get if state.exists else (-1, "", 0)
        for f in frames:
            n += len(f)
            top = f.sort_values("seq").iloc[-1]
            if int(top["seq"]) > seq:
                seq, status = int(top["seq"]), str(top["status"])
        state.update((seq, status, n))
        yield pd.DataFrame({"uid": [key[0]], "status": [status], "seq": [seq], "n": [n]})

    return tags.groupBy("uid").applyInPandasWithState(update, "uid bigint, status string, seq bigint, n bigint", "seq bigint, status string, n bigint", "update", "NoTimeout")


def stream_queue(events: DataFrame, most: int) -> DataFrame:
    """A bounded drop-oldest queue per partition in state: after each batch, what it holds
    and how many it has dropped so far."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, dropped = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for f in frames:
            held += [int(x) for x in f.sort_values("seq")["seq"]]
        dropped += max(0, len(held) - most)
        held = held[-most:]
        state.update((held, dropped))
        yield pd.DataFrame({"partition_id": [key[0]], "size": [len(held)], "oldest": [held[0]], "dropped": [dropped]})

    return events.groupBy("partition_id").applyInPandasWithState(update, "partition_id string, size bigint, oldest bigint, dropped bigint", "held array<bigint>, dropped bigint", "update", "NoTimeout")
