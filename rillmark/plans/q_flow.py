"""Queries: files written and read again, queues, ranks, registries, roll-ups, checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import advantage as A
from ..operators import balance as P
from ..operators import batch as B
from ..operators import dispatch as D
from ..operators import joins as J
from ..operators import masked as K
from ..operators import metrics as M
from ..operators import offpolicy as O
from ..operators import registry as X
from ..sources import files, kv
from ..streaming import queues as S
from .base import TOKENS_SQL, TRAJ_SQL, query, r6, s6, scratch, table, tokens, trajectories

_T = f"WITH {TOKENS_SQL}"
_NUMBERED = "SELECT doc_id, lang, source, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, count(*) OVER () AS n FROM documents"


def numbered(spark, sf):
    return B.with_row_index(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), ["doc_id"])


# ---- files


@query("SELECT item_id, text FROM benchmark")
def atomic_sink(spark, sf):
    path = scratch(spark, "table")
    files.write_table(table(spark, sf, "benchmark"), path)
    return spark.read.parquet(path).select("item_id", "text")


@query("SELECT doc_id, lang, n_chars FROM documents")
def batch_snapshot(spark, sf):
    return files.snapshot(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), scratch(spark, "batch"))


@query("SELECT conv_id % 7 AS step, conv_id, turn, replace(role, 'user', '<mask>') AS role FROM conversations")
def generation_dump(spark, sf):
    """Rows dumped by step and read back, one string masked."""
    path = scratch(spark, "dump")
    files.write_dump(table(spark, sf, "conversations").select((F.col("conv_id") % 7).alias("step"), "conv_id", "turn", "role"), path)
    return files.read_dump(spark, path, mask=("user",)).select("step", "conv_id", "turn", "role")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 7 = 3")
def rollout_replay(spark, sf):
    path = scratch(spark, "rollouts")
    files.write_dump(table(spark, sf, "conversations").select((F.col("conv_id") % 7).alias("step"), "conv_id", "turn"), path)
    return files.replay(spark, path, 3)


@query(f"SELECT o_orderpriority AS name, CAST(o_custkey % 5 AS BIGINT) AS step, {s6('avg(o_totalprice)')} AS value FROM orders GROUP BY ALL")
def metrics_lines(spark, sf):
    path = scratch(spark, "metrics")
    m = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 5).alias("step"), F.col("o_orderpriority").alias("name")).agg(F.avg("o_totalprice").alias("value"))
    files.write_metrics(m, path)
    back = spark.read.schema("step bigint, data map<string, double>").json(path)
    return back.select("step", F.explode("data").alias("name", "value")).select("name", "step", r6("value").alias("value"))


@query("SELECT s AS sink, item_id FROM benchmark, (SELECT unnest(['json', 'parquet']) AS s)")
def metrics_fan_out(spark, sf):
    """The same rows handed to two sinks."""
    path = scratch(spark, "sinks")
    files.fan_out(table(spark, sf, "benchmark").select("item_id"), [lambda df: df.write.json(f"{path}/json"), lambda df: df.write.parquet(f"{path}/parquet")])
    both = [spark.read.schema("item_id bigint").format(k).load(f"{path}/{k}").select(F.lit(k).alias("sink"), "item_id") for k in ("json", "parquet")]
    return both[0].unionByName(both[1])


@query("SELECT toxic AS step, list(lang || ' ' || quality ORDER BY source, lang, quality)[1:3] AS samples FROM labels JOIN documents USING (doc_id) GROUP BY toxic")
def generations_table(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    g = files.generations_table(d.select(F.col("toxic").alias("step"), F.col("source").alias("input"), F.col("lang").alias("output"), F.col("quality").alias("score")), n=3)
    return g.select("step", F.transform("samples", lambda s: F.concat_ws(" ", s["output"], s["score"].cast("string"))).alias("samples"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def wire_roundtrip(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return files.from_wire(files.to_wire(c, "conv_id"), c.schema)


@query("SELECT n_nationkey, n_name FROM nation")
def local_copy(spark, sf):
    folder = scratch(spark, "cache")
    files.cached(spark, f"{sf}/nation.parquet", folder)
    return spark.read.parquet(files.cached(spark, f"{sf}/nation.parquet", folder)).select("n_nationkey", "n_name")


@query("SELECT doc_id, lang FROM documents JOIN labels USING (doc_id)")
def kv_optional_fields(spark, sf):
    """A field that the table lacks is left out."""
    found = kv.get(table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id"), [], "doc_id", ("lang", "absent"))
    return found


@query("""WITH c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS row_idx FROM (SELECT DISTINCT conv_id FROM conversations)), s AS (SELECT * FROM c ORDER BY md5('s:' || row_idx), row_idx LIMIT 20)
SELECT row_idx, role, text AS content FROM s JOIN conversations USING (conv_id)""")
def sft_scan(spark, sf):
    """Conversations written as rows, of which a sample is read."""
    from ..functions.prompts import conversations_of

    path = scratch(spark, "sft")
    conversations_of(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text").orderBy("index").write.parquet(path)
    read = files.read_sft(spark, [path], sample=20, seed="s")
    return read.select("row_idx", F.inline("messages"))


@query("""WITH t AS (SELECT d.doc_id, d.lang, CASE WHEN l.doc_id IS NOT NULL THEN l.toxic ELSE d.n_chars END AS n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang <> 'fr')
SELECT doc_id, lang, n_chars, quality FROM t JOIN (SELECT doc_id FROM documents WHERE n_chars % 3 = 0) USING (doc_id)""")
def keyed_table(spark, sf):
    """Rows put in a table on disk, fields put for some, others cleared, and every third got."""
    d = table(spark, sf, "documents")
    held = kv.KeyedTable(spark, scratch(spark, "keyed"), d.select("doc_id", "lang", "n_chars").schema, "doc_id", parts=16, buckets=4)
    held.put(d.select("doc_id", "lang", "n_chars"))
    held.put(table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("bigint").alias("n_chars"), "quality"))
    held.clear(d.where("lang = 'fr'").select("doc_id"))
    return held.get(d.where("n_chars % 3 = 0").select("doc_id"), ["lang", "n_chars", "quality"], ("absent",))


@query("SELECT text AS prompt, 'yes' AS chosen, 'no' AS rejected FROM benchmark")
def preference_files(spark, sf):
    path = scratch(spark, "pairs") + ".parquet"
    files.write_table(table(spark, sf, "benchmark").select(F.col("text").alias("q"), F.lit("yes").alias("a"), F.lit("no").alias("b")), path)
    return files.read_preferences(spark, [path], "q", "a", "b")


# ---- batches and ranks


@query("SELECT n_nationkey, n_name, n_nationkey AS row_idx FROM nation")
def batch_from_columns(spark, sf):
    n = B.with_row_index(table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    return B.from_columns(spark, B.to_columns(n), "n_nationkey bigint, n_name string")


@query(f"SELECT row_idx, row_number() OVER (ORDER BY md5('q:' || row_idx), row_idx) - 1 AS place FROM ({_NUMBERED}) QUALIFY place >= 20")
def rows_sampler(spark, sf):
    return B.sampler(numbered(spark, sf), "q", 20).select("row_idx", "place")


@query("SELECT k, lcm(k, 6)::BIGINT AS multiple, CAST(ceil(k / 4.0) AS BIGINT) AS ceiled, CAST(ceil(k / 4.0) * 4 AS BIGINT) AS rounded FROM (SELECT n_nationkey + 1 AS k FROM nation)")
def whole_multiples(spark, sf):
    k = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("k"))
    return k.select("k", B.multiple_with(F.col("k"), 6).alias("multiple"), D.ceildiv(F.col("k"), F.lit(4)).alias("ceiled"), D.roundup(F.col("k"), F.lit(4)).alias("rounded"))


@query(f"SELECT row_idx, CAST(row_idx // ((n + 6) // 7) AS INT) AS rank FROM ({_NUMBERED}) WHERE row_idx // ((n + 6) // 7) IN (0, 2, 6)")
def dispatch_chunks(spark, sf):
    """Equal chunks for seven ranks, padded, of which three collect."""
    return D.compute(numbered(spark, sf), "chunks", 7, lambda rows: rows, [0, 2, 6]).select("row_idx", "rank")


@query("SELECT n_nationkey, CAST(r AS INT) AS rank, n_nationkey * (r + 1) AS made FROM nation, range(3) t(r) WHERE r <> 1")
def dispatch_to_all(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey")
    return D.compute(n, "one_to_all", 3, lambda rows: rows.withColumn("made", F.col("n_nationkey") * (F.col("rank") + 1)), [0, 2])


@query(f"""WITH d AS ({_NUMBERED}), p AS (SELECT row_idx AS place, doc_id, n FROM d UNION ALL SELECT n + k, doc_id, n FROM d JOIN range(7) t(k) ON row_idx = k % n WHERE k < (7 - n % 7) % 7), r AS (SELECT *, CAST(place // CAST(ceil(n / 7.0) AS BIGINT) AS INT) AS rank FROM p)
SELECT rank, count(*) AS n, min(doc_id) AS least, CAST(sum(doc_id * (pos + 1)) AS BIGINT) AS folded FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY place) - 1 AS pos FROM r) GROUP BY rank""")
def dispatch_partitions(spark, sf):
    """Seven ranks as partitions; each folds its rows in their order."""
    import numpy as np
    import pyarrow as pa

    def work(rank, batches):
        n, least, folded = 0, [], 0
        for b in batches:
            ids = b.column(b.schema.get_field_index("doc_id")).to_numpy()
            folded += int((ids * (np.arange(len(ids)) + n + 1)).sum())
            least += [int(ids.min())] if len(ids) else []
            n += len(ids)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([rank], pa.int32()), pa.array([n]), pa.array([min(least)]), pa.array([folded])], names=["rank", "n", "least", "folded"])

    return D.on_ranks(D.chunks(numbered(spark, sf), 7), 7, work, "rank int, n long, least long, folded long")


@query("SELECT s_suppkey, CAST(s_suppkey % 3 AS INT) AS rank FROM supplier")
def dispatch_custom(spark, sf):
    """A mode that a user adds."""
    if "by_key" not in X.DISPATCH.held:
        D.mode("by_key", lambda rows, ranks: rows.withColumn("rank", (F.col("s_suppkey") % ranks).cast("int")), lambda rows, ranks: rows.where(F.col("rank").isin(*ranks)))
    return D.compute(table(spark, sf, "supplier").select("s_suppkey"), "by_key", 3, lambda rows: rows)


@query("SELECT r_regionkey AS row_idx, r_name AS name FROM region UNION ALL SELECT n_nationkey + (SELECT count(*) FROM region), n_name FROM nation")
def all_gather(spark, sf):
    parts = [table(spark, sf, t).select(F.col(f"{p}_{t}key").alias("row_idx"), F.col(f"{p}_name").alias("name")) for t, p in (("region", "r"), ("nation", "n"))]
    return D.all_gather(parts)


@query(f"""WITH b AS (SELECT row_idx // 48 AS batch, row_idx, n_chars FROM ({_NUMBERED}))
SELECT batch, count(*) AS rows, sum(n_chars) AS total, CASE WHEN count(*) % 4 = 0 THEN 4 ELSE 1 END AS parts, CAST(ceil(count(*) / CASE WHEN count(*) % 4 = 0 THEN 4.0 ELSE 1 END) AS BIGINT) AS most, true AS light_ends FROM b GROUP BY batch""")
def batch_balance(spark, sf):
    """Batches of 48 in equal parts for four ranks, light rows at both ends of a part; what is
    left at the end and doesn't divide is one rank's."""
    d = numbered(spark, sf).withColumn("batch", F.floor(F.col("row_idx") / 48))
    p = P.partition(d.select("batch", "row_idx", "n_chars"), "batch", "row_idx", "n_chars", lambda s: P.ranks(s, 4 if len(s) % 4 == 0 else 1))
    w = Window.partitionBy("batch", "part")
    p = p.withColumn("light", (F.min_by("n_chars", "place").over(w) == F.min("n_chars").over(w)) & (F.max_by("n_chars", "place").over(w) <= F.max("n_chars").over(w)))
    sums = p.groupBy("batch", "part").agg(F.count_distinct("row_idx").alias("n"), F.sum("n_chars").alias("s"), F.bool_and("light").alias("light"))
    return sums.groupBy("batch").agg(F.sum("n").alias("rows"), F.sum("s").alias("total"), F.count(F.lit(1)).alias("parts"), F.max("n").alias("most"), F.bool_and("light").alias("light_ends"))


# ---- checks


@query("""SELECT 'repeated in base' AS fault, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n UNION ALL SELECT 'repeated in overrides', 0 UNION ALL SELECT 'unknown', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))""")
def merge_faults(spark, sf):
    orders, customers = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return J.merge_faults(orders, customers, ["k"])


@query("SELECT c_custkey, arg_max(o_orderstatus, o_orderkey) AS result, CASE WHEN count(o_orderkey) = 0 THEN 'missing' ELSE 'done' END AS state FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def manifest_results(spark, sf):
    results = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("result"), F.col("o_orderkey").alias("order"))
    return J.manifest_results(table(spark, sf, "customer").select("c_custkey"), results, "c_custkey", "result")


@query("SELECT l_partkey, count(DISTINCT l_returnflag || l_linestatus) AS values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag || l_linestatus) > 1")
def inconsistent_dimensions(spark, sf):
    return J.inconsistent(table(spark, sf, "lineitem"), "l_partkey", ["l_returnflag", "l_linestatus"])


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN (event_id % 9 + 1) / 10.0 END AS low, CASE WHEN user_id % 3 = 0 THEN NULL ELSE (event_id % 9 + 2) / 10.0 END AS high FROM events")
def threshold_bands(spark, sf):
    """Bands, upper bounds, and what is neither (bounds the wrong way round)."""
    k, low, high = F.col("user_id") % 3, ((F.col("event_id") % 9 + 1) / 10).cast("string"), ((F.col("event_id") % 9 + 2) / 10).cast("string")
    text = F.when(k == 0, F.concat_ws("_", high, low)).when(k == 1, F.concat_ws("_", low, high)).otherwise(high)
    return table(spark, sf, "events").select("event_id", O.band_bounds(text).alias("b")).select("event_id", "b.low", "b.high")


@query(f"{_T} SELECT {s6('sum(reward * mask) / sum(mask)')} AS mean FROM tok")
def rank_masked_mean(spark, sf):
    return K.mean_across_ranks(tokens(spark, sf).withColumn("rank", F.col("uid") % 4), "reward", "mask", "rank").select(r6("mean").alias("mean"))


# ---- estimators, weights, draws


@query(f"""{_T}, {TRAJ_SQL}, g AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS m FROM traj WINDOW w AS (PARTITION BY uid))
SELECT traj, 'rloo' AS name, {s6('CASE WHEN n > 1 THEN n * (score - m) / (n - 1) ELSE score END')} AS advantage FROM g UNION ALL SELECT traj, 'rloo_vectorized', {s6('CASE WHEN n > 1 THEN n * (score - m) / (n - 1) ELSE 0 END')} FROM g""")
def advantage_by_name(spark, sf):
    t, out = trajectories(spark, sf), []
    for name in ("rloo", "rloo_vectorized"):
        out.append(A.estimator(name)(t, ["uid"]).select("traj", F.lit(name).alias("name"), r6("advantage").alias("advantage")))
    return out[0].unionByName(out[1])


@query(f"""{_T}, {TRAJ_SQL}, e AS (SELECT max(score) AS hi, min(score) AS lo FROM traj) SELECT traj, {s6('CASE WHEN score IN (hi, lo) THEN 1 ELSE 0 END + 1e-8')} AS extreme, {s6('CASE WHEN score = hi THEN 1 ELSE 0.4 END + 1e-8')} AS top FROM traj, e""")
def preference_weights_of_extremes(spark, sf):
    t = trajectories(spark, sf)
    a = A.resample_weights(t, "score", "max_min").select("traj", r6("weight").alias("extreme"))
    return a.join(A.resample_weights(t, "score", "max_random").select("traj", r6("weight").alias("top")), "traj")


_V = "WITH v AS (SELECT o_custkey, o_totalprice / 1000 AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice)), p AS (SELECT *, pow(i / n, 3) - pow((i - 1) / n, 3) AS b, pow((n - i + 1) / n, 3) - pow((n - i) / n, 3) AS w FROM v)"


@query(f"{_V}, m AS (SELECT o_custkey, sum(x * b) AS mb, sum(x * w) AS mw FROM p GROUP BY 1) SELECT o_custkey, {s6('any_value(mb)')} AS best, {s6('sqrt(sum((x - mb) * (x - mb) * b))')} AS best_std, {s6('sqrt(sum((x - mw) * (x - mw) * w))')} AS worst_std FROM p JOIN m USING (o_custkey) GROUP BY 1")
def bootstrap_expected(spark, sf):
    """Mean and deviation of the best and worst of three draws, in closed form."""
    v = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.col("o_totalprice") / 1000)).alias("v"))
    return v.select("o_custkey", r6(M.best_of_k(F.col("v"), 3)).alias("best"), r6(M.best_of_k_std(F.col("v"), 3)).alias("best_std"), r6(M.best_of_k_std(F.col("v"), 3, worst=True)).alias("worst_std"))


@query(f"""WITH o AS (SELECT o_orderpriority AS g, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
d AS (SELECT g, n, i, j, ((CAST(('0x' || substr(md5('42:' || g || ':' || i || ':' || j), 1, 8)) AS BIGINT)) * n) >> 32 AS place FROM (SELECT DISTINCT g, n FROM o), range(200) a(i), range(4) b(j)),
x AS (SELECT g, i, list(v ORDER BY j) AS l FROM d JOIN o USING (g, place, n) GROUP BY g, i),
r AS (SELECT g, 'max' AS reducer, list_max(l) AS x FROM x UNION ALL SELECT g, 'median', list_median(l) FROM x UNION ALL SELECT g, 'first', l[1] FROM x)
SELECT g AS o_orderpriority, reducer, {s6('avg(x) / 1357')} AS mean, {s6('stddev_pop(x) / 1357')} AS std FROM r GROUP BY ALL""")
def bootstrap_reducers(spark, sf):
    """Any functions over draws that a hash names."""
    middle = lambda a: (F.get(F.array_sort(a), F.lit(1)) + F.get(F.array_sort(a), F.lit(2))) / 2
    found = M.resampled(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", ["o_orderkey"], 4, {"max": F.array_max, "median": middle, "first": lambda a: F.get(a, F.lit(0))}, draws=200)
    return found.select("o_orderpriority", "reducer", r6(F.col("mean") / 1357).alias("mean"), r6(F.col("std") / 1357).alias("std"))


@query(f"""WITH s AS (SELECT o_custkey AS g, o_orderpriority AS vote, o_totalprice / 1357 AS v FROM orders), u AS (SELECT g, vote, count(*) AS c, avg(v) AS m, var_pop(v) AS w FROM s GROUP BY ALL), q AS (SELECT *, c / sum(c) OVER (PARTITION BY g) AS p FROM u),
t AS (SELECT *, sum(p * p) OVER (PARTITION BY g) - p * p AS rest FROM q), chance AS (SELECT g, m, w, 2 AS k, p FROM t UNION ALL SELECT g, m, w, 3, p * p * (1 - p) + p * (1 - rest) FROM t), e AS (SELECT *, sum(p * m) OVER (PARTITION BY g, k) AS mean FROM chance)
SELECT g AS o_custkey, CAST(k AS INT) AS k, {s6('any_value(mean)')} AS mean, {s6('sqrt(sum(p * (w + (m - mean) * (m - mean))))')} AS std FROM e GROUP BY g, k""")
def majority_of_draws(spark, sf):
    """The majority vote among two and three of a customer's orders."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", (F.col("o_totalprice") / 1357).alias("v"))
    found = M.majority_of(o, ["o_custkey"], "o_orderpriority", "v", [2, 3])
    return found.select("o_custkey", "k", r6("mean").alias("mean"), r6("std").alias("std"))


@query("SELECT name, CASE WHEN name LIKE '%timing_s/%' THEN 'sum' WHEN name LIKE '%mean%' THEN 'avg' WHEN name LIKE '%max%' THEN 'max' WHEN name LIKE '%min%' THEN 'min' WHEN name LIKE '%sum%' THEN 'sum' ELSE 'avg' END AS rule FROM (SELECT DISTINCT p || '/' || o_orderpriority || '/' || s AS name FROM orders, (SELECT unnest(['timing_s', 'loss', 'reward_mean']) AS p), (SELECT unnest(['max', 'min', 'sum', 'x']) AS s))")
def asynchronous_rules(spark, sf):
    names = table(spark, sf, "orders").select("o_orderpriority").distinct()
    names = J.expand(J.expand(names, "p", ["timing_s", "loss", "reward_mean"]), "s", ["max", "min", "sum", "x"]).select(F.concat_ws("/", "p", "o_orderpriority", "s").alias("name"))
    return names.select("name", M.async_rule(F.col("name")).alias("rule"))


_ASYNC_NAMES = ["perf/throughput", "perf/total_num_tokens", "perf/time_per_step", "timing_s/gen", "timing_s/step", "timing_s/wait_for_enough_samples", "global_seqlen/minmax_diff", "global_seqlen/max", "global_seqlen/min", "training/global_step", "dynamic_resource/train_compute_time_s", "dynamic_resource/train_allocated_time_s", "actor/loss"]


@query(f"""WITH e AS (SELECT event_id, ({_ASYNC_NAMES})[event_id % {len(_ASYNC_NAMES)} + 1] AS name, value FROM events),
m AS (SELECT name, CASE WHEN name IN ('perf/total_num_tokens', 'perf/time_per_step', 'dynamic_resource/train_compute_time_s', 'dynamic_resource/train_allocated_time_s') OR name LIKE 'timing_s/%' THEN sum(value) WHEN name = 'training/global_step' THEN arg_max(value, event_id) WHEN name LIKE '%minmax%' OR name LIKE '%/max' THEN max(value) WHEN name LIKE '%/min' THEN min(value) ELSE avg(value) END AS v FROM e GROUP BY name),
o AS (SELECT max(v) FILTER (WHERE name = 'perf/total_num_tokens') AS tokens, max(v) FILTER (WHERE name = 'perf/time_per_step') AS seconds, max(v) FILTER (WHERE name = 'timing_s/gen') AS gen, max(v) FILTER (WHERE name = 'timing_s/step') AS step, max(v) FILTER (WHERE name LIKE '%wait_for%') AS wait,
  max(v) FILTER (WHERE name = 'global_seqlen/max') - max(v) FILTER (WHERE name = 'global_seqlen/min') AS spread, max(v) FILTER (WHERE name LIKE '%compute_time_s') / max(v) FILTER (WHERE name LIKE '%allocated_time_s') AS use FROM m),
x AS (SELECT *, least(1.0, wait / step) AS x FROM o),
r AS (SELECT name, v FROM m WHERE name NOT IN ('perf/throughput', 'global_seqlen/minmax_diff') UNION ALL SELECT 'perf/throughput', tokens / (seconds * 8) FROM x UNION ALL SELECT 'global_seqlen/minmax_diff', spread FROM x UNION ALL SELECT 'fully_async/trainer/idle_ratio', gen / step FROM x
  UNION ALL SELECT 'dynamic_resource/train_resource_utilization', use FROM x UNION ALL SELECT 'dynamic_resource/rollout_resource_utilization', 0.75 FROM x UNION ALL SELECT 'dynamic_resource/resource_utilization', ((1 - x) * 6 * use + (x * 6 + 2) * 0.75) / 8 FROM x)
SELECT name, {s6('v')} AS value FROM r""")
def asynchronous_metrics(spark, sf):
    """Events as metrics of steps, rolled up into one set."""
    names = F.element_at(F.array(*map(F.lit, _ASYNC_NAMES)), (F.col("event_id") % len(_ASYNC_NAMES) + 1).cast("int"))
    rows = table(spark, sf, "events").select(F.col("event_id").alias("step"), names.alias("name"), "value")
    return M.asynchronous(rows, 8, hybrid=6, standalone=2, rollout_use=0.75).select("name", r6("value").alias("value"))


# ---- roll-ups


@query("SELECT vec_id, CAST(label % 5 + 1 AS BIGINT) AS response_length, CAST(label % 3 + 2 AS BIGINT) AS prompt_length FROM embeddings")
def response_info(spark, sf):
    ones = lambda n: F.array_repeat(F.lit(1), n)
    mask, prompt = F.concat(ones(F.col("label") % 5 + 1), F.array(F.lit(0))), F.concat(F.array(F.lit(0)), ones(F.col("label") % 3 + 2))
    rows = table(spark, sf, "embeddings").select("vec_id", mask.alias("mask"), F.concat(prompt, mask).alias("attention"))
    return M.response_info(rows, "mask", "attention").select("vec_id", "response_length", "prompt_length")


_P = "SELECT CAST(p_size % 4 AS INT) AS ratio, CASE p_size % 3 WHEN 0 THEN 'crop' WHEN 1 THEN 'pad' END AS mode, p_size % 2 = 0 AS ok, p_size % 5 = 0 AS strict, p_size / 50.0 AS area, p_size * 2 AS padding, p_size % 3 + 1 AS attempts, p_retailprice AS seconds FROM part"


def _parts(spark, sf):
    n = F.col("p_size")
    mode = F.when(n % 3 == 0, "crop").when(n % 3 == 1, "pad")
    return table(spark, sf, "part").select((n % 4).cast("int").alias("ratio"), mode.alias("mode"), (n % 2 == 0).alias("ok"), (n % 5 == 0).alias("strict"), (n / 50.0).alias("area"), (n * 2).alias("padding"), (n % 3 + 1).alias("attempts"), F.col("p_retailprice").alias("seconds"))


@query(f"""WITH p AS ({_P}) SELECT ratio, count(*) FILTER (WHERE mode = 'crop') AS n_crop, count(*) FILTER (WHERE mode = 'pad') AS n_pad, count(*) FILTER (WHERE mode IS NULL) AS n_invalid, {s6("avg(CASE WHEN ok THEN 1.0 ELSE 0 END) FILTER (WHERE mode = 'crop')")} AS crop_rate,
{s6("avg(CASE WHEN strict THEN 1.0 ELSE 0 END) FILTER (WHERE mode = 'crop')")} AS strict_rate, {s6("avg(area) FILTER (WHERE mode = 'crop')")} AS crop_area, {s6("avg(padding) FILTER (WHERE mode = 'pad')")} AS padding FROM p GROUP BY GROUPING SETS ((), (ratio))""")
def layout_summary(spark, sf):
    m = M.summarise(_parts(spark, sf), ["ratio"], M.layout_measures(*(F.col(c) for c in ("mode", "ok", "strict", "area", "padding"))))
    return m.select("ratio", "n_crop", "n_pad", "n_invalid", *(r6(c).alias(c) for c in ("crop_rate", "strict_rate", "crop_area", "padding")))


@query(f"""WITH p AS ({_P}) SELECT ratio, {s6('avg(CASE WHEN ok AND attempts = 1 THEN 1.0 ELSE 0 END)')} AS first_rate, {s6('avg(CASE WHEN ok THEN 1.0 ELSE 0 END)')} AS valid_rate, sum(attempts)::BIGINT AS attempts, sum(padding)::BIGINT AS tokens, round(sum(seconds), 2) + 0.0 AS seconds, {s6('avg(area) FILTER (WHERE ok)')} AS area FROM p GROUP BY GROUPING SETS ((), (ratio))""")
def attempt_summary(spark, sf):
    m = M.summarise(_parts(spark, sf), ["ratio"], M.attempt_measures(*(F.col(c) for c in ("attempts", "ok", "padding", "seconds", "area"))))
    return m.select("ratio", *(r6(c).alias(c) for c in ("first_rate", "valid_rate")), "attempts", "tokens", (F.round("seconds", 2) + F.lit(0.0)).alias("seconds"), r6("area").alias("area"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN '' ELSE p_type || ': x' END AS label FROM part")
def report_labels(spark, sf):
    """The first of the lines that begin with the mark; none, where it stands inside a line."""
    shapes = [("first\nLabel: ", "\nlast Label: no\nLabel: no"), ("first Label: ", "\n Label: no\nlabel: no"), ("Label:\t", ": x")]
    text = F.element_at(F.array(*(F.concat(F.lit(a), "p_type", F.lit(b)) for a, b in shapes)), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", M.label_line(text).alias("label"))


def _report(spark, sf):
    """Answers about parts as lines, of which every fourth size is only cropped."""
    p, k = table(spark, sf, "part"), F.col("p_size") % 4
    cropped, filled = k.isin(0, 1), k.isin(1, 2)
    box = F.when(cropped, F.concat(F.lit("[0.0,0.25,"), (F.col("p_size") / 64).cast("string"), F.lit(",1.0]"))).otherwise("null")
    response = F.concat(F.lit('{"target_ratio":1.5,"is_cropped":'), cropped.cast("string"), F.lit(',"is_filled":'), filled.cast("string"), F.lit(',"crop_box":'), box, F.lit(',"fill_color":'), F.when(filled, "[1,2,3]").otherwise("null"), F.lit("}"))
    content = F.concat(F.lit("Look.\nNews headline:  "), "p_name", F.lit(" \nImage caption: "), "p_type", F.lit("\nImage caption: no"))
    path = scratch(spark, "report")
    p.select(response.alias("response"), F.concat(F.lit("/images/"), F.col("p_partkey").cast("string"), F.lit(".v1.jpg")).alias("image"), F.array(F.struct(content.alias("content"))).alias("messages")).write.json(path)
    return files.read_crop_report(spark, path)


@query("SELECT p_partkey || '.v1' AS image_id, 1.5::DOUBLE AS target_ratio, [0.0, 0.25, p_size / 64.0, 1.0]::DOUBLE[] AS crop_box, trim(p_name) AS title, trim(p_type) AS caption FROM part WHERE p_size % 4 = 0")
def crop_report_details(spark, sf):
    return _report(spark, sf)[0]


@query("SELECT ['crop', 'crop_fill', 'fill', 'keep'][p_size % 4 + 1] AS operation, count(*) AS n FROM part GROUP BY 1")
def crop_report_operations(spark, sf):
    return _report(spark, sf)[1]


# ---- replay


_PROMPTS = "SELECT user_id, CAST(user_id % 3 AS BIGINT) AS partition_id, 500 - user_id % 40 AS birth, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'finished' WHEN 'purchase' THEN 'finished' ELSE 'failure' END AS status FROM events"


def _prompts(spark, sf):
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type").isin("click", "purchase"), "finished").otherwise("failure")
    return table(spark, sf, "events").select("user_id", (F.col("user_id") % 3).cast("bigint").alias("partition_id"), (500 - F.col("user_id") % 40).alias("birth"), status.alias("status"))


@query(f"""WITH p AS ({_PROMPTS}), s AS (SELECT partition_id, count(*) FILTER (WHERE status = 'finished') AS every, count(*) FILTER (WHERE status = 'finished' AND 501 - birth <= 20) AS fresh, coalesce(bool_or(status = 'running' AND 501 - birth >= 40), false) AS late FROM p GROUP BY 1)
SELECT partition_id, 'wait' AS strategy, every AS ready, late AS blocked, NOT late AND every >= 5 AS go FROM s UNION ALL SELECT partition_id, 'drop', fresh, false, fresh >= 5 FROM s""")
def sampling_state(spark, sf):
    p = _prompts(spark, sf)
    out = [S.sampling_state(p, 500, t, 5, k).withColumn("strategy", F.lit(k)) for k, t in (("wait", 40), ("drop", 20))]
    return out[0].unionByName(out[1])


@query("SELECT item_id || '_' || k AS traj_key, CAST(k AS INT) AS session_id, 'pending' AS status FROM benchmark, range(4) t(k)")
def prompt_fan_out(spark, sf):
    return S.fan_out(table(spark, sf, "benchmark").select(F.col("item_id").alias("uid")), 4).select("traj_key", "session_id", "status")


@query(f"WITH p AS ({_PROMPTS}) SELECT user_id AS uid, CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or(status = 'failure') THEN 'failure' ELSE 'finished' END AS status FROM p GROUP BY 1")
def prompt_status(spark, sf):
    return S.group_status(_prompts(spark, sf).withColumnRenamed("user_id", "uid"))


@query(f"WITH p AS ({_PROMPTS}) SELECT partition_id, count(*) FILTER (WHERE status = 'running') + count(*) FILTER (WHERE status = 'finished') >= 64 * 2 AS pause FROM p GROUP BY 1")
def must_pause(spark, sf):
    """By partition: whether as much is in flight and queued as may be."""
    sums = _prompts(spark, sf).groupBy("partition_id").agg(F.count_if(F.col("status") == "running").alias("a"), F.count_if(F.col("status") == "finished").alias("b"))
    return sums.select("partition_id", S.must_pause(F.col("a"), F.col("b"), 64, 1, 1).alias("pause"))


@query(f"WITH d AS ({_NUMBERED}) SELECT doc_id, row_idx, CAST(a // n AS INT) AS epoch, 'pending' AS status, 9 AS birth, sha256('9:' || a) AS uid FROM (SELECT range AS a FROM range(90, 330)) JOIN d ON d.row_idx = a % d.n")
def refill(spark, sf):
    """Whole batches of eight from a place on, past the end of the source."""
    d = numbered(spark, sf).select("row_idx", "doc_id")
    return S.refill(d, d.count(), 90, 240, 8, 9).select("doc_id", "row_idx", "epoch", "status", "birth", "uid")


@query(f"SELECT row_idx, CAST(row_idx // 32 AS INT) AS step, CAST(row_idx % 32 // 8 AS INT) AS trigger FROM ({_NUMBERED})")
def trigger_steps(spark, sf):
    return S.trigger_steps(numbered(spark, sf), 32, 4).select("row_idx", "step", "trigger")


# ---- registries


class Suppliers(X.Rows):
    """Rows of a user's own data set."""

    def read(self, spark):
        return spark.read.parquet(self.path).select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") * self.by).alias("v"))

    def __init__(self, path: str, by: int = 3):
        self.path, self.by = path, by


X.dataset(Suppliers)


@query("SELECT s_suppkey AS k, s_nationkey * 4 AS v FROM supplier")
def dataset_by_name(spark, sf):
    return X.DATASETS.get("Suppliers")(f"{sf}/supplier.parquet", by=4).read(spark)


@X.tool
def unit_price(total: float, count: int) -> float:
    """What one of several costs.

    Args:
        total: what all cost
        count: how many there are
    """
    return round(total / count, 2)


@query("SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN CAST(round(p_size / 4.0, 2) AS DOUBLE) END AS price FROM part")
def tool_by_name(spark, sf):
    """A user's function called with JSON; arguments that it can't take give nothing."""
    arguments = F.concat(F.lit('{"total": '), F.col("p_size").cast("string"), F.lit(', "count": '), F.when(F.col("p_size") % 5 == 0, '"x"').otherwise("4"), F.lit("}"))
    return table(spark, sf, "part").select("p_partkey", X.call_tool("unit_price", arguments).cast("double").alias("price"))


@X.PIPELINES.register("languages")
def _languages(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def pipeline_by_name(spark, sf):
    return X.PIPELINES.get("languages")(spark, sf)
