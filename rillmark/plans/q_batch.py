"""Queries: scans, batch algebra, arrays, joins, balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrays as R
from ..operators import balance as P
from ..operators import batch as B
from ..operators import joins as J
from ..sources import files, kv
from .base import query, r6, s6, table

_DOCS = "SELECT doc_id, lang, source, n_chars, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_idx FROM documents"


def docs(spark, sf):
    return B.with_row_index(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), ["doc_id"])


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def parquet_scan(spark, sf):
    d = files.read_files(spark, [f"{sf}/lineitem.parquet"])
    return d.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id AS row, list(text ORDER BY turn) AS responses FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def generation_join_back(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'").withColumnRenamed("conv_id", "row")
    return files.responses_by_row(c, "row", "text", "turn")


@query("""SELECT 'doc_id' AS "column", count(*) AS rows, count(*) FILTER (WHERE doc_id IS NULL) AS nulls FROM labels UNION ALL SELECT 'quality', count(*), count(*) FILTER (WHERE quality IS NULL) FROM labels UNION ALL SELECT 'toxic', count(*), count(*) FILTER (WHERE toxic IS NULL) FROM labels""")
def schema_probe(spark, sf):
    return files.probe(table(spark, sf, "labels")).select("column", "rows", "nulls")


@query("SELECT quality AS step, toxic AS value, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY toxic ORDER BY quality) AS BIGINT) AS running FROM labels GROUP BY quality, toxic")
def filtered_value_histogram(spark, sf):
    return files.value_histogram(table(spark, sf, "labels").select(F.col("quality").alias("step"), F.col("toxic").alias("value")), "step", "value")


@query("SELECT doc_id, n_chars, quality FROM labels JOIN documents USING (doc_id)")
def kv_get(spark, sf):
    return kv.get(table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality"), ["n_chars"], "doc_id", ("absent",)).select("doc_id", "n_chars", "quality")


@query("SELECT d.doc_id, d.lang, CASE WHEN l.doc_id IS NOT NULL THEN l.quality END AS quality, CASE WHEN l.doc_id IS NOT NULL THEN l.toxic ELSE d.n_chars END AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def kv_put(spark, sf):
    fresh = table(spark, sf, "labels").select("doc_id", "quality", F.col("toxic").cast("bigint").alias("n_chars"))
    return kv.put(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), fresh, "doc_id").select("doc_id", "lang", "quality", "n_chars")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def kv_clear(spark, sf):
    gone = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return kv.clear(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("SELECT doc_id, lang FROM documents")
def batch_select(spark, sf):
    return B.select(table(spark, sf, "documents"), ["doc_id", "lang"])


@query(f"SELECT row_idx, n_chars FROM ({_DOCS})")
def batch_pop(spark, sf):
    return B.pop(docs(spark, sf), ["n_chars"])[0]


@query(f"SELECT row_idx, doc_id AS id, lang AS language, source, n_chars FROM ({_DOCS})")
def batch_rename(spark, sf):
    return B.rename(docs(spark, sf), ["doc_id", "lang"], ["id", "language"])


@query(f"SELECT row_idx, doc_id, lang, source, n_chars, n_chars * 2 AS twice FROM ({_DOCS})")
def batch_union(spark, sf):
    d = docs(spark, sf)
    return B.union(d, d.select("row_idx", "lang", (F.col("n_chars") * 2).alias("twice")))


@query(f"SELECT 'lang' AS \"column\", count(*) FILTER (WHERE row_idx % 7 = 0 AND lang <> 'xx') AS conflicts FROM ({_DOCS})")
def batch_union_conflicts(spark, sf):
    d = docs(spark, sf)
    return B.union_conflicts(d, d.select("row_idx", F.when(F.col("row_idx") % 7 == 0, "xx").otherwise(F.col("lang")).alias("lang")))


@query(f"""SELECT 'doc_id' AS "column", count(doc_id) AS non_null, count(DISTINCT doc_id) AS "distinct" FROM ({_DOCS}) UNION ALL SELECT 'lang', count(lang), count(DISTINCT lang) FROM ({_DOCS})""")
def batch_report(spark, sf):
    return B.column_report(docs(spark, sf).select("doc_id", "lang")).select("column", "non_null", "distinct")


@query("""WITH a AS (SELECT doc_id, lang, source FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'xx' ELSE lang END AS lang, source FROM documents UNION ALL SELECT doc_id, lang, source FROM documents WHERE doc_id % 25 = 1),
d AS (SELECT doc_id, lang, source, sum(n) AS n FROM (SELECT *, 1 AS n FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL) SELECT CASE WHEN n > 0 THEN 'a' ELSE 'b' END AS side, CAST(abs(n) AS BIGINT) AS rows, doc_id, lang, source FROM d WHERE n <> 0""")
def batch_differences(spark, sf):
    """Two versions of a batch: what only one has, or more often."""
    a = table(spark, sf, "documents").select("doc_id", "lang", "source")
    b = a.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "xx").otherwise(F.col("lang"))).unionByName(a.where("doc_id % 25 = 1"))
    return B.row_differences(a, b)


@query(f"SELECT row_idx, doc_id FROM ({_DOCS}) WHERE row_idx >= 10 AND row_idx < 100 AND (row_idx - 10) % 3 = 0")
def rows_slice(spark, sf):
    return B.slice_rows(docs(spark, sf), 10, 100, 3).select("row_idx", "doc_id")


@query(f"SELECT new_idx, doc_id FROM (VALUES (0, 5), (1, 3), (2, 5), (3, 0)) p(new_idx, row_idx) JOIN ({_DOCS}) USING (row_idx)")
def rows_take(spark, sf):
    return B.take_rows(docs(spark, sf), [5, 3, 5, 0]).select("new_idx", "doc_id")


@query(f"SELECT (SELECT count(*) FROM documents) - 1 - row_idx AS row_idx, doc_id FROM ({_DOCS})")
def rows_reorder(spark, sf):
    d = docs(spark, sf)
    n = d.count()
    return B.reorder(d, d.select((F.lit(n - 1) - F.col("row_idx")).alias("new_idx"), "row_idx")).select("row_idx", "doc_id")


@query(f"SELECT row_idx, doc_id FROM ({_DOCS}) UNION ALL SELECT row_idx + (SELECT count(*) FROM documents), doc_id FROM ({_DOCS})")
def rows_concat(spark, sf):
    d = docs(spark, sf).select("row_idx", "doc_id")
    return B.concat([d, d])


@query(f"SELECT row_idx * 3 + k AS row_idx, doc_id FROM ({_DOCS}), (SELECT unnest([0, 1, 2]) AS k)")
def rows_repeat_interleaved(spark, sf):
    return B.repeat(docs(spark, sf), 3).select("row_idx", "doc_id")


@query(f"SELECT k * (SELECT count(*) FROM documents) + row_idx AS row_idx, doc_id FROM ({_DOCS}), (SELECT unnest([0, 1, 2]) AS k)")
def rows_repeat_blocks(spark, sf):
    return B.repeat(docs(spark, sf), 3, interleave=False).select("row_idx", "doc_id")


@query(f"SELECT doc_id, CAST(k AS INT) AS copy FROM ({_DOCS}) JOIN range(4) r(k) ON k < row_idx % 5")
def rows_repeat_each(spark, sf):
    return B.repeat_each(docs(spark, sf), F.col("row_idx") % 5).select("doc_id", "copy")


@query(f"SELECT row_idx, CAST(floor(row_idx / ((SELECT count(*) FROM documents) // 4)) AS INT) AS chunk FROM ({_DOCS})")
def rows_chunk(spark, sf):
    d = docs(spark, sf)
    return B.chunk(d, 4, d.count(), rest=True).select("row_idx", "chunk")


@query(f"SELECT row_idx, CAST(row_idx // 7 AS INT) AS piece FROM ({_DOCS})")
def rows_split(spark, sf):
    return B.split(docs(spark, sf), 7).select("row_idx", "piece")


@query(f"WITH n AS (SELECT count(*) AS n FROM documents) SELECT row_idx, CAST(row_idx // (n // 7) AS INT) AS chunk FROM ({_DOCS}), n WHERE row_idx < n - n % 7")
def rows_split_even(spark, sf):
    d = docs(spark, sf)
    return B.split_even(d, 7, d.count()).select("row_idx", "chunk")


@query("SELECT vec_id * 4 + k AS row_idx, CAST(label AS INT) AS label, round(list_sum(list_transform(embedding[k * 16 + 1 : k * 16 + 16], lambda v: CAST(v AS DOUBLE))), 5) + 0.0 AS total FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS k)")
def rows_unfold_columns(spark, sf):
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_idx")
    rows = B.unfold_columns(e, ["embedding"], 4)
    return rows.select("row_idx", "label", (F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double")), 5) + F.lit(0.0)).alias("total"))


@query(f"SELECT row_idx // 3 AS row_idx, list(doc_id ORDER BY row_idx) AS doc_id FROM ({_DOCS}) GROUP BY 1")
def rows_fold(spark, sf):
    return B.fold(docs(spark, sf), 3, ["doc_id"])


@query(f"SELECT row_idx, doc_id FROM ({_DOCS})")
def rows_fold_unfold(spark, sf):
    return B.unfold(B.fold(docs(spark, sf), 3, ["doc_id"]), 3, ["doc_id"])


@query(f"WITH n AS (SELECT count(*) AS n FROM documents) SELECT row_idx, doc_id, false AS is_pad FROM ({_DOCS}) UNION ALL SELECT row_idx + n, doc_id, true FROM ({_DOCS}), n WHERE row_idx < (37 - n % 37) % 37")
def rows_pad_cyclic(spark, sf):
    d = docs(spark, sf)
    return B.pad_to_multiple(d, 37, d.count()).select("row_idx", "doc_id", "is_pad")


@query(f"WITH n AS (SELECT count(*) AS n FROM documents) SELECT row_idx, doc_id FROM ({_DOCS}) UNION ALL SELECT n + k, doc_id FROM ({_DOCS}), n, (SELECT unnest([0, 1]) AS k) WHERE row_idx = n - 1")
def rows_pad_last(spark, sf):
    d = docs(spark, sf)
    return B.pad_rows(d, 2, d.count(), last=True).select("row_idx", "doc_id")


@query(f"WITH k AS (SELECT e AS epoch, row_idx, row_number() OVER (PARTITION BY e ORDER BY md5('s:' || e || ':' || row_idx), row_idx) - 1 AS p FROM ({_DOCS}), (SELECT unnest([0, 1]) AS e)) SELECT CAST(epoch AS INT) AS epoch, row_idx, CAST(p // 50 AS INT) AS batch FROM k")
def rows_mini_batches(spark, sf):
    d = docs(spark, sf)
    return B.mini_batches(d, 50, 2, "s", d.count(), rest=True).select("epoch", "row_idx", "batch")


@query(f"SELECT row_idx FROM ({_DOCS}) ORDER BY md5('s:' || row_idx), row_idx LIMIT 25")
def rows_subsample(spark, sf):
    return B.subsample(docs(spark, sf), 25, "s").select("row_idx")


@query(f"SELECT row_idx, doc_id FROM ({_DOCS}) WHERE row_idx % 4 = 1")
def rows_stride(spark, sf):
    return B.stride(docs(spark, sf), 1, 4).select("row_idx", "doc_id")


@query("SELECT conv_id, list(role ORDER BY turn) AS role FROM conversations GROUP BY conv_id")
def rows_collate(spark, sf):
    return B.collate(table(spark, sf, "conversations"), "conv_id", ["role"], "turn")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 5)")
def complete_groups(spark, sf):
    return B.complete_groups(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", 5).select("o_orderkey")


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 20")
def oldest_rows(spark, sf):
    return B.oldest(table(spark, sf, "events"), "ts", "event_id", 20).select("event_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'The') OR contains(source, 'The')")
def search_rows(spark, sf):
    return B.search(table(spark, sf, "documents"), "The", ["text", "source"]).select("doc_id")


@query("SELECT vec_id, round(list_sum(list_transform(embedding[1:5], lambda v: CAST(v AS DOUBLE))) + list_sum(list_transform(embedding[60:64], lambda v: CAST(v AS DOUBLE))), 5) + 0.0 AS total FROM embeddings")
def truncate_middle(spark, sf):
    x = R.pad_or_truncate(F.col("embedding").cast("array<double>"), 10, F.lit(0.0), truncation="middle")
    return table(spark, sf, "embeddings").select("vec_id", (F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 5) + F.lit(0.0)).alias("total"))


@query("SELECT conv_id, CASE WHEN len(r) >= 4 THEN r[len(r) - 3:] ELSE list_concat(list_transform(range(4 - len(r)), lambda x: 'pad'), r) END AS roles FROM (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)")
def pad_left(spark, sf):
    c = B.collate(table(spark, sf, "conversations"), "conv_id", ["role"], "turn")
    return c.select("conv_id", R.pad_or_truncate(F.col("role"), 4, F.lit("pad"), truncation="left").alias("roles"))


@query("SELECT conv_id, list_transform(r, lambda x, i: CASE WHEN list_position(r, 'assistant') IS NULL OR list_position(r, 'assistant') = 0 OR i <= list_position(r, 'assistant') THEN 1 ELSE 0 END) AS mask FROM (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)")
def mask_to_first_end(spark, sf):
    c = B.collate(table(spark, sf, "conversations"), "conv_id", ["role"], "turn")
    return c.select("conv_id", R.mask_to_eos(F.col("role"), F.lit("assistant")).alias("mask"))


@query("SELECT doc_id, 24576 * n_chars + n_chars * n_chars AS work FROM documents")
def workload(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.workload(F.col("n_chars")).alias("work"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'label' || l.quality ELSE d.lang END AS lang, l.doc_id IS NOT NULL AS replaced FROM documents d LEFT JOIN labels l USING (doc_id)")
def keyed_upsert(spark, sf):
    fresh = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("label"), F.col("quality").cast("string")).alias("lang"))
    return J.upsert(table(spark, sf, "documents").select("doc_id", "lang"), fresh, ["doc_id"], ["lang"])


@query("SELECT event_id, CASE WHEN NOT v THEN 'rejected' WHEN row_number() OVER (PARTITION BY user_id, v ORDER BY ts DESC, event_id) = 1 THEN 'kept' ELSE 'superseded' END AS state FROM (SELECT *, coalesce(value >= 10, false) AS v FROM events)")
def latest_wins(spark, sf):
    return J.latest(table(spark, sf, "events"), ["user_id"], "ts", "event_id", F.col("value") >= 10).select("event_id", "state")


@query("SELECT min(doc_id) AS doc_id, count(*) - 1 AS duplicates FROM documents GROUP BY md5(text), lang")
def first_wins_dedup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("h"))
    return J.first_wins(d, ["h", "lang"], ["doc_id"]).select("doc_id", "duplicates")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 1)")
def conflict_rejection(spark, sf):
    return J.without_conflicts(table(spark, sf, "lineitem"), "l_orderkey", "l_linestatus").select("l_orderkey", "l_linenumber")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def lookup_join(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return J.lookup(table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k")), n, "k").select("s_suppkey", "n_name")


@query("SELECT p_partkey, ratio FROM part, (SELECT unnest([0.5, 1.0, 1.5, 2.0]::DOUBLE[]) AS ratio)")
def cross_expansion(spark, sf):
    return J.expand(table(spark, sf, "part").select("p_partkey"), "ratio", [0.5, 1.0, 1.5, 2.0])


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def run_coverage(spark, sf):
    return J.coverage(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT md5(text) AS h, count(DISTINCT source) AS splits, count(*) AS rows FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def split_leakage(spark, sf):
    return J.leakage(table(spark, sf, "documents").select(F.md5("text").alias("h"), "source"), "h", "source")


@query("""WITH r AS (SELECT l_orderkey AS task, l_linestatus AS run, min(l_linenumber) AS label FROM lineitem GROUP BY ALL), b AS (SELECT task, label FROM r WHERE run = 'F')
SELECT r.task, r.run, CASE WHEN r.label < b.label THEN 'win' WHEN r.label > b.label THEN 'loss' ELSE 'tie' END AS outcome FROM r JOIN b USING (task) WHERE r.run <> 'F'""")
def paired_runs(spark, sf):
    r = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("task"), F.col("l_linestatus").alias("run")).agg(F.min("l_linenumber").alias("label"))
    return J.paired_runs(r, "task", "run", "label", "F")


@query("""SELECT o_custkey AS task, max(CASE WHEN o = 0 THEN p END) AS first, max(CASE WHEN o = 1 THEN p END) AS second, coalesce(max(CASE WHEN o = 0 THEN p END) = max(CASE WHEN o = 1 THEN p END), false) AS stable
FROM (SELECT o_custkey, CAST(o_orderkey % 2 AS INT) AS o, o_orderstatus AS p FROM orders) GROUP BY 1""")
def two_order_judgments(spark, sf):
    j = table(spark, sf, "orders").select(F.col("o_custkey").alias("task"), (F.col("o_orderkey") % 2).alias("o"), F.col("o_orderstatus").alias("p"))
    return J.both_orders(j, "task", "o", "p")


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'judged' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'generated' ELSE 'pending' END AS status FROM customer")
def task_progress(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return J.task_status(table(spark, sf, "customer").select("c_custkey"), o, o.where("o_orderstatus = 'F'"), "c_custkey")


@query("WITH k AS (SELECT s_suppkey, row_number() OVER (ORDER BY md5('h:' || s_suppkey), s_suppkey) AS k, count(*) OVER () AS n FROM supplier) SELECT s_suppkey, CASE WHEN k <= greatest(1, floor(n * 0.3)) THEN 'validation' ELSE 'train' END AS split FROM k")
def seeded_holdout(spark, sf):
    return J.seeded_holdout(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", "h", 0.3)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return J.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_BATCHES = f"SELECT row_idx // 50 AS batch, row_idx % 50 AS i, row_idx, n_chars FROM ({_DOCS})"


def _differencing(weight: str, parts: str) -> str:
    """Largest differencing, one merge a step: nodes in falling order of (spread, largest part)."""
    node = lambda p: f"{{'spread': {p}[1].s - {p}[-1].s, 'top': {p}[1], 'parts': {p}}}"
    return f"""WITH RECURSIVE d AS MATERIALIZED ({_BATCHES}), b AS (SELECT batch, {parts} AS k FROM d GROUP BY batch),
i AS (SELECT batch, k, list_prepend({{'s': {weight}, 'n': 1::BIGINT, 'p': [i]::BIGINT[]}}, list_transform(range(1, k), lambda _: {{'s': 0::BIGINT, 'n': 0::BIGINT, 'p': []::BIGINT[]}})) AS q FROM d JOIN b USING (batch)),
g AS (SELECT batch, k, list_sort(list({node('q')}), 'DESC') AS h FROM i GROUP BY batch, k UNION ALL
  SELECT batch, k, list_sort(list_append(h[3:], {node('q')}), 'DESC') FROM (SELECT batch, k, h, list_sort(list_transform(range(1, k + 1), lambda j: {{'s': h[1].parts[j].s + h[2].parts[k + 1 - j].s, 'n': h[1].parts[j].n + h[2].parts[k + 1 - j].n, 'p': list_concat(h[1].parts[j].p, h[2].parts[k + 1 - j].p)}}), 'DESC') AS q FROM g WHERE len(h) > 1)),
e AS (SELECT batch, k, unnest(h[1].parts) AS x, unnest(range(k)) AS part FROM g WHERE len(h) = 1)"""


def _items(parts):
    """(batch, part, items): which rows of a batch are in each of its parts that has any."""
    return parts.groupBy("batch", F.col("part").cast("bigint").alias("part")).agg(F.array_sort(F.collect_list(F.col("row_idx") % 50)).alias("items"))


@query(f"{_differencing('n_chars', '4::BIGINT')} SELECT batch, part, list_sort(x.p) AS items FROM e WHERE len(x.p) > 0")
def karmarkar_karp(spark, sf):
    d = docs(spark, sf).withColumn("batch", F.floor(F.col("row_idx") / 50))
    return _items(P.partition(d.select("batch", "row_idx", "n_chars"), "batch", "row_idx", "n_chars", lambda s: P.differencing(s, 4)))


@query(f"""{_differencing('(24576 * n_chars + n_chars * n_chars)', 'greatest(least(count(*), CAST(ceil(sum(n_chars) / 40000.0) AS BIGINT)), 1)')},
o AS (SELECT batch, k, list_sort(x.p) AS items, row_number() OVER (PARTITION BY batch ORDER BY x.s DESC, list_min(x.p) DESC) AS r FROM e)
SELECT batch, CAST(CASE WHEN r % 2 = 1 THEN (k + 1) // 2 - (r + 1) // 2 ELSE (k + 1) // 2 + r // 2 - 1 END AS BIGINT) AS part, items FROM o WHERE len(items) > 0""")
def dynamic_micro_batches(spark, sf):
    d = docs(spark, sf).withColumn("batch", F.floor(F.col("row_idx") / 50))
    return _items(P.partition(d.select("batch", "row_idx", "n_chars"), "batch", "row_idx", "n_chars", lambda s: P.micro_batches(s, 40_000)))


@query(f"""WITH RECURSIVE d AS MATERIALIZED ({_BATCHES}), g(batch, i, sums) AS (SELECT DISTINCT batch, 0::BIGINT, [0, 0, 0, 0]::BIGINT[] FROM d
UNION ALL SELECT g.batch, g.i + 1, list_transform(g.sums, lambda s, k: CASE WHEN k = list_position(g.sums, list_min(g.sums)) THEN s + d.n_chars ELSE s END) FROM g JOIN d ON d.batch = g.batch AND d.i = g.i)
SELECT batch, sums FROM g WHERE i = (SELECT count(*) FROM d x WHERE x.batch = g.batch)""")
def greedy_partition(spark, sf):
    g = B.collate(docs(spark, sf).withColumn("batch", F.floor(F.col("row_idx") / 50)), "batch", ["n_chars"])
    return g.select("batch", P.greedy_sums(F.col("n_chars"), 4).alias("sums"))


@query("WITH s AS (SELECT doc_id // 20 AS part, sum(n_chars) AS s FROM documents GROUP BY 1) SELECT min(s) AS min, max(s) AS max, round(avg(s), 6) + 0.0 AS mean FROM s")
def balance_stats(spark, sf):
    d = table(spark, sf, "documents").withColumn("part", F.floor(F.col("doc_id") / 20))
    return P.balance_stats(d, "part", "n_chars").select("min", "max", r6("mean").alias("mean"))
