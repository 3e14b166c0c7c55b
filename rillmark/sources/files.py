"""Files in and out: prompt and preference tables, dumps by step, metrics, histograms."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FORMATS = {".parquet": "parquet", ".json": "json", ".jsonl": "json"}


def read_files(spark: SparkSession, paths: list[str], schema: str | None = None, multiline: bool = False) -> DataFrame:
    """Rows of files in the order given (``file_order`` says which), format by extension;
    another extension is an error.  Columns a file lacks are null."""
    out = None
    for k, path in enumerate(paths):
        kind = _FORMATS.get(os.path.splitext(path)[1])
        if kind is None:
            raise ValueError(f"unsupported file format: {path}")
        reader = spark.read.schema(schema) if schema else spark.read
        part = (reader.option("multiLine", multiline).json(path) if kind == "json" else reader.parquet(path)).withColumn("file_order", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def read_preferences(spark: SparkSession, paths: list[str], prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    return read_files(spark, paths).select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"))


def probe(df: DataFrame) -> DataFrame:
    """(column, type, rows, nulls) of each column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *(F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in df.columns))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("_rows").alias("rows"), F.col(f"`{c}`").alias("nulls")) for c, t in df.dtypes))
    return counts.select(F.inline(each))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet with zstd; committed as a whole by Spark's commit protocol."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_dump(df: DataFrame, path: str, step_col: str = "step") -> None:
    """JSON lines partitioned by step."""
    df.write.mode("append").partitionBy(step_col).json(path)


def read_dump(spark: SparkSession, path: str, mask: tuple[str, ...] = (), mask_with: str = "<mask>") -> DataFrame:
    """A dump, its steps as numbers in order, with the strings ``mask`` replaced in text columns."""
    df = spark.read.json(path)
    for c, t in df.dtypes:
        if t == "string":
            for m in mask:
                df = df.withColumn(c, F.replace(F.col(c), F.lit(m), F.lit(mask_with)))
    return df.withColumn("step", F.col("step").cast("bigint")).orderBy("step")


def write_metrics(df: DataFrame, path: str) -> None:
    """One line per step: {"step": s, "data": {name: value}}.  Of a name given twice in a step the
    largest value counts; a null name has no place in a line."""
    single = df.where("name IS NOT NULL").groupBy("step", "name").agg(F.max("value").alias("value"))
    rows = single.groupBy("step").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("data"))
    rows.write.mode("append").json(path)


def generations_table(samples: DataFrame, step: str = "step", n: int | None = None) -> DataFrame:
    """(step, samples array<struct<input, output, score>>) of logged generations, in input order."""
    from pyspark.sql import Window

    one = F.struct("input", "output", "score")
    if n:  # of a step only the first n meet in a task
        samples = samples.withColumn("_place", F.row_number().over(Window.partitionBy(step).orderBy("input", "output", "score"))).where(F.col("_place") <= n)
    return samples.groupBy(step).agg(F.array_sort(F.collect_list(one)).alias("samples"))


def value_histogram(df: DataFrame, by: str, value: str) -> DataFrame:
    """Counts of each value by step, with the running total over steps."""
    from pyspark.sql import Window

    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("running", F.sum("n").over(Window.partitionBy(value).orderBy(by)))


def fan_out(df: DataFrame, sinks: list) -> list[int]:
    """Hand the same rows to several sinks (callables), and tell how many each was given.

    Rows are counted as they flow into a sink's own job, and computed once for all."""
    from pyspark import StorageLevel
    from pyspark.sql import Observation

    held, counts = df.persist(StorageLevel.DISK_ONLY), []
    try:
        for sink in sinks:
            seen = Observation()
            sink(held.observe(seen, F.count(F.lit(1)).alias("n")))
            counts.append(seen.get["n"])
    finally:
        held.unpersist()
    return counts


def responses_by_row(generated: DataFrame, row: str, response: str, order: str) -> DataFrame:
    """Gather a row's responses into an array, in order."""
    return generated.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, response))), lambda x: x[response]).alias("responses"))


def cached(spark: SparkSession, source: str, folder: str) -> str:
    """A local copy of a remote file or folder, named by the md5 of where it came from; one of the
    same size that is there already is used again.  Any scheme that Hadoop knows will do."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    there = path(source)
    here = path(f"{folder}/{hashlib.md5(source.encode()).hexdigest()}/{there.getName()}")
    a, b = there.getFileSystem(conf), here.getFileSystem(conf)
    size = a.getContentSummary(there).getLength()
    if not (b.exists(here) and b.getContentSummary(here).getLength() == size):
        b.delete(here, True)
        jvm.org.apache.hadoop.fs.FileUtil.copy(a, there, b, here, False, conf)
        if b.getContentSummary(here).getLength() != size:
            raise OSError(f"{source}: the copy has another size")
    return here.toString()


def read_crop_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(details, operations) of JSON lines (response, image, messages): of answers that only crop the
    image, its name, ratio, box and what the prompt's lines call it; and how many answers say each
    operation.  An answer that can't be read is an error, and so is an image and ratio given twice."""
    from ..functions.parsers import crop_fill, operation_of

    lines = spark.read.schema("response string, image string, messages array<struct<content string>>").json(path)
    plan = crop_fill(F.col("response"))
    plan = F.when(plan.isNotNull(), plan).otherwise(F.raise_error(F.concat(F.lit("an answer that can't be read: "), F.coalesce("response", F.lit("none")))))
    rows = lines.withColumn("plan", plan).withColumn("operation", operation_of(F.col("plan.is_cropped"), F.col("plan.is_filled")))
    field = lambda label: F.trim(F.regexp_extract(F.coalesce(F.get("messages", F.lit(0))["content"], F.lit("")), rf"(?m)^{label}:\s*(.*)$", 1))
    stem = F.regexp_replace(F.substring_index("image", "/", -1), r"(?<=.)\.[^.]*$", "")
    crops = rows.where("operation = 'crop'").select(stem.alias("image_id"), F.col("plan.ratio").alias("target_ratio"), F.col("plan.crop_box").alias("crop_box"), field("News headline").alias("title"), field("Image caption").alias("caption"))
    once = crops.groupBy("image_id", "target_ratio").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("crop_box", "title", "caption")).alias("x"))
    said = F.concat(F.lit("given twice: "), F.col("image_id"), F.lit(" at "), F.col("target_ratio").cast("string"))
    details = once.select(F.when(F.col("n") == 1, F.col("image_id")).otherwise(F.raise_error(said)).alias("image_id"), "target_ratio", "x.*")
    return details, rows.groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


def read_sft(spark: SparkSession, paths: list[str], messages: str = "messages", optional: tuple[str, ...] = ("tools", "enable_thinking"), sample: int | None = None, seed: str | None = None) -> DataFrame:
    """(row_idx, messages, ...): conversations to learn from, of Parquet files in the order of their names
    and rows, with the optional columns that are there and no others.

    ``sample`` keeps so many rows: the first, or with a seed those that come first by its hash.
    Conversations that are null stay, as rows of their own; a file without ``messages`` is an error."""
    from ..operators.batch import IDX, BatchError, subsample, with_row_index

    rows = spark.read.parquet(*paths)
    if messages not in rows.columns:
        raise BatchError(f"no column {messages} in {paths}")
    kept = [F.col(messages).alias("messages"), *(F.col(c) for c in optional if c in rows.columns)]
    placed = rows.select(*kept, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    numbered = with_row_index(placed, ["_file", "_at"], IDX).drop("_file", "_at")
    return numbered if sample is None else subsample(numbered, sample, seed)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Keep a batch on disk and read it again."""
    write_table(df, path, "overwrite")
    return df.sparkSession.read.parquet(path)


def to_wire(df: DataFrame, by: str) -> DataFrame:
    """(by, n, data): the rows of each key as one Arrow stream."""

    def run(rows: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        return pa.table({by: rows.column(by).slice(0, 1), "n": pa.array([rows.num_rows], pa.int64()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return df.groupBy(by).applyInArrow(run, f"{by} {dict(df.dtypes)[by]}, n bigint, data binary")


def from_wire(wire: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of Arrow streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield from pa.ipc.open_stream(data.as_buffer())

    return wire.select("data").mapInArrow(run, schema)


def replay(spark: SparkSession, path: str, step: int) -> DataFrame:
    """The rollout that was dumped at a step, in place of generating one; none is an error."""
    rows = spark.read.json(path).where(F.col("step").cast("bigint") == step).drop("step")
    if rows.isEmpty():
        raise ValueError(f"nothing was dumped at step {step}")
    return rows
