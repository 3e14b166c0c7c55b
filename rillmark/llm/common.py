"""What the operators share: durable intermediate tables, salted numbering, inputs."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies; the default of every ``tokenizer`` parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where the session names none (as in tests)
    one of this machine is used, which needs a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame) -> DataFrame:
    """The rows of ``df``, kept in the shared folder so that a lost executor loses none.

    What was shuffled for them isn't needed any more; Spark deletes it once the driver has
    collected its garbage, which is asked for here."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, its session handing Arrow batches of at most 8 MB and 2000 rows to Python; an
    executor holds a batch several times over.  Smaller limits of the session stay."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "64MB", "64m"):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def number_within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each key from 0 without a gap, in no task holding a whole key.

    Rows are dealt by key and a salt of where they lie and of their order columns (so that
    rows alike in all columns part as well), numbered there, and moved on by the counts of
    the smaller salts of their key.  ``df`` must be durable, as it is read twice."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.spark_partition_id(), *order), F.lit(shuffle_width(df.sparkSession))).cast("int"))
    inside = salted.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)).cast("long") - 1)
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    moved = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return inside.join(moved, [*keys, "_salt"]).withColumn(name, F.col(name) + F.col("_before")).drop("_salt", "_before")


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one, so that columns added beside it clash with none."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
