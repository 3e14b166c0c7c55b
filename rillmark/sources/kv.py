"""A keyed table with appendable columns: get, optional fields, put, clear; of rows, and on disk."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get(table: DataFrame, keys: DataFrame, fields: list[str], key: str = "key", optional: tuple[str, ...] = ()) -> DataFrame:
    """``fields`` of the keys asked, in one join; optional fields only where they exist."""
    chosen = [*fields, *(c for c in optional if c in table.columns)]
    return keys.join(table.select(key, *chosen), key)


def put(table: DataFrame, fresh: DataFrame, key: str = "key") -> DataFrame:
    """Write fields of existing keys: new columns are appended, present ones overwritten
    where ``fresh`` has the key."""
    new = [c for c in fresh.columns if c != key]
    told = fresh.select(key, F.struct(*new).alias("_fresh"))
    joined = table.join(told, key, "left")
    kept = [c for c in table.columns if c not in new]
    written = [F.when(F.col("_fresh").isNotNull(), F.col(f"_fresh.{c}")).otherwise(F.col(c) if c in table.columns else F.lit(None)).alias(c) for c in new]
    return joined.select(*kept, *written)


def clear(table: DataFrame, uids: DataFrame, uid: str = "uid") -> DataFrame:
    """Drop the rows of prompts: their own and all their trajectories'."""
    return table.join(uids.select(uid).distinct(), uid, "left_anti")


class KeyedTable:
    """A keyed table on disk: Parquet in ``parts`` folders by a hash of the key, each bucketed by the
    key, so that ``get`` moves the keys asked and not the table, and ``put`` and ``clear`` rewrite the
    folders of the keys that they touch and no others.

    A key may have several rows (a prompt's trajectories): all of them are got, written and cleared.
    A write replaces its folders when its job commits; one writer at a time.  The session's catalogue
    holds the table's name only, so another session opens the same ``path`` with the same options.
    Null keys can't be kept; writing one is an error."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "key", parts: int = 64, buckets: int = 16):
        self.spark, self.path, self.key, self.parts, self.buckets = spark, path, key, parts, buckets
        self.name = f"keyed_{hashlib.md5(path.encode()).hexdigest()}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, _part INT) USING parquet PARTITIONED BY (_part) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
        self._folder("").mkdirs(self._at(""))
        spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _folder(self, name: str):
        """The file system of a folder of the table."""
        return self._at(name).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop("_part")

    def get(self, keys: DataFrame, fields: list[str], optional: tuple[str, ...] = ()) -> DataFrame:
        """``get`` of the rows on disk."""
        return get(self.rows(), keys, fields, self.key, optional)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _touched(self, keys: DataFrame) -> list[int]:
        """The folders of some keys; as many numbers as there are folders, at most."""
        nulls = F.count_if(F.col(self.key).isNull())
        told = keys.groupBy(self._part().alias("part")).agg(nulls.alias("nulls")).collect()
        if any(r["nulls"] for r in told):
            raise ValueError(f"{self.key} is null")
        return sorted(r["part"] for r in told)

    def put(self, fresh: DataFrame) -> None:
        """Write fields of keys: keys that aren't there become rows, new fields columns."""
        new = [f for f in fresh.schema if f.name not in self.rows().columns]
        if new:
            self.spark.sql(f"ALTER TABLE {self.name} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
        touched = self._touched(fresh)
        held = self.rows_of(touched)
        told = fresh.select(self.key, F.struct(*(c for c in fresh.columns if c != self.key)).alias("_fresh"))
        both = held.join(told, self.key, "full")
        chosen = [F.when(F.col("_fresh").isNotNull(), F.col(f"_fresh.{c}")).otherwise(F.col(c)).alias(c) if c in fresh.columns and c != self.key else F.col(c) for c in held.columns]
        self._replace(both.select(*chosen), [])

    def clear(self, keys: DataFrame) -> None:
        """Drop all rows of some keys."""
        touched = self._touched(keys)
        left = self.rows_of(touched).join(keys.select(self.key).distinct(), self.key, "left_anti")
        still = {r["part"] for r in left.select(self._part().alias("part")).distinct().collect()}
        self._replace(left, [k for k in touched if k not in still])

    def rows_of(self, parts: list[int]) -> DataFrame:
        return self.spark.table(self.name).where(F.col("_part").isin(*parts)).drop("_part")

    def _replace(self, rows: DataFrame, emptied: list[int]) -> None:
        """Write the folders that the rows belong to anew, and drop those left without any."""
        placed = rows.withColumn("_part", self._part()).repartition(self.parts, "_part")
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            placed.write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set(mode, before)
        for part in emptied:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (_part = {part})")
            self._folder(f"_part={part}").delete(self._at(f"_part={part}"), True)
        self.spark.catalog.refreshTable(self.name)
