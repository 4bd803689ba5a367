"""SRC-4/5/7: batch scans of the driver's parquet tables.

Only the listed columns are selected so the parquet scan's ReadSchema is
pruned; filters written downstream reach the scan as PushedFilters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from intentlane.session import scratch_path

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


_SCHEMAS: dict[str, object] = {}


def table_schema(spark: SparkSession, path: str):
    """The table's schema, inferred from the parquet footers once per path
    and then declared on every later read (inference costs a footer pass per
    read; the views read some tables several times per job)."""
    schema = _SCHEMAS.get(path)
    if schema is None:
        schema = _SCHEMAS[path] = spark.read.parquet(path).schema
    return schema


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    path = table_path(sf_dir, name)
    df = spark.read.schema(table_schema(spark, path)).parquet(path)
    return df.select(*columns) if columns else df


def read_table_stream(spark: SparkSession, path: str, *columns: str,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC-1 replay path: a file stream over parquet with the table's declared
    schema (taken from the footers, no inference). Kafka goes through
    ``intentlane.sources.streams.kafka_behavior`` instead."""
    schema = table_schema(spark, path)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back:
    it is computed once however often it is read, survives lost executors and
    cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """The side of a key join that grows with the tables: both sides are dealt by
    key. Left to its estimate, a pruned, compressed table counts as small, while
    what the driver collects and every worker holds are its unpacked rows, and a
    job per micro-batch sends them again each time."""
    return df.hint("merge")


SCRIPT_SCHEMA = "scenario string, content string, tags string"


def read_scripts_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: a UTF-8 JSON array of {scenario, content, tags} objects, with a
    declared schema (no inference)."""
    return spark.read.option("multiLine", True).option("encoding", "UTF-8") \
        .schema(SCRIPT_SCHEMA).json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 64,
              **props: str) -> DataFrame:
    """SRC-4 / SRC-5 from the operational database: a partitioned JDBC scan
    (``partition_column`` between ``lower`` and ``upper`` split into
    ``num_partitions`` range queries) so no single task reads the table.
    Needs the database's JDBC driver on the classpath."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower)).option("upperBound", str(upper))
                  .option("numPartitions", str(num_partitions)))
    for k, v in props.items():
        reader = reader.option(k, v)
    return reader.load()


def write_behavior_history(behavior: DataFrame, path: str, time_col: str = "event_time") -> str:
    """SRC-7 storage: behaviour history as parquet partitioned by event date,
    so the activity horizon filter prunes whole partitions.

    A write holds whole days: it replaces the days it has and leaves the others,
    so a day that is loaded again does not count twice, and a new day is
    appended. Rows are dealt to tasks by ranges of day, user and event, so a day
    (or a user) with most rows is several tasks and files, each with a narrow
    range of users for row-group pruning. Rows without a time go to the
    default partition, which no horizon reads."""
    from pyspark.sql import functions as F
    dated = behavior.withColumn("event_date", F.to_date(F.col(time_col)))
    order = ["event_date", *[c for c in ("user_id", "event_id") if c in behavior.columns]]
    (dated.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path))
    return path


def read_behavior_history(spark: SparkSession, path: str, since_us: int | None = None) -> DataFrame:
    """SRC-7: the partitioned history; with ``since_us`` only the partitions of
    that day and later ones."""
    from pyspark.sql import functions as F
    history = spark.read.parquet(path)
    return history if since_us is None else history.where(F.col("event_date") >= F.lit(utc_day(since_us)))


def utc_day(t_us: int):
    """The date of an epoch time, whatever the session's time zone."""
    from datetime import datetime, timezone
    return datetime.fromtimestamp(t_us // 1_000_000, tz=timezone.utc).date()


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> str:
    """A catalogue table bucketed and sorted by ``key``: a join on the key reads
    it as it lies, without a shuffle of its side. The other side is dealt to the
    same number of buckets. Choose the buckets for the table's size (about a
    gigabyte each)."""
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", path).format("parquet").saveAsTable(table))
    return table
