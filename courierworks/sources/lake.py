"""Hour-partitioned Parquet lakes of positions and events: write, read, compact, check."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courierworks.functions.num import round_half_up
from courierworks.operators.keyed import join_checked, row_hash
from courierworks.sources.schemas import EVENT_LAKE, HOUR_PARTS, POSITION_LAKE, POSITION_LAKE_COLUMNS

ROWS_PER_FILE = 2_000_000


def with_hour_parts(df: DataFrame) -> DataFrame:
    """Year, month, day and hour (UTC) of `ts`; rows without a time get NULL and so the default partition."""
    return df.withColumns({"year": F.year("ts"), "month": F.month("ts"), "day": F.dayofmonth("ts"), "hour": F.hour("ts")})


def _spread(df: DataFrame, parts: list[str], rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Rows of every partition together, in as many equal pieces as it needs files, so a full hour is no single task."""
    pieces = df.groupBy(*parts).count().select(*[F.coalesce(F.col(p).cast("string"), F.lit("")).alias(f"__k_{p}") for p in parts],
                                               F.ceil(F.col("count") / rows_per_file).alias("__n"))
    keyed = df.withColumns({f"__k_{p}": F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts})
    joined = join_checked(keyed, pieces, [f"__k_{p}" for p in parts], "left")
    piece = F.pmod(row_hash(df), F.greatest(F.col("__n"), F.lit(1)))
    return joined.withColumn("__piece", piece).repartition(*parts, "__piece").drop("__piece", "__n", *[f"__k_{p}" for p in parts])


def write_position_lake(positions: DataFrame, root: str, mode: str = "append") -> None:
    rows = with_hour_parts(positions.select(*POSITION_LAKE_COLUMNS))
    _spread(rows, HOUR_PARTS).sortWithinPartitions(*HOUR_PARTS, "courier_id", "ts").write.mode(mode).option(
        "compression", "snappy").partitionBy(*HOUR_PARTS).parquet(root)


def write_event_lake(wide: DataFrame, root: str, mode: str = "append") -> None:
    parts = ["topic", *HOUR_PARTS]
    _spread(with_hour_parts(wide), parts).write.mode(mode).option("compression", "snappy").partitionBy(*parts).parquet(root)


def hours_between(start: datetime, end: datetime) -> Column:
    """Predicate on the partition columns alone, so that only the hours of the window are listed and read."""
    stamp = F.col("year") * 1000000 + F.col("month") * 10000 + F.col("day") * 100 + F.col("hour")
    number = lambda t: t.year * 1000000 + t.month * 10000 + t.day * 100 + t.hour
    return stamp.between(number(start), number(end))


def _in_window(df: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    if start is None or end is None:
        return df
    start, end = min(start, end), max(start, end)
    return df.where(hours_between(start, end) & (F.col("ts") >= F.lit(start)) & (F.col("ts") <= F.lit(end)))


def read_position_lake(spark: SparkSession, root: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    return _in_window(spark.read.schema(POSITION_LAKE).parquet(root), start, end)


def read_event_lake(spark: SparkSession, root: str, topics: list[str] | None = None, start: datetime | None = None,
                    end: datetime | None = None) -> DataFrame:
    rows = spark.read.schema(EVENT_LAKE).parquet(root)
    if topics:
        rows = rows.where(F.col("topic").isin(topics))
    return _in_window(rows, start, end)


def _newest_hours(spark: SparkSession, root: str, n: int) -> list[str]:
    """Hour folders of a lake, newest first; only folder names are listed, no file is opened."""
    files = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found: list[str] = []

    def children(path: str, name: str) -> list[str]:
        listed = [s.getPath() for s in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)) if s.isDirectory()]
        numbered = [(int(p.getName().split("=")[1]), p.toString()) for p in listed if p.getName().startswith(f"{name}=") and p.getName().split("=")[1].isdigit()]
        return [path for _, path in sorted(numbered, reverse=True)]

    for year in children(root, "year"):
        for month in children(year, "month"):
            for day in children(month, "day"):
                found += children(day, "hour")
                if len(found) >= n:
                    return found[:n]
    return found


def latest_event_time(spark: SparkSession, root: str, newest_hours: int = 8) -> datetime | None:
    """Newest `ts` of a lake, looked for in the newest hours first and in the whole lake only when those have none."""
    hours = _newest_hours(spark, root, newest_hours)
    if hours:
        found = spark.read.schema(POSITION_LAKE).option("basePath", root).parquet(*hours).agg(F.max("ts")).first()[0]
        if found is not None:
            return found
    return spark.read.schema(POSITION_LAKE).parquet(root).agg(F.max("ts")).first()[0]


def data_files(spark: SparkSession, root: str) -> DataFrame:
    """Path and length of the Parquet files under a root, without hidden and unfinished ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    return files.select("path", "length").where(~F.col("path").rlike(r"/\.[^/]*$") & ~F.col("path").endswith(".tmp.parquet"))


def lake_stats(spark: SparkSession, root: str) -> DataFrame:
    return data_files(spark, root).agg(F.count("*").alias("files"), round_half_up(F.coalesce(F.sum("length"), F.lit(0)) / 1048576.0, 3).alias("megabytes"))


def quarantine_scan(spark: SparkSession, root: str) -> DataFrame:
    """Every data file with `problem` where no row of it can be read: broken files, and files without rows, which lose nothing."""
    # A column that no file has: only footers are read.
    rows = spark.read.schema("__none int").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(root)
    seen = rows.select(F.col("_metadata.file_path").alias("__path")).distinct()
    files = data_files(spark, root)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    joined = files.withColumn("__file", plain("path")).join(seen.select(plain("__path").alias("__file"), F.lit(True).alias("__good")), "__file", "left")
    return joined.select("path", "length", F.when(F.col("__good").isNull(), F.lit("unreadable")).alias("problem"))


def read_valid(spark: SparkSession, root: str, scan: DataFrame, schema=None) -> DataFrame:
    """The rows of all files that the scan found readable."""
    if schema is None:
        good = scan.where("problem IS NULL").select("path").orderBy("path").first()
        if good is None:
            raise ValueError(f"no readable file under {root}")
        schema = spark.read.parquet(good["path"]).schema
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(root).withColumn("__path", F.col("_metadata.file_path"))
    bad = scan.where("problem IS NOT NULL").select(F.col("path").alias("__path"))
    return join_checked(rows, bad, ["__path"], "left_anti").drop("__path")


def compact_partitions(spark: SparkSession, source: str, target: str, parts: list[str], rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Rewrite a lake with as few files per partition as its size allows; returns a one-row report."""
    before = data_files(spark, source).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).first()
    rows = spark.read.parquet(source)
    _spread(rows, parts, rows_per_file).write.mode("overwrite").option("compression", "snappy").partitionBy(*parts).parquet(target)
    after = data_files(spark, target).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).first()
    counts = rows.count(), spark.read.parquet(target).count()
    report = [(before["files"], after["files"], round((before["files"] - after["files"]) / max(before["files"], 1) * 100, 1),
               before["bytes"], after["bytes"], counts[0], counts[1], counts[0] == counts[1])]
    return spark.createDataFrame(report, "files_before long, files_after long, files_reduced_pct double, bytes_before long, bytes_after long, "
                                         "rows_before long, rows_after long, row_count_ok boolean")


def register_views(spark: SparkSession, positions_root: str, events_root: str) -> None:
    """SQL views `gps_events` and `copilot_events` over the two lakes."""
    read_position_lake(spark, positions_root).createOrReplaceTempView("gps_events")
    read_event_lake(spark, events_root).createOrReplaceTempView("copilot_events")


def newest_rows(lake: DataFrame, n: int = 20) -> DataFrame:
    return lake.orderBy(F.desc("ts")).limit(n)
