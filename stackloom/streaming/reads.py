"""Streaming extensions: the stateless and stateful operators over data as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.operators.reads import barcode_neighbours
from stackloom.plans.durable import shared_folder


def event_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_trigger: int | None = 1) -> DataFrame:
    """A stream over the Parquet files of a folder, and over the files of its subfolders of such a name (a table of several files). With None all files are one batch."""
    stream = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    return stream.parquet(f"{folder}/{{{glob}}}")  # in braces, since Spark takes a path without a pattern for a folder


def _timed(events: DataFrame, time: str) -> DataFrame:
    """Watermarks need instants; times without a zone are read in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(events: DataFrame, key: str, time: str = "ts", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """``start, key, n`` by time window; rows later than ``late`` are dropped with their window's state."""
    return _timed(events, time).withWatermark(time, late).groupBy(F.window(time, width), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "key", "n")


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``key, start, end, n``: rows of a key parted by silences of ``gap``."""
    return _timed(events, time).withWatermark(time, late).groupBy(F.session_window(time, gap), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def demultiplexed_stream(reads: DataFrame, barcodes: DataFrame, mismatches: int = 1) -> DataFrame:
    """Streamed reads with the sample of their barcode, by a stream-static join."""
    known = barcode_neighbours(barcodes, mismatches).select("observed", F.col("sample").alias("match"))
    return reads.withColumn("observed", F.upper(F.trim("barcode"))).join(known, "observed", "left")


def dereplicated_stream(reads: DataFrame) -> DataFrame:
    """Running abundance of each sequence of each sample, for update mode."""
    return reads.groupBy("sample", "seq").agg(F.count(F.lit(1)).alias("size"))


def drain(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """All results of a stream over data that is there, as a table that executors write, batch by batch, and the driver never holds. Progress and
    rows are kept in the session's shared checkpoint folder unless another is given; rows are then in ``<folder>-rows``.

    A batch that is run again overwrites its own rows. In complete mode each batch has all results, so the batches before it are removed."""
    spark = stream.sparkSession
    folder = checkpoint or shared_folder(spark, name)
    rows = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}-rows")
    files = rows.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(rows)

    def keep(batch: DataFrame, number: int) -> None:
        own = f"batch-{number}"
        batch.write.mode("overwrite").parquet(f"{folder}-rows/{own}")
        if mode == "complete":
            for x in files.listStatus(rows):
                if x.getPath().getName() != own:
                    files.delete(x.getPath(), True)

    query = stream.writeStream.foreachBatch(keep).queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", folder).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{folder}-rows")
