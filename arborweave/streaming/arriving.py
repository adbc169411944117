"""Records, hits and queries that keep arriving (Structured Streaming). An extension: batch results are the reference for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arborweave.operators.record_keys import PART, keyed_records
from arborweave.plans import placement


def stream_of(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    """Parquet files that appear in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def once_per_pos(records: DataFrame, late: str = "7 days") -> DataFrame:
    """Records without repeated deliveries; a copy that comes more than `late` (of read_at) after the first may pass. Rows without pos or read_at are left out."""
    return records.where("pos IS NOT NULL AND read_at IS NOT NULL").withWatermark("read_at", late).dropDuplicatesWithinWatermark(["pos"])


def running_counts(records: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window, field, key, n_records, sum_duplicates) per tag and node in windows of read_at; a window is given out when it is complete.

    Partial sums are formed before the shuffle, so a heavy key is a few rows in it.
    """
    keyed = keyed_records(records.where("read_at IS NOT NULL")).withWatermark("read_at", late)
    counted = keyed.groupBy(F.window("read_at", width), "key").agg(F.count("*").alias("n_records"), F.coalesce(F.sum("num_duplicates"), F.lit(0)).alias("sum_duplicates"))
    return counted.select("window", F.substring_index("key", PART, 1).alias("field"), F.expr(f"substring(key, instr(key, '{PART}') + 1)").alias("key"), "n_records", "sum_duplicates")


def best_hits(hits: DataFrame, late: str = "30 days", width: str = "1 day") -> DataFrame:
    """(window, query, node, score): the best score of each query and node within windows of run_at."""
    rows = hits.where("query IS NOT NULL AND node IS NOT NULL AND score IS NOT NULL AND run_at IS NOT NULL").withWatermark("run_at", late)
    return rows.groupBy(F.window("run_at", width), "query", "node").agg(F.max("score").alias("score"))


def placing(queries: DataFrame, targets: Callable[[], DataFrame], path: str, checkpoint: str, **limits):
    """Starts a stream that places arriving queries (query, node, q_text) at targets() (node, t_text) and appends to a Parquet folder.

    Each micro-batch is written to a folder of its own number, so a batch
    that runs again after a failure replaces what it wrote. targets is asked
    anew for each batch, so placed queries may be added to it meanwhile.
    """

    def place(batch: DataFrame, number: int) -> None:
        pairs = batch.join(targets(), "node").select("query", "node", "q_text", "t_text")
        placement.place_all(pairs, **limits).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(place).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
