"""Headwords that arrive as files: keys are derived as they come, and the index grows by appended parquet."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexloom.operators.index import KEYED, keyed, version_of


def read_arrivals(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream over parquet files of headwords as they are dropped into a folder."""
    return spark.readStream.schema(schema).parquet(path)


def first_arrivals(stream: DataFrame, lateness: str = "30 days") -> DataFrame:
    """The stream without slots that came before, by loaded_at; state is kept for as long as rows can be late."""
    return stream.withWatermark("loaded_at", lateness).dropDuplicatesWithinWatermark(["slot"])


def append_to_index(stream: DataFrame, path: str, checkpoint: str, lateness: str | None = None) -> StreamingQuery:
    """Adds keyed headwords to the newest version of the index at path; ends when all files there are taken.

    Each batch has a folder of its number that is written anew if the batch is run again after a failure, so its rows
    are there once. With lateness, slots that came before within that time are left out. A rebuild from all headwords
    brings index and manifest together again.
    """
    version = version_of(stream.sparkSession, path)
    if version is None:
        raise ValueError(f"no index at {path}")
    rows = stream if lateness is None else first_arrivals(stream, lateness)
    own = f"{zlib.crc32(checkpoint.encode()):08x}"

    def add(batch: DataFrame, number: int) -> None:
        keyed(batch).select(*KEYED).sortWithinPartitions("bare_key", "slot").write.mode("overwrite").parquet(f"{version}/arrivals/batch-{own}-{number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
