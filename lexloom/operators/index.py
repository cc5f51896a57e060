"""The merged index of headwords: slots, keys, order; written as sorted parquet in versions that never change.

An index is a folder of versions. Each has its own folder, `headwords-<time>-<id>`, with the keyed headwords, what they were
written from (files with size and time, rows and checksums by dictionary), and a manifest that is written last; a
version without one is no version. Readers take the newest whole version, so they see the old one while a new one is
being written, and never half of one. Rows that arrive later stand beside the headwords, by batch.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.keys import with_keys
from lexloom.session import delete

KEYED = ("dict", "idx", "slot", "word", "is_alias", "entry_id", "fold_key", "bare_key", "fold_class", "plain", "marks", "optional")
#: What rows of an index depend on.
SOURCE = ("dict", "idx", "slot", "word", "is_alias", "entry_id")
#: Versions kept beside the newest, for those who still read them.
KEPT = 1


def slot_bases(headwords: DataFrame) -> DataFrame:
    """dict, headwords, base: the first slot of each dictionary when all lists are laid end to end in dict order.

    The counts are one row per dictionary, so the running sum over all of them is small.
    """
    counts = headwords.groupBy("dict").agg(F.count("*").alias("headwords"))
    before = Window.orderBy("dict").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum("headwords").over(before), F.lit(0)))


def with_slots(headwords: DataFrame) -> DataFrame:
    """headwords (dict, idx, ...) with slot = base of the dictionary + idx."""
    return headwords.join(slot_bases(headwords).select("dict", "base"), "dict").withColumn("slot", F.col("base") + F.col("idx")).drop("base")


def _source(headwords: DataFrame) -> DataFrame:
    """The columns an index is made of; optional ones that are missing come out as false or null."""
    present = set(headwords.columns)
    df = headwords if "is_alias" in present else headwords.withColumn("is_alias", F.lit(False))
    df = df if "entry_id" in present else df.withColumn("entry_id", F.lit(None).cast("bigint"))
    df = df if "idx" in present else df.withColumn("idx", F.col("slot"))
    return df.select("dict", "idx", "slot", "word", F.coalesce("is_alias", F.lit(False)).alias("is_alias"), "entry_id").filter("word is not null")


def keyed(headwords: DataFrame) -> DataFrame:
    """headwords with their keys."""
    return with_keys(_source(headwords)).select(*KEYED)


def merged_order(keyed_headwords: DataFrame) -> DataFrame:
    """All headwords sorted by (bare_key, slot) over the whole cluster: range partitions, sorted within."""
    return keyed_headwords.repartitionByRange("bare_key", "slot").sortWithinPartitions("bare_key", "slot")


def _state(headwords: DataFrame) -> DataFrame:
    """dict, headwords, checksum: what an index must have been written from to be current, over all its columns."""
    one = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in SOURCE]).cast("decimal(20,0)")
    return _source(headwords).groupBy("dict").agg(F.count("*").alias("headwords"), F.sum(one).cast("string").alias("checksum"))


def _files(headwords: DataFrame) -> dict[str, tuple[int, int]]:
    """Size and time of the files that headwords are read from, as the file system tells them; none if they come from elsewhere."""
    spark = headwords.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    out = {}
    for name in headwords.inputFiles():
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = at.getFileSystem(conf).getFileStatus(at)
        out[name] = (status.getLen(), status.getModificationTime())
    return out


def versions(spark: SparkSession, path: str) -> list[str]:
    """The folders of all whole versions, oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(root):
        return []
    names = sorted(x.getPath().getName() for x in fs.listStatus(root) if x.getPath().getName().startswith("headwords-"))
    return [f"{path}/{n}" for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/manifest/_SUCCESS"))]


def version_of(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest whole version."""
    return next(reversed(versions(spark, path)), None)


def write(headwords: DataFrame, path: str) -> str:
    """Writes a version of the index, sorted by key, so that a prefix reads few row groups; returns its folder."""
    spark = headwords.sparkSession
    at = f"{path}/headwords-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    files = _files(headwords)
    merged_order(keyed(headwords)).write.option("parquet.block.size", 8 << 20).parquet(f"{at}/rows")
    spark.createDataFrame([(f, n, t) for f, (n, t) in files.items()], "file string, size bigint, modified bigint").write.parquet(f"{at}/files")
    _state(headwords).coalesce(1).write.parquet(f"{at}/manifest")
    for old in versions(spark, path)[: -1 - KEPT]:
        delete(spark, old)
    return at


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """dict, headwords, checksum of the newest version; None if there is no whole index at path."""
    at = version_of(spark, path)
    return None if at is None else spark.read.schema("dict int, headwords bigint, checksum string").parquet(f"{at}/manifest")


def is_current(spark: SparkSession, headwords: DataFrame, path: str) -> bool:
    """Whether the newest version was written from these headwords.

    If whole files are read and all are as they were, that is enough; else the rows are compared by their checksums.
    """
    at = version_of(spark, path)
    if at is None:
        return False
    if _whole_files(headwords) and (now := _files(headwords)):
        then = {r.file: (r["size"], r.modified) for r in spark.read.parquet(f"{at}/files").collect()}
        if now == then:
            return True
    now, then = _state(headwords), manifest(spark, path)
    return now.exceptAll(then).isEmpty() and then.exceptAll(now).isEmpty()


def _whole_files(headwords: DataFrame) -> bool:
    """Whether headwords are files as they are, without any filter, limit, join or change."""
    return headwords._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The newest version with all batches that arrived since it was written."""
    at = version_of(spark, path)
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/arrivals")
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    later = [x.getPath().toString() for x in fs.listStatus(root)] if fs.exists(root) else []
    whole = [p for p in later if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))]
    return spark.read.parquet(f"{at}/rows", *sorted(whole))


def open_or_build(spark: SparkSession, headwords: DataFrame, path: str) -> DataFrame:
    """The index at path, rebuilt first if it is missing, broken or of other headwords."""
    if not is_current(spark, headwords, path):
        write(headwords, path)
    return open_index(spark, path)


def figures(spark: SparkSession, headwords: DataFrame, path: str) -> DataFrame:
    """headwords, dictionaries, bytes, versions, open_ms: size of the newest version, and what opening it costs while it is current."""
    began = time.perf_counter()
    open_or_build(spark, headwords, path)
    took = (time.perf_counter() - began) * 1000
    at = spark._jvm.org.apache.hadoop.fs.Path(version_of(spark, path))
    size = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(at).getLength()
    held = manifest(spark, path).agg(F.coalesce(F.sum("headwords"), F.lit(0)).alias("headwords"), F.count("*").alias("dictionaries"))
    return held.select("headwords", "dictionaries", F.lit(size).alias("bytes"), F.lit(len(versions(spark, path))).alias("versions"), F.lit(took).alias("open_ms"))
