"""What dictionary files an index was built from, and whether they have changed since."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 64 << 10
#: Endings of the files a primary file depends on.
SIBLINGS = {
    ".ifo": (".ifo", ".idx", ".idx.gz", ".syn", ".dict", ".dict.dz"),
    ".index": (".index", ".dict", ".dict.dz"),
    ".csv": (".csv",),
    ".dsl": (".dsl",),
    ".dsl.dz": (".dsl.dz",),
}


def sample_hash(stream, size: int) -> int:
    """A hash of the first, the middle and the last 64 KiB and the length; files are rarely changed elsewhere only. Nothing else is read."""
    total = xxhash.xxh64(str(size))
    for at in (0, max(0, (size - SAMPLE) // 2), max(0, size - SAMPLE)):
        stream.seek(at)
        total.update(stream.read(SAMPLE))
    return total.intdigest() - (1 << 63)


def needed_files(dictionaries: DataFrame) -> DataFrame:
    """path (of the primary file), file: all files each dictionary may depend on, whether they exist or not."""
    low = F.lower("path")
    out = None
    for ending, siblings in sorted(SIBLINGS.items(), key=lambda kv: -len(kv[0])):
        own = dictionaries.filter(low.endswith(ending)) if ending != ".dsl" else dictionaries.filter(low.endswith(".dsl"))
        stem = F.expr(f"left(path, length(path) - {len(ending)})")
        one = own.select("path", F.explode(F.array(F.col("path"), *[F.concat(stem, F.lit(s)) for s in siblings if s != ending])).alias("file"))
        out = one if out is None else out.unionByName(one)
    return out


def fingerprints(spark: SparkSession, dictionaries: DataFrame, folder: str) -> DataFrame:
    """path, file, size, modified, hash of all files of the dictionaries below folder; nulls where a file is missing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    listed = files.select("path", F.regexp_replace("path", "^file:/*", "/").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    wanted = listed.join(needed_files(dictionaries).select("file").distinct(), "file", "left_semi")

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        for b in batches:
            out = []
            for path, size in zip(b["path"], b["size"]):
                fs, at = FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                with fs.open_input_file(at) as f:
                    out.append(sample_hash(f, size))
            yield b[["file", "size", "modified"]].assign(hash=out)

    found = wanted.select("path", "file", "size", "modified").mapInPandas(sample, "file string, size bigint, modified timestamp, hash bigint")
    return needed_files(dictionaries).join(found, "file", "left").select("path", "file", "size", "modified", "hash")


def changed(then: DataFrame, now: DataFrame) -> DataFrame:
    """path: dictionaries of which a file is new, gone or different."""
    a, b = (df.select("path", "file", F.xxhash64("size", "modified", "hash", F.col("size").isNull()).alias(n)) for df, n in ((then, "x"), (now, "y")))
    return a.join(b, ["path", "file"], "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select("path").distinct()
