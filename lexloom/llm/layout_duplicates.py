"""Duplicates hidden by formatting: one record per headword of a dictionary, with the number of its copies.

Byte-identical raw rows are collapsed first, so that only distinct survivors are brought to canonical form; these are
grouped again on the full canonical text, adding up the counts. Both groupings combine before their shuffle, so a
group that holds a third of all rows costs one row per input partition. Survivors are written once; slots are never collected into a list. Members
get their group by joins whose other side has one row per key; a hot key's rows are then split by adaptive skew joins.

Defined cases: a null word is no headword and belongs to no group; null dict is a dictionary of its own; words
without any letter or digit have the empty bag and form one group per dictionary; a row given twice with the same
slot counts twice but pairs with no slot but others. Columns besides slot, dict and word are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.casefold import casefold
from lexloom.session import cut_lineage

WORDS = r"[\p{L}\p{M}\p{N}]+"


def canonical(word: Column) -> Column:
    """The words after full case folding, in sorted order: layout, case, punctuation and order no longer show."""
    return F.array_join(F.array_sort(F.regexp_extract_all(casefold(word), F.lit(WORDS), F.lit(0))), " ")


def survivors(rows: DataFrame, partition: str = "dict", text: str = "word", key: str = "slot") -> DataFrame:
    """Distinct raw rows with their count, smallest key and canonical text."""
    return (
        rows.filter(F.col(text).isNotNull())
        .groupBy(F.col(partition).alias("part"), F.col(text).alias("raw"))
        .agg(F.count("*").alias("n"), F.min(key).alias("first"))
        .withColumn("canon", canonical(F.col("raw")))
    )


def collapse(rows: DataFrame, partition: str = "dict", text: str = "word", key: str = "slot") -> DataFrame:
    """One record per group: partition, canonical text, smallest key, its number of copies and of layouts."""
    return (
        survivors(rows, partition, text, key)
        .groupBy(F.col("part").alias(partition), "canon")
        .agg(F.min("first").alias(key), F.sum("n").alias("copies"), F.count("*").alias("layouts"))
    )


def duplicate_pairs(rows: DataFrame, partition: str = "dict", text: str = "word", key: str = "slot") -> DataFrame:
    """(key_a, key_b): the smallest key of each group with each other key in it."""
    # written once, as groups and their members both come from it
    alive = cut_lineage(survivors(rows, partition, text, key), "survivors")
    groups = (
        alive.groupBy(F.col("part").alias("g_part"), F.col("canon").alias("g_canon"))
        .agg(F.min("first").alias("key_a"), F.sum("n").alias("copies"))
        .filter("copies > 1")
    )
    placed = alive.join(groups, alive.part.eqNullSafe(groups.g_part) & (alive.canon == groups.g_canon)).select("part", "raw", "n", "first", "key_a")
    layouts = placed.filter("first <> key_a").select("key_a", F.col("first").alias("key_b"))
    # only survivors that stood for several rows are joined back to the rows
    repeated = placed.filter("n > 1").select("part", "raw", "first", "key_a")
    source = rows.select(F.col(partition).alias("r_part"), F.col(text).alias("r_raw"), F.col(key).alias("key_b"))
    copies = (
        source.join(repeated, source.r_part.eqNullSafe(repeated.part) & (source.r_raw == repeated.raw))
        .filter((F.col("key_b") != F.col("first")) & (F.col("key_b") != F.col("key_a")))
        .select("key_a", "key_b")
    )
    return layouts.unionByName(copies)
