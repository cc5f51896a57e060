"""Discovery of dictionary files: what a path is, which are excluded, which repeat another."""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Endings of the primary file of each format.
ENDINGS = {"StarDict": (".ifo",), "Bgl": (".bgl",), "Dsl": (".dsl", ".dsl.dz"), "Csv": (".csv",), "Dictd": (".index",)}
SUPPORTED = ("StarDict", "Dictd", "Csv", "Dsl")
SETTINGS = "path string, name string, short string, cfg_order bigint, scope boolean, language string"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def classify(path: Column) -> Column:
    """The format whose primary file a path is; null for all other files."""
    name = F.lower(file_name(path))
    out = F.when(F.lit(False), F.lit(None))
    for kind, endings in ENDINGS.items():
        for e in endings:
            out = out.when(name.endswith(e), kind)
    return out


def label_of(path: Column) -> Column:
    """The folder a file lies in; of a file without folder its name without ending."""
    parts = F.split(path, "/")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    return F.coalesce(F.when(folder != "", folder), F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", ""))


def included(files: DataFrame, excludes: DataFrame) -> DataFrame:
    """Files (path) under none of the excluded paths (path); whole components count, not strings.

    A file is tried with each of its parent paths, so this is an equi-join.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    stopped = files.select("path", F.explode(above).alias("above")).join(excludes.select(F.regexp_replace("path", "/+$", "").alias("above")), "above", "left_semi")
    return files.join(stopped.select("path").distinct(), "path", "left_anti")


def without_packed_twins(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Files without each X.dsl.dz beside which there is X.dsl, as a file or (folders: path) as a folder."""
    taken = files.filter(F.lower("path").endswith(".dsl")).select("path")
    if folders is not None:
        taken = taken.unionByName(folders.select("path"))
    packed = F.when(F.lower("path").endswith(".dsl.dz"), F.expr("left(path, length(path) - 3)")).otherwise(F.lit(None))
    twins = files.withColumn("twin", packed).join(taken.select(F.col("path").alias("twin")), "twin", "left_semi").select("path")
    return files.join(twins, "path", "left_anti")


def discovered(files: DataFrame, excludes: DataFrame | None = None, settings: DataFrame | None = None, folders: DataFrame | None = None) -> DataFrame:
    """dict, path, format, derived, label, short, language, scope, cfg_order: all dictionaries among the files.

    They are numbered by folder name without case, then by path.
    """
    df = files.select("path").distinct()
    df = df if excludes is None else included(df, excludes)
    df = df.withColumn("format", classify(F.col("path"))).filter(F.col("format").isin(*SUPPORTED)).withColumn("derived", label_of(F.col("path")))
    df = without_packed_twins(df, folders)
    settings = settings if settings is not None else files.sparkSession.createDataFrame([], SETTINGS)
    number = F.row_number().over(Window.orderBy(F.lower("derived"), "path")) - 1
    return df.join(settings, "path", "left").select(
        number.alias("dict"), "path", "format", "derived", F.coalesce("name", "derived").alias("label"), "short", "language", F.coalesce("scope", F.lit(True)).alias("scope"), "cfg_order"
    )


def list_files(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """(files, folders) with path below local roots. Symbolic links aren't taken, unreadable folders are skipped."""
    files, folders = [], []
    for root in roots:
        for at, inner, names in os.walk(root, onerror=None, followlinks=False):
            folders += [(os.path.join(at, d),) for d in inner]
            files += [(p,) for n in names if not os.path.islink(p := os.path.join(at, n)) and os.path.isfile(p)]
    return spark.createDataFrame(files, "path string"), spark.createDataFrame(folders, "path string")


def read_config(spark: SparkSession, text: str) -> tuple[list[str], DataFrame, DataFrame]:
    """(roots, excludes, settings) from TOML text with dictionary_dirs and tables dictionary."path"."""
    config = tomllib.loads(text)
    dirs = config.get("dictionary_dirs", [])
    rows = [(p, s.get("name"), s.get("short"), s.get("order"), s.get("scope"), s.get("language")) for p, s in config.get("dictionary", {}).items()]
    excludes = spark.createDataFrame([(d[1:],) for d in dirs if d.startswith("!")], "path string")
    return [d for d in dirs if not d.startswith("!")], excludes, spark.createDataFrame(rows, SETTINGS)


def scan(spark: SparkSession, config: str) -> DataFrame:
    """All dictionaries a configuration names; see discovered."""
    roots, excludes, settings = read_config(spark, config)
    files, folders = list_files(spark, roots)
    return discovered(files, excludes, settings, folders)


def b64_value(text: Column) -> Column:
    """dictd's base-64 numbers, digit by digit without Python; null for other characters and beyond a BIGINT."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    digits = F.transform(F.split(text, ""), lambda c: F.when(c != "", F.instr(alphabet, c) - 1))
    value = F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0).cast("bigint"), lambda n, d: F.try_add(F.try_multiply(n, F.lit(64).cast("bigint")), d.cast("bigint")))
    return F.when(text.rlike(r"^[A-Za-z0-9+/]*\z"), value)
