"""The collection of dictionaries: order, scope, labels, counts; and the definitions of rows.

Tables of dictionaries have one row each and stay small, so windows over all of them are fine.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.language import OTHER, group, quantity, starts_a_sense, thousands


def reading_order(dictionaries: DataFrame) -> DataFrame:
    """dict, rank (from 0): those with an order first, by it; the others by label without case; ties by number."""
    order = Window.orderBy(F.col("cfg_order").isNull(), "cfg_order", F.lower(F.coalesce("label", F.lit(""))), "dict")
    return dictionaries.select("dict", (F.row_number().over(order) - 1).alias("rank"))


def repaired_order(asked: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """dict, rank of an order asked for (pos, dict): first mentions in order, then what it leaves out; unknown ones dropped."""
    first = asked.join(dictionaries.select("dict"), "dict", "left_semi").groupBy("dict").agg(F.min("pos").alias("pos")).withColumn("rest", F.lit(0))
    missing = dictionaries.select("dict").join(first, "dict", "left_anti").select("dict", F.col("dict").cast("bigint").alias("pos"), F.lit(1).alias("rest"))
    both = first.select("dict", F.col("pos").cast("bigint").alias("pos"), "rest").unionByName(missing)
    return both.select("dict", (F.row_number().over(Window.orderBy("rest", "pos")) - 1).alias("rank"))


def scopes(dictionaries: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """dict, scope: by settings (path, scope) if given, else by the column; true where nothing is said."""
    if settings is None:
        return dictionaries.select("dict", F.coalesce("scope", F.lit(True)).alias("scope"))
    return dictionaries.drop("scope").join(settings.select("path", "scope"), "path", "left").select("dict", F.coalesce("scope", F.lit(True)).alias("scope"))


def headword_counts(headwords: DataFrame) -> DataFrame:
    return headwords.groupBy("dict").agg(F.count("*").alias("headwords"))


def scope_size(dictionaries: DataFrame, headwords: DataFrame) -> DataFrame:
    """One row: dicts and words in scope, all dicts, and whether every dictionary is turned off."""
    known = scopes(dictionaries).join(headword_counts(headwords), "dict", "left")
    on = F.col("scope")
    return known.agg(
        F.count(F.when(on, 1)).alias("dicts"),
        F.coalesce(F.sum(F.when(on, F.coalesce("headwords", F.lit(0)))), F.lit(0)).alias("words"),
        F.count("*").alias("all_dicts"),
    ).withColumn("nothing_selected", (F.col("all_dicts") > 0) & (F.col("dicts") == 0))


def _of_all() -> Column:
    return F.concat(F.col("dicts").cast("string"), F.lit(" of "), quantity(F.col("all_dicts"), "dictionary", "dictionaries"))


def library_size(size: DataFrame) -> DataFrame:
    """The line for an empty query, from scope_size."""
    named = F.when(F.col("dicts") < F.col("all_dicts"), _of_all()).otherwise(quantity(F.col("dicts"), "dictionary", "dictionaries"))
    return size.select(F.concat(quantity(F.col("words"), "word", "words"), F.lit(" · "), named).alias("line"))


def status(size: DataFrame, rows: int, truncated: bool, fold_forms: bool) -> DataFrame:
    """The line under a result, from scope_size."""
    n = F.lit(rows)
    line = F.concat(thousands(n), F.lit("+ results")) if truncated else quantity(n, "result", "results")
    scoped = F.when(F.col("dicts") < F.col("all_dicts"), F.concat(line, F.lit(" · "), _of_all())).otherwise(line)
    return size.select((F.concat(scoped, F.lit(" · forms folded")) if fold_forms else scoped).alias("line"))


def repeated_labels(dictionaries: DataFrame, label: str = "label") -> DataFrame:
    """label, n: labels held by more than one dictionary."""
    return dictionaries.groupBy(label).agg(F.count("*").alias("n")).filter(f"n > 1 and {label} is not null")


def file_stem(path: Column) -> Column:
    """The name of a file without its last ending; a leading dot is no ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def disambiguated(dictionaries: DataFrame) -> DataFrame:
    """dict, label: repeated labels give way to the dictionary's own name, else get the file's stem; two rounds."""
    df = dictionaries.select("dict", "path", "name", "label")
    for _ in range(2):
        n = F.count("*").over(Window.partitionBy("label"))
        own = F.trim(F.coalesce("name", F.lit("")))
        better = F.when((own != "") & (own != F.col("label")), own).otherwise(F.concat("label", F.lit(" ("), file_stem(F.col("path")), F.lit(")")))
        df = df.withColumn("label", F.when(n > 1, better).otherwise(F.col("label")))
    return df.select("dict", "label")


def language_groups(dictionaries: DataFrame) -> DataFrame:
    """dict, language, position: by language in alphabetical order, OTHER last, within each in reading order."""
    grouped = dictionaries.join(reading_order(dictionaries), "dict").select("dict", "rank", group(F.col("name"), F.col("language")).alias("language_group"))
    order = Window.orderBy(F.col("language_group") == OTHER, "language_group", "rank")
    return grouped.select("dict", "language_group", (F.row_number().over(order) - 1).alias("position"))


def shelf(dictionaries: DataFrame, headwords: DataFrame) -> DataFrame:
    """All dictionaries as the scope command shows them: rank, dict, label, short, scope, headwords."""
    return (
        dictionaries.select("dict", "label", "short", "format")
        .join(reading_order(dictionaries), "dict")
        .join(scopes(dictionaries), "dict")
        .join(headword_counts(headwords), "dict", "left")
        .select("rank", "dict", "label", "short", "format", "scope", F.coalesce("headwords", F.lit(0)).alias("headwords"))
    )


def entries_of(definitions: DataFrame, keep_empty: DataFrame | None = None) -> DataFrame:
    """dict, word, filed, part, entry: the strings of all entries in stored order; empty ones only of dictionaries in keep_empty."""
    rows = definitions.select("dict", "word", F.col("def_id").alias("filed"), F.posexplode("entries").alias("part", "entry")).filter("entry is not null")
    if keep_empty is None:
        return rows.filter("entry <> ''")
    return rows.join(keep_empty.select("dict", F.lit(True).alias("keep")), "dict", "left").filter("entry <> '' or keep").drop("keep")


def definitions_of(rows: DataFrame, entries: DataFrame, dictionaries: DataFrame, by: tuple[str, ...] = ("bare_key", "first_slot")) -> DataFrame:
    """by..., rank, dict, label, derived, entries: the sections to show for rows with members, by reading order.

    Each dictionary answers for the spellings it files; of later spellings only entries not shown before are added.
    """
    active = scopes(dictionaries).filter("scope").select("dict")
    asked = rows.select(*by, F.posexplode("members").alias("pos", "m")).select(*by, "pos", F.col("m.dict").alias("dict"), F.col("m.spelling").alias("word")).join(active, "dict", "left_semi")
    got = asked.join(entries, ["dict", "word"])
    each = Window.partitionBy(*by, "dict")
    fresh = F.row_number().over(Window.partitionBy(*by, "dict", "entry").orderBy("pos", "filed", "part")) == 1
    kept = got.withColumn("fresh", fresh).withColumn("first_pos", F.min("pos").over(each)).filter("fresh or pos = first_pos")
    sections = kept.groupBy(*by, "dict").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "filed", "part", "entry"))), lambda e: e["entry"]).alias("entries"))
    return sections.join(reading_order(dictionaries), "dict").join(dictionaries.select("dict", "label", "derived"), "dict").select(*by, "rank", "dict", "label", "derived", "entries")


@functools.cache
def _running():
    @F.pandas_udf("array<int>")
    def count(flags: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else np.cumsum(np.asarray(f, dtype="int32"), dtype="int32") for f in flags], dtype=object)

    return count


def sense_lines(texts: DataFrame, key: str | tuple[str, ...], text: str) -> DataFrame:
    """key (one column or several), line_no, line, sense (0 before the first), kind: body, sense or within, for each line of a text.

    The running count is inside each text, so lines never leave their row's task and nothing is shuffled.
    """
    key = (key,) if isinstance(key, str) else key
    df = texts.filter(F.col(text).isNotNull()).select(*key, F.split(F.col(text), "\n").alias("_lines"))
    df = df.withColumn("_starts", F.transform("_lines", starts_a_sense)).withColumn("_sense", _running()(F.col("_starts")))
    rows = df.select(*key, F.posexplode(F.arrays_zip("_lines", "_starts", "_sense")).alias("line_no", "l"))
    kind = F.when(F.col("l._starts"), "sense").when((F.col("l._sense") > 0) & (F.trim("l._lines") != ""), "within").otherwise("body")
    return rows.select(*key, "line_no", F.col("l._lines").alias("line"), F.col("l._sense").alias("sense"), kind.alias("kind"))
