"""Prefix search over keyed headwords: scope, marks, grouping of spellings, repeats folded, limits.

A query is folded on the driver; the plan then filters by a prefix of bare_key (pushed to the scan) and, only if the
query has marks, by a vectorised residual. Rows come out with `bare_key` and `first_slot`, by which they are ordered.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import keys
from lexloom.functions.keys import allows_marks
from lexloom.session import bounded, cut_lineage

DEFAULT_LIMIT = 500
_POSITION = ("bare_key", "first_slot")


def needle_of(query: str) -> tuple[str, str, bool]:
    """(fold, needle, marked) of what was typed."""
    folded = keys.fold(query.strip())
    needle = keys.bare(folded)
    return folded, needle, needle != keys.strip_homograph(folded)


def candidates(index: DataFrame, query: str, scope: DataFrame | None = None) -> DataFrame:
    """Headwords that answer the query. scope: dictionaries with dict and scope; a missing or null flag includes."""
    folded, needle, marked = needle_of(query)
    if not needle:
        return index.limit(0)
    found = index.filter(F.col("bare_key").startswith(needle))
    if scope is not None:
        out = scope.filter(~F.coalesce("scope", F.lit(True))).select("dict")
        found = found.join(out, "dict", "left_anti")
    return found.filter(allows_marks(folded, F.col("word"))) if marked else found


def _hosted(cs: Column) -> Column:
    """For each spelling class of a key the class it is shown under, and whether it is shown: host, maximal.

    A class is at the top if no other has all its marks. One that isn't is shown under the one class at the top that
    has all its marks and only optional ones; if there are several, or none, under itself.
    """
    within = lambda c, o: F.size(F.array_except(c["marks"], o["marks"])) == 0
    top = lambda c: ~F.exists(cs, lambda o: (o["fold_class"] != c["fold_class"]) & within(c, o))
    tops = F.filter(cs, top)

    def one(c: Column) -> Column:
        hosts = F.filter(tops, lambda h: h["optional"] & within(c, h))
        shown, alone = top(c), F.size(hosts) == 1
        return F.struct(
            F.when(~shown & alone, F.get(hosts, F.lit(0))["fold_class"]).otherwise(c["fold_class"]).alias("host"),
            (shown | alone).alias("maximal"),
        )

    return F.transform(cs, one)


def group_rows(found: DataFrame, by: tuple[str, ...] = ("bare_key",)) -> DataFrame:
    """Rows of spelling groups: by..., first_slot, word, members, all_aliases, ids.

    members: struct<dict, spelling> by dictionary, those of the shown spelling before absorbed ones, without repeats
    that follow each other. ids: the entries of all members. One exchange, by key; the rows of a key are then made
    in its own row, without Python.
    """
    classes = (
        found.repartition(*by)
        .groupBy(*by, "fold_class")
        .agg(
            F.min("slot").alias("class_slot"),
            F.bool_and("is_alias").alias("silent"),
            F.min(F.struct("slot", "word", "plain")).alias("first"),
            F.min(F.when(F.col("plain"), F.struct("slot", "word"))).alias("first_plain"),
            F.any_value("marks").alias("marks"),
            F.any_value("optional").alias("optional"),
            F.collect_list(F.struct("dict", "slot", "word", "entry_id")).alias("m"),
        )
    )
    held = classes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("class_slot", "fold_class", "silent", "first", "first_plain", "marks", "optional", "m"))).alias("cs"))
    several = F.size("cs") > 1
    alone = F.transform("cs", lambda c: F.struct(c["fold_class"].alias("host"), F.lit(True).alias("maximal")))
    hosted = held.withColumn("zs", F.arrays_zip("cs", F.when(several, _hosted(F.col("cs"))).otherwise(alone).alias("hs")))
    placed = hosted.select(*by, "zs", F.explode(F.array_distinct(F.transform("zs", lambda z: z["hs"]["host"]))).alias("host"))
    mine = F.filter("zs", lambda z: z["hs"]["host"] == F.col("host"))
    c = F.get(F.filter(mine, lambda z: z["cs"]["fold_class"] == F.col("host")), F.lit(0))["cs"]

    def members_of(z: Column) -> Column:
        absorbed = z["cs"]["fold_class"] != z["hs"]["host"]
        order = F.when(absorbed, z["cs"]["class_slot"]).otherwise(0)
        return F.transform(z["cs"]["m"], lambda x: F.struct(x["dict"].alias("dict"), absorbed.alias("absorbed"), order.alias("order"), x["slot"].alias("slot"), x["word"].alias("spelling"), x["entry_id"].alias("entry_id")))

    fresh = lambda x, i: (i == 0) | (x != F.get(F.col("every"), i - 1))
    return (
        placed.withColumns({"own": c, "m": F.array_sort(F.flatten(F.transform(mine, members_of)))})
        .withColumn("every", F.transform("m", lambda x: F.struct(x["dict"].alias("dict"), x["spelling"].alias("spelling"))))
        .select(
            *by,
            F.col("own.class_slot").alias("first_slot"),
            F.when(F.col("own.first.plain"), F.col("own.first.word")).otherwise(F.coalesce("own.first_plain.word", "own.first.word")).alias("word"),
            F.filter("every", fresh).alias("members"),
            F.forall(mine, lambda z: z["cs"]["silent"] & z["hs"]["maximal"]).alias("all_aliases"),
            F.array_distinct(F.transform(F.filter("m", lambda x: x["entry_id"].isNotNull()), lambda x: F.struct(x["dict"].alias("dict"), x["entry_id"].alias("entry_id")))).alias("ids"),
        )
    )


def fold_repeats(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """rows without those made of aliases whose every entry an earlier row of the same query shows.

    The earliest row of each entry is an aggregate, combined before its shuffle, so that a stub entry that serves very
    many words stays one row; it is joined back only to rows that could go.
    """
    position = F.struct(*_POSITION)
    shown = rows.select(*by, *_POSITION, "all_aliases", F.explode("ids").alias("e")).select(*by, *_POSITION, "all_aliases", "e.dict", "e.entry_id")
    earliest = shown.groupBy(*by, "dict", "entry_id").agg(F.min(position).alias("first"))
    repeats = (
        shown.filter("all_aliases")
        .join(earliest, [*by, "dict", "entry_id"])
        .groupBy(*by, *_POSITION)
        .agg(F.bool_and(F.col("first") < position).alias("seen"))
        .filter("seen")
    )
    return rows.join(repeats, [*by, *_POSITION], "left_anti")


def key_limit(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of a query cut between keys: a key's rows stay if fewer than limit rows stand before it.

    At most `limit` keys can stay, so the running count is over a top-k of keys.
    """
    if limit <= 0:
        return rows.limit(0)
    counts = rows.groupBy("bare_key").agg(F.count("*").alias("n")).orderBy("bare_key").limit(limit)
    before = F.coalesce(F.sum("n").over(Window.orderBy("bare_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(counts.withColumn("before", before).filter(F.col("before") < limit).select("bare_key"), "bare_key", "left_semi")


def first_keys(found: DataFrame, limit: int) -> DataFrame:
    """Candidates of the first `limit` keys, by a top-k: with nothing folded each key gives a row, so no others are needed."""
    return found.join(found.select("bare_key").distinct().orderBy("bare_key").limit(limit), "bare_key", "left_semi")


def search(index: DataFrame, query: str, limit: int | None = None, scope: DataFrame | None = None, fold_forms: bool = False) -> DataFrame:
    """bare_key, first_slot, word, members, all_aliases of all rows that answer a query; order by the first two."""
    found = candidates(index, query, scope)
    if fold_forms:
        rows = fold_repeats(group_rows(found))
    else:
        rows = group_rows(found if limit is None else first_keys(found, max(limit, 0)))
    return (rows if limit is None else key_limit(rows, limit)).drop("ids")


def page(index: DataFrame, query: str, n: int = DEFAULT_LIMIT, scope: DataFrame | None = None, fold_forms: bool = False) -> tuple[DataFrame, bool]:
    """(the first n rows in order, whether there are more)"""
    # written once, as it is counted and shown: at most the rows of n + 1 keys
    rows = cut_lineage(search(index, query, n + 1, scope, fold_forms), "page").orderBy("bare_key", "first_slot")
    return rows.limit(n), rows.limit(n + 1).count() > n


def batch_search(index: DataFrame, queries: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Rows for many queries at once: query_id, bare_key, first_slot, word, members, all_aliases.

    queries: query_id, query. Each key is met with the needles by its beginnings of the lengths that needles have, in one
    pass and by one equi-join: a pair that is tried is a pair that is found, whatever the needles have in common.
    """
    asked = keys.with_keys(queries.select("query_id", F.trim("query").alias("word")).filter("word is not null"))
    asked = asked.select("query_id", F.col("fold_key").alias("q_fold"), F.col("bare_key").alias("needle"), (F.col("bare_key") != F.col("fold_class")).alias("marked")).filter("needle <> ''")
    # written and counted, so that needles are broadcast while they are few and the index is streamed past them
    asked = cut_lineage(asked, "needles")
    # at most as many rows as the longest needle has characters
    told = asked.groupBy(F.length("needle").alias("n")).agg(F.max("marked").alias("marked")).collect()
    lengths = F.array(*[F.lit(r.n) for r in sorted(told)]).cast("array<int>")
    begun = index.withColumn("n", F.explode(F.filter(lengths, lambda n: n <= F.length("bare_key"))))
    found = begun.withColumn("needle", F.expr("left(bare_key, n)")).join(bounded(asked), "needle")
    if scope is not None:
        found = found.join(scope.filter(~F.coalesce("scope", F.lit(True))).select("dict"), "dict", "left_anti")

    @F.pandas_udf("boolean")
    def allowed(q: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([a is None or keys.marks_allow(a, b) for a, b in zip(q, w)], dtype=bool)

    if any(r.marked for r in told):
        found = found.filter(allowed(F.when(F.col("marked"), F.col("q_fold")), F.col("word")))
    return group_rows(found.drop("needle", "n", "marked", "q_fold"), ("query_id", "bare_key")).drop("ids")


def resolve(index: DataFrame, word: str, scope: DataFrame | None = None) -> DataFrame:
    """The one row for a word: spelled exactly so, else with the same fold, else the first of its key; or none."""
    folded = keys.fold(word)
    rows = search(index, word, 8, scope).filter(F.col("bare_key") == keys.bare(folded))
    exact = (F.col("word") == word) | F.exists("members", lambda m: m["spelling"] == word)
    same = keys.with_keys(rows)
    rank = F.when(exact, 0).when(F.col("fold_key") == folded, 1).otherwise(2)
    return same.withColumn("rank", rank).orderBy("rank", "first_slot").limit(1).select(*rows.columns)


def language_tags(rows: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """rows with `tags`: the distinct languages of their members in order, joined."""
    from lexloom.functions.language import tag

    m = rows.select("bare_key", "first_slot", F.posexplode("members").alias("pos", "m"))
    tagged = m.join(dictionaries.select("dict", "name"), F.col("m.dict") == F.col("dict"), "left").select("bare_key", "first_slot", "pos", tag(F.col("m.spelling"), F.col("name")).alias("tag"))
    firsts = tagged.filter("tag is not null").groupBy("bare_key", "first_slot", "tag").agg(F.min("pos").alias("pos"))
    tags = firsts.groupBy("bare_key", "first_slot").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]), " · ").alias("tags"))
    return rows.join(tags, ["bare_key", "first_slot"], "left").withColumn("tags", F.coalesce("tags", F.lit("")))
