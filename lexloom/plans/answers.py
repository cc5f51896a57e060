"""A collection of dictionaries as one object: search, define, scope, size; as DataFrames and as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.markup import html_text, link_target
from lexloom.operators import collection, index
from lexloom.operators import search as finder
from lexloom.sources import paths, reader


class Collection:
    """dictionaries: dict, path, label, derived, short, name, language, scope, cfg_order; at: keyed headwords;
    entries: dict, word, filed, part, entry (HTML)."""

    def __init__(self, dictionaries: DataFrame, at: DataFrame, entries: DataFrame):
        self.dictionaries, self.at, self.entries = dictionaries, at, entries

    @classmethod
    def of_tables(cls, dictionaries: DataFrame, headwords: DataFrame, definitions: DataFrame, index_path: str | None = None) -> Collection:
        """From tables of the test data's shape; with index_path the index is kept there and reused while current."""
        spark = headwords.sparkSession
        at = index.open_or_build(spark, headwords, index_path) if index_path else index.keyed(headwords)
        return cls(dictionaries, at, collection.entries_of(definitions))

    @classmethod
    def of_files(cls, spark: SparkSession, config: str, index_path: str | None = None) -> Collection:
        """From the files a configuration names."""
        found = paths.scan(spark, config)
        roots = paths.read_config(spark, config)[0]
        read = reader.read(spark, roots)
        known = found.join(read.names.select("path", "name"), "path")
        dictionaries = known.drop("label").join(collection.disambiguated(known), "dict")
        numbered = lambda df: df.join(dictionaries.select("path", "dict"), "path")
        headwords = index.with_slots(numbered(read.headwords).select("dict", "idx", "word", "is_alias", "entry_id"))
        at = index.open_or_build(spark, headwords, index_path) if index_path else index.keyed(headwords)
        filed = numbered(reader.lookup(read, read.filings.select("word")))
        return cls(dictionaries, at, filed.select("dict", "word", F.col("filing_no").alias("filed"), F.lit(0).alias("part"), F.col("html").alias("entry")))

    def _scope(self) -> DataFrame:
        return collection.scopes(self.dictionaries)

    def size(self) -> DataFrame:
        return collection.scope_size(self.dictionaries, self.at)

    def library_size(self) -> str:
        return collection.library_size(self.size()).first().line

    def search(self, query: str, limit: int | None = finder.DEFAULT_LIMIT, fold_forms: bool = False) -> DataFrame:
        return finder.search(self.at, query, limit, self._scope(), fold_forms)

    def page(self, query: str, n: int = finder.DEFAULT_LIMIT, fold_forms: bool = False) -> tuple[DataFrame, bool]:
        return finder.page(self.at, query, n, self._scope(), fold_forms)

    def resolve(self, word: str) -> DataFrame:
        return finder.resolve(self.at, word, self._scope())

    def define(self, word: str) -> DataFrame:
        """word, rank, dict, label, derived, entries: what each dictionary has for the row of a word."""
        row = self.resolve(word)
        got = collection.definitions_of(row, self.entries, self.dictionaries)
        return row.select("bare_key", "first_slot", "word").join(got, ["bare_key", "first_slot"]).drop("bare_key", "first_slot")

    def follow(self, href: str) -> DataFrame:
        """Definitions of the word a link leads to; none if it leads elsewhere."""
        spark = self.at.sparkSession
        target = spark.createDataFrame([(href,)], "h string").select(link_target(F.col("h"))).first()[0]
        return self.define(target) if target is not None else self.define("").limit(0)

    def shelf(self) -> DataFrame:
        return collection.shelf(self.dictionaries, self.at)

    # --- answers as JSON: one row with one column ---------------------------------------------------------------------

    def search_json(self, query: str, limit: int = finder.DEFAULT_LIMIT, fold_forms: bool = False) -> DataFrame:
        rows, more = self.page(query, limit, fold_forms)
        labels = self.dictionaries.select("dict", "label")
        members = rows.select("bare_key", "first_slot", "word", F.posexplode_outer("members").alias("pos", "m"))
        named = members.join(labels, F.col("m.dict") == F.col("dict"), "left")
        one = named.groupBy("bare_key", "first_slot", "word").agg(
            F.array_sort(F.collect_list(F.struct("pos", F.col("m.dict").alias("d"), F.coalesce("label", F.lit("")).alias("dictionary"), F.col("m.spelling").alias("spelling")))).alias("m")
        )
        shaped = F.struct(
            "bare_key", "first_slot", "word", F.size(F.array_distinct(F.transform("m", lambda x: x["d"]))).alias("dictionaries"),
            F.transform("m", lambda x: F.struct(x["dictionary"].alias("dictionary"), x["spelling"].alias("spelling"))).alias("members"),
        )
        listed = one.agg(F.array_sort(F.collect_list(shaped)).alias("rows"))
        bare = F.transform("rows", lambda r: F.struct(r["word"].alias("word"), r["dictionaries"].alias("dictionaries"), r["members"].alias("members")))
        return listed.select(F.to_json(F.struct(F.lit(query).alias("query"), bare.alias("rows"), F.lit(more).alias("truncated"))).alias("answer"))

    def define_json(self, word: str) -> DataFrame:
        got = self.define(word).select("word", "rank", "label", F.posexplode("entries").alias("n", "entry")).withColumn("text", html_text(F.col("entry")))
        by = got.groupBy("rank", "label").agg(F.min("word").alias("word"), F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda e: e["text"]).alias("entries"))
        listed = by.agg(F.min("word").alias("word"), F.array_sort(F.collect_list(F.struct("rank", F.col("label").alias("dictionary"), "entries"))).alias("d"))
        shown = F.transform("d", lambda x: F.struct(x["dictionary"].alias("dictionary"), x["entries"].alias("entries")))
        return listed.select(F.to_json(F.struct(F.coalesce("word", F.lit(word)).alias("word"), shown.alias("definitions"))).alias("answer"))

    def scope_json(self) -> DataFrame:
        rows = self.shelf().join(self.dictionaries.select("dict", "path"), "dict")
        listed = rows.agg(F.array_sort(F.collect_list(F.struct("rank", "label", "headwords", "path"))).alias("d"))
        return listed.select(F.to_json(F.struct(F.transform("d", lambda x: F.struct(x["label"].alias("label"), x["headwords"].alias("headwords"), x["path"].alias("path"))).alias("dictionaries"))).alias("answer"))
