"""All queries of the core, each a function of the session and the folder with the tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import language, markup
from lexloom.functions.keys import with_keys, without_homograph
from lexloom.operators import collection, index, rejects, search
from lexloom.plans import answers, files
from lexloom.session import shared_dir, table
from lexloom.sources import paths

Query = Callable[[SparkSession, str], DataFrame]

NEEDLE, MARKED, REPEATED, POINTED, WORD, NEAR = "cra", "crâ", "pra", "מ", "шосуцэфэзац", "sacicraestax"
#: A word that several dictionaries define.
DEFINED = "faupliabrosod"
QUERIES = [(1, "ad "), (2, "κλ"), (3, "סַ"), (4, ""), (5, "zzz"), (6, " Spo "), (7, "кр"), (8, "b"), (9, "É")]
LIMIT = 25
#: Paths for the rules of discovery.
FILES = [
    "/books/a/x.dsl", "/books/a/x.dsl.dz", "/books/b/y.dsl.dz", "/books/b/Z.IFO", "/books/b/z.idx", "/books/greek_or_2/g.ifo",
    "/books/greek_or_20/h.ifo", "/books/c/t.csv", "/books/c/w.index", "/books/c/w.dict", "/books/d/old.bgl", "/books/e/k.DSL.DZ", "/books/e/k.DSL", "solo.csv",
]
EXCLUDED = ["/books/greek_or_2", "/books/c/w.index"]


def _heads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "headwords")


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return index.keyed(_heads(spark, d))


def _index(spark: SparkSession, d: str) -> DataFrame:
    """The written index of the headwords in a folder, built by the first query that asks for it and while they stay as they are."""
    return index.open_or_build(spark, _heads(spark, d), f"{shared_dir(spark)}/index-{zlib.crc32(d.encode()):08x}")


def _dicts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dictionaries")


def _flat(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of a search with their members as text."""
    members = F.array_join(F.transform("members", lambda m: F.concat_ws("=", m["dict"].cast("string"), m["spelling"])), "; ")
    return rows.select(*by, "bare_key", "first_slot", "word", members.alias("members"), "all_aliases")


def kw_total(spark: SparkSession, d: str) -> DataFrame:
    return _heads(spark, d).agg(F.count("*").alias("headwords"))


def kw_per_dict(spark: SparkSession, d: str) -> DataFrame:
    return collection.headword_counts(_heads(spark, d))


def scope_size(spark: SparkSession, d: str) -> DataFrame:
    return collection.scope_size(_dicts(spark, d), _heads(spark, d))


def library_size_line(spark: SparkSession, d: str) -> DataFrame:
    return collection.library_size(scope_size(spark, d))


def status_line(spark: SparkSession, d: str) -> DataFrame:
    return collection.status(scope_size(spark, d), 1234, True, True)


def slot_bases(spark: SparkSession, d: str) -> DataFrame:
    return index.slot_bases(_heads(spark, d))


def merged_order(spark: SparkSession, d: str) -> DataFrame:
    return index.merged_order(_keyed(spark, d)).select("bare_key", "slot", "dict", "idx")


def keys(spark: SparkSession, d: str) -> DataFrame:
    return with_keys(_heads(spark, d).select("slot", "word").filter("word is not null")).select("slot", "fold_key", "bare_key", "fold_class", "plain")


def homograph_strip(spark: SparkSession, d: str) -> DataFrame:
    return _heads(spark, d).select("slot", without_homograph(F.col("word")).alias("stripped"))


def prefix_matches(spark: SparkSession, d: str) -> DataFrame:
    found = search.candidates(_index(spark, d), NEEDLE)
    return found.groupBy("bare_key").agg(F.count("*").alias("n"), F.min("slot").alias("first_slot"))


def prefix_search(spark: SparkSession, d: str) -> DataFrame:
    return _flat(search.search(_index(spark, d), NEEDLE))


def prefix_search_all(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all headwords, as an index of the whole collection shows them."""
    return _flat(search.group_rows(_index(spark, d)))


def prefix_search_scoped(spark: SparkSession, d: str) -> DataFrame:
    return _flat(search.search(_index(spark, d), NEEDLE, scope=_dicts(spark, d)))


def prefix_search_marked(spark: SparkSession, d: str) -> DataFrame:
    return _flat(search.search(_index(spark, d), MARKED))


def prefix_search_pointed(spark: SparkSession, d: str) -> DataFrame:
    """Hebrew, where words without points are shown under the one pointed spelling they can be."""
    return _flat(search.search(_index(spark, d), POINTED))


def prefix_search_batch(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame(QUERIES, "query_id int, query string")
    return _flat(search.batch_search(_index(spark, d), asked), "query_id")


def fold_forms(spark: SparkSession, d: str) -> DataFrame:
    return _flat(search.search(_index(spark, d), REPEATED, fold_forms=True))


def key_aligned_limit(spark: SparkSession, d: str) -> DataFrame:
    return _flat(search.search(_index(spark, d), NEEDLE, limit=LIMIT))


def page_rows(spark: SparkSession, d: str) -> DataFrame:
    rows, more = search.page(_index(spark, d), NEEDLE, LIMIT)
    return _flat(rows).withColumn("more", F.lit(more))


def spelling_classes(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).groupBy("bare_key", "fold_class").agg(F.count("*").alias("n"), F.bool_and("is_alias").alias("all_aliases"))


def resolve_word(spark: SparkSession, d: str) -> DataFrame:
    return _flat(search.resolve(_index(spark, d), WORD))


def row_language_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = search.search(_index(spark, d), NEEDLE)
    return search.language_tags(rows, _dicts(spark, d)).select("bare_key", "first_slot", "tags")


def exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    entries = collection.entries_of(table(spark, d, "definitions"))
    heads = _heads(spark, d).select("dict", "word").distinct()
    return heads.join(entries, ["dict", "word"]).groupBy("dict", "word").agg(F.count("*").alias("entries"), F.sum(F.length("entry")).alias("chars"))


def definitions_ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = search.search(_index(spark, d), NEEDLE)
    got = collection.definitions_of(rows, collection.entries_of(table(spark, d, "definitions")), _dicts(spark, d))
    return got.select("bare_key", "first_slot", "rank", "dict", "label", "derived", F.array_join("entries", "␞").alias("entries"))


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return collection.reading_order(_dicts(spark, d))


def order_repair(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(0, 7), (1, 3), (2, 7), (3, 999), (4, 0)], "pos int, dict int")
    return collection.repaired_order(asked, _dicts(spark, d))


def scope_default(spark: SparkSession, d: str) -> DataFrame:
    return collection.scopes(_dicts(spark, d))


def shelf(spark: SparkSession, d: str) -> DataFrame:
    return collection.shelf(_dicts(spark, d), _heads(spark, d))


def label_collisions(spark: SparkSession, d: str) -> DataFrame:
    return collection.repeated_labels(_dicts(spark, d))


def label_disambiguated(spark: SparkSession, d: str) -> DataFrame:
    return collection.disambiguated(_dicts(spark, d))


def language_tag(spark: SparkSession, d: str) -> DataFrame:
    heads = _heads(spark, d).join(_dicts(spark, d).select("dict", "name"), "dict")
    return heads.select("slot", language.tag(F.col("word"), F.col("name")).alias("tag"))


def language_pair(spark: SparkSession, d: str) -> DataFrame:
    p = language.pair(F.col("name"))
    return _dicts(spark, d).select("dict", p["source"].alias("source"), p["target"].alias("target"))


def language_group_order(spark: SparkSession, d: str) -> DataFrame:
    return collection.language_groups(_dicts(spark, d))


def path_classify(spark: SparkSession, d: str) -> DataFrame:
    files = spark.createDataFrame([(f,) for f in FILES], "path string").unionByName(_dicts(spark, d).select("path"))
    return files.select("path", paths.classify(F.col("path")).alias("format"), paths.label_of(F.col("path")).alias("label"))


def discovered(spark: SparkSession, d: str) -> DataFrame:
    files = spark.createDataFrame([(f,) for f in FILES], "path string").unionByName(_dicts(spark, d).select("path"))
    out = spark.createDataFrame([(f,) for f in EXCLUDED], "path string")
    return paths.discovered(files, out).select("dict", "path", "format", "derived", "label", "scope")


def b64_offsets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", paths.b64_value(F.col("c_mktsegment")).alias("value"))


def tsv_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Per dictionary and headword of the tab-separated lines, read without quoting, the first description."""
    f = F.split(F.regexp_replace("line", r"\r\z", ""), "\t")
    rows = table(spark, d, "csv_lines").select("dict", "line_no", F.trim(F.get(f, F.lit(2))).alias("word"), F.get(f, F.lit(4)).alias("body")).filter("word <> '' and body is not null")
    return rows.groupBy("dict", "word").agg(F.min_by("body", "line_no").alias("body"))


def link_targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs").filter("href is not null").select("run_id", markup.link_target(F.col("href")).alias("target"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "definitions").select("def_id", F.posexplode("entries").alias("part", "entry"))
    return entries.select("def_id", "part", markup.html_text(F.col("entry")).alias("text"))


def html_runs(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "definitions").select("def_id", F.posexplode("entries").alias("part", "entry"))
    runs = entries.select("def_id", "part", F.posexplode(markup.html_runs(F.col("entry"))).alias("run_no", "r"))
    return runs.select("def_id", "part", "run_no", "r.text", "r.style.bold", "r.style.italic", "r.style.scale", "r.href")


def sense_lines(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "definitions").select("def_id", F.get("entries", F.lit(0)).alias("text"))
    return collection.sense_lines(texts, "def_id", "text")


def sense_lines_all(spark: SparkSession, d: str) -> DataFrame:
    """The lines of all entries of a definition, not only of its first as sense_lines gives them."""
    entries = table(spark, d, "definitions").select("def_id", F.posexplode("entries").alias("part", "entry"))
    return collection.sense_lines(entries, ("def_id", "part"), "entry")


def fuzzy_keys(spark: SparkSession, d: str) -> DataFrame:
    """Beyond the plain search: keys at most two edits from a word."""
    near = F.levenshtein(F.col("bare_key"), F.lit(NEAR), 2)
    return _index(spark, d).select("slot", "bare_key", near.alias("edits")).filter("edits >= 0")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.faulty_records(table(spark, d, "csv_lines"), table(spark, d, "dsl_cards")).select("format", "rec_id")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return rejects.faulty_records(table(spark, d, "csv_lines"), table(spark, d, "dsl_cards"))


def p1_valid(spark: SparkSession, d: str) -> DataFrame:
    return rejects.valid_records(table(spark, d, "csv_lines"), table(spark, d, "dsl_cards"))


def p1_valid_lines(spark: SparkSession, d: str) -> DataFrame:
    """The valid records line by line: format, rec_id, part (headword or body), no, text."""
    rows = p1_valid(spark, d)
    one = lambda part, column: rows.select("format", "rec_id", F.lit(part).alias("part"), F.posexplode(column).alias("no", "text"))
    return one("headword", "headwords").unionByName(one("body", "body"))


def index_figures(spark: SparkSession, d: str) -> DataFrame:
    """Headwords and dictionaries of the index; its bytes, versions and the cost of opening differ by run."""
    _index(spark, d)
    got = index.figures(spark, _heads(spark, d), f"{shared_dir(spark)}/index-{zlib.crc32(d.encode()):08x}")
    return got.select("headwords", "dictionaries", (F.col("bytes") > 0).alias("stored"), (F.col("open_ms") >= 0).alias("opened"))


def definitions_ranked_all(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of all rows of the index, not of those under one prefix: how many sections, entries and characters each row has."""
    rows = search.group_rows(_index(spark, d))
    got = collection.definitions_of(rows, collection.entries_of(table(spark, d, "definitions")), _dicts(spark, d))
    chars = F.aggregate("entries", F.lit(0).cast("bigint"), lambda n, e: n + F.length(e))
    return got.groupBy("bare_key", "first_slot").agg(F.count("*").alias("sections"), F.sum(F.size("entries")).alias("entries"), F.sum(chars).alias("chars"))


def row_language_tags_all(spark: SparkSession, d: str) -> DataFrame:
    """Language tags of all rows of the index."""
    return search.language_tags(search.group_rows(_index(spark, d)), _dicts(spark, d)).select("bare_key", "first_slot", "tags")


def fold_forms_all(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the index, without those whose entries an earlier row shows."""
    return _flat(search.fold_repeats(search.group_rows(_index(spark, d))).drop("ids"))


def _collection(spark: SparkSession, d: str) -> answers.Collection:
    return answers.Collection(_dicts(spark, d), _index(spark, d), collection.entries_of(table(spark, d, "definitions")))


def answer_define(spark: SparkSession, d: str) -> DataFrame:
    """What `define` shows of a word, dictionary by dictionary."""
    got = _collection(spark, d).define(DEFINED)
    return got.select("word", "rank", "dict", "label", F.array_join("entries", "␞").alias("entries"))


def answer_scope(spark: SparkSession, d: str) -> DataFrame:
    """The shelf as JSON."""
    return _collection(spark, d).scope_json()


def answer_search(spark: SparkSession, d: str) -> DataFrame:
    """What `search` answers as JSON: the first rows with their members, and whether there are more."""
    return _collection(spark, d).search_json(NEEDLE, LIMIT)


def dsl_filings(spark: SparkSession, d: str) -> DataFrame:
    """All keys the valid cards are filed under, with whether they are listed."""
    from lexloom.functions import dsl_columns

    cards = rejects.split_valid(rejects.dsl_records(table(spark, d, "dsl_cards")))[0]
    return cards.select("card_id", "dict", F.explode(dsl_columns.filed(F.col("headwords"))).alias("f")).select("card_id", "dict", "f.word", "f.listed")


def dsl_html(spark: SparkSession, d: str) -> DataFrame:
    from lexloom.functions import dsl_columns

    cards = rejects.split_valid(rejects.dsl_records(table(spark, d, "dsl_cards")))[0]
    word = F.get(dsl_columns.filed(F.col("headwords")), F.lit(0))["word"]
    return cards.select("card_id", word.alias("word"), dsl_columns.body_html(F.array_join("body", "\n"), word).alias("html"))


def queries() -> dict[str, Query]:
    own = (
        kw_total, kw_per_dict, scope_size, library_size_line, status_line, slot_bases, merged_order, keys, homograph_strip, prefix_matches, prefix_search,
        prefix_search_all, prefix_search_scoped, prefix_search_marked, prefix_search_pointed, prefix_search_batch, fold_forms, key_aligned_limit, page_rows, spelling_classes,
        resolve_word, row_language_tags, exact_lookup, definitions_ranked, reading_order, order_repair, scope_default, shelf, label_collisions,
        label_disambiguated, language_tag, language_pair, language_group_order, path_classify, discovered, b64_offsets, tsv_first_wins, link_targets,
        html_text, html_runs, sense_lines, sense_lines_all, fuzzy_keys, dsl_filings, dsl_html, p1_found, p1_reasons, p1_valid, p1_valid_lines,
        index_figures, answer_define, answer_scope, answer_search, definitions_ranked_all, row_language_tags_all, fold_forms_all,
    )
    return {f.__name__: f for f in (*own, *files.QUERIES)}
