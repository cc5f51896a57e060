"""Queries of the readers: the test tables written as dictionary files of each format, and what reading them gives."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import rejects
from lexloom.session import shared_dir, table
from lexloom.sources import reader, writer
from lexloom.sources.paths import file_name


def _books(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """dict, format, stem, name, packed: every other dictionary is packed."""
    stem = F.regexp_replace(file_name(F.col("path")), r"\.(ifo|index|csv|dsl|dsl\.dz)$", "")
    return table(spark, d, "dictionaries").filter(F.col("format") == kind).select("dict", "format", stem.alias("stem"), F.coalesce("label", F.lit("")).alias("name"), (F.col("dict") % 2 == 1).alias("packed"))


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """dict, word, text: the entries of the first definition of each word, joined by line breaks."""
    definitions = table(spark, d, "definitions").filter("entries is not null")
    return definitions.groupBy("dict", "word").agg(F.min_by(F.array_join("entries", "\n"), "def_id").alias("text"))


def _listed(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """The headwords of all dictionaries of a format with their bodies; of a word without definition the word itself."""
    heads = table(spark, d, "headwords").filter("word is not null").join(_books(spark, d, kind), "dict").join(_bodies(spark, d), ["dict", "word"], "left")
    return heads.withColumn("text", F.coalesce("text", F.concat(F.lit("<i>"), "word", F.lit("</i>"))))


def stardict_rows(spark: SparkSession, d: str) -> DataFrame:
    """Words in their order, then aliases, of which each points to the word of its own number, counted round."""
    heads = _listed(spark, d, "StarDict").withColumn("alias", F.coalesce("is_alias", F.lit(False)))
    # numbers within a dictionary, from counts by it: a word's number is how many words stand before it
    words = heads.filter(~F.col("alias")).groupBy("dict").agg(F.count("*").alias("n"))
    joined = heads.join(words, "dict")
    return joined.select(
        "dict", "format", "stem", "name", "packed", F.when(F.col("alias"), F.col("idx") + (1 << 40)).otherwise(F.col("idx")).alias("no"), "word", "text",
        F.when(F.col("alias"), F.pmod("idx", "n")).otherwise(F.lit(-1)).cast("bigint").alias("target"),
    )


_read: dict[tuple[str, str, str], reader.Dictionaries] = {}


def _written(spark: SparkSession, d: str, rows_of: Callable[[SparkSession, str], DataFrame]) -> reader.Dictionaries:
    """What reading the files of a format gives; they are written and read once in an application."""
    key = (spark.sparkContext.applicationId, d, rows_of.__name__)
    if key not in _read:
        folder = f"{shared_dir(spark)}/books-{uuid.uuid4().hex}"
        writer.write_dictionaries(rows_of(spark, d), folder)
        _read[key] = reader.read(spark, folder)
    return _read[key]


def _dict(df: DataFrame) -> DataFrame:
    return df.withColumn("dict", F.regexp_extract("path", r"/dict-(\d+)/", 1).cast("int"))


def read_stardict(spark: SparkSession, d: str) -> DataFrame:
    """dict, idx, word, is_alias: the listed words of StarDict files, as they are told apart."""
    return _dict(_written(spark, d, stardict_rows).headwords).select("dict", "idx", "word", "is_alias")


def read_stardict_entries(spark: SparkSession, d: str) -> DataFrame:
    """dict, filing_no, word, is_alias, text: every filing with what its offset and size give."""
    got = _written(spark, d, stardict_rows)
    return _dict(got.filings.drop("format").join(got.entries.drop("format"), ["path", "offset", "size"])).select("dict", "filing_no", "word", "is_alias", "text")


def dictd_rows(spark: SparkSession, d: str) -> DataFrame:
    """Tabs and line breaks in words become spaces, as the format has no place for them."""
    word = F.regexp_replace("word", r"[\t\r\n]", " ")
    return _listed(spark, d, "Dictd").select("dict", "format", "stem", "name", "packed", F.col("idx").alias("no"), word.alias("word"), "text", F.lit(-1).cast("bigint").alias("target"))


def read_dictd(spark: SparkSession, d: str) -> DataFrame:
    got = _written(spark, d, dictd_rows)
    return _dict(got.filings.drop("format").join(got.entries.drop("format"), ["path", "offset", "size"])).select("dict", "filing_no", "word", "text")


def tsv_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "csv_lines").filter("line is not null").join(_books(spark, d, "Csv"), "dict")
    return lines.select("dict", "format", "stem", "name", "packed", F.col("line_no").alias("no"), F.lit("").alias("word"), F.col("line").alias("text"), F.lit(-1).cast("bigint").alias("target"))


def read_tsv(spark: SparkSession, d: str) -> DataFrame:
    """dict, word, text: the first description of each word of tab-separated files."""
    got = _written(spark, d, tsv_rows)
    return _dict(got.filings.drop("format").join(got.entries.drop("format"), ["path", "offset", "size"])).select("dict", "word", "text")


def dsl_rows(spark: SparkSession, d: str) -> DataFrame:
    """The valid cards, of which alone a file can be made up."""
    valid = rejects.split_valid(rejects.dsl_records(table(spark, d, "dsl_cards")))[0].select("card_id")
    cards = table(spark, d, "dsl_cards").join(valid, "card_id", "left_semi").join(_books(spark, d, "Dsl"), "dict")
    return cards.select("dict", "format", "stem", "name", "packed", F.col("card_no").alias("no"), F.lit("").alias("word"), F.col("card").alias("text"), F.lit(-1).cast("bigint").alias("target"))


def read_dsl(spark: SparkSession, d: str) -> DataFrame:
    """dict, text, cards: the bodies of the cards of DSL files, with the number of cards that have them."""
    got = _written(spark, d, dsl_rows)
    return _dict(got.entries).groupBy("dict", "text").agg(F.count("*").alias("cards"))


def read_dsl_names(spark: SparkSession, d: str) -> DataFrame:
    """dict, name, entries: the name in the header of each DSL file, and how many cards it has."""
    got = _written(spark, d, dsl_rows)
    counts = got.entries.groupBy("path").agg(F.count("*").alias("entries"))
    return _dict(got.names.join(counts, "path", "left")).select("dict", "name", F.coalesce("entries", F.lit(0)).alias("entries"))


def read_names(spark: SparkSession, d: str) -> DataFrame:
    """dict, name: the names that StarDict and dictd files give themselves."""
    both = [_written(spark, d, rows_of).names for rows_of in (stardict_rows, dictd_rows)]
    return _dict(both[0].unionByName(both[1])).select("dict", "name")


def dictd_offsets(spark: SparkSession, d: str) -> DataFrame:
    """dict, filing_no, offset, size: the numbers of dictd files, written in their digits and read from them."""
    return _dict(_written(spark, d, dictd_rows).filings).select("dict", "filing_no", "offset", "size")


QUERIES = (read_stardict, read_stardict_entries, read_dictd, read_tsv, read_dsl, read_dsl_names, read_names, dictd_offsets)

_TEXT = """
t AS (SELECT dict, word, arg_min(array_to_string(entries, chr(10)), def_id) AS text FROM definitions WHERE entries IS NOT NULL GROUP BY dict, word),
l AS (SELECT h.dict, d.format, h.idx, h.word, coalesce(h.is_alias, false) AS alias, coalesce(t.text, '<i>' || h.word || '</i>') AS text
  FROM headwords h JOIN dictionaries d USING (dict) LEFT JOIN t USING (dict, word) WHERE h.word IS NOT NULL)"""
_STARDICT = f"""{_TEXT},
w AS (SELECT *, row_number() OVER (PARTITION BY dict ORDER BY idx) - 1 AS no, count(*) OVER (PARTITION BY dict) AS n FROM l WHERE format = 'StarDict' AND NOT alias),
c AS (SELECT dict, count(*) AS n FROM w GROUP BY dict),
s AS (SELECT l.dict, l.word, c.n + row_number() OVER (PARTITION BY l.dict ORDER BY l.idx) - 1 AS no, l.idx % c.n AS target FROM l JOIN c USING (dict) WHERE l.format = 'StarDict' AND l.alias),
f AS (SELECT dict, no, word, false AS is_alias, text FROM w UNION ALL SELECT s.dict, s.no, s.word, true, w.text FROM s JOIN w ON w.dict = s.dict AND w.no = s.target)"""
_DICTD = f"""{_TEXT},
f AS (SELECT dict, row_number() OVER (PARTITION BY dict ORDER BY idx) - 1 AS filing_no, regexp_replace(word, '[\\t\\r\\n]', ' ', 'g') AS word, text FROM l WHERE format = 'Dictd')"""


def sql(faulty: str) -> dict[str, str]:
    """faulty: the SQL that gives the faulty records (format, rec_id)."""
    valid = f"SELECT dict, card FROM dsl_cards WHERE card IS NOT NULL AND card_id NOT IN (SELECT rec_id FROM ({faulty}) WHERE format = 'Dsl')"
    body = r"regexp_replace(regexp_extract(card, '(?s)(?:^|\n)([\t ][\t ]*[^\t \r\n].*)$', 1), '(\r?\n[\t \r]*)*\r?$', '')"
    return {
        "read_stardict": f"WITH {_STARDICT}, u AS (SELECT dict, word, min(no) AS no, arg_min(is_alias, no) AS is_alias FROM f GROUP BY dict, word) SELECT dict, (row_number() OVER (PARTITION BY dict ORDER BY no) - 1)::BIGINT AS idx, word, is_alias FROM u",
        "read_stardict_entries": f"WITH {_STARDICT} SELECT dict, no::BIGINT AS filing_no, word, is_alias, text FROM f",
        "read_dictd": f"WITH {_DICTD} SELECT dict, filing_no::BIGINT AS filing_no, word, text FROM f",
        "read_tsv": r"""WITH p AS (SELECT dict, line_no, string_split(regexp_replace(line, '\r$', ''), chr(9)) AS f FROM csv_lines WHERE line IS NOT NULL)
 SELECT dict, regexp_replace(f[3], '^\s+|\s+$', '', 'g') AS word, arg_min(f[5], line_no) AS text FROM p WHERE len(f) > 4 AND regexp_replace(f[3], '^\s+|\s+$', '', 'g') <> '' GROUP BY ALL""",
        "read_dsl": f"SELECT dict, {body} AS text, count(*) AS cards FROM ({valid}) GROUP BY ALL",
        "read_dsl_names": f"SELECT dict, label AS name, count(*) AS entries FROM ({valid}) JOIN dictionaries USING (dict) GROUP BY ALL",
        "read_names": "SELECT dict, label AS name FROM dictionaries WHERE format IN ('StarDict', 'Dictd') AND dict IN (SELECT dict FROM headwords WHERE word IS NOT NULL)",
        "dictd_offsets": f"""WITH {_DICTD} SELECT f.dict, filing_no::BIGINT AS filing_no,
 (octet_length(encode(d.label)) + 1 + coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY f.dict ORDER BY filing_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset",
 octet_length(encode(text))::BIGINT AS size FROM f JOIN dictionaries d USING (dict)""",
    }
