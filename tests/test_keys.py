"""Golden vectors of keys, marks and languages."""

import unicodedata as U

import pytest
from pyspark.sql import functions as F

from lexloom.functions import keys, language
from lexloom.functions.casefold import casefold


@pytest.mark.parametrize(
    "word, fold, bare",
    [
        ("λόγος", "λόγοσ", "λογοσ"),
        ("λόγος", "λόγοσ", "λογοσ"),
        ("ΛΌΓΟΣ", "λόγοσ", "λογοσ"),
        ("ᾴ", U.normalize("NFC", "ᾴ").casefold(), "αι"),
        ("ᾴ", U.normalize("NFC", "ᾴ").casefold(), "αι"),
        ("מֶ֫לֶךְ", "מֶ֫לֶךְ", "מלך"),
        ("ἀνθρωπος", "ἀνθρωποσ", "ανθρωποσ"),
        ("Rex", "rex", "rex"),
        ("Rex (2)", "rex (2)", "rex"),
        ("Rex (x)", "rex (x)", "rex (x)"),
        ("ְ", "ְ", ""),
        ("", "", ""),
    ],
)
def test_keys(spark, word, fold, bare):
    row = keys.with_keys(spark.createDataFrame([(word,), (None,)], "word string")).collect()
    assert (row[0].fold_key, row[0].bare_key) == (fold, bare)
    assert row[1].fold_key is None and row[1].bare_key is None


@pytest.mark.parametrize(
    "query, word, allowed",
    [
        ("מֶלֶךְ", "מֶלֶךְ", True), ("מֶלֶךְ", "מָלָךְ", False), ("מֶלֶךְ", "מלך", False), ("מֶלך", "מֶלֶךְ", True), ("מֶלֶךְ", "מֶלֶךְ אֶבְיוֹן", True),
        ("λόγος", "λόγος", True), ("Λόγος", "λόγος", True), ("λόγος", "λὸγος", False), ("λόγος", "λογος", False), ("λόγος", "λόγ", False),
    ],
)
def test_marks(query, word, allowed):
    assert keys.marks_allow(keys.fold(query), word) is allowed


def test_optional_marks():
    assert keys.only_optional_marks("מֶלֶךְ") and keys.only_optional_marks("mur")
    assert not keys.only_optional_marks("mûr") and not keys.only_optional_marks("λόγοσ")


def test_fold_is_idempotent_and_bare_depends_on_it_only(spark, data):
    rows = keys.with_keys(spark.read.parquet(f"{data}/headwords.parquet").select("word")).collect()
    assert len(rows) > 1000
    by_fold = {}
    for r in rows:
        assert keys.fold(r.fold_key) == r.fold_key == keys.fold(r.word)
        assert by_fold.setdefault(r.fold_key, r.bare_key) == r.bare_key


def test_casefold_equals_python(spark):
    words = ["Straße", "ΣΊΣΥΦΟΣ", "ŉ", "İI", "ﬃ ﬆ", "ᾳᾼ", "ԵՒ և", "", "abC", "Ａｂ", "ǰ", None, "ẞ" * 3, "ͅ"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(casefold(F.col("w"))).collect()] == [None if w is None else w.casefold() for w in words]


@pytest.mark.parametrize(
    "word, title, tag",
    [
        ("שׁוֹשָׁן", "x", "HEB"), ("λόγος", "x", "GRC"), ("ἀρετή", "x", "GRC"), ("книга", "x", "CYR"), ("1. λόγος", "x", "GRC"),
        ("virtus", "Dictionary latininfl -> english", "LAT"), ("maison", "French - English", "FR"), ("word", "Some Glossary", None),
    ],
)
def test_tag(spark, word, title, tag):
    df = spark.createDataFrame([(word, title)], "w string, t string")
    assert df.select(language.tag(F.col("w"), F.col("t"))).first()[0] == tag


@pytest.mark.parametrize(
    "title, pair",
    [
        ("X (Lat-Fra)", ("LAT", "FR")), ("Greek-English Lexicon - Liddell & Scott", ("GRC", "ENG")), ("HEB-HEB y", ("HEB", "HEB")),
        ("bgl-Latin_English_Inflected", ("LAT", "ENG")), ("Hebrew and Aramaic Lexicon of the Old Testament", None), ("Middle_Liddell_stardict", None),
    ],
)
def test_pair(spark, title, pair):
    p = language.pair(F.col("t"))
    row = spark.createDataFrame([(title,)], "t string").select(p["source"], p["target"]).first()
    assert tuple(row) == (pair or (None, None))


def test_groups_and_quantities(spark):
    df = spark.createDataFrame([("", "hebrew"), ("untitled", None), ("Lat-Fra", None)], "t string, c string")
    assert [r[0] for r in df.select(language.group(F.col("t"), F.col("c"))).collect()] == ["HEB", "OTHER", "LAT"]
    n = spark.createDataFrame([(1,), (4009,), (0,)], "n bigint")
    assert [r[0] for r in n.select(language.quantity(F.col("n"), "result", "results")).collect()] == ["1 result", "4,009 results", "0 results"]


def test_sense_starts(spark):
    lines = ["¶ 1", "- a", "-a", "12. x", "iv) y", "IV", "word", "  2) z"]
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    assert [r[0] for r in df.select(language.starts_a_sense(F.col("l"))).collect()] == [True, True, False, True, True, False, False, True]
