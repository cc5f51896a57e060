"""Garbled text: what is learned, found and restored."""

import random

import pytest

from lexloom.llm import mojibake as J

WORDS = "présent déjà été grüßen Mädchen hören über façon naïve señor mañana canción corazón café forêt château fenêtre élève règle noël pêche tête âme île août cœur garçon leçon reçu größer müde Tür".split()


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "row_key bigint, value string")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    clean = [" ".join(rng.sample(WORDS, 6)) for _ in range(60)]
    garbled = {i: J.misread(" ".join(rng.sample(WORDS, 5)), c) for i, c in enumerate([("cp1252",)] * 12 + [("cp1251",)] * 12 + [("mac_roman",)] * 12 + [("cp1252", "cp1252")] * 8)}
    return clean, garbled


def test_chains_round_trip():
    for codec in J.CODECS:
        assert J.reread(J.misread("déjà “vu” λόγος слово מלך", (codec,)), codec) == "déjà “vu” λόγος слово מלך"
    assert J.reread("déjà", "cp1252") is None and J.reread("plain", "cp1252") == "plain"


def test_learning(spark, corpus):
    clean, garbled = corpus
    learned = J.learn_encodings(texts(spark, [*clean, *garbled.values()]))
    assert {"cp1252", "cp1251", "mac_roman"} <= set(learned)
    assert J.learn_encodings(texts(spark, clean)) == [] == J.learn_encodings(texts(spark, []))


def test_found_and_restored(spark, corpus):
    clean, garbled = corpus
    values = [*clean, *garbled.values(), "the letter Â, then Ã", "lost d�s", "", "plain", "слово λόγος מלך"]
    df = texts(spark, values)
    got = {r.row_key: r.original for r in J.restored(df, J.learn_encodings(df)).collect()}
    assert set(got) == {*range(len(clean), len(clean) + len(garbled)), values.index("lost d�s")}
    for i, v in enumerate(garbled.values()):
        assert set(got[len(clean) + i].split()) <= set(WORDS), v


def test_legacy_words(spark):
    words = ["словарь", "корень", "береза", "молоко", "дерево"]
    as_read = [w.encode("cp1251").decode("cp1252") for w in words]
    df = texts(spark, [*as_read, "été", "Öl", "àéè"])
    legacy = J.learn_legacy(df, texts(spark, words))
    assert legacy[0] == ("cp1252", "cp1251")
    got = {r.value: r.original for r in J.restored(df, [], [("cp1252", "cp1251")]).collect()}
    assert {got[a] for a in as_read} == set(words) and "été" not in got and "Öl" not in got


def test_nothing_learned_changes_nothing(spark):
    df = texts(spark, ["dÃ©jÃ\xa0", "a � b", None, ""]).filter("value is not null")
    assert [r.row_key for r in J.restored(df, []).collect()] == [1]


def test_fields(spark):
    defs = spark.createDataFrame([(1, ["a", None, "é"]), (2, None), (3, [])], "def_id bigint, entries array<string>")
    cards = spark.createDataFrame([(7, "hd\r\nh2\n\tbody é"), (8, None)], "card_id bigint, card string")
    got = sorted((r.field, r.row_key, r.value) for r in J.garbled_fields(defs, cards).collect())
    assert got == [("definition", 1, "a"), ("definition", 1, "é"), ("dsl_headword", 7, "h2"), ("dsl_headword", 7, "hd")]
    assert J.found(defs, cards).collect() == []


def test_long_text(spark):
    df = texts(spark, ["déjà " * 50_000, J.misread("déjà " * 50_000, ("cp1252",))])
    got = J.restored(df, ["cp1252"]).collect()
    assert [r.row_key for r in got] == [1] and got[0].original == "déjà " * 50_000


def test_lost_words_are_filled_in(spark, corpus):
    clean, _ = corpus
    lost = ["gr�¼�en", "pr�sent déjà", "coraz��n", "d�j�", "zz�zz", "m�nager"]
    df = texts(spark, [*clean, *lost]).selectExpr("'f' as field", "row_key", "0 as part", "value")
    got = J.restored(df, ["cp1252"])
    filled = {r.value: r.original for r in J.regained(got, df, ["cp1252"]).collect()}
    assert filled["gr�¼�en"] == "grüßen" and filled["pr�sent déjà"] == "présent déjà" and filled["coraz��n"] == "corazón"
    assert filled["zz�zz"] == "zz�zz" and filled["m�nager"] == "m�nager"
    assert J.could_be("�©", "é", ["cp1252"]) and not J.could_be("�©", "ü", ["cp1252"])


def test_an_encoding_outside_the_list_is_learned_from_twins(spark):
    rng = random.Random(2)
    assert "cp737" not in J.CODECS
    own = ["".join(rng.choice("bdfglmnprst") for _ in range(4)) + c + "".join(rng.choice("bdfglmnprst") for _ in range(3)) for c in "éèêüöñóç" for _ in range(5)]
    clean = [" ".join(rng.sample(own, 6)) for _ in range(60)]
    garbled = [J.misread(" ".join(rng.sample(own, 6)), ("cp737",)) for _ in range(40)]
    df = texts(spark, [*clean, *garbled])
    units = J.learned_units(J.twin_evidence(J.words_of(df)))
    assert {units.get(J.misread(c, ("cp737",))) for c in "éèêüöñóç"} == set("éèêüöñóç")
    got = {r.row_key: r.original for r in J.restored(df, [], [], units).collect()}
    right = sum(set(got.get(len(clean) + i, "").split()) <= set(own) for i in range(len(garbled)) if len(clean) + i in got)
    assert set(got) == set(range(len(clean), len(clean) + len(garbled))) and right >= 0.95 * len(garbled)
    # and through the whole operator, without any known encoding having a part in it
    defs = spark.createDataFrame([(i, [v]) for i, v in enumerate([*clean, *garbled])], "def_id bigint, entries array<string>")
    cards = spark.createDataFrame([], "card_id bigint, card string")
    assert {r.row_key for r in J.found(defs, cards).collect()} >= set(got)


def test_words_without_ascii_are_learned_from_whole_strings(spark):
    words = "словарь слово корень береза молоко дерево соловей молва народ дорога вера зерно переводчик весна лето осень село слон олень вереск колесо отец сено слива велосипед".split()
    read = lambda w: w.encode("koi8_r").decode("cp1250", "replace")  # noqa: E731 - a pair that LEGACY doesn't have
    words = [w for w in words if "�" not in read(w)]
    line = lambda i, w: f"entry number {i} of this list gives {w} in the first place"
    df = texts(spark, [line(i, w) for i, w in enumerate(words)] + [line(i, read(w)) for i, w in enumerate(words)] + ["été", "un œuf"])
    units = J.learned_units(J.record_evidence(df))
    assert len(units) > 5 and all(len(g) == 1 for g in units)
    known = [i for i, w in enumerate(words) if all(c in units for c in read(w))]
    got = {r.row_key: r.original for r in J.restored(df, [], [], units).collect()}
    assert known and all(got[len(words) + i] == line(i, words[i]) for i in known) and set(got) == {len(words) + i for i in known}


def test_spellings_are_no_mapping():
    assert J.units_of("é", "è") == [("é", "è")] and J.units_of("Ã©", "é") == [("Ã©", "é")] and J.units_of("Î»Î¿", "λο") == [("Î»", "λ"), ("Î¿", "ο")]
    assert J.units_of("é", "é") == [] and J.units_of("abc", "éè") == []


def test_one_accent_for_another_is_not_learned(spark):
    pairs = spark.createDataFrame([("é", "è", 9)], "garbled string, clean string, n long")
    assert J.learned_units(pairs) == {}


def test_markup_tells_nothing_of_the_word_in_it(spark, corpus):
    clean, garbled = corpus
    tags = ("\\emph{%s}", "\\textit{%s", "&lt;b&gt;%s&lt;", "&gt;%s&lt;br", "Category:%s", "'color'&gt;%s")
    other = [t % w for t in tags for w in ("à", "à", "τοῦ", "старой", "דָתָל")]
    values = [*clean, *garbled.values(), *other, "ἐκ τοῦ ξύλου", "у старой реки"]
    defs = spark.createDataFrame([(i, [v]) for i, v in enumerate(values)], "def_id bigint, entries array<string>")
    got = {r.row_key for r in J.found(defs, spark.createDataFrame([], "card_id bigint, card string")).collect()}
    assert got == set(range(len(clean), len(clean) + len(garbled)))


def test_words_that_differ_are_no_mapping(spark):
    garbled = [("Ã©", "é", 5), ("Ã¶ÃŸ", "öß", 3), ("รฉ", "é", 3), ("รผ", "ü", 3), ("รถ", "ö", 3), ("ГЁ", "è", 3)]
    chance = [("בֶגֶהַל", "γηκο", 1), ("צִרֶהֶם", "λεητ", 1), ("נַקֶהַן", "δσηυ", 1), ("а»бв", "λρ", 1), ("а»гд", "λσ", 1), ("а»еж", "λτ", 1), ("τοῦ", "à", 9), ("старой", "à", 9), ("на", "à", 9)]
    pairs = spark.createDataFrame(garbled + chance, "garbled string, clean string, n long")
    assert J.learned_units(pairs) == {"Ã©": "é", "Ã¶": "ö", "ÃŸ": "ß", "รฉ": "é", "รผ": "ü", "รถ": "ö", "ГЁ": "è"}


def test_a_word_read_in_part_is_none_of_a_legacy_encoding():
    one = J.Restorer([], [("mac_roman", "cp1251")])
    assert one("τήγυ(π)ειρ") == ("τήγυ(π)ειρ", False)
    assert one("слово".encode("cp1251").decode("mac_roman")) == ("слово", True)
