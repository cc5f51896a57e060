"""One form for text that looks the same."""

import unicodedata as U

import pytest

from lexloom.llm import lookalikes as L

SCHEMA = "field string, row_key bigint, value string"


def run(spark, values):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], SCHEMA)
    return {r.row_key: (r.usual, r.is_case) for r in L.consistent(df).collect()}


def test_classes_are_transitive_and_disjoint():
    groups = L.classes()
    seen = [m for ms in groups.values() for m in ms]
    assert len(seen) == len(set(seen))
    of = {m: root for root, ms in groups.items() for m in ms}
    assert of["a"] == of["ａ"] == of["а"] == of["α"]
    assert of["é"] == of["é"] and of["ά"] == of["ά"] == of["ά"]


COMMON = ["word", "anderer", "λόγος", "ἄνθρωπος", "слово", "другое", "מלך", "מֶלֶךְ", "déjà", "st", "x (2)", "καί"] * 3


@pytest.mark.parametrize(
    "value, usual",
    [
        ("ｗｏｒｄ", "word"), ("w\u043erd", "word"), ("word\u200b", "word"), ("x\u00a0(2)", "x (2)"), ("de\u0301ja\u0300", "déjà"), ("λ\u00f3γος", "λόγος"),
        ("λ\u1f79γος", "λόγος"), ("c\u043bo\u0432o", "слово"), ("\ufb06", "st"), ("\u200eword\u2060", "word"), ("\ufb21לך", "אלך"), ("x (２)", "x (2)"), ("\u2170x", "ix"),
    ],
)
def test_cases(spark, value, usual):
    got = run(spark, [*COMMON, value])[len(COMMON)]
    assert got == (usual, True)


def test_usual_values_stay(spark):
    values = [*COMMON, "a\tb\r\n", "", None, "«x»", "1.2", "vi", "ix", "n-1"]
    for i, (usual, case) in run(spark, values).items():
        assert usual == values[i] and not case


def test_no_look_alike_known_is_still_a_case(spark):
    assert run(spark, [*COMMON, "wordж"])[len(COMMON)] == ("wordж", True)


def test_rewriting_twice_changes_nothing(spark, data):
    t = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    values = L.spellings(t("headwords"), t("dictionaries"), t("home_rows"), t("guest_rows"))
    rows = L.consistent(values).collect()
    counts = {r.sign: r.n for r in L.count_signs(values.select("value")).collect()}
    again = L.Rewriter(counts)
    cases = [r for r in rows if r.is_case]
    assert cases and len(rows) == values.count()
    for r in cases:
        assert again(r.usual)[0] == r.usual
        assert not any(L.unseen(c) or L.other_space(c) for c in r.usual)
        assert U.normalize("NFC", r.usual) == r.usual or L._script_of(r.usual) == "Hebrew"


def test_empty_and_long(spark):
    assert run(spark, []) == {}
    assert run(spark, ["wоrd " * 100_000])[0] == ("word " * 100_000, True)


def test_values_of_usual_signs_are_as_the_automaton_leaves_them():
    import random

    rng = random.Random(3)
    signs = "abcoxеоаλόγοςсловоמלךÀéñßＡ１²ﬁ ​ -'́·ӱёйϲⅰⅨ½№ª"
    one, slow = (L.Rewriter({c: i + 1 for i, c in enumerate(signs)}) for _ in range(2))
    slow.usual = lambda c: None
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 5)))
        assert one(text) == slow(text), ascii(text)


def test_look_alikes_of_further_scripts():
    import itertools

    groups = [set(ms) for ms in L.classes().values()]
    of = lambda c: next(g for g in groups if c in g)
    for alike in ("oοоօⲟ", "AΑАᎪ", "SЅՏᏚ", "pρрⲣ"):
        assert all(of(a) is of(b) for a, b in itertools.combinations(alike, 2)), alike
    one = L.Rewriter({c: 5 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    assert one("wօrd") == ("word", True) and one("ᎪBLE") == ("ABLE", True) and one("օրդո") == ("օրդո", False)
