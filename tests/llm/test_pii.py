"""Personal information: spans, validators, redaction."""

import pytest
from pyspark.sql import functions as F

from lexloom.llm import pii as P

CASES = [
    ("write to ⟦ana.b+x@mail.example.com⟧ today", "email"), ("at ⟦ana [at] mail [dot] example [dot] org⟧.", "email"), ("⟦a_b(at)lex.example.test⟧", "email"), ("⟦A.B@LEX.EXAMPLE⟧", "email"),
    ("call ⟦+44 (0)7700 900 873⟧ now", "phone"), ("Tel. ⟦01632 960 417⟧.", "phone"), ("text me on ⟦(777) 555-0169⟧", "phone"), ("⟦1.212.555.0135⟧ (ask)", "phone"), ("Tel.: ⟦030/23125135⟧", "phone"),
    ("Tfno. ⟦900 00 01 88⟧", "phone"), ("appelez le ⟦05 36 49 59 52⟧.", "phone"), ("Tel.: ⟦0049 (0)30 23125 587⟧", "phone"),
    ("SSN: ⟦954-12-7063⟧, please", "id_number"), ("(NIR : ⟦2 86 99 02 552 460 81⟧)", "id_number"), ("DNI ⟦99.986.557-Z⟧", "id_number"), ("passport no. ⟦X00574457⟧", "id_number"),
    ("national insurance no. ⟦QQ 54 89 30 B⟧)", "id_number"), ("Steuer-ID: ⟦02 874 426 778⟧).", "id_number"), ("Personalausweis Nr.: ⟦L0J377127⟧)", "id_number"), ("pasaporte n.º ⟦X00539863⟧.", "id_number"),
    ("posted to ⟦Flat 7, 168 Some Road, Town⟧ in", "address"), ("at ⟦72 Old Bee Row, Town 00917⟧.", "address"), ("⟦50A Bee Terrace\nTown⟧.", "address"), ("Adresse : ⟦157, rue des Bees, 00953 Ville⟧.", "address"),
    ("⟦110 bis avenue Bee, Ville⟧", "address"), ("⟦Calle Bee, 126, 00488 Villa⟧.", "address"), ("⟦C/ Bee 106, 2.º B, Villa⟧", "address"), ("⟦Avda. de Bee n.º 238, Villa⟧", "address"), ("an ⟦Beestraße 28, 00390 Stadt⟧", "address"),
    ("⟦Bee-Str. 48, Stadt⟧.", "address"), ("⟦Am Beetor 26, 00879 Stadt⟧", "address"),
    ("thanks to ⟦Carla Beebaum⟧ for", "name"), ("Yours, ⟦Bastian BEEBAUM⟧.", "name"), ("who was ⟦Beebaum, Käthe⟧, the", "name"), ("⟦Emil von Beebaum⟧ sent", "name"), ("⟦Simon M. Bee-Baum⟧ said", "name"),
    ("checked by Dr. ⟦Thérèse d’Beebaum⟧ and", "name"), ("according to ⟦Braeph Beebaum⟧ the", "name"), ("⟦Noemi Jonas Beebaum⟧ wrote", "name"), ("Cordialement, ⟦Clara Beebaum⟧ Tél. : x", "name"),
]


@pytest.mark.parametrize("text, kind", CASES)
def test_spans(text, kind):
    start, end = text.index("⟦"), text.index("⟧") - 1
    plain = text.replace("⟦", "").replace("⟧", "")
    assert [(s.kind, s.start, s.end) for s in P.find(plain)] == [(kind, start, end)]
    assert P.redact(plain) == plain[:start] + f"[{kind.upper()}]" + plain[end:]


@pytest.mark.parametrize(
    "text",
    [
        "Order of 5-242-242 slips.", "Entry ids 1001661668 and up.", "ISBN 979-9-989-0989-7.", "Call number 363.6/363", "Shelfmark MS 33-760-0760 b.", "Checked 2019-07-17 at 14:37.", "Version 1.1.315.",
        "E.g. word@2 marks it. The handle @someone.", "The Bastian hypothesis, so called.", "Saint Helena and the 3 looms", "Cape Clara has its own word", "A barge named Nadia carries it", "The Bee Road sense",
        "Sodroestacrut Concise Dictionary", "Bee Press printed 661 copies.", "Mount Bee and Port Baum are rivers.", "page 639 of Bee Wordbook", "", "verse 4.975.4", "according to Bee Lexicon the sense",
    ],
)
def test_no_cases(text):
    assert P.find(text) == [] and P.redact(text) == text


def test_validators():
    assert P.luhn("4539578763621486") and not P.luhn("4539578763621487")
    assert P.valid_dni("12345678Z") and P.valid_dni("X1234567L") and not P.valid_dni("12345678A")
    assert P.valid_nir("255081416802538") and not P.valid_nir("255081416802539")
    assert P.valid_tax_id("86095742719") and not P.valid_tax_id("86095742718")
    # a number without label is taken only if its check letter is right
    assert [s.kind for s in P.find("it is 12345678Z here")] == ["id_number"] and P.find("it is 12345678A here") == []


def test_columns(spark):
    rows = [(1, "x 🐝 call +44 1632 960220 or a@b.example"), (2, None), (3, ""), (1, "x 🐝 call +44 1632 960220 or a@b.example"), (None, "thanks to Carla Beebaum for it")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("redacted_text", F.lit("old"))
    got = sorted((r.doc_id or 0, r.kind, r.start_pos, r.end_pos) for r in P.spans(df).collect())
    assert got == [(0, "name", 11, 23), (1, "email", 29, 39), (1, "email", 29, 39), (1, "phone", 10, 24), (1, "phone", 10, 24)]
    clean = [r.redacted_text for r in P.redacted(df).orderBy("doc_id", "text").collect()]
    assert clean == ["thanks to [NAME] for it", "x 🐝 call [PHONE] or [EMAIL]", "x 🐝 call [PHONE] or [EMAIL]", None, ""]
    assert P.spans(df.limit(0)).collect() == []


def test_redacted_texts_hold_nothing_more(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = 0
    for r in P.redacted(docs).select("text", "redacted_text").collect():
        spans = P.find(r.text)
        found += len(spans)
        parts = [r.text[a:b] for a, b in zip([0, *(s.end for s in spans)], [*(s.start for s in spans), len(r.text)])]
        assert r.redacted_text == "".join(x + y for x, y in zip(parts, [*(P.PLACEHOLDER[s.kind] for s in spans), ""]))
    assert found


def test_long_text():
    text = "word " * 100_000 + "call +44 1632 960220"
    assert [s.kind for s in P.find(text)] == ["phone"]


def test_given_names_outside_the_list_are_learned(spark):
    texts = [f"According to Dr {g} {f} the sense is old." for g in ("Wanjiru", "Oyelaran") for f in ("Kamau", "Adeyemi", "Njoroge")]
    texts += ["The sense, says Wanjiru Otieno here, is old.", "Then Oyelaran Mwangi came.", "So the Vellum Codex says.", "the copy of Dr Vellum Codex", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert P.learned_given(df) == {"wanjiru", "oyelaran"} and not P.find(texts[6])
    got = {(r.doc_id, texts[r.doc_id][r.start_pos - 1 : r.end_pos]) for r in P.spans(df).collect()}
    assert {(6, "Wanjiru Otieno"), (7, "Oyelaran Mwangi")} <= got and not any(d == 8 for d, _ in got)
    clean = [r.redacted_text for r in P.redacted(df).orderBy("doc_id").collect()]
    assert clean[7] == "Then [NAME] came." and clean[8] == texts[8] and clean[10] is None


OUTSIDE = "Kwame Wolfram Ayumi Yevgenia Tendai Ruaridh Ngozi Bronisław Saoirse Torvald Ximena Dagmar Leontyne Ishaan Marisol Anneliese Gwendolyn Bartholomäus Évariste Zoraida".split()
FAMILIES = "Mensah Hagedorn Takahashi Sokolova Moyo MacAskill Okonkwo Kowalczyk Gallagher Lindqvist Etxeberria Vogelsang Thibodeaux Raghunathan Cienfuegos Obermüller Lloyd-Jones Apfelbaum Quatrefages Villaseñor".split()
NEUTRAL = [
    "Contact {} about it.", "In the end {} wrote the second part.", "We met {} in the library.", "The draft went to {} last week.", "Nothing was heard of {} after that.", "The letter mentions {} and two others.",
    "Dann kam {} mit einem Brief.", "Im Sommer arbeitete {} an der Liste.", "On a vu {} au bureau.", "Plus tard, {} prit la parole.", "Ayer vino {} con la carta.", "La lista de {} es larga.",
]
NO_NAMES = [
    "The Harvest Moon Society printed the list.", "He read it in the Northern Star Gazette of that week.", "From Mount Kenning to Port Alden the road is long.", "Das Neue Wörterbuch liegt im Regal.", "La Rue Haute est longue.", "Die Lange Nacht war kalt und lang.",
    "we saw the harvest and the moon", "a northern star", "der neue Weg", "long roads", "kalte Nacht, lange Nacht", "the rue is haute",
]


def test_names_from_outside_in_neutral_sentences(spark):
    # every name once, so that nothing is learned of it but that its words are no ordinary ones
    names = [f"{g} {f}" for i, g in enumerate(OUTSIDE) for f in (FAMILIES[i], FAMILIES[(i * 7 + 3) % len(FAMILIES)])]
    texts = [NEUTRAL[i % len(NEUTRAL)].format(n) for i, n in enumerate(names)] + NO_NAMES
    assert not {w.casefold() for n in names for w in n.split()} & P._given
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, texts[r.doc_id][r.start_pos - 1 : r.end_pos]) for r in P.spans(df).filter("kind = 'name'").collect()}
    want = set(enumerate(names))
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_given_names_written_with_articles_stay_given_names(spark):
    texts = [f"according to Ngozi {f} the sense is old" for f in FAMILIES[:4]] + ["The Ngozi hypothesis", "A barge named Ngozi", "write to ngozi.moyo@mail.example"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    learned = P.learn(df)
    assert "ngozi" in learned.given and "ngozi" not in learned.ordinary


def test_last_words_of_works_and_firms_are_learned(spark):
    texts = [f"found in {w} Yearbook again" for w in "Brindle Castor Dunmore Elswick Fenwick Garrow Hexham".split()] + ["said Ana Dunmore of it"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert "yearbook" in P.learn(df).heads
    assert [(r.doc_id, r.kind) for r in P.spans(df).collect()] == [(7, "name")]


def test_checksums_decide_on_bare_numbers():
    kinds = lambda t: [s.kind for s in P.find(t)]
    assert kinds("paid with card 4111 1111 1111 1111 today") == ["card"] and kinds("paid with card 4111 1111 1111 1112 today") == []
    assert kinds("to DE89 3704 0044 0532 0130 00 please") == ["iban"] and kinds("to DE88 3704 0044 0532 0130 00 please") == []
    assert P.valid_iban("GB82WEST12345698765432") and not P.valid_iban("GB82WEST12345698765433")
    assert P.redact("card 4111111111111111.") == "card [CARD]."


def test_texts_without_any_sign_stay_as_they_are(spark):
    import re

    texts = [t.replace("⟦", "").replace("⟧", "") for t, _ in CASES]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(~F.col("t").rlike(P.ANY)).collect() == [] and re.search("@", P.ANY)
