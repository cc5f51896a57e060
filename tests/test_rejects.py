"""Rows that fail to parse, against a plain reading of the rules."""

import random
import re

from lexloom.operators import rejects

LINES = "line_id bigint, dict int, line_no bigint, line string"
CARDS = "card_id bigint, dict int, card_no bigint, card string"


def csv_fields(line):
    """The fields, or None if a quoted one isn't closed before a tab or the end."""
    out, at = [], 0
    while True:
        if line[at : at + 1] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"(?=\t|\Z)').match(line, at)
            if not m:
                return None
            out.append(m[1].replace('""', '"'))
            at = m.end()
        else:
            end = line.find("\t", at)
            end = len(line) if end < 0 else end
            out.append(line[at:end])
            at = end
        if at >= len(line):
            return out
        at += 1


def csv_valid(line):
    if line is None:
        return False
    line = line.removesuffix("\r")
    f = csv_fields(line)
    if f is None or len(f) != 6:
        return False
    return all(re.fullmatch("[0-9]{1,18}", f[i]) for i in (1, 5)) and bool(f[2].strip()) and not re.search(r"[\x00-\x08\x0a-\x1f]", line)


def nested(line):
    stack = []
    for c in line:
        if c in "({":
            stack.append(c)
        elif c in ")}" and (not stack or stack.pop() != {")": "(", "}": "{"}[c]):
            return False
    return not stack


def closed(line, opening, closing):
    depth = 0
    for t in re.findall(f"{re.escape(opening)}|{re.escape(closing)}", line):
        depth = depth + 1 if t == opening else max(0, depth - 1)
    return depth == 0


def card_valid(card):
    if card is None or re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f]|\r(?!\n)", card):
        return False
    lines = [x for x in re.split(r"\r?\n", card) if x.strip()]
    kinds = "".join("b" if x[0] in "\t " else "h" for x in lines)
    if not re.fullmatch("h+b+", kinds):
        return False
    for x, k in zip(lines, kinds):
        x = re.sub(r"\\.", "x", x)
        if k == "h" and not nested(re.sub(r"[^(){}]", "", x)):
            return False
        if k == "b" and (
            not re.fullmatch(r"(\[\])*", re.sub(r"[^\[\]]", "", x)) or not closed(x, "{{", "}}") or not closed(x, "<<", ">>")
            or re.search(r"\[m(?![0-9]?\])", x) or re.search(r"\[ref\]\s*\[/ref\]|<<\s*>>", x)
        ):
            return False
    return True


def judged(spark, lines=(), cards=()):
    a = spark.createDataFrame([(i, 0, i, x) for i, x in enumerate(lines)], LINES)
    b = spark.createDataFrame([(i, 0, i, x) for i, x in enumerate(cards)], CARDS)
    bad = {(r.format, r.rec_id): r.errors for r in rejects.faulty_records(a, b).collect()}
    good = {(r.format, r.rec_id): r for r in rejects.valid_records(a, b).collect()}
    assert not bad.keys() & good.keys() and len(bad) + len(good) == len(lines) + len(cards)
    return bad, good


CASES = {
    "a\t1\tb\tc\td\t2": None, "a\t1\tb\tc\td\t2\r": None, '"x\ty ""q"""\t1\tb\tc\t"d"\t2': None, "": "field_count", None: "null_text", "a\t1\tb\tc\td": "field_count",
    'a\t"1\tb\tc\td\t2': "bad_quoting", 'a\t1\t"b"x\tc\td\t2': "bad_quoting", "a\t1\t \tc\td\t2": "blank_headword", "a\tx\tb\tc\td\t2": "bad_id", "a\t1\tb\tc\td\t1e3": "bad_number",
    "a\t1\tb\tc\td\t" + "9" * 19: "bad_number", "a\x07\t1\tb\tc\td\t2": "control_character", "a\t1\tb\tc\td\t2\r\r": "control_character", 'said "so"\t1\tb"\tc\t\t2': None,
}


def test_lines(spark):
    lines = list(CASES)
    bad, good = judged(spark, lines=lines)
    for i, x in enumerate(lines):
        assert (CASES[x] in bad[("Csv", i)]) if CASES[x] else ("Csv", i) in good, x
        assert csv_valid(x) is (CASES[x] is None)
    assert good[("Csv", 2)].headwords == ["b"] and good[("Csv", 2)].body == ["d"]


CARD_CASES = {
    "w\n\tb": None, "w\r\n b\r\n": None, "w\n\n(x)y\n\n\tb\n\n  c": None, "w": "no_body", "\tb": "no_headword", "": "no_headword", None: "null_text", "w\n\tb\nv\n\tc": "headword_after_body",
    "w(\n\tb": "headword_brackets", "w({)}\n\tb": "headword_brackets", r"w\(" + "\n\tb": None, "w(((((((((x)))))))))\n\tb": None, "w((((((((((x)))))))){\n\tb": "headword_brackets",
    "w(\nv)\n\tb": "headword_brackets", "w\n\t[b": "tag_brackets", "w\n\t[[b]]": "tag_brackets", "w\n\tb]": "tag_brackets", "w\n\t{{x": "open_comment", "w\n\t{{x}} {{": "open_comment",
    "w\n\t<<x": "open_link", "w\n\t<<x>>": None, "w\n\t<< >>": "blank_link", "w\n\t[ref] [/ref]": "blank_link", "w\n\t[m1]x[/m]": None, "w\n\t[m]x": None, "w\n\t[m10]x": "bad_indent_tag",
    "w\n\t[mx]y": "bad_indent_tag", "w\n\t\x00b": "control_character", "w\rx\n\tb": "control_character", r"w" + "\n\t\\[m10\\]": None, "w\n\t[i][b]x[/i]": None, "w\n\t}} x": None,
}


def test_cards(spark):
    cards = list(CARD_CASES)
    bad, good = judged(spark, cards=cards)
    for i, x in enumerate(cards):
        assert (CARD_CASES[x] in bad[("Dsl", i)]) if CARD_CASES[x] else ("Dsl", i) in good, (x, bad.get(("Dsl", i)))
        assert card_valid(x) is (CARD_CASES[x] is None), x


def test_random_rows_against_the_rules(spark):
    rng = random.Random(3)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(rng.randrange(n)))
    lines = ["\t".join(rng.choice(["1", "12", "x", '"q"', '"a\tb"', '"', "", " ", 'a""', '"a""b"', "é", "\x01"]) for _ in range(rng.choice([5, 6, 6, 6, 6, 7]))) + rng.choice(["", "\r"]) for _ in range(600)]
    lines += [pick('"\ta1', 14) for _ in range(300)]
    cards = [rng.choice(["w", "w(x)", "w{y}", "\\(w", "w("]) + "\n" + rng.choice(["\t", " ", ""]) + pick(["[m1]", "[b]", "[", "]", "{{", "}}", "<<", ">>", "x", " ", "\\", "[ref]", "[/ref]", "\n\t"], 9) for _ in range(600)]
    cards += [pick("w(){}\\\n\t ", 12) for _ in range(300)]
    bad, _ = judged(spark, lines, cards)
    assert {i for k, i in bad if k == "Csv"} == {i for i, x in enumerate(lines) if not csv_valid(x)}
    assert {i for k, i in bad if k == "Dsl"} == {i for i, x in enumerate(cards) if not card_valid(x)}


def test_long_texts_repeats_and_clashing_columns(spark):
    lines = ["a\t1\tb\tc\t" + '"' + '""' * 200_000 + '"\t2'] * 2
    bad, good = judged(spark, lines, ["w" + "(x)" * 50_000 + "\n\t" + "[b]y[/b]" * 50_000])
    assert not bad and len(good) == 3
    clash = spark.createDataFrame([(1, 0, 1, "a\t1\tb\tc\td\t2", "mine", "e")], LINES + ", headword string, errors string")
    assert rejects.csv_records(clash).first().headword == "b"


def test_empty_tables(spark):
    assert judged(spark) == ({}, {})


def test_whole_table_against_the_rules(spark, data):
    t = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    bad = {(r.format, r.rec_id) for r in rejects.faulty_records(t("csv_lines"), t("dsl_cards")).collect()}
    want = {("Csv", r.line_id) for r in t("csv_lines").collect() if not csv_valid(r.line)} | {("Dsl", r.card_id) for r in t("dsl_cards").collect() if not card_valid(r.card)}
    assert bad == want and bad


def test_comments_and_links_nested_deep(spark):
    deep = lambda a, b, n, m: f"word\n\t{a * n}x{b * m}"
    cards = [deep(a, b, n, m) for a, b in (("{{", "}}"), ("<<", ">>")) for n, m in ((12, 12), (13, 13), (40, 40), (40, 39), (39, 40), (14, 12))]
    cards += ["word\n\t" + "{{" * 20 + "x\n\ty" + "}}" * 20, "word\n\t" + "{{" * 20 + "x" + "}}" * 20 + "\n\t{{y", "word\n\t}}" + "<<" * 20 + "x" + ">>" * 20 + ">>"]
    df = spark.createDataFrame([(i, 0, i, c) for i, c in enumerate(cards)], CARDS)
    got = {r.card_id: set(r.errors) & {"open_comment", "open_link"} for r in rejects.dsl_records(df).collect()}
    for i, card in enumerate(cards):
        lines = card.split("\n")[1:]
        want = {name for name, a, b in (("open_comment", "{{", "}}"), ("open_link", "<<", ">>")) if not all(closed(x, a, b) for x in lines)}
        assert got[i] == want, card
