"""Record linkage: keys, blocking against all pairs, and accuracy on made-up collections."""

import random

import pandas as pd
import pytest

from lexloom.llm import linkage as K

ROWS = "row_id bigint, word string, members array<struct<dict:int,spelling:string>>, label string, gloss string"
MORE = [a + b for a in "br cl dr fl gr".split() for b in "eck ost ind uft arm".split()]
NOUNS = "ditch bell plough roof anchor spear market cave river ladder oath coin tower garden letter horn".split() + [w + "on" for w in MORE]
ADJS = "heavy dry gentle broad bitter curved early silent rustic hollow lame iron woven sacred".split() + [w + "ish" for w in MORE]
OTHER = {"ditch": "trench", "broad": "wide", "gentle": "mild", "market": "fair", "coin": "penny"}


@pytest.mark.parametrize("a, b", [("Vita", "uita"), ("ΛΌΓΟΣ", "λόγος"), ("wοrd", "word"), ("rex (2)", "REX"), ("khan", "chan"), ("ёлка", "елка"), ("Лагя", "лагя"), ("ΔΉΜΗ", "δήμη"), ("Вord", "Bord"), ("ｗｏｒｄ​", "word"), ("מֶלֶךְ", "מלך")])
def test_skeletons_agree(a, b):
    assert set(K.skeletons(a)) & set(K.skeletons(b))


def test_skeletons_differ():
    assert not set(K.skeletons("word")) & set(K.skeletons("ward")) and K.skeletons(None) == K.skeletons("") == []
    assert K.label_key("The Big Wordbook, 2nd ed.") == K.label_key("big_wordbook") and K.label_key(None) is None


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def collections(rng, n):
    """Two collections with a known truth: words, some spelled alike with another meaning, glosses reworded."""
    home, guest, truth = [], [], set()
    for i in range(n):
        word = "".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(4))
        for twin in range(2 if rng.random() < 0.15 else 1):
            a, b, x, y = *rng.sample(NOUNS, 2), *rng.sample(ADJS, 2)
            dicts = rng.sample(range(8), 3)
            h = len(home)
            home.append((h, word, [(d, word) for d in dicts], f"Book{dicts[0]} Wordbook", None if rng.random() < 0.05 else f"the {y} {a} kept by the {x} {b}"))
            if rng.random() < 0.6:
                a, b, x, y = (OTHER.get(w, w) if rng.random() < 0.5 else w for w in (a, b, x, y))
                gloss = rng.choice([f"the {y} {a} kept by the {x} {b}", f"the {x} {b} kept by the {y} {a}"])
                g = 10_000 + len(guest)
                if rng.random() < 0.05:
                    word = word[:3] + rng.choice("xz") + word[3:]  # misspelled throughout
                guest.append((g, word.upper() if rng.random() < 0.2 else word, [(7 - d, word) for d in dicts], f"the book{dicts[0]} wordbook", None if rng.random() < 0.05 else gloss))
                truth.add((h, g))
    return home, guest, truth


@pytest.fixture(scope="module")
def made(spark):
    home, guest, truth = collections(random.Random(3), 700)
    dicts = spark.createDataFrame([(d, f"Book{d} Wordbook") for d in range(8)], "dict int, label string")
    return spark.createDataFrame(home, ROWS), spark.createDataFrame(guest, ROWS), dicts, truth


def test_accuracy(made):
    home, guest, dicts, truth = made
    got = K.link(home, guest, dicts).collect()
    pairs = {(r.row_a, r.row_b) for r in got}
    hit = len(pairs & truth)
    assert hit / len(truth) > 0.95 and hit / len(pairs) > 0.95
    assert all(0.5 <= r.confidence <= 1 for r in got) and len(got) == len(pairs)


def test_learned_words_and_numbers(made):
    home, guest, _, _ = made
    stop = K.common_words(home, guest)
    pairs = K.candidates(K.prepared(home, stop, None), K.prepared(guest, stop, None)).cache()
    assert K.learned_synonyms(pairs) == {v: k for k, v in OTHER.items() if v in K.learned_synonyms(pairs)}
    assert K.learned_synonyms(pairs)["trench"] == "ditch"
    assert K.learned_dicts(pairs) == {7 - d: d for d in range(8)}


def test_blocking_equals_all_pairs_and_hot_blocks_lose_nothing(made):
    home, guest, _, _ = made
    h, g = K.prepared(home, set(), None).cache(), K.prepared(guest, set(), None).cache()
    hs, gs = h.collect(), g.collect()
    near = lambda a, b: bool(set(a["exact"]) & set(b["exact"])) or edits(a.word_key, b.word_key) <= K.EDITS
    want = {(a.row_id, b.row_id) for a in hs for b in gs if set(a["keys"]) & set(b["keys"]) and near(a, b)}
    assert any(not set(a["exact"]) & set(b["exact"]) for a in hs for b in gs if (a.row_id, b.row_id) in want)
    got = [(r.h_row_id, r.g_row_id) for r in K.candidates(h, g).collect()]
    assert set(got) == want and len(got) == len(want)
    hot = [(r.h_row_id, r.g_row_id) for r in K.candidates(h, g, hot_pairs=0).collect()]
    share = {(a.row_id, b.row_id) for a in hs for b in gs if (a.row_id, b.row_id) in want and (set(a["tokens"]) & set(b["tokens"]) or set(a["labels"]) & set(b["labels"]))}
    assert set(hot) == share and len(hot) == len(share)


def test_hot_blocks_keep_pairs_without_common_words_or_labels(spark):
    home = [(i, "word", [(1, "word")], None, g) for i, g in enumerate([None, "a heavy ditch", "the old bell", None])]
    guest = [(10 + i, "word", [(2, "word")], label, g) for i, (label, g) in enumerate([(None, None), ("Book", "a heavy trench"), (None, "plough")])]
    h, g = (K.prepared(spark.createDataFrame(rows, ROWS), set(), None).cache() for rows in (home, guest))
    for hot_pairs in (0, 1, 5, 1_000_000):
        got = [(r.h_row_id, r.g_row_id) for r in K.candidates(h, g, hot_pairs).collect()]
        assert sorted(got) == [(a[0], b[0]) for a in home for b in guest]


def test_words_two_edits_apart_meet_wherever_the_edits_are(spark):
    rng = random.Random(5)
    pairs = {("pagoret", "pagaret"), ("magoret", "magorex"), ("xagoretilumx", "yagoretilumy"), ("ab", "abcd"), ("a", "abc")}
    for _ in range(300):
        a = b = "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 12)))
        for _ in range(2):
            at = rng.randint(0, len(b))
            b = b[:at] + rng.choice(["", rng.choice("abcdefg")]) + b[at + rng.randint(0, 1) :]
        if b and edits(a, b) <= K.EDITS:
            pairs.add((a, b))
    for a, b in pairs:
        assert K.own_parts(a) & K.parts_met(b), (a, b)
    rows = lambda i: [(n * 10 + i, p[i], [(1, p[i])], None, None) for n, p in enumerate(sorted(pairs))]
    h, g = (K.prepared(spark.createDataFrame(rows(i), ROWS), set(), None, side).cache() for i, side in ((0, "h"), (1, "g")))
    keys = lambda rs: [(r.row_id, set(r.exact), r.word_key) for r in rs.collect()]
    want = {(i, j) for i, x, a in keys(h) for j, y, b in keys(g) if x & y or edits(a, b) <= K.EDITS}
    for hot_pairs in (3, 1_000_000):
        got = [(r.h_row_id, r.g_row_id) for r in K.candidates(h, g, hot_pairs).collect()]
        assert set(got) == want and len(got) == len(want)


def test_a_hot_lemma_keeps_the_words_of_its_meaning(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(5))
    gloss = lambda a, x: f"the {x} {a} kept by the {rng.choice(ADJS)} {rng.choice(NOUNS[5:])}"
    rows = [(word(), gloss(rng.choice(NOUNS[5:]), rng.choice(ADJS))) for _ in range(200)]
    rows += [(rng.choice(["Hotword", "hotword", "hotword (2)"]), gloss("ditch", "humid")) for _ in range(150)]
    rows += [(None, gloss("bell", "humid")) for _ in range(3)]
    df = spark.createDataFrame([(i, w, [] if w is None else [(1, w)], None, g) for i, (w, g) in enumerate(rows)], ROWS)
    stop = K.common_words(df)
    assert {"the", "kept", "by"} <= stop and not {"ditch", "humid", "bell"} & stop


def test_a_hot_lemma_does_not_hide_the_synonyms_of_the_others(spark):
    tokens = lambda *ws: sorted(ws)
    rows = [(f"word{i}", tokens("ditch", f"a{i}", f"b{i}"), tokens("trench", f"a{i}", f"b{i}")) for i in range(5)]
    rows += [("hot", tokens("bell", "x", "y"), tokens("chime", "x", "y"))] * 9_000
    rows += [("hot", tokens("bell", "x", "y", f"c{i}"), tokens("trench", "x", "y", f"c{i}")) for i in range(20)]
    pairs = spark.createDataFrame(rows, "h_word_key string, h_tokens array<string>, g_tokens array<string>")
    # the first is told by five lemmas against one, the other by one case given often
    assert K.learned_synonyms(pairs) == {"trench": "ditch"}
    guest = spark.createDataFrame([(1, ["a", "trench", "ditch"]), (2, []), (3, ["bell"])], "rid bigint, tokens array<string>")
    assert {r.g_rid: sorted(r.g_same) for r in K.translated(guest, K.synonym_table(pairs)).collect()} == {1: ["a", "ditch"], 3: ["bell"]}


def test_expectation_maximisation_separates():
    rows = [(2, 4, 1, 3, 0, 900), (2, 0, 0, 0, 1, 500), (2, 3, 1, 2, 0, 300), (2, 1, 0, 0, 1, 90), (2, -1, 1, 3, 0, 60), (2, 0, 1, 1, 1, 40)]
    got = K.expectation_maximisation(pd.DataFrame(rows, columns=[*K.LEVELS, "n"])).confidence.tolist()
    assert got[0] > 0.99 and got[2] > 0.99 and got[4] > 0.9 and got[1] < 0.01 and got[3] < 0.1 and got[5] < 0.5


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "word", [(1, "word")], None, None), (2, None, None, None, ""), (3, "", [], "L", "g"), (4, "word", [(1, None), None], "L", "a gloss of it"), (4, "word", [(1, None)], "L", "a gloss of it")]
    df = spark.createDataFrame(rows, ROWS)
    for a, b in ((df, df), (df, df.limit(0)), (df.limit(0), df)):
        for r in K.link(a, b, least=0.0).collect():
            assert {r.row_a, r.row_b} <= {1, 4} and 0 <= r.confidence <= 1
    assert K.link(df.limit(0), df.limit(0)).columns[-1] == "confidence"


def test_links_are_the_same_however_blocks_are_cut(spark):
    home, guest, _ = collections(random.Random(11), 150)
    # a hot lemma, of which some rows have neither label nor gloss
    home += [(5000 + i, "hotword", [(1, "hotword")], None, None if i % 3 else "the heavy ditch kept by the dry bell") for i in range(20)]
    guest += [(20_000 + i, "hotword", [(6, "hotword")], None, None if i % 2 else "the heavy trench kept by the dry bell") for i in range(15)]
    home, guest = (spark.createDataFrame(rows, ROWS) for rows in (home, guest))
    got = [sorted((r.row_a, r.row_b, round(r.confidence, 6)) for r in K.link(home, guest, hot_pairs=n).collect()) for n in (0, 20, 1_000_000)]
    assert got[0] and got[0] == got[1] == got[2]


def test_words_misspelled_at_both_ends_are_linked(spark):
    rng = random.Random(13)
    home, guest, truth = collections(rng, 300)
    changed = []
    for g in guest:
        word = g[1]
        if rng.random() < 0.3:
            word = rng.choice("xz") + word[1:-1] + rng.choice("xz")
            changed.append(g[0])
        changed_row = (g[0], word, [(d, word) for d, _ in g[2]], g[3], g[4])
        guest[guest.index(g)] = changed_row
    links = {(r.row_a, r.row_b) for r in K.link(spark.createDataFrame(home, ROWS), spark.createDataFrame(guest, ROWS)).collect()}
    both = {(h, g) for h, g in truth if g in set(changed)}
    assert len(both) > 40 and len(links & both) / len(both) > 0.85


def test_plain_spellings_have_the_skeleton_of_all_others():
    assert all(K._sign(chr(c)) == chr(c) for c in range(32, 127))
    assert K.skeletons("Rex Vita (2)") == K.skeletons("rex​ vita") == ["rex uita"]
