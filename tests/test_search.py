"""Search, grouping, folding and limits: golden rows, and random collections against a sequential model."""

import random

import pytest

from lexloom.functions import keys
from lexloom.operators import collection, index, search


def make(spark, *dicts, aliases=(), ids=()):
    """Keyed headwords of dictionaries given as lists of words."""
    rows, slot = [], 0
    for d, words in enumerate(dicts):
        for i, w in enumerate(words):
            rows.append((d, i, slot, w, slot in aliases, ids[slot] if slot < len(ids) else None))
            slot += 1
    return index.keyed(spark.createDataFrame(rows, "dict int, idx bigint, slot bigint, word string, is_alias boolean, entry_id bigint")).cache()


def rows(df):
    return [(r.word, [(m.dict, m.spelling) for m in r.members]) for r in df.orderBy("bare_key", "first_slot").collect()]


def words(df):
    return [w for w, _ in rows(df)]


def scope(spark, *flags):
    return spark.createDataFrame(list(enumerate(flags)), "dict int, scope boolean")


def test_prefix_and_members(spark):
    at = make(spark, ["Apple", "apricot"], ["apple", "grape"])
    assert rows(search.search(at, "ap")) == [("Apple", [(0, "Apple"), (1, "apple")]), ("apricot", [(0, "apricot")])]
    assert rows(search.search(at, "ap", 1)) == [("Apple", [(0, "Apple"), (1, "apple")])]
    assert words(search.search(at, "ap", scope=scope(spark, False, True))) == ["apple"]
    assert words(search.search(at, "ap", scope=scope(spark, False))) == ["apple"]
    assert words(search.search(at, "ap", scope=scope(spark, False, False))) == []
    for q in ("", "  ", "zzz", "ְ"):
        assert words(search.search(at, q)) == []
    assert words(search.search(at, "ap", 0)) == []


def test_marked_queries(spark):
    at = make(spark, ["מֶלֶךְ", "מָלָךְ", "מלך"])
    assert len(rows(search.search(at, "מלך"))) == 3
    assert words(search.search(at, "מֶלֶךְ")) == ["מֶלֶךְ"]
    assert words(search.search(at, "מֶלך")) == ["מֶלֶךְ"]
    greek = make(spark, ["λόγος", "λὸγος", "λογος"])
    assert len(rows(search.search(greek, "λογος"))) == 3
    assert words(search.search(greek, "λόγος")) == words(search.search(greek, "λόγοσ")) == ["λόγος"]


def test_absorption(spark):
    at = make(spark, ["כאב לב", "כְּאֵב לֵב"])
    assert rows(search.search(at, "כאב")) == [("כְּאֵב לֵב", [(0, "כְּאֵב לֵב"), (0, "כאב לב")])]
    assert words(search.search(make(spark, ["mur", "mûr"]), "mur")) == ["mur", "mûr"]
    assert len(words(search.search(make(spark, ["εἰ", "εἶ"]), "ει"))) == 2


def test_homographs(spark):
    assert rows(search.search(make(spark, ["rex (1)", "Rex (2)"], ["rex"]), "rex")) == [("rex", [(0, "rex (1)"), (0, "Rex (2)"), (1, "rex")])]


def test_fold_forms(spark):
    at = make(spark, ["rego", "rexi", "rexit", "rexerint"], aliases=(2, 3), ids=(0, 1, 0, 0))
    assert words(search.search(at, "rex")) == ["rexerint", "rexi", "rexit"]
    assert words(search.search(at, "rex", fold_forms=True)) == ["rexerint", "rexi"]
    assert words(search.search(at, "rexit", fold_forms=True)) == ["rexit"]
    at = make(spark, ["rego", "rex"], ["rex"], aliases=(1,), ids=(0, 0))
    assert [[d for d, _ in m] for _, m in rows(search.search(at, "rex", fold_forms=True))] == [[0, 1]]
    at = make(spark, ["טוּנִיקָה", "טוֹנִיקָה", "טוניקה"], aliases=(2,), ids=(5, 6, 5))
    assert len(rows(search.search(at, "טוניקה", fold_forms=True))) == 3


def test_resolve(spark):
    at = make(spark, ["Apple", "apricot"], ["apple", "grape"])
    assert rows(search.resolve(at, "appl")) == rows(search.resolve(at, "zzz")) == []
    assert rows(search.resolve(at, "apple")) == [("Apple", [(0, "Apple"), (1, "apple")])]
    assert rows(search.resolve(at, "apple", scope(spark, False, True))) == [("apple", [(1, "apple")])]


def test_page(spark):
    at = make(spark, ["a1", "a2", "a3"])
    got, more = search.page(at, "a", 2)
    assert words(got) == ["a1", "a2"] and more
    got, more = search.page(at, "a", 3)
    assert words(got) == ["a1", "a2", "a3"] and not more


# --- a sequential model ---------------------------------------------------------------------------------------------


def model(entries, query, limit, fold):
    """entries: (dict, word, alias, id) in slot order."""
    folded = keys.fold(query.strip())
    needle = keys.bare(folded)
    marked = needle != keys.strip_homograph(folded)
    if not needle:
        return []
    found = sorted((keys.bare(keys.fold(w)), s, d, w, a) for s, (d, w, a, _) in enumerate(entries) if keys.bare(keys.fold(w)).startswith(needle) and (not marked or keys.marks_allow(folded, w)))
    ids = {}
    for d, w, _, e in entries:
        if e is not None:
            ids.setdefault((d, w), set()).add((d, e))
    out, seen = [], set()
    for key in sorted({f[0] for f in found}):
        if limit is not None and len(out) >= limit:
            break
        groups = {}
        for _, _, d, w, a in (f for f in found if f[0] == key):
            groups.setdefault(keys.strip_homograph(keys.fold(w)), []).append((d, w, a))
        silent = {c: all(a for *_, a in ms) for c, ms in groups.items()}
        members = {c: list(ms) for c, ms in groups.items()}
        top = [c for c in groups if not any(o != c and keys.marks_allow(c, o) for o in groups)]
        for c in list(groups):
            if c in top:
                continue
            hosts = [h for h in top if keys.only_optional_marks(h) and keys.marks_allow(c, h)]
            if len(hosts) == 1:
                members[hosts[0]] += members.pop(c)
                silent[hosts[0]] &= silent[c]
            else:
                silent[c] = False
        for c, ms in members.items():
            own = groups[c]
            shown = own[0][1]
            if keys.strip_homograph(shown) != shown:
                shown = next((w for _, w, _ in own if keys.strip_homograph(w) == w), shown)
            flat = []
            for d, w, _ in sorted(ms, key=lambda m: m[0]):
                if not flat or flat[-1] != (d, w):
                    flat.append((d, w))
            mine = set().union(*(ids.get(m, set()) for m in flat))
            hidden = fold and silent[c] and mine and mine <= seen
            seen |= mine
            if not hidden:
                out.append((shown, flat))
    return out


POOL = ["rex", "Rex (2)", "rexi", "rexit", "réx", "rêx", "כאב", "כְּאֵב", "כָּאֵב", "כְּאב", "λόγος", "λογος", "λόγοσ", "mur", "mûr", "rex (1)"]


@pytest.mark.parametrize("seed", range(6))
def test_against_the_model(spark, seed):
    rng = random.Random(seed)
    dicts = [[rng.choice(POOL) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
    n = sum(map(len, dicts))
    ids = [rng.randrange(4) if rng.random() < 0.7 else None for _ in range(n)]
    aliases = {s for s in range(n) if rng.random() < 0.5}
    at = make(spark, *dicts, aliases=aliases, ids=ids)
    flat = [(d, w) for d, ws in enumerate(dicts) for w in ws]
    entries = [(d, w, s in aliases, ids[s]) for s, (d, w) in enumerate(flat)]
    for query, limit, fold in (("r", None, True), ("כ", None, True), ("re", 2, False), ("rex", None, True), ("λ", 1, True), ("m", None, False), ("כְּאב", None, True)):
        assert rows(search.search(at, query, limit, fold_forms=fold)) == model(entries, query, limit, fold), (query, dicts, ids, aliases)


def test_folding_keeps_every_entry_reachable(spark):
    rng = random.Random(9)
    ws = [rng.choice(POOL) + rng.choice("abc") for _ in range(40)]
    ids = [rng.randrange(12) for _ in ws]
    at = make(spark, ws, aliases={i for i in range(40) if i % 3}, ids=ids)
    entry = {}
    for w, e in zip(ws, ids):
        entry.setdefault(w, set()).add(e)
    shown = lambda fold: {e for _, ms in rows(search.search(at, "r", fold_forms=fold)) for _, w in ms for e in entry[w]}
    assert shown(True) == shown(False)


def test_batch_equals_single_searches(spark):
    at = make(spark, POOL[:8], POOL[8:], ["r", "ré", "rexes"])
    asked = [(1, "re"), (2, "r"), (3, ""), (4, "כְּ"), (5, " REX "), (6, "réx"), (7, None)]
    got = search.batch_search(at, spark.createDataFrame(asked, "query_id int, query string")).collect()
    for i, q in asked:
        mine = sorted((r.bare_key, r.first_slot, r.word) for r in got if r.query_id == i)
        assert mine == sorted((r.bare_key, r.first_slot, r.word) for r in search.search(at, q or "").collect())


def test_plan_pushes_the_prefix_and_skips_python(spark, tmp_path):
    path = str(tmp_path / "ix")
    heads = spark.createDataFrame([(0, i, i, f"word{i}", False, None) for i in range(50)], "dict int, idx bigint, slot bigint, word string, is_alias boolean, entry_id bigint")
    at = index.open_or_build(spark, heads, path)
    assert index.is_current(spark, heads, path) and not index.is_current(spark, heads.limit(3), path)
    plan = search.candidates(at, "word1")._jdf.queryExecution().toString()
    assert "StringStartsWith(bare_key" in plan and "Python" not in plan and "Arrow" not in plan


def test_slots_and_counts(spark):
    heads = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (4, 0, "c")], "dict int, idx bigint, word string")
    assert [(r.dict, r.base) for r in index.slot_bases(heads).orderBy("dict").collect()] == [(1, 0), (4, 2)]
    assert sorted(r.slot for r in index.with_slots(heads).collect()) == [0, 1, 2]


def test_collection_orders_and_labels(spark):
    dicts = spark.createDataFrame(
        [(0, "/b/one.ifo", "same", "same", None, True, "x", None), (1, "/b/two.ifo", "same", "same", 3, None, "x", None), (2, "/c/z.csv", "Alpha", "own", 1, False, "x", None)],
        "dict int, path string, label string, name string, cfg_order bigint, scope boolean, derived string, language string",
    )
    assert [r.dict for r in collection.reading_order(dicts).orderBy("rank").collect()] == [2, 1, 0]
    asked = spark.createDataFrame([(0, 2), (1, 0), (2, 2), (3, 1)], "pos int, dict int")
    assert [r.dict for r in collection.repaired_order(asked, dicts).orderBy("rank").collect()] == [2, 0, 1]
    assert [r.label for r in collection.disambiguated(dicts).orderBy("dict").collect()] == ["same (one)", "same (two)", "Alpha"]
    assert [(r.label, r.n) for r in collection.repeated_labels(dicts).collect()] == [("same", 2)]
    heads = spark.createDataFrame([(0, "w")] * 5 + [(2, "v")], "dict int, word string")
    size = collection.scope_size(dicts, heads)
    assert collection.library_size(size).first()[0] == "5 words · 2 of 3 dictionaries"
    assert collection.status(size, 1, False, True).first()[0] == "1 result · 2 of 3 dictionaries · forms folded"
    assert collection.status(size, 500, True, False).first()[0] == "500+ results · 2 of 3 dictionaries"


def test_definitions(spark):
    at = make(spark, ["byte", "byte (2)"], ["byte"])
    dicts = spark.createDataFrame([(0, "A", "a", 2, True), (1, "B", "b", 1, None)], "dict int, label string, derived string, cfg_order bigint, scope boolean")
    defs = spark.createDataFrame([(1, 0, "byte", ["x", "x", ""]), (2, 0, "byte (2)", ["x", "y"]), (3, 1, "byte", ["z"]), (4, 1, "other", None)], "def_id bigint, dict int, word string, entries array<string>")
    got = collection.definitions_of(search.search(at, "byte"), collection.entries_of(defs), dicts).orderBy("rank").collect()
    assert [(r.dict, r.entries) for r in got] == [(1, ["z"]), (0, ["x", "x", "y"])]


def test_sense_lines(spark):
    df = spark.createDataFrame([(1, "head\n1. one\nmore\n\n2) two"), (2, None), (3, "")], "k bigint, t string")
    got = [(r.k, r.line_no, r.sense, r.kind) for r in collection.sense_lines(df, "k", "t").orderBy("k", "line_no").collect()]
    assert got == [(1, 0, 0, "body"), (1, 1, 1, "sense"), (1, 2, 1, "within"), (1, 3, 1, "body"), (1, 4, 2, "sense"), (3, 0, 0, "body")]
