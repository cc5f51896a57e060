"""Headwords filed again in other layouts, against a plain grouping."""

import random
from collections import defaultdict

import regex

from lexloom.llm import layout_duplicates as L

SCHEMA = "slot bigint, dict int, word string"


def brute(rows):
    groups = defaultdict(list)
    for slot, d, w in rows:
        if w is not None:
            groups[d, tuple(sorted(regex.findall(r"[\p{L}\p{M}\p{N}]+", w.casefold())))].append(slot)
    return groups


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    groups = brute(rows)
    pairs = {(r.key_a, r.key_b) for r in L.duplicate_pairs(df).collect()}
    assert pairs == {(min(g), s) for g in groups.values() for s in g if s != min(g)}
    got = sorted((r.slot, r.copies) for r in L.collapse(df).collect())
    assert got == sorted((min(g), len(g)) for g in groups.values())


def test_random(spark):
    rng = random.Random(2)
    words = ["Ad  lib", "lib, ad", "AD-LIB", "ad lib", "ad lib lib", "straße", "STRASSE", "é", "é", "—", "...", "", None, "ςσ", "ΣΣ", "x (2)", "(2) x", "x 3", "ﬁn", "fin"]
    check(spark, [(i, rng.choice([1, 2, None]), rng.choice(words)) for i in range(400)])


def test_hot_group_and_repeats(spark):
    check(spark, [(i, 7, "hot" if i % 3 else f"w{i}") for i in range(3000)])
    check(spark, [(1, 1, "a"), (1, 1, "a"), (2, 1, "A")])


def test_empty_long_and_clashing_columns(spark):
    check(spark, [])
    check(spark, [(1, 1, "b a " * 50_000), (2, 1, "A B " * 50_000)])
    df = spark.createDataFrame([(1, 1, "a", 5, "x"), (2, 1, "A", 6, "y")], SCHEMA + ", n int, raw string")
    assert [tuple(r) for r in L.duplicate_pairs(df).collect()] == [(1, 2)]
