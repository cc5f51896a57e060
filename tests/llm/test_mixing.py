"""Mixing to target shares: rates, copies and reported shares."""

import pytest

from lexloom.llm import mixing as M
from lexloom.session import table

DOCS, TARGETS = "doc_id bigint, source string, text string", "source string, target_share double, max_repeats int"


def test_tokens_are_those_of_the_tokenizer(spark, data):
    encode = M._encoder(M.TOKENIZER).encode_ordinary
    docs = table(spark, data, "documents").select("text").limit(20)
    got = docs.select("text", M.count_tokens(docs.text).alias("n")).collect()
    assert all(r.n == len(encode(r.text)) for r in got)
    assert all(M._encoder(M.TOKENIZER).decode(encode(r.text)) == r.text for r in got)


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [(i, "big", "one two three four") for i in range(600)] + [(1000 + i, "small", "one two three four") for i in range(100)] + [(5000, "none", "x"), (5001, None, "x"), (5002, "big", None)]
    targets = [("big", 0.5, 1), ("small", 0.25, 3), ("absent", 0.25, 9), ("zero", 0.0, 2)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)


def test_shares_fit_within_caps(corpus):
    rows = {r.source: r for r in M.shares(*corpus).collect()}
    assert set(rows) == {"big", "small", "absent", "zero"}
    # the small source is given out as often as it may; the other so that it has twice as much
    assert rows["small"].rate == 3.0 and abs(rows["big"].rate - 1.0) < 1e-9
    assert abs(rows["big"].reached_share - 2 / 3) < 1e-9 and rows["absent"].mixed_tokens == rows["zero"].mixed_tokens == 0


def test_copies(corpus):
    rows = M.mix(*corpus).collect()
    by = {}
    for r in rows:
        by.setdefault((r.source, r.doc_id), []).append(r.copy_no)
    assert {s for s, _ in by} == {"big", "small"}
    assert all(sorted(c) == [1, 2, 3] for (s, _), c in by.items() if s == "small") and all(c == [1] for (s, _), c in by.items() if s == "big")


def test_fractions_are_drawn_alike_and_near_the_rate(corpus):
    docs, targets = corpus
    once = {(r.doc_id, r.copy_no) for r in M.mix(docs, targets, total_tokens=1600).collect()}
    assert once == {(r.doc_id, r.copy_no) for r in M.mix(docs.repartition(7), targets, total_tokens=1600).collect()}
    assert once != {(r.doc_id, r.copy_no) for r in M.mix(docs, targets, seed=8, total_tokens=1600).collect()}
    rows = {r.source: r for r in M.shares(docs, targets, total_tokens=1600).collect()}
    tokens = {s: sum(4 for d, _ in once if (d >= 1000) == (s == "small")) for s in ("big", "small")}
    assert {s: rows[s].mixed_tokens for s in tokens} == tokens
    assert abs(rows["big"].mixed_tokens - rows["big"].rate * 2400) < 250


def test_caps_leave_a_share_short(corpus):
    rows = {r.source: r for r in M.shares(*corpus, total_tokens=1e6).collect()}
    assert rows["big"].rate == 1 and rows["small"].rate == 3


def test_empty(spark, corpus):
    docs, targets = corpus
    assert M.mix(docs.limit(0), targets).collect() == [] and M.mix(docs, targets.limit(0)).collect() == []
    assert all(r.reached_share == 0 for r in M.shares(docs.limit(0), targets).collect())
