"""Passages of test items in documents, against a comparison of all runs of words."""

import random

from lexloom.llm import leakage as K

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def brute(docs, items, n=12):
    runs = lambda t: {tuple(w[i : i + n]) for w in [K.words_of(t or "")] for i in range(len(w) - n + 1)}
    of = [(i, runs(t)) for i, t in items]
    return {(d, i) for d, t in docs for mine in [runs(t)] for i, theirs in of if mine & theirs}


def check(spark, docs, items, **how):
    got = K.leaked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **how).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items) and len(got) == len(brute(docs, items))
    return got


def test_random(spark):
    rng = random.Random(5)
    text = lambda n, k: " ".join(f"W{rng.randrange(k)}" for _ in range(n))
    items = [(i, text(rng.randrange(5, 40), 6)) for i in range(15)] + [(90, None), (91, ""), (92, "a" * 50)]
    docs = []
    for d in range(80):
        t = text(rng.randrange(0, 60), 6)
        if d % 3 == 0:
            w = items[d % 15][1].split()
            t = f"{t} {', '.join(w[: rng.randrange(8, 20)]).lower()}; {t}"
        docs.append((d, t))
    docs += [(100, None), (101, "")]
    check(spark, docs, items)
    check(spark, docs, items, block_chars=200)


def test_punctuation_case_and_length(spark):
    passage = "One two, three -- four? FIVE six seven (eight) nine ten eleven twelve thirteen"
    docs = [(1, "x " + passage.upper().replace(" ", "\n")), (2, " ".join(passage.split()[:12]))]
    got = check(spark, docs, [(7, passage)])
    assert {r.doc_id: r.longest_run for r in got} == {1: 13}


def test_longest_run_and_repeats(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, item), (1, item), (2, " ".join(item.split()[3:18]) + " x " + item)]
    got = check(spark, docs, [(7, item)])
    assert {(r.doc_id, r.longest_run) for r in got} == {(1, 30), (2, 30)}


def test_empty_and_long(spark):
    check(spark, [], [(1, "a")])
    check(spark, [(1, "a b")], [])
    item = " ".join(f"w{i}" for i in range(12))
    check(spark, [(1, "z " * 200_000 + item)], [(1, item)])


def test_documents_are_read_once_whatever_the_number_of_items(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    items = [(i, text(40)) for i in range(60)]
    docs = [(d, text(30) + " " + " ".join(items[d % 60][1].split()[5 : 5 + rng.randrange(8, 30)]) + " " + text(20)) for d in range(50)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return t

    counted = counted.asNondeterministic()
    size = sum(len(t) for _, t in items)
    df = spark.createDataFrame(docs, DOCS).withColumn("text", counted("text"))
    got = K.leaked(df, spark.createDataFrame(items, ITEMS), block_chars=size // 10).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items) and seen.value == len(docs)
    small = K.leaked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, small))


def test_tables_miss_nothing_with_colliding_hashes():
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    items = [(i, text(30)) for i in range(20)]
    doc = text(50) + " " + items[3][1] + " " + text(40)
    want = None
    for bits in (1, 4, 8, 16):
        got = K.WordSearch(K.Tables.of([t for _, t in items], 12, bits), items).find(K.words_of(doc))
        want = want or got
        assert got == want and got[3] >= 30
