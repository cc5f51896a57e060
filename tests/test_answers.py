"""The collection as one object, from files and from tables."""

import json

import pytest

from lexloom.plans.answers import Collection
from lexloom.session import table
from lexloom.sources import manifest, paths


@pytest.fixture(scope="module")
def books(tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    (d / "sample").mkdir()
    bodies = {"aardvark": "an animal", "byte": "eight bits", "rust": "a metal", "zeitgeist": "the times", "byte again": "x"}
    data, lines = b"", ["00-database-short\tA\tA"]
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for w, t in [*bodies.items(), ("byte", "eight bits more")]:
        lines.append(f"{w}\t{b64[len(data) // 64]}{b64[len(data) % 64]}\t{b64[len(t)]}")
        data += t.encode()
    (d / "sample/sample.index").write_text("\n".join(lines) + "\n")
    (d / "sample/sample.dict").write_bytes(data)
    (d / "links").mkdir()
    words = {"cf": "see <a href='bword://byte'>byte</a>", "byte": "a <b>unit</b>", "λόγος": "word"}
    (d / "links/links.csv").write_text("".join(f"<i>{w}</i>\t{i}\t{w}\tk\t{t}\t1\n" for i, (w, t) in enumerate(words.items())))
    return d


def answer(df):
    return json.loads(df.first().answer)


def test_files_to_answers(spark, books, tmp_path):
    config = f'dictionary_dirs = ["{books}"]\n[dictionary."{books}/sample/sample.index"]\norder = 1\n'
    c = Collection.of_files(spark, config, str(tmp_path / "index"))
    assert c.library_size() == "9 words · 2 dictionaries"
    got = answer(c.search_json("byte"))
    assert not got["truncated"] and [r["word"] for r in got["rows"]] == ["byte", "byte again"]
    assert got["rows"][0] == {"word": "byte", "dictionaries": 2, "members": [{"dictionary": "links", "spelling": "byte"}, {"dictionary": "sample", "spelling": "byte"}]}
    assert [r["word"] for r in answer(c.search_json("λογοσ"))["rows"]] == ["λόγος"]
    assert answer(c.search_json("λὸγος"))["rows"] == [] == answer(c.search_json("zzzz"))["rows"]
    assert answer(c.search_json("byte", 0)) == {"query": "byte", "rows": [], "truncated": True}
    assert answer(c.define_json("byte")) == {"word": "byte", "definitions": [{"dictionary": "sample", "entries": ["eight bits", "eight bits more"]}, {"dictionary": "links", "entries": ["a unit"]}]}
    assert answer(c.define_json("notaword")) == {"word": "notaword", "definitions": []}
    assert {r.label for r in c.follow("bword://byte").collect()} == {"sample", "links"} and c.follow("http://x").collect() == []
    assert [(d["label"], d["headwords"]) for d in answer(c.scope_json())["dictionaries"]] == [("sample", 6), ("links", 3)]
    # the second time nothing is rebuilt
    again = Collection.of_files(spark, config, str(tmp_path / "index"))
    assert [r.word for r in again.search("zeit").collect()] == ["zeitgeist"]
    assert len(list((tmp_path / "index").glob("headwords-*"))) == 1


def test_tables(spark, data):
    c = Collection.of_tables(*(table(spark, data, t) for t in ("dictionaries", "headwords", "definitions")))
    word = c.at.orderBy("slot").first().word
    assert c.define(word).count() >= 0 and c.shelf().count() == 34
    assert len(answer(c.search_json("a", 5))["rows"]) <= 5


def test_fingerprints(spark, books):
    dicts = paths.scan(spark, f'dictionary_dirs = ["{books}"]').select("path")
    rows = manifest.fingerprints(spark, dicts, str(books))
    then = spark.createDataFrame(rows.collect(), rows.schema)  # as it would be read from a table kept
    assert then.filter("size is null").count() == 1 and then.count() == 4  # sample.dict.dz is missing
    assert manifest.changed(then, manifest.fingerprints(spark, dicts, str(books))).collect() == []
    (books / "links/links.csv").write_text("x\t1\tnew\tk\tt\t1\n")
    now = manifest.fingerprints(spark, dicts, str(books))
    assert [r.path.rsplit("/", 1)[1] for r in manifest.changed(then, now).collect()] == ["links.csv"]
