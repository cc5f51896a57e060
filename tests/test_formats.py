"""Readers on generated bytes, discovery, DSL and HTML functions."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from lexloom.functions import dsl, markup
from lexloom.sources import formats, paths, reader


def idx(*entries, bits=32):
    form = ">QI" if bits == 64 else ">II"
    return b"".join(w.encode() + b"\0" + struct.pack(form, o, n) for w, o, n in entries)


def syn(*entries):
    return b"".join(w.encode() + b"\0" + struct.pack(">I", i) for w, i in entries)


INFO = b"StarDict's dict ifo file\nbookname = Colors \nsametypesequence=h\n"


def texts(parsed, word):
    return [parsed.texts.get((o, n)) for w, o, n, *_ in parsed.filings if w == word]


@pytest.mark.parametrize("bits", [32, 64])
@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_stardict(bits, pack):
    info = INFO + f"idxoffsetbits={bits}\n".encode()
    p = formats.stardict("x", info, pack(idx(("##name", 0, 4), ("color", 4, 12), bits=bits)), pack(b"META<b>color</b>"), syn(("colour", 1), ("nonesuch", 99)))
    assert p.name == "Colors" and p.headwords() == [("color", False), ("colour", True)]
    assert texts(p, "colour") == ["<b>color</b>"] and texts(p, "##name") == ["META"] and texts(p, "nonesuch") == []


def test_stardict_aliases_and_damage():
    p = formats.stardict("x", INFO, idx(("rego", 0, 1)), b"r", syn(("rexit", 0), ("rexerint", 0), ("rego", 0)))
    assert p.headwords() == [("rego", False), ("rexit", True), ("rexerint", True)]
    cut = idx(("a", 0, 1), ("b", 1, 1))
    assert [w for w, _ in formats.stardict("x", INFO, cut[:-2], b"xy").headwords()] == ["a"]
    with pytest.raises(formats.ParseError):
        formats.stardict("x", b"idxoffsetbits=16", cut, b"")
    with pytest.raises(formats.ParseError):
        formats.unpacked(gzip.compress(b"x" * 1000)[:-9])
    with pytest.raises(formats.ParseError):
        formats.unpacked(gzip.compress(b"x" * 1000), cap=100)
    assert formats.unpacked(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab"


def test_blocks():
    assert formats.block_text(b"one\0two", "mt") == "one\ntwo"
    assert formats.block_text(struct.pack(">I", 3) + b"RIFtext", "Wm") == "text"
    assert formats.block_text(b"mone\0" + b"W" + struct.pack(">I", 2) + b"xx" + b"ttwo\0", None) == "one\ntwo"
    assert formats.block_text(b"mone", None) == "one"


def test_b64():
    assert [formats.b64(x) for x in ("A", "R", "Z", "BA", "")] == [0, 17, 25, 64, 0]
    for bad in ("?", "A\tB", "A" + "/" * 11):
        with pytest.raises(formats.ParseError):
            formats.b64(bad if bad != "A" + "/" * 11 else "/" * 12)


def test_dictd():
    data = b"Short titlebytebyte two"
    lines = "00-database-short\tA\tL\nbyte\tL\tE\nbyte\tP\tI\nbad\t?\tE\nfour\tA\tB\tC\nshort\tA\n00-database-url\tA\tB\nfar\tA\t//\n"
    p = formats.dictd("stem", lines.encode(), data)
    assert p.name == "Short title" and [w for w, _ in p.headwords(distinct=False)] == ["byte", "byte", "far"]
    assert texts(p, "byte") == ["byte", "byte two"] and texts(p, "far") == [None]


def test_table():
    p = formats.table("t", "a\t1\t cf \tk\tone\t1\nshort\tline\nb\t2\tcf\tk\ttwo\t2\r\nc\t3\t\tk\tx\t3\nd\t4\tqv\tk\t\t4\n".encode())
    assert p.headwords() == [("cf", False), ("qv", False)] and texts(p, "cf") == ["one"] and texts(p, "qv") == [""]


@pytest.mark.parametrize("encode", [lambda t: b"\xff\xfe" + t.encode("utf-16-le"), lambda t: b"\xfe\xff" + t.encode("utf-16-be"), lambda t: b"\xef\xbb\xbf" + t.encode(), lambda t: t.encode(), lambda t: t.encode("utf-16-le")])
def test_dsl_encodings(encode):
    text = '#NAME "Sample"\nword(s)\nother\n\tbody\n\n\tmore\nlost\n'
    p = formats.dsl_file("x", encode(text))
    assert p.name == "Sample" and p.headwords() == [("word", False), ("words", False), ("other", False)]
    assert texts(p, "other") == ["\tbody\n\n\tmore"]


def test_dsl_decoding_of_broken_text():
    assert formats.decoded(b"\xff\xfe\x00\xd8") == "�" and formats.decoded(b"\xff\xfea\0b") == "a"
    with pytest.raises(formats.ParseError):
        formats.dsl_file("x", b"just a line")


def test_random_bytes_never_crash():
    rng = random.Random(4)
    for _ in range(150):
        data = bytes(rng.choice(b"\0\t\n ab{}([])\\#~<>/m\xff\xc3") for _ in range(rng.randrange(80)))
        for parse in (lambda: formats.stardict("x", INFO, data, data, data), lambda: formats.dictd("x", data, data), lambda: formats.table("x", data), lambda: formats.dsl_file("x", data), lambda: formats.block_text(data, None)):
            try:
                parse()
            except formats.ParseError:
                pass
        dsl.body_to_html(data.decode("utf-8", "replace"), "w")


@pytest.mark.parametrize(
    "line, shown",
    [
        ("(I) אָדָם", "אָדָם"), (r"((\*)II) אבד", "אבד"), (r"(\*)אֵב", "אֵב"), ("ad lib(itum)", "ad libitum"), ("colo(u)r", "colour"),
        (r"(\*)V בַּד", "בַּד"), ("III λόγος", "λόγος"), ("V", "V"), ("V littera", "V littera"), ("I bin", "I bin"), ("a {x}b", "a b"),
    ],
)
def test_display_form(line, shown):
    assert dsl.display_form(line) == shown


def test_variants():
    form = lambda s: [v for v, _ in dsl.variants(s)]
    assert form("a(b)c(d)") == ["ac", "abc", "acd", "abcd"]
    assert form(r"{\[}σαν{\]}") == ["σαν"]
    assert form("a(b)(c)(d)(e)") == ["abcde"]
    assert dsl.filed(["(I) אָדָם"]) == [("אָדָם", True), ("I אָדָם", False)]
    assert dsl.filed(["(only)"]) == [("only", True)]


@pytest.mark.parametrize(
    "body, html",
    [
        ("\t[m1]one[/m]\n\t[m2][b]~[/b] two", "<blockquote>one</blockquote><blockquote><blockquote><b>hw</b> two</blockquote></blockquote>"),
        ("\tsee [ref]a\\[b[/ref] and <<c>>", '<div>see <a href="bword://a[b">a[b</a> and <a href="bword://c">c</a></div>'),
        ("\t[s]sound.wav[/s]x{{note}}y", "<div>xy</div>"),
        ("\t[b]one[c blue]two[/b]three[/c]", "<div><b>onetwo</b>three</div>"),
        ("\t[i]one[b]two[/i]three[/b]", "<div><i>one<b>two</b></i>three</div>"),
        ("\t[/m]\n\tx < y & \"z\"", "<div>x &lt; y &amp; &quot;z&quot;</div>"),
        ("\topen [bracket", "<div>open [bracket</div>"),
        ("\t[m12]deep", "<blockquote>" * 9 + "deep" + "</blockquote>" * 9),
        ("\t[EX]e[/EX] [p]n.[/p] [t]ˈa[/t]", "<div><cite>e</cite> <i>n.</i> <tt>ˈa</tt></div>"),
    ],
)
def test_dsl_bodies(body, html):
    assert dsl.body_to_html(body, "hw") == html


@pytest.mark.parametrize(
    "html, text",
    [
        ("<b>alpha</b>   plain   <i>beta</i>", "alpha plain beta"), ("<style>a{color:red}</style><b>hi</b><script>x=1</script> there", "hi there"),
        ("<b> ¶ 1</b> one <b>¶ 2</b> two", "¶ 1 one\n¶ 2 two"), ("one || two", "one\ntwo"), ("one | two", "one | two"), ("<p>one</p><p>two</p>", "one\ntwo"),
        ("a<br>b", "a\nb"), ("&#945;&#946; &amp; Ελληνικά", "αβ & Ελληνικά"), ("<b>" * 40_000 + "w", ""), ("", ""), ("<ul><li>a<li>b</ul>c", "a\nb\nc"), ("a</p>b", "a\nb"),
    ],
)
def test_html_text(html, text):
    assert markup.to_text(html) == text


def test_html_runs():
    runs = markup.to_runs('<a href="x">one</a><a href="y">two</a> <sup>n</sup><b>c<i>d</i></b>')
    assert [(r["text"], r["href"]) for r in runs] == [("one", "x"), ("two", "y"), (" ", None), ("n", None), ("c", None), ("d", None)]
    assert runs[3]["style"]["sup"] and runs[3]["style"]["scale"] < 1 and runs[5]["style"]["bold"] and runs[5]["style"]["italic"]
    nested = markup.to_runs('<a href="x">a <b>b</b></a>')
    assert [r["href"] for r in nested if r["text"].strip()] == ["x", "x"]
    assert [r["style"]["bold"] for r in markup.to_runs("<p><b>a<p>b") if r["text"].strip()] == [True, True]


def test_link_targets(spark):
    hrefs = ["bword://x", "bword:x", "x", "bword://a b: c", "http://x", "https://x", "mailto:a", "#a", "", None]
    df = spark.createDataFrame([(h,) for h in hrefs], "h string")
    assert [r[0] for r in df.select(markup.link_target(F.col("h"))).collect()] == ["x", "x", "x", "a b: c", None, None, None, None, None, None]


def test_column_forms(spark):
    df = spark.createDataFrame([("<b>a</b>",), (None,)], "h string")
    rows = df.select(markup.html_text(F.col("h")).alias("t"), markup.html_runs(F.col("h")).alias("r")).collect()
    assert rows[0].t == "a" and rows[0].r[0].style.bold and rows[1].t is None
    values = spark.createDataFrame([(x,) for x in ("BA", "", "R?", "/" * 12, None)], "b string")
    assert [r[0] for r in values.select(paths.b64_value(F.col("b"))).collect()] == [64, 0, None, None, None]


def test_discovery(spark, tmp_path):
    for p in ("a/x.dsl", "a/x.dsl.dz", "a/y.dsl.dz", "b/z.IFO", "b/z.idx", "or_2/g.ifo", "or_20/h.ifo", "k/k.dsl.dz", "k/k.dsl/part", "old/o.bgl"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"")
    (tmp_path / "b/link.csv").symlink_to(tmp_path / "a/x.dsl")
    config = f'dictionary_dirs = ["{tmp_path}", "!{tmp_path}/or_2"]\n[dictionary."{tmp_path}/b/z.IFO"]\nname = "Zed"\norder = 4\nscope = false\n'
    got = {r.path.removeprefix(f"{tmp_path}/"): r for r in paths.scan(spark, config).collect()}
    assert sorted(got) == ["a/x.dsl", "a/y.dsl.dz", "b/z.IFO", "or_20/h.ifo"]
    z = got["b/z.IFO"]
    assert (z.label, z.derived, z.cfg_order, z.scope, z.format) == ("Zed", "b", 4, False, "StarDict") and got["a/x.dsl"].scope
    assert [r.path.rsplit("/", 1)[1] for r in sorted(got.values(), key=lambda r: r.dict)] == ["x.dsl", "y.dsl.dz", "z.IFO", "h.ifo"]


def test_reader(spark, tmp_path):
    d = tmp_path / "books"
    (d / "s").mkdir(parents=True)
    (d / "s/c.ifo").write_bytes(INFO)
    (d / "s/c.idx").write_bytes(idx(("color", 0, 12), ("empty", 12, 0)))
    (d / "s/c.dict.dz").write_bytes(gzip.compress(b"<b>color</b>"))
    (d / "s/c.syn").write_bytes(syn(("colour", 0)))
    (d / "w.index").write_text("byte\tA\tE\nbyte\tE\tE\n")
    (d / "w.dict").write_bytes(b"bytetwo.")
    (d / "t.csv").write_text("x\t1\tcf\tk\t\t1\n")
    (d / "l.dsl").write_text('#NAME "L"\ncolor(s)\n\t[b]~[/b] x\n')
    (d / "bad.dsl").write_text("nothing")
    (d / "alone.ifo").write_bytes(INFO)
    got = reader.read(spark, str(d))
    assert sorted(r.name for r in got.names.collect()) == ["Colors", "L", "t", "w"]
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.rejects.collect()) == ["alone.ifo", "bad.dsl"]
    heads = [(r.path.rsplit("/", 1)[1], r.word, r.is_alias) for r in got.headwords.orderBy("path", "idx").collect()]
    assert heads == [("l.dsl", "color", False), ("l.dsl", "colors", False), ("c.ifo", "color", False), ("c.ifo", "empty", False), ("c.ifo", "colour", True), ("t.csv", "cf", False), ("w.index", "byte", False), ("w.index", "byte", False)]
    ids = {r.word: r.entry_id for r in got.headwords.collect() if r.path.endswith("c.ifo")}
    assert ids["color"] == ids["colour"] == 12 << 40 and ids["color"] != ids["empty"]
    words = spark.createDataFrame([("color",), ("colour",), ("byte",), ("cf",), ("empty",), ("none",)], "word string")
    html = sorted((r.path.rsplit("/", 1)[1], r.word, r.html) for r in reader.lookup(got, words).collect())
    assert html == [("c.ifo", "color", "<b>color</b>"), ("c.ifo", "colour", "<b>color</b>"), ("l.dsl", "color", "<div><b>color</b> x</div>"), ("t.csv", "cf", ""), ("w.index", "byte", "byte"), ("w.index", "byte", "two.")]
    assert {(r.name, r.headwords) for r in reader.preview(got).collect()} == {("Colors", 3), ("L", 2), ("t", 1), ("w", 2)}


def test_arrivals_extend_the_index(spark, tmp_path):
    from lexloom.operators import index
    from lexloom.streaming import ingest

    rows = spark.createDataFrame([(0, i, i, f"w{i}", False, None) for i in range(20)], "dict int, idx bigint, slot bigint, word string, is_alias boolean, entry_id bigint")
    index.write(rows.filter("slot < 5"), str(tmp_path / "ix"))
    rows.filter("slot >= 5").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # what was taken once isn't taken again
        ingest.append_to_index(ingest.read_arrivals(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination(60)
    assert index.open_index(spark, str(tmp_path / "ix")).count() == 20


def test_settings_round_trip(spark):
    from lexloom.sources import settings

    start = spark.createDataFrame([("/a.ifo", "A \"q\"", None, 2, None, "GRC"), ("/b.csv", None, "b", None, False, None)], paths.SETTINGS)
    ordered = settings.remember_order(start, spark.createDataFrame([("/b.csv", 0), ("/c.dsl", 1)], "path string, rank int"))
    scoped = settings.remember_scope(ordered, spark.createDataFrame([("/b.csv", True), ("/c.dsl", False)], "path string, scope boolean"))
    text = settings.to_toml(["/books"], ["/books/x"], scoped)
    roots, excludes, back = paths.read_config(spark, text)
    assert roots == ["/books"] and [r.path for r in excludes.collect()] == ["/books/x"]
    got = {r.path: (r.name, r.short, r.cfg_order, r.scope, r.language) for r in back.collect()}
    assert got == {"/a.ifo": ("A \"q\"", None, None, None, "GRC"), "/b.csv": (None, "b", 0, None, None), "/c.dsl": (None, None, 1, False, None)}


def test_late_repeats_are_dropped(spark, tmp_path):
    import datetime as dt

    from lexloom.streaming import ingest

    day = lambda n: dt.datetime(2025, 1, n)
    rows = spark.createDataFrame([(1, day(1)), (2, day(2)), (1, day(3)), (2, day(2))], "slot bigint, loaded_at timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.first_arrivals(ingest.read_arrivals(spark, str(tmp_path / "in"), rows.schema))
    stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r.slot for r in spark.table("arrived").collect()) == [1, 2]


def test_configurations_are_edited_in_place(spark, tmp_path):
    from lexloom.sources import settings

    text = '# mine\ndictionary_dirs = [\n    "/books", # all\n    "/more"  # and these\n]\n\n[dictionary."/a.ifo"] # first\nname = "A"  # short\norder = 2\n\n[other]\nx = 1\n'
    out = settings.with_exclude(text, "/books/x")
    assert paths.read_config(spark, out)[0] == ["/books", "/more"] and [r.path for r in paths.read_config(spark, out)[1].collect()] == ["/books/x"]
    assert all(c in out for c in ("# mine", "# all", "# and these", "# first")) and settings.with_exclude(out, "/books/x") == out
    for before in ("dictionary_dirs = []\n", "dictionary_dirs = ['/a']\n", 'dictionary_dirs = ["/a",]\n', "x = 1\n"):
        assert [r.path for r in paths.read_config(spark, settings.with_exclude(before, "/b \"q\""))[1].collect()] == ['/b "q"']
    new = spark.createDataFrame([("/a.ifo", "B", None, None, False, None), ("/c.dsl", None, "c", 1, None, None), ("/d.dsl", None, None, None, None, None)], paths.SETTINGS)
    out = settings.with_settings(text, new)
    got = {r.path: (r.name, r.short, r.cfg_order, r.scope) for r in paths.read_config(spark, out)[2].collect()}
    assert got == {"/a.ifo": ("B", None, None, False), "/c.dsl": (None, "c", 1, None)}
    assert '[other]\nx = 1' in out and 'name = "B"  # short' in out and "# first" in out and settings.with_settings(out, new) == out
    made = settings.load_or_create(str(tmp_path / "new/config.toml"), str(tmp_path / "books"))
    assert paths.read_config(spark, made)[0] == [str(tmp_path / "books")] and settings.load_or_create(str(tmp_path / "new/config.toml"), "/else") == made


def test_data_files_are_read_by_several_tasks(spark, tmp_path):
    d = tmp_path / "books"
    d.mkdir()
    words = [f"w{i:04}" for i in range(500)]
    body = lambda w: f"<p>{w}</p>" * 20
    at, index, data = 0, [], b""
    for w in words:
        b = body(w).encode()
        index.append((w, at, len(b)))
        data, at = data + b, at + len(b)
    (d / "s.ifo").write_bytes(INFO)
    (d / "s.idx").write_bytes(idx(*index))
    (d / "s.dict").write_bytes(data[:-5])  # the last entry is cut
    (d / "s.syn").write_bytes(syn(("alias", 3), ("none", 9999)))
    got = reader.read(spark, str(d), split=5000)
    texts = {(r.offset, r.size): r.text for r in got.entries.collect()}
    assert texts == {(o, n): body(w) for w, o, n in index[:-1]}
    assert got.rejects.collect() == [] and {r.word for r in got.filings.filter("is_alias").collect()} == {"alias"}
    assert [(r.word, r.idx) for r in got.headwords.orderBy("idx").collect()] == [*((w, i) for i, w in enumerate(words)), ("alias", 500)]
    assert [r.text for r in reader.lookup(got, spark.createDataFrame([("alias",)], "word string"), text=True).collect()] == ["\n".join(["w0003"] * 20)]


def test_tables_and_cards_keep_their_order_when_split(spark, tmp_path):
    d = tmp_path / "books"
    d.mkdir()
    lines = [f"x\t{i}\tword{i % 300}\tk\ttext {i}\t1" for i in range(3000)]
    (d / "t.csv").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = reader.read(spark, str(d))
        assert {r.text for r in got.entries.collect()} == {f"text {i}" for i in range(300)}
        assert [r.word for r in got.headwords.orderBy("idx").collect()] == [f"word{i}" for i in range(300)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_batch_that_is_run_again_is_there_once(spark, tmp_path):
    import shutil

    from lexloom.operators import index
    from lexloom.streaming import ingest

    rows = spark.createDataFrame([(0, i, i, f"w{i}", False, None) for i in range(20)], "dict int, idx bigint, slot bigint, word string, is_alias boolean, entry_id bigint")
    path, cp = str(tmp_path / "ix"), str(tmp_path / "cp")
    index.write(rows.filter("slot < 5"), path)
    rows.filter("slot >= 5").write.parquet(str(tmp_path / "in"))
    run = lambda: ingest.append_to_index(ingest.read_arrivals(spark, str(tmp_path / "in"), rows.schema), path, cp).awaitTermination(60)
    run()
    # as after a failure between the writing of a batch and its commit
    for f in (tmp_path / "cp/commits").iterdir():
        f.unlink() if f.is_file() else shutil.rmtree(f)
    run()
    assert sorted(r.slot for r in index.open_index(spark, path).collect()) == list(range(20))


def test_state_of_an_index(spark, tmp_path):
    from lexloom.operators import index

    kind = "dict int, idx bigint, slot bigint, word string, is_alias boolean, entry_id bigint"
    rows = [(0, i, i, f"w{i}", False, 1) for i in range(6)]
    path = str(tmp_path / "ix")
    heads = spark.createDataFrame(rows, kind)
    index.write(heads, path)
    assert index.is_current(spark, heads, path)
    for column, value in (("is_alias", "true"), ("entry_id", "2"), ("slot", "slot + 1"), ("idx", "idx + 1"), ("word", "upper(word)")):
        assert not index.is_current(spark, heads.selectExpr(*[f"cast({value} as {t}) as {c}" if c == column else c for c, t in heads.dtypes]), path)
    # from files, what the file system tells is enough, and no job is run
    heads.write.parquet(str(tmp_path / "heads"))
    stored = spark.read.parquet(str(tmp_path / "heads"))
    index.write(stored, path)
    assert index._files(stored) and index.is_current(spark, stored, path) and not index.is_current(spark, stored.limit(3), path)
    for _ in range(3):
        last = index.write(stored, path)
    assert len(index.versions(spark, path)) == 1 + index.KEPT and index.version_of(spark, path) == last
    # half a version is none
    (tmp_path / "ix/headwords-99999999999999999999-x/rows").mkdir(parents=True)
    assert index.version_of(spark, path) == last and index.open_index(spark, path).count() == 6
    assert index.figures(spark, stored, path).first().headwords == 6


def test_deeply_nested_markup_is_read_in_time():
    import time

    began = time.perf_counter()
    assert markup.to_text("<b>" * 200 + "<p>x</p>" * 2 + "</b>" * 200) == "x\nx"
    markup.to_runs("<b>" * 20_000 + "<p>x</p>" * 2_000)
    markup.to_runs("<p>" * 5_000 + "</i>" * 20_000)
    assert time.perf_counter() - began < 10
