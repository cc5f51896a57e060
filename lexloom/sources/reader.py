"""Dictionary files as tables, read piece by piece and, where the format allows it, by several tasks.

A dictionary that can't be parsed gives one row in `rejects`, the others their filings and entries. A data file that is
cut or broken gives the entries that are whole.
"""

from __future__ import annotations

import codecs
import gzip
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import dsl
from lexloom.functions.markup import html_text
from lexloom.session import bounded, cut_lineage
from lexloom.sources import formats
from lexloom.sources.paths import classify

#: Endings of files that belong to one dictionary, longest first.
_ENDINGS = ("\\.dict\\.dz", "\\.idx\\.gz", "\\.idx\\.dz", "\\.syn\\.dz", "\\.dsl\\.dz", "\\.ifo", "\\.idx", "\\.syn", "\\.dict", "\\.index", "\\.dsl", "\\.csv")
_ROWS = "path string, format string, kind string, no bigint, word string, offset bigint, size bigint, listed boolean, target bigint, text string"


@dataclass(frozen=True)
class Dictionaries:
    """filings: path, filing_no, word, offset, size, listed, is_alias, entry_id; headwords: path, idx, word, is_alias,
    entry_id; entries: path, offset, size, text; rejects: path, format, reason; names: path, format, name."""

    names: DataFrame
    filings: DataFrame
    headwords: DataFrame
    entries: DataFrame
    rejects: DataFrame


def _uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path)


def _open(path: str):
    """A file to be read from any place, unpacked on the way if it is packed."""
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(_uri(path))
    raw = fs.open_input_file(at)
    packed = raw.read(2) == b"\x1f\x8b"
    raw.seek(0)
    return gzip.GzipFile(fileobj=raw) if packed else raw


def _lines(stream) -> Iterator[str]:
    """Lines of a text file in the encoding it shows, without line feeds; a last line without one counts if it has anything."""
    head = stream.read(1024)
    encoding, mark = formats.encoding_of(head)
    decode = codecs.getincrementaldecoder(encoding)("replace").decode
    held, piece = "", head[mark:]
    while piece:
        *whole, held = (held + decode(piece)).split("\n")
        yield from whole
        piece = stream.read(1 << 20)
    # half a sign at the end of UTF-16 is left out
    held += "" if "16" in encoding else decode(b"", True)
    if held:
        yield held


def _first(parts: dict[str, str], *endings: str) -> str | None:
    return next((parts[e] for e in endings if e in parts), None)


def _scanned(kind: str, stem: str, parts: dict[str, str]) -> Iterator[tuple]:
    """(kind, no, word, offset, size, listed, target, text) of one dictionary, as its files are read from begin to end.

    Of StarDict and dictd only the index files are read, the data where a name stands in it.
    """
    row = lambda what, no=0, word=None, offset=None, size=None, listed=None, target=None, text=None: (what, no, word, offset, size, listed, target, text)
    if kind == "StarDict":
        idx, data = _first(parts, ".idx", ".idx.gz", ".idx.dz"), _first(parts, ".dict", ".dict.dz")
        if idx is None or data is None:
            raise formats.ParseError("index or data file is missing")
        info = formats.parse_info(_open(parts[".ifo"]).read().decode("utf-8", "replace"))
        form = formats.offset_form(info)
        yield row("name", word=info.get("bookname") or stem)
        yield row("data", word=data, text=info.get("sametypesequence") or None)
        n = 0
        for n, (word, b) in enumerate(formats.records(_open(idx), struct.calcsize(form)), 1):
            offset, size = struct.unpack(form, b)
            yield row("filing", n - 1, word, offset, size, not word.startswith("##"))
        if (syn := _first(parts, ".syn", ".syn.dz")) is not None:
            for i, (word, b) in enumerate(formats.records(_open(syn), 4)):
                yield row("synonym", n + i, word, listed=not word.startswith("##"), target=struct.unpack(">I", b)[0])
    elif kind == "Dictd":
        data = _first(parts, ".dict", ".dict.dz")
        if data is None:
            raise formats.ParseError("data file is missing")
        name, n = stem, 0
        yield row("data", word=data, text="m")
        for word, offset, size in filter(None, map(formats.index_line, _lines(_open(parts[".index"])))):
            if word.startswith("00-database-short"):
                at = _open(data)
                at.seek(offset)
                block = at.read(size)
                name = block.decode("utf-8", "replace").strip() if len(block) == size else name
            elif not word.startswith("00-database-"):
                yield row("filing", n, word, offset, size, True)
                n += 1
        yield row("name", word=name)
    else:
        path = _first(parts, ".dsl", ".dsl.dz")
        name = formats.dsl_name(_lines(_open(path)))
        n = 0
        for heads, offset, body in formats.cards(_lines(_open(path))):
            size = len(body.encode("utf-8", "replace"))
            yield row("entry", offset=offset, size=size, text=body)
            for key, shown in dsl.filed(heads):
                yield row("filing", n, key, offset, size, shown)
                n += 1
        if not n and name is None:
            raise formats.ParseError("neither header nor cards")
        yield row("name", word=name or stem)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _ROWS.split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype(object)
    for batch in batches:
        for book in batch.itertuples(index=False):
            own = (book.path, book.format)
            rows = []
            try:
                for r in _scanned(book.format, book.stem, dict(book.parts)):
                    rows.append((*own, *r))
                    if len(rows) == 10_000:
                        yield frame(rows)
                        rows = []
            except (formats.ParseError, UnicodeError, ValueError, EOFError, zlib.error, OSError) as e:
                rows = [(*own, "reject", 0, None, None, None, None, None, str(e) or type(e).__name__)]
            if rows:
                yield frame(rows)


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The texts of entries, in the order of their offsets; none for what the data doesn't hold in full."""
    at, stream = None, None
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if at != r.data:
                at, stream = r.data, _open(r.data)
            try:
                stream.seek(r.offset)
                block = stream.read(r.size)
            except (EOFError, zlib.error, OSError):
                continue
            if len(block) == r.size:
                text = block.decode("utf-8", "replace") if r.format == "Dictd" else formats.entry_text(block, r.types)
                out.append((r.path, r.format, r.offset, r.size, text))
        yield pd.DataFrame(out, columns=["path", "format", "offset", "size", "text"]).astype({"offset": "int64", "size": "int64"})


def _tabled(spark: SparkSession, uris: list[str]) -> DataFrame:
    """path, no, word, text: the first description of each word of tab-separated files, which are split among tasks.

    A line's number is where its part of the file begins plus its place in it: in the order of lines, not without gaps.
    """
    if not uris:
        return spark.createDataFrame([], "path string, no bigint, word string, text string")
    lines = spark.read.option("lineSep", "\n").text(uris).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"))
    f = F.split(F.regexp_replace("value", r"\r\z", ""), "\t")
    rows = lines.select(_plain("path"), (F.col("start") + F.col("i").bitwiseAND((1 << 33) - 1)).alias("no"), F.regexp_replace(F.get(f, F.lit(2)), STRIPPED, "").alias("word"), F.get(f, F.lit(4)).alias("text"))
    return rows.filter("word <> '' and text is not null").groupBy("path", "word").agg(F.min(F.struct("no", "text")).alias("first")).select("path", "first.no", "word", "first.text")


#: What Python and others take as white space at the ends of a word.
STRIPPED = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+\z"


def _plain(path: str) -> Column:
    return F.regexp_replace(F.col(path), "^file:/*", "/").alias("path")


def numbered(df: DataFrame, key: str, order: str, to: str) -> DataFrame:
    """df with a column that numbers the rows of each key from 0 in order, however many rows a key has.

    Rows are sorted over all partitions; how many rows of a key stand in partitions before is added to the place within.
    """
    placed = df.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    placed = cut_lineage(placed, "placed")
    firsts = placed.groupBy(key, "_p").agg(F.min("_i").alias("_f"), F.count("*").alias("_n"))
    # one row per key and partition that has it
    before = firsts.withColumn("_b", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(bounded(before.drop("_n")), [key, "_p"]).withColumn(to, F.col("_b") + F.col("_i") - F.col("_f")).drop("_p", "_i", "_f", "_b")


def read(spark: SparkSession, path: str | list[str], split: int = 64 << 20) -> Dictionaries:
    """All dictionaries in a folder (searched recursively), in several folders, or of single files with siblings.

    Files are listed first, without their content. Index files and cards are read piece by piece by one task each, in
    constant memory; synonyms find their words by a join. Data files are read where entries stand, by a task for each
    `split` bytes unless they are packed; tab-separated files are split as text. No size is too large.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("uri"))
    ending = F.regexp_extract("uri", f"(?i)({'|'.join(_ENDINGS)})$", 1)
    files = files.select("uri", ending.alias("ending"), classify(F.col("uri")).alias("format"), _plain("uri")).filter("ending <> ''")
    files = files.withColumn("stem", F.expr("left(path, length(path) - length(ending))"))
    parts = files.groupBy("stem").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.lower("ending").alias("k"), F.col("uri").alias("v"))))).alias("parts"))
    # one row per dictionary; of several primary files of a format the first in order
    first = files.filter("format is not null and format <> 'Bgl'").groupBy("stem", "format").agg(F.min(F.struct("path", "uri")).alias("p")).select("stem", "format", "p.path", "p.uri")
    books = cut_lineage(first.join(parts, "stem").select("path", "uri", "format", F.element_at(F.split("stem", "/"), -1).alias("stem"), "parts"), "books")
    scanned = books.filter("format <> 'Csv'").repartition("path")

    # written once, as all five tables come from it
    rows = cut_lineage(scanned.select("path", "format", "stem", "parts").mapInPandas(_scan, _ROWS), "scanned")
    kind = lambda k: rows.filter(F.col("kind") == k)
    rejects = kind("reject").select("path", "format", F.col("text").alias("reason"))
    sound = lambda df: df.join(rejects.select("path"), "path", "left_anti")
    tables = cut_lineage(_tabled(spark, [r.uri for r in books.filter("format = 'Csv'").select("uri").collect()]), "tables")

    own = kind("filing").select("path", "format", F.col("no").alias("filing_no"), "word", "offset", "size", "listed", F.lit(False).alias("is_alias"))
    targets = own.filter("format = 'StarDict'").select("path", F.col("filing_no").alias("target"), "offset", "size")
    synonyms = kind("synonym").select("path", "format", F.col("no").alias("filing_no"), "word", "listed", "target").join(targets, ["path", "target"])
    lined = tables.select("path", F.lit("Csv").alias("format"), F.col("no").alias("filing_no"), "word", F.col("no").alias("offset"), F.length("text").cast("bigint").alias("size"), F.lit(True).alias("listed"), F.lit(False).alias("is_alias"))
    filings = sound(own.unionByName(synonyms.drop("target").withColumn("is_alias", F.lit(True)))).unionByName(lined)
    entry_id = F.when(F.col("format") == "StarDict", F.col("offset").bitwiseXOR(F.shiftleft(F.col("size"), 40)))
    filings = cut_lineage(filings.withColumn("entry_id", entry_id), "filings")

    listed = F.when(F.col("listed"), F.struct("filing_no", "is_alias"))
    distinct = filings.filter("format <> 'Dictd'").groupBy("path", "word").agg(F.min(listed).alias("f"), F.min(F.struct("filing_no", "entry_id")).alias("e")).filter("f is not null")
    heads = distinct.select("path", "word", F.col("f.filing_no").alias("filing_no"), F.col("f.is_alias").alias("is_alias"), F.col("e.entry_id").alias("entry_id"))
    heads = heads.unionByName(filings.filter("format = 'Dictd'").select("path", "word", "filing_no", "is_alias", "entry_id"))

    data = kind("data").select("path", F.col("word").alias("data"), F.col("text").alias("types"), F.lower("word").endswith(".dz").alias("packed"))
    asked = filings.filter("format in ('StarDict', 'Dictd')").select("path", "format", "offset", "size").distinct().join(data, "path")
    # a packed file can be read from its beginning only, so one task reads it
    cut = asked.withColumn("piece", F.when(F.col("packed"), F.lit(0)).otherwise(F.floor(F.col("offset") / split)))
    sliced = cut.repartition("path", "piece").sortWithinPartitions("data", "offset", "size").select("path", "format", "data", "types", "offset", "size").mapInPandas(_slices, "path string, format string, offset bigint, size bigint, text string")
    written = sound(kind("entry").select("path", "format", "offset", "size", "text"))
    entries = sliced.unionByName(written).unionByName(tables.select("path", F.lit("Csv").alias("format"), F.col("no").alias("offset"), F.length("text").cast("bigint").alias("size"), "text"))
    names = sound(kind("name").select("path", "format", F.col("word").alias("name"))).unionByName(books.filter("format = 'Csv'").select("path", "format", F.col("stem").alias("name")))
    return Dictionaries(
        names=names,
        filings=filings,
        headwords=numbered(heads, "path", "filing_no", "idx").select("path", "idx", "word", "is_alias", "entry_id"),
        entries=cut_lineage(entries, "entries"),
        rejects=rejects,
    )


def lookup(dictionaries: Dictionaries, words: DataFrame, text: bool = False) -> DataFrame:
    """path, word, filing_no, html: what each dictionary has for words (word); empty definitions only of tables. With text also its plain text."""
    asked = dictionaries.filings.join(words.select("word").distinct(), "word").drop("format")
    got = asked.join(dictionaries.entries, ["path", "offset", "size"])

    @F.pandas_udf("string")
    def html(bodies: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else dsl.body_to_html(b, w) for b, w in zip(bodies, heads)])

    is_dsl = F.col("format") == "Dsl"
    got = got.withColumn("_html", html(F.when(is_dsl, F.col("text")), F.col("word")))
    found = got.select("path", "word", "filing_no", F.when(is_dsl, F.col("_html")).otherwise(F.col("text")).alias("html"), "format").filter("html <> '' or format = 'Csv'").drop("format")
    return found.withColumn("text", html_text(F.col("html"))) if text else found


def preview(dictionaries: Dictionaries, n: int = 5, chars: int = 100) -> DataFrame:
    """path, name, headwords, idx, word, preview: name, size and the first n headwords with the beginning of their text."""
    counts = dictionaries.headwords.groupBy("path").agg(F.count("*").alias("headwords"))
    first = dictionaries.headwords.filter(F.col("idx") < n)
    html = lookup(dictionaries, first).groupBy("path", "word").agg(F.min(F.struct("filing_no", "html")).alias("h"))
    return (
        dictionaries.names.join(counts, "path", "left").join(first, "path", "left").join(html, ["path", "word"], "left")
        .select("path", "name", F.coalesce("headwords", F.lit(0)).alias("headwords"), "idx", "word", F.left("h.html", F.lit(chars)).alias("preview"))
    )
