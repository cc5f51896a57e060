"""Evaluation texts inside training text: which documents contain passages of which test items.

Wu-Manber search with words as its alphabet: the patterns are all runs of `words` consecutive words of the items. A
table of bytes, indexed by the hash of a block of two words, gives how far the search may move on; most blocks of a
document occur in no item and skip eleven words at once. Where the shift is zero, a second table tells by the hash of
the whole run whether it can be a pattern; what is left is compared directly. Words that share a hash can only make
a shift shorter or a comparison more, so nothing is missed and nothing wrong is given.

Both tables are built by the executors, piece by piece, and the documents are read once whatever the number of items.
Items of up to `block_chars` characters are compared within that pass (the patterns are kept by worker, not by task);
of more items the runs left are written and joined with the runs of the items. Both ways give the same rows.

Defined cases: null or empty texts and items, and items shorter than `words`, match nothing; rows given twice give
one result row; a null id is kept as an id. Words are runs of letters and digits after case folding, so combining
marks separate words in both texts alike.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import cut_lineage

WORD = re.compile(r"[^\W_]+")
BLOCK = 2
#: Entries of a table: at least eight for each word of the items, within these powers of two. With more items than the
#: upper one holds, more positions are compared, that is all.
LEAST_BITS, MOST_BITS = 16, 26
PIECE = 1 << 16


def words_of(text: str) -> list[str]:
    return WORD.findall(text.casefold())


def _code(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def runs_of(text: str | None, length: int) -> list[str]:
    w = words_of(text or "")
    return [" ".join(w[i : i + length]) for i in range(len(w) - length + 1)]


class Tables(NamedTuple):
    """shift: by the hash of two words how far to move on; known: by the hash of a run whether it can be a pattern."""

    length: int
    shift: bytes
    known: bytes

    @classmethod
    def of(cls, texts: Iterable[str | None], length: int, bits: int) -> Tables:
        size = 1 << bits
        shift, known = np.full(size, length - BLOCK + 1, np.uint8), np.zeros(size, np.uint8)
        for text in texts:
            w = words_of(text or "")
            if len(w) < length:
                continue
            n = len(w) - length
            for at in range(BLOCK, len(w) + 1):
                # the block ends `rest` words before the end of the pattern that fits it best
                rest = max(0, length - at)
                slot = _code(f"{w[at - 2]} {w[at - 1]}") & (size - 1)
                if rest < shift[slot]:
                    shift[slot] = rest
            for i in range(n + 1):
                known[_code(" ".join(w[i : i + length])) & (size - 1)] = 1
        return cls(length, shift.tobytes(), known.tobytes())

    def ends(self, w: list[str]) -> Iterator[tuple[int, str]]:
        """(end, run) of all runs of w that can be patterns."""
        n, shift, known, mask, end, last = self.length, self.shift, self.known, len(self.shift) - 1, self.length, len(w)
        while end <= last:
            move = shift[_code(f"{w[end - 2]} {w[end - 1]}") & mask]
            if move == 0:
                run = " ".join(w[end - n : end])
                if known[_code(run) & mask]:
                    yield end, run
                move = 1
            end += move


class WordSearch:
    """Tables with the patterns themselves, for items few enough to be held by each worker."""

    def __init__(self, tables: Tables, items: Iterable[tuple[int, str]]):
        self.tables, self.bucket = tables, {}
        for item, text in items:
            for run in runs_of(text, tables.length):
                self.bucket.setdefault(run, set()).add(item)

    def find(self, w: list[str]) -> dict[int, int]:
        """The items of which w holds a run, each with the length of the longest run of words in common."""
        at: dict[int, tuple[int, int]] = {}
        best: dict[int, int] = {}
        for end, run in self.tables.ends(w):
            for item in self.bucket.get(run, ()):
                start, last = at.get(item, (0, -2))
                if last != end - 1:
                    start = end - self.tables.length
                at[item] = (start, end)
                best[item] = max(best.get(item, 0), end - start)
        return best


_engines: dict[str, WordSearch] = {}


def _engine(shared) -> WordSearch:
    """The search of a broadcast (name, tables, items), built once in each worker."""
    name, tables, items = shared.value
    if name not in _engines:
        _engines.clear()
        _engines[name] = WordSearch(tables, items)
    return _engines[name]


def build_tables(items: DataFrame, words: int, bits: int) -> Tables:
    """The tables of all items; each task fills its own, and pieces of them are merged by their number."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = (t for b in batches for t in b.text)
        own = Tables.of(texts, words, bits)
        skip = bytes([words - BLOCK + 1])
        rows = []
        for name, table, empty in (("shift", own.shift, skip), ("known", own.known, b"\0")):
            for i in range(0, len(table), PIECE):
                piece = table[i : i + PIECE]
                if piece.strip(empty):
                    rows.append((name, i // PIECE, piece))
        yield pd.DataFrame(rows, columns=["name", "piece", "data"]).astype({"piece": "int32"})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        both = np.minimum if pdf.name.iloc[0] == "shift" else np.maximum
        data = both.reduce([np.frombuffer(d, np.uint8) for d in pdf["data"]])
        return pd.DataFrame({"name": pdf.name[:1], "piece": pdf.piece[:1], "data": [data.tobytes()]})

    kind = "name string, piece int, data binary"
    size = 1 << bits
    out = {"shift": bytearray([words - BLOCK + 1]) * size, "known": bytearray(size)}
    for r in items.select("text").mapInPandas(fill, kind).groupBy("name", "piece").applyInPandas(merge, kind).toLocalIterator():
        out[r.name][r.piece * PIECE : r.piece * PIECE + len(r.data)] = r.data
    return Tables(words, bytes(out["shift"]), bytes(out["known"]))


def leaked(documents: DataFrame, items: DataFrame, words: int = 12, block_chars: int = 4_000_000) -> DataFrame:
    """One row per document and item in common: doc_id, item_id, longest_run (words)."""
    context = documents.sparkSession.sparkContext
    wanted = items.select("item_id", "text").filter("text is not null")
    size = wanted.agg(F.sum(F.length("text")).alias("chars")).first().chars or 0
    # a word and what separates it take five characters or more, nearly always
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * size // 5).bit_length()))
    tables = build_tables(wanted, words, bits)
    source = documents.select("doc_id", "text").filter("text is not null")
    result = "doc_id bigint, item_id bigint, longest_run int"
    if size <= block_chars:
        shared = context.broadcast((uuid.uuid4().hex, tables, [(r.item_id, r.text) for r in wanted.collect()]))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            engine = _engine(shared)
            for batch in batches:
                rows = [(d, i, n) for d, t in zip(batch.doc_id, batch.text) for i, n in engine.find(words_of(t)).items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "longest_run"]).astype({"doc_id": "Int64", "item_id": "Int64", "longest_run": "int32"})

        found = source.mapInPandas(search, result)
    else:
        shared = context.broadcast((uuid.uuid4().hex, tables, ()))

        def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find = _engine(shared).tables.ends
            for batch in batches:
                rows = [(row, d, end, run) for row, d, t in zip(batch["row"], batch.doc_id, batch.text) for end, run in find(words_of(t))]
                yield pd.DataFrame(rows, columns=["row", "doc_id", "end", "run"]).astype({"row": "int64", "doc_id": "Int64", "end": "int32"})

        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(i, run) for i, t in zip(batch.item_id, batch.text) for run in set(runs_of(t, words))]
                yield pd.DataFrame(rows, columns=["item_id", "run"]).astype({"item_id": "Int64"})

        left = cut_lineage(source.withColumn("row", F.monotonically_increasing_id()).mapInPandas(candidates, "row bigint, doc_id bigint, end int, run string"), "candidates")
        hits = left.join(wanted.mapInPandas(spread, "item_id bigint, run string").distinct(), "run").select("row", "doc_id", "item_id", "end").distinct()
        # positions that follow each other differ from their number by the same
        own = hits.withColumn("island", F.col("end") - F.row_number().over(Window.partitionBy("row", "doc_id", "item_id").orderBy("end")))
        found = own.groupBy("row", "doc_id", "item_id", "island").agg((F.count("*") + words - 1).cast("int").alias("longest_run"))
    return found.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"))
