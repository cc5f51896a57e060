"""Tables written as dictionary files, as readers elsewhere take them. One task writes the files of a dictionary, row by row."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lexloom.sources.formats import B64

_WRITTEN = "dict int, path string, rows bigint"


def b64(n: int) -> str:
    """A number in dictd's digits."""
    out = B64[n % 64]
    while n := n // 64:
        out = B64[n % 64] + out
    return out


class _Files:
    """The open files of one dictionary."""

    def __init__(self, fs, root: str, row):
        self.fs, self.at, self.form, self.rows, self.offset, self.words, self.synonyms = fs, f"{root}/dict-{row.dict}", row.format, 0, 0, 0, 0
        self.stem, self.name, self.packed = f"{self.at}/{row.stem}", row.name, bool(row.packed)
        fs.create_dir(self.at)
        self.out: dict[str, object] = {}
        if self.form == "Dictd":
            body = (self.name + "\n").encode()
            self.path = self.stem + ".index"
            self._write(".index", f"00-database-short\t{b64(0)}\t{b64(len(body))}\n".encode())
            self._data(body)
        elif self.form == "Dsl":
            self.encoding = "utf-16-le" if self.packed else "utf-8"
            self.path = self.stem + (".dsl.dz" if self.packed else ".dsl")
            self._write(self.path[len(self.stem) :], ("﻿" * self.packed + f'#NAME "{self.name}"\n').encode(self.encoding))
        else:
            self.path = self.stem + (".ifo" if self.form == "StarDict" else ".csv")

    def _write(self, ending: str, data: bytes) -> None:
        if ending not in self.out:
            self.out[ending] = self.fs.open_output_stream(self.stem + ending, compression="gzip" if ending.endswith(".dz") else None)
        self.out[ending].write(data)

    def _data(self, body: bytes) -> tuple[int, int]:
        at = self.offset
        self._write(".dict.dz" if self.packed else ".dict", body)
        self.offset += len(body)
        return at, len(body)

    def add(self, row) -> None:
        self.rows += 1
        if self.form == "StarDict" and row.target >= 0:
            self.synonyms += 1
            self._write(".syn", row.word.encode() + b"\0" + struct.pack(">I", row.target))
        elif self.form == "StarDict":
            self.words += 1
            self._write(".idx", row.word.encode() + b"\0" + struct.pack(">II", *self._data(row.text.encode())))
        elif self.form == "Dictd":
            at, size = self._data(row.text.encode())
            self._write(".index", f"{row.word}\t{b64(at)}\t{b64(size)}\n".encode())
        elif self.form == "Csv":
            self._write(".csv", (row.text + "\n").encode())
        else:
            self._write(self.path[len(self.stem) :], (row.text + "\n").encode(self.encoding))

    def close(self) -> None:
        if self.form == "StarDict":
            for ending in (".idx", ".dict.dz" if self.packed else ".dict"):
                self._write(ending, b"")
            self._write(".ifo", f"StarDict's dict ifo file\nversion=2.4.2\nbookname={self.name}\nwordcount={self.words}\nsynwordcount={self.synonyms}\nsametypesequence=h\n".encode())
        for f in self.out.values():
            f.close()


def write_dictionaries(rows: DataFrame, folder: str) -> list[str]:
    """The primary files written below folder: dict-<number>/<stem> with the endings of the format.

    rows: dict, format, stem, name, packed (data compressed, or cards in UTF-16 and compressed), no (order), word, text,
    target (of a StarDict synonym the number of the word it points to, else -1). Of tab-separated files and cards the
    text is the line or card as it is. Synonyms must come behind words in order.
    """
    kept = rows.select("dict", "format", "stem", "name", "packed", "no", "word", "text", "target")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        own, done = None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if own is None or own[0] != row.dict:
                    if own:
                        own[1].close()
                        done.append((own[0], own[1].path, own[1].rows))
                    own = (row.dict, _Files(fs, root, row))
                own[1].add(row)
        if own:
            own[1].close()
            done.append((own[0], own[1].path, own[1].rows))
        yield pd.DataFrame(done, columns=["dict", "path", "rows"]).astype({"dict": "int32", "rows": "int64"})

    # one row per dictionary is fetched
    return [r.path for r in kept.repartition("dict").sortWithinPartitions("dict", "no").mapInPandas(write, _WRITTEN).collect()]
