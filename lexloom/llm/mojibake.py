"""Garbled text from wrong character encoding: find the affected records and restore the original where possible.

Learning: words, and whole strings, are grouped by what is left of them without non-ASCII characters. In each group the
simplest frequent one stands for the clean spelling, and every other is joined with that one twin only (never all
pairs of a group). The ASCII characters align both; what stands between them are pairs of a garbled run and its clean
original. Whole strings align words that have no ASCII character of their own. From the runs two things are learned:

* a mapping from garbled sequence to character, as the pairs show it, whatever the encodings were: runs are cut evenly
  into as many pieces as there are characters, and a piece that stands for one character in `least` different words and
  in four fifths of all its words is a mapping (`learned_units`). Two strings that differ by a word aren't told from
  garbled and clean ones by their remainder, so only pairs count that agree with others in most of their pieces, and
  pieces of letters alone, which could be words, need bytes that bear them out;
* which known encodings explain pairs (bytes of UTF-8 read in another encoding, once or twice). These extend the
  mapping to characters that no pair shows.

What is fetched is one row per mapping, of which there are at most as many as characters times encodings, and one per
known encoding. The words of all texts are gathered in one pass and written once with their numbers.

Applying: in all records, runs of non-ASCII characters that the mapping or a learned encoding turns back in full, or
that hold mapped sequences with signs no word is written with, are restored, longest first. Single western letters
that stand for another script (`legacy`) are turned back only in words without any ASCII letter. The replacement
character U+FFFD marks a record too; words with lost characters are filled in from their twin where one fits what is
left (`regained`), and stay as they are elsewhere.

Defined cases: null and empty texts are no cases; without evidence nothing is learned and only U+FFFD counts; rows
given twice are found twice by row and once by key; a lone letter such as a cited "Â" is no sequence and stays.
"""

from __future__ import annotations

import functools
import unicodedata as U
import uuid
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut_lineage, discard

LOST = "�"
RUN = regex.compile(r"[^\x00-\x7F]+")
#: Encodings that UTF-8 may have been read in; a chain is one of them, or two, first mistake first.
CODECS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1255", "cp1257", "mac_roman", "cp437", "cp850", "cp852", "cp866", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_15", "koi8_r", "mac_cyrillic")
#: (read in, written in) for single-byte text; only words without any ASCII letter are tried.
LEGACY = [(a, b) for a in ("cp1252", "latin-1", "mac_roman", "cp437") for b in ("cp1251", "cp1253", "cp1255", "iso8859_5", "iso8859_7", "iso8859_8", "koi8_r", "cp866", "mac_cyrillic", "mac_greek")]
#: Characters that may have been garbled: letters of the scripts at hand, and punctuation.
REPERTOIRE = [*range(0xA0, 0x250), *range(0x300, 0x483), *range(0x48A, 0x530), *range(0x591, 0x5F5), *range(0x1F00, 0x2000), *range(0x2010, 0x2045), 0x20AC, 0x2122]
KNOWN = {*map(chr, REPERTOIRE), *map(chr, range(32, 127))}
WORD_ENDS = r"[\s<>\"=\[\]/]+"
#: ASCII that no word of evidence goes across: in "\\emph{à}" or "&lt;b&gt;à" the letters of the markup tell nothing of the word.
EVIDENCE_ENDS = r"[\x00-\x7F&&[^A-Za-z'-]]+"
#: A word of accented western letters and marks, without any ASCII letter.
FOREIGN = r"^[^A-Za-z]*[\x{80}-\x{2FF}][^A-Za-z]*[\x{80}-\x{2FF}][^A-Za-z]*$"
FOREIGN_WORD = regex.compile(r"(?<![^\s<>\"=\[\]/])[^A-Za-z\s<>\"=\[\]/]+(?![^\s<>\"=\[\]/])")


def _one_script(text: str) -> bool:
    """Whether the letters are at least two and all Greek, all Cyrillic or all Hebrew."""
    letters = [c for c in text if c.isalpha()]
    return len(letters) > 1 and any(all(a <= c <= b or (a == "Ͱ" and "ἀ" <= c <= "῿") for c in letters) for a, b in (("Ͱ", "Ͽ"), ("Ѐ", "ӿ"), ("֑", "״"))) and not any("\x80" <= c <= "˿" and c not in "·«»§" for c in text)


@functools.cache
def _bytes_of(codec: str) -> dict[str, bytes]:
    """Character to byte; bytes without a character stand as the control of their number, as lenient decoders leave them."""
    out: dict[str, bytes] = {}
    for b in range(256):
        c = bytes([b]).decode(codec, "replace")
        out.setdefault(chr(b) if c == LOST else c, bytes([b]))
    return out


@functools.cache
def _signs_of(codec: str) -> list[str]:
    back = {v[0]: k for k, v in _bytes_of(codec).items()}
    return [back.get(b, chr(b)) for b in range(256)]


def misread(text: str, chain: tuple[str, ...]) -> str:
    """What text becomes when its UTF-8 bytes are read in each encoding of the chain in turn."""
    for codec in chain:
        signs = _signs_of(codec)
        text = "".join([signs[b] for b in text.encode("utf-8")])
    return text


def reread(text: str, codec: str) -> str | None:
    """The original of text if it was UTF-8 read in that encoding, else None."""
    table = _bytes_of(codec)
    try:
        return b"".join([table.get(c) or c.encode("latin-1") for c in text]).decode("utf-8")
    except UnicodeError:
        return None


def reread_legacy(text: str, chain: tuple[str, str]) -> str | None:
    """The original of text if its bytes in the second encoding were read in the first."""
    table, signs = _bytes_of(chain[0]), _signs_of(chain[1])
    return "".join([signs[table[c][0]] for c in text]) if all(c in table for c in text) else None


def explaining(garbled: str, clean: str) -> list[str]:
    """The encodings that turn the clean run into the garbled one, by one mistake or the same family twice."""
    size = len(clean.encode("utf-8"))
    if len(garbled) == size:
        return [c for c in CODECS if misread(clean, (c,)) == garbled]
    if len(garbled) < size:
        return []
    once = {misread(clean, (c,)): c for c in reversed(CODECS)}
    return sorted({x for text, c in once.items() if len(text.encode("utf-8")) == len(garbled) for d in CODECS if misread(text, (d,)) == garbled for x in (c, d)})


def words_of(texts: DataFrame) -> DataFrame:
    """word, n: all words with non-ASCII characters of column `value`, written once."""
    words = texts.filter(F.col("value").rlike(r"[^\x00-\x7F]")).select(F.explode(F.split("value", WORD_ENDS)).alias("word"))
    return cut_lineage(words.filter(F.col("word").rlike(r"[^\x00-\x7F]")).groupBy("word").agg(F.count("*").alias("n")), "words")


_runs = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"[^\x00-\x7F]+"), F.lit(0))
_shape = lambda c: F.regexp_replace(F.col(c), r"[^\x00-\x7F]+", "\u0001")
_skeleton = lambda c: F.regexp_replace(F.col(c), r"[^\x00-\x7F]+", "")
_odd = lambda c: F.length(F.regexp_replace(F.col(c), r"[\x00-\x7F]+", ""))


def _aligned(pairs: DataFrame) -> DataFrame:
    """garbled, clean, n: the runs of word and twin that stand at the same place, and in how many words they do."""
    return (
        pairs.filter(_shape("word") == _shape("twin"))
        .select(F.explode(F.arrays_zip(_runs("word").alias("garbled"), _runs("twin").alias("clean"))).alias("p"))
        .select("p.garbled", "p.clean")
        .filter("garbled <> clean")
        .groupBy("garbled", "clean")
        .agg(F.count("*").alias("n"))
    )


def twin_evidence(words: DataFrame) -> DataFrame:
    """garbled, clean, n: pairs of runs aligned between words (word, n) and their clean near-twin."""
    bare = words.select(F.explode(F.split("word", EVIDENCE_ENDS)).alias("word"), "n").select(F.btrim("word", F.lit("'-")).alias("word"), "n")
    bare = bare.filter(F.col("word").rlike(r"[^\x00-\x7F]") & ~F.col("word").contains(LOST)).groupBy("word").agg(F.sum("n").alias("n"))
    own = bare.withColumns({"skeleton": _skeleton("word"), "odd": _odd("word")}).filter(F.col("skeleton").rlike("[A-Za-z].*[A-Za-z]"))
    # the twin: fewest non-ASCII characters, then most frequent, then first in order
    twins = own.groupBy("skeleton").agg(F.min(F.struct("odd", -F.col("n"), "word")).alias("t"), F.count("*").alias("c")).filter("c > 1")
    pairs = own.join(twins.select("skeleton", F.col("t.word").alias("twin"), F.col("t.odd").alias("twin_odd")), "skeleton").filter("odd > twin_odd")
    return _aligned(pairs)


def record_evidence(texts: DataFrame) -> DataFrame:
    """garbled, clean, n: as twin_evidence, of whole strings whose ASCII characters, ten letters or more, are the same.

    Strings are told apart by hashes; only those whose remainder stands in several different strings are joined.
    """
    own = texts.select("value").filter(F.col("value").rlike(r"[^\x00-\x7F]") & ~F.col("value").contains(LOST)).withColumn("skeleton", _skeleton("value"))
    own = own.filter(F.length(F.regexp_replace("skeleton", "[^A-Za-z]", "")) >= 10).select(F.col("value").alias("word"), F.xxhash64("skeleton").alias("key"), _odd("value").alias("odd"))
    first = own.groupBy("key").agg(F.min(F.struct("odd", F.xxhash64("word"), "word")).alias("t"), F.min(F.xxhash64("word")).alias("a"), F.max(F.xxhash64("word")).alias("z")).filter("a <> z")
    pairs = own.join(first.select("key", F.col("t.word").alias("twin")), "key").filter("word <> twin").dropDuplicates(["word"])
    return _aligned(pairs.filter(_skeleton("word") == _skeleton("twin")))


def units_of(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The pieces of a garbled run, one for each character of the clean one, if it can be cut evenly."""
    k, rest = divmod(len(garbled), len(clean))
    if rest or not k or U.normalize("NFKC", garbled) == U.normalize("NFKC", clean):
        return []
    return [(garbled[i * k : (i + 1) * k], c) for i, c in enumerate(clean)]


def could_be_word(text: str) -> bool:
    return all(U.category(c)[0] in "LM" for c in text)


def borne_out(units: dict[str, str], least: int = 3) -> dict[str, str]:
    """The units without those of letters alone that no bytes bear out.

    Such a unit needs a known encoding that gives it, or as many signs as its character has bytes, the first of them
    standing for the same first byte in units of `least` characters.
    """
    led: dict[tuple[str, int], set[str]] = {}
    whole = {g: c for g, c in units.items() if len(g) == len(c.encode("utf-8"))}
    for g, c in whole.items():
        led.setdefault((g[0], c.encode("utf-8")[0]), set()).add(c)
    return {g: c for g, c in units.items() if len(g) == 1 or not could_be_word(g) or explaining(g, c) or (g in whole and len(led[g[0], c.encode("utf-8")[0]]) >= least)}


def learned_units(pairs: DataFrame, least: int = 3, share: float = 0.8) -> dict[str, str]:
    """garbled sequence -> character, from aligned runs (garbled, clean, n).

    Single letters count only where they stand for a letter of another script; one accent for another is a spelling.
    Pairs of different words agree on some piece by chance, but not on most: what is learned first chooses the pairs
    that count.
    """

    def pieces(garbled: str, clean: str) -> list[tuple[str, str]]:
        return [(g, c) for g, c in units_of(garbled, clean) if g != c and (len(g) > 1 or (g < "\u02ff" < c and _one_script(c + c)))]

    @F.pandas_udf("array<struct<g:string,c:string>>")
    def cut(garbled: pd.Series, clean: pd.Series) -> pd.Series:
        return pd.Series([[{"g": g, "c": c} for g, c in pieces(a, b)] for a, b in zip(garbled, clean)])

    def most_frequent(cuts: DataFrame) -> dict[str, str]:
        counts = cuts.select(F.explode("u").alias("u"), "n").groupBy("u.g", "u.c").agg(F.sum("n").alias("n"))
        best = counts.groupBy("g").agg(F.sum("n").alias("all"), F.max(F.struct("n", "c")).alias("b")).filter((F.col("b.n") >= least) & (F.col("b.n") >= share * F.col("all")))
        return {r.g: r.c for r in best.select("g", F.col("b.c").alias("c")).collect()}

    cuts = pairs.select(cut("garbled", "clean").alias("u"), "n")
    first = most_frequent(cuts)

    @F.pandas_udf("boolean")
    def agrees(u: pd.Series) -> pd.Series:
        return pd.Series([2 * sum(first.get(x["g"]) == x["c"] for x in p) > len(p) for p in u], dtype=bool)

    return borne_out(most_frequent(cuts.filter(agrees("u"))), least) if first else {}


def _in_order(evidence: DataFrame, least: int, order: list) -> list[str]:
    """The names with enough evidence, most first; one row per name is fetched."""
    rows = [(-r.n, order.index(r.name), r.name) for r in evidence.groupBy("name").agg(F.count("*").alias("n")).collect() if r.n >= least]
    return [name for _, _, name in sorted(rows)]


def _explained(pairs: DataFrame, least: int) -> list[str]:
    @F.pandas_udf("array<string>")
    def explain(garbled: pd.Series, clean: pd.Series) -> pd.Series:
        return pd.Series([explaining(g, c) for g, c in zip(garbled, clean)])

    return _in_order(pairs.select(F.explode(explain("garbled", "clean")).alias("name")), least, list(CODECS))


def learn_encodings(texts: DataFrame, least: int = 3) -> list[str]:
    """Encodings that UTF-8 was read in, with at least `least` distinct pairs of evidence over all texts."""
    return _explained(twin_evidence(words_of(texts)), least)


def _legacy(odd: DataFrame, seen: DataFrame, least: int) -> list[tuple[str, str]]:
    names = [">".join(c) for c in LEGACY]

    @F.pandas_udf("array<struct<name:string,word:string>>")
    def candidates(words: pd.Series) -> pd.Series:
        out = []
        for w in words:
            new = [(name, RUN.sub(lambda m, c=c: reread_legacy(m[0], c) or m[0], w)) for name, c in zip(names, LEGACY)]
            out.append([{"name": n, "word": x} for n, x in new if x != w and _one_script(x)])
        return pd.Series(out)

    odd = odd.select("word").filter(F.col("word").rlike(FOREIGN))
    seen = seen.select("word").filter(F.col("word").rlike(r"[^\x00-\x{02FF}]"))
    return [tuple(n.split(">")) for n in _in_order(odd.select(F.explode(candidates("word")).alias("c")).select("c.*").join(seen, "word").select("name"), least, names)]


def learn_legacy(texts: DataFrame, vocabulary: DataFrame, least: int = 3) -> list[tuple[str, str]]:
    """(read in, written in): legacy encodings taken for a western one.

    Such words have nothing left without their non-ASCII characters. Beside the twins of whole strings (learned_units),
    twins are found by what they would have been: each is read anew in every legacy encoding and joined with the words
    of `vocabulary` (column `value`).
    """
    return _legacy(words_of(texts), words_of(vocabulary), least)


class Restorer:
    """Applies the mappings of the learned encodings; built once per worker."""

    def __init__(self, encodings: list[str], legacy: list[tuple[str, str]], units: dict[str, str] | None = None):
        import ahocorasick

        self.encodings, self.legacy = encodings, legacy
        self.units = {g: c for g, c in (units or {}).items() if len(g) > 1}
        self.letters = {g: c for g, c in (units or {}).items() if len(g) == 1}
        self.longest = max(map(len, self.units), default=0)
        # what the pairs show comes before what encodings would give
        mapping = {g: c for g, c in self.units.items() if not could_be_word(g)}
        for codec in encodings:
            for c in map(chr, REPERTOIRE):
                seen = misread(c, (codec,))
                # a sequence of letters alone could be a word; it counts only where the run is turned back in full
                if not seen.isascii() and not seen.isalpha() and U.category(c)[0] != "C":
                    mapping.setdefault(seen, c)
        self.automaton = ahocorasick.Automaton()
        for k, v in mapping.items():
            self.automaton.add_word(k, (len(k), v))
        self.automaton.make_automaton()
        self.any = bool(mapping)

    def by_units(self, run: str) -> str | None:
        """The run as learned sequences, longest first, if it consists of such and of characters that no sequence begins with."""
        out, at, hit = [], 0, False
        while at < len(run):
            for k in range(min(self.longest, len(run) - at), 1, -1):
                if to := self.units.get(run[at : at + k]):
                    out.append(to)
                    at, hit = at + k, True
                    break
            else:
                return None
        return "".join(out) if hit else None

    def once(self, run: str) -> str | None:
        if len(run) > 1:
            if self.units and (new := self.by_units(run)):
                return new
            for codec in self.encodings:
                whole = reread(run, codec)
                if not whole or whole == run:
                    continue
                if KNOWN.issuperset(whole):
                    return whole
                # garbled twice, with bytes in between that no one wrote
                for again in self.encodings:
                    if (twice := reread(whole, again)) and twice != whole and KNOWN.issuperset(twice):
                        return twice
        if not self.any:
            return None
        parts, at = [], 0
        for end, (n, to) in self.automaton.iter_long(run):
            parts += [run[at : end + 1 - n], to]
            at = end + 1
        return "".join(parts) + run[at:] if parts else None

    def run(self, run: str) -> str | None:
        """The run restored, or None if nothing in it is garbled; text garbled twice is turned back twice."""
        new = None
        for _ in range(3):
            better = RUN.sub(lambda m: self.once(m[0]) or m[0], new or run)
            if better == (new or run):
                break
            new = better
        return new

    def foreign(self, word: str) -> str | None:
        """A word all of accented western letters, as it was written in a legacy encoding."""
        if self.letters and all(c in self.letters for c in word if ord(c) > 127):
            new = "".join(self.letters.get(c, c) for c in word)
            if new != word and _one_script(new):
                return new
        runs = RUN.findall(word)
        for chain in self.legacy:
            # all of the word was read in the same encoding: where one run can't have been, the others weren't either
            if not all(reread_legacy(r, chain) for r in runs):
                continue
            new = RUN.sub(lambda m, c=chain: reread_legacy(m[0], c), word)
            if new != word and _one_script(new):
                return new
        return None

    def __call__(self, text: str) -> tuple[str, bool]:
        """(restored text, whether it was garbled)"""
        if text.isascii():
            return text, False
        hit = LOST in text

        def one(m) -> str:
            nonlocal hit
            new = self.run(m[0])
            hit |= new is not None
            return m[0] if new is None else new

        def whole(m) -> str:
            nonlocal hit
            new = self.foreign(m[0])
            hit |= new is not None
            return m[0] if new is None else new

        text = RUN.sub(one, text)
        return (FOREIGN_WORD.sub(whole, text) if self.legacy or self.letters else text), hit


_restorers: dict[str, Restorer] = {}


def _restorer(name: str, encodings: list[str], legacy: list[tuple[str, str]], units: dict[str, str] | None) -> Restorer:
    if name not in _restorers:
        _restorers.clear()
        _restorers[name] = Restorer(encodings, legacy, units)
    return _restorers[name]


def restored(texts: DataFrame, encodings: list[str], legacy: list[tuple[str, str]] = (), units: dict[str, str] | None = None) -> DataFrame:
    """The rows of texts (with their other columns) that hold garbled text, with `original` restored where possible.

    Rows of ASCII only never leave the JVM.
    """
    name = uuid.uuid4().hex
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema)

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = _restorer(name, encodings, legacy, units)
        for batch in batches:
            both = [one(v) for v in batch.value]
            yield batch.assign(original=[b[0] for b in both])[[b[1] for b in both]]

    return texts.filter(F.col("value").rlike(r"[^\x00-\x7F]")).mapInPandas(restore, f"{fields}, original string")


def twins_of(words: DataFrame) -> DataFrame:
    """skeleton, twin: the simplest, then most frequent, whole word of each skeleton, from words (word, n)."""
    own = words.filter(~F.col("word").contains(LOST)).withColumns({"odd": _odd("word"), "skeleton": _skeleton("word")}).filter(F.col("skeleton").rlike("[A-Za-z].*[A-Za-z]"))
    return own.groupBy("skeleton").agg(F.min(F.struct("odd", -F.col("n"), "word")).alias("t")).select("skeleton", F.col("t.word").alias("twin"))


def could_be(lost: str, clean: str, encodings: list[str]) -> bool:
    """Whether the clean run, misread in a learned encoding, shows what is left of a run with lost characters."""
    pattern = regex.compile("".join(".{1,2}" if c == LOST else regex.escape(c) for c in lost), regex.S)
    return lost.strip(LOST) == "" or any(pattern.fullmatch(misread(clean, (c,))) for c in encodings)


def regained(found: DataFrame, texts: DataFrame, encodings: list[str], words: DataFrame | None = None) -> DataFrame:
    """found (field, row_key, part, value, original) with lost words filled in from their twin among whole words.

    A twin counts if it has the same ASCII characters around its other ones and, misread, shows what is left of the
    lost word; words without such a twin stay as they are.
    """
    key = ["field", "row_key", "part"]

    @F.pandas_udf("boolean")
    def fits(lost: pd.Series, clean: pd.Series) -> pd.Series:
        return pd.Series([all(could_be(a, b, encodings) for a, b in zip(x, y)) for x, y in zip(lost, clean)], dtype=bool)

    broken = found.filter(F.col("original").contains(LOST)).select(*key, F.explode(F.array_distinct(F.split("original", WORD_ENDS))).alias("word")).filter(F.col("word").contains(LOST))
    known = (
        broken.select("word").distinct().withColumn("skeleton", _skeleton("word"))
        .join(twins_of(words_of(texts) if words is None else words), "skeleton")
        .filter(_shape("word") == _shape("twin"))
        .filter(fits(_runs("word"), _runs("twin")))
        .select("word", "twin")
    )
    # longer words first, so that none is replaced inside another
    pairs = broken.join(known, "word").groupBy(*key).agg(F.array_sort(F.collect_set(F.struct((-F.length("word")).alias("n"), "word", "twin"))).alias("pairs"))
    filled = F.aggregate("pairs", F.col("original"), lambda acc, p: F.replace(acc, p["word"], p["twin"]))
    return found.join(pairs, key, "left").withColumn("original", F.when(F.col("pairs").isNotNull(), filled).otherwise(F.col("original"))).drop("pairs")


def headword_lines(card: Column) -> Column:
    """The lines of a card that begin at column 0."""
    return F.filter(F.split(card, r"\r?\n"), lambda x: x.rlike(r"^[^\t ]"))


def garbled_fields(definitions: DataFrame, dsl_cards: DataFrame) -> DataFrame:
    """field, row_key, part, value: strings of entries and headword lines of cards that aren't null."""
    entries = definitions.select(F.lit("definition").alias("field"), F.col("def_id").alias("row_key"), F.posexplode("entries").alias("part", "value"))
    heads = dsl_cards.select(F.lit("dsl_headword").alias("field"), F.col("card_id").alias("row_key"), F.posexplode(headword_lines(F.col("card"))).alias("part", "value"))
    return entries.unionByName(heads).filter("value is not null")


def found(definitions: DataFrame, dsl_cards: DataFrame, least: int = 3, fill: bool = False) -> DataFrame:
    """field, row_key, part, value, original: all garbled strings with their restored form; with fill, lost words too."""
    texts = garbled_fields(definitions, dsl_cards)
    words = words_of(texts)
    bodies = words_of(dsl_cards.select(F.col("card").alias("value")))
    pairs = cut_lineage(twin_evidence(words).unionByName(record_evidence(texts)).groupBy("garbled", "clean").agg(F.sum("n").alias("n")), "pairs")
    encodings, units = _explained(pairs, least), learned_units(pairs, least)
    rows = restored(texts, encodings, _legacy(words, words.unionByName(bodies).select("word").distinct(), least), units)
    discard(pairs, bodies)
    return regained(cut_lineage(rows, "restored"), texts, encodings, words) if fill else rows
