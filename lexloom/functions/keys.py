"""Search keys of headwords: fold (how a word is spelled), bare (without marks), and tests on combining marks.

fold: NFC, then full case folding. bare: the fold without homograph number and marks. ASCII words are folded by column
expressions; only others go through an Arrow function, which gets nulls in place of the ASCII ones.
"""

from __future__ import annotations

import functools
import re
import unicodedata as U
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOMOGRAPH = r" \([0-9]+\)\z"
_homograph = re.compile(r" \([0-9]+\)\Z")
# Marks a writer may leave off without writing another word (Hebrew points and accents, Arabic vowels).
OPTIONAL_MARKS = "[֑-ׇֽֿׁׂًׅׄ-ٰٟ]"
_optional = re.compile(OPTIONAL_MARKS)


def is_mark(c: str) -> bool:
    return U.category(c)[0] == "M"


def fold(word: str) -> str:
    return word.lower() if word.isascii() else U.normalize("NFC", word).casefold()


def strip_homograph(word: str) -> str:
    """Without one trailing number in brackets, as in `x (2)`."""
    return _homograph.sub("", word)


def bare(folded: str) -> str:
    """The key without marks, from a fold key."""
    word = strip_homograph(folded)
    return word if word.isascii() else U.normalize("NFC", "".join(c for c in U.normalize("NFD", word) if not is_mark(c)))


def only_optional_marks(folded: str) -> bool:
    """Whether all marks are optional ones; true of a word without marks."""
    return all(_optional.match(c) for c in U.normalize("NFD", folded) if is_mark(c))


@functools.lru_cache(100_000)
def _by_base(text: str) -> tuple[tuple[str, frozenset[str]], ...]:
    out: list[tuple[str, set[str]]] = []
    for c in text:
        if out and is_mark(c):
            out[-1][1].add(c)
        else:
            out.append((c, set()))
    return tuple((b, frozenset(m)) for b, m in out)


def marks_allow(query_fold: str, word: str) -> bool:
    """Whether the word has every mark of the query, base by base; the query may end first."""
    asked = _by_base(U.normalize("NFD", query_fold))
    given = _by_base(U.normalize("NFD", U.normalize("NFC", word).casefold()))
    return len(asked) <= len(given) and all(b == c and m <= n for (b, m), (c, n) in zip(asked, given))


def marks_of(folded: str) -> list[str]:
    """The marks of a spelling with the number of their base. Of two spellings with one bare key, the first allows the second if its marks are among those of the second."""
    return [f"{i}{m}" for i, (_, marks) in enumerate(_by_base(U.normalize("NFD", strip_homograph(folded)))) for m in sorted(marks)]


def without_homograph(word: Column) -> Column:
    return F.regexp_replace(word, HOMOGRAPH, "")


@functools.cache
def _keys():
    @F.pandas_udf("fold_key string, bare_key string, marks array<string>, optional boolean")
    def derive(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for words in batches:
            folds = [None if w is None else fold(w) for w in words]
            own = {
                "fold_key": folds,
                "bare_key": [None if f is None else bare(f) for f in folds],
                "marks": [None if f is None else marks_of(f) for f in folds],
                "optional": [None if f is None else only_optional_marks(f) for f in folds],
            }
            yield pd.DataFrame(own, dtype=object)

    return derive


def with_keys(df: DataFrame, word: str = "word") -> DataFrame:
    """df with fold_key, bare_key, fold_class (the fold without homograph number), plain (no such number), marks (see marks_of) and optional (whether all marks are)."""
    w = F.col(word)
    ascii_only = ~w.rlike(r"[^\x00-\x7F]")
    # called nondeterministic, so that filters on keys don't derive them a second time below
    out = df.withColumn("_k", _keys().asNondeterministic()(F.when(~ascii_only, w)))
    return out.withColumns(
        {
            "fold_key": F.when(ascii_only, F.lower(w)).otherwise(F.col("_k.fold_key")),
            "bare_key": F.when(ascii_only, without_homograph(F.lower(w))).otherwise(F.col("_k.bare_key")),
            "plain": w == without_homograph(w),
            "marks": F.coalesce("_k.marks", F.array().cast("array<string>")),
            "optional": F.coalesce("_k.optional", F.lit(True)),
        }
    ).withColumn("fold_class", without_homograph(F.col("fold_key"))).drop("_k")


def allows_marks(query_fold: str, word: Column) -> Column:
    """Column form of marks_allow for one query."""

    @F.pandas_udf("boolean")
    def allowed(words: pd.Series) -> pd.Series:
        return words.map(lambda w: w is not None and marks_allow(query_fold, w)).astype(bool)

    return allowed(word)
