"""Column forms of the DSL functions."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import dsl


@functools.cache
def _filed():
    @F.pandas_udf("array<struct<word:string,listed:boolean>>")
    def filed_under(lines: pd.Series) -> pd.Series:
        return pd.Series([[] if x is None else [{"word": w, "listed": s} for w, s in dsl.filed(list(x))] for x in lines])

    return filed_under


@functools.cache
def _body():
    @F.pandas_udf("string")
    def html(bodies: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else dsl.body_to_html(b, w or "") for b, w in zip(bodies, words)], dtype=object)

    return html


def filed(lines: Column) -> Column:
    """The keys of a card's headword lines, each with whether it is listed."""
    return _filed()(lines)


def body_html(body: Column, headword: Column) -> Column:
    return _body()(body, headword)
