"""Mixing sources to target weights, in tokens of a public tokenizer.

Tokens are counted over whole texts and added up by source before the only shuffle. From the totals follows how often
each source is repeated; each document is then given out floor(rate) times, plus once more with the probability of the
fraction, decided by a seeded hash of the document, so that a lost executor gives the same rows again.

The size of the mix is the largest at which every source with documents reaches its share within its cap, so shares
hold exactly but for the chance of single documents; with `total_tokens`, sources that reach their cap are given out
as often as it allows, and the report shows the share they miss.

Defined cases: sources without target, targets without documents, null sources and null or non-positive shares
contribute nothing (shares of the others are scaled up to 1; the report lists every target); a cap that is null means
1; a null text has no tokens and is not given out; equal rows are equal in the draw; an empty table gives an empty mix.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import bounded, cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of texts before byte pairs are merged, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of each text; of null, null. The vocabulary file must be at the same place on every worker."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(tokenizer).encode_ordinary
        for texts in batches:
            yield pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return count(text)


def counted_documents(documents: DataFrame, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """source, draw, n: the tokens of each document with text, and its number in [0, 1) for the draw.

    Written to the shared folder: whoever needs totals and the result both counts each text once.
    """
    source = documents.select("doc_id", "source", "text").filter("text is not null and source is not null")
    return cut_lineage(source.select("source", _draw(seed).alias("draw"), count_tokens(F.col("text"), tokenizer).alias("n")), "tokens")


def totals_of(counted: DataFrame) -> DataFrame:
    """source, tokens, documents: one row per source."""
    return counted.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("n").alias("documents"))


def rates(totals: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """source, target_share, max_repeats, tokens, documents, share, rate: how often each source is given out.

    As many rows as there are targets, so the windows over all of them stay small.
    """
    wanted = targets.filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = wanted.join(totals, "source", "left").select(
        "source", "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents")
    )
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    every = Window.partitionBy()
    shared = both.withColumn("share", F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(every)).otherwise(0.0))
    fit = F.min(F.when(usable, F.col("max_repeats") * F.col("tokens") / F.col("share"))).over(every)
    size = fit if total_tokens is None else F.lit(float(total_tokens))
    return shared.withColumn("rate", F.when(usable, F.least(F.col("max_repeats").cast("double"), size * F.col("share") / F.col("tokens"))).otherwise(0.0)).select(
        "source", "target_share", "max_repeats", "tokens", "documents", "share", "rate"
    )


def _draw(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col("doc_id"), F.col("text")), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _copies(draw: Column) -> Column:
    """floor(rate), and one more with the probability of the fraction."""
    return (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, total_tokens: float | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """The mixed set: doc_id, source, copy_no (from 1), text. Texts aren't shuffled: the rates come to them."""
    plan = cut_lineage(rates(totals_of(counted_documents(documents, seed, tokenizer)), targets, total_tokens).filter("rate > 0").select("source", "rate"), "rates")
    return (
        documents.select("doc_id", "source", "text")
        .filter("text is not null")
        .join(bounded(plan), "source")
        .withColumn("copies", _copies(_draw(seed)))
        .filter("copies > 0")
        .select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "text")
    )


def shares(documents: DataFrame, targets: DataFrame, seed: int = 7, total_tokens: float | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """What the mix of the same parameters reaches, one row per target: tokens given out and the share of all of them."""
    counted = counted_documents(documents, seed, tokenizer)
    plan = cut_lineage(rates(totals_of(counted), targets, total_tokens), "rates")
    given = (
        counted.join(bounded(plan.filter("rate > 0").select("source", "rate")), "source")
        .withColumn("copies", _copies(F.col("draw")))
        .groupBy("source")
        .agg(F.sum(F.col("copies") * F.col("n")).alias("mixed_tokens"), F.sum("copies").alias("mixed_documents"))
    )
    out = plan.join(given, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("mixed_tokens", "mixed_documents")})
    total = F.sum("mixed_tokens").over(Window.partitionBy())
    return out.select(
        "source", "target_share", "max_repeats", "documents", "tokens", "rate", "mixed_documents", "mixed_tokens",
        F.when(total > 0, F.col("mixed_tokens") / total).otherwise(0.0).alias("reached_share"),
    )
