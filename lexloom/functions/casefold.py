"""Full Unicode case folding as a column expression; Spark has lower() but no case folding."""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.cache
def _tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Built by rule from str.casefold: characters folded to one character (from, to), and those folded to several."""
    one, several = [], []
    for c in map(chr, range(sys.maxunicode + 1)):
        folded = c.casefold()
        if folded != c:
            (one if len(folded) == 1 else several).append((c, folded))
    return "".join(a for a, _ in one), "".join(b for _, b in one), tuple(several)


def casefold(text: Column) -> Column:
    """Equal to Python's str.casefold for every text; null stays null.

    Characters that fold to one are translated by table; the few that fold to several are replaced one after
    another, which rows without any of them skip.
    """
    source, target, several = _tables()
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in several])
    expanded = F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["a"], p["b"]))
    ascii_only = ~text.rlike(r"[^\x00-\x7F]")
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(F.when(text.rlike("[" + "".join(a for a, _ in several) + "]"), expanded).otherwise(text), source, target)
    )
