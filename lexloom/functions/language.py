"""Languages of words and dictionaries, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER = "OTHER"
# Scripts that belong to one language in practice.
SCRIPTS = {
    "HEB": "֐-׿יִ-ﭏ",
    "GRC": "Ͱ-Ͽἀ-῿",
    "CYR": "Ѐ-ӿ",
    "ARA": "؀-ۿ",
}
# Names and codes of languages as parts of a pair in a title.
PAIR_NAMES = {
    "lat": "LAT", "latin": "LAT", "grc": "GRC", "greek": "GRC", "heb": "HEB", "hebrew": "HEB", "arc": "ARC", "aramaic": "ARC",
    "fra": "FR", "fre": "FR", "french": "FR", "français": "FR", "eng": "ENG", "english": "ENG", "anglais": "ENG",
    "deu": "DEU", "ger": "DEU", "german": "DEU", "spa": "SPA", "spanish": "SPA", "ita": "ITA", "italian": "ITA",
    "rus": "RUS", "russian": "RUS", "ara": "ARA", "arabic": "ARA",
}
# What in a title names its language; the first that occurs counts.
TITLE_PARTS = (
    ("lat-", "LAT"), ("latin", "LAT"), ("french", "FR"), ("français", "FR"), ("fr-en", "FR"), ("greek", "GRC"), ("grc", "GRC"),
    ("lsj", "GRC"), ("liddell", "GRC"), ("pindar", "GRC"), ("hebrew", "HEB"), ("heb", "HEB"), ("aramaic", "ARC"), ("german", "DEU"),
    ("spanish", "SPA"), ("italian", "ITA"), ("russian", "RUS"), ("arabic", "ARA"), ("english", "ENG"),
)


def script_tag(word: Column) -> Column:
    """By the first letter of a script in SCRIPTS; null if there is none."""
    letters = "".join(SCRIPTS.values())
    first = F.regexp_extract(word, f"((?=\\p{{IsAlphabetic}})[{letters}])", 1)
    return reduce(lambda c, kv: c.when(first.rlike(f"^[{kv[1]}]"), kv[0]), SCRIPTS.items(), F.when(F.lit(False), F.lit(None)))


def named_language(title: Column) -> Column:
    """The language a title names, or null."""
    low = F.lower(title)
    return reduce(lambda c, p: c.when(low.contains(p[0]), p[1]), TITLE_PARTS, F.when(F.lit(False), F.lit(None)))


def pair(title: Column) -> Column:
    """(source, target) where two names stand directly on either side of - or _ ; null fields if there is no such pair."""
    names = F.create_map(*[F.lit(x) for kv in PAIR_NAMES.items() for x in kv])
    chunks = F.split(F.lower(title), r"[^\p{IsAlphabetic}\-_]")
    tag = lambda x: F.try_element_at(names, x)

    def pairs(chunk: Column) -> Column:
        parts = F.split(chunk, "[-_]")
        both = F.zip_with(parts, F.slice(parts, 2, F.size(parts)), lambda a, b: F.struct(tag(a).alias("source"), tag(b).alias("target")))
        return F.filter(both, lambda p: p["source"].isNotNull() & p["target"].isNotNull())

    return F.get(F.flatten(F.transform(chunks, pairs)), F.lit(0))


def tag(word: Column, title: Column) -> Column:
    """The language of one row: by its script, else by the dictionary's title."""
    return F.coalesce(script_tag(word), named_language(title))


def group(title: Column, configured: Column) -> Column:
    """The group of a dictionary: the language configured, else the source of its pair, else what its title names, else OTHER."""
    return F.coalesce(named_language(configured), pair(title)["source"], named_language(title), F.lit(OTHER))


def thousands(n: Column) -> Column:
    return F.format_number(n.cast("bigint"), 0)


def quantity(n: Column, one: str, many: str) -> Column:
    return F.concat(thousands(n), F.lit(" "), F.when(n == 1, one).otherwise(many))


def starts_a_sense(line: Column) -> Column:
    return line.rlike("^\\s*(?:¶|- |[0-9IVXivx]+[.)])")
