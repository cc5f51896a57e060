"""Rows that fail to parse: valid records parsed, faulty ones kept with every reason why they fail.

Each input row arrives as nullable text. Rules are column expressions that each give a reason or null; the reasons
of a row form an error array, and an empty array marks a valid row. Nothing leaves the JVM and nothing is shuffled.

Defined cases: a null line or card is faulty with the reason ``null_text``; an empty one fails by field count or by
having no headword. Repeated rows are judged each on its own. Columns of the input named like a result column are
dropped from the output; others are not carried along (join on the id for them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A field in double quotes, with "" for one quote. Possessive, so that long fields cannot exhaust the stack.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
CSV_FIELDS = 6
#: Control characters that no record may hold; tab separates, and is allowed inside quotes.
CSV_CONTROL = r"[\x00-\x08\x0A-\x1F]"
DSL_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]|\r(?!\n)"
#: How often nested pairs are removed by plain replacement before the general rule takes over.
PAIR_PASSES = 6


def _reasons(*rules: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules]))


def _unquote(field: Column) -> Column:
    return F.when(field.rlike(f"^{QUOTED}\\z"), F.replace(F.substring(field, 2, F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)


def csv_records(lines: DataFrame, text: str = "line", keys: tuple[str, ...] = ("line_id", "dict", "line_no")) -> DataFrame:
    """All lines with their fields and error arrays: keys, display, entry_no, headword, key, body, number, errors."""
    line = F.regexp_replace(F.col(text), r"\r\z", "")
    df = lines.select(*keys, F.col(text).alias("_text"), line.alias("_line"))
    df = df.withColumn("_raw", F.regexp_extract_all(F.concat(F.lit("\t"), F.col("_line")), F.lit(rf"\t({QUOTED}(?=\t|\z)|[^\t]*+)"), F.lit(1)))
    df = df.withColumn("_f", F.transform("_raw", _unquote))
    field = lambda i: F.get(F.col("_f"), F.lit(i))
    whole = r"^[0-9]{1,18}\z"
    errors = _reasons(
        ("null_text", F.col("_text").isNull()),
        ("field_count", F.size("_raw") != CSV_FIELDS),
        ("bad_quoting", F.exists("_raw", lambda f: f.startswith('"') & ~f.rlike(f"^{QUOTED}\\z"))),
        ("control_character", F.col("_line").rlike(CSV_CONTROL)),
        # ANSI casts take signs and blanks as well, so the form is a rule of its own
        ("bad_id", ~field(1).rlike(whole) | field(1).try_cast("bigint").isNull()),
        ("bad_number", ~field(5).rlike(whole) | field(5).try_cast("bigint").isNull()),
        ("blank_headword", field(2).rlike(r"^[\s\p{Z}]*\z")),
    )
    return df.select(
        *keys,
        field(0).alias("display"),
        field(1).try_cast("bigint").alias("entry_no"),
        F.regexp_replace(field(2), r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "").alias("headword"),
        field(3).alias("key"),
        field(4).alias("body"),
        field(5).try_cast("bigint").alias("number"),
        errors.alias("errors"),
        F.col("_text").alias("text"),
    )


def _drop_pairs(text: Column, pair: str, passes: int = PAIR_PASSES) -> Column:
    for _ in range(passes):
        text = F.regexp_replace(text, pair, "")
    return text


def _unnested(brackets: Column) -> Column:
    """Whether a string of brackets and line breaks isn't properly nested within each line.

    Pairs are removed innermost first; only nesting deeper than PAIR_PASSES needs the stack.
    """
    pair = r"\(\)|\{\}"
    left = _drop_pairs(brackets, pair)
    stacked = F.aggregate(
        F.split(left, ""),
        F.lit(""),
        lambda stack, c: F.when(
            ((c == ")") & F.endswith(stack, F.lit("("))) | ((c == "}") & F.endswith(stack, F.lit("{"))), F.left(stack, F.length(stack) - 1)
        ).otherwise(F.concat(stack, c)),
    )
    return F.when(~left.rlike(r"[^\n]"), False).when(left.rlike(pair), stacked.rlike(r"[^\n]")).otherwise(True)


def _unclosed(text: Column, opening: str, closing: str) -> Column:
    """Whether an opening sign lacks its closing sign in its line; text is the body, lines joined by LF.

    Pairs are removed innermost first; only nesting deeper than that is counted.
    """
    one = opening[:2] + closing[:2]
    marks = F.regexp_replace(text, rf"({opening}|{closing}|\n)|[^{one}\n]++|[{one}]", "$1")
    left = _drop_pairs(marks, opening + closing, 12)
    sign = opening.replace("\\", "")
    # what is nested deeper is counted, line by line; a closing sign without an opening one counts for nothing
    depth = lambda line: F.aggregate(
        F.regexp_extract_all(line, F.lit(f"{opening}|{closing}"), F.lit(0)),
        F.lit(0),
        lambda n, x: F.when(x == sign, n + 1).otherwise(F.greatest(n - 1, F.lit(0))),
    )
    return F.when(left.rlike(opening + closing), F.exists(F.split(left, "\n"), lambda line: depth(line) > 0)).otherwise(left.contains(sign))


def dsl_records(cards: DataFrame, text: str = "card", keys: tuple[str, ...] = ("card_id", "dict", "card_no")) -> DataFrame:
    """All cards with their headword lines, body lines and error arrays."""
    df = cards.select(*keys, F.col(text).alias("_text"))
    df = df.withColumn("_lines", F.filter(F.split(F.col("_text"), r"\r?\n"), lambda x: x.rlike(r"\S")))
    body = lambda x: x.rlike(r"^[\t ]")
    df = df.withColumns({"headwords": F.filter("_lines", lambda x: ~body(x)), "body": F.filter("_lines", body)})
    plain = lambda name: F.regexp_replace(F.array_join(name, "\n"), r"\\[^\n]", "x")
    df = df.withColumns(
        {
            "_order": F.array_join(F.transform("_lines", lambda x: F.when(body(x), "b").otherwise("h")), ""),
            "_head": plain("headwords"),
            "_body": plain("body"),
        }
    )
    errors = _reasons(
        ("null_text", F.col("_text").isNull()),
        ("no_headword", F.size("headwords") == 0),
        ("no_body", F.size("body") == 0),
        ("headword_after_body", F.col("_order").contains("bh")),
        ("control_character", F.col("_text").rlike(DSL_CONTROL)),
        ("headword_brackets", _unnested(F.regexp_replace("_head", r"[^(){}\n]", ""))),
        ("tag_brackets", ~F.regexp_replace("_body", r"[^\[\]\n]", "").rlike(r"^(?:\[\]|\n)*+\z")),
        ("open_comment", _unclosed(F.col("_body"), r"\{\{", r"\}\}")),
        ("open_link", _unclosed(F.col("_body"), "<<", ">>")),
        ("bad_indent_tag", F.col("_body").rlike(r"\[m(?![0-9]?\])")),
        ("blank_link", F.col("_body").rlike(r"\[ref\][^\S\n]*\[/ref\]|<<[^\S\n]*>>")),
    )
    return df.select(*keys, "headwords", "body", errors.alias("errors"), F.col("_text").alias("text"))


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, faulty): the rows with an empty error array, without it, and the others with their reasons."""
    clean = F.size("errors") == 0
    return records.filter(clean).drop("errors", "text"), records.filter(~clean)


def faulty_records(csv_lines: DataFrame, dsl_cards: DataFrame) -> DataFrame:
    """Faulty rows of both sources: format, rec_id, dict, reasons, text."""
    one = lambda df, kind, key: split_valid(df)[1].select(F.lit(kind).alias("format"), F.col(key).alias("rec_id"), "dict", "errors", "text")
    return one(csv_records(csv_lines), "Csv", "line_id").unionByName(one(dsl_records(dsl_cards), "Dsl", "card_id"))


def valid_records(csv_lines: DataFrame, dsl_cards: DataFrame) -> DataFrame:
    """Valid rows of both sources, parsed: format, rec_id, dict, headwords, body."""
    csv = split_valid(csv_records(csv_lines))[0].select(
        F.lit("Csv").alias("format"), F.col("line_id").alias("rec_id"), "dict", F.array("headword").alias("headwords"), F.array("body").alias("body")
    )
    dsl = split_valid(dsl_records(dsl_cards))[0].select(F.lit("Dsl").alias("format"), F.col("card_id").alias("rec_id"), "dict", "headwords", "body")
    return csv.unionByName(dsl)
