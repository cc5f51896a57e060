"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import layout_duplicates, leakage, linkage, lookalikes, markup_residue, mixing, mojibake, pii
from lexloom.session import table


def _fields(spark: SparkSession, d: str) -> DataFrame:
    return markup_residue.fields(table(spark, d, "definitions"), table(spark, d, "runs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return markup_residue.has_markup(_fields(spark, d), "value").filter("has_markup").select("field", "row_key").distinct()


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup_residue.cleaned(_fields(spark, d), "value").select("field", "row_key", "part", "clean_text")


def _odd_spellings(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.cases(lookalikes.spellings(*(table(spark, d, t) for t in ("headwords", "dictionaries", "home_rows", "guest_rows"))))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _odd_spellings(spark, d).select("field", "row_key").distinct()


def p3_rewritten(spark: SparkSession, d: str) -> DataFrame:
    return _odd_spellings(spark, d).select("field", "row_key", "value", "usual")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return layout_duplicates.duplicate_pairs(table(spark, d, "headwords")).toDF("slot_a", "slot_b")


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return layout_duplicates.collapse(table(spark, d, "headwords"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(*(table(spark, d, t) for t in ("home_rows", "guest_rows", "dictionaries")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("row_a", "row_b").distinct()


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.found(table(spark, d, "definitions"), table(spark, d, "dsl_cards")).select("field", "row_key").distinct()


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.found(table(spark, d, "definitions"), table(spark, d, "dsl_cards"), fill=True)


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, into how many documents, and their longest passage."""
    return _leaked(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("longest_run").alias("longest_run"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Cards and accounts are redacted as well, but no kind of this query."""
    return pii.spans(table(spark, d, "documents")).filter(~F.col("kind").isin("card", "iban")).select("doc_id", "kind", "start_pos")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "redacted_text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        p2_found, p2_clean, p3_found, p3_rewritten, p4_found, p4_records, p5_found, p5_links, p6_found, p6_restored,
        p7_found, p7_items, p8_mix, p8_shares, p9_found, p9_redacted,
    )
    return {f.__name__: f for f in own}


_FOLDED = "lower(word)"
for _a, _b in (("ß", "ss"), ("ς", "σ"), ("µ", "μ"), ("ſ", "s"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
    _FOLDED = f"replace({_FOLDED}, '{_a}', '{_b}')"
_CANON = rf"""
SELECT slot, dict, array_to_string(list_sort(regexp_extract_all({_FOLDED}, '[\p{{L}}\p{{M}}\p{{N}}]+')), ' ') AS canon
FROM headwords WHERE word IS NOT NULL
"""
_WORDS = r"regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '[\p{L}\p{N}]+')"
_RUNS = """
  SELECT {id}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS run
  FROM (SELECT {id}, {words} AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 12
"""
_LEAKED = f"""
WITH d AS ({_RUNS.format(id="doc_id", words=_WORDS, table="documents")}), i AS ({_RUNS.format(id="item_id", words=_WORDS, table="eval_items")})
SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (run)
"""
_PLACED = """
  SELECT {id}, unnest(range(1, len(w) - 10)) AS pos, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS run
  FROM (SELECT {id}, {words} AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 12
"""
_ITEMS = f"""
WITH d AS ({_PLACED.format(id="doc_id", words=_WORDS, table="documents")}), i AS (SELECT DISTINCT * FROM ({_RUNS.format(id="item_id", words=_WORDS, table="eval_items")})),
h AS (SELECT DISTINCT doc_id, item_id, pos FROM d JOIN i USING (run)),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS island FROM h),
r AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM g GROUP BY doc_id, item_id, island)
SELECT item_id, count(DISTINCT doc_id) AS documents, max(n)::INT AS longest_run FROM r GROUP BY item_id
"""
_ODD = r"""
SELECT DISTINCT field, row_key FROM (
  SELECT 'headword' AS field, slot AS row_key, word AS v FROM headwords JOIN dictionaries USING (dict) WHERE format = 'StarDict'
  UNION ALL SELECT 'row_word', row_id, word FROM home_rows UNION ALL SELECT 'row_word', row_id, word FROM guest_rows
  UNION ALL SELECT 'row_member', row_id, unnest(members).spelling FROM home_rows UNION ALL SELECT 'row_member', row_id, unnest(members).spelling FROM guest_rows
) WHERE regexp_matches(v, '[\p{Cf}\x{180E}]|[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[\x{FF01}-\x{FF5E}]|[\x{FB00}-\x{FB4F}]')
   OR nfc_normalize(v) <> v
   OR regexp_matches(v, '\p{Latin}')::INT + regexp_matches(v, '\p{Greek}')::INT + regexp_matches(v, '\p{Cyrillic}')::INT + regexp_matches(v, '[א-ת]')::INT > 1
"""

# What the statement names, looked for in whole texts: tags and comments, whole or cut, and character references; of
# Markdown emphasis, code, headings, quotations, lists, links; of wikis quotes, links, templates, headings, lists, tables;
# of LaTeX commands and formulas.
_HTML = r"</?[A-Za-z]|<!--|-->|=(\"[^\"<>]*\"|''[^''<>]*'')\s*/?>|&(#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z]\w+);"
_MARKDOWN = r"\*\*|~~|`|\b__|__\b|(^|[^\p{L}\p{N}*(])\*[^\s*]([^*(\n]*[^\s*(\n-])?\*($|[^\p{L}\p{N}*)])|^#+ |^> |^[*+] |^- .*\[|\]\([^()\s]*\)|^\s*\[[^\]]+\]: \S|[^\s=].*\n={3,}\s*$"
_WIKI = r"''''|\[\[|\]\]|\{\{|\}\}|^=+[^=\n]+=+\s*$|^[:;] |\{\||\|\}|^\|"
_LATEX = r"\\[A-Za-z(\[\])&%$#_{}]|\$\$|\$[^$]*[\\^_{][^$]*\$"
_MARKED = f"""
SELECT DISTINCT field, row_key FROM (
  SELECT 'definition' AS field, def_id AS row_key, unnest(entries) AS v FROM definitions
  UNION ALL SELECT 'run_text', run_id, text FROM runs UNION ALL SELECT 'run_href', run_id, href FROM runs
) WHERE regexp_matches(replace(v, chr(13), ''), '(?m)({_HTML}|{_MARKDOWN}|{_WIKI}|{_LATEX})')
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _MARKED,
        "p3_found": _ODD,
        "p4_found": f"WITH c AS ({_CANON}), g AS (SELECT *, min(slot) OVER (PARTITION BY dict, canon) AS slot_a FROM c) SELECT slot_a, slot AS slot_b FROM g WHERE slot <> slot_a",
        "p4_records": f"SELECT dict, canon, min(slot) AS slot, count(*) AS copies, count(DISTINCT word) AS layouts FROM ({_CANON}) JOIN headwords USING (slot, dict) GROUP BY dict, canon",
        "p7_found": _LEAKED,
        "p7_items": _ITEMS,
    }
