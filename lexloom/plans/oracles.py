"""SQL that gives the same rows as queries of the catalogue, for an engine that reads the same tables."""

from __future__ import annotations

from lexloom.functions import keys
from lexloom.functions.language import PAIR_NAMES, TITLE_PARTS
from lexloom.plans import catalogue as c
from lexloom.plans import files

_FOLD = "lower(nfc_normalize(word))"
for _a, _b in (("ß", "ss"), ("ς", "σ"), ("µ", "μ"), ("ſ", "s"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
    _FOLD = f"replace({_FOLD}, '{_a}', '{_b}')"
_STRIP = r"regexp_replace({}, ' \([0-9]+\)$', '')"
#: Headwords with their keys.
_KEYED = rf"""
k AS (
  SELECT *, {_STRIP.format("fold_key")} AS fold_class, strip_accents({_STRIP.format("fold_key")}) AS bare_key, word = {_STRIP.format("word")} AS plain
  FROM (SELECT dict, idx, slot, word, coalesce(is_alias, false) AS is_alias, entry_id, {_FOLD} AS fold_key FROM headwords WHERE word IS NOT NULL)
)"""
# whether b has every mark of a, base by base; both have the same bare key
_ALLOWS = r"""(
  len(regexp_extract_all({a}, '[^\p{{M}}]\p{{M}}*')) <= len(regexp_extract_all({b}, '[^\p{{M}}]\p{{M}}*'))
  AND len(list_filter(list_zip(regexp_extract_all({a}, '[^\p{{M}}]\p{{M}}*'), regexp_extract_all({b}, '[^\p{{M}}]\p{{M}}*'), true),
    lambda p: NOT (list_has_all(string_split(p[2], ''), string_split(p[1], '')) OR p[1] = strip_accents(p[2])))) = 0)"""
_OPTIONAL = r"regexp_replace({h}, '[\x{{0591}}-\x{{05BD}}\x{{05BF}}\x{{05C1}}\x{{05C2}}\x{{05C4}}\x{{05C5}}\x{{05C7}}\x{{064B}}-\x{{065F}}\x{{0670}}]', '', 'g') = strip_accents({h})"


def _rows(where: str, of: str = "k") -> str:
    """CTEs ending in r: the rows of a search over the keyed headwords that match."""
    return rf"""{_KEYED},
f AS (SELECT * FROM {of} WHERE {where}),
cl AS (SELECT bare_key, fold_class, min(slot) AS class_slot, bool_and(is_alias) AS aliases FROM f GROUP BY ALL),
several AS (SELECT a.bare_key, a.fold_class AS x, b.fold_class AS y FROM cl a JOIN cl b USING (bare_key) WHERE a.fold_class <> b.fold_class AND {_ALLOWS.format(a="a.fold_class", b="b.fold_class")}),
mx AS (SELECT *, fold_class NOT IN (SELECT x FROM several s WHERE s.bare_key = cl.bare_key) AS maximal FROM cl),
ho AS (SELECT s.bare_key, s.x, min(s.y) AS host, count(*) AS n FROM several s JOIN mx h ON h.bare_key = s.bare_key AND h.fold_class = s.y AND h.maximal AND {_OPTIONAL.format(h="s.y")} GROUP BY ALL),
pl AS (
  SELECT mx.*, CASE WHEN ho.n = 1 THEN ho.host ELSE mx.fold_class END AS host, CASE WHEN maximal OR ho.n = 1 THEN aliases ELSE false END AS silent
  FROM mx LEFT JOIN (SELECT bare_key, x, max(host) AS host, sum(n) AS n FROM ho GROUP BY ALL) ho ON ho.bare_key = mx.bare_key AND ho.x = mx.fold_class
),
m AS (SELECT f.*, pl.host, pl.silent, pl.class_slot, f.fold_class = pl.host AS own FROM f JOIN pl USING (bare_key, fold_class)),
o AS (SELECT *, row_number() OVER w AS pos, lag(word) OVER w AS w1, lag(dict) OVER w AS d1 FROM m WINDOW w AS (PARTITION BY bare_key, host ORDER BY dict, NOT own, CASE WHEN own THEN 0 ELSE class_slot END, slot)),
r AS (
  SELECT bare_key, min(slot) FILTER (own) AS first_slot,
    CASE WHEN arg_min(plain, slot) FILTER (own) THEN arg_min(word, slot) FILTER (own)
         ELSE coalesce(arg_min(word, slot) FILTER (own AND plain), arg_min(word, slot) FILTER (own)) END AS word,
    string_agg(dict || '=' || word, '; ' ORDER BY pos) FILTER (pos = 1 OR word <> w1 OR dict <> d1) AS members,
    bool_and(silent) AS all_aliases, host
  FROM o GROUP BY bare_key, host
)"""


def _asked(query: str) -> str | None:
    """The condition on headwords that a query sets; None if it asks for nothing."""
    folded = keys.fold(query.strip())
    needle = keys.bare(folded)
    if not needle:
        return None
    prefix = f"starts_with(bare_key, '{needle}')"
    return prefix if needle == keys.strip_homograph(folded) else f"{prefix} AND {_ALLOWS.format(a=f"'{folded}'", b='fold_key')}"


_OUT = "bare_key, first_slot, word, members, all_aliases"
_NEEDLE = f"starts_with(bare_key, '{c.NEEDLE}')"
_REPEATED = f"starts_with(bare_key, '{c.REPEATED}')"
_MARKED = f"starts_with(bare_key, strip_accents('{c.MARKED}')) AND {_ALLOWS.format(a=chr(39) + c.MARKED + chr(39), b='fold_key')}"
_SHELF = "SELECT dict, (row_number() OVER (ORDER BY cfg_order NULLS LAST, lower(coalesce(label, '')), dict) - 1)::INT AS rank FROM dictionaries"
_SIZE = """SELECT count(*) FILTER (on_) AS dicts, coalesce(sum(n) FILTER (on_), 0)::BIGINT AS words, count(*) AS all_dicts
  FROM (SELECT coalesce(scope, true) AS on_, coalesce(n, 0) AS n FROM dictionaries LEFT JOIN (SELECT dict, count(*) AS n FROM headwords GROUP BY dict) USING (dict))"""


def _n(x: str, one: str, many: str) -> str:
    return f"format('{{:,}}', {x}) || ' ' || CASE WHEN {x} = 1 THEN '{one}' ELSE '{many}' END"


_ALL_DICTS = _n("all_dicts", "dictionary", "dictionaries")
_TITLE = "CASE " + " ".join(f"WHEN contains(lower({{t}}), '{a}') THEN '{b}'" for a, b in TITLE_PARTS) + " END"
_FIRST = r"regexp_extract({w}, '[\x{{0590}}-\x{{05FF}}\x{{FB1D}}-\x{{FB4F}}\x{{0370}}-\x{{03FF}}\x{{1F00}}-\x{{1FFF}}\x{{0400}}-\x{{04FF}}\x{{0600}}-\x{{06FF}}]')"
_SCRIPT = rf"CASE WHEN regexp_matches({_FIRST}, '[\x{{{{0590}}}}-\x{{{{05FF}}}}\x{{{{FB1D}}}}-\x{{{{FB4F}}}}]') THEN 'HEB' WHEN regexp_matches({_FIRST}, '[\x{{{{0370}}}}-\x{{{{03FF}}}}\x{{{{1F00}}}}-\x{{{{1FFF}}}}]') THEN 'GRC' WHEN regexp_matches({_FIRST}, '[\x{{{{0400}}}}-\x{{{{04FF}}}}]') THEN 'CYR' WHEN regexp_matches({_FIRST}, '[\x{{{{0600}}}}-\x{{{{06FF}}}}]') THEN 'ARA' END".replace("{{{{", "{{").replace("}}}}", "}}")
_TAG = f"coalesce({_SCRIPT.format(w='word')}, {_TITLE.format(t='name')})"
_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in PAIR_NAMES.items()) + "}"
_PAIRS = rf"""
SELECT dict, p[1] AS source, p[2] AS target FROM (
  SELECT dict, flatten(list_transform(string_split_regex(lower(name), '[^\p{{L}}\p{{M}}_-]'), lambda ch: list_filter(
    list_transform(range(1, len(string_split_regex(ch, '[-_]'))), lambda i: [{_MAP}[string_split_regex(ch, '[-_]')[i]], {_MAP}[string_split_regex(ch, '[-_]')[i + 1]]]),
    lambda q: q[1] IS NOT NULL AND q[2] IS NOT NULL)))[1] AS p FROM dictionaries)"""
_FILES = ", ".join(f"('{f}')" for f in c.FILES)
_PATHS = f"(SELECT path FROM (VALUES {_FILES}) v(path) UNION ALL SELECT path FROM dictionaries)"
_CLASS = """CASE WHEN ends_with(lower(path), '.ifo') THEN 'StarDict' WHEN ends_with(lower(path), '.bgl') THEN 'Bgl' WHEN ends_with(lower(path), '.dsl') OR ends_with(lower(path), '.dsl.dz') THEN 'Dsl'
  WHEN ends_with(lower(path), '.csv') THEN 'Csv' WHEN ends_with(lower(path), '.index') THEN 'Dictd' END"""
_LABEL = r"CASE WHEN contains(path, '/') THEN string_split(path, '/')[-2] ELSE regexp_replace(path, '\.[^.]*$', '') END"
_OUTSIDE = " AND ".join(f"path <> '{e}' AND NOT starts_with(path, '{e}/')" for e in c.EXCLUDED)
_ENTRIES = "SELECT dict, word, def_id, unnest(range(1, len(entries) + 1)) AS part, unnest(entries) AS entry FROM definitions"
_BETTER = r"""CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN CASE WHEN trim(coalesce(name, '')) NOT IN ('', label) THEN trim(name)
  ELSE label || ' (' || regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '') || ')' END ELSE label END"""


_F = r'("(?:[^"]|"")*"|[^"\t][^\t]*|)'
_N = r'("[0-9]{1,18}"|[0-9]{1,18})'
_RECORD = rf"{_F}\t{_N}\t{_F}\t{_F}\t{_F}\t{_N}"


def _left_open(text: str, one: str, two: str, sign: str) -> str:
    """Whether of two signs one is left open: opening ones count up, closing ones down to nothing, at any depth."""
    return (
        f"list_reduce(list_prepend('0', regexp_extract_all({text}, '{one}|{two}')),"
        f" lambda a, t: CASE WHEN t = '{sign}' THEN (a::INT + 1)::VARCHAR ELSE greatest(a::INT - 1, 0)::VARCHAR END) <> '0'"
    )


def _misnested(text: str) -> str:
    """Whether brackets aren't closed and properly nested: each closing one takes its opening one off the end of what is left."""
    return (
        f"list_reduce(list_prepend('', regexp_extract_all({text}, '[(){{}}]')),"
        " lambda a, t: CASE WHEN (t = ')' AND ends_with(a, '(')) OR (t = '}' AND ends_with(a, '{')) THEN a[:-2] ELSE a || t END) <> ''"
    )


def _faulty() -> str:
    line = r"regexp_replace(line, '\r$', '')"
    unquoted = f"CASE WHEN starts_with(h, '\"') THEN replace(h[2:-2], '\"\"', '\"') ELSE h END"
    csv = rf"""SELECT 'Csv' AS format, line_id AS rec_id FROM (SELECT line_id, line, regexp_extract({line}, '{_RECORD}', 3) AS h FROM csv_lines)
  WHERE line IS NULL OR NOT regexp_full_match({line}, '{_RECORD}') OR regexp_matches({line}, '[\x00-\x08\x0a-\x1f]') OR regexp_full_match({unquoted}, '\s*')"""
    dsl = rf"""SELECT 'Dsl', card_id FROM (
    SELECT card_id, card, list_filter(string_split_regex(regexp_replace(card, '\\[^\r\n]', 'x', 'g'), '\r?\n'), lambda x: regexp_matches(x, '\S')) AS l FROM dsl_cards)
  WHERE card IS NULL OR regexp_matches(card, '[\x00-\x08\x0b\x0c\x0e-\x1f]') OR regexp_matches(replace(card, chr(13) || chr(10), ''), '\r')
    OR NOT regexp_full_match(array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '^[\t ]') THEN 'b' ELSE 'h' END), ''), 'h+b+')
    OR len(list_filter(l, lambda x: NOT regexp_matches(x, '^[\t ]') AND {_misnested("x")})) > 0
    OR len(list_filter(l, lambda x: regexp_matches(x, '^[\t ]') AND (NOT regexp_full_match(regexp_replace(x, '[^\[\]]', '', 'g'), '(\[\])*')
      OR {_left_open("x", "[{][{]", "[}][}]", "{{")} OR {_left_open("x", "<<", ">>", "<<")} OR regexp_matches(regexp_replace(x, '\[m[0-9]?\]', '', 'g'), '\[m')
      OR regexp_matches(x, '\[ref\]\s*\[/ref\]|<<\s*>>')))) > 0"""
    return f"{csv} UNION ALL {dsl}"


def _valid() -> str:
    line = r"regexp_replace(line, '\r$', '')"
    field = lambda n: f"regexp_extract({line}, '{_RECORD}', {n})"
    unquoted = lambda x: f"CASE WHEN starts_with({x}, '\"') THEN replace(({x})[2:-2], '\"\"', '\"') ELSE {x} END"
    return rf"""WITH f AS ({_faulty()}),
 v AS (SELECT line_id, {unquoted(field(3))} AS h, {unquoted(field(5))} AS b FROM csv_lines WHERE line_id NOT IN (SELECT rec_id FROM f WHERE format = 'Csv')),
 c AS (SELECT card_id, list_filter(string_split_regex(card, '\r?\n'), lambda x: regexp_matches(x, '\S')) AS l FROM dsl_cards WHERE card_id NOT IN (SELECT rec_id FROM f WHERE format = 'Dsl')),
 p AS (SELECT card_id, list_filter(l, lambda x: NOT regexp_matches(x, '^[\t ]')) AS h, list_filter(l, lambda x: regexp_matches(x, '^[\t ]')) AS b FROM c)
SELECT 'Csv' AS format, line_id AS rec_id, 'headword' AS part, 0 AS no, regexp_replace(h, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS text FROM v
UNION ALL SELECT 'Csv', line_id, 'body', 0, b FROM v
UNION ALL SELECT 'Dsl', card_id, 'headword', unnest(range(0, len(h)))::INT, unnest(h) FROM p
UNION ALL SELECT 'Dsl', card_id, 'body', unnest(range(0, len(b)))::INT, unnest(b) FROM p"""


_SPACE = r"[\s\x85\xa0\x1c-\x1f\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _filings() -> str:
    """The keys of valid cards whose headword lines have one optional group at most, as those of the test tables do: braces go, escapes stand for themselves."""
    line = r"regexp_replace(regexp_replace(x, '\{(\\.|[^{}])*\}', '', 'g'), '\\([(])', chr(2), 'g')"
    line = rf"regexp_replace(regexp_replace({line}, '\\([)])', chr(3), 'g'), '\\(.)', '\1', 'g')"
    word = lambda x: f"trim(regexp_replace(replace(replace({x}, chr(2), '('), chr(3), ')'), '{_SPACE}', ' ', 'g'))"
    bare = r"regexp_replace({0}, '^[IVXLCDM]+[.)]?\s+((?:[^\p{{L}}]*)[\p{{Greek}}\p{{Hebrew}}].*)$', '\1')"
    group = lambda n: f"regexp_extract(l, '^(.*?)[(]([^()]*)[)](.*)$', {n})"
    return rf"""WITH f AS ({_faulty()}),
 c AS (SELECT card_id, dict, unnest(list_filter(string_split_regex(card, '\r?\n'), lambda x: regexp_matches(x, '^[^\t ]'))) AS x FROM dsl_cards WHERE card_id NOT IN (SELECT rec_id FROM f WHERE format = 'Dsl')),
 l AS (SELECT card_id, dict, row_number() OVER () AS n, {line} AS l FROM c WHERE regexp_matches(x, '\S')),
 g AS (SELECT *, regexp_matches(l, '[(][^()]*[)]') AS has, {group(1)} AS pre, {group(2)} AS opt, {group(3)} AS post FROM l),
 v AS (SELECT card_id, dict, n, 0 AS k, CASE WHEN has THEN {word("pre || post")} ELSE {word("l")} END AS word, false AS marked FROM g
   UNION ALL SELECT card_id, dict, n, 1, {word("pre || opt || post")}, trim(pre) = '' FROM g WHERE has),
 d AS (SELECT card_id, dict, n, 2 AS k, {bare.format(f"CASE WHEN NOT has THEN {word('l')} WHEN trim(pre) = '' THEN {word('post')} ELSE {word('pre || opt || post')} END")} AS word FROM g),
 a AS (SELECT card_id, dict, n, k, word, NOT marked AND {bare.format("word")} = word AS listed FROM v UNION ALL SELECT card_id, dict, n, k, word, true FROM d),
 u AS (SELECT card_id, dict, word, bool_or(listed) AS listed, min((n, k)) AS first FROM a WHERE word <> '' GROUP BY ALL)
SELECT card_id, dict, word, listed OR (NOT bool_or(listed) OVER (PARTITION BY card_id) AND row_number() OVER (PARTITION BY card_id ORDER BY first) = 1) AS listed FROM u"""


# Elements that stand on lines of their own, and the character references of the test tables; "&amp;" comes last.
_BLOCKS = "p|div|li|tr|ul|ol|dl|dt|dd|table|section|article|blockquote|hr|center|h1|h2|h3|h4|h5|h6|br"
_CHARACTERS = {"&quot;": '"', "&nbsp;": " ", "&eacute;": "é", "&lt;": "<", "&gt;": ">", "&#8217;": "’", "&#xFC;": "ü", "&amp;": "&"}


def _html_text() -> str:
    """The text of entries, for markup whose tags are whole: comments go, blocks, bars and pilcrows break lines, other tags vanish, then references become characters and white space one space."""
    attributes = r"""(\s([^<>"'']|"[^"]*"|''[^'']*'')*)?"""
    x = r"regexp_replace(entry, '(?s)<!--.*?-->|(?i)<(style|script)\b.*?</(style|script)\s*>', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)</?({_BLOCKS}){attributes}/?>|\|\|', chr(1), 'g')"
    x = rf"regexp_replace({x}, '</?[A-Za-z][^\s<>/]*{attributes}/?>', '', 'g')"
    for name, sign in _CHARACTERS.items():
        x = f"replace({x}, '{name}', '{sign}')"
    x = f"replace({x}, '¶', chr(1) || '¶')"
    x = f"regexp_replace({x}, '{_SPACE}', ' ', 'g')"
    x = rf"trim(regexp_replace({x}, '( ?\x01 ?)+', chr(1), 'g'), ' ' || chr(1))"
    return f"SELECT def_id, part::INT AS part, replace({x}, chr(1), chr(10)) AS text FROM (SELECT def_id, unnest(range(0, len(entries))) AS part, unnest(entries) AS entry FROM definitions)"


def oracle_sql() -> dict[str, str]:
    limited = f"WITH {_rows(_NEEDLE)}, n AS (SELECT bare_key, count(*) AS n FROM r GROUP BY bare_key), b AS (SELECT bare_key, coalesce(sum(n) OVER (ORDER BY bare_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)"
    return {
        "p1_found": _faulty(),
        "p1_valid_lines": _valid(),
        **files.sql(_faulty()),
        "kw_total": "SELECT count(*) AS headwords FROM headwords",
        "kw_per_dict": "SELECT dict, count(*) AS headwords FROM headwords GROUP BY dict",
        "scope_size": f"SELECT *, all_dicts > 0 AND dicts = 0 AS nothing_selected FROM ({_SIZE})",
        "library_size_line": f"SELECT {_n('words', 'word', 'words')} || ' · ' || CASE WHEN dicts < all_dicts THEN dicts || ' of ' || {_ALL_DICTS} ELSE {_n('dicts', 'dictionary', 'dictionaries')} END AS line FROM ({_SIZE})",
        "status_line": f"SELECT '1,234+ results' || CASE WHEN dicts < all_dicts THEN ' · ' || dicts || ' of ' || {_ALL_DICTS} ELSE '' END || ' · forms folded' AS line FROM ({_SIZE})",
        "slot_bases": "SELECT dict, headwords, coalesce(sum(headwords) OVER (ORDER BY dict ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM (SELECT dict, count(*) AS headwords FROM headwords GROUP BY dict)",
        "merged_order": f"WITH {_KEYED} SELECT bare_key, slot, dict, idx FROM k",
        "keys": f"WITH {_KEYED} SELECT slot, fold_key, bare_key, fold_class, plain FROM k",
        "homograph_strip": f"SELECT slot, {_STRIP.format('word')} AS stripped FROM headwords",
        "prefix_matches": f"WITH {_KEYED} SELECT bare_key, count(*) AS n, min(slot) AS first_slot FROM k WHERE {_NEEDLE} GROUP BY bare_key",
        "prefix_search": f"WITH {_rows(_NEEDLE)} SELECT {_OUT} FROM r",
        "prefix_search_all": f"WITH {_rows('true')} SELECT {_OUT} FROM r",
        "prefix_search_scoped": f"WITH {_rows(_NEEDLE + ' AND dict NOT IN (SELECT dict FROM dictionaries WHERE NOT scope)')} SELECT {_OUT} FROM r",
        "prefix_search_marked": f"WITH {_rows(_MARKED)} SELECT {_OUT} FROM r",
        "prefix_search_pointed": f"WITH {_rows(f'starts_with(bare_key, {chr(39)}{c.POINTED}{chr(39)})')} SELECT {_OUT} FROM r",
        "prefix_search_batch": " UNION ALL ".join(f"SELECT {i}::INT AS query_id, {_OUT} FROM (WITH {_rows(w)} SELECT {_OUT} FROM r)" for i, q in c.QUERIES if (w := _asked(q))),
        "fold_forms": f"""WITH {_rows(_REPEATED)}, ids AS (SELECT DISTINCT dict, word, entry_id FROM k WHERE entry_id IS NOT NULL),
 sh AS (SELECT DISTINCT r.bare_key, r.first_slot, i.dict, i.entry_id FROM r JOIN o ON o.bare_key = r.bare_key AND o.host = r.host JOIN ids i ON i.dict = o.dict AND i.word = o.word),
 se AS (SELECT *, min((bare_key, first_slot)) OVER (PARTITION BY dict, entry_id) AS first FROM sh),
 dr AS (SELECT bare_key, first_slot FROM se GROUP BY ALL HAVING bool_and(first < (bare_key, first_slot)))
 SELECT {_OUT} FROM r WHERE NOT (all_aliases AND (bare_key, first_slot) IN (SELECT (bare_key, first_slot) FROM dr))""",
        "key_aligned_limit": f"{limited} SELECT {_OUT} FROM r JOIN b USING (bare_key) WHERE before < {c.LIMIT}",
        "page_rows": f"{limited}, w AS (SELECT {_OUT} FROM r JOIN b USING (bare_key) WHERE before < {c.LIMIT + 1}) SELECT *, (SELECT count(*) > {c.LIMIT} FROM w) AS more FROM (SELECT * FROM w ORDER BY bare_key, first_slot LIMIT {c.LIMIT})",
        "spelling_classes": f"WITH {_KEYED} SELECT bare_key, fold_class, count(*) AS n, bool_and(is_alias) AS all_aliases FROM k GROUP BY bare_key, fold_class",
        "resolve_word": f"WITH {_rows(f'''starts_with(bare_key, '{c.WORD}')''')} SELECT {_OUT} FROM r WHERE bare_key = '{c.WORD}' ORDER BY word <> '{c.WORD}', first_slot LIMIT 1",
        "exact_lookup": f"SELECT dict, word, count(*) AS entries, sum(length(entry))::BIGINT AS chars FROM (SELECT DISTINCT dict, word FROM headwords) JOIN ({_ENTRIES}) USING (dict, word) WHERE entry <> '' GROUP BY dict, word",
        "definitions_ranked": f"""WITH {_rows(_NEEDLE)}, e AS ({_ENTRIES}), rk AS ({_SHELF}),
 g AS (SELECT r.bare_key, r.first_slot, o.pos, e.dict, e.def_id, e.part, e.entry FROM r JOIN o ON o.bare_key = r.bare_key AND o.host = r.host JOIN e ON e.dict = o.dict AND e.word = o.word
   WHERE e.entry <> '' AND o.dict NOT IN (SELECT dict FROM dictionaries WHERE NOT scope)),
 q AS (SELECT *, row_number() OVER (PARTITION BY bare_key, first_slot, dict, entry ORDER BY pos, def_id, part) AS k, min(pos) OVER (PARTITION BY bare_key, first_slot, dict) AS p FROM g)
 SELECT bare_key, first_slot, rank, q.dict, d.label, d.derived, string_agg(entry, '␞' ORDER BY pos, def_id, part) AS entries FROM q JOIN rk USING (dict) JOIN dictionaries d USING (dict) WHERE k = 1 OR pos = p GROUP BY ALL""",
        "definitions_ranked_all": f"""WITH {_rows('true')}, e AS ({_ENTRIES}),
 g AS (SELECT r.bare_key, r.first_slot, o.pos, e.dict, e.def_id, e.part, e.entry FROM r JOIN o ON o.bare_key = r.bare_key AND o.host = r.host JOIN e ON e.dict = o.dict AND e.word = o.word
   WHERE e.entry <> '' AND o.dict NOT IN (SELECT dict FROM dictionaries WHERE NOT scope)),
 q AS (SELECT *, row_number() OVER (PARTITION BY bare_key, first_slot, dict, entry ORDER BY pos, def_id, part) AS k, min(pos) OVER (PARTITION BY bare_key, first_slot, dict) AS p FROM g)
 SELECT bare_key, first_slot, count(DISTINCT dict) AS sections, count(*)::BIGINT AS entries, sum(length(entry))::BIGINT AS chars FROM q WHERE k = 1 OR pos = p GROUP BY ALL""",
        "row_language_tags_all": f"""WITH {_rows('true')}, t AS (SELECT o.bare_key, o.host, {_TAG} AS tag, min(pos) AS pos FROM o JOIN dictionaries USING (dict) GROUP BY ALL)
 SELECT r.bare_key, r.first_slot, coalesce(string_agg(tag, ' · ' ORDER BY pos) FILTER (tag IS NOT NULL), '') AS tags FROM r LEFT JOIN t ON t.bare_key = r.bare_key AND t.host = r.host GROUP BY r.bare_key, r.first_slot""",
        "fold_forms_all": f"""WITH {_rows('true')}, ids AS (SELECT DISTINCT dict, word, entry_id FROM k WHERE entry_id IS NOT NULL),
 sh AS (SELECT DISTINCT r.bare_key, r.first_slot, i.dict, i.entry_id FROM r JOIN o ON o.bare_key = r.bare_key AND o.host = r.host JOIN ids i ON i.dict = o.dict AND i.word = o.word),
 se AS (SELECT *, min((bare_key, first_slot)) OVER (PARTITION BY dict, entry_id) AS first FROM sh),
 dr AS (SELECT bare_key, first_slot FROM se GROUP BY ALL HAVING bool_and(first < (bare_key, first_slot)))
 SELECT {_OUT} FROM r WHERE NOT (all_aliases AND (bare_key, first_slot) IN (SELECT (bare_key, first_slot) FROM dr))""",
        "index_figures": "SELECT count(*) AS headwords, count(DISTINCT dict) AS dictionaries, true AS stored, true AS opened FROM headwords WHERE word IS NOT NULL",
        "answer_define": f"""WITH {_rows(f"bare_key = '{c.DEFINED}' AND dict NOT IN (SELECT dict FROM dictionaries WHERE NOT scope)")}, e AS ({_ENTRIES}), rk AS ({_SHELF}),
 one AS (SELECT * FROM r ORDER BY word <> '{c.DEFINED}', first_slot LIMIT 1),
 g AS (SELECT one.word, o.pos, e.dict, e.def_id, e.part, e.entry FROM one JOIN o ON o.bare_key = one.bare_key AND o.host = one.host JOIN e ON e.dict = o.dict AND e.word = o.word WHERE e.entry <> ''),
 q AS (SELECT *, row_number() OVER (PARTITION BY dict, entry ORDER BY pos, def_id, part) AS k, min(pos) OVER (PARTITION BY dict) AS p FROM g)
 SELECT q.word, rank, q.dict, d.label, string_agg(entry, '␞' ORDER BY pos, def_id, part) AS entries FROM q JOIN rk USING (dict) JOIN dictionaries d USING (dict) WHERE k = 1 OR pos = p GROUP BY ALL""",
        "answer_search": f"""WITH {_rows(_NEEDLE + ' AND dict NOT IN (SELECT dict FROM dictionaries WHERE NOT scope)')}, n AS (SELECT bare_key, count(*) AS n FROM r GROUP BY bare_key),
 b AS (SELECT bare_key, coalesce(sum(n) OVER (ORDER BY bare_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
 w AS (SELECT r.* FROM r JOIN b USING (bare_key) WHERE before < {c.LIMIT + 1}), s AS (SELECT * FROM w ORDER BY bare_key, first_slot LIMIT {c.LIMIT}),
 j AS (SELECT s.bare_key, s.first_slot, s.word, count(DISTINCT o.dict) AS dictionaries, list({{'dictionary': coalesce(d.label, ''), 'spelling': o.word}} ORDER BY pos) FILTER (pos = 1 OR o.word <> w1 OR o.dict <> d1) AS members
   FROM s JOIN o ON o.bare_key = s.bare_key AND o.host = s.host LEFT JOIN dictionaries d ON d.dict = o.dict GROUP BY s.bare_key, s.first_slot, s.word)
 SELECT to_json({{'query': '{c.NEEDLE}', 'rows': list({{'word': word, 'dictionaries': dictionaries, 'members': members}} ORDER BY bare_key, first_slot), 'truncated': (SELECT count(*) > {c.LIMIT} FROM w)}})::VARCHAR AS answer FROM j""",
        "dsl_filings": _filings(),
        "html_text": _html_text(),
        "answer_scope": f"""WITH s AS (SELECT rank, dict, label, coalesce(n, 0) AS headwords FROM dictionaries JOIN ({_SHELF}) USING (dict) LEFT JOIN (SELECT dict, count(*) AS n FROM headwords WHERE word IS NOT NULL GROUP BY dict) USING (dict))
 SELECT to_json({{'dictionaries': list({{'label': s.label, 'headwords': s.headwords, 'path': d.path}} ORDER BY s.rank)}})::VARCHAR AS answer FROM s JOIN dictionaries d USING (dict)""",
        "reading_order": _SHELF,
        "order_repair": "SELECT dict, (row_number() OVER (ORDER BY rest, pos) - 1)::INT AS rank FROM (SELECT dict, coalesce(min(pos), dict) AS pos, min(pos) IS NULL AS rest FROM dictionaries LEFT JOIN (VALUES (0, 7), (1, 3), (2, 7), (3, 999), (4, 0)) v(pos, dict) USING (dict) GROUP BY dict)",
        "scope_default": "SELECT dict, coalesce(scope, true) AS scope FROM dictionaries",
        "shelf": f"SELECT rank, dict, label, short, format, coalesce(scope, true) AS scope, coalesce(n, 0) AS headwords FROM dictionaries JOIN ({_SHELF}) USING (dict) LEFT JOIN (SELECT dict, count(*) AS n FROM headwords GROUP BY dict) USING (dict)",
        "label_collisions": "SELECT label, count(*) AS n FROM dictionaries WHERE label IS NOT NULL GROUP BY label HAVING count(*) > 1",
        "label_disambiguated": f"SELECT dict, {_BETTER} AS label FROM (SELECT dict, path, name, {_BETTER} AS label FROM dictionaries)",
        "language_tag": f"SELECT slot, {_TAG} AS tag FROM headwords JOIN dictionaries USING (dict)",
        "language_pair": _PAIRS,
        "language_group_order": f"""WITH g AS (SELECT d.dict, coalesce({_TITLE.format(t='language')}, p.source, {_TITLE.format(t='name')}, 'OTHER') AS language_group, rank FROM dictionaries d JOIN ({_PAIRS}) p USING (dict) JOIN ({_SHELF}) USING (dict))
 SELECT dict, language_group, (row_number() OVER (ORDER BY language_group = 'OTHER', language_group, rank) - 1)::INT AS position FROM g""",
        "row_language_tags": f"""WITH {_rows(_NEEDLE)}, t AS (SELECT o.bare_key, o.host, {_TAG} AS tag, min(pos) AS pos FROM o JOIN dictionaries USING (dict) GROUP BY ALL)
 SELECT r.bare_key, r.first_slot, coalesce(string_agg(tag, ' · ' ORDER BY pos) FILTER (tag IS NOT NULL), '') AS tags FROM r LEFT JOIN t ON t.bare_key = r.bare_key AND t.host = r.host GROUP BY r.bare_key, r.first_slot""",
        "path_classify": f"SELECT path, {_CLASS} AS format, {_LABEL} AS label FROM {_PATHS}",
        "discovered": f"""WITH f AS (SELECT DISTINCT path, {_CLASS} AS format, {_LABEL} AS derived FROM {_PATHS} WHERE {_OUTSIDE})
 SELECT (row_number() OVER (ORDER BY lower(derived), path) - 1)::INT AS dict, path, format, derived, derived AS label, true AS scope FROM f
 WHERE format <> 'Bgl' AND NOT (ends_with(lower(path), '.dsl.dz') AND left(path, length(path) - 3) IN (SELECT path FROM f))""",
        "b64_offsets": "SELECT c_custkey, CASE WHEN regexp_full_match(c_mktsegment, '[A-Za-z0-9+/]*') AND length(c_mktsegment) < 11 THEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_mktsegment, ''), lambda x: (instr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/', x) - 1)::BIGINT)), lambda a, x: a * 64 + x) END AS value FROM customer",
        "tsv_first_wins": r"SELECT dict, word, arg_min(body, line_no) AS body FROM (SELECT dict, line_no, trim(f[3]) AS word, f[5] AS body FROM (SELECT dict, line_no, string_split(regexp_replace(line, '\r$', ''), chr(9)) AS f FROM csv_lines)) WHERE word <> '' AND body IS NOT NULL GROUP BY dict, word",
        "link_targets": r"SELECT run_id, CASE WHEN t <> '' AND NOT contains(t, '://') AND NOT starts_with(t, '#') AND NOT regexp_matches(t, '^[^\s:]*:') THEN t END AS target FROM (SELECT run_id, trim(regexp_replace(href, '^bword:(//)?', '')) AS t FROM runs WHERE href IS NOT NULL)",
        "sense_lines": r"""WITH l AS (SELECT def_id, unnest(range(0, len(x))) AS line_no, unnest(x) AS line FROM (SELECT def_id, string_split(entries[1], chr(10)) AS x FROM definitions WHERE entries[1] IS NOT NULL)),
 s AS (SELECT *, regexp_matches(line, '^\s*(?:¶|- |[0-9IVXivx]+[.)])') AS starts FROM l), n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY def_id ORDER BY line_no) AS sense FROM s)
 SELECT def_id, line_no::INT AS line_no, line, sense::INT AS sense, CASE WHEN starts THEN 'sense' WHEN sense > 0 AND trim(line) <> '' THEN 'within' ELSE 'body' END AS kind FROM n""",
        "sense_lines_all": r"""WITH e AS (SELECT def_id, unnest(range(0, len(entries))) AS part, unnest(entries) AS entry FROM definitions),
 l AS (SELECT def_id, part, unnest(range(0, len(x))) AS line_no, unnest(x) AS line FROM (SELECT def_id, part, string_split(entry, chr(10)) AS x FROM e WHERE entry IS NOT NULL)),
 s AS (SELECT *, regexp_matches(line, '^\s*(?:¶|- |[0-9IVXivx]+[.)])') AS starts FROM l), n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY def_id, part ORDER BY line_no) AS sense FROM s)
 SELECT def_id, part::INT AS part, line_no::INT AS line_no, line, sense::INT AS sense, CASE WHEN starts THEN 'sense' WHEN sense > 0 AND trim(line) <> '' THEN 'within' ELSE 'body' END AS kind FROM n""",
        "fuzzy_keys": f"WITH {_KEYED} SELECT slot, bare_key, levenshtein(bare_key, '{c.NEAR}')::INT AS edits FROM k WHERE levenshtein(bare_key, '{c.NEAR}') <= 2",
    }
