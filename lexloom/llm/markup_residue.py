"""Markup residue in text documents: which texts hold HTML, Markdown, wiki or LaTeX markup, and their clean text.

Texts are cut into flat blocks (lines). Each block is described by its word count, its link density (the share of its
characters in links and bracketed words), its counts of signs by markup family, the share of its characters in signs
that may mark nothing up, and by the word count, link density and signs of both neighbours. A decision tree trained on
the small labelled table below (at most 800 lines) classifies the blocks; it is turned into one column expression, so
that texts are judged in the JVM, without a shuffle and without Python. A text holds markup if any of its blocks does.

Signs of one meaning only (tags, character references, emphasis in pairs, commands) are told by their count. Others
depend on what stands beside them, and this is what words, links and neighbours are for: a line of dashes or equal
signs underlines a heading only if the line before it has a few words, and separates plain text else; dashes, bars and
bracketed words are lists, tables and links only if their neighbours are alike; "#" and ">" begin headings and
quotations of several words, and stand before numbers else.

Texts with markup are converted: headings become "# " lines, lists "- " and "1. " lines, code fenced blocks or
`code`, formulas $formula$; links give their text. Everything else of the markup goes, the words stay.

Defined cases: null and empty texts hold no markup and come out unchanged; unclosed and cut markup is removed where
its sign is certain; a text is judged by itself, so repeated rows give equal results.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*|\s[^<]*?\"[^\"]*\"[^<]*)?/?>"
ATTRIBUTE = r"\s[A-Za-z-]+=(?:\"[^\"]*\"|'[^']*')\s*/?>"
#: Signs of one meaning, counted in each block.
SIGNS = {
    "html": rf"{TAG}|<!--|-->|</?[A-Za-z][A-Za-z0-9]*\z|<[A-Za-z][A-Za-z0-9]*\s[A-Za-z-]+=[^<>]*\z|{ATTRIBUTE}",
    "reference": r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});",
    "emphasis": r"\*\*[^*]+\*\*|(?<![\p{L}\p{N}_])__(?:[^_]|(?<=\w)_(?=\w))+__(?![\p{L}\p{N}_])|~~[^~]+~~|`[^`]+`|(?<![\p{L}\p{N}*(])\*[^\s*][^*(]*(?<![\s-])\*(?![\p{L}\p{N}*)])",
    "fence": r"^\s*(?:```|~~~)",
    "bullet": r"^[*+]\s|^-\s.*[*_`~\[]",
    "md_link": r"!?\[[^\[\]]+\]\([^()\s]*\)|^\s*\[[^\[\]]+\]:\s\S",
    "wiki": r"''[^']+''|\[\[[^\[\]]+\]\]|\{\{[^{}]+\}\}|^=+[^=]+=+\s*$|\{\||\|\}|^\|",
    "latex": r"\\[A-Za-z]+|\\[\\()\[\]%&$#_{}]|\$[^\s$0-9](?:[^$]*[^\s$])?\$|\$[^$]*[\\^_{][^$]*\$|\$\$",
}
#: Forms of a line that mark something up or not, as their surroundings tell.
FORMS = {
    "dash": r"^-\s",
    "rule": r"^\s*(?:={3,}|-{3,})\s*$",
    "bar": r"\s\|\s",
    "heading": r"^#{1,6}\s",
    "quote": r"^>\s",
    "term": r"^[:;]\s",
}
#: What looks like markup but may mark nothing up, as a share of the characters.
WEAK = {
    "angle": r"[<>]",
    "brace": r"[{}\[\]]",
    "star": r"[*_]",
    "equals": r"[=^|~]",
    "dollar": r"[$#&\\]",
    "digit": r"\d",
    "path": r"\b[A-Za-z]:\\|\\\\\w",
}
#: No feature but word counts can be above zero in a text without any of these.
ANY_SIGN = r"[<>&*_~`#|=^\[\]{}\\$]|''|(?:\A|\n)\s{0,3}[:;+-]|\s[A-Za-z-]+=[\"']"
LINK = r"<[aA]\s[^>]*>[^<]*</[aA]>|!?\[[^\[\]]+\]\([^()]*\)|\[\[[^\[\]]*\]\]|\[[^\[\]]+\]|\\hyperref\[[^\]]*\]\{[^}]*\}|\\(?:href|ref|url)\{[^}]*\}"
OWN = ("words", "link", *SIGNS, *FORMS, *WEAK)
NEAR = ("words", "link", "marked", *FORMS)
FEATURES = [*OWN, *(f"{side}_{f}" for side in ("before", "after") for f in NEAR)]

#: The small labelled table: texts of one or more lines; before each line, M marks markup and P plain text; small
#: letters continue the text before.
LABELLED = r"""
M|<p>One <b>two</b> three four</p>
M|a word in <i>italics</i> and more
M|see <a href="bword://word">word</a>
M|<a href='x'>x</a>
M|<A HREF="bword:some">some</A>
M|<div class="c">some text here</div>
M|<li>first item of a list
M|last line of it<br/>
M|last line of it<br
M|cut off in a tag</i
M|word</i>
M|<b>word
M|<h2>heading</h2>
M|<!-- a comment -->
M|<blockquote lang=la>some words here
M|<style>.c{color:red}</style>
M|<nowiki>if a == 0 { b; }</nowiki>
M|<math>x^{2} + y</math>
M|<ref>p. 12</ref>
M|bword://word" target="_blank">
M|bword://<sup>word</sup>
M|<span class="math">\(x \leq 1\)</span>
M|<p id="s1" data-x="a>b">words here</p>
M|salt &amp; pepper in a dish
M|&lt;i&gt;word&lt;/i&gt; in a line
M|&quot;word&quot;
M|word&nbsp;
M|caf&eacute; and tea
M|a sign &#945; here
M|word&amp;
M|&amp;word
M|one **two** three four five
M|**one** two three
M|one __two three__ four
M|__one__ two
M|one *two* three four
M|*one two* three
M|one ~~two~~ three
M|one `two` three four
M|`one two` three
M|# heading words
M|### heading
M|> quoted words here
M|> one **two** three
M|* item one of the list
M|* item **two** of it
M|- item **three** of it
M|- **item** four
M|1. item **five** of it
M|```
M|```py
M|key = value
M|```
M|~~~
M|some code
M|~~~
M|see [word](bword://word)
M|cf. [word](word)
M|[word](x)
M|[word]: bword://word
M|![picture](file.png)
M|Heading words
M|=============
M|| a | b |
M|== heading ==
M|=== heading ===
M|one ''two'' three
M|''one''
M|one '''two''' three
M|'''''one''''' two
M|[[word]]
M|[[word|shown]]
M|see [[word]]
M|[[Category:words]]
M|{{l|la|word}}
M|{{term|word}} one two
M|{{gloss|one two}}
M|# item ''one'' of the list
M|: item ''two'' of it
M|: item three of it
M|; term
M|{| class="t"
M||}
M|one \textbf{two} three
M|\emph{one two} three
M|\textit{word}
M|{\em one two}
M|\item one two three
M|\begin{itemize}
M|\end{itemize}
M|\section*{heading}
M|\paragraph{heading}
M|see~\hyperref[word]{word}
M|\ref{word} \textit{word}
M|$x \rightarrow y$
M|$\mathrm{one two}$
M|$x^{2} + y$
M|$a_{1} = b$
M|$$
M|\[ x = y \]
M|p \leq 0.5
M|one \& two
M|\emph{bword://word}
M|''bword://word''
M|[[bword://word]]
M|**bword://word**
M|- one two three four
m|- five six seven
m|- eight nine ten
M|- one two
m|- three four
P|one two three
m|- four five six
m|- seven eight
P|- one two three four
P|- five six
P|one two three four five six seven eight
p|- nine ten eleven twelve
P|- one two
p|three four five six seven
P|one two
p|- three
p|four five
M|one two
m|-----
M|one two three
m|------------
p|four five six seven eight nine ten
M|one two three four five
m|========
p|six seven
M|one
m|---
P|one
p|
p|two three
P|one two
p|
p|three
P|one two three
p|
P|one
p|—
p|two
P|one two
p|...
p|three
P|one two
p|
p|
p|three four
P|one two three four five
p|
p|six
M|> one
M|# one
P|-----
P|----------
p|one two three
P|
p|-----
p|one two three four
P|======
P|
p|=========
p|one two
P|one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen
p|-----
p|one two three
P|one two three four five six seven eight nine ten eleven twelve thirteen fourteen
p|==========
P|one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
p|------
M|one | two | three
m|four | five | six
M|one | two
m|--- | ---
m|three | four
M|one two | three
m|four | five six
m|seven | eight
P|one | two
P|one two | three four | five
P|one | two
p|three four five six
P|one two three
p|four | five
M|[one]
m|[two]
m|[three]
M|[one two]
m|[three four]
M|[one]
m|[two three]
m|[four]
m|[five six]
P|[one]
P| [sic]
P|[sic]
P|[one two]
P|[one two three]
P|[x^2 + y]
P|one [two]
P|[one] two
M|[bword://word](x)
M|[bword://one](bword://one)
M|[one](bword://two) three
M|[one two](three)
P|[one]
p|two three four five six
P|one two [three] four
P|[one] two three four five
P|one two three four five
p|[six]
P|one [two] three
p|four [five] six
M|# one two three
M|## one two
M|# one
p|two three four five six
M|### one
p|two three
P|# 12
P|# 7
P|one two three
p|# 3
M|> one two three four
M|> one two
m|> three four
P|> 1
P|> 12
P|one two three four
p|> 5
M|: one two three four
M|; one
m|: two three
M|; one two
m|: three four five
P|C:\lists\old
P|see D:\index\new for it
P|E:\one
P|from C:\texts\two three
P|of $HOME and $PATH in it
P|$ONE, $TWO and $THREE
P|one two three four five six
P|a word of many words, said of a thing that one must do
P|the thing kept beside another
P|word
P|bword://word
P|word word
P|one, cf. other
P|1. one two three
P|2. four five six
P|3. seven (eight) nine
P|see word
P|one two (a < b in the older list)
P|k > h
P|f = n / N
P|x^2 + y
P|a_1 = b
P|p <= 0.5
P|x >= 3
P|a < b
P|a < b > c
P|if n == 0 { return miss; }
P|for f in forms:
P|    show(f)
P|key = fold(word)
P|row = find(key)
P|a -> alpha
P|b -> beta
P|sort -k1 list > out
P|one two [sic]
P|one two {sic}
P|one two (2*) in the list
P|(2*)
P|one two *word-, reconstructed
P|*word-, reconstructed
P|one *word (1)-, reconstructed
P|one two at $5 the pair
P|for $5 or $10 a piece
P|one two (series #3)
P|#3 in the series
P|R&D sense, 2 > 1
P| > 1
P| one two
P|AT&T and R&D
P|snake_case in the index
P|one snake_case word and other_name
P|l'un et l'autre
P|it's the dog's
P|n. pl.
P|word adj.
P|50 % of it, and/or more
P|C# or F#
P|3 * 4 = 12
P|2*3*4
P|a | b
P|~ about ten
P|(one) two three
P|“quoted” — words
P|- and so on
P|a: b; c
P|
P|one

P|two
P|[1] and [2]
P|{1, 2, 3}
P|price: $5
P|a & b
P|path/to/file
P|me@2 marks it
P|5' 3'' tall
P|x = {1, 2}
P|-5 or -6
"""


def blocks_of(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def _described(block: Column) -> Column:
    """A struct of a block's own features."""
    words = F.regexp_count(block, F.lit(r"[\p{L}\p{M}\p{N}]+"))
    link = 1 - F.length(F.regexp_replace(block, LINK, "")) / F.greatest(F.length(block), F.lit(1))
    counts = [F.regexp_count(block, F.lit(p)).cast("double").alias(k) for k, p in (SIGNS | FORMS).items()]
    shares = [(F.regexp_count(block, F.lit(p)) / F.greatest(F.length(block), F.lit(1))).alias(k) for k, p in WEAK.items()]
    return F.struct(words.cast("double").alias("words"), link.alias("link"), *counts, *shares)


def _in_context(described: Column) -> Column:
    """For each block its own features and those of its neighbours, as an array of structs."""
    marked = lambda s: functools.reduce(lambda a, b: a + b, [s[k] for k in SIGNS])

    def one(s: Column, i: Column) -> Column:
        near = {"before": F.when(i > 0, F.get(described, i - 1)), "after": F.get(described, i + 1)}
        own = [s[k].alias(k) for k in OWN]
        sides = [F.coalesce(marked(n) if f == "marked" else n[f], F.lit(0.0)).alias(f"{side}_{f}") for side, n in near.items() for f in NEAR]
        return F.struct(*own, *sides)

    return F.transform(described, one)


def _tree(x: np.ndarray, y: np.ndarray, depth: int, least: int) -> tuple:
    """A node (feature, threshold, low, high), or a leaf's share of markup: grown by Gini impurity."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return (share,)
    best = (1e-9, None, None)
    gini = lambda v: 2 * v.mean() * (1 - v.mean()) * len(v)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values[:-1], values[1:]):
            low = x[:, f] <= (a + b) / 2
            if min(low.sum(), (~low).sum()) >= least and (gain := gini(y) - gini(y[low]) - gini(y[~low])) > best[0] + 1e-12:
                best = (gain, f, (a + b) / 2)
    if best[1] is None:
        return (share,)
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], _tree(x[low], y[low], depth - 1, least), _tree(x[~low], y[~low], depth - 1, least))


def labelled_texts() -> list[tuple[str, list[int]]]:
    """The labelled table: texts with the labels of their lines. Every line is a text unless its label is in small letters; fenced code and underlined headings go with their lines."""
    out: list[tuple[str, list[int]]] = []
    pending: tuple[list[str], list[int]] | None = None
    for row in LABELLED.strip("\n").split("\n"):
        if row[:2] not in ("M|", "P|", "m|", "p|"):
            continue
        label, text = int(row[0] in "Mm"), row[2:]
        if row[0].islower():
            out[-1] = (f"{out[-1][0]}\n{text}", [*out[-1][1], label])
            continue
        if pending:
            pending[0].append(text)
            pending[1].append(label)
            if text.startswith(("```", "~~~")):
                out.append(("\n".join(pending[0]), pending[1]))
                pending = None
        elif text.startswith("```p") or text == "~~~":
            pending = ([text], [label])
        elif re.fullmatch("={3,}", text):
            out[-1] = (f"{out[-1][0]}\n{text}", [*out[-1][1], label])
        else:
            out.append((text, [label]))
    return out + _put_together(out)


def _put_together(texts: list[tuple[str, list[int]]]) -> list[tuple[str, list[int]]]:
    """Lines of the table that mean the same anywhere, plain ones by threes and marked ones between plain ones: what stands beside them is no sign of anything."""
    free = [(t, y[0]) for t, y in texts if len(y) == 1 and t and not any(re.search(p.replace(r"\z", r"\Z"), t) for p in (*FORMS.values(), SIGNS["fence"], r"^\[[^\[\]]+\]\s*$"))]
    plain = [t for t, y in free if not y]
    more = [("\n".join(plain[i : i + 3]), [0, 0, 0]) for i in range(0, len(plain) - 2, 2)]
    marked = [t for t, y in free if y]
    return more + [(f"{plain[i % len(plain)]}\n{t}\n{plain[(i * 7 + 3) % len(plain)]}", [0, 1, 0]) for i, t in enumerate(marked)]


def _always_plain(node: tuple) -> bool:
    """Whether a tree calls every block plain that has no sign in itself nor beside it."""
    if len(node) == 1:
        return node[0] < 0.5
    free = FEATURES[node[0]] in ("words", "before_words", "after_words", "digit")
    return (_always_plain(node[2]) and _always_plain(node[3])) if free else _always_plain(node[2] if node[1] >= 0 else node[3])


_trees: dict[tuple[int, int], tuple] = {}


def trained_tree(spark: SparkSession, depth: int = 24, least: int = 1) -> tuple:
    """The decision tree, from the features of the labelled table as Spark computes them; kept for the process."""
    if (depth, least) not in _trees:
        rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(labelled_texts())], "i int, text string")
        described = rows.withColumn("d", F.transform(blocks_of(F.col("text")), _described)).select("i", F.posexplode(_in_context(F.col("d"))).alias("k", "f")).select("i", "k", "f.*")
        table = described.toPandas().sort_values(["i", "k"])
        y = np.array([label for _, labels in labelled_texts() for label in labels], float)
        _trees[depth, least] = _tree(table[FEATURES].to_numpy(float), y, depth, least)
    return _trees[depth, least]


def _expression(node: tuple, features: Column) -> Column:
    if len(node) == 1:
        return F.lit(node[0] >= 0.5)
    f, threshold, low, high = node
    return F.when(features[FEATURES[f]] <= threshold, _expression(low, features)).otherwise(_expression(high, features))


def has_markup(df: DataFrame, text: str, to: str = "has_markup") -> DataFrame:
    """df with a boolean column: whether any block of the text is classified as markup."""
    tree = trained_tree(df.sparkSession)
    described = F.transform(blocks_of(F.col(text)), _described)
    # as the variable of a function the features are computed once; as a column, every use would repeat them
    judged = F.transform(F.array(described), lambda d: F.exists(_in_context(d), lambda s: _expression(tree, s)))
    verdict = F.coalesce(F.get(judged, F.lit(0)), F.lit(False))
    if _always_plain(tree):
        verdict = F.when(F.col(text).rlike(ANY_SIGN), verdict).otherwise(F.lit(False))
    return df.withColumn(to, verdict)


def fields(definitions: DataFrame, runs: DataFrame) -> DataFrame:
    """field, row_key, part, value: strings of entries, texts and link targets of runs that aren't null."""
    entries = definitions.select(F.lit("definition").alias("field"), F.col("def_id").alias("row_key"), F.posexplode("entries").alias("part", "value"))
    one = lambda name, col: runs.select(F.lit(name).alias("field"), F.col("run_id").alias("row_key"), F.lit(0).alias("part"), F.col(col).alias("value"))
    return entries.unionByName(one("run_text", "text")).unionByName(one("run_href", "href")).filter("value is not null")


# --- conversion -----------------------------------------------------------------------------------------------------

_BLOCK_TAGS = r"p|div|blockquote|section|article|table|tr|dl|dt|dd|center|pre|ul|ol"
_tag = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)?/?>")


def _inline(text: str) -> str:
    """Removes inline markup of all four families, keeping what it marks."""
    text = re.sub(r"!?\[\[(?:Category|File|Image|Kategorie|Catégorie|Categoría):[^\[\]]*\]\]", "", text)
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", text)
    for _ in range(3):
        text = re.sub(r"\{\{(?:[^{}|]*\|)*([^{}|]*)\}\}", r"\1", text)
    text = re.sub(r"'{2,5}([^'].*?)'{2,5}", r"\1", text)
    text = re.sub(r"!?\[([^\[\]]+)\]\([^()\s]*\)", r"\1", text)
    text = re.sub(r"\*\*([^*]+)\*\*|(?<!\w)__([^_]+)__(?!\w)|~~([^~]+)~~", lambda m: next(g for g in m.groups() if g is not None), text)
    text = re.sub(r"(?<![\w*(])\*([^\s*][^*(]*(?<![\s-]))\*(?![\w*)])", r"\1", text)
    text = re.sub(r"\\hyperref\[[^\]]*\]\{([^{}]*)\}|\\href\{[^{}]*\}\{([^{}]*)\}", lambda m: m[1] or m[2] or "", text)
    for _ in range(3):
        text = re.sub(r"\\(?!frac|sqrt|mathrm)[A-Za-z]+\*?\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\{\\(?:em|it|bf|sc|tt|sl|rm)\s*([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\([%&$#_{}])", r"\1", text)
    return re.sub(r"(?<=\w)~(?=\w)", " ", text)


def clean(text: str | None) -> str | None:
    """The text without markup, with headings, lists, code and formulas still recognisable."""
    if not text:
        return text
    if re.search(r"&lt;/?[A-Za-z]", text) and not _tag.search(text):
        text = html.unescape(text)
    kept: list[str] = []
    # pieces are kept behind a sign that occurs nowhere in the text, nor in what its references stand for
    own = set(text) | set(html.unescape(text)) | set(html.unescape(html.unescape(text)))
    mark = next(c for c in map(chr, (*range(0xE000, 0xF900), *range(0xF0000, 0x10FFFE))) if c not in own)

    def keep(value: str) -> str:
        kept.append(value)
        return f"{mark}{len(kept) - 1}{mark}"

    unescape = lambda s: html.unescape(_tag.sub("", s))
    fence = lambda m: "\n" + keep("```\n" + unescape(m[1]).strip("\n") + "\n```") + "\n"
    formula = lambda m: keep("$" + next(g for g in m.groups() if g is not None).strip() + "$")
    code = lambda m: keep("`" + unescape(m[1]) + "`")
    text = re.sub(r"<!--.*?-->|<(style|script)\b.*?</\1\s*>|<ref\b[^>]*>.*?</ref>", "", text, flags=re.S | re.I)
    text = re.sub(r"^```[^\n]*\n(.*?)^```[ \t]*$", fence, text, flags=re.S | re.M)
    text = re.sub(r"<pre\b[^>]*>(.*?)</pre>", fence, text, flags=re.S | re.I)
    text = re.sub(r"\\begin\{(?:verbatim|lstlisting)\}\n?(.*?)\\end\{(?:verbatim|lstlisting)\}", fence, text, flags=re.S)
    text = re.sub(r"<(?:nowiki|code|tt)\b[^>]*>(.*?)</(?:nowiki|code|tt)>", lambda m: fence(m) if "\n" in m[1] else code(m), text, flags=re.S | re.I)
    text = re.sub(r"\\(?:verb|texttt)\{([^{}]*)\}", code, text)
    text = re.sub(r"<math\b[^>]*>(.*?)</math>|\\\((.*?)\\\)|\\\[(.*?)\\\]|\$\$(.*?)\$\$|\\begin\{(?:equation|align|displaymath)\*?\}(.*?)\\end\{(?:equation|align|displaymath)\*?\}", formula, text, flags=re.S)
    text = re.sub(r"\$\\(?:mathrm|text)\{([^{}$]*)\}\$", r"\1", text)
    text = re.sub(r"\$((?![\s\d])[^$\n]+|[^$\n]*[\\^_{][^$\n]*)\$", formula, text)
    text = re.sub(r"(?<!`)`([^`\n]+)`", code, text)

    ordered: list[bool] = []

    def tag(m) -> str:
        name = re.match(r"</?([A-Za-z0-9]+)", m[0])[1].lower()
        closing = m[0].startswith("</")
        if name in ("ul", "ol"):
            ordered.append(name == "ol") if not closing else (ordered.pop() if ordered else None)
            return "\n"
        if name == "li":
            return "\n" + ("" if closing else "1. " if ordered and ordered[-1] else "- ")
        if re.fullmatch(r"h[1-6]", name):
            return "\n" if closing else "\n" + "#" * int(name[1]) + " "
        return "\n" if name == "br" or re.fullmatch(_BLOCK_TAGS, name) else ""

    text = _tag.sub(tag, text)
    text = re.sub(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[A-Za-z-]+=[^<>]*)?\Z|\"?\s[A-Za-z-]+=(?:\"[^\"]*\"|'[^']*')\s*/?>", "", text)
    text = html.unescape(re.sub(r"&amp;(?=[a-z]+;)", "&", text)).replace("\xa0", " ")
    text = re.sub(r"^(=+)\s*([^=\n].*?)\s*\1[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2], text, flags=re.M)
    text = re.sub(r"^([^\n]+)\n(?:(={3,})|-{3,})[ \t]*$", lambda m: ("# " if m[2] else "## ") + m[1], text, flags=re.M)
    levels = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
    text = re.sub(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", lambda m: "\n" + "#" * levels[m[1]] + " " + m[2] + "\n", text)
    numbered = "\\begin{enumerate}" in text
    text = re.sub(r"\\item\s*", "1. " if numbered else "- ", re.sub(r"\\(?:begin|end)\{[a-z]+\*?\}", "", text))
    wiki = bool(re.search(r"''|\[\[|\{\{", text))
    text = re.sub(r"^[ \t]{0,3}>[ \t]?", "", text, flags=re.M)
    text = re.sub(r"^[*+][ \t]", "- ", text, flags=re.M)
    if wiki:
        text = re.sub(r"^#[ \t]", "1. ", text, flags=re.M)
    text = re.sub(r"^[:;][ \t]", "", text, flags=re.M)
    text = re.sub(r"^\s*\[([^\[\]]+)\]:\s\S+\s*$", r"\1", text, flags=re.M)
    text = "\n".join(_inline(line) for line in text.split("\n"))
    text = re.sub(f"{mark}(\\d+){mark}", lambda m: kept[int(m[1])], text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", text, flags=re.M)).strip()


def cleaned(df: DataFrame, text: str, to: str = "clean_text") -> DataFrame:
    """df with the clean text where there is markup, and the text as it is elsewhere; plain texts skip the converter."""

    @F.pandas_udf("string")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(clean)

    marked = has_markup(df, text, "_marked")
    # null keeps plain texts from being converted: a condition around the function would not
    out = marked.withColumn("_converted", convert(F.when(F.col("_marked"), F.col(text))))
    return out.withColumn(to, F.when(F.col("_marked"), F.col("_converted")).otherwise(F.col(text))).drop("_marked", "_converted")
