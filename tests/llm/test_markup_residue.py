"""Markup found and removed."""

import pytest
from pyspark.sql import functions as F

from lexloom.llm import markup_residue as M

MARKED = [
    "the <b>bold</b> one", "see <a href='x'>x</a>", "cut in a tag<br", "a &lt;i&gt;b&lt;/i&gt;", "salt&nbsp;", "a **b** c", "a __b c__ d", "*one* two", "`code` here", "~~no~~ yes",
    "# head", "> quote", "```\nplain words\n```", "[a](b)", "[a]: bword://a", "* item", "- **item**", "head\n====", "== head ==", "''it'' is", "[[a|b]]", "{{t|a}}", ": ''x''",
    "\\textbf{x}", "{\\em x}", "$x^{2}$", "\\begin{itemize}\n\\item a\n\\end{itemize}", "\\section*{a}", "<!-- c -->", 'word" target="_blank">', "bword://<i>x</i>", "{| class=x",
]
PLAIN = [
    "plain words only", "1. one\n2. two", "a < b in the list", "k > h", "f = n / N", "x^2 + y", "a_1 = b", "p <= 0.5", "if n == 0 { return miss; }", "for f in forms:\n    show(f)",
    "a -> alpha", "sort -k1 list > out", "x [sic]", "x {sic}", "x (2*) y", "*word-, reconstructed", "*word-, reconstructed (2*) in the list", "at $5 the pair", "$5 or $6", "(series #3)", "R&D sense, 2 > 1",
    "snake_case here", "bword://word", "l'un", "", " > 1", "\n\n", "a\nb", "“x” — y", "50 %",
]


def judged(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, value string")
    return {r.i: r.has_markup for r in M.has_markup(df, "value").collect()}


def test_held_out_texts(spark):
    got = judged(spark, [*MARKED, *PLAIN, None])
    assert [t for i, t in enumerate(MARKED) if not got[i]] == []
    assert [t for i, t in enumerate(PLAIN) if got[len(MARKED) + i]] == []
    assert got[len(MARKED) + len(PLAIN)] is False


def test_training_table_is_learned(spark):
    texts = M.labelled_texts()
    got = judged(spark, [t for t, _ in texts])
    assert [t for i, (t, y) in enumerate(texts) if got[i] != any(y)] == []
    assert 100 < len(texts) < 500


def test_shortcut_changes_nothing(spark):
    # texts without any sign are left out; they must be plain to the tree as well
    free = [t for t in [*MARKED, *PLAIN] if not spark.createDataFrame([(t,)], "t string").filter(F.col("t").rlike(M.ANY_SIGN)).count()]
    assert free and not set(free) & set(MARKED)
    assert M._always_plain(M.trained_tree(spark))


@pytest.mark.parametrize(
    "text, clean",
    [
        ("<h2>Head</h2><p>a <b>b</b></p><ul><li>one<li>two</ul>", "## Head\n\na b\n\n- one\n- two"),
        ("<ol><li>one</li><li>two</li></ol>", "1. one\n\n1. two"),
        ("## Head\n\na **b** and `c`\n\n> quoted\n\n* x\n* y", "## Head\n\na b and `c`\n\nquoted\n\n- x\n- y"),
        ("== Head ==\n''a'' [[b|c]]\n# ''one''\n# two", "## Head\na c\n1. one\n1. two"),
        ("\\subsection{Head}\na \\textbf{b}\n\\begin{itemize}\n\\item x\n\\end{itemize}", "## Head\n\na b\n\n- x"),
        ("$x^{2} + y$ and $$z$$", "$x^{2} + y$ and $z$"),
        ("<math>x_{1}</math>", "$x_{1}$"),
        ("```py\na -> b\n```", "```\na -> b\n```"),
        ("<pre><code>a -&gt; b\nc</code></pre>", "```\na -> b\nc\n```"),
        ("<tt>one\ntwo</tt>", "```\none\ntwo\n```"),
        ("&lt;p&gt;a &lt;b&gt;c&lt;/b&gt;&lt;/p&gt;", "a c"),
        ("see~\\hyperref[x]{x} [y](bword://y)", "see x y"),
        ("a<style>.x{}</style><!-- n --> b<ref>p. 1</ref>", "a b"),
        ("at $5 the pair, a < b", "at $5 the pair, a < b"),
        ("", ""),
        (None, None),
    ],
)
def test_clean(text, clean):
    assert M.clean(text) == clean


def test_cleaned_column_keeps_plain_texts_and_words(spark, data):
    t = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    rows = M.cleaned(M.has_markup(M.fields(t("definitions"), t("runs")), "value"), "value").collect()
    assert any(r.has_markup for r in rows)
    for r in rows:
        if not r.has_markup:
            assert r.clean_text == r.value
        assert not M._tag.search(r.clean_text) or "`" in r.clean_text


def test_empty_table_and_long_text(spark):
    assert judged(spark, []) == {}
    assert judged(spark, ["word " * 200_000, "a\n" * 3000 + "<b>x</b>"]) == {0: False, 1: True}


#: Texts whose signs mark something up or not as their surroundings tell; none of them is in the labelled table.
IN_CONTEXT = {
    "- apples and pears\n- plums\n- all kinds of berries": True, "- apples and pears": False, "a word\n- said she -\nand more of it": False, "He came in late that day.\n- where from, nobody knew": False,
    "Old forms\n---------": True, "Old forms of it\n======": True, "this is a long paragraph of many words that goes on and on and does not end here\n------": False, "-------": False, "\n-----\nmore words": False,
    "this is another long paragraph, which has far more words than any heading would ever have, so it is none\n========\nnext": False,
    "case | form\nnominative | rex": True, "singular | plural | dual\n--- | --- | ---\na | b | c": True, "here | there": False, "either | or\nnext line has none": False,
    "[rex]\n[regis]\n[regi]": True, "[rex]": False, "he wrote [sic] of it": False, "[sic] he wrote": False, "[regina bona]\n[rex malus]": True,
    "# Old forms of it": True, "# 45": False, "## The second part": True, "> he said it was so": True, "> 7": False, "F:\\data\\words": False, "in G:\\old\\texts for all": False, "of $LANG and $TERM here": False,
}


def test_surroundings_decide(spark):
    import re

    got = judged(spark, list(IN_CONTEXT))
    right = [got[i] == y for i, y in enumerate(IN_CONTEXT.values())]
    assert sum(right) >= 0.9 * len(right), [t for t, ok in zip(IN_CONTEXT, right) if not ok]
    # any sign at all, in any line: what a text would be without its surroundings
    signs = [re.compile(p.replace(r"\z", r"\Z").replace(r"\p{L}\p{N}", r"\w"), re.M) for p in (*M.SIGNS.values(), *M.FORMS.values())]
    plain_or = [any(p.search(t) for p in signs) == y for t, y in IN_CONTEXT.items()]
    assert sum(right) > sum(plain_or) + 5
    assert not set(IN_CONTEXT) & {t for t, _ in M.labelled_texts()}


def test_tree_uses_words_links_and_neighbours(spark):
    used = set()

    def walk(node):
        if len(node) > 1:
            used.add(M.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(M.trained_tree(spark))
    assert "words" in used and "link" in used and used & {"before_words", "after_words"} and used & {"before_link", "after_link", "before_bracket", "after_bracket"} and used & {"before_dash", "after_dash"}
    assert sum(len(y) for _, y in M.labelled_texts()) <= 800


def test_signs_of_the_converter_in_the_text():
    assert M.clean("<p>a \ue0005\ue001 `code` \ue000 &#xE001; b</p>") == "a \ue0005\ue001 `code` \ue000 \ue001 b"
