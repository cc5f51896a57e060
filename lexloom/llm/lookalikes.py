"""One consistent form for text that looks the same but differs in its characters.

Look-alike classes: code points and strings that show the same sign are united by union-find - compatibility and
composed forms by rule from the Unicode tables, letters of other scripts by a table of look-alikes - so the classes
are transitive (full-width a, Latin a and Cyrillic a are one). Each class has one representative per script: its most
frequent ordinary member in that script, counted over all values (a compatibility or uncomposed form represents only
where there is no other). A value is then rewritten greedily, longest match first, by
an Aho-Corasick automaton of all other members, to the representatives of its own script: the script of the letters
that look like no other script's, else of the most letters.

Characters that can't be seen are removed, other spaces become U+0020; tab, CR and LF stay.

Defined cases: null stays null and is no case; an empty text is unchanged; a value whose letters are of several
scripts is a case even where no look-alike is known for some of them (those stay); in a tie between scripts the one
more frequent in all values is taken. Values are treated one by one, so repeated rows give equal results.
"""

from __future__ import annotations

import functools
import sys
import unicodedata as U
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that look alike, in rows of Latin, Greek, Cyrillic ("-" where a script has none), then of Latin
# with Armenian, Cherokee or Coptic.
LOOK_ALIKES = """
a α а
c ϲ с
d - ԁ
e - е
h - һ
i ι і
j ϳ ј
k κ к
o ο о
p ρ р
q - ԛ
s - ѕ
u υ -
v ν ѵ
w ω ԝ
x χ х
y γ у
A Α А
B Β В
C Ϲ С
E Ε Е
F Ϝ -
G - Ԍ
H Η Н
I Ι І
J Ϳ Ј
K Κ К
M Μ М
N Ν -
O Ο О
P Ρ Р
Q - Ԛ
S - Ѕ
T Τ Т
U - -
V - Ѵ
W - Ԝ
X Χ Х
Y Υ Ү
Z Ζ -
- Π П
- Φ Ф
- Γ Г
- Λ Л
o օ
n ո
u ս
h հ
j յ
q զ
O Օ
S Տ
U Ս
L Լ
A Ꭺ
B Ᏼ
C Ꮯ
D Ꭰ
E Ꭼ
G Ꮐ
H Ꮋ
J Ꭻ
K Ꮶ
L Ꮮ
M Ꮇ
P Ꮲ
R Ꭱ
S Ꮪ
T Ꭲ
V Ꮩ
W Ꮃ
Z Ꮓ
o ⲟ
p ⲣ
c ⲥ
O Ⲟ
P Ⲣ
C Ⲥ
K Ⲕ
M Ⲙ
N Ⲛ
"""
#: With one of these, letters that look alike still do: grave, acute, circumflex, tilde, macron, breve, dieresis.
MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0308"
#: Marks and letters that leave no trace although they aren't format characters.
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ"
SCRIPTS = "Latin Greek Cyrillic Hebrew Arabic Armenian Georgian Devanagari Bengali Tamil Thai Ethiopic Cherokee Coptic Gothic Syriac Hangul Han Hiragana Katakana".split()
#: Written together as a matter of course.
TOGETHER = {"Hiragana": "Han", "Katakana": "Han"}
_script_patterns = [(TOGETHER.get(s, s), regex.compile(rf"\p{{Script={s}}}")) for s in SCRIPTS]
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e]*+\Z")
CLUSTER = regex.compile(r"\P{M}\p{M}+")


MARK_RUN = regex.compile(r"\p{M}{2,}")


def _ordered(marks) -> str:
    """Marks on one base in Unicode's order, in which they look the same."""
    run = marks[0]
    return "".join(sorted(run, key=U.combining)) if all(map(U.combining, run)) else run


@functools.cache
def script(c: str) -> str | None:
    """The script of a letter; None for all else and for letters of no one script."""
    if U.category(c)[0] != "L":
        return None
    return next((name for name, p in _script_patterns if p.match(c)), None if regex.match(r"\p{Script=Common}|\p{Script=Inherited}", c) else "other")


def unseen(c: str) -> bool:
    return c in UNSEEN or "︀" <= c <= "️" or (U.category(c) in ("Cf", "Cc") and c not in "\t\r\n")


def other_space(c: str) -> bool:
    return c != " " and U.category(c) in ("Zs", "Zl", "Zp")


class Classes:
    """Union-find over strings and code points."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(b)] = self.find(a)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return out


@functools.cache
def classes() -> dict[str, list[str]]:
    """All look-alike classes of letters, digits and accents: the same on every worker, as they come from tables only."""
    uf = Classes()
    for c in map(chr, range(0xA0, sys.maxunicode + 1)):
        if U.category(c)[0] not in "LNM" or "가" <= c <= "힣" or unseen(c):
            continue
        for form in ("NFC", "NFD", "NFKC", "NFKD"):
            same = U.normalize(form, c)
            if same != c and same.strip() and not any(unseen(x) for x in same):
                uf.union(same, c)
    for row in LOOK_ALIKES.split("\n"):
        alike = [x for x in row.split() if x != "-"]
        for other in alike[1:]:
            uf.union(alike[0], other)
            for mark in MARKS:
                uf.union(U.normalize("NFC", alike[0] + mark), U.normalize("NFC", other + mark))
                uf.union(U.normalize("NFC", other + mark), other + mark)
    return uf.members()


def _script_of(member: str) -> str:
    return next((s for s in map(script, member) if s), "")


def usual_forms(counts: dict[str, int]) -> tuple[dict[str, dict[str, str]], list[str]]:
    """For each member of a class its representative by script, from the counts of strings; and scripts by frequency.

    A member of no letters (digits, accents) stands under script "". Members that Unicode itself has another form for
    stand back behind those it has none for; among these the most frequent counts, then the shortest and first.
    """
    rank = lambda m: (U.normalize("NFKC", m) != m, -_seen(m, counts), len(m), m)
    forms: dict[str, dict[str, str]] = {}
    for members in classes().values():
        by: dict[str, list[str]] = {}
        for m in members:
            by.setdefault(_script_of(m), []).append(m)
        best = {s: min(ms, key=rank) for s, ms in by.items()}
        for m in members:
            forms[m] = best
    total: Counter[str] = Counter()
    for c, n in counts.items():
        if len(c) == 1 and (s := script(c)):
            total[s] += n
    return forms, [s for s, _ in total.most_common()]


def _seen(member: str, counts: dict[str, int]) -> int:
    """How often a member occurs: composed signs and strings with accents are counted as such, others by their rarest letter."""
    if member in counts:
        return counts[member]
    if len(member) == 1 or CLUSTER.search(member):
        return 0
    return min(counts.get(c, 0) for c in member)


class Rewriter:
    """Rewrites values to their usual characters; built once per worker from the counts."""

    def __init__(self, counts: dict[str, int]):
        import ahocorasick

        self.forms, self.order = usual_forms(counts)
        self.cross = {m for m, best in self.forms.items() if len([s for s in best if s]) > 1}
        self._usual: dict[str, str | None] = {}
        self.automaton = ahocorasick.Automaton()
        for m, best in self.forms.items():
            # plain strings such as "vi" belong to classes (of a Roman number) but are no odd form of anything
            if any(m != b for b in best.values()) and (len(m) == 1 or CLUSTER.search(m)):
                self.automaton.add_word(m, m)
        self.automaton.make_automaton()

    def usual(self, c: str) -> str | None:
        """The script of a sign that stands for itself wherever its script is written ("" if it has none); None for all others."""
        if c not in self._usual:
            own = script(c) or ""
            forms = self.forms.get(c, {})
            # a sign of no script, such as a Roman number, takes the form of the script around it
            changes = forms.get(own) != c if own else any(to != c for to in forms.values())
            odd = unseen(c) or other_space(c) or U.category(c)[0] == "M" or (bool(forms) and changes)
            self._usual[c] = None if odd else own
        return self._usual[c]

    def own_script(self, text: str) -> str:
        sure: Counter[str] = Counter()
        every: Counter[str] = Counter()
        for c in text:
            if s := script(c):
                every[s] += 1
                if c not in self.cross:
                    sure[s] += 1
        votes = sure or every
        if not votes:
            return ""
        most = max(votes.values())
        return min((s for s, n in votes.items() if n == most), key=lambda s: self.order.index(s) if s in self.order else 99)

    def __call__(self, text: str) -> tuple[str, bool]:
        """The text in its usual characters, and whether it was a case."""
        if PLAIN.match(text):
            return text, False
        known = self._usual
        kinds = {known[c] if c in known else self.usual(c) for c in text}
        if None not in kinds and len(kinds - {""}) < 2:
            # usual signs of one script: nothing to rewrite
            return text, False
        seen = "".join(" " if other_space(c) else c for c in text if not unseen(c))
        scripts = {s for s in map(script, seen) if s}
        own = self.own_script(seen)
        new = seen
        for _ in range(3):
            before, parts, at = new, [], 0
            for end, m in self.automaton.iter_long(new):
                best = self.forms[m]
                to = best.get(own) if own in best else best.get(_script_of(m), m)
                parts += [new[at : end + 1 - len(m)], to]
                at = end + 1
            new = MARK_RUN.sub(_ordered, "".join(parts) + new[at:])
            if new == before:
                break
        return new, new != text or len(scripts) > 1


#: Values of other signs than these can be cases; the others never go to Python.
SPECIAL = r"[^\t\n\r\x20-\x7e]"


def count_signs(values: DataFrame) -> DataFrame:
    """sign, n: code points and clusters of a base with its marks, of column `value`; combined before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _known_clusters()
        total: Counter[str] = Counter()
        for batch in batches:
            for v in batch.value:
                total.update(v)
                total.update(x for x in CLUSTER.findall(v) if x in known)
        # the types are given, as an empty partition has no values to tell them from
        yield pd.DataFrame({"sign": pd.Series(list(total), dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})

    own = values.select("value").filter("value is not null")
    special = own.filter(F.col("value").rlike(SPECIAL)).mapInPandas(count, "sign string, n bigint")
    plain = own.filter(~F.col("value").rlike(SPECIAL)).select(F.explode(F.split("value", "")).alias("sign")).filter("sign <> ''").groupBy("sign").agg(F.count("*").alias("n"))
    return special.unionByName(plain).groupBy("sign").agg(F.sum("n").alias("n"))


@functools.cache
def _known_clusters() -> frozenset[str]:
    return frozenset(m for ms in classes().values() for m in ms if len(m) > 1)


_rewriters: dict[str, Rewriter] = {}


def _rewriter(shared) -> Rewriter:
    """The rewriter of a broadcast (name, counts), built once in each worker."""
    name, counts = shared.value
    if name not in _rewriters:
        _rewriters.clear()
        _rewriters[name] = Rewriter(counts)
    return _rewriters[name]


def _rewritten(values: DataFrame, some: DataFrame) -> DataFrame:
    counts = {r.sign: r.n for r in count_signs(values.select("value")).collect()}
    shared = values.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, counts))

    @F.pandas_udf("usual string, is_case boolean")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            if not (there := texts.notna()).any():
                yield pd.DataFrame({"usual": texts, "is_case": False})
                continue
            one = _rewriter(shared)
            both = [one(v) if ok else (None, False) for v, ok in zip(texts, there)]
            yield pd.DataFrame(both, columns=["usual", "is_case"])

    # plain values are replaced by null, which costs next to nothing
    out = some.select("field", "row_key", "value").withColumn("r", rewrite(F.when(F.col("value").rlike(SPECIAL), F.col("value"))))
    return out.select("field", "row_key", "value", F.coalesce("r.usual", "value").alias("usual"), F.coalesce("r.is_case", F.lit(False)).alias("is_case"))


def consistent(values: DataFrame) -> DataFrame:
    """field, row_key, value, usual, is_case: each value of (field, row_key, value) in its one consistent form.

    What the driver fetches are counts of single signs: at most one row per code point and per known composition.
    """
    return _rewritten(values, values)


def cases(values: DataFrame) -> DataFrame:
    """The rows of consistent that are cases, with the same forms: counts are over all values, but plain ones are no case."""
    return _rewritten(values, values.filter(F.col("value").rlike(SPECIAL))).filter("is_case").drop("is_case")


def spellings(headwords: DataFrame, dictionaries: DataFrame, home_rows: DataFrame, guest_rows: DataFrame) -> DataFrame:
    """field, row_key, value: headwords of StarDict dictionaries, words and member spellings of both row tables."""
    star = dictionaries.filter("format = 'StarDict'").select("dict")
    heads = headwords.join(star, "dict", "left_semi").select(F.lit("headword").alias("field"), F.col("slot").alias("row_key"), F.col("word").alias("value"))
    out = heads
    for rows in (home_rows, guest_rows):
        words = rows.select(F.lit("row_word").alias("field"), F.col("row_id").alias("row_key"), F.col("word").alias("value"))
        members = rows.select(F.lit("row_member").alias("field"), F.col("row_id").alias("row_key"), F.explode("members.spelling").alias("value"))
        out = out.unionByName(words).unionByName(members)
    return out
