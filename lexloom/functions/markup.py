"""HTML of definitions as styled runs, as text, and the targets of its links."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STYLE = "struct<bold:boolean,italic:boolean,sup:boolean,sub:boolean,link:boolean,mono:boolean,scale:double>"
RUNS = f"array<struct<text:string,style:{STYLE},href:string>>"
MAX_DEPTH = 256
# Elements that stand on lines of their own, and what other elements do to the style.
BLOCKS = frozenset("p div li tr ul ol dl dt dd table section article blockquote hr center h1 h2 h3 h4 h5 h6".split())
EFFECTS = {
    **dict.fromkeys(("b", "strong"), ("bold", 1.0)),
    **dict.fromkeys(("i", "em", "cite", "var"), ("italic", 1.0)),
    "sup": ("sup", 0.83),
    "sub": ("sub", 0.83),
    **dict.fromkeys(("a", "kref"), ("link", 1.0)),
    **dict.fromkeys(("tt", "code", "kbd", "samp", "pre"), ("mono", 1.0)),
    "small": (None, 0.9),
    "big": (None, 1.1),
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), ("bold", 1.15)),
}
#: Elements that are reopened after a block that ends while they are open.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose opening ends one of the same kind that is still open.
IMPLIED_END = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
PLAIN = (False, False, False, False, False, False, 1.0)
_FLAGS = ("bold", "italic", "sup", "sub", "link", "mono")
PILCROW = "¶"


class _Runs(HTMLParser):
    """Collects runs while it reads; the stack holds (name, style, href) of open elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.runs: list[list] = []
        self.stack: list[tuple[str, tuple, str | None]] = []
        #: How many elements of a name are open, so that the stack is searched only where there is something to find.
        self.open: Counter[str] = Counter()
        self.silent = 0
        self.gap = ""

    def _top(self) -> tuple[tuple, str | None]:
        return self.stack[-1][1:] if self.stack else (PLAIN, None)

    def _push(self, name: str, href: str | None) -> None:
        style, outer = self._top()
        flag, factor = EFFECTS.get(name, (None, 1.0))
        flags = tuple(on or f == flag for f, on in zip(_FLAGS, style))
        self.stack.append((name, (*flags, style[6] * factor), outer if href is None else href))
        self.open[name] += 1

    def _break(self) -> None:
        if self.runs:
            self.gap = "\n"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("style", "script"):
            self.silent += 1
            return
        if (ends := IMPLIED_END.get(tag)) and any(self.open[n] for n in ends):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in ends:
                    self._close(i)
                    break
                if self.stack[i][0] in BLOCKS and self.stack[i][0] not in ends:
                    break
        if tag in BLOCKS and self.open["p"]:
            self._close(self._last("p"))
        if tag == "a" and self.open["a"]:
            self._close(self._last("a"))
        if tag in BLOCKS or tag == "br":
            self._break()
        if tag not in VOID:
            self._push(tag, dict(attrs).get("href"))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def _last(self, name: str) -> int:
        return next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == name)

    def _close(self, i: int) -> None:
        """Closes the element at i; formatting elements opened inside a block go on after it."""
        inner = self.stack[i + 1 :]
        block = self.stack[i][0] in BLOCKS
        self.open.subtract(n for n, *_ in self.stack[i:])
        del self.stack[i:]
        for name, _, href in inner:
            if name in FORMATTING:
                self._push(name, href)
        if block:
            self._break()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("style", "script"):
            self.silent = max(0, self.silent - 1)
            return
        for i in range(len(self.stack) - 1, -1, -1) if self.open[tag] or not (tag in BLOCKS or tag in FORMATTING) else ():
            if self.stack[i][0] == tag:
                self._close(i)
                return
            if self.stack[i][0] in BLOCKS and tag not in BLOCKS and tag not in FORMATTING:
                return
        if tag in ("p", "br"):
            self._break()

    def _emit(self, text: str, style: tuple, href: str | None) -> None:
        if self.runs and self.runs[-1][1] == style and self.runs[-1][2] == href:
            self.runs[-1][0].append(text)
        else:
            self.runs.append([[text], style, href])

    def handle_data(self, data: str) -> None:
        if self.silent or len(self.stack) > MAX_DEPTH:
            return
        style, href = self._top()
        for n, part in enumerate(data.split("||")):
            if n:
                self._break()
            for k, line in enumerate(part.split(PILCROW)):
                if k:
                    self._break()
                    line = PILCROW + line
                if line[:1].isspace() and self.runs and not self.gap:
                    self.gap = " "
                for j, word in enumerate(line.split()):
                    if (j or self.gap) and self.runs:
                        self._emit(self.gap or " ", PLAIN, None)
                    self.gap = ""
                    self._emit(word, style, href)
                if line[-1:].isspace() and line.strip() and self.runs:
                    self.gap = " "


def to_runs(html: str | None) -> list[dict]:
    """Styled runs: white space collapsed, blocks on lines of their own."""
    if not html:
        return []
    parser = _Runs()
    parser.feed(html)
    parser.close()
    return [{"text": "".join(t), "style": dict(zip((*_FLAGS, "scale"), s)), "href": h} for t, s, h in parser.runs]


def to_text(html: str | None) -> str | None:
    return None if html is None else "".join(r["text"] for r in to_runs(html))


@functools.cache
def _udf(kind: str, of) -> object:
    @F.pandas_udf(kind)
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(of, na_action="ignore")

    return convert


def html_runs(html: Column) -> Column:
    return _udf(RUNS, to_runs)(html)


def html_text(html: Column) -> Column:
    return _udf("string", to_text)(html)


def link_target(href: Column) -> Column:
    """The headword a link leads to; null if it leads out of the collection."""
    target = F.regexp_replace(F.regexp_replace(href, "^bword:(?://)?", ""), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    away = (target == "") | target.contains("://") | target.startswith("#") | target.rlike(r"^[^\s\p{Z}:]*:")
    return F.when(~away, target)
