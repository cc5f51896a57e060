"""DSL cards: the forms of a headword line and the HTML of a body."""

from __future__ import annotations

import itertools
import re
from html import escape

# Elements of DSL tags that are rendered, and what they become in HTML.
ELEMENTS = {"b": "b", "i": "i", "u": "u", "sup": "sup", "sub": "sub", "ex": "cite", "p": "i", "t": "tt"}
MAX_GROUPS = 3
MAX_INDENT = 9
_numeral = re.compile(r"([IVXLCDM]+) (.*)", re.S)
_tag = re.compile(r"\[(/?)([^\[\]]*)\]")


def pieces(line: str) -> list[tuple[str, int | None]]:
    """(text, number of its optional group or None) of a headword line: escapes resolved, {display only} dropped."""
    out: list[tuple[str, int | None]] = []
    depth = braces = 0
    group: int | None = None
    groups = 0
    for m in re.finditer(r"\\(.?)|(.)", line, re.S):
        escaped, c = m[1], m[2]
        if c is None:
            if escaped and not braces:
                out.append((escaped, group))
        elif c in "{}":
            braces = braces + 1 if c == "{" else max(0, braces - 1)
        elif braces:
            continue
        elif c == "(":
            depth += 1
            if depth == 1:
                group, groups = groups, groups + 1
                out.append(("", group))
        elif c == ")" and depth:
            depth -= 1
            group = group if depth else None
        else:
            out.append((c, group))
    return [("".join(t for t, _ in part), g) for g, part in itertools.groupby(out, key=lambda p: p[1])]


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def _leading(parts: list[tuple[str, int | None]]) -> set[int]:
    """The optional groups before any other text: markers, not part of the word."""
    out: set[int] = set()
    for text, group in parts:
        if group is not None:
            out.add(group)
        elif text.strip():
            break
    return out


def without_leading_numeral(word: str) -> str:
    """Without a Roman numeral that stands before a Hebrew or Greek word."""
    if m := _numeral.fullmatch(word):
        first = next((c for c in m[2] if c.isalpha()), "")
        if first and ("֐" <= first <= "׿" or "Ͱ" <= first <= "Ͽ" or "ἀ" <= first <= "῿"):
            return m[2].lstrip()
    return word


def variants(line: str) -> list[tuple[str, bool]]:
    """(form, whether a leading group was kept): all forms a line can be found by, in order of the groups kept."""
    parts = pieces(line)
    groups = sorted({g for _, g in parts if g is not None})
    leading = _leading(parts)
    choices = [set(groups)] if len(groups) > MAX_GROUPS or not groups else [{g for g in groups if mask >> g & 1} for mask in range(2 ** len(groups))]
    out: dict[str, bool] = {}
    for kept in choices:
        form = _squeezed("".join(t for t, g in parts if g is None or g in kept))
        if form:
            out.setdefault(form, any(g in leading and any(t for t, h in parts if h == g) or g in leading for g in kept))
    return list(out.items())


def display_form(line: str) -> str:
    """The form of a line to show: without leading groups, with the others."""
    parts = pieces(line)
    leading = _leading(parts)
    return without_leading_numeral(_squeezed("".join(t for t, g in parts if g not in leading or g is None)))


def filed(lines: list[str]) -> list[tuple[str, bool]]:
    """(key, whether it is listed) of one card: everything it can be found by, each once."""
    found: dict[str, bool] = {}
    for line in lines:
        for form, marked in variants(line):
            shown = not marked and without_leading_numeral(form) == form
            found[form] = found.get(form, False) or shown
        if shown := display_form(line):
            found[shown] = True
    if found and not any(found.values()):
        found[next(iter(found))] = True
    return list(found.items())


def _name(inner: str) -> str:
    return re.split("[ =]", inner, maxsplit=1)[0].lower()


def plain(text: str) -> str:
    """A link's text: escapes resolved, tags dropped."""
    return re.sub(r"\\(.)|\\$|\[[^\[\]]*\]", lambda m: m[1] or "", text, flags=re.S).strip()


def _link(target: str) -> str:
    t = escape(target, quote=True).replace("&#x27;", "'")
    return f'<a href="bword://{t}">{t}</a>' if target else ""


_token = re.compile(r"\\(?P<esc>.)|\\$|<<(?P<link>.*?)>>|(?P<comment>\{\{(?:.*?\}\}|.*))|\[(?P<close>/?)(?P<tag>[^\[\]]*)\]|(?P<tilde>~)|(?P<text>[^\\<{\[~]+|.)", re.S)


def inline_to_html(line: str, headword: str) -> str:
    out: list[str] = []
    open_: list[str] = []
    silent = False
    at = 0
    show = lambda s: escape(s, quote=True).replace("&#x27;", "'")
    while m := _token.match(line, at):
        at = m.end()
        if m["tag"] is not None:
            name, closing = _name(m["tag"]), bool(m["close"])
            if name == "s":
                silent = not closing
            elif name == "ref" and not closing:
                end = next((t for t in _tag.finditer(line, at) if t[1] and _name(t[2]) == "ref"), None)
                inner = line[at : end.start()] if end else line[at:]
                at = end.end() if end else len(line)
                if not silent:
                    out.append(_link(plain(inner)))
            elif silent or name not in ELEMENTS:
                continue
            elif not closing:
                open_.append(ELEMENTS[name])
                out.append(f"<{ELEMENTS[name]}>")
            elif ELEMENTS[name] in open_:
                while (el := open_.pop()) != ELEMENTS[name]:
                    out.append(f"</{el}>")
                out.append(f"</{el}>")
        elif silent or m["comment"] is not None:
            continue
        elif m["link"] is not None:
            out.append(_link(plain(m["link"])))
        else:
            out.append(show(m["esc"] if m["esc"] is not None else headword if m["tilde"] else m["text"] or ""))
    return "".join(out) + "".join(f"</{el}>" for el in reversed(open_))


def body_to_html(body: str, headword: str) -> str:
    """Every line a block, in as many quotes as its [mN] says; lines of markup only are left out."""
    out = []
    for line in body.split("\n"):
        line = line.rstrip("\r").lstrip("\t ")
        level = 0
        if m := re.match(r"\[m(\d*)\]", line, re.I):
            level, line = min(int(m[1] or 0), MAX_INDENT), line[m.end() :]
        inner = inline_to_html(line, headword)
        if inner.strip():
            out.append(f"{'<blockquote>' * level}{inner}{'</blockquote>' * level}" if level else f"<div>{inner}</div>")
    return "".join(out)
