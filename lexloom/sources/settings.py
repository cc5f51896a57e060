"""Settings of dictionaries as a small table, changed by rules and written as TOML.

A settings table has one row per path: path, name, short, cfg_order, scope, language; see paths.SETTINGS.
"""

from __future__ import annotations

import json
import os
import re
import tomllib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("name", "short", "cfg_order", "scope", "language")


def _changed(settings: DataFrame, change: DataFrame, column: str) -> DataFrame:
    """settings with `column` taken from change (path, new) where that has the path; new paths are added."""
    both = settings.join(change.withColumn("_has", F.lit(True)), "path", "full")
    value = F.when(F.col("_has"), F.col("new")).otherwise(F.col(column))
    return both.select("path", *[(value if c == column else F.col(c)).alias(c) for c in COLUMNS])


def remember_order(settings: DataFrame, order: DataFrame) -> DataFrame:
    """order (path, rank): the reader's order; paths not in it lose theirs."""
    return _changed(settings.withColumn("cfg_order", F.lit(None).cast("bigint")), order.select("path", F.col("rank").cast("bigint").alias("new")), "cfg_order")


def remember_scope(settings: DataFrame, scope: DataFrame) -> DataFrame:
    """scope (path, scope): only what is left out is written down; what is included needs no word."""
    return _changed(settings, scope.select("path", F.when(~F.col("scope"), F.lit(False)).alias("new")), "scope")


def _quoted(text: str) -> str:
    """A basic TOML string, which JSON writes the same way."""
    return json.dumps(text, ensure_ascii=False)


def _values(row) -> dict[str, str]:
    """The lines of a dictionary's table, by key; what isn't set has none."""
    known = {"name": row["name"], "short": row["short"], "order": row["cfg_order"], "scope": row["scope"], "language": row["language"]}
    return {k: _quoted(v) if isinstance(v, str) else str(v).lower() for k, v in known.items() if v is not None}


def to_toml(roots: list[str], excludes: list[str], settings: DataFrame) -> str:
    """The configuration as text, for paths.read_config. Settings have a row per dictionary and are fetched."""
    lines = ["dictionary_dirs = [" + ", ".join(_quoted(d) for d in [*roots, *(f"!{e}" for e in excludes)]) + "]"]
    for r in settings.orderBy("path").collect():
        if values := _values(r):
            lines += ["", f"[dictionary.{_quoted(r.path)}]", *(f"{k} = {v}" for k, v in values.items())]
    return "\n".join(lines) + "\n"


def with_exclude(text: str, path: str) -> str:
    """A configuration that leaves out a path for good; everything else in the text, comments too, stays as it is."""
    dirs = tomllib.loads(text).get("dictionary_dirs", [])
    if f"!{path}" in dirs:
        return text
    item = _quoted(f"!{path}")
    strings = r"(?:\"(?:[^\"\\]|\\.)*\"|'[^']*'|#[^\n]*|[^\]\"'#])*"
    m = re.search(rf"(?m)^[ \t]*dictionary_dirs[ \t]*=[ \t]*\[({strings})\]", text)
    if not m:
        return f"dictionary_dirs = [{item}]\n{text}"
    # before the closing bracket, behind the last item and whatever comment follows it
    held = m[1].rstrip()
    bare = re.sub(r"#[^\n]*", "", held).rstrip()
    comma = "" if not dirs or bare.endswith(",") else ","
    last = len(held) - len(held[held.rfind("\n") + 1 :]) if "#" in held[held.rfind("\n") + 1 :] else len(held)
    if last < len(held):
        at = held.index("#", last)
        held = f"{held[:at].rstrip()}{comma} {held[at:]}\n    {item}"
    else:
        held = f"{held}{comma}{' ' if dirs else ''}{item}"
    return text[: m.start(1)] + held + m[1][len(m[1].rstrip()) :] + text[m.end(1) :]


def with_settings(text: str, settings: DataFrame) -> str:
    """A configuration with these settings; of the text only what differs is changed, and comments stay.

    Tables of dictionaries that settings don't name stay as they are; new ones are put at the end. Settings have a row
    per dictionary and are fetched.
    """
    new = {r.path: _values(r) for r in settings.collect()}
    out: list[str] = []
    own: dict[str, str] | None = None

    def finish() -> None:
        if own:
            at = len(out)
            while at and not out[at - 1].strip():
                at -= 1
            out[at:at] = [f"{k} = {v}" for k, v in own.items()]

    for line in text.splitlines():
        if re.match(r"\s*\[", line) and not re.match(r"\s*\[[^\]]*\]\s*,", line):
            finish()
            own = None
            m = re.fullmatch(r"\s*\[\s*dictionary\s*\.\s*(\"(?:[^\"\\]|\\.)*\"|'[^']*')\s*\]\s*(?:#.*)?", line)
            if m:
                path = tomllib.loads(f"x = {m[1]}")["x"]
                own = new.pop(path, None)
        elif own is not None and (m := re.match(r"\s*(name|short|order|scope|language)\s*=\s*(\"(?:[^\"\\]|\\.)*\"|'[^']*'|[^#\s]+)(.*)", line)):
            if m[1] not in own:
                continue
            value = own.pop(m[1])
            old, now = (tomllib.loads(f"x = {v}")["x"] for v in (m[2], value))
            line = line if old == now else f"{m[1]} = {value}{m[3]}"
        out.append(line)
    finish()
    for path, values in sorted(new.items()):
        if values:
            out += ["", f"[dictionary.{_quoted(path)}]", *(f"{k} = {v}" for k, v in values.items())]
    return "\n".join(out) + "\n"


DEFAULT = """# Folders with dictionaries; "!" before a path leaves it out.
dictionary_dirs = [{folder}]
"""


def load_or_create(path: str, folder: str = "~/Dictionaries") -> str:
    """The configuration at path; if there is none, one that names a folder in the user's home is written first."""
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(DEFAULT.format(folder=_quoted(os.path.expanduser(folder))))
    with open(path, encoding="utf-8") as f:
        return f.read()
