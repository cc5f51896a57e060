"""Parsers of dictionary files: bytes in, filings and entries out. Damaged input gives what is whole, or ParseError."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from lexloom.functions import dsl

CAP = 2 << 30
B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


class ParseError(ValueError):
    """The file is no dictionary of its format."""


@dataclass
class Parsed:
    """name; filings: (word, offset, size, listed, alias) in stored order; texts: (offset, size) -> text; lines for DSL."""

    name: str
    filings: list[tuple[str, int, int, bool, bool]] = field(default_factory=list)
    texts: dict[tuple[int, int], str] = field(default_factory=dict)

    def headwords(self, distinct: bool = True) -> list[tuple[str, bool]]:
        """(word, is_alias) of listed words in order; a word filed itself before any pointer to it is no alias."""
        listed = [(w, alias) for w, _, _, shown, alias in self.filings if shown]
        if not distinct:
            return listed
        out: dict[str, bool] = {}
        for word, alias in listed:
            out.setdefault(word, alias)
        return list(out.items())


def unpacked(data: bytes, cap: int = CAP) -> bytes:
    """The content of a gzip file of one or more members; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts, total = [], 0
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        try:
            parts.append(one.decompress(data, cap - total + 1))
        except zlib.error as e:
            raise ParseError(f"broken gzip data: {e}") from e
        total += len(parts[-1])
        if total > cap or one.unconsumed_tail:
            raise ParseError("unpacked data is too large")
        if not one.eof:
            raise ParseError("gzip data ends early")
        data = one.unused_data
    return b"".join(parts)


def _slice(data: bytes, offset: int, size: int) -> bytes | None:
    return data[offset : offset + size] if offset + size <= len(data) else None


def _lossy(data: bytes) -> str:
    return data.decode("utf-8", "replace")


# --- StarDict ---------------------------------------------------------------------------------------------------------


def parse_info(text: str) -> dict[str, str]:
    return {k.strip(): v.strip() for k, eq, v in (line.partition("=") for line in text.splitlines()) if eq}


def records(stream, tail: int, step: int = 1 << 20) -> Iterator[tuple[str, bytes]]:
    """(word, the bytes behind it) of NUL-terminated words, up to where the data is cut; read piece by piece."""
    held = b""
    while piece := stream.read(step):
        held += piece
        at = 0
        while (end := held.find(b"\0", at)) >= 0 and end + 1 + tail <= len(held):
            yield _lossy(held[at:end]), held[end + 1 : end + 1 + tail]
            at = end + 1 + tail
        held = held[at:]


def offset_form(info: dict[str, str]) -> str:
    """How an index stores offset and size."""
    bits = info.get("idxoffsetbits", "32")
    if bits not in ("32", "64"):
        raise ParseError(f"offsets of {bits} bits")
    return ">QI" if bits == "64" else ">II"


def entry_text(block: bytes, types: str | None) -> str:
    """The text of an entry of a StarDict file whose entries are of these types."""
    if types is None or len(types) > 1:
        return block_text(block, types)
    return _lossy(block) if "a" <= types <= "z" else ""


def block_text(block: bytes, types: str | None) -> str:
    """The text fields of a block: of the types given, or each with its own type byte; joined by line breaks."""
    out, at, kinds = [], 0, list(types or "")
    while at < len(block) if types is None else kinds:
        if types is None:
            kind, at = chr(block[at]), at + 1
            last = False
        else:
            kind = kinds.pop(0)
            last = not kinds
        if last:
            value, at = block[at:], len(block)
        elif "A" <= kind <= "Z":
            if at + 4 > len(block):
                break
            size = struct.unpack_from(">I", block, at)[0]
            value, at = block[at + 4 : at + 4 + size], min(at + 4 + size, len(block))
        else:
            end = block.find(b"\0", at)
            if end < 0:
                if types is not None:
                    break
                end = len(block)
            value, at = block[at:end], end + 1
        if "a" <= kind <= "z":
            out.append(_lossy(value))
    return "\n".join(out)


def stardict(stem: str, info: bytes, idx: bytes, data: bytes, syn: bytes = b"") -> Parsed:
    keys = parse_info(_lossy(info))
    form = offset_form(keys)
    data, idx = unpacked(data), unpacked(idx)
    out = Parsed(keys.get("bookname") or stem)
    raw = [(w, *struct.unpack(form, b)) for w, b in records(io.BytesIO(idx), struct.calcsize(form))]
    out.filings = [(w, o, n, not w.startswith("##"), False) for w, o, n in raw]
    for word, b in records(io.BytesIO(unpacked(syn)), 4):
        (at,) = struct.unpack(">I", b)
        if at < len(raw):
            out.filings.append((word, raw[at][1], raw[at][2], not word.startswith("##"), True))
    types = keys.get("sametypesequence") or None
    for _, o, n, _, _ in out.filings:
        if (o, n) not in out.texts and (block := _slice(data, o, n)) is not None:
            out.texts[o, n] = entry_text(block, types)
    return out


# --- dictd ------------------------------------------------------------------------------------------------------------


def b64(text: str) -> int:
    n = 0
    for c in text:
        digit = B64.find(c)
        if digit < 0:
            raise ParseError(f"no digit: {c!r}")
        n = n * 64 + digit
        if n >= 1 << 64:
            raise ParseError("number too large")
    return n


def index_line(line: str) -> tuple[str, int, int] | None:
    """(word, offset, size) of a line of an index; None of a broken one."""
    parts = line.removesuffix("\r").split("\t", 2)
    try:
        return parts[0], b64(parts[1]), b64(parts[2])
    except (IndexError, ParseError):
        return None


def dictd(stem: str, index: bytes, data: bytes) -> Parsed:
    data, out = unpacked(data), Parsed(stem)
    for word, offset, size in filter(None, map(index_line, _lossy(index).split("\n"))):
        block = _slice(data, offset, size)
        if word.startswith("00-database-"):
            if word.startswith("00-database-short") and block is not None:
                out.name = _lossy(block).strip()
            continue
        out.filings.append((word, offset, size, True, False))
        if block is not None:
            out.texts[offset, size] = _lossy(block)
    return out


# --- tab-separated ----------------------------------------------------------------------------------------------------


def table(stem: str, data: bytes) -> Parsed:
    """Headword in the third column, description in the fifth; the first description of a word counts."""
    out, seen = Parsed(stem), set()
    for n, line in enumerate(_lossy(data).split("\n")):
        parts = line.removesuffix("\r").split("\t")
        if len(parts) > 4 and (word := parts[2].strip()) and word not in seen:
            seen.add(word)
            out.filings.append((word, n, len(parts[4]), True, False))
            out.texts[n, len(parts[4])] = parts[4]
    return out


# --- DSL --------------------------------------------------------------------------------------------------------------


def encoding_of(head: bytes) -> tuple[str, int]:
    """(encoding, bytes of its mark) by the beginning of a file: by its byte-order mark, else UTF-16LE if every fifth byte or more is NUL, else UTF-8."""
    for mark, encoding in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if head.startswith(mark):
            return encoding, len(mark)
    head = head[:1024]
    return ("utf-16-le" if head and head.count(0) * 5 > len(head) else "utf-8"), 0


def decoded(data: bytes) -> str:
    encoding, mark = encoding_of(data)
    body = data[mark:]
    return (body[: len(body) & ~1] if "16" in encoding else body).decode(encoding, "replace")


def cards(lines: Iterable[str]) -> Iterator[tuple[list[str], int, str]]:
    """(headword lines, offset in bytes of UTF-8, body) of each card; headers and headwords without body are left out.

    lines are without their line feeds. One card at a time is held: its headwords, and its body as it grows.
    """
    heads: list[str] = []
    body: list[str] = []
    start = at = pending = 0
    header = True
    for raw in lines:
        line, here = raw.rstrip("\r"), at
        at += len(raw.encode("utf-8", "replace")) + 1
        indented = line[:1] in ("\t", " ") and line != ""
        if not line.strip() or (header and not indented and line.startswith("#")):
            # blank lines belong to a body only if more of it follows
            if body:
                body.append(raw)
                pending += 1
            continue
        header = False
        if indented:
            if not body:
                start = here
            body.append(raw)
            pending = 0
            continue
        if body:
            yield heads, start, "\n".join(body[: len(body) - pending]).rstrip("\r")
            heads, body, pending = [], [], 0
        heads = [*heads, line]
    if body:
        yield heads, start, "\n".join(body[: len(body) - pending]).rstrip("\r")


def dsl_name(lines: Iterable[str]) -> str | None:
    for line in lines:
        if line.strip() and not line.startswith("#"):
            return None
        if line.startswith("#NAME") and (name := line[5:].strip().strip('"').strip()):
            return name
    return None


def dsl_file(stem: str, data: bytes) -> Parsed:
    text = decoded(unpacked(data))
    name = dsl_name(text.split("\n"))
    out = Parsed(name or stem)
    for lines, offset, body in cards(text.split("\n")):
        size = len(body.encode("utf-8"))
        for key, shown in dsl.filed(lines):
            out.filings.append((key, offset, size, shown, False))
        out.texts[offset, size] = body
    if not out.filings and name is None:
        raise ParseError("neither header nor cards")
    return out
