"""Markdown messages to units (paragraph-sized pieces) and units to sentences.

Blocks are read line by line from a subset of CommonMark with tables, task lists and footnotes: fenced and
indented code, headings, HTML blocks, table rows, quotes, nested lists, paragraphs. Offsets are bytes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Newlines of a piece of code that counts as one sentence (fixed value).
CODE_LINES = 20

UNIT = "array<struct<seq:int,start:int,end:int,code:boolean,text:string,sentences:array<string>>>"

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(?=\S)|[ \t]*$)")
_HTML = re.compile(r" {0,3}<(?:[A-Za-z/][A-Za-z0-9-]*(?=[\s/>]|$)|[!?])")
_DASHES = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_REFERENCE = re.compile(r" {0,3}\[[^\]^][^\]]*\]:\s*\S+")
_FOOTNOTE = re.compile(r" {0,3}\[\^[^\]]+\]:[ \t]*")
_QUOTE = re.compile(r" {0,3}> ?")

Line = tuple[int, int]  # where the line's content starts and ends, container marks stripped


class _Blocks:
    """Reads blocks and writes down the units, (start, end, code), in reading order. Each place of the text belongs to one
    unit at most, as no block with text holds another: a list item has what stands before its first inner unit."""

    def __init__(self, text: str):
        self.text, self.units = text, []

    def blank(self, line: Line) -> bool:
        return not self.text[line[0] : line[1]].strip()

    def indent(self, line: Line) -> int:
        s = self.text[line[0] : line[1]].expandtabs(4)
        return len(s) - len(s.lstrip(" "))

    def starts(self, line: Line) -> bool:
        """Whether the line ends a paragraph before it."""
        s = self.text[line[0] : line[1]]
        m = _ITEM.match(s)
        if m and (m[3] is None or (m[2][0].isdigit() and int(m[2][:-1]) != 1)):
            m = None
        return bool(m or _FENCE.match(s) or _HEADING.match(s) or _RULE.match(s) or _QUOTE.match(s) or _HTML.match(s))

    def read(self, lines: list[Line], tight: bool = False) -> None:
        i, n = 0, len(lines)
        while i < n:
            start = i
            s = self.text[lines[i][0] : lines[i][1]]
            if self.blank(lines[i]):
                i += 1
            elif m := _FENCE.match(s):
                i += 1
                while i < n and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", self.text[lines[i][0] : lines[i][1]]):
                    i += 1
                i = min(i + 1, n)
                self.leaf(lines, start, i, True)
            elif self.indent(lines[i]) >= 4:
                while i < n and (self.blank(lines[i]) or self.indent(lines[i]) >= 4):
                    i += 1
                self.leaf(lines, start, i, True)
            elif _HEADING.match(s):
                i += 1
                self.leaf(lines, start, i)
            elif _RULE.match(s):
                i += 1
            elif _QUOTE.match(s):
                inner = []
                while i < n and not self.blank(lines[i]):
                    m = _QUOTE.match(self.text[lines[i][0] : lines[i][1]])
                    if not m and self.starts(lines[i]):
                        break
                    inner.append((lines[i][0] + (m.end() if m else 0), lines[i][1]))
                    i += 1
                self.read(inner)
            elif _ITEM.match(s):
                i = self.list(lines, i)
            elif m := _FOOTNOTE.match(s):
                inner = [(lines[i][0] + m.end(), lines[i][1])]
                i += 1
                while i < n and not self.blank(lines[i]) and not self.starts(lines[i]):
                    inner.append(lines[i])
                    i += 1
                self.read(inner)
            elif _HTML.match(s):
                while i < n and not self.blank(lines[i]):
                    i += 1
                self.leaf(lines, start, i)
            elif "|" in s and i + 1 < n and "-" in self.text[lines[i + 1][0] : lines[i + 1][1]] and _DASHES.match(self.text[lines[i + 1][0] : lines[i + 1][1]]):
                i += 2  # the head row is no unit
                while i < n and not self.blank(lines[i]) and not self.starts(lines[i]):
                    self.leaf(lines, i, i + 1)
                    i += 1
            elif _REFERENCE.match(s):
                i += 1
            else:
                i += 1
                heading = False
                while i < n and not self.blank(lines[i]):
                    if _UNDERLINE.match(self.text[lines[i][0] : lines[i][1]]):
                        i, heading = i + 1, True
                        break
                    if self.starts(lines[i]):
                        break
                    i += 1
                if heading or not tight:
                    self.leaf(lines, start, i)

    def leaf(self, lines: list[Line], start: int, end: int, code: bool = False) -> None:
        self.write(lines[start][0], lines[end - 1][1], code)

    def write(self, start: int, end: int, code: bool = False, at: int | None = None) -> None:
        """A unit without the white space around it, as the last or at a place in the order; none if nothing else is there."""
        held = re.search(r"\S(?:.*\S)?", self.text[start:end], re.S)
        if held:
            self.units.insert(len(self.units) if at is None else at, (start + held.start(), start + held.end(), code))

    def list(self, lines: list[Line], i: int) -> int:
        """The items of one list from line i on; the line after it."""
        n, found, loose = len(lines), [], False
        kind = _ITEM.match(self.text[lines[i][0] : lines[i][1]])[2][-1]
        while i < n:
            s = self.text[lines[i][0] : lines[i][1]]
            m = _ITEM.match(s)
            if not m or m[2][-1] != kind or _RULE.match(s):
                break
            width = m.end(2) + (len(m[3]) if m[3] and len(m[3]) <= 4 else 1)
            inner, first, gap = [(min(lines[i][0] + width, lines[i][1]), lines[i][1])], lines[i][0] + len(m[1]), False
            i += 1
            while i < n:
                if self.blank(lines[i]):
                    after = next((j for j in range(i, n) if not self.blank(lines[j])), n)
                    if after == n or self.indent(lines[after]) < width:
                        break
                    gap = True
                    inner += lines[i:after]
                    i = after
                elif self.indent(lines[i]) >= width:
                    inner.append((lines[i][0] + width, lines[i][1]))
                    i += 1
                elif self.starts(lines[i]) or _ITEM.match(self.text[lines[i][0] : lines[i][1]]):
                    break
                else:
                    inner.append(lines[i])
                    i += 1
            found.append((first, inner))
            loose |= gap
            after = next((j for j in range(i, n) if not self.blank(lines[j])), n)
            if after < n and after > i and _ITEM.match(self.text[lines[after][0] : lines[after][1]]) and _ITEM.match(self.text[lines[after][0] : lines[after][1]])[2][-1] == kind:
                loose, i = True, after
        for first, inner in found:
            place = len(self.units)
            self.read(inner, tight=not loose)
            held = self.units[place:]
            self.write(first, held[0][0] if held else inner[-1][1], at=place)
        return i


def units(text: str | None) -> list[tuple[int, int, bool]]:
    """(start, end, code) of the units, in characters. A blank text has none; a text without blocks is one."""
    text = text or ""
    lines, at = [], 0
    for raw in text.split("\n"):
        lines.append((at, at + len(raw)))
        at += len(raw) + 1
    reader = _Blocks(text)
    reader.read(lines)
    if not reader.units:
        reader.write(0, len(text))
    return reader.units


_END = re.compile(r"[.!?؟؛\n](?=\s|\Z)")


def sentences(text: str, code: bool = False) -> list[str]:
    """Pieces of a unit's text: sentences with their terminators, or runs of CODE_LINES lines of code."""
    if code:
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        pieces = ["".join(lines[i : i + CODE_LINES]) for i in range(0, len(lines), CODE_LINES)]
    else:
        pieces, at = [], 0
        for m in _END.finditer(text):
            pieces.append(text[at : m.end()])
            at = m.end()
        pieces.append(text[at:])
    return [p.strip() for p in pieces if p.strip()]


def split_units(body: Column) -> Column:
    """The units of each message body, as an array to explode; null bodies have none."""

    @F.pandas_udf(UNIT)
    def run(bodies: pd.Series) -> pd.Series:
        out = []
        for text in bodies:
            rows = []
            wide = text is not None and not text.isascii()
            for seq, (start, end, code) in enumerate(units(text)):
                piece = text[start:end]
                b = len(text[:start].encode()) if wide else start
                rows.append({"seq": seq, "start": b, "end": b + len(piece.encode()) if wide else end, "code": code, "text": piece, "sentences": sentences(piece, code)})
            out.append(rows)
        return pd.Series(out)

    return run(body)


def sentence_pieces(text: Column) -> Column:
    """sentences() of prose as a native expression."""
    pieces = F.split(text, r"(?<=[.!?؟؛\n])(?=\s|\z)")
    return F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
