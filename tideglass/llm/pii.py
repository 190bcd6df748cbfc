"""Personal data: plain patterns, and disguised ones found on a normalised text and mapped back."""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.blocks import slices
from tideglass.llm.common import pick

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Letters that look like ASCII ones, and digits as words in four languages.
LOOKALIKES = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "υ": "u", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ⅼ": "l", "‐": "-", "‑": "-", "–": "-", "−": "-", "。": ".", "․": ".",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}

GAP = r"[ \t\n]{0,4}"
NO_LETTER_BEFORE, NO_LETTER_AFTER = r"(?<![^\W_])", r"(?![^\W_])"
BRACKETED = re.compile(rf"{GAP}[\[({{<]{GAP}(?:(at|arroba|arobase)|(?:dot|punkt|punto|point)){GAP}[\])}}>]{GAP}", re.I)
PLAIN_AT = re.compile(r"(?<=[A-Za-z0-9])[ \t]{1,4}at[ \t]{1,4}(?=[A-Za-z0-9-]{1,63}(?:[ \t]{1,4}dot[ \t]{1,4}[A-Za-z0-9]))", re.I)
PLAIN_DOT = re.compile(r"(?<=[A-Za-z0-9])[ \t]{1,4}dot[ \t]{1,4}(?=[A-Za-z0-9])", re.I)
WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
ONE_DIGIT = re.compile(rf"(?:{WORD}){NO_LETTER_AFTER}", re.I)
SPELLED = re.compile(rf"{NO_LETTER_BEFORE}(?:{WORD})(?:(?:[ \t]{{1,4}}|-|\.)(?:{WORD}|[0-9]))+{NO_LETTER_AFTER}", re.I)
DIGIT_SET = frozenset(DIGIT_WORDS)
BLANKS = {i: " " for i in range(128) if not chr(i).isalnum()}
UN_RUN = re.compile(r"un(?:[ \t]{1,4}|-|\.)(?:un|[0-9])")
PLUS = re.compile(rf"{NO_LETTER_BEFORE}plus[ \t]{{1,4}}(?=[0-9])", re.I)


def emails(text: str):
    """An address has one "@", and the characters before it can't hold another, so every "@" is tried once."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of identifiers as they stand, leftmost first and without overlap within a kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


@cache
def lookalikes() -> dict[str, str]:
    """Single characters by their ASCII form: the listed ones, compatibility forms, decimal digits of any
    script; invisible ones vanish. Of Latin-1 only the soft hyphen is among them."""
    table = {}
    for c in map(chr, range(0x100, 0x20000)):
        form = unicodedata.normalize("NFKC", c)
        if len(form) == 1 and "!" <= form <= "~":
            table[c] = form
        elif (d := unicodedata.decimal(c, None)) is not None:
            table[c] = str(d)
    return table | LOOKALIKES | dict.fromkeys(INVISIBLE, "")


def has_lookalikes(text: str) -> bool:
    if text.isascii() or INVISIBLE[0] in text:
        return INVISIBLE[0] in text
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return not lookalikes().keys().isdisjoint(set(text))


def has_spelled_run(low: str) -> bool:
    """False only if SPELLED matches nowhere; a French text is full of single "un"."""
    found = DIGIT_SET.intersection(low.translate(BLANKS).split())
    return bool(found - {"un"} or found and UN_RUN.search(low)) and bool(SPELLED.search(low))


class Tape:
    """A text under rewriting; each of its characters knows the stretch of the source it stands for.

    Offsets are 32-bit arrays of the machine (8 bytes a character), joined from slices, never lists of numbers."""

    def __init__(self, text: str):
        self.text, self.start = text, array("i", range(len(text)))
        self.end = array("i", range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, new) -> None:
        """Replace each match; ``new(match)`` gives (first, last, string) pieces, in order, within it."""
        text, start, end, at = [], array("i"), array("i"), 0
        for m in pattern.finditer(self.text):
            text.append(self.text[at : m.start()])
            start += self.start[at : m.start()]
            end += self.end[at : m.start()]
            for a, b, s in new(m):
                text.append(s)
                start += array("i", [self.start[a]]) * len(s)
                end += array("i", [self.end[b - 1]]) * len(s)
            at = m.end()
        if at:
            text.append(self.text[at:])
            start += self.start[at:]
            end += self.end[at:]
            self.text, self.start, self.end = "".join(text), start, end

    def translate(self, table: dict[str, str]) -> None:
        """One character for each character, or none."""
        self.start = array("i", (x for x, c in zip(self.start, self.text, strict=True) if table.get(c, c)))
        self.end = array("i", (x for x, c in zip(self.end, self.text, strict=True) if table.get(c, c)))
        self.text = self.text.translate(str.maketrans(table))

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def digits_of(m: re.Match):
    """Digits of a spelled run; blanks and hyphens between two of them fall away, points stay."""
    at = m.start()
    while at < m.end():
        c = m.string[at]
        if c in " \t-":
            at += 1
        elif c == "." or c.isdigit():
            yield at, at + 1, c
            at += 1
        else:
            word = ONE_DIGIT.match(m.string, at)
            yield at, word.end(), str(DIGIT_WORDS[word[0].lower()])
            at = word.end()


def disguised(text: str) -> list[tuple[int, int, int]]:
    """Identifiers of the normalised text, at their places in the source."""
    low = text.lower()
    foreign = has_lookalikes(text)
    spoken = "dot" in low or any(c in text for c in "[({<") and BRACKETED.search(text)
    spelled = has_spelled_run(low)
    if not (foreign or spoken or spelled):
        return []
    tape = Tape(text)
    if foreign:
        tape.translate(lookalikes())
    tape.rewrite(BRACKETED, lambda m: [(m.start(), m.end(), "@" if m[1] else ".")])
    tape.rewrite(PLAIN_AT, lambda m: [(m.start(), m.end(), "@")])
    tape.rewrite(PLAIN_DOT, lambda m: [(m.start(), m.end(), ".")])
    tape.rewrite(SPELLED, digits_of)
    tape.rewrite(PLUS, lambda m: [(m.start(), m.end(), "+")])
    if tape.text == text:
        return []
    return [(s, k, e) for a, k, b in plain(tape.text) for s, e in [tape.source(a, b)]]


def spans_of(text: str | None) -> list[dict]:
    if not text:
        return []
    base = set(plain(text))
    return [{"kind": KINDS[k], "start": a, "end": b, "base": (a, k, b) in base} for a, k, b in sorted(base | set(disguised(text)))]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data in every whole text: doc_id and spans, an array of (kind, start, end, base).

    Offsets are code points of the source, end exclusive; order is by start, then email, ip, card, phone.
    ``base`` spans are those of the plain patterns: leftmost, not overlapping within a kind, matches that fail
    the kind's test dropped. The others come from normalising look-alike letters and digits, invisible
    characters, bracketed or spoken "at" and "dot", digits as words and spoken "plus", detecting again,
    and mapping each span to the source characters it stands for; they may overlap base ones.

    Null and empty texts have no spans. Repeated rows are searched each, null ids stay null. An empty table gives
    an empty result; further columns, whatever their names, are ignored. A rewritten text costs 8 bytes a
    character beside itself, so a very long one needs some ten times its size.
    """

    def search(batches):
        for batch in batches:
            for part in slices(batch):
                found = [spans_of(s) for s in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(SPAN))], names=["doc_id", "spans"])

    rows = pick(docs, doc_id=(doc_id, "long"), text=(text, "string"))
    return rows.mapInArrow(search, "doc_id long, spans array<struct<kind string, start long, end long, base boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and a checksum of the base spans, and all spans as one string."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [of_kind(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
