"""Personal data in texts, plain or disguised, with spans of the original text.

Plain addresses, numbers and hosts are found in the text itself.  Then small transducers
rewrite what hides them (look-alike and invisible characters, bracketed or spoken "at" and
"dot", spelled digits), each output character keeping the source span it stands for; what is
found in the rewritten text is mapped back.  Plain Arrow tasks over the corpus: no shuffle,
work linear in the length of a text, a few hundred texts in memory at a time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from packaudit.llm.common import key_type, slices, texts

KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<kind:string,start:int,end:int,plain:boolean>"

# Cyrillic, Greek and other letters that look like ASCII ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p",
    "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I",
    "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ɡ": "g", "ı": "i", "∙": ".", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
}
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤︎️﻿"
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
DOTS, ATS, PLUS = ("dot", "punkt", "punto"), ("at", "arroba"), ("plus", "más")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ so that work stays linear."""
    out, done, at = [], 0, text.find("@")
    seen = 0
    while at >= 0:
        low = max(done, seen)
        start = low + len(text[low:at].rstrip(LOCAL))
        seen = at + 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", at + 1)
    return out


def _octets(s: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in s.split(".")))


def _luhn(s: str) -> bool:
    digits = [ord(c) - 48 for c in s if "0" <= c <= "9"]
    if not 16 <= len(digits) <= 19:
        return False
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans written openly, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and _luhn(m[0])]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


class Rewritten:
    """A text whose every character knows the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def apply(self, pattern: re.Pattern, replace: Callable[[re.Match], str | None]) -> None:
        """Rewrite each match; None leaves it as it is."""
        parts, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = replace(m)
            if new is None or m.end() == m.start():
                continue
            a, b = m.span()
            parts += [self.text[at:a], new]
            starts += [*self.starts[at:a], *[self.starts[a]] * len(new)]
            ends += [*self.ends[at:a], *[self.ends[b - 1]] * len(new)]
            at = b
        if at or parts:
            self.text = "".join([*parts, self.text[at:]])
            self.starts = [*starts, *self.starts[at:]]
            self.ends = [*ends, *self.ends[at:]]


def _plain_character(c: str) -> str | None:
    """ASCII that a character stands for: look-alikes, wide and styled forms, other digits."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in INVISIBLE:
        return ""
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    n = unicodedata.normalize("NFKC", c)
    return n if n != c and len(n) == 1 and n.isascii() and n.isprintable() else None


_ODD = re.compile(r"[^\x00-\x7fÀ-ſ]")  # beyond ASCII and the Latin letters of European languages
_SOFT = re.compile("­|ı")
_words = lambda words: "|".join(sorted(words, key=len, reverse=True))
_BRACKET_AT = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:@|{_words(ATS)})\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
_BRACKET_DOT = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:\.|{_words(DOTS)})\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
_SPOKEN_DOT = re.compile(rf"(?<=[A-Za-z0-9])\s{{1,3}}(?:{_words(DOTS)})\s{{1,3}}(?=[A-Za-z0-9])", re.I)
# A number with a decimal point ("priced at 9.99") is no host.
_SPOKEN_AT = re.compile(rf"(?<=[A-Za-z0-9])\s{{1,3}}(?:{_words(ATS)})\s{{1,3}}(?![0-9]++\.[0-9]++(?!\.?[A-Za-z0-9-]))(?=[A-Za-z0-9-]{{1,63}}(?:\.|\s{{1,3}}(?:{_words(DOTS)})\s{{1,3}})[A-Za-z0-9])", re.I)
_AT_WORD = re.compile(rf"\s(?:{_words(ATS)})\s", re.I)
_WORD_DIGIT = rf"(?:{_words(DIGIT_WORDS)})(?![^\W\d_])"
# Four digits at least, as an address of a host has; _digits asks for dots where there are fewer than seven.
_DIGITS_SPOKEN = re.compile(rf"(?<![^\W_])(?:(?:{_words(PLUS)})\s{{1,3}})?(?:{_WORD_DIGIT}|[0-9])(?:(?:[\s,-]{{1,3}}|\s{{1,3}}(?:{_words(DOTS)})\s{{1,3}}|\s?\.\s?)(?:{_WORD_DIGIT}|[0-9])){{3,}}+", re.I)
_FIRST_DIGIT = re.compile(_WORD_DIGIT, re.I)
_TOKEN = re.compile(rf"{_words(DIGIT_WORDS)}|{_words(DOTS)}|{_words(PLUS)}|[0-9]|\.", re.I)
_NUMBER_DOT = re.compile(rf"\s(?:{_words(DOTS)})\s|(?<=\s)\.|\.(?!\s)", re.I)  # not the full stop of "One. Two."
_LETTERS = re.compile(r"[^\W\d_]+")
_SPELLED = {w.encode() for w in DIGIT_WORDS}
#: ASCII letters in lower case, all else of ASCII as spaces.
_FLAT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))


def _fold(text: str) -> str:
    """Lower case as patterns without case take it: four more letters stand for i, s and k."""
    if not text.isascii():
        text = text.replace("İ", "i").replace("ı", "i").replace("ſ", "s").replace("\u212a", "k")
    return text.lower()


def _spells_digits(text: str) -> bool:
    """Whether four digits with a spelled one among them could be here: a count of whole words.

    Each spelled digit of a match is a whole run of letters, so this holds wherever the pattern matches.
    """
    if text.isascii():
        n = sum(map(_SPELLED.__contains__, text.encode().translate(_FLAT).split()))
    else:
        n = sum(map(DIGIT_WORDS.__contains__, _LETTERS.findall(_fold(text))))
    return n > 3 or n > 0 and n + len(_DIGIT.findall(text)) > 3


def _digits(m: re.Match) -> str | None:
    s = m[0]
    if not _FIRST_DIGIT.search(s):
        return None
    out = []
    for t in _TOKEN.findall(s):
        low = _fold(t)
        out.append("+" if low in PLUS else "." if low in DOTS or low == "." else DIGIT_WORDS.get(low, low))
    if sum(c not in "+." for c in out) < 7 and len(_NUMBER_DOT.findall(s)) < 3:
        return None
    return "".join(out)


def rewrite(text: str) -> Rewritten | None:
    """The text without disguises; None if it holds nothing that could be one."""
    r = Rewritten(text)
    if not text.isascii() and (_ODD.search(text) or _SOFT.search(text)):
        r.apply(_ODD, lambda m: _plain_character(m[0]))
        r.apply(_SOFT, lambda m: _plain_character(m[0]))
    low = r.text.lower()
    if any(c in low for c in "[({<"):
        r.apply(_BRACKET_AT, lambda m: "@")
        r.apply(_BRACKET_DOT, lambda m: ".")
    if _AT_WORD.search(r.text):
        r.apply(_SPOKEN_AT, lambda m: "@")
    if any(d in low for d in DOTS):
        r.apply(_SPOKEN_DOT, lambda m: ".")
    if _spells_digits(r.text):
        r.apply(_DIGITS_SPOKEN, _digits)
    return r if r.text != text else None


def spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain) in code points, by kind and start.

    Plain spans always stay; a disguised one is added unless a span of its kind covers it.
    """
    out = [(k, a, b, True) for k, a, b in plain_spans(text)]
    hidden = rewrite(text)
    if hidden is not None:
        taken: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        for k, a, b, _ in out:
            taken[k].append((a, b))
        for k, a, b in plain_spans(hidden.text):
            start, end = hidden.starts[a], hidden.ends[b - 1]
            if text[start:end] != hidden.text[a:b] and not any(s <= start and end <= e for s, e in taken[k]):
                taken[k].append((start, end))
                out.append((k, start, end, False))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())]))


def find(files: DataFrame) -> DataFrame:
    """(path, spans) per file: all personal data of its whole content, by kind and start.

    Null and empty contents have no spans.  One row per input row, so repeated and null paths
    stay; other columns are not read.
    """

    def run(batches):
        for batch in slices(batches):
            found = [[dict(zip(("kind", "start", "end", "plain"), s)) for s in spans(t)] for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, _SPANS)], ["path", "spans"])

    return files.select("path", "content").mapInArrow(run, f"path {key_type(files)}, spans array<{SPAN}>")


def redact(files: DataFrame) -> DataFrame:
    """The files with every span, plain or disguised, replaced by its kind in angle brackets.

    All columns stay as they are but ``content``.  Spans that overlap are replaced as one, named
    after the first.  Null contents stay null.
    """

    def clean(text: str) -> str:
        parts, at = [], 0
        for kind, start, end, _ in sorted(spans(text), key=lambda s: (s[1], -s[2])):
            if start >= at:
                parts += [text[at:start], f"<{kind}>"]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    def run(batches):
        for batch in slices(batches):
            new = [t if t is None else clean(t) for t in batch.column("content").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("content"), "content", pa.array(new, pa.string()))

    return files.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in files.schema.fields]))
