"""Personal data, plain and disguised, as spans of the source text.

Transducers rewrite a text - look-alike letters and digits to ASCII, spelled digits to
figures, ``at`` and ``dot`` disguises to signs - and note for every written character the source
characters that it comes from. Detection runs on both the source and the
rewritten text; what is found there maps back to source spans and is added unless a plain span of its kind covers it.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomline.llm.common import chunks, small_batches

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# Letters of other scripts that look like ASCII letters.
LOOK_ALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABESIJKMHOPCTYXaesijopcyxdqwABEZHIKMNOPTYXoav"))
# Marks of other forms that stand for an ASCII sign.
SIGN_FORMS = {"﹫": "@", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-"}
# Characters without width.
ZERO_WIDTH = "­​‌‍⁠﻿"
# Digit words in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Digits that a row of digit words must spell to count.
MIN_SPELLED = 7
#: Different digits in such a row.
MIN_DISTINCT = 3

_FOREIGN = re.compile("[" + re.escape("".join(LOOK_ALIKES) + "".join(SIGN_FORMS) + ZERO_WIDTH) + "！-～٠-٩۰-۹०-९\U0001d7ce-\U0001d7ff]")
_WORD_DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w))) + "|[0-9])"
_SPELLED = re.compile(rf"(?<!\w)(?:plus[\x20-])?{_WORD_DIGIT}(?:[\x20-]{_WORD_DIGIT}){{{MIN_SPELLED - 1},}}(?!\w)", re.IGNORECASE)
_MAYBE_SPELLED = re.compile(rf"(?<!\w){_WORD_DIGIT}[\x20-]{_WORD_DIGIT}[\x20-]{_WORD_DIGIT}(?!\w)", re.IGNORECASE)
_BOXED = re.compile(r"\x20?[\[({<]\x20?(at|@|dot|\.)\x20?[\])}>]\x20?", re.IGNORECASE)
_TALKED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: dot [A-Za-z0-9_%+-]{1,64}){0,4}(@| at (?!(?:the|an?|this|that|its|his|her|my|our|your|their) ))"
    r"([A-Za-z0-9-]{1,63}(?:(?:\.| dot )[A-Za-z0-9-]{1,63}){1,34})(?![A-Za-z0-9-])", re.IGNORECASE
)
_AT = re.compile(r"[ ](?i:at)[ ](?=[A-Za-z0-9-]{1,63}\.)")
_HANDLE = re.compile(r"(?<![A-Za-z0-9._%+-])(?=[A-Za-z]*[0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\Z")
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,5}\.[A-Za-z]{2,24}(?![A-Za-z0-9@-])")
_TALKED_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?: ?dot ?|\.)[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)
_SIGN = re.compile(r" (at|dot) ", re.IGNORECASE)
_IP_SIGN = re.compile(r" ?dot ?", re.IGNORECASE)
_PART = re.compile(r"[\x20-]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of undisguised data, leftmost and non-overlapping for each kind, in linear time."""
    out = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL_SIGNS:
                start -= 1
            if start < m.start():
                end = m.end()
                out.append((start, 0, end))
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


class Tape:
    """A text under rewriting, and for places in it the places in the source that they come from.

    Only the pieces that rewriting made are kept, so a long text with few disguises needs little more than itself.
    """

    def __init__(self, text: str):
        self.text = text
        #: Of every piece: where it begins here, where in the source, and where its source ends; -1 there for a piece copied from the source.
        self.at, self.start, self.end = array("q", [0]), array("q", [0]), array("q", [-1])

    def _source(self, place: int, ends: bool) -> int:
        """Where the source of the character at ``place`` starts or ends."""
        i = bisect_right(self.at, place) - 1
        if self.end[i] >= 0:
            return self.end[i] if ends else self.start[i]
        return self.start[i] + place - self.at[i] + ends

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the source that [start, end) comes from; it is not empty."""
        return self._source(start, False), self._source(end - 1, True)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) by a string, for disjoint edits in order; one pass over edits and pieces."""
        if not edits:
            return
        text, at, start, end = [], array("q"), array("q"), array("q")
        size = done = piece = 0

        def copy(until: int) -> None:
            nonlocal size, piece
            place = done
            while place < until:
                while piece + 1 < len(self.at) and self.at[piece + 1] <= place:
                    piece += 1
                stop = min(until, self.at[piece + 1] if piece + 1 < len(self.at) else until)
                at.append(size)
                start.append(self.start[piece] if self.end[piece] >= 0 else self.start[piece] + place - self.at[piece])
                end.append(self.end[piece])
                size += stop - place
                place = stop

        for a, b, put in edits:
            copy(a)
            text.append(self.text[done:a])
            if put:
                s, e = self.source(a, b)
                at.append(size)
                start.append(s)
                end.append(e)
                size += len(put)
                text.append(put)
            done = b
        copy(len(self.text))
        text.append(self.text[done:])
        self.at, self.start, self.end = (at, start, end) if at else (array("q", [0]), array("q", [0]), array("q", [-1]))
        self.text = "".join(text)


def _fold_letters(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _FOREIGN.finditer(text):
        c = m[0]
        if c in ZERO_WIDTH:
            put = ""
        elif c in LOOK_ALIKES:
            put = LOOK_ALIKES[c]
        elif c in SIGN_FORMS:
            put = SIGN_FORMS[c]
        elif "！" <= c <= "～":
            put = chr(ord(c) - 0xFEE0)
        else:
            put = str(unicodedata.digit(c))
        edits.append((m.start(), m.end(), put))
    return edits


def _unbox(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "@" if m[1].lower() in ("at", "@") else ".") for m in _BOXED.finditer(text)]


def _written(edits: list[tuple[int, int, str]]) -> set[int]:
    """Where the signs of edits stand after the rewriting."""
    out, shift = set(), 0
    for a, b, put in edits:
        out.add(a + shift)
        shift += len(put) - (b - a)
    return out


def _unsay(text: str, boxed: set[int]) -> list[tuple[int, int, str]]:
    """Spoken signs of an address whose ``@`` or a dot of whose host was in brackets or is spoken, and of an IP address; ``boxed`` tells where signs in brackets stood."""
    edits = []
    for m in _TALKED.finditer(text):
        spoken = _SIGN.search(m[2]) or any(text[i] == "." and i in boxed for i in range(m.start(2), m.end(2)))
        if spoken or m.start(1) in boxed:
            edits += [(m.start() + s.start(), m.start() + s.end(), "@" if s[1].lower() == "at" else ".") for s in _SIGN.finditer(m[0])]
    for m in _TALKED_IP.finditer(text):
        edits += [(m.start() + s.start(), m.start() + s.end(), ".") for s in _IP_SIGN.finditer(m[0])]
    edits.sort()
    return [e for i, e in enumerate(edits) if not i or e[0] >= edits[i - 1][1]]


def _unspoken_at(text: str) -> list[tuple[int, int, str]]:
    """``at`` between what looks like a user's name (with a digit or sign in it) and a host's name."""
    return [(m.start(), m.end(), "@") for m in _AT.finditer(text) if _HOST.match(text, m.end()) and _HANDLE.search(text, max(0, m.start() - 66), m.start())]


def _unspell(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED.finditer(text):
        words = _PART.split(m[0])
        put = "".join("+" if w.lower() == "plus" else DIGIT_WORDS.get(w.lower(), w) for w in words)
        if len(set(put)) >= MIN_DISTINCT and any(w.lower() in DIGIT_WORDS for w in words):  # not one article or number said again and again
            edits.append((m.start(), m.end(), put))
    return edits


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and plain and disguised ones."""
    base = plain_spans(text)
    tape, spelled = Tape(text), []
    if not text.isascii() and _FOREIGN.search(text):
        tape.rewrite(_fold_letters(text))
    low = tape.text.lower()
    boxed = _unbox(tape.text)
    tape.rewrite(boxed)
    if boxed or "dot" in low:
        tape.rewrite(_unsay(tape.text, _written(boxed)))
    if " at " in low:
        tape.rewrite(_unspoken_at(tape.text))
    if _MAYBE_SPELLED.search(tape.text):
        spelled = _unspell(tape.text)
        tape.rewrite(spelled)
    if tape.text == text:
        return base, base
    found = list(base)
    plain = [[(a, b) for a, kind, b in base if kind == k] for k in range(len(KINDS))]
    reach = [0] * len(KINDS)
    extra = plain_spans(tape.text)
    # a row of spelled digits without a plus is a phone number if its length allows it, where nothing else was found
    shift, i, covered = 0, 0, 0
    phones = []
    for a, b, put in spelled:
        a += shift
        shift += len(put) - (b - (a - shift))
        while i < len(extra) and extra[i][0] <= a:
            covered = max(covered, extra[i][2])
            i += 1
        if put.isdigit() and 9 <= len(put) <= 15 and covered <= a:
            phones.append((a, 3, a + len(put)))
    for s, k, e in sorted(extra + phones):
        start, end = tape.source(s, e)
        i = bisect_right(plain[k], (start, len(text))) - 1
        if text[start:end] == tape.text[s:e] or start < reach[k] or i >= 0 and plain[k][i][1] >= end:
            continue
        found.append((start, k, end))
        reach[k] = end
    return base, sorted(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))
    for batch, texts in chunks(batches, "text"):
        rows = []
        for text in texts:
            base, found = all_spans(text.decode())
            plain = set(base)
            rows.append([{"kind": KINDS[k], "start": s, "end": e, "plain": (s, k, e) in plain} for s, k, e in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: an array of (kind, start, end, plain) for every whole text, by start and then kind.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Offsets count code points, the end is exclusive.
    Null and empty texts have no spans. Every input row gives one row, repeated rows and null ids too. A very long text is read whole, in
    time in proportion to its length; besides the text, its spans and a few numbers for each disguise are held. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_scan, "doc_id long, spans array<struct<kind:string,start:long,end:long,plain:boolean>>")
