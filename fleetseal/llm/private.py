"""Find personal data, also where it is disguised, at its place in the source text.

Plain identifiers are found in the text as it stands. Then transducers rewrite a copy: look-alike characters become ASCII,
invisible ones go, "[at]" and "(dot)" become signs, spelled digits become digits. Each keeps a list of its edits, so that what
is found in the rewritten copy is mapped back, edit by edit, to source characters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("plain", "boolean"))

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters that look like a Latin letter.
_LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТХУаеіјорѕсухԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανι", "ABESIJKMHOPCTXYaeijopscyxdqwhABEZHIKMNOPTYXoavi", strict=True))
# Spelled digits and signs.
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_SIGNS = {"plus": "+", "dot": ".", "point": ".", "dash": "-", "hyphen": "-"}

_INVISIBLE = re.compile("[­​-‏⁠﻿]+")
_BRACKETED = re.compile(r"(?<=[A-Za-z0-9_%+-])\s*[\[({<]\s*(at|@|dot|\.)\s*[\])}>]\s*(?=[A-Za-z0-9])", re.I)
_SPOKEN = re.compile(r"(?<=[A-Za-z0-9_%+-])\s+at\s+(?=[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)+)", re.I)
# Before a plain domain the word is taken for a sign only if the name is no ordinary word: letters with a digit, dot or underscore inside.
_NAMED = re.compile(r"(?<=[A-Za-z0-9])\s+at\s+(?=[A-Za-z0-9-]+\.[A-Za-z]{2,})", re.I)
_NAME_BEFORE = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_DOT_AFTER = re.compile(r"(?<=[A-Za-z0-9-])\s+dot\s+(?=[A-Za-z0-9-])", re.I)
_DOT_CHAIN = re.compile(r"(?<=@)[A-Za-z0-9-]+(?:(?:\s+dot\s+|\.)[A-Za-z0-9-]+)+|(?<![0-9])[0-9]{1,3}(?:\s+dot\s+[0-9]{1,3}){3}(?![0-9])", re.I)
# Spoken dots within a name; they count only if a sign follows that is written or stands in brackets.
_NAME_CHAIN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\s+dot\s+[A-Za-z0-9._%+-]++)++", re.I)
_SIGN_NEXT = re.compile(r"@[A-Za-z0-9-]|\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*[A-Za-z0-9]", re.I)
_NAME_DOT = re.compile(r"\s+dot\s+", re.I)
_ANY_DIGIT_WORD = re.compile(r"\b(?:%s)\b" % "|".join(_DIGITS), re.I)
_ITEM = r"(?:%s|[0-9]+)" % "|".join(_DIGITS)
_SIGN = r"(?:%s)" % "|".join(_SIGNS)
_RUN = re.compile(rf"(?:\bplus[\s,-]+|\+\s?)?\b{_ITEM}(?:[\s,.-]+(?:{_SIGN}[\s,.-]+)?{_ITEM})++\b", re.I)
_PART = re.compile(rf"{_ITEM}|{_SIGN}|[+.]", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their sign: the name is what stands before it, back to the last match."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        domain, begin = _DOMAIN.match(text, at), at
        if domain:
            while begin > done and text[begin - 1] in _LOCAL:
                begin -= 1
        if begin < at:
            done = domain.end()
            found.append((begin, done))
        at = text.find("@", done if begin < at else at + 1)
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of every plain identifier, in that order."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


class Rewrite:
    """A rewritten text and its edits; maps spans of it back to the text before."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        """``edits``: (start, end, replacement), ascending and apart from each other."""
        parts, at, place = [], 0, 0
        self._begin, self._edits = [], []
        for start, end, new in edits:
            parts += [text[at:start], new]
            place += start - at
            self._begin.append(place)
            self._edits.append((place + len(new), start, end))
            place, at = place + len(new), end
        self.text = "".join([*parts, text[at:]])

    def _source(self, place: int, side: int) -> int:
        """Where the character at ``place`` begins (side 0) or ends (side 1) in the text before."""
        i = bisect_right(self._begin, place) - 1
        if i < 0:
            return place + side
        after, start, end = self._edits[i]
        if place < after:
            return end if side else start
        return place - after + end + side

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self._source(start, 0), self._source(end - 1, 1)


@lru_cache(maxsize=1 << 16)
def _ascii_like(char: str) -> str:
    if char in _LOOKALIKES:
        return _LOOKALIKES[char]
    plain = unicodedata.normalize("NFKC", char)
    if len(plain) == 1 and plain.isascii() and not plain.isspace():
        return plain
    return str(unicodedata.digit(char)) if unicodedata.digit(char, -1) >= 0 else char


def _homoglyphs(text: str) -> str:
    """One character for one, so places stay."""
    if text.isascii():
        return text
    changed = {ord(c): like for c in set(text) if not c.isascii() and (like := _ascii_like(c)) != c}
    return text.translate(changed) if changed else text


def _invisible(text: str) -> list[tuple[int, int, str]]:
    return [] if text.isascii() else [(m.start(), m.end(), "") for m in _INVISIBLE.finditer(text)]


def _signs(text: str) -> list[tuple[int, int, str]]:
    edits = [(m.start(), m.end(), "@" if m[1].lower() in ("at", "@") else ".") for m in _BRACKETED.finditer(text)]
    edits += [(m.start(), m.end(), "@") for m in _SPOKEN.finditer(text)]
    for m in _NAMED.finditer(text):
        name = _NAME_BEFORE.search(text, max(0, m.start() - 64), m.start())
        if name and re.search("[A-Za-z]", name[0]) and re.search("[A-Za-z0-9][0-9._][A-Za-z0-9]?", name[0]):
            edits.append((m.start(), m.end(), "@"))
    return _apart(edits)


def _name_dots(text: str) -> list[tuple[int, int, str]]:
    if "dot" not in text.lower():
        return []
    return [(m.start(), m.end(), ".") for chain in _NAME_CHAIN.finditer(text) if _SIGN_NEXT.match(text, chain.end())
            for m in _NAME_DOT.finditer(text, chain.start(), chain.end())]


def _dots(text: str) -> list[tuple[int, int, str]]:
    """Spoken dots count within a domain after its sign, and between the four parts of an address."""
    return [(chain.start() + m.start(), chain.start() + m.end(), ".") for chain in _DOT_CHAIN.finditer(text) for m in _DOT_AFTER.finditer(chain[0])]


def _digits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _RUN.finditer(text) if _ANY_DIGIT_WORD.search(text) else ():
        parts = _PART.findall(run[0])
        if sum(p.lower() in _DIGITS for p in parts) >= 3:
            edits.append((run.start(), run.end(), "".join(_DIGITS.get(p.lower(), _SIGNS.get(p.lower(), p)) for p in parts)))
    return edits


def _apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    kept, at = [], 0
    for start, end, new in sorted(edits):
        if start >= at:
            kept.append((start, end, new))
            at = end
    return kept


_TRANSDUCERS = (_invisible, _digits, _name_dots, _signs, _dots)


def disguised(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifiers that the rewritten text shows, as spans of the source, but for those inside a plain one of their kind.

    A plain one may be a fragment of a disguised one; both are found then.
    """
    now, rewrites = _homoglyphs(text), []
    swapped = now is not text and now != text
    for transducer in _TRANSDUCERS:
        if edits := transducer(now):
            rewrites.append(Rewrite(now, edits))
            now = rewrites[-1].text
    if not swapped and not rewrites:
        return []
    taken = {kind: [(a, b) for a, k, b in plain if k == kind] for kind in range(len(KINDS))}
    found = []
    for start, kind, end in identifiers(now):
        for rewrite in reversed(rewrites):
            start, end = rewrite.back(start, end)
        own = taken[kind]
        i = bisect_right(own, (start, len(text))) - 1  # plain ones of a kind lie apart
        if i < 0 or own[i][1] < end:
            found.append((start, kind, end))
    return sorted(set(found))


@F.arrow_udf(SPANS)
def _find(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts:
        text = text.as_py() or ""
        plain = identifiers(text)
        both = [(*s, True) for s in plain] + [(*s, False) for s in disguised(text, plain)]
        rows.append([{"kind": KINDS[k], "start": a, "end": b, "plain": p} for a, k, b, p in sorted(both)])
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())])
    return pa.array(rows, pa.list_(struct))


@F.arrow_udf(T.StringType())
def _mask(texts: pa.Array, spans: pa.Array) -> pa.Array:
    rows = []
    for text, found in zip(texts, spans, strict=True):
        text, found = text.as_py(), found.as_py()
        parts, at = [], 0
        for span in found or ():
            if span["end"] <= at:
                continue
            if span["start"] >= at:
                parts += [text[at:span["start"]], f"[{span['kind'].upper()}]"]
            at = span["end"]
        rows.append(text if not found else "".join([*parts, text[at:]]))
    return pa.array(rows, pa.string())


def find(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """Add every span of personal data, (kind, start, end, plain) by start, then kind; places are code points, end exclusive.

    A null or empty text has none. Repeated rows and other columns stay as they are; a column called ``into`` is replaced.
    """
    return docs.withColumn(into, _find(F.col(text)))


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span in ``text`` by the name of its kind in brackets; overlapping spans become one. Null stays null."""
    return find(docs, text, "__spans").withColumn(text, _mask(F.col(text), F.col("__spans"))).drop("__spans")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
