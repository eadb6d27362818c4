"""Personal data: identifiers in plain and in disguised form, with spans of the source text.

Plain identifiers are found by one expression per kind.  Disguised ones go through three
transducers that rewrite a text piece by piece (look-alike characters to ASCII, spelled
digits to digits, ``[at]`` / ``dot`` to ``@`` / ``.``); each keeps, for every character it
writes, the source characters it stands for, so what the expressions find in the rewritten
text maps back to a span of the source.  A mapped span that touches a plain one is dropped:
the plain spans always stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callqc.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")

Span = tuple[str, int, int]

# The expressions of the kinds.  Possessive repeats and look-behinds change no match; they
# keep the search linear in very long runs of digits or letters.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: the run of local characters before an ``@``, then a dotted name."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield "email", start, end
        # a name cannot hold an @, so the next one is behind it
        at = text.find("@", max(at + 1, end))


def identifiers(text: str) -> list[Span]:
    """Plain identifiers of a text by start and kind; spans are code points, end exclusive."""
    found: list[Span] = []
    if "@" in text:
        found += _emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", *m.span()))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- transducers -------------------------------------------------------------------------

# Letters of other scripts that look like ASCII ones, and look-alike marks.
LOOK_ALIKES = {
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "ο": "o", "ν": "v", "ρ": "p", "α": "a", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "\u2024": ".", "\u2027": ".", "\u3002": ".", "\uff61": ".", "\u2010": "-", "\u2011": "-", "\u2013": "-", "\u2212": "-",
    "\u00a0": " ", "\u2007": " ", "\u202f": " ",
}
# Spelled digits.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
               "seven": "7", "eight": "8", "nine": "9"}
#: Characters that are written into a text to break up identifiers and are not seen.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"


def _plain(c: str) -> str | None:
    """ASCII form of a look-alike character: full width, mathematical and digits of any script."""
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    if c >= "\u2100":  # compatibility forms: full width, enclosed, mathematical letters
        form = unicodedata.normalize("NFKC", c)
        if len(form) == 1 and "!" <= form <= "~":
            return form
    return None


def _class_of(codes: list[int]) -> str:
    """A character class of sorted code points."""
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out) + "]"


_ALIKES = [c for c in range(0x80, 0x110000) if _plain(chr(c)) is not None]
#: Exactly the characters outside ASCII that ``_plain`` rewrites; those above U+FFFF, in many
#: ranges, are looked through only for characters there.
_ALIKE = re.compile(f"{_class_of([c for c in _ALIKES if c < 0x10000])}|(?=[\U00010000-\U0010ffff]){_class_of([c for c in _ALIKES if c >= 0x10000])}")
_SPELLED = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_SPELLED_RUN = re.compile(rf"(?<![A-Za-z0-9])(?:{_SPELLED}|[0-9])(?:[\x20-]{{1,2}}(?:{_SPELLED}|[0-9])){{3,}}(?![A-Za-z0-9])", re.I)
_SPELLED_ONE = re.compile(_SPELLED, re.I)
_PLUS = re.compile(rf"(?<![A-Za-z0-9])plus\x20(?=(?:{_SPELLED}|[0-9])(?![A-Za-z]))", re.I)
_BRACKETS = re.compile(r"\x20?[\[({<]\x20?(at|dot|@|\.)\x20?[\])}>]\x20?", re.I)
# a bare word is a disguise only as a whole address: name at host dot name (dot name)*
_SPOKEN = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:(?:\.|\x20dot\x20)[A-Za-z0-9_%+-]+){0,3}(\x20at\x20|@)"
    r"[A-Za-z0-9-]+(?:(?:\.|\x20dot\x20)[A-Za-z0-9-]+){0,4}(?:\.|\x20dot\x20)[A-Za-z]{2,}(?![A-Za-z0-9])", re.I)
_SPOKEN_MARK = re.compile(r"\x20(at|dot)\x20", re.I)
_SPOKEN_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:dot|\.)\x20?[0-9]{1,3}){3}(?![0-9.])", re.I)
_SPOKEN_DOT = re.compile(r"\x20?(?:dot|\.)\x20?", re.I)
_MARKS = {"at": "@", "@": "@", "dot": ".", ".": "."}


class Rewritten:
    """A text being rewritten; character i stands for ``source[begin[i]:end[i]]``."""

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, None, None
        self.changed = False

    def replace(self, changes: list[tuple[int, int, str]]) -> None:
        """Write each (start, end, new) in place; a new text's characters stand for the whole part."""
        if not changes:
            return
        if self.begin is None:
            self.begin, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        text, begin, end, at = [], [], [], 0
        for start, stop, new in changes:
            text += (self.text[at:start], new)
            begin += self.begin[at:start] + [self.begin[start]] * len(new)
            end += self.end[at:start] + [self.end[stop - 1]] * len(new)
            at = stop
        self.text = "".join((*text, self.text[at:]))
        self.begin, self.end = begin + self.begin[at:], end + self.end[at:]
        self.changed = True

    def source(self, start: int, stop: int) -> tuple[int, int]:
        return self.begin[start], self.end[stop - 1]


def _look_alikes(t: Rewritten) -> None:
    if not t.text.isascii():
        t.replace([(m.start(), m.end(), _plain(m[0])) for m in _ALIKE.finditer(t.text)])


def _spelled_digits(t: Rewritten) -> None:
    changes = []
    for run in _SPELLED_RUN.finditer(t.text):
        if _SPELLED_ONE.search(run[0]):
            parts = list(re.finditer(r"[A-Za-z]+|[0-9]", run[0]))
            for part, after in pairwise([*parts, None]):
                stop = after.start() if after else part.end()  # the gap goes with the digit before it
                changes.append((run.start() + part.start(), run.start() + stop, DIGIT_WORDS.get(part[0].lower(), part[0])))
    t.replace(changes)
    t.replace([(m.start(), m.end(), "+") for m in _PLUS.finditer(t.text)])


def _at_and_dot(t: Rewritten) -> None:
    t.replace([(m.start(), m.end(), _MARKS[m[1].lower()]) for m in _BRACKETS.finditer(t.text)])
    t.replace([(m.start() + x.start(), m.start() + x.end(), _MARKS[x[1].lower()])
               for m in _SPOKEN.finditer(t.text) for x in _SPOKEN_MARK.finditer(m[0])])
    t.replace([(m.start() + x.start(), m.start() + x.end(), ".")
               for m in _SPOKEN_IP.finditer(t.text) if re.search("dot", m[0], re.I) for x in _SPOKEN_DOT.finditer(m[0])])


#: In a text without look-alikes each change of the steps begins with one of these: a bracketed
#: mark; `` at `` or `` dot `` between words; a digit and ``dot``; two digits side by side, one of
#: them spelled; ``plus`` and a digit.  They only save time: without any, no step changes a text.
_TRIGGERS = tuple(re.compile(x, re.I) for x in (
    r"[\[({<]\x20?(?:at|dot|@|\.)\x20?[\])}>]", r"\x20(?:at|dot)\x20", r"[0-9]\x20?dot",
    rf"{_SPELLED}[\x20-]{{1,2}}(?:{_SPELLED}|[0-9])|[0-9][\x20-]{{1,2}}{_SPELLED}", rf"plus\x20(?:{_SPELLED}|[0-9])"))


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that only the rewritten text shows, as spans of the source, by start and kind."""
    alike = not text.isascii() and _ALIKE.search(text)
    return rewritten(text, base) if alike or any(x.search(text) for x in _TRIGGERS) else []


def rewritten(text: str, base: list[Span]) -> list[Span]:
    """``disguised`` without a first test."""
    t = Rewritten(text)
    for step in (_look_alikes, _spelled_digits, _at_and_dot):
        step(t)
    if not t.changed:
        return []
    found = [(kind, *t.source(a, b)) for kind, a, b in identifiers(t.text)]
    return in_order([s for s in set(found) if all(s[2] <= b[1] or s[1] >= b[2] for b in base)])


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain and added spans of a whole text."""
    base = identifiers(text or "")
    return base, disguised(text or "", base)


def listed(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every row: ``doc_id, base, added`` as arrays of ``kind, begin, end``.

    Spans are code points of the whole source text, end exclusive, by start and then kind
    (email, ip, card, phone).  A null or empty text has none.  Repeated rows keep a row each;
    an empty table gives an empty result; other columns are not read.
    """
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def rows(batches):
        for ids, texts in batches:
            found = [spans(t.decode("utf-8", "replace")) if t else ([], []) for t in texts]
            yield ids, *(pa.array([[dict(zip(("kind", "begin", "end"), s, strict=True)) for s in own] for own in side], kind)
                         for side in zip(*found, strict=True))

    span = "array<struct<kind:string,begin:bigint,end:bigint>>"
    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], "text",
                     f"doc_id {docs.schema[id_col].dataType.simpleString()}, base {span}, added {span}", rows)


def _text_of(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def _place(kind: Column) -> Column:
    return F.array_position(F.lit(list(KINDS)), kind)


def report(found: DataFrame) -> DataFrame:
    """Counts by kind (plain and added), digest of the plain spans and the list of all spans."""
    keyed = F.transform(F.concat("base", "added"), lambda s: F.struct(s["begin"], _place(s["kind"]), s["end"], s["kind"].alias("kind")))
    found = found.withColumn("every", F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["begin"], s["end"])))

    def count(kind: str) -> Column:
        return F.size(F.filter("every", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_text_of("base").cast("binary"), 256).alias("base_sha256"),
                        _text_of("every").alias("spans"))


def masked(text: str | None, found: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets (overlapping spans: the first)."""
    out, at = [], 0
    for kind, a, b in found:
        if a >= at:
            out += ((text or "")[at:a], f"<{kind}>")
            at = b
    return "".join(out) + (text or "")[at:]
