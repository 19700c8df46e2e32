"""Personal data in texts, disguised or not, as spans of the source's characters.

Two transducers rewrite a text while keeping track of where each output character came from.  The
first works on characters: invisible ones vanish, digits of other scripts, full-width forms and
letters that look like Latin ones become ASCII.  The second works on words: spelled digits, and
disguised ``@`` and ``.``, become what they stand for.  The same detectors then read the source and the
rewritten text; spans found in the latter are carried back through both alignments.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormframe.llm.common import text_batches

KINDS = ("email", "ip", "card", "phone")

# ---------------------------------------------------------------- detectors

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Characters looked at together when a mail's first part is searched backwards.
_STEP = 64


def _local_start(text: str, at: int, least: int) -> int:
    """Where the run of local characters before ``at`` begins, not before ``least``."""
    end = at
    while end > least:
        lo = max(least, end - _STEP)
        other = None
        for other in _NOT_LOCAL.finditer(text, lo, end):
            pass
        if other is not None:
            return other.end()
        end = lo
    return end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    least = 0
    for domain in _DOMAIN.finditer(text):
        start = _local_start(text, domain.start(), least)
        if start < domain.start():
            yield start, domain.end()
            least = domain.end()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            yield m.span()


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


_DETECTORS = (_emails, _ips, _cards, _phones)


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of what stands openly in ``text``, leftmost and apart per kind, in order of start and kind."""
    found = []
    for kind, spans in enumerate(_DETECTORS):
        found += [(start, kind, end) for start, end in spans(text)]
    return sorted(found)


# ---------------------------------------------------------------- transducers

# Greek, Cyrillic and other letters and marks that look like ASCII ones.
LOOKALIKES = {
    **dict(zip("АВЕЅІЈКМНОРСТХаеѕіјорсухԁԛԝһӏ", "ABESIJKMHOPCTXaesijopcyxdqwhl", strict=True)),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιρ", "ABEZHIKMNOPTYXoavip", strict=True)),
    **dict(zip("ıɑɡ։。｡٠·", "iag:..0.", strict=True)),
}
_LAST_SCRIPT = 0x20000


def _plain(c: str) -> str:
    """What a character stands for in an identifier; itself, if nothing else."""
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Nd":
        return str(unicodedata.decimal(c))
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if kind in ("Zs", "Pd"):
        return " " if kind == "Zs" else "-"
    whole = unicodedata.normalize("NFKC", c)
    return whole if len(whole) == 1 and whole.isascii() and whole.isprintable() else c


_ODD = {c: p for c in map(chr, range(0x80, _LAST_SCRIPT)) if unicodedata.category(c) != "Cs" and (p := _plain(c)) != c}
_ODD_CHARACTER = re.compile("[" + "".join(map(re.escape, _ODD)) + "]")
#: Anything but ASCII and the accented letters that hold no odd one; quicker to look for.
_FOREIGN = re.compile("[^\\x00-\\x7f\\xc0-\u0130]")

# Number words of four languages, by the digit they name.
DIGIT_WORDS = (
    ("zero", "null", "zéro", "cero"),
    ("one", "eins", "un", "uno"),
    ("two", "zwei", "deux", "dos"),
    ("three", "drei", "trois", "tres"),
    ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"),
    ("seven", "sieben", "sept", "siete"),
    ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
_VALUE = {w: str(d) for d, words in enumerate(DIGIT_WORDS) for w in words}
_TIMES = {"double": 2, "triple": 3}
#: Spelled digits in a row that are taken as a number.
SPELLED = 3

_ONE = "(?:(?:double|triple) )?(?:" + "|".join(sorted(_VALUE, key=len, reverse=True)) + r")(?!\w)"
_DOT_IN_BRACKETS = r"\s{0,3}[(\[{<]\s{0,3}(?:dot|\.|punto|punkt|point)\s{0,3}[)\]}>]\s{0,3}|&#0{0,3}46;|&period;"
_DOT_AS_WORD = r"(?<=\w)(?:\s{1,3}(?:dot|punto|punkt|point)\s{1,3}|[_-]dot[_-])(?=\w)"
_ANY_DOT = f"(?:{_DOT_IN_BRACKETS}|{_DOT_AS_WORD})"
_AT_IN_BRACKETS = r"\s{0,3}[(\[{<]\s{0,3}(?:at|@|arroba)\s{0,3}[)\]}>]\s{0,3}|&#0{0,3}64;|&commat;"
# A bare word counts only before a name with a dot, disguised or not.
_AT_AS_WORD = rf"(?<=\w)(?:\s{{1,3}}(?:at|@|arroba)\s{{1,3}}|[_-]at[_-])(?=[a-z0-9-]{{1,63}}(?:\.|{_ANY_DOT})[a-z0-9])"
_BETWEEN = rf"(?:[\s(),-]{{1,4}}|\.|{_ANY_DOT})"
_WORDS = re.compile(
    rf"(?P<digits>(?<!\w){_ONE}(?:{_BETWEEN}{_ONE}){{{SPELLED - 2},}})"
    rf"|(?P<plus>(?<!\w)(?:plus|más)\s{{1,3}}(?=\d|{_ONE}))"
    rf"|(?P<at>{_AT_IN_BRACKETS})|(?P<bare>{_AT_AS_WORD})|(?P<dot>{_DOT_IN_BRACKETS})|(?P<word>{_DOT_AS_WORD})"
    r"|(?P<mixed>(?<![^\W_])(?=[oil]*\d)[\doil]*[oil][\doil]*(?![^\W_])|(?<=\d\.)[oil](?=\.\d))",
    re.IGNORECASE,
)
_INSIDE = re.compile(rf"(?P<times>(?:double|triple) )?(?P<one>{'|'.join(sorted(_VALUE, key=len, reverse=True))})(?!\w)|(?P<dot>\.|{_ANY_DOT})", re.IGNORECASE)
_LETTER_DIGITS = str.maketrans("oOiIlL", "001111")
#: What a bare word between a name and a domain needs on its left, unless the domain's dot is disguised too.
_NAMELIKE = re.compile(r"[A-Za-z0-9][._+-][a-z0-9]|^[A-Z][A-Za-z]*[._+-][A-Z]|[A-Za-z][A-Za-z._-]*[0-9]")

# What a text must hold for the word transducer to find anything; all are cheap to look for.
_SIGNS = ("arroba", "&#", "&commat;", "&period;")
_DOT_WORDS = ("dot", "punto", "punkt", "point")
_DOT_WORD = re.compile(rf"[\s_(\[{{<-](?:{'|'.join(_DOT_WORDS)})[\s_)\]}}>-]")
_SIGN = re.compile(r"at\s{1,3}[a-z0-9-]{1,63}\.[a-z0-9]|at[_-][a-z0-9-]{1,63}\.[a-z0-9]")
_BRACKETED = re.compile(r"[(\[{<]\s{0,3}(?:at|@|\.)")
_SPACED = re.compile(r"@\s")
_MIXED = re.compile(r"\d\.?[oil]|[oil]\d")
_PLUS = re.compile(r"(?:plus|más)\s{1,3}\d")
_SPELLED_WORDS = frozenset(_VALUE) | frozenset(_TIMES)


class Rewritten:
    """A text made from another by replacing pieces, and the way back.

    ``at`` and ``source`` are where each stretch begins in the new and in the old text; a stretch is
    copied, or stands as a whole for ``taken`` characters of the old text.
    """

    def __init__(self, text: str, edits: Iterator[tuple[int, int, str]]) -> None:
        self.at, self.source, self.taken = [], [], []
        parts: list[str] = []
        size = done = 0
        for start, end, made in edits:
            for piece, where, taken in ((text[done:start], done, -1), (made, start, end - start)):
                if piece:
                    self.at.append(size)
                    self.source.append(where)
                    self.taken.append(taken)
                    parts.append(piece)
                    size += len(piece)
            done = end
        if done < len(text):
            self.at.append(size)
            self.source.append(done)
            self.taken.append(-1)
            parts.append(text[done:])
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The old text's span behind a span of the new one."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first = self.source[i] + (0 if self.taken[i] >= 0 else start - self.at[i])
        last = self.source[j] + (self.taken[j] if self.taken[j] >= 0 else end - self.at[j])
        return first, last


def _character_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _ODD_CHARACTER.finditer(text):
        yield m.start(), m.end(), _ODD[m[0]]


def _word_edits(text: str, marks: dict[int, str]) -> Iterator[tuple[int, int, str]]:
    """Edits of the second transducer; ``marks`` learns which places of the old text held a disguised sign."""
    for m in _WORDS.finditer(text):
        kind = m.lastgroup
        if kind == "digits":
            found = list(_INSIDE.finditer(m[0]))
            if sum(_TIMES.get((d["times"] or "").strip().lower(), 1) for d in found if d["one"]) < SPELLED:
                continue
            last = 0
            for d in found:
                if d.start() > last:
                    yield m.start() + last, m.start() + d.start(), ""
                made = "." if d["dot"] else _VALUE[d["one"].lower()] * _TIMES.get((d["times"] or "").strip().lower(), 1)
                yield m.start() + d.start(), m.start() + d.end(), made
                last = d.end()
        elif kind == "mixed":
            if len(m[0]) == 1 or 2 * len(_DIGIT.findall(m[0])) >= len(m[0]):
                yield m.start(), m.end(), m[0].translate(_LETTER_DIGITS)
        else:
            marks[m.start()] = "dot" if "@" in m[0] else kind
            yield m.start(), m.end(), {"plus": "+", "at": "@", "bare": "@", "dot": ".", "word": "."}[kind]


def _may_be_disguised(text: str) -> bool:
    """Whether the transducers can change anything in ``text`` that an identifier may stand in."""
    if not text.isascii() and _FOREIGN.search(text) and _ODD_CHARACTER.search(text):
        return True
    low = text.lower()
    if any(sign in low for sign in _SIGNS) or (any(w in low for w in _DOT_WORDS) and _DOT_WORD.search(low)) or any(p.search(low) for p in (_SIGN, _BRACKETED, _SPACED, _MIXED, _PLUS)):
        return True
    for mark in "-,().":
        low = low.replace(mark, " ")
    words = low.split()
    spelled = [i for i, w in enumerate(words) if w in _SPELLED_WORDS]
    return any(c - a < 4 * SPELLED for a, c in zip(spelled, spelled[SPELLED - 1 :], strict=False))


def _disguised(text: str) -> Iterator[tuple[int, int, int]]:
    """``(start, kind, end)`` in ``text`` of identifiers that only the rewritten text shows."""
    first = Rewritten(text, _character_edits(text))
    marks: dict[int, str] = {}
    second = Rewritten(first.text, _word_edits(first.text, marks))
    if second.text == text:
        return
    for start, kind, end in identifiers(second.text):
        inner = second.back(start, end)
        span = first.back(*inner)
        shown = second.text[start:end]
        if text[span[0] : span[1]] == shown:
            continue
        if kind == 0:
            at = shown.index("@")
            sign = marks.get(second.back(start + at, start + at + 1)[0])
            dots = [marks.get(second.back(start + i, start + i + 1)[0]) for i in range(at, len(shown)) if shown[i] == "."]
            if sign == "bare" and not any(dots) and not _NAMELIKE.search(shown[:at]) or shown.lower().endswith((".dot", ".at")):
                continue
        yield span[0], kind, span[1]


def personal_data(text: str) -> list[tuple[int, int, int, bool]]:
    """``(start, kind, end, open)`` in order of start and kind: what stands openly, and what is disguised and no part of that."""
    base = identifiers(text)
    found = [(*b, True) for b in base]
    if not _may_be_disguised(text):
        return found
    for start, kind, end in _disguised(text):
        if not any(k == kind and s <= start and end <= e for s, k, e in base):
            found.append((start, kind, end, False))
    return sorted(found)


SPANS = "array<struct<kind: string, start: long, end: long, open: boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("open", pa.bool_())]))


def detect(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` of every row, in order of start and then kind.

    A span has code points of the source, its end exclusive; ``open`` ones stand undisguised in the
    text, and all of these are there.  A disguised one may reach over an open one that is its part.
    Null and empty texts have no spans; repeated rows and rows without an id are read each; other
    columns play no part.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_batches(whole, "text")):
            spans = [
                [{"kind": KINDS[k], "start": s, "end": e, "open": o} for s, k, e, o in personal_data(t)] if t else []
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPAN_TYPE)], ["doc_id", "spans"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, f"doc_id long, spans {SPANS}")
