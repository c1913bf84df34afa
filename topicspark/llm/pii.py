"""Personal data found through disguises, at the places of the source text.

A transducer rewrites the disguised stretches of a text (homoglyphs and other
digits, invisible characters, spelled digits, "at" and "dot" in words or
brackets) and keeps, for each stretch, where it came from. The detectors that
run on the source run on its output too, and what they find is mapped back.
There are two readings: the strict one rewrites what is disguised throughout,
the wide one also what is disguised in part (one spelled digit beside numerals,
a word dot after a real @ or between numerals). What either shows counts.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import partial
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")

# --- detectors -----------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ so that long words cost no more than their length."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Of each run of dotted numbers every four in turn, if none is above 255."""
    out = []
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PLUS.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []


DETECTORS = dict(zip(KINDS, (emails, ips, cards, phones)))

# --- the transducer ------------------------------------------------------------

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "п": "n", "в": "b", "ь": "b",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "‚": ",", "。": ".", "․": ".", "·": ".", "٠": "0", "۰": "0",
}
# The digits' names in English, Spanish, French and German.
DIGIT_NAMES = (
    ("zero", "oh", "cero", "zéro", "null"), ("one", "uno", "un", "eins"), ("two", "dos", "deux", "zwei", "zwo"), ("three", "tres", "trois", "drei"),
    ("four", "cuatro", "quatre", "vier"), ("five", "cinco", "cinq", "fünf"), ("six", "seis", "sechs"), ("seven", "siete", "sept", "sieben"),
    ("eight", "ocho", "huit", "acht"), ("nine", "nueve", "neuf", "neun"),
)
DASHES, INVISIBLE = "‐‑‒–—―−", "­᠎​‌‍⁠﻿"
#: Spelled digits that must follow one another to count as such.
MIN_SPELLED = 3

_DIGIT_OF = {name: str(d) for d, names in enumerate(DIGIT_NAMES) for name in names}
_NAME = "(?:" + "|".join(sorted(_DIGIT_OF, key=len, reverse=True)) + ")"
_TIMES = {"double": 2, "doble": 2, "triple": 3}
_SPELLED = rf"(?:(?:double|doble|triple)\s+)?{_NAME}\b"
_BETWEEN = r"(?:\s*[,;-]\s*|\s+)"
_DOT_WORD = r"(?:\s+(?:dot|point|punkt|punto)\s+)"
_RUN = re.compile(rf"\b(?:(?P<plus>plus|más|mas)\s+)?{_SPELLED}(?:(?:{_DOT_WORD}|{_BETWEEN}){_SPELLED}){{{MIN_SPELLED - 1},}}", re.I)
_IN_RUN = re.compile(rf"(?P<dot>{_DOT_WORD})|(?:(?P<times>double|doble|triple)\s+)?\b(?P<digit>{_NAME})\b", re.I)
_PLUS_WORD = re.compile(r"\b(?:plus|más)\s+(?=[0-9])", re.I)
_BRACKET = re.compile(r"(?:\[\s*(?P<a>at|@|dot|\.|punkt|punto|point|arroba)\s*\]|\(\s*(?P<b>at|@|dot|\.|punkt|punto|point|arroba)\s*\)|\{\s*(?P<c>at|@|dot|\.|punkt|punto|point|arroba)\s*\}|<\s*(?P<d>at|dot|punkt|punto|point|arroba)\s*>)\s*", re.I)
_WORDS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?P<at>\s+(?:at|arroba)\s+)[A-Za-z0-9-]+(?P<dots>(?:\s+(?:dot|punkt|punto|point)\s+[A-Za-z0-9-]+)+)", re.I)
_DOT = re.compile(r"(?<!\s)\s+(?:dot|punkt|punto|point)\s+", re.I)
# the wide reading: numerals among spelled digits, real and bracketed signs among words
_LABEL = "[A-Za-z0-9-]++"


def _bracketed(words: str) -> str:
    return rf"\s*(?:\[\s*(?:{words})\s*\]|\(\s*(?:{words})\s*\)|\{{\s*(?:{words})\s*\}}|<\s*(?:{words})\s*>)\s*"


_DOT_BRACKET = _bracketed(r"dot|\.|punkt|punto|point")
_HIDDEN_DOT = rf"(?:{_DOT_WORD}|{_DOT_BRACKET})"
_MIXED = re.compile(rf"\b(?:(?P<plus>(?:plus|más|mas)\s+))?(?:{_SPELLED}|[0-9]++\b)(?:(?:{_HIDDEN_DOT}|\.|[\s,;()-]+)(?:{_SPELLED}|[0-9]++\b))*", re.I)
_IN_MIXED = re.compile(rf"(?P<dot>{_DOT_WORD})|(?P<kept>{_DOT_BRACKET}|\.)|(?:(?P<times>double|doble|triple)\s+)?\b(?P<digit>{_NAME})\b|(?P<numeral>[0-9]++)|(?P<between>[\s,;()-]+)", re.I)
_PART_WORDS = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:(?P<at>\s+(?:at|arroba|@)\s+)|@|{_bracketed('at|@|arroba')})"
                         rf"{_LABEL}(?P<dots>(?:\.{_LABEL})*{_HIDDEN_DOT}{_LABEL}(?:(?:\.|{_HIDDEN_DOT}){_LABEL})*)", re.I)
_OPEN = re.compile(r"[\[({<]\s*(?:@|\.|at|dot|pu|po|ar)", re.I)
_RUN_WORDS = frozenset(_DIGIT_OF) | frozenset(_TIMES) | {"dot", "point", "punkt", "punto"}
_DOT_WORDS, _AT_WORDS = frozenset({"dot", "punkt", "punto", "point"}), frozenset({"at", "arroba"})
_SEPARATORS = ",;-().+:/[]{}<>\"'!?=*#|“”‘’«»"
_ODD = re.compile("[ ­ª²³·¹ºı]|[^\x00-ɏ]")


def plain_char(c: str) -> str:
    """What a single character stands for; itself if nothing else."""
    if c in INVISIBLE:
        return ""
    if c in DASHES:
        return "-"
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    if c.isspace():
        return " "
    same = unicodedata.normalize("NFKC", c)
    return same if len(same) == 1 and same.isascii() else c


class Tape:
    """A rewritten text. ``edits`` are stretches (start, end, replacement) of
    ``source`` in order; positions map back stretch by stretch."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        out, at, place = [], 0, 0
        self.out_at, self.src_at, self.edited = [], [], []
        for s, e, r in edits:
            for piece, start, is_edit in ((source[at:s], at, False), (r, s, True)):
                if piece or is_edit:
                    self.out_at.append(place)
                    self.src_at.append((start, e if is_edit else s))
                    self.edited.append(is_edit)
                out.append(piece)
                place += len(piece)
            at = e
        self.out_at.append(place)
        self.src_at.append((at, len(source)))
        self.edited.append(False)
        out.append(source[at:])
        self.text = "".join(out)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source stretch of output [start, end), and whether an edit lies in it."""
        i, j = bisect_right(self.out_at, start) - 1, bisect_right(self.out_at, end - 1) - 1
        s = self.src_at[i][0] if self.edited[i] else self.src_at[i][0] + start - self.out_at[i]
        e = self.src_at[j][1] if self.edited[j] else self.src_at[j][0] + end - self.out_at[j]
        return s, e, any(self.edited[i:j + 1])


def _char_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), p) for m in _ODD.finditer(text) if (p := plain_char(m[0])) != m[0]]


def _run_edits(text: str) -> list[tuple[int, int, str]]:
    """Runs of spelled digits: digits with the separator before them, which goes."""
    edits = []
    for run in _RUN.finditer(text):
        first = True
        at = run.start()
        for m in _IN_RUN.finditer(text, run.start(), run.end()):
            if m["dot"]:
                r = "."
            else:
                r = _DIGIT_OF[m["digit"].lower()] * _TIMES.get((m["times"] or "").lower(), 1)
                if first and run["plus"]:
                    r = "+" + r
            edits.append((at, m.end(), r))
            at, first = m.end(), False
    return edits


def _mixed_edits(text: str) -> list[tuple[int, int, str]]:
    """Runs of spelled digits and numerals. Single digits close up; a numeral of
    several keeps a space to its neighbours, round brackets stay."""
    edits = []
    for run in _MIXED.finditer(text):
        parts = list(_IN_MIXED.finditer(text, run.end("plus") if run["plus"] else run.start(), run.end()))
        spelled = sum(m["digit"] is not None for m in parts)
        if spelled < MIN_SPELLED and not (any(m["numeral"] for m in parts) and (spelled or any(m["dot"] for m in parts))):
            continue
        if run["plus"]:
            edits.append((*run.span("plus"), "+"))
        for k, m in enumerate(parts):
            if m["dot"]:
                r = "."
            elif m["digit"]:
                r = _DIGIT_OF[m["digit"].lower()] * _TIMES.get((m["times"] or "").lower(), 1)
            elif m["between"]:
                long = any(len(parts[i]["numeral"] or "") > 1 for i in (k - 1, k + 1))
                r = "".join(c for c in m[0] if c in "()") or " " * long
            else:
                continue
            if r != m[0]:
                edits.append((*m.span(), r))
    return edits


def _beside(words: list[str], spelled: bytes) -> bool:
    """Whether a word of a run stands beside a numeral."""
    numeral = bytes(map(str.isdecimal, words))
    return 1 in numeral and (any(map(and_, spelled, numeral[1:])) or any(map(and_, spelled[1:], numeral)))


def _word_edits(text: str, wide: bool = False) -> list[tuple[int, int, str]]:
    low = text.lower()
    for c in _SEPARATORS:
        low = low.replace(c, " ")
    words = low.split()
    edits = []
    # each pattern is tried only where the words it needs stand in the text
    spelled = bytes(map(_RUN_WORDS.__contains__, words))
    run = b"\1" * MIN_SPELLED in spelled
    part = wide and 1 in spelled and _beside(words, spelled)
    if run or part:
        edits += _mixed_edits(text) if wide else _run_edits(text)
    if "plus" in low or "más" in low:
        edits += [(m.start(), m.end(), "+") for m in _PLUS_WORD.finditer(text)]
    open_ = _OPEN.search(text) is not None
    done = 0
    for m in _BRACKET.finditer(text) if open_ else ():
        word, start = (m["a"] or m["b"] or m["c"] or m["d"]).lower(), m.start()
        while start > done and text[start - 1].isspace():  # the blanks before it, each walked over once
            start -= 1
        edits.append((start, m.end(), "@" if word in ("at", "@", "arroba") else "."))
        done = m.end()
    dots, ats = not _DOT_WORDS.isdisjoint(words), not _AT_WORDS.isdisjoint(words)
    if wide:
        found = _PART_WORDS.finditer(text) if dots and (ats or open_ or "@" in text) or open_ and (ats or "@" in text) else ()
    else:
        found = _WORDS.finditer(text) if dots and ats else ()
    for m in found:
        if m["at"]:
            edits.append((*m.span("at"), "@"))
        edits += [(d.start(), d.end(), ".") for d in _DOT.finditer(text, *m.span("dots"))]
    edits.sort()
    out: list[tuple[int, int, str]] = []
    for e in edits:  # the first of overlapping edits stands
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def rewritten(text: str, wide: bool = False) -> list[Tape]:
    """The tapes from ``text`` to its normal form, one per pass that changes it."""
    tapes = []
    for edits_of in (_char_edits, partial(_word_edits, wide=wide)):
        if edits := edits_of(tapes[-1].text if tapes else text):
            tapes.append(Tape(tapes[-1].text if tapes else text, edits))
    return tapes


def find(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by start, kind, end."""
    base = {(s, k, e) for k, kind in enumerate(KINDS) for s, e in DETECTORS[kind](text)}
    spans = {x: True for x in base}
    seen = {text}
    for wide in (False, True):
        tapes = rewritten(text, wide)
        if not tapes or tapes[-1].text in seen:
            continue
        seen.add(tapes[-1].text)
        for k, kind in enumerate(KINDS):
            for s, e in DETECTORS[kind](tapes[-1].text):
                changed = False
                for tape in reversed(tapes):
                    s, e, here = tape.back(s, e)
                    changed |= here
                if changed:
                    spans.setdefault((s, k, e), False)
    return [(KINDS[k], s, e, b) for (s, k, e), b in sorted(spans.items())]


# --- over documents ------------------------------------------------------------

_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def _run(batches):
    for b in batches:
        found = [[{"kind": k, "start": s, "end": e, "base": own} for k, s, e, own in find(t or "")] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, _SPAN)], ["doc_id", "spans"])


def find_pii(docs: DataFrame) -> DataFrame:
    """<doc_id, spans> for each row of ``docs`` <doc_id, text>: the spans of the
    whole text by start, kind and end, in code points, end exclusive.

    ``base`` spans match the plain patterns in the source; the others come from
    its rewritten form and hold at least one rewritten stretch. Null and empty
    texts have none. Rows are independent: repeated rows and ids repeat their
    result, an empty table gives no rows, other columns are not read.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_run, f"doc_id {id_type}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, per document."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == F.lit(kind)))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """``text`` with each span, or union of overlapping spans, replaced by [KIND]."""
    out, at = [], 0
    for kind, s, e, _ in spans:
        if s >= at:
            out += text[at:s], f"[{kind.upper()}]"
        at = max(at, e)
    return "".join(out) + text[at:]
