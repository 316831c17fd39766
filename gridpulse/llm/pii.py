"""Personal data in texts, also where it is disguised, with places in the source text.

A cascade of three transducers rewrites a text: look-alike characters to ASCII (one to one, invisible
ones to nothing), spelled digits to digits, and disguises of ``@`` and ``.`` to these. Each step keeps
which stretch of its input every stretch of its output came from; a span found in the last output is
mapped back step by step. Texts in which no step changes anything are scanned once.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache
from hashlib import sha256

from pyspark.sql import DataFrame

from gridpulse.llm.texts import map_texts

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like ASCII letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "С": "C", "Е": "E",
    "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A",
    "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ɡ": "g", "ı": "i", "ⅼ": "l", "ո": "n", "ս": "u", "օ": "o", "ԍ": "g",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "․": ".", "∙": ".", "·": ".",
}
INVISIBLE = re.compile("[­᠎​-‏⁠﻿]+")

# Digits as words (English, German, French, Spanish).
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4",
    "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "un": "1", "deux": "2",
    "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1",
    "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
REPEATS = {"double": 2, "triple": 3}
WEAK_AT, WEAK_DOT = "", ""           # "at" and "dot" as bare words: proof is asked for later

_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_SPOKEN = rf"(?:(?:double|triple)[ -])?\b{_WORD}\b"
_RUN = rf"{_SPOKEN}(?:[\s,.\-]{{1,3}}(?:(?:dash|hyphen|space)\s)?{_SPOKEN})"
_OCTET = rf"(?:{_SPOKEN}(?:[\s\-]{_SPOKEN}){{0,2}}|[0-9]{{1,3}})"
_OPEN, _CLOSE = r"[ \t]*[\[({<]{1,2}[ \t]*", r"[ \t]*[\])}>]{1,2}[ \t]*"
SPELLED = re.compile(
    rf"\b(?P<octets>{_OCTET}(?:\s(?:dot|point|punkt|punto)\s{_OCTET}){{3}})\b"
    rf"|\b(?P<run>(?:double|triple)[ -]{_WORD}\b|{_RUN}+)"
    rf"|\b(?P<plus>plus[\s\-]{{1,2}})(?=(?:{_SPOKEN})|[0-9])"
    rf"|(?<=[0-9][ .\-])(?P<lone>{_SPOKEN})(?=[ .\-][0-9])"
    r"|(?<![A-Za-z0-9])(?P<mixed>[0-9OoIl|](?:[ ().\-]?[0-9OoIl|]){6,})(?![A-Za-z0-9])", re.I)
DISGUISED = re.compile(
    rf"(?P<at>{_OPEN}(?:at|@|arroba){_CLOSE}|&#0*64;|&#x0*40;|&commat;)"
    rf"|(?P<dot>{_OPEN}(?:dot|\.|punkt|point|punto){_CLOSE}|&#0*46;|&#x0*2e;|&period;)"
    r"|(?P<wat>(?<=[A-Za-z0-9])(?:[ \t]+(?:at|arroba)[ \t]+|[_\-](?:at)[_\-]|[ \t]+@[ \t]*|@[ \t]+)(?=[A-Za-z0-9]))"
    r"|(?P<wdot>(?<=[A-Za-z0-9])(?:[ \t]+(?:dot|punkt|punto)[ \t]+|[_\-]dot[_\-]|[ \t]+\.[ \t]*(?=[a-z]{2,}\b))"
    r"(?=[A-Za-z0-9]))", re.I)
# Nothing is rewritten in a text (here in lower case) without one of these.
_DIGIT = re.compile("[0-9]")
_BRACKETED = re.compile(r"[\[({<][ \t]*(?:at|@|arroba|dot|\.|punkt|point|punto)[ \t]*[\])}>]")
_BARE_AT = re.compile(r"at[ _\t\-]+[a-z0-9\-]+\.[a-z]{2}")
_NEAR_DIGIT = re.compile(rf"[0-9][ .\-]+{_WORD}\b|\b{_WORD}[ .\-]+[0-9]|plus\s[0-9]|[0-9]\s(?:dot|point|punkt|punto)\s[0-9]"
                         r"|[0-9][ ().\-]?[oil|]|[oil|][ ().\-]?[0-9]")
_DOT_WORDS = ("dot", "punkt", "punto", "arroba")


def maybe_spelled(low: str) -> bool:
    """Whether digit words may stand side by side or beside digits."""
    words = set(low.split())
    seen = {w for v in words if (w := v.strip(".,;:!?()-")) in DIGIT_WORDS or v.count("-") > 1 and w[:2] != "--"
            and w.split("-")[0] in DIGIT_WORDS}
    if len(seen) > 1 or any("-" in w or re.search(rf"\b{w}[\s,.\-]+{w}\b", low) for w in seen):
        return True
    return bool((seen & DIGIT_WORDS.keys() or _DIGIT.search(low)) and _NEAR_DIGIT.search(low)) or (
        bool(seen) and ("double" in words or "triple" in words))


def maybe_disguised(low: str) -> bool:
    """Whether an ``@`` or ``.`` may be disguised."""
    if ("[" in low or "(" in low or "{" in low or "<" in low) and _BRACKETED.search(low):
        return True
    if "&#" in low or "&commat" in low or "&period" in low or " @" in low or "@ " in low or "\t@" in low or "@\t" in low:
        return True
    return any(w in low for w in _DOT_WORDS) or bool(_BARE_AT.search(low))


_DOMAIN = re.compile(r"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ \-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9\-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+\-]")
_EMAIL = re.compile(
    rf"(?<![A-Za-z0-9_%+.\-{WEAK_DOT}])([A-Za-z0-9_%+\-]++(?:[.{WEAK_DOT}]+[A-Za-z0-9_%+\-]++)*+)([@{WEAK_AT}])"
    rf"([A-Za-z0-9\-]+(?:[.{WEAK_DOT}][A-Za-z0-9\-]+)*[.{WEAK_DOT}][A-Za-z]{{2,24}})(?![A-Za-z0-9\-])")


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 if d > 4 else d * 2 for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start, low = at, free
        while start > low:                      # back over the local part, in steps
            step = max(low, start - 64)
            bad = None
            for bad in _NOT_LOCAL.finditer(text, step, start):
                pass
            if bad:
                start = bad.end()
                break
            start = step
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def numbers(text: str):
    """(kind, start, end) of addresses, cards and phones."""
    if not _DIGIT.search(text):
        return
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
                    yield 1, m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[ -]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield 2, m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield 3, m.start(), m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Undisguised identifiers as (start, kind number, end), sorted."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    return sorted(found + [(s, k, e) for k, s, e in numbers(text)])


@lru_cache(maxsize=4096)
def fold_char(ch: str) -> str:
    """The ASCII character that ``ch`` looks like, or itself."""
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    digit = unicodedata.decimal(ch, None)
    if digit is not None:
        return str(digit)
    if unicodedata.category(ch) == "Zs":
        return " "
    plain = unicodedata.normalize("NFKC", ch)
    return plain if len(plain) == 1 and plain.isascii() and plain.isprintable() else ch


class Rewriting:
    """A text after replacements, and for each stretch of it the stretch of the source."""

    def __init__(self, source: str, changes: list[tuple[int, int, str]]):
        out, self.new, self.old, self.whole = [], [], [], []
        at = size = 0
        for start, end, put in changes:
            for text, begin, literal in ((source[at:start], at, True), (put, start, False)):
                if text:
                    self.new.append(size)
                    self.old.append((begin, start if literal else end))
                    self.whole.append(not literal)
                    out.append(text)
                    size += len(text)
            at = end
        if at < len(source):
            self.new.append(size)
            self.old.append((at, len(source)))
            self.whole.append(False)
            out.append(source[at:])
        self.text = "".join(out)

    def back(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.new, start) - 1, bisect_right(self.new, end - 1) - 1
        low = self.old[i][0] + (0 if self.whole[i] else start - self.new[i])
        return low, self.old[j][1] if self.whole[j] else self.old[j][0] + end - self.new[j]


def _spoken(text: str) -> str:
    out, times = [], 1
    for word in re.findall(r"\w+", text.lower()):
        if word in REPEATS:
            times = REPEATS[word]
        elif word in DIGIT_WORDS:
            out.append(DIGIT_WORDS[word] * times)
            times = 1
    return "".join(out)


def _spelled_changes(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in SPELLED.finditer(text):
        kind = m.lastgroup
        if kind == "octets":
            put = ".".join(p if p.isdigit() else _spoken(p)
                           for p in re.split(r"\s(?:dot|point|punkt|punto)\s", m[0], flags=re.I))
        elif kind == "plus":
            put = "+"
        elif kind == "mixed":
            put = m[0].translate({ord("O"): "0", ord("o"): "0", ord("I"): "1", ord("l"): "1", ord("|"): "1"})
            digits = sum(c.isdigit() for c in m[0])
            if put == m[0] or digits * 2 < sum(c.isdigit() for c in put):
                continue
            for i, (a, b) in enumerate(zip(m[0], put)):
                if a != b:
                    out.append((m.start() + i, m.start() + i + 1, b))
            continue
        else:
            put = _spoken(m[0])
        out.append((m.start(), m.end(), put))
    return out


def _disguise_changes(text: str) -> list[tuple[int, int, str]]:
    put = {"at": "@", "dot": ".", "wat": WEAK_AT, "wdot": WEAK_DOT}
    return [(m.start(), m.end(), put[m.lastgroup]) for m in DISGUISED.finditer(text)]


def hidden_spans(text: str) -> list[tuple[int, int, int]]:
    """Identifiers that only show in the rewritten text, with places in the source."""
    steps, now = [], text
    if not text.isascii():
        swaps = {ord(c): fold_char(c) for c in set(text) if not c.isascii() and fold_char(c) != c}
        if swaps:
            now = now.translate(swaps)
        if INVISIBLE.search(now):
            steps.append(Rewriting(now, [(m.start(), m.end(), "") for m in INVISIBLE.finditer(now)]))
            now = steps[-1].text
    low = now.lower()
    if maybe_spelled(low):
        if changes := _spelled_changes(now):
            steps.append(Rewriting(now, changes))
            now = steps[-1].text
    if maybe_disguised(low):
        if changes := _disguise_changes(now):
            steps.append(Rewriting(now, changes))
            now = steps[-1].text
    if now == text:
        return []
    found = [(k, s, e) for k, s, e in numbers(now)]
    if "@" in now or WEAK_AT in now:
        for m in _EMAIL.finditer(now):
            local, at, domain = m.groups()
            if at == WEAK_AT and WEAK_DOT not in domain and not re.search(rf"[0-9._%+\-{WEAK_DOT}]", local):
                continue
            found.append((0, m.start(), m.end()))
    out = []
    for kind, start, end in found:
        for step in reversed(steps):
            start, end = step.back(start, end)
        out.append((start, kind, end))
    return out


def find_pii(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, spans the rewriting adds). An added span never lies inside a base span, and reaches over
    one only where no space stands between them (a disguised part of the same identifier)."""
    base, added = base_spans(text), []
    for start, kind, end in sorted(set(hidden_spans(text))):
        clear = True
        for s, _, e in base:
            if s < end and start < e:
                left = start < s and text[s - 1].isspace()
                right = e < end and text[e].isspace()
                clear &= start <= s and e <= end and (start, end) != (s, e) and not left and not right
        if clear:
            added.append((start, kind, end))
    return base, added


def span_text(spans) -> str:
    """``kind:start:end`` by start and kind, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: id, counts of undisguised identifiers, ``base`` and ``added`` spans
    (array of kind, start, end in code points, end exclusive).

    Null and empty texts have none; repeated rows give repeated rows; an empty table gives an empty one;
    other columns, whatever their names, are not read.
    """
    span = "array<struct<start:bigint,kind:string,end:bigint>>"

    def make():
        def work(texts):
            both = [find_pii(t) for t in texts]
            counts = [[sum(k == i for _, k, _ in b) for b, _ in both] for i in range(len(KINDS))]
            shown = [[[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in x[side]] for x in both] for side in (0, 1)]
            return [*counts, *shown, [sha256(span_text(b).encode()).hexdigest() for b, _ in both],
                    [span_text(b + a) for b, a in both]]
        return work

    return map_texts(docs, [doc_id], text, "n_email long, n_ip long, n_card long, n_phone long, "
                     f"base {span}, added {span}, base_sha256 string, spans string", make)
