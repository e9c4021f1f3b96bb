"""Personal data: plain identifiers, and disguised ones by offset-preserving transducers.

Plain detection finds emails, IP addresses, card and phone numbers in the text as it is.
Texts that show a sign of disguise pass through transducers that replace look-alike letters
and digits, digits spelled in English, German, French or Spanish, the at / dot disguises of
these languages, and invisible characters, keeping for every piece of output the piece of
source it came from. Look-alikes are all characters whose compatibility form is one ASCII
character, all decimal digits, and a list of letters of other scripts. The same detectors run
over the output, and spans that touch a rewritten piece are mapped back to source characters.
Plain spans always stay; a mapped span that meets one is dropped unless it holds it and more.

Every scan is linear in the text, whatever runs of letters or digits it holds.

Defined cases: null or empty texts have no span; rows are scanned one by one, whatever their
ids, equal rows alike; an empty table gives an empty table; a very long text is scanned
whole; of two kinds at one place the one that is listed first comes first; other columns are
not read; offsets count code points, end exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[int, int, int]  # start, kind, end

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot start within a run of digits: either it starts at the run's head, or that
# head has no match and then its rest has none.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> list[Span]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((start, 0, last))
        at = text.find("@", max(at + 1, last))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text: str) -> list[Span]:
    """Spans of the identifiers that stand in the text undisguised."""
    out = _emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


#: Letters and marks of other scripts that look like ASCII ones.
_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ɡ": "g", "ɑ": "a", "ı": "i", "ȷ": "j",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "Ο": "O", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z",
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "\u00a0": " ", "\u202f": " ",
}


def _folds() -> dict[int, str]:
    """What each look-alike stands for, one character for one."""
    out = {}
    for i in range(0x80, 0x20000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind == "Nd":
            out[i] = str(unicodedata.decimal(c))
        elif kind[0] in "LNPS":
            plain_ = unicodedata.normalize("NFKC", c)
            if len(plain_) == 1 and plain_.isascii() and plain_.isprintable():
                out[i] = plain_
    return out | {ord(k): v for k, v in _ALIKE.items()}


_FOLD = _folds()
_FOLD_CHARS = frozenset(map(chr, _FOLD))
_NON_ASCII = re.compile("[^\\x00-\\x7f]")

#: The digits' names from nought on, in four languages, and the words for plus, dot and at.
_NAMES = ["zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve"]
_NUMBERS = {w: str(d) for names in _NAMES for d, w in enumerate(names.split())} | {"oh": "0", "zwo": "2"}
_D = "(?:" + "|".join(sorted(_NUMBERS, key=len, reverse=True)) + ")"
_PLUS, _POINT = "(?:plus|más|mas)", "(?:dot|point|punkt|punto)"
_AT, _PLAIN_AT = "(?:at|ät|arroba|arobase|klammeraffe)", "(?:arroba|arobase|klammeraffe)"
_GAP = r"[ \t\n,-]{1,3}"
_OPEN, _CLOSE = r"[ \t]{0,3}[\[({<][ \t]{0,2}", r"[ \t]{0,2}[\])}>][ \t]{0,3}"
#: After a bare "dot": a top-level domain, or one more label before such a one.
_TOP = "(?:com|org|net|edu|gov|mil|info|biz|io|co|uk|eu|fr|ch|nl|jp|cn|au|ca|ru|br|dev|app|ai|de|es|mx|ar)(?![a-z0-9-])"
_LABELS = rf"(?:[a-z0-9-]{{1,63}}[ \t]{{1,3}}{_POINT}[ \t]{{1,3}}){{0,3}}{_TOP}"
_BARE = r"(?<=[a-z0-9])[ \t]{1,3}"
_REWRITES = re.compile(
    rf"(?P<digits>(?<![a-z0-9])(?:{_PLUS}{_GAP})?{_D}(?:{_GAP}(?:{_D}|{_POINT})(?![a-z0-9])){{3,}})"
    rf"|(?P<at>{_OPEN}{_AT}{_CLOSE}|{_BARE}at[ \t]{{1,3}}(?=[a-z0-9-]{{1,63}}(?:[ \t]{{1,3}}{_POINT}[ \t]{{1,3}}{_LABELS}|{_OPEN}{_POINT}{_CLOSE}))|{_BARE}{_PLAIN_AT}[ \t]{{1,3}}(?=[a-z0-9]))"
    rf"|(?P<dot>{_OPEN}(?:{_POINT}|\.){_CLOSE}|{_BARE}{_POINT}[ \t]{{1,3}}(?={_LABELS}))"
    rf"|(?P<none>[​‌‍⁠﻿­])",
    re.IGNORECASE | re.ASCII,
)
#: Each starts with a set of characters, which keeps the search fast. Without any of these signs no rewrite applies.
_WORD_SIGNS = ["dot", "punkt", "punto", "arroba", "arobase", "klammeraffe"]
_BRACKET_SIGN = re.compile(r"[\[({<][ \t]{0,2}(?:at|ät|point|\.)[ \t]{0,2}[\])}>]")
_POINT_SIGN = re.compile(rf"[ \t]point[ \t]{{1,3}}{_LABELS}")
_DIGIT_SIGN = re.compile(rf"[^a-z0-9]{_D}{_GAP}(?:{_D}|{_POINT}){_GAP}")
_NONE_SIGN = re.compile(r"[​‌‍⁠﻿­]")


def _signs(text: str) -> bool:
    # A-Z only, as in the rewrites.
    low = " " + (text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
    if any(w in low for w in _WORD_SIGNS) or _BRACKET_SIGN.search(low) or _DIGIT_SIGN.search(low) or "point" in low and _POINT_SIGN.search(low):
        return True
    return not text.isascii() and (not _FOLD_CHARS.isdisjoint(_NON_ASCII.findall(text)) or bool(_NONE_SIGN.search(text)))


_WORD = re.compile(r"[^\W\d_]+")
_SPOKEN = _NUMBERS | dict.fromkeys(("plus", "más", "mas"), "+") | dict.fromkeys(("dot", "point", "punkt", "punto"), ".")


def _spelled(text: str) -> str:
    return "".join(_SPOKEN.get(w, "") for w in map(str.lower, _WORD.findall(text)))


class Normal:
    """A text's normal form, with the source of each piece."""

    def __init__(self, text: str):
        folded = text.translate(_FOLD)  # one character for one: offsets hold
        self.changed = [m.start() for m in _NON_ASCII.finditer(text) if m[0] in _FOLD_CHARS]
        self.pieces: list[tuple[int, int, int, int]] = []  # output start and end, source start and end, of rewritten pieces
        parts, done, size = [], 0, 0
        for m in _REWRITES.finditer(folded):
            new = "@" if m["at"] else "." if m["dot"] else "" if m["none"] else _spelled(m[0])
            parts += [folded[done : m.start()], new]
            size += m.start() - done
            self.pieces.append((size, size + len(new), m.start(), m.end()))
            size += len(new)
            done = m.end()
        parts.append(folded[done:])
        self.text = "".join(parts)
        self.starts = [p[0] for p in self.pieces]

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source start and end of an output span, and whether it holds a changed piece."""
        a = bisect.bisect_right(self.starts, start) - 1
        b = bisect.bisect_left(self.starts, end) - 1
        if a >= 0 and start < self.pieces[a][1]:
            s, inner = self.pieces[a][2], a
        else:
            s, inner = start + (self.pieces[a][3] - self.pieces[a][1] if a >= 0 else 0), a + 1
        if b >= 0 and end <= self.pieces[b][1]:
            e = self.pieces[b][3]
        else:
            e = end + (self.pieces[b][3] - self.pieces[b][1] if b >= 0 else 0)
        k = bisect.bisect_left(self.changed, s)
        return s, e, b >= inner or k < len(self.changed) and self.changed[k] < e


def disguised(text: str, known: list[Span]) -> list[Span]:
    """Spans that only the normal form shows, in source characters. One that meets a plain span must hold it and more."""
    if not _signs(text):
        return []
    normal, taken, out = Normal(text), sorted((s, e) for s, _, e in known), []
    highest, most = [], 0
    for _, e in taken:
        most = max(most, e)
        highest.append(most)
    for start, kind, end in plain(normal.text):
        s, e, changed = normal.source(start, end)
        k = bisect.bisect_left(taken, (e,)) - 1
        if changed and (not (k >= 0 and highest[k] > s) or _holds(taken, highest, k, s, e)):
            out.append((s, kind, e))
    return out


def _holds(taken: list[tuple[int, int]], highest: list[int], k: int, s: int, e: int) -> bool:
    """Whether all plain spans up to the kth that meet s to e lie within, and none is all of it."""
    while k >= 0 and highest[k] > s:
        a, b = taken[k]
        if b > s and (a < s or b > e or (a, b) == (s, e)):
            return False
        k -= 1
    return True


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<start, kind, end, disguised>>) for each row."""

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                base = plain(t or "")
                rows = [(*x, False) for x in base] + [(*x, True) for x in disguised(t or "", base)]
                out.append([{"start": s, "kind": KINDS[k], "end": e, "disguised": d} for s, k, e, d in sorted(rows)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("disguised", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["key", "spans"])

    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = f"key {narrow.schema[0].dataType.simpleString()}, spans array<struct<start:bigint,kind:string,end:bigint,disguised:boolean>>"
    return narrow.mapInArrow(run, schema).withColumnRenamed("key", key)


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, the plain spans' number by kind and hash, all spans, n_disguised."""

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                base = plain(t or "")
                more = disguised(t or "", base)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names)

    narrow = docs.select("doc_id", "text")
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised"]
    kinds = [narrow.schema[0].dataType.simpleString(), *["long"] * 4, "string", "string", "long"]
    return narrow.mapInArrow(run, ", ".join(map(" ".join, zip(names, kinds, strict=True))))
