"""Personal information in free text: list of mentions, and text with typed placeholders.

High-recall generators propose overlapping spans; boosted trees score each by its format, its surroundings and how often its words
are used as names in the corpus; calibrated thresholds and then the best non-overlapping choice select the mentions. The trees are
trained on the driver on made-up sentences (``training_rows``, ``TRAINING_SENTENCES`` of them). Their templates were written for this module,
not taken from any corpus (some negative ones were added after a look at false findings); ``held_out_figures`` trains without every fifth template and judges the sentences of those.

How often a word is used as a given or family name is counted over the whole corpus. A count matters only in relation to the others: a
level of 6 is that of a usual name, each level more twice as often, so levels don't change as the corpus grows, and words that are 64 times
rarer than that are no names. The levels are sent to every worker if they were counted to be at most ``NAME_ROWS``; beyond, they are joined
to the texts that hold the words (``joined_names``), which gives the same result.
"""

from __future__ import annotations

import functools
import random
import re
import unicodedata
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.boosting import Boosted
from tracewright.session import cut, lookup, spread

TYPES = ("email", "phone", "id_number", "address", "person")
#: A table of levels of more words than this (about 10 bytes each) isn't sent to the workers but joined.
NAME_ROWS = 2_000_000
USUAL, TOP = 6, 9
TRAINING_SENTENCES = 6000
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}

# ---------------------------------------------------------------- generators



def _ranges(wanted) -> str:
    """A class of characters, as ranges for a pattern."""
    out, start = "", None
    for o in range(0x41, 0x2000):
        if wanted(chr(o)):
            start = o if start is None else start
        elif start is not None:
            out += chr(start) + ("-" + chr(o - 1) if o - 1 > start else "")
            start = None
    return out


#: Capitals of the Latin, Greek, Cyrillic and other alphabets that have them.
_U = _ranges(lambda c: unicodedata.category(c) in ("Lu", "Lt"))
_W = rf"[{_U}][^\W\d_]*(?:['’\-][^\W\d_]+)*"
_TOWN = rf"[{_U}][^\W\d_]+(?:[ \-][{_U}][^\W\d_]+(?![^\W_]))?"
_GAP = r"[ \t\u00a0]+"

EMAIL = re.compile(r"[^\W_][\w.+%\-]*@[^\W_][\w\-]*(?:\.[^\W_][\w\-]*)*\.[^\W\d_]{2,24}(?![\w@])")
HIDDEN_AT = re.compile(r" ?[(\[{] ?(?:at|AT|At) ?[)\]}] ?| (?:AT|at) (?=[\w\-]+(?:\.[\w\-]+)*(?: (?:DOT|dot) \w|\.[^\W\d_]))")
HIDDEN_DOMAIN = re.compile(r"[^\W_][\w\-]*(?:(?:\.| ?[(\[{] ?(?:dot|DOT) ?[)\]}] ?| (?:dot|DOT) )[^\W_][\w\-]*)*(?:\.| ?[(\[{] ?(?:dot|DOT) ?[)\]}] ?| (?:dot|DOT) )[^\W\d_]{2,24}(?!\w)")

#: Anything that may be telephone or identity numbers: a run of digits with single separators in between, however long. Nothing is tried twice.
NUMBER = re.compile(r"(?<![\w.,\-/#‑])(?<!\d:)(?:\+|\(|[A-Z]{1,3}[ \-]?(?=\d))?\d(?:\d|[ .\-‑\u00a0](?=[\d(])|\(\d{1,4}\)[ .\-‑\u00a0]?|\)[ .\-‑\u00a0]?(?=\d))*+(?:(?<=\d)[ \-]?[A-Za-z](?![\w]))?")
_S = r"[ .\-‑\u00a0]"
#: (type, format, pattern of the whole number)
NUMBER_FORMATS = tuple(
    (kind, name, re.compile(pattern))
    for kind, name, pattern in (
        ("id_number", "resident", r"\d{6}[\-‑]\d{7}"),
        ("id_number", "social", r"\d{3}[\-‑]\d{2}[\-‑]\d{4}"),
        ("id_number", "insurance", r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"),
        ("id_number", "national", r"\d{8}[\-‑]?[A-Z]"),
        ("id_number", "passport", r"[A-Z]{1,2}\d{7,8}"),
        ("phone", "korean", rf"01[016789](?:{_S}?\d{{3,4}}){{1}}{_S}?\d{{4}}"),
        ("phone", "korean_international", rf"\+82{_S}?\(?0?\)?{_S}?\d{{1,2}}{_S}?\d{{3,4}}{_S}?\d{{4}}"),
        ("phone", "american_international", rf"\+1{_S}?\(?\d{{3}}\)?{_S}?\d{{3}}{_S}?\d{{4}}"),
        ("phone", "american", rf"(?:\(\d{{3}}\){_S}?|\d{{3}}{_S})\d{{3}}{_S}\d{{4}}"),
        ("phone", "ten_digits", r"[2-9]\d{9}"),
        ("phone", "british", rf"0\d{{2,4}}{_S}\d{{3,4}}{_S}?\d{{3,4}}"),
        ("phone", "compact", r"0[1-9]\d{8,9}"),
        ("phone", "french", rf"0\d(?:{_S}\d\d){{4}}"),
        ("phone", "international", rf"\+\d{{1,3}}{_S}?(?:\(0\){_S}?)?\d{{1,5}}(?:{_S}?\d{{2,6}}){{1,4}}"),
    )
)
#: Whether any of the formats occurs at all: one search instead of one for each.
_ANY_NUMBER = re.compile("|".join(f"(?:{p.pattern})" for _, _, p in NUMBER_FORMATS))
#: None of the formats is meant to hold in fewer characters.
SHORTEST_NUMBER = 8
#: The formats as parts of a run.
_PARTS = tuple(re.compile(rf"(?<![^\W_])(?<![\-.+])(?:{p.pattern})(?![^\W_]|[\-.])") for _, _, p in NUMBER_FORMATS)

_STREET = r"(?:Street|St|Avenue|Ave|Lane|Ln|Road|Rd|Court|Ct|Drive|Dr|Boulevard|Blvd|Way|Close|Place|Square|Terrace|Crescent|Row|Hill)"
#: Postcodes: four or five digits, those of Britain, the Netherlands and Canada.
_POST = r"(?:\d{4,5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|\d{4} [A-Z]{2}|[A-Z]\d[A-Z] ?\d[A-Z]\d)"
_AFTER_TOWN = rf"(?:,{_GAP}[A-Z]{{2}}\b)?(?:{_GAP}{_POST}\b|,{_GAP}(?=[A-Z]){_POST}\b)?"
_CODE = rf"(?:[A-Z]{{1,2}}-)?\d{{4,5}}(?:{_GAP}[A-Z]{{2}}\b)?"
ADDRESSES = tuple(
    (name, re.compile(pattern))
    for name, pattern in (
        ("english", rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|FLAT|APT\.?|UNIT){_GAP}\d+[A-Za-z]?,{_GAP})?(?<![\w.\-/])\d{{1,5}}[A-Za-z]?{_GAP}(?:{_W}{_GAP}){{1,3}}(?:{_STREET}|{_STREET.upper()})\b\.?(?:,?{_GAP}(?:Apt\.?|Flat|Unit|Suite|APT\.?|FLAT|UNIT){_GAP}\d+[A-Za-z]?)?,{_GAP}{_TOWN}{_AFTER_TOWN}"),
        ("box", rf"\b(?:P\.?(?:{_GAP})?O\.?{_GAP}Box|PO{_GAP}BOX|P\.O\.{_GAP}BOX){_GAP}\d+,{_GAP}{_TOWN}{_AFTER_TOWN}"),
        ("german", rf"(?:{_W}{_GAP}){{0,2}}{_W}(?<=[a-zA-ZßẞäöüÄÖÜ.]){_GAP}\d{{1,4}}[a-z]?,{_GAP}{_CODE}{_GAP}{_TOWN}"),
        ("french", rf"(?<![\w.\-/])\d{{1,4}},?{_GAP}(?:rue|avenue|boulevard|impasse|chemin|place|quai|allée|route|RUE|AVENUE|BOULEVARD|IMPASSE|CHEMIN|PLACE|QUAI|ALLÉE){_GAP}[^\d,\n]{{2,40}},{_GAP}\d{{5}}{_GAP}{_TOWN}"),
        ("spanish", rf"\b(?:Calle|Avenida|Plaza|Paseo|Camino|Ronda|Travesía|CALLE|AVENIDA|PLAZA|PASEO|CAMINO){_GAP}[^\d,\n]{{2,40}}{_GAP}\d{{1,4}},{_GAP}\d{{5}}{_GAP}{_TOWN}"),
        ("korean", r"(?:[가-힣]{1,6}(?:특별시|광역시|도|시)[ \u00a0]+)(?:[가-힣]{1,6}[시군구][ \u00a0]+)?[가-힣0-9]{1,10}[로길](?:[ \u00a0]+\d+번?길)?[ \u00a0]+\d+(?:-\d+)?"),
    )
)
#: Whether any of them occurs at all; it has to accept whatever one of them matches.
_ANY_ADDRESS = re.compile(rf",{_GAP}(?:[A-Z]{{1,2}}-)?\d{{4,5}}{_GAP}[{_U}]|(?:{_STREET}|{_STREET.upper()})\b\.?(?:,|{_GAP}(?:Apt|Flat|Unit|Suite|APT|FLAT|UNIT))|[Bb][Oo][Xx]{_GAP}\d|[로길][ \u00a0]+\d")

# Titles before a name.
TITLES = (
    "Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Officer", "Detective", "Inspector", "Sergeant", "Agent", "Judge", "Sir", "Madam", "Herr", "Herrn", "Frau", "Monsieur", "Madame",
    "Mademoiselle", "Señor", "Señora", "señor", "señora", "Sr", "Sra", "Don", "Doña",
)
_TITLES = "|".join(sorted({*TITLES, *(t.upper() for t in TITLES)}, key=len, reverse=True))
#: Two or three capitalised words in a row; the middle one may be an initial, the first too; or family name, comma, given name.
_PAIR = re.compile(rf"(?<![\w@.])(?:[{_U}]\.|{_W})(?:{_GAP}[{_U}]\.)?{_GAP}{_W}(?![\w@])")
_SWAPPED = re.compile(rf"(?<![\w@.]){_W},{_GAP}{_W}(?:{_GAP}[{_U}]\.)?(?![\w@])")
_TITLED = re.compile(rf"(?<!\w)(?:{_TITLES})\.?{_GAP}({_W})(?![\w@])")
# Small words inside names.
PARTICLES = frozenset(("van", "der", "den", "von", "zu", "de", "del", "della", "di", "da", "dos", "la", "le", "du", "bin", "al"))
_NAME_WORD = re.compile(rf"(?<![\w@.])(?:[{_U}]\.|{_W}|(?:{'|'.join(sorted(PARTICLES))})(?= ))")
_HANGUL = re.compile(r"[가-힣]+")
_HONOUR = re.compile(r"[ \u00a0]?(?:씨|님|군|양|과장|부장|대리|교수|박사|선생)")
_NAMED = re.compile(r"(?:담당자|참고인[ \u00a0]*\d*|작성자|성명|이름|피의자|증인|의뢰인)[ \u00a0]*:?[ \u00a0]*$")

# Words near a mention that speak for or against a type, in the five languages.
CUES = {
    "email": re.compile(r"mail|e-mail|courriel|correo|메일|write|schreib|écri|escrib|send|senden|envoy|envi|contact|kontakt|contacto|reach|reply|\bcc\b|\bto\b|from|von|\bde\b|address|adresse|login|user|account|conto|sip|문의|연락", re.I),
    "phone": re.compile(r"tel|phone|fon|fono|fax|mobil|móvil|cell|handy|portable|call|ruf|rang|ring|appel|llam|text|sms|number|nummer|numéro|número|contact|kontakt|reach|dial|전화|연락|번호|휴대", re.I),
    "id_number": re.compile(r"\bid\b|ident|passport|pass\b|reisepass|passeport|pasaporte|ausweis|carte|carnet|dni|ssn|social|security|sozial|insurance|versicherung|national|licen|permit|주민|여권|등록|신분", re.I),
    "address": re.compile(r"address|adresse|anschrift|dirección|domicil|live|living|wohn|habit|vive|resid|deliver|liefer|livr|entreg|ship|send to|bill|invoice|rechnung|factur|home|office|visit|at\b|in\b|au\b|주소|배송|거주|사는", re.I),
    "person": re.compile(r"\bby\b|\bvon\b|\bpar\b|\bpor\b|name|nombre|\bnom\b|called|signed|unterschr|signé|firmado|dear|liebe|cher|estimad|hello|regards|grüßen|cordialement|atentamente|from|\bto\b|\bcc\b|contact|kontakt|ansprech|attn|attention|owner|holder|user|customer|kund|client|employee|member|author|autor|tenant|witness|zeug|témoin|testigo|\band\b|\bund\b|\bet\b|\by\b|with|mit|avec|con\b|담당|성명|이름|작성|참고|고객", re.I),
}
AGAINST = re.compile(r"\b(?:session|imsi|imei|version|ver\b|build|release|sid\b|uid|gid|sha|md5|hash|checksum|digest|tag|serial|seriennummer|numéro de série|número de serie|model|part|code|record|block|sector|sektor|token|realm|icon|status|error|event|pid|process|device|volume|partition|offset|bytes|item|order|invoice|ticket|tracking|queue|port|entry|rows?|lines?|addr|host|server|software|program|programm|logiciel|programa|service|dienst|install\w*|open\w*|database|file|datei|fichier|일련|버전|코드|장치)\W*$", re.I)
AFTER_FOR = re.compile(r"^[ \u00a0]*(?:씨|님|입니다|과장|부장|대리|교수|박사|said|says|told|asked|wrote|writes|replied|answered|explained|confirmed|called|lives|works|signed|agreed|attended|joined|has |had |is |was |will |wants|wanted|thinks|and |und |et |y |sagte?|schr[ei]|erklär|bestät|rief|wohnt|meldete|a (?:dit|écrit|confirmé|déclaré|précisé|répondu|appelé|signé)|habite|confirm|déclar|dijo|aclar|explic|escrib|vive|llamó|firmó|['’]s\b|<|\(|:|,|;|\||am \d|on \d|le \d|el \d)", re.I)
AFTER_AGAINST = re.compile(r"^[ \u00a0]*(?:v?\d+\.\d|version|edition|server|service|software|app\b|database|update|installed|is (?:now|slow|down)|crash|fail|start(?:ed|s)|stop|load|enthält|speichert|wurde|führt|zeigt|contient|conserve|utilise|contiene|guarda|muestra|gespeichert|opens|closed|festival|was (?:clos|clean|install|launch|start|load|merg|empty|found)|were|with \d|from \d|=|\.\d|:\d|/\d|x\d|개|건|번\b|프로그램|데이터|파일|서버)", re.I)


class Span:
    """A candidate: where, what, in which form, and the words that may be given and family name."""

    __slots__ = ("end", "first", "form", "kind", "last", "middle", "start")

    def __init__(self, start: int, end: int, kind: int, form: int, first: str = "", last: str = "", middle: int = 0) -> None:
        self.start, self.end, self.kind, self.form, self.first, self.last, self.middle = start, end, kind, form, first, last, middle


def _clean_word(w: str) -> str:
    return w.strip("'’-.").lower()


def spans_of(text: str, names: Names) -> list[Span]:
    """All candidate spans of a text."""
    out: list[Span] = []
    if "@" in text:
        for m in EMAIL.finditer(text):
            out.append(Span(m.start(), m.end(), 0, 0))
    for m in HIDDEN_AT.finditer(text):
        left = m.start()
        while left and (text[left - 1].isalnum() or text[left - 1] in "_.+%-"):
            left -= 1
        while left < m.start() and not text[left].isalnum():
            left += 1
        right = HIDDEN_DOMAIN.match(text, m.end())
        if left < m.start() and right:
            out.append(Span(left, right.end(), 0, 1))
    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= SHORTEST_NUMBER:
            out += _numbers(text, m.start(), m.end())
    if _ANY_ADDRESS.search(text):
        found = [Span(m.start(), m.end(), 3, form) for form, (_, pattern) in enumerate(ADDRESSES) for m in pattern.finditer(text)]
        # of addresses inside each other only the outer one is proposed: the inner one is its tail
        reach = -1
        for s in sorted(found, key=lambda s: (s.start, -s.end, s.form)):
            if s.end > reach:
                reach = s.end
                out.append(s)
    out += _persons(text, names)
    return out


def _numbers(text: str, start: int, end: int) -> list[Span]:
    """The formats that a run of digits and separators has; if it has none, those of its parts, overlapping ones too."""
    while not text[end - 1].isalnum():  # blanks and digits in brackets are no end of a number
        end = text.rindex("(", start, end) if text[end - 1] == ")" else end - 1
    part = text[start:end]
    if end - start < SHORTEST_NUMBER or not _ANY_NUMBER.search(part):
        return []
    found = [Span(start, end, TYPES.index(kind), form) for form, (kind, _, pattern) in enumerate(NUMBER_FORMATS) if pattern.fullmatch(part)]
    if found:
        return found
    for form, (kind, _, _) in enumerate(NUMBER_FORMATS):
        m = _PARTS[form].search(part)
        while m:
            if m.end() - m.start() >= SHORTEST_NUMBER:
                found.append(Span(start + m.start(), start + m.end(), TYPES.index(kind), form))
            m = _PARTS[form].search(part, m.start() + 1)
    return found


def _persons(text: str, names: Names) -> list[Span]:
    """Runs of two to four name words, with initials and particles; family names after titles; Korean names.

    Of longer runs than two words, and of Korean words without a label or title, only those are proposed whose words the corpus uses as names.
    """
    out: list[Span] = []
    words = [(m.start(), m.end(), m.group()) for m in _NAME_WORD.finditer(text)]
    n = len(words)
    for i in range(n - 1):
        s, e, w = words[i]
        s2, e2, w2 = words[i + 1]
        gap = text[e:s2]
        if w in PARTICLES:
            continue
        if 0 < len(gap) < 4 and not gap.strip(" \t\u00a0"):
            if w2 not in PARTICLES and not w2.endswith(".") and len(w2) > 1 and (len(w) > 1 or w[1:] == ".") and _ends(text, e2):
                out.append(Span(s, e2, 4, 1 if w.endswith(".") else 0, _clean_word(w), _clean_word(w2)))
            j, end = i + 1, e2
            while j + 1 < n and j - i < 3:
                s3, e3, w3 = words[j + 1]
                if not (0 < s3 - end < 4) or text[end:s3].strip(" \t\u00a0"):
                    break
                j, end = j + 1, e3
                if w3 in PARTICLES or w3.endswith(".") or len(w3) < 2 or not _ends(text, e3):
                    continue
                first, last = _clean_word(w), _clean_word(w3)
                between = [words[k][2] for k in range(i + 1, j)]
                if all(x.endswith(".") for x in between) and not w.endswith("."):
                    out.append(Span(s, e3, 4, 2, first, last, len(between)))
                elif names.of(last)[1] and (w.endswith(".") or names.of(first)[0]):
                    known = sum(x in PARTICLES or x.endswith(".") or any(names.of(_clean_word(x))) for x in between)
                    if known == len(between):
                        out.append(Span(s, e3, 4, 9, first, last, len(between)))
        elif gap.rstrip(" \u00a0") == "," and len(gap) in (2, 3) and not w.endswith(".") and len(w) > 1 and w2 not in PARTICLES and (len(w2) > 1):
            if i + 2 < n and words[i + 2][2].endswith(".") and not text[e2 : words[i + 2][0]].strip():
                out.append(Span(s, words[i + 2][1], 4, 3, _clean_word(w2), _clean_word(w)))
            out.append(Span(s, e2, 4, 3, _clean_word(w2), _clean_word(w)))
    for m in _TITLED.finditer(text):
        out.append(Span(m.start(1), m.end(1), 4, 4, "", _clean_word(m.group(1))))
    for m in _HANGUL.finditer(text):
        run, at = m.group(), m.start()
        named = _NAMED.search(text, max(0, at - 12), at) is not None
        for k in (2, 3, 4):
            if len(run) < k:
                break
            honoured = _HONOUR.match(text, at + k) is not None
            if honoured or (named and len(run) <= k + 2) or (k > 2 and len(run) <= k + 2 and any(names.of(run[:k]))):
                out.append(Span(at, at + k, 4, 5 + honoured + 2 * named, run[:k], run[:k]))
    return out


def _ends(text: str, at: int) -> bool:
    after = text[at : at + 1]
    return after not in ("@", "_") and not after.isalnum()


# ---------------------------------------------------------------- features

FEATURES = 22
# General and reserved top-level domains; those of countries have two letters. (A mail that is cut short ends with neither.)
TOP_LEVEL = frozenset("com org net edu gov mil int info biz name pro app dev shop online site cloud test example invalid localhost".split())
_DIGITS = re.compile(r"\d+")
_MARKS = {":": 5, "=": 6, "-": 7, ".": 8, "/": 9, "_": 10, "\\": 10, "|": 11, ",": 12, '"': 13, "(": 4, "[": 4, "{": 4, "<": 4}


def _char_class(c: str) -> int:
    if not c:
        return 0
    if c.isspace():
        return 1
    return 2 if c.isalnum() else _MARKS.get(c, 3)


def hashed(word: str) -> int:
    """The hash under which ``Names`` holds a word, as the engine's ``xxhash64`` gives it."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)


class Names:
    """The levels of words as given and as family names (0 for words that aren't used so): sorted hashes and two small numbers for each."""

    def __init__(self, keys: np.ndarray, given: np.ndarray, family: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.given, self.family = keys[order], given[order], family[order]
        self.known: dict[str, tuple[int, int]] = {}

    @classmethod
    def of_words(cls, levels: dict[str, tuple[int, int]]) -> Names:
        pairs = list(levels.values())
        names = cls(np.array([hashed(w) for w in levels], np.uint64), np.array([g for g, _ in pairs], np.uint8), np.array([f for _, f in pairs], np.uint8))
        return names

    def of(self, word: str) -> tuple[int, int]:
        """(level as given name, level as family name)."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            h = np.uint64(hashed(word))
            k = int(np.searchsorted(self.keys, h))
            found = (int(self.given[k]), int(self.family[k])) if k < len(self.keys) and self.keys[k] == h else (0, 0)
            self.known[word] = found
        return found


NO_NAMES = Names(np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint8))


def features(text: str, spans: list[Span], names: Names) -> np.ndarray:
    x = np.zeros((len(spans), FEATURES), np.float32)
    end = len(text.rstrip())
    whole = len(text.strip())
    for i, s in enumerate(spans):
        mention, kind = text[s.start : s.end], s.kind
        left, right = text[max(0, s.start - 30) : s.start], text[s.end : s.end + 24]
        row = x[i]
        row[0], row[1] = kind, s.form
        row[4], row[5] = _char_class(left[-1:]), _char_class(right[:1])
        row[6] = len(mention) >= 0.6 * whole
        row[7] = CUES[TYPES[kind]].search(left) is not None
        row[8] = AGAINST.search(left) is not None
        row[9] = AFTER_FOR.match(right) is not None
        row[10] = AFTER_AGAINST.match(right) is not None
        row[16] = left.rstrip(" \u00a0")[-1:] in ("", ".", "\n", "!", "?", ":", "]", '"')
        row[17] = s.end >= end
        if kind == 4:
            row[13], row[14] = names.of(s.last) if s.last else (0, 0)
            if s.form == 1:  # an initial is no word to look up
                row[11] = row[14]
            elif s.first:
                row[11], row[12] = names.of(s.first)
            row[15] = 1 if mention.istitle() else 2 if mention.isupper() else 0
            row[20] = min(row[11], row[14]) if s.first else row[14]
            row[2] = s.middle
        else:
            digits = _DIGITS.findall(mention)
            row[3] = sum(map(len, digits))
            if kind == 0:
                top = re.split(r"[. ]", mention)[-1].lower()
                row[19] = 2 if top in TOP_LEVEL else len(top) == 2
            elif kind == 3:
                row[19], row[21] = mention.count(","), len(digits[-1]) if digits else 0
            else:
                row[2], row[19] = len(mention), len(set("".join(digits)))
                row[18] = right[:2].strip("-.:/ \u00a0")[:1].isdigit() + 2 * left[-2:].strip("-.:/+ \u00a0")[-1:].isdigit()
    return x


# ---------------------------------------------------------------- training

_ONSETS, _VOWELS = "bcdfghjklmnprstvwz", "aeiouaeioäöüéèáíóñ"


def _coined(rng: random.Random, n: int = 2) -> str:
    """A word of about 3 n letters that hardly ever comes up twice; a few are in other alphabets."""
    script = rng.random()
    onsets, vowels, closing = (_ONSETS, _VOWELS, "nrl") if script < 0.9 else ("cłśżčšřźdgkmnt", "aeiouyąęě", "nkw") if script < 0.95 else ("бвгдклмнпрст", "аеиоуы", "нрл") if script < 0.98 else ("βγδκλμνπρστ", "αειου", "νσρ")
    word = "".join(rng.choice(onsets) + rng.choice(vowels) + rng.choice(("", "", *closing)) for _ in range(n + 1))
    return word[: max(3, 3 * n + rng.randint(-1, 2))].capitalize()


#: Sentences of the training sample, written for it; {p} person, {e} mail, {t} telephone, {i} identity number, {a} address, {k} a family name after a
#: title and {q} a Korean person are mentions; {b} product, {n} digits, {f} file, {h} host, {v} version, {w} plain capitalised words, {x} number-like
#: codes are not.
_POSITIVE = (
    "Please call {p} at {t} before noon.", "You can reach {p} at {e} or {t}.", "Best regards,\n{p}\n{t}", "Kind regards\n{p}\n{e}", "Invoice to: {p}, {a}", "Ship the parcel to {a} until {n}.",
    "{p} wrote on {n}: page {n} is blank.", "Dear {p}, thank you for your letter.", "Dear Mr {k}, order {n} has arrived.", "Dear Ms {k},\n", "Dr {k} will see you at {n}.", "Present were {p}, {p} and {p}.",
    "cc: {p} <{e}>", "From: {p} <{e}>", "To: {e}", "Reply-To: {e}; Subject: {n}", "My passport number is {i}.", "SSN: {i}", "National ID {i} (expires {n})", "ID card {i}, issued to {p}", "He gave {a} as his address.",
    "The tenant of {a} is {p}.", "Home: {a}. Mobile: {t}.", "Tel. {t}, fax {t}", "phone={t}", "{t}", "{e}", "{p}", "{i}", "{a}", "contact: {t}; user: {e}", "name={p}&mail={e}", "\"{p}\" <{e}>", "{p}, {t}", "tel:{t}",
    "mailto:{e}", "Customer {p} (no. {n}) complained about {b}.", "Employee {n}: {p}, {e}, ext. {n}", "Signed: {p}, {n}", "I met {p} yesterday; Mrs {k} was out.", "A payment by {p} of {n} euros was booked.",
    "[{n}] {p}: see you at {n}", "{p} has joined the call", "{p} said that {b} crashed.", "The survey by {p} covers {n} pages.", "Call me on {t} or text {t}.", "{p}'s number is {t}.", "Ask Professor {k} or Judge {k}.",
    "Guests: {p}, {p}", "Written by {p} and {p} with {b}.", "{t}; {t}", "{t} | {t}", "{t}(mobile)", "work {t} ext {n}", "{e}(email)", "{p}(owner)", "{i}(id)", "{a}(home)", "Owner: {p}|{e}|{t}", "id={i};name={p}",
    "The coach of team {n} is {p}", "We thank {p} for {f}.", "{p} lives at {a}.", "Room {n} is booked for {p}, {e}.", "Officer {k} and {p} stood at the gate.", "The heir, {p}, keeps {f}.", "Her card shows {i}, his {i}.",
    "Sehr geehrter Herr {k}, anbei {f}.", "Sehr geehrte Frau {k},\n", "Mit freundlichen Grüßen\n{p}\n{t}", "Ansprechpartner: {p}, Tel. {t}", "Bitte schreiben Sie an {e}.", "Lieferanschrift: {a}", "{p} wohnt seit {n} in {a}.",
    "Vorgelegt wurde der Ausweis {i} von {p}.", "Herr {k} rief unter {t} zurück.", "Unterschrieben von {p} am {n}", "{p} sagte, {b} sei abgestürzt.", "Kunde {p}, {a}, Telefon {t}", "Am {n} kam {p} mit {f} zurück.",
    "Cher Monsieur {k}, veuillez trouver {f}.", "Madame {k} vous rappellera au {t}.", "Cordialement,\n{p}\n{e}", "Livraison : {a}", "{p} habite au {a} depuis {n}.", "Contact : {p}, tél. {t}", "Carte {i} au nom de {p}",
    "Envoyez le dossier à {e}.", "{p} a déclaré avoir perdu {f}.", "Le {n}, {p} a signé.", "Estimado señor {k}: adjunto {f}.", "La señora {k} llamó al {t}.", "Atentamente,\n{p}\n{e}", "Envío: {a}", "{p} vive en {a} desde {n}.",
    "Contacto: {p}, teléfono {t}", "DNI {i} a nombre de {p}", "Escriba a {e} para más datos.", "{p} dijo que {f} no existe.", "El {n} firmó {p}.", "{q} 님께 전화 바랍니다: {t}", "담당자: {q}, {e}", "{q} 씨가 {n}에 방문했습니다.",
    "주소: {a}", "주민등록번호 {i} 확인", "배송지는 {a} 입니다.", "{q} 과장에게 {f} 파일을 보냈다.", "연락처 {t}, 이름 {q}", "{q}입니다. {t} 로 연락 주세요.", "이메일은 {e} 입니다.", "{q} 대리가 회의에서 발표했다.", "작성자: {q}", "{a} 에 사는 {q} 씨",
)
_NEGATIVE = (
    "{b} {v} can now be downloaded.", "Get {b} from {h} before {n}.", "The {b} service failed with code {x}.", "Open {f} in {b}.", "Server {h} answered within {n} ms.", "Order {x} left, tracking {x}.", "Serial number {x}, firmware {v}",
    "IMEI {x}", "IMSI: {x}", "Session {x} closed", "Ticket {n}: {b} is slow on {w}.", "GET /{w}/{f} {n} {x}", "[{n}] INFO {w} {w} started after {n} ms", "{n} ERROR {b}: cannot read {f}", "Checksum {x} for {f}", "The {w} {w} was closed on {n}.",
    "{w} {w} opens at {n}.", "Ask for {b} at the counter.", "Learn {b} by reading {f}.", "Data of {b} and {b} were merged.", "User {w}{n} logged on from {v}.", "Account {x} has {n} points.", "Build {v} of {b} mends {n} bugs.",
    "coordinates {v}, -{v}", "uid={x} gid={x}", "In {w}, the {w} Festival starts.", "Dear {w}, hello", "Hello {w},\n\nThe {w} list", "On {w} the {w} {b} was cleaned.", "Picture {f}@2x.png is cached.", "Version {v}, {b} Edition",
    "Model {x}-{n}", "Invoice no. {x} dated {n}", "SID S-1-5-21-{x}-{x}-{n}", "MAC 0x{x}", "part no. {n}-{n}-{n}", "{x}", "{v}", "{n}", "{f}", "{b}", "{w}", "{x}(count)", "Lines {n} to {n} of {f} name {b}.", "{w} {n}, {w} {n}", "{b}: {n} new, {n} old",
    "Finally, {w} won. Later, {w} lost.", "Some {b} uses {v} and {v}.", "Item {x} and item {x} match.", "Copied by {b} to {h}", "Task {w} {w} ended: code {x}", "see {b}, {b}", "the {b} from {b}", "opened with {b}, closed with {b}", "user{n}: use {b} or {b}",
    "{b} Version {v} wurde eingerichtet.", "Die Datei {f} gehört zu {b}.", "Der Dienst {b} speichert {n} Werte.", "Seriennummer {x}, Stand {n}", "Die {w} {w} war leer.", "Im {w} lag {f}.", "Das {w} {w} in {w}", "Programm {b}, Fehler {x}",
    "Le logiciel {b} contient {n} fichiers.", "Le serveur {h} utilise {b} {v}.", "Numéro de série {x}", "La {w} {w} est fermée.", "Erreur {x} dans {b}", "El programa {b} guarda {n} registros.", "La copia {f} viene de {b}.",
    "Número de serie {x}", "La {w} {w} está cerrada.", "Error {x} en {b}", "{b} 프로그램에서 오류 {x} 발생", "파일 {f} 저장 완료, {n}건 처리.", "일련번호 {x} 장치", "버전 {v} 설치가 끝났다", "서버 {h} 응답 시간 {n}", "회의는 {n}에 시작한다.", "보고서 초안은 다음 주에 검토한다.",
    "user{n}: Yes, {w} went home", "[{n}] user{n}: Sure, That took {n} hours", "{w}, {w} and {w} are closed", "Well, {w}, {w}, see {f}", "Next, {b} was sold.", "Here, Nobody knows {f}.",
    "{b} says that {n} updates wait.", "user{n}: {b} has crashed again", "{b} is slow and {b} was slow", "{b} will restart at {n}", "user{n}: {b} and {b} are running", "{b} ({v})", "from {b} to {h}", "[{n}] {b}: {w} {n}", "by {b}, {n}",
)
#: Every so many-th template is held out as a whole when figures are taken.
HELD_OUT = 5


def _make(rng: random.Random, code: str, used: dict[str, tuple[int, int]]) -> str:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    low = lambda n=2: _coined(rng, n).lower()
    if code in "pkq":
        given, family = _coined(rng, rng.choice((1, 2, 2, 3))), _coined(rng, rng.choice((1, 2, 3, 3)))
        middle = rng.random()
        given = given[: rng.randint(2, 3)] if rng.random() < 0.05 else given
        if rng.random() < 0.97:  # the corpus doesn't know every name
            used[given.lower()], used[family.lower()] = (rng.randint(2, TOP), 0), (0, rng.randint(2, TOP))
        if code == "k":
            return family.upper() if rng.random() < 0.1 else family
        if code == "q":
            name = rng.choice("김이박최정강조윤장임한오서신권황안송류홍") + "".join(rng.choice("가온누리다솜라새론서하람별초롱민준지우현수연진영") for _ in range(2))
            if rng.random() < 0.97:
                used[name] = (rng.randint(2, TOP), rng.randint(2, TOP))
            return name
        if middle < 0.06:
            second = _coined(rng)
            used[second.lower()] = (rng.randint(2, TOP), 0)
            return f"{given} {second} {family}"
        if middle < 0.10:
            return f"{given} {rng.choice(('van', 'de', 'von', 'van der', 'de la'))} {family}"
        name = rng.choice((f"{given} {family}",) * 6 + (f"{given} {rng.choice('ABCDEHKLR')}. {family}", f"{given[0]}. {family}", f"{family}, {given}", f"{given}  {family}"))
        return name.upper() if rng.random() < 0.12 else name
    if code == "e":
        local = rng.choice((low(), f"{low()}.{low()}", f"{low()}_{rng.choice('abcdefgh')}{d(2)}", f"{low(3)}{rng.choice(('19', '20'))}{d(2)}", f"{low()}-{d(4)}", f"{low()}+{low()}", f"{rng.choice('abcdefg')}.{low()}"))
        host = rng.choice(("", "", "mx.", "post.")) + low() + rng.choice(("", "", "-mail", "-labs", d(1)))
        top = rng.choice((*sorted(TOP_LEVEL), "de", "fr", "es", "co", "kr", "co.uk", "eu", "nl"))
        return rng.choice((f"{local}@{host}.{top}",) * 5 + (f"{local} (at) {host} (dot) {top}", f"{local} [at] {host}.{top}", f"{local} AT {host} DOT {top}", f"{local}@{host}.{top}".upper()))
    if code == "t":
        s = rng.choice("- ")
        return rng.choice((f"010-{d(4)}-{d(4)}", f"010{d(8)}", f"+82{s}10{s}{d(4)}{s}{d(4)}", f"({rng.randint(2, 9)}{d(2)}) {d(3)}-{d(4)}", f"{rng.randint(2, 9)}{d(2)}-{d(3)}-{d(4)}", f"{rng.randint(2, 9)}{d(2)}.{d(3)}.{d(4)}", f"+1-{rng.randint(2, 9)}{d(2)}-{d(3)}-{d(4)}", f"07{d(3)} {d(6)}", f"+44 7{d(3)} {d(6)}", f"+44 (0)20 {d(4)} {d(4)}", f"+49 30 {d(5)} {d(3)}", f"01 {d(2)} {d(2)} {d(2)} {d(2)}", f"+44{d(10)}", f"07{d(9)}", f"01{d(8)}", f"{rng.randint(2, 9)}{d(9)}"))
    if code == "i":
        return rng.choice((f"{d(6)}-{d(7)}", f"{d(3)}-{d(2)}-{d(4)}", f"{rng.choice(('QQ', 'AB', 'JK'))}{d(6)}{rng.choice('ABCD')}", f"QQ {d(2)} {d(2)} {d(2)} A", f"{d(8)}-{rng.choice('ABCXYZ')}", f"{rng.choice('CKLMX')}{rng.choice('CKLMX')}{d(7)}"))
    if code == "a":
        town, post, no = _coined(rng, rng.choice((2, 3, 3))), d(5), d(rng.randint(1, 3)).lstrip("0") or "7"
        return rng.choice((
            f"{no} {_coined(rng)} {rng.choice(('Street', 'Ave.', 'Lane', 'Road', 'St', 'Blvd', 'Drive'))}, {town}{rng.choice((' ', ', OR ', ', NY '))}{post}", f"{no} {_coined(rng)} Court, Apt {d(1)}, {town} {post}", f"Flat {d(2)}, {no} {_coined(rng)} Street, {town}",
            f"{no} {_coined(rng)} Road, {town} {rng.choice(('AB1 2CD', 'N16 5XY', 'EH3 7QA'))}", f"P.O. Box {d(4)}, {town} {post}", f"{_coined(rng, rng.choice((1, 2)))}{rng.choice(('weg', 'allee', 'gasse', 'straße'))} {no}, {rng.choice((post, post, d(4)))} {town}",
            f"{no} {rng.choice(('rue', 'avenue', 'impasse'))} {rng.choice(('du', 'des', 'de la'))} {_coined(rng)}, {post} {town}", f"{rng.choice(('Calle', 'Avenida', 'Plaza'))} de las {_coined(rng)} {no}, {post} {town}", f"{rng.choice(('한빛시', '서울특별시', '경기도'))} {rng.choice(('솔밭로', '새터길', '큰마을로'))} {d(2)}{rng.choice(('', '길'))} {no}",
        ))
    if code == "b":
        first, second = _coined(rng), _coined(rng)
        if rng.random() < 0.3:  # some words of products are names too
            used[first.lower()] = rng.choice(((rng.randint(1, TOP), 0), (0, rng.randint(1, TOP))))
        elif rng.random() < 0.1:
            used[second.lower()] = (0, rng.randint(1, TOP))
        return rng.choice((f"{first} {second}",) * 5 + (f"{first} {second} {_coined(rng)}",))
    if code == "n":
        return rng.choice((d(2), d(4), d(5), f"{d(2)}:{d(2)}", f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}"))
    if code == "f":
        return f"{low()}_{low()}{d(3)}.{rng.choice(('pdf', 'zip', 'txt', 'docx'))}"
    if code == "h":
        return f"{low()}.{rng.choice(('test', 'example', 'invalid', 'net'))}"
    if code == "v":
        return rng.choice((f"{d(1)}.{d(2)}.{d(4)}", f"{d(5)}.{d(5)}.{d(5)}", f"203.0.113.{d(2)}", f"{d(2)}.{d(4)}", f"10.{d(3)}.{d(3)}.{d(4)}"))
    if code == "x":
        return rng.choice((d(13), d(15), d(10), d(11), d(9), d(8), f"{d(5)}-{d(5)}", f"{d(9)}-{d(9)}", "0x" + d(8), f"{d(3)}-{d(2)}-{d(3)}-C", f"1{d(9)}", f"16{d(11)}"))
    return _coined(rng)


def _texts(seed: int, sentences: int, part: str) -> tuple[list[tuple[str, set]], Names]:
    """Made-up texts with their mentions, and the names that they use. ``part`` is ``all``, ``kept`` or ``held`` templates."""
    rng = random.Random(seed)
    mine = lambda templates: [t for k, t in enumerate(templates) if part == "all" or (k % HELD_OUT == 1) == (part == "held")]
    positive, negative = mine(_POSITIVE), mine(_NEGATIVE)
    texts, used = [], {}
    for _ in range(sentences):
        text, gold = "", set()
        for _ in range(rng.choice((1, 1, 2, 3))):
            pattern = rng.choice(positive if rng.random() < 0.55 else negative)
            text += rng.choice((" ", " ", "\n")) if text else ""
            for literal, code in re.findall(r"([^{]*)(?:\{(\w)\})?", pattern):
                text += literal
                if code:
                    value = _make(rng, code, used)
                    if code in "petiakq":
                        gold.add((len(text), len(text) + len(value), {"p": 4, "k": 4, "q": 4, "e": 0, "t": 1, "i": 2, "a": 3}[code]))
                    text += value
        if rng.random() < 0.06 and len(text.upper()) == len(text):
            text = text.upper()
        if rng.random() < 0.08 and len(text) > 20:  # cut short: what the cut goes through is no mention any more
            text = text[: rng.randint(10, len(text) - 1)]
            gold = {g for g in gold if g[1] <= len(text)}
        texts.append((text, gold))
    return texts, Names.of_words(used)


def training_rows(seed: int = 11, sentences: int = TRAINING_SENTENCES, part: str = "all") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates in ``sentences`` made-up texts."""
    texts, names = _texts(seed, sentences, part)
    xs, ys = [], []
    for text, gold in texts:
        spans = spans_of(text, names)
        # what lies inside a mention of its own type is neither right nor wrong
        spans = [s for s in spans if not any(g[2] == s.kind and g[0] <= s.start and s.end <= g[1] and g[:2] != (s.start, s.end) for g in gold)]
        if spans:
            xs.append(features(text, spans, names))
            ys.append([(s.start, s.end, s.kind) in gold for s in spans])
    return np.concatenate(xs), np.concatenate([np.array(y, float) for y in ys])


@dataclass
class Model:
    boosted: Boosted
    thresholds: np.ndarray


@functools.cache
def trained(seed: int = 11, sentences: int = TRAINING_SENTENCES, part: str = "all") -> Model:
    """Trees on four fifths of the made-up rows; calibration and, for each type, the threshold of the best F1 on the rest."""
    x, y = training_rows(seed, sentences, part)
    held = np.random.default_rng(seed).random(len(y)) < 0.2
    boosted = Boosted().fit(x[~held], y[~held]).calibrate(x[held], y[held])
    p, thresholds = boosted.probability(x[held]), np.full(len(TYPES), 0.5)
    for k in range(len(TYPES)):
        of, want = p[x[held, 0] == k], y[held][x[held, 0] == k]
        if len(of):
            grid = np.linspace(0.2, 0.8, 25)
            scores = [2 * (want * (of >= t)).sum() / max(1, want.sum() + (of >= t).sum()) for t in grid]
            top = np.flatnonzero(np.array(scores) >= max(scores) - 1e-9)
            thresholds[k] = grid[top[len(top) // 2]]
    return Model(boosted, thresholds)


def held_out_figures(seed: int = 5, sentences: int = 3000) -> dict[str, tuple[float, float]]:
    """(recall, precision) of each type's mentions in sentences of the templates that a model wasn't trained on."""
    texts, names = _texts(seed, sentences, "held")
    chosen = mentions_of([t for t, _ in texts], names, trained(part="kept"))
    out = {}
    for k, kind in enumerate(TYPES):
        want = {(i, *g) for i, (_, gold) in enumerate(texts) for g in gold if g[2] == k}
        got = {(i, s.start, s.end, s.kind) for i, spans in enumerate(chosen) for s in spans if s.kind == k}
        out[kind] = (len(want & got) / len(want), len(want & got) / max(1, len(got)))
    return out


# ---------------------------------------------------------------- selection


def choose(spans: list[Span], p: np.ndarray, thresholds: np.ndarray) -> list[Span]:
    """The best non-overlapping spans over their thresholds: most probable first, of about equals the longer."""
    order = sorted((i for i, s in enumerate(spans) if p[i] >= thresholds[s.kind]), key=lambda i: (-round(float(p[i]), 1), spans[i].start - spans[i].end, -p[i], spans[i].start))
    taken: list[Span] = []  # in the order of the text
    starts: list[int] = []
    for i in order:
        s = spans[i]
        k = bisect(starts, s.start)
        if (k == 0 or taken[k - 1].end <= s.start) and (k == len(taken) or taken[k].start >= s.end):
            taken.insert(k, s)
            starts.insert(k, s.start)
    return taken


def redact(text: str, chosen: list[Span]) -> str:
    out, at = [], 0
    for s in chosen:
        out += [text[at : s.start], PLACEHOLDERS[TYPES[s.kind]]]
        at = s.end
    return "".join([*out, text[at:]])


def mentions_of(texts: list[str | None], names: Names, model: Model) -> list[list[Span]]:
    """The chosen spans of each text; null and empty texts have none."""
    spans = [spans_of(t, names) if t else [] for t in texts]
    flat = [features(t, s, names) for t, s in zip(texts, spans, strict=True) if s]
    p = model.boosted.probability(np.concatenate(flat)) if flat else np.zeros(0)
    out, at = [], 0
    for s in spans:
        out.append(choose(s, p[at : at + len(s)], model.thresholds) if s else [])
        at += len(s)
    return out


# ---------------------------------------------------------------- Spark


@dataclass
class NameCounts:
    """What ``count_names`` counted: (h, given, family) levels by hash of the word, and how many words."""

    frame: DataFrame
    rows: int


def count_names(frame: DataFrame, column: str) -> NameCounts:
    """Count the words of a column of personal names (``Given Family``, ``Family, Given``, ``G. Family``) as given and family names.

    All rows are counted, with partial aggregation. The level of a count is ``USUAL`` if it is that of the word of which half of all uses are less
    or equally frequent, and one more or less for each factor of two, up to ``TOP`` and down to 0 (no name).
    """
    text = F.trim(F.regexp_replace(F.col(column), r"\s+", " "))
    plain = frame.select(text.alias("n")).filter(F.col("n").rlike(r"^[\p{L}\p{M}'’.,\- ]{2,60}$"))
    swapped = F.col("n").contains(", ")
    given = F.when(swapped, F.regexp_extract("n", r"^[^,]+, (\S+)", 1)).otherwise(F.regexp_extract("n", r"^(\S+) \S", 1))
    family = F.when(swapped, F.regexp_extract("n", r"^([^,]+),", 1)).otherwise(F.regexp_extract("n", r" (\S+)$", 1))
    alone = F.when(F.col("n").rlike(r"^[가-힣]{2,4}$"), F.col("n"))
    both = F.array(F.struct(F.lit(1).alias("g"), F.coalesce(alone, given).alias("w")), F.struct(F.lit(0).alias("g"), F.coalesce(alone, family).alias("w")))
    uses = plain.select(F.explode(both).alias("x")).filter((F.length("x.w") > 1) & ~F.col("x.w").endswith("."))
    uses = uses.select(F.xxhash64(F.lower("x.w")).alias("h"), "x.g")
    counts = cut(uses.groupBy("h").agg(F.sum("g").alias("given"), F.sum(1 - F.col("g")).alias("family")))
    # how many uses there are of words of each power of two: at most 64 rows
    usual = {}
    for kind in ("given", "family"):
        power = counts.filter(F.col(kind) > 0).groupBy(F.floor(F.log2(kind)).cast("int").alias("b")).agg(F.sum(kind).alias("n")).orderBy("b").collect()
        half, total = sum(r["n"] for r in power) / 2, 0
        usual[kind] = 0
        for r in power:
            total += r["n"]
            usual[kind] = r["b"]
            if total >= half:
                break
    level = lambda kind: F.when(F.col(kind) > 0, F.greatest(F.least(F.floor(F.log2(kind)).cast("int") - usual[kind] + USUAL, F.lit(TOP)), F.lit(0))).otherwise(0)
    levels = counts.select("h", level("given").alias("given"), level("family").alias("family")).filter("given > 0 or family > 0")
    return NameCounts(levels, levels.count())


def collected(counts: NameCounts) -> Names:
    """The levels on the driver, to be sent to the workers; only for tables of at most ``NAME_ROWS``."""
    table = counts.frame.toPandas()
    return Names(table["h"].to_numpy(np.int64).view(np.uint64), table["given"].to_numpy(np.uint8), table["family"].to_numpy(np.uint8))


class _Every(Names):
    """Takes every word for a name and notes what it is asked for."""

    def __init__(self) -> None:
        self.asked: set[str] = set()

    def of(self, word: str) -> tuple[int, int]:
        self.asked.add(word)
        return (1, 1)


def asked_words(text: str) -> set[str]:
    """All words of a text whose levels the search for persons may ask for."""
    names = _Every()
    spans = [s for s in _persons(text, names) if s.kind == 4]
    return names.asked | {w for s in spans for w in (s.first, s.last) if w}


def joined_names(frame: DataFrame, counts: NameCounts) -> DataFrame:
    """(r, t, w, h, g): ``frame`` (r, t) with the name words of each text and their levels, for tables of levels too large to send.

    The words are joined with the levels (salted, since a frequent name is in many texts), and only those that are names come back to the text's row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, int(np.uint64(hashed(w)).view(np.int64))) for k, t in zip(batch["k"], batch["t"], strict=True) if isinstance(t, str) for w in asked_words(t)]
            yield pd.DataFrame(rows, columns=["k", "h"])

    keyed = cut(frame.withColumn("k", F.monotonically_increasing_id()))
    words = keyed.select("k", "t").mapInPandas(run, "k bigint, h bigint")
    known = lookup(words, counts.frame, "h", "k", "inner", rows=0)
    per = known.groupBy("k").agg(F.collect_set(F.struct("h", F.col("given").alias("g"), F.col("family").alias("f"))).alias("levels"))
    return keyed.join(per, "k", "left").drop("k")


def _per_batch(frame: DataFrame, row: str, column: str, names: Names | NameCounts, model: Model, make, schema: str) -> DataFrame:
    read = spread(frame.select(F.col(row).alias("r"), F.col(column).cast("string").alias("t")))
    if isinstance(names, NameCounts):
        if names.rows > NAME_ROWS:
            return _per_row_names(read, names, model, make, schema)
        names = collected(names)
    keys, given, family = names.keys.tobytes(), names.given.tobytes(), names.family.tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Names(np.frombuffer(keys, np.uint64), np.frombuffer(given, np.uint8), np.frombuffer(family, np.uint8))
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["t"]]
            yield make(batch["r"], texts, mentions_of(texts, own, model))

    return read.mapInPandas(run, schema)


def _per_row_names(read: DataFrame, counts: NameCounts, model: Model, make, schema: str) -> DataFrame:
    """The same with the levels that were joined to each row; a level depends on the word alone, so those of a batch are put together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            levels = {(x["h"], x["g"], x["f"]) for found in batch["levels"] if found is not None for x in found}
            table = np.array(sorted(levels), np.int64).reshape(-1, 3)
            own = Names(table[:, 0].copy().view(np.uint64), table[:, 1].astype(np.uint8), table[:, 2].astype(np.uint8))
            texts = [t if isinstance(t, str) else None for t in batch["t"]]
            yield make(batch["r"], texts, mentions_of(texts, own, model))

    return joined_names(read, counts).select("r", "t", "levels").mapInPandas(run, schema)


def list_mentions(frame: DataFrame, row: str, column: str, names: Names | NameCounts, model: Model | None = None) -> DataFrame:
    """(row, pii_type, pii_text): each distinct mention in each row's ``column``, exactly as written.

    Null, empty and mention-free texts give no row. Rows aren't compared with each other, so repeated rows each have their own list;
    other columns aren't read. Whole texts are read, however long.
    """

    def make(ids, texts, chosen):
        out = {(i, k, TYPES[s.kind], t[s.start : s.end]) for k, (i, t, c) in enumerate(zip(ids, texts, chosen, strict=True)) for s in c}
        return pd.DataFrame([(i, kind, text) for i, _, kind, text in sorted(out, key=lambda x: x[1:])], columns=["r", "pii_type", "pii_text"])

    kind = frame.schema[row].dataType.simpleString()
    out = _per_batch(frame.filter(F.col(column).isNotNull()), row, column, names, model or trained(), make, f"r {kind}, pii_type string, pii_text string")
    return out.withColumnRenamed("r", row)


def redact_column(frame: DataFrame, row: str, column: str, names: Names | NameCounts, model: Model | None = None) -> DataFrame:
    """(row, redacted): every row's text with typed placeholders; null stays null, empty stays empty."""

    def make(ids, texts, chosen):
        return pd.DataFrame({"r": ids, "redacted": [None if t is None else redact(t, c) for t, c in zip(texts, chosen, strict=True)]})

    kind = frame.schema[row].dataType.simpleString()
    return _per_batch(frame, row, column, names, model or trained(), make, f"r {kind}, redacted string").withColumnRenamed("r", row)
