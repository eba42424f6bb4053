"""Text that was decoded with the wrong character encoding: find it, and restore it where that is possible.

Round-trip repair: a text is encoded again in the encoding that it may have been read with by mistake and decoded strictly in the one that
was meant. Layers are taken off one after the other. A repair is accepted if the garbling cost drops: the cost counts what doesn't occur in
words as people write them (symbols inside words, scripts that change within a word, capitals after small letters, control characters).
Words are judged one by one, so a garbled part of a clean text is found and its clean words are left as they are; where a word has several
repairs, the one that fits most words of the field counts. One repair of the whole field is taken only if its cost is lower still and it
changes no word without cost.
One Arrow pass over each field, no shuffle; the cost of a word is remembered within a batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import spread

#: Bytes that have no character in the most usual legacy encoding pass through as control characters, as browsers do it.
_SLOPPY = {ord(bytes([b]).decode("cp1252")): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
#: (read with by mistake, meant). The first group proves itself, since hardly any other text is valid in UTF-8; of the others a word must come
#: out without any cost.
STRONG = tuple((wrong, "utf-8") for wrong in ("cp1252", "mac_roman", "cp437", "cp850", "cp949", "cp1251", "cp866", "cp1250", "koi8_r", "cp932", "gbk"))
WEAK = (("cp1252", "cp949"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp949", "cp1252"))
LAYERS = 3

_TOKEN = re.compile(r"[^ \t\r\n\f\v]*[^\x00-\x7f \t\r\n\f\v][^ \t\r\n\f\v]*")
_EDGES = set("“”„‚‘’«»‹›–—…¿¡•·")
_LETTER_LIKE = set("ªº²³¹¼½¾")
#: Accented letters that are frequent in Western languages; of repairs that are as good otherwise, the one with fewer others counts.
_USUAL = set("äöüßéèêëàâçîïôûñáíóúÄÖÜÉ")
#: Letters beyond Latin-1 that Western texts hold.
_WESTERN = set("ŒœŠšŽžŸƒ€")
_HIGH_RUN = re.compile(r"[^\x00-\x7f]{4,}")


def encode(text: str, encoding: str) -> bytes:
    if encoding == "cp1252":
        return text.translate(_SLOPPY).encode("latin-1")
    return text.encode(encoding)


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x370 <= o < 0x400:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0xAC00 <= o < 0xD7B0 or 0x1100 <= o < 0x1200 or 0x3130 <= o < 0x3190:
        return "hangul"
    if 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00:
        return "han"
    return "kana" if 0x3040 <= o < 0x3100 else "other"


def cost(word: str) -> int:
    """How little a word looks like one; 0 for words as people write them."""
    total, n = 0, len(word)
    for i, c in enumerate(word):
        o = ord(c)
        if o < 0x80:
            continue
        before, after = word[i - 1] if i else " ", word[i + 1] if i + 1 < n else " "
        if o == 0xFFFD:
            total += 4
        elif o < 0xA0:
            total += 3
        elif 0x2500 <= o < 0x25A0:
            total += 2
        elif c.isalpha() and c not in _LETTER_LIKE:
            kind = _script(c)
            if before.isalpha() and before not in _LETTER_LIKE:
                other = _script(before)
                if other != kind and {other, kind} != {"han", "kana"}:
                    total += 2
                elif c.isupper() and before.islower():
                    total += 2
            if ord(after) < 0x80 and after.isalpha() and kind != "latin":
                total += 2
            if kind == "latin" and after.islower() and after.isascii() and c.isupper() and before.isalpha():
                total += 1
            if n == 1 and c in "ñÃÂÐÑ":
                total += 2
        elif unicodedata.category(c)[0] in "SPNC" or c == " ":
            inside = before.isalpha() and after.isalpha()
            touches = before.isalpha() or after.isalpha()
            if c in _EDGES:
                if c == "·":
                    total += 2 if touches and not (before in "lL" and after in "lL") else 0
                elif c in "‹›„‚":
                    total += 2 if (before.isalpha() and c != "›") or (touches and c in "‹›" and not ("‹" in word and "›" in word)) else 0
                elif c == "—":
                    total += 1 if inside and before.isupper() and after.isupper() else 0
                else:
                    total += 2 if inside and c not in "’‘–…" else 0
            elif c == "°":
                total += 2 if before.isalpha() and before not in "nNº" or (after.isalpha() and after not in "CFKcfk") else 0
            elif c in "ªº":
                total += 2 if after.isalpha() or (before.isalpha() and before not in "nN") else 0
            elif c == " ":
                total += 1 if before in "ÃÂ" else 0
            elif o < 0x2000 or c in "†‡ˆ‰™ﬂﬁ˜ƒ∂∆∏∑−√∞∫≈≠≤≥◊⌐⌠⌡":
                total += 2 if touches else 0
                total += 1 if not touches and (ord(before) > 0x7F or ord(after) > 0x7F) else 0
        if c in "ﬂﬁ":
            total += 2
    return total + _disguised(word)


def _disguised(word: str) -> int:
    """The number of characters that a word of plain letters and marks hides: those of valid UTF-8 that Western texts hold, and Korean or Russian letters in runs."""
    for wrong in ("cp1252", "mac_roman"):
        try:
            read = encode(word, wrong).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        high = [c for c in read if ord(c) > 0x7F]
        if all(0xA0 <= ord(c) < 0x100 or c in _WESTERN or 0x2010 <= ord(c) < 0x203B for c in high):
            return len(high)
    total = 0
    for m in _HIGH_RUN.finditer(word):
        for meant, script in (("cp949", "hangul"), ("cp1251", "cyrillic")):
            try:
                read = encode(m.group(), "cp1252").decode(meant)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if all(_script(c) == script for c in read) and (read[1:].islower() or script == "hangul" or read.isupper()):
                total += len(read)
                break
    return total


def _round_trips(text: str, pairs) -> Iterator[tuple[str, str]]:
    for wrong, meant in pairs:
        try:
            yield encode(text, wrong).decode(meant), f"{wrong}>{meant}"
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue


def repair_word(word: str) -> tuple[int, int, dict[str, str]]:
    """(cost before, cost after, readings) of one word. readings has, by the encodings taken off, the best reading first; there are several if legacy
    encodings give equally good ones."""
    first = now = cost(word)
    done: list[str] = []
    readings = {"": word}
    for _ in range(LAYERS):
        if now == 0:
            break
        best = min(((cost(t), k, t, name) for k, (t, name) in enumerate(_round_trips(word, STRONG)) if t != word), default=None)
        if best is not None and best[0] < now:
            now, _, word, name = best
            done.append(name)
            readings = {"+".join(done): word}
            continue
        weak = [(sum(ord(c) > 0x7F and c.isalpha() and c not in _USUAL and _script(c) == "latin" for c in t), k, t, name) for k, (t, name) in enumerate(_round_trips(word, WEAK)) if t != word and cost(t) == 0 and not any(ord(c) < 0x20 for c in t)]
        if weak:
            now = 0
            readings = {"+".join([*done, name]): t for _, _, t, name in sorted(weak)}
    return first, now, readings


def _lost(word: str) -> bool:
    """Garbled for sure, though no round trip is left: replacement or control characters, Chinese and Korean in turns, or broken remains of UTF-8."""
    if "�" in word or any(0x80 <= ord(c) < 0xA0 and c != "\x85" for c in word):
        return True
    if cost(word) > 2:
        for wrong in ("cp1252", "mac_roman", "cp437"):
            try:
                raw = encode(word, wrong)
            except UnicodeEncodeError:
                continue
            high = sum(b > 0x7F for b in raw)
            kept = sum(len(c.encode()) for c in raw.decode("utf-8", "ignore") if ord(c) > 0x7F)
            if kept >= 2 and 2 * kept >= high:
                return True
    kinds = [_script(c) for c in word if c.isalpha()]
    return sum({a, b} == {"han", "hangul"} for a, b in zip(kinds, kinds[1:], strict=False)) >= 2


def _through(text: str, chain: str) -> str | None:
    """``text`` after all round trips of ``chain``; null if one fails."""
    try:
        for step in chain.split("+"):
            wrong, meant = step.split(">")
            text = encode(text, wrong).decode(meant)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None
    return text


def _total(text: str) -> int:
    return sum(cost(m.group()) for m in _TOKEN.finditer(text))


def examine(text: str | None, seen: dict | None = None) -> tuple[bool, str | None, str]:
    """(garbled, restored text or null if it can't be restored, encodings). Clean, null and empty texts come out as (False, text, '').

    Words without garbling cost stay as they are, whatever is repaired beside them.
    """
    if not text or text.isascii():
        return False, text, ""
    seen = {} if seen is None else seen
    votes: dict[str, int] = {}
    left = 0
    for m in _TOKEN.finditer(text):
        w = m.group()
        r = seen.get(w)
        if r is None:
            before, after, readings = repair_word(w)
            r = seen[w] = (before > after, readings, _lost(next(iter(readings.values()))), before == 0)
        if r[0]:
            for name in r[1]:
                votes[name] = votes.get(name, 0) + 1
        left += r[2]
    if not votes:
        return left > 0, None if left else text, ""
    chain = max(votes, key=votes.__getitem__)
    if left:
        return True, None, chain

    def reading(m: re.Match) -> str:
        readings = seen[m.group()][1]
        return readings[max(readings, key=votes.__getitem__)] if seen[m.group()][0] else m.group()

    joined = _TOKEN.sub(reading, text)
    whole = _through(text, chain)
    if whole is not None and whole != joined and _total(whole) < _total(joined):
        old, new = re.split(r"[ \t\r\n\f\v]+", text), re.split(r"[ \t\r\n\f\v]+", whole)
        if len(old) == len(new) and all(a == b or (a in seen and not seen[a][3]) for a, b in zip(old, new, strict=True)):
            return True, whole, chain
    return True, joined, chain


def find_garbled(frame: DataFrame, row: str, fields: tuple[str, ...]) -> DataFrame:
    """(row, field_name, restored, encodings): each field of each row that was decoded wrongly, wholly or in part.

    restored is null where characters were lost. Null, empty and clean fields give no row; repeated rows are judged each. Whole texts are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict = {}
            out = []
            for f in fields:
                for i, text in zip(batch["r"], batch[f], strict=True):
                    if isinstance(text, str) and not text.isascii():
                        bad, restored, chain = examine(text, seen)
                        if bad:
                            out.append((i, f, restored, chain))
            yield pd.DataFrame(out, columns=["r", "field_name", "restored", "encodings"])

    kind = frame.schema[row].dataType.simpleString()
    read = frame.select(F.col(row).alias("r"), *(F.col(f).cast("string").alias(f) for f in fields))
    return spread(read).mapInPandas(run, f"r {kind}, field_name string, restored string, encodings string").withColumnRenamed("r", row)
