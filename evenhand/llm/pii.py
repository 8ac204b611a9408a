"""Personal data: plain identifiers, and disguised ones found in a normalised text and mapped back.

Transducers rewrite a text while remembering, for each character they emit, which source characters it
stands for: lookalike letters and digits become ASCII, invisible characters vanish, runs of spelled digits become
digits, and at/dot disguises become ``@`` and ``.``. Identifiers found in the rewritten text become
spans of the source. Spans count code points; the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import small_batches, text_or_empty

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like ASCII letters.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁһӏԛԝАВЕКМНОРСТУХІЈЅαονρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijsdhlqwABEKMHOPCTYXIJSaovptuikABEZHIKMNOPTYX",
        strict=True,
    )
)
# Digits as words, in the languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
# A match can only begin where a run of digits begins, which the lookbehind says to save time in long runs.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT_WORDS |= {unicodedata.normalize("NFD", w): d for w, d in DIGIT_WORDS.items()}
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_ITEM = rf"(?:{_WORD}|[0-9]{{1,15}})"
# Commas, and dots before a space, separate the entries of lists and sentences, not the digits of a number.
_RUN = re.compile(rf"(?<![\w+])(?:(plus|\+)[\s-]{{0,3}})?(\(?{_ITEM}(?:(?:[\s()-]{{1,3}}|\.){_ITEM})+)(?!\w)", re.IGNORECASE)
# Words before a number that say what it is, in the languages of the corpus.
_CUE = re.compile(
    r"\b(?:call|ring|dial|phone|telephone|tel|mobile|cell|fax|sms|whatsapp|card|visa|mastercard|telefon|handy|rufen?|anrufen|karte|"
    r"tel[eé]fono|m[oó]vil|llam[ae]|tarjeta|t[eé]l[eé]phone|portable|appele[rz]|carte)\W{1,3}(?:\w{1,8}\W{1,3}){0,2}$",
    re.IGNORECASE,
)
_CUE_REACH = 48
#: Digit words in a row from which no other sign of a number is asked for.
_MANY = 7
_ITEMS = re.compile(_ITEM, re.IGNORECASE)
_YEAR = re.compile("(?:19|20)[0-9]{2}")
_ANY_ITEM = re.compile(rf"{_WORD}|[0-9]", re.IGNORECASE)
_DIGIT_WORDS = frozenset(DIGIT_WORDS)
# Fixed values: "null" is a digit only beside these, as tables and programs are full of it.
_GERMAN = frozenset(unicodedata.normalize(f, w) for f in ("NFC", "NFD") for w in ("eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"))
_SEPARATORS = str.maketrans("-,.()", "     ")
# Octets of digits or digit words; a dot followed but not preceded by space ends a sentence.
_OCTET = rf"(?:{_WORD}|[0-9]{{1,3}})(?:[\s-]{{1,3}}(?:{_WORD}|[0-9]{{1,3}})){{0,2}}"
_IP_DOT = r"(?:\.|\s{1,3}\.\s{1,3}|\s{1,3}dot\s{1,3})"
_SPELLED_IP = re.compile(rf"(?<![\w.])({_OCTET}){_IP_DOT}({_OCTET}){_IP_DOT}({_OCTET}){_IP_DOT}({_OCTET})(?!\w)", re.IGNORECASE)
_OPEN, _CLOSE = r"[(\[{<]", r"[)\]}>]"
_AT_IN = rf"\s{{0,3}}{_OPEN}\s?(?:at|@|ät|ät)\s?{_CLOSE}\s{{0,3}}"
_DOT_IN = rf"\s{{0,3}}{_OPEN}\s?(?:dot|punkt|punto|point|\.)\s?{_CLOSE}\s{{0,3}}"
_AT = re.compile(_AT_IN, re.IGNORECASE)
_DOT = re.compile(_DOT_IN, re.IGNORECASE)
_NO_NAME = r"(?!(?:the|an?|this|that|my|your|our|its)\s)"
_DOT_WORD = rf"(?:{_DOT_IN}|\s{{1,3}}dot\s{{1,3}}{_NO_NAME})"
_ANY_DOT = rf"(?:\.|{_DOT_WORD})"
# What may stand for the sign between a local part and a domain; the second form is a bare word and asks for a disguised dot in the domain.
_MARK = re.compile(rf"{_AT_IN}|\s{{1,3}}@\s{{1,3}}|@|(?P<bare>\s{{1,3}}at\s{{1,3}}){_NO_NAME}", re.IGNORECASE)
_NAME = re.compile(rf"[A-Za-z0-9-]+(?:{_ANY_DOT}[A-Za-z0-9-]+)+", re.IGNORECASE)
_LOCAL_DOT = re.compile(rf"{_ANY_DOT}$", re.IGNORECASE)
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_%+-")
#: Longest form of a disguised dot.
_DOT_REACH = 18
_DOTS = re.compile(rf"\.|{_DOT_WORD}", re.IGNORECASE)
_DISGUISED_DOT = re.compile(_DOT_WORD, re.IGNORECASE)

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, in time proportional to the text."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and not _LOCAL_END.match(text, start - 1):
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            last = domain.end()
        else:
            last = at + 1
        at = text.find("@", at + 1)


def plain(text: str) -> list[Span]:
    """Identifiers written plainly, per kind leftmost and non-overlapping; matches that fail a check are dropped."""
    found: list[Span] = [("email", s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Mapped:
    """A rewritten text and, for each of its characters, the source characters it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] | range = range(len(text))
        self.ends: list[int] | range = range(1, len(text) + 1)

    def rewrite(self, pattern: re.Pattern, emit: Callable[[re.Match], list[tuple[str, int, int]]]) -> None:
        """Replaces matches by characters, each with its first and last + 1 character in the present text."""
        self.replace((m.start(), m.end(), emit(m)) for m in pattern.finditer(self.text))

    def replace(self, passages: Iterable[tuple[int, int, list[tuple[str, int, int]]]]) -> None:
        """The same for passages given by start, end and characters, from left to right."""
        out, starts, ends, at = [], [], [], 0
        for start, end, chars in passages:
            out.append(self.text[at:start])
            starts += self.starts[at:start]
            ends += self.ends[at:start]
            for char, s, e in chars:
                out.append(char)
                starts.append(self.starts[s])
                ends.append(self.ends[e - 1])
            at = end
        if at:
            out.append(self.text[at:])
            starts += self.starts[at:]
            ends += self.ends[at:]
            self.text, self.starts, self.ends = "".join(out), starts, ends

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def _plain_form(char: str) -> str:
    """What a character beyond ASCII is read as; itself where that is not ASCII."""
    if unicodedata.category(char) == "Cf":
        return ""
    form = unicodedata.normalize("NFKC", char)
    form = "".join(str(unicodedata.decimal(c)) if unicodedata.category(c) == "Nd" else LOOKALIKES.get(c, c) for c in form)
    return form if form.isascii() else char


# Decimal digits, invisible characters and forms with an ASCII equivalent lie below these bounds.
_ODD = {c: form for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0080)]) if (form := _plain_form(c)) != c}


def _plain_char(m: re.Match) -> list[tuple[str, int, int]]:
    return [(c, m.start(), m.end()) for c in _ODD[m[0]]]


def _same(m: re.Match) -> list[tuple[str, int, int]]:
    return [(c, m.start() + i, m.start() + i + 1) for i, c in enumerate(m[0])]


def _digits_between(m: re.Match, start: int, end: int) -> list[tuple[str, int, int]]:
    return [(DIGIT_WORDS.get(d[0].lower(), d[0]), d.start(), d.end()) for d in _ANY_ITEM.finditer(m.string, start, end)]


def _octets(m: re.Match) -> list[tuple[str, int, int]]:
    """An address of four numbers up to 255, where words are among its digits or dots."""
    octets = [_digits_between(m, *m.span(i)) for i in range(1, 5)]
    values = ["".join(d[0] for d in octet) for octet in octets]
    if not _words_agree(_ANY_ITEM.findall(m[0])):
        return _same(m)
    if not re.search("[^0-9. ]", m[0]) or _IP.search(m[0]) or any(len(v) > 3 or int(v) > 255 for v in values):
        return _same(m)
    out = octets[0]
    for i in range(1, 4):
        out = [*out, (".", m.end(i), m.start(i + 1)), *octets[i]]
    return out


def _words_agree(items: list[str]) -> bool:
    words = {i.lower() for i in items}
    return "null" not in words or not _GERMAN.isdisjoint(words)


def _in_a_row(items: list[str]) -> int:
    """Most digit words that follow each other."""
    most = now = 0
    for item in items:
        now = 0 if item.isdigit() else now + 1
        most = max(most, now)
    return most


class Spans:
    """Spans of one kind that do not overlap, to be asked which of them meet a stretch."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.ends = [e for _, e in self.spans]

    def met(self, start: int, end: int) -> list[tuple[int, int]]:
        first = last = bisect_right(self.ends, start)
        while last < len(self.spans) and self.spans[last][0] < end:
            last += 1
        return self.spans[first:last]


def _number_in(m: re.Match, known: dict[str, Spans], mapped: Mapped) -> int | None:
    """Where in a run of digit words and groups a number of 10 to 15 digits, or a card, begins; groups before it, and years that it can do without, are left out.

    A run is a number only if something says so: a plus, a word like "call" or "card" before it, seven digit words in a row, or digit words
    throughout; cards pass Luhn and may also come in groups of four and more. One digit word is enough after a plus; without, or
    beside a number written plainly, two are needed.
    """
    items = [(d[0], d.start()) for d in _ITEMS.finditer(m.string, m.start(2), m.end(2))]
    texts = [t for t, _ in items]
    if all(t.isdigit() for t in texts) or not _words_agree(texts) or _IP.search(m[0]):
        return None
    s, e = mapped.source(m.start(), m.end())
    least = 1 if m[1] and not any(known[k].met(s, e) for k in ("card", "phone")) else 2
    told = bool(m[1]) or _CUE.search(m.string[max(0, m.start() - _CUE_REACH) : m.start()]) is not None
    values = [DIGIT_WORDS.get(t.lower(), t) for t in texts]
    left = sum(map(len, values))
    for i, (text, start) in enumerate(items):
        left -= len(values[i - 1]) if i else 0
        if left > 19:
            if not text.isdigit():
                return None
            continue
        rest, digits = texts[i:], "".join(values[i:])
        words = sum(not t.isdigit() for t in rest)
        shown = told or words == len(rest) or _in_a_row(rest) >= _MANY
        is_card = 14 <= len(digits) <= 19 and _luhn(digits) and (shown or all(len(t) >= 4 for t in rest if t.isdigit()))
        if is_card or (shown and 10 <= len(digits) <= 15 and words >= least):
            if m[1] or not _YEAR.fullmatch(text) or len(digits) < 14:
                return start if i or not m[1] else m.start()
        if not text.isdigit() or len(digits) < 10:
            return None
    return None


def _as(char: str) -> Callable[[re.Match], list[tuple[str, int, int]]]:
    return lambda m: [(char, m.start(), m.end())]


def _addresses(text: str) -> Iterator[tuple[int, int, list[tuple[str, int, int]]]]:
    """Addresses in which a sign is disguised, with each of their characters in place. A text is walked once, whatever it holds."""
    last = 0
    for mark in _MARK.finditer(text):
        if mark.start() <= last:
            continue
        name = _NAME.match(text, mark.end())
        if not name:
            continue
        hidden = _DISGUISED_DOT.search(name[0])
        if mark["bare"] and not (hidden and re.search(r"[^A-Za-z0-9-][A-Za-z]{2,}$", name[0]) and text[name.end() : name.end() + 1] != "_"):
            continue
        start = at = mark.start()
        while True:
            while at > last and text[at - 1] in _LOCAL:
                at -= 1
            if at == start:
                break
            start = at
            dot = _LOCAL_DOT.search(text[max(last, at - _DOT_REACH) : at])
            if not dot:
                break
            at -= len(dot[0])
        if start == mark.start() or (start and (text[start - 1].isalnum() or text[start - 1] == ".")):
            continue
        end, local = name.end(), text[start : mark.start()]
        last = end
        if mark[0].strip() != "@" or mark[0] != "@" or hidden or _DISGUISED_DOT.search(local):
            dots = [(d.start(), d.end(), ".") for a, b in ((start, mark.start()), (mark.end(), end)) for d in _DOTS.finditer(text, a, b)]
            out, at = [], start
            for s, e, char in sorted([*dots, (*mark.span(), "@")]):
                out += [(text[i], i, i + 1) for i in range(at, s)]
                out.append((char, s, e))
                at = e
            yield start, end, out + [(text[i], i, i + 1) for i in range(at, end)]


def disguised(text: str, known: list[Span]) -> list[Span]:
    """Further identifiers, visible only in the rewritten text.

    One that overlaps known ones of its kind is added only if it holds all of each and more.
    """
    mapped, spelled = Mapped(text), []
    if not text.isascii() and (odd := _ODD.keys() & set(text)):
        mapped.rewrite(re.compile(f"[{''.join(sorted(odd))}]"), _plain_char)
    if _DISGUISED_DOT.search(mapped.text):
        mapped.replace(_addresses(mapped.text))
    if any(map(mapped.text.__contains__, "([{<")):
        mapped.rewrite(_DOT, _as("."))
        mapped.rewrite(_AT, _as("@"))
    words = mapped.text.lower().translate(_SEPARATORS).split()
    if not _DIGIT_WORDS.isdisjoint(words) or "dot" in words:
        mapped.rewrite(_SPELLED_IP, _octets)
    of_kind = {kind: Spans([(s, e) for k, s, e in known if k == kind]) for kind in KINDS}
    if not _DIGIT_WORDS.isdisjoint(words):

        def number(m: re.Match) -> list[tuple[str, int, int]]:
            start = _number_in(m, of_kind, mapped)
            if start is None:
                return _same(m)
            digits = _digits_between(m, start, m.end())
            if 10 <= sum(len(d[0]) for d in digits) <= 15:
                spelled.append(("phone", *mapped.source(start if start == m.start() else digits[0][1], digits[-1][2])))
            plus = [("+", m.start(1), m.end(1))] if m[1] and start == m.start() else []
            return [(c, i, i + 1) for i, c in enumerate(m.string[m.start() : start], m.start())] + plus + digits

        mapped.rewrite(_RUN, number)
    if mapped.text == text and not spelled:
        return []
    found = [(kind, *mapped.source(s, e)) for kind, s, e in plain(mapped.text)] + spelled
    new: list[Span] = []
    # Of the new spans of a kind: the farthest end, and that of those which begin where the present one does.
    reach, here = dict.fromkeys(KINDS, (-1, -1)), dict.fromkeys(KINDS, (-1, -1))
    for kind, start, end in in_order(found):
        if here[kind][0] != start:
            reach[kind] = max(reach[kind], (here[kind][1], here[kind][1]))
            here[kind] = (start, -1)
        if reach[kind][0] > start or here[kind][1] >= end:
            continue
        met = of_kind[kind].met(start, end)
        if all(start <= s and e <= end and (s, e) != (start, end) for s, e in met):
            new.append((kind, start, end))
            here[kind] = (start, end)
    return new


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or each run of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


RESULT = "n_email long, n_ip long, n_card long, n_phone long, n_disguised long, base_sha256 string, spans string"


def find(docs: DataFrame, text_col: str = "text", redact: bool = False) -> DataFrame:
    """``docs`` with counts of plain identifiers per kind, n_disguised, base_sha256 and spans; columns of these names are replaced.

    spans lists plain and disguised identifiers as kind:start:end by start, then kind. base_sha256 hashes the list of
    plain ones alone. With ``redact`` a column named redacted holds the text without them. A null or empty text
    has no spans (and stays null or empty). Every row is searched on its own, so repeats get equal results.
    """
    small_batches(docs.sparkSession)
    result = RESULT + (", redacted string" if redact else "")
    names = [f.split()[0] for f in result.split(", ")]

    @F.pandas_udf(result)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                base = plain(text)
                more = disguised(text, base)
                spans = in_order(base + more)
                counts = [sum(s[0] == kind for s in base) for kind in KINDS]
                row = [*counts, len(more), hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(spans)]
                rows.append([*row, redacted(text, spans)] if redact else row)
            yield pd.DataFrame(rows, columns=names)

    kept = [F.col(c) for c in docs.columns if c not in names]
    out = docs.select(*kept, search(text_or_empty(text_col)).alias("_pii")).select(*kept, "_pii.*")
    return out.withColumn("redacted", F.when(F.col(text_col).isNotNull(), F.col("redacted"))) if redact else out
