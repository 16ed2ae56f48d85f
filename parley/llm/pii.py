"""Personal data, plain and in disguise, with places in the text as it is (operator 6).

Plain forms are matched in the text itself. Disguises are undone by transducers that rewrite a
text and note for each character it puts out which characters of the source it stands for: letters
that look like Latin ones or digits, spelled-out digits, and words for the at sign and the dot. The same
identifiers are then sought in the rewritten text, and their places mapped back to the source. Plain spans
always stay. A found span that touches a plain one is added if it properly holds it, is of its kind and goes
beyond it without free blanks, as where one lookalike cuts an address in two; others that touch one are left out.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns. An address is sought from its at sign, a number from a digit that begins a run: matches are
# the same as from the left, without trying each character of a long text again.
_LOCAL = frozenset(
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
)
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Spelled digits in the languages of the texts, and words for signs (fixed values).
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "f\u00fcnf": "5",
    "fu\u0308nf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "z\u00e9ro": "0", "ze\u0301ro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8",
    "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS = ("at", "arroba", "arobase")
#: At-words that mean nothing else, so that an address with plain dots counts.
SURE_AT_WORDS = ("arroba", "arobase")
DOT_WORDS = ("dot", "punkt", "point", "punto")
# Cyrillic and Greek letters that look like Latin ones, and what they look like (fixed values).
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТХУаеѕіјорсухԁɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν",
        "ABESIJKMHOPCTXYaesijopcyxdgABEZHIKMNOPTYXoav",
        strict=True,
    )
)
# Characters that print as nothing, and ones that print as a hyphen or a blank (fixed values).
UNSEEN = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")
HYPHENS = frozenset("\u2010\u2011\u2012\u2212")
BLANKS = frozenset("\u00a0\u2007\u202f")
#: So many digits in a row, all spelled or spelled and literal ones, are a number.
LEAST_DIGITS = 4

_WORD = r"(?<![A-Za-z0-9])(?:{})(?![A-Za-z0-9])"
_WORDS = "|".join(sorted(DIGITS, key=len, reverse=True))
_PARTING = r"[\x20,-]{1,2}"
_SPELLED = re.compile(
    _WORD.format(_WORDS)
    + rf"(?:{_PARTING}(?:{_WORDS})(?![A-Za-z0-9])){{{LEAST_DIGITS - 1},}}",
    re.I,
)
_ONE = re.compile(_WORDS, re.I)
# A run with literal digits as well.
_MIXED = re.compile(
    _WORD.format(f"{_WORDS}|[0-9]+")
    + rf"(?:{_PARTING}(?:{_WORDS}|[0-9]+)(?![A-Za-z0-9]))+",
    re.I,
)
# Where a spelled digit meets a literal one, sought from the literal one.
_FOLLOWED = re.compile(rf"[0-9]{_PARTING}(?:{_WORDS})(?![A-Za-z0-9])", re.I)
_LED = re.compile(r"[0-9](?:(?<=[A-Za-z][\x20,-][0-9])|(?<=[A-Za-z][\x20,-][\x20,-][0-9]))")
_LEADS = re.compile(rf"(?<![A-Za-z0-9])(?:{_WORDS}){_PARTING}\Z", re.I)
_LONGEST = max(map(len, DIGITS)) + 3
_ITEM = re.compile(f"{_WORDS}|[0-9]+", re.I)
_OPEN, _CLOSE = r"[\[({<]\x20?", r"\x20?[\])}>]"
_ENTITY_AT, _ENTITY_DOT = r"&(?:#0*64|#x0*40|commat);", r"&(?:#0*46|#x0*2e|period);"
#: Without blanks around it, an a in brackets is an at sign too.
_A_SIGN = r"[\[({<]a[\])}>]"
_SIGN_AT = rf"(?:{_ENTITY_AT}|{_A_SIGN}|\x20?{_OPEN}(?:at|ät|@|arroba|arobase){_CLOSE}\x20?|\x20(?:{'|'.join(AT_WORDS)})\x20|\x20@\x20)"
_SIGN_DOT = rf"(?:{_ENTITY_DOT}|\x20?{_OPEN}(?:\.|{'|'.join(DOT_WORDS)}){_CLOSE}\x20?|\x20(?:{'|'.join(DOT_WORDS)})\x20)"
_NAME = r"[A-Za-z0-9_%+-]{1,64}"
#: A whole address in which the at sign or a dot is disguised. Words that stand free need both.
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<local>{_NAME}(?:(?:\.|{_SIGN_DOT}){_NAME}){{0,4}})"
    rf"(?P<at>{_SIGN_AT}|@)"
    rf"(?P<domain>[A-Za-z0-9-]{{1,63}}(?:(?:\.|{_SIGN_DOT})[A-Za-z0-9-]{{1,63}}){{1,5}})"
    rf"(?![A-Za-z0-9-])",
    re.I,
)
_IP_WORDS = re.compile(
    rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|{_SIGN_DOT})[0-9]{{1,3}}){{3}}(?![0-9])", re.I
)
_HINT = re.compile(
    rf"{_ENTITY_AT}|{_ENTITY_DOT}|{_A_SIGN}(?=[A-Za-z0-9])|"
    r"[\[({<]\x20?(?:at|ät|@|dot|\.|punkt|point|punto|arroba|arobase)\x20?[\])}>]"
    r"|\x20(?:dot|punkt|point|punto|" + "|".join(SURE_AT_WORDS) + r")\x20|\x20@\x20",
    re.I,
)
_DOTS = re.compile(_SIGN_DOT, re.I)
_BRACKETED = re.compile(rf"\x20?{_OPEN}[^\[\](){{}}<>\s]+{_CLOSE}\x20?")
_PLUS = re.compile(r"(?<![A-Za-z0-9])plus\x20\Z", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of the plain forms, in order of kind, then start."""
    found: list[tuple[str, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            found.append(("email", start, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    if _IP.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        number = _digits(m[0])
        if 16 <= len(number) <= 19 and _luhn(number):
            found.append(("card", m.start(), m.end()))
    at = text.find("+")
    while at >= 0:
        match = _PHONE.match(text, at)
        if match and 8 <= len(_digits(match[0])) <= 15:
            found.append(("phone", at, match.end()))
        at = text.find("+", match.end() if match else at + 1)
    return found


class Rewritten:
    """A text put out by transducers, with the source span of each character."""

    def __init__(self, text: str):
        self.text = text
        self.begins: list[int] | None = None
        self.ends: list[int] | None = None

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans; what comes out stands for the whole of its span."""
        if not edits:
            return
        if self.begins is None:
            self.begins = list(range(len(self.text)))
            self.ends = list(range(1, len(self.text) + 1))
        parts, begins, ends, at = [], [], [], 0
        for start, end, new in edits:
            parts += [self.text[at:start], new]
            begins += self.begins[at:start] + [self.begins[start]] * len(new)
            ends += self.ends[at:start] + [self.ends[end - 1]] * len(new)
            at = end
        self.text = "".join([*parts, self.text[at:]])
        self.begins = begins + self.begins[at:]
        self.ends = ends + self.ends[at:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        if self.begins is None or self.ends is None:
            return start, end
        return self.begins[start], self.ends[end - 1]


@cache
def _folded(char: str) -> str:
    """The Latin letter or digit a character looks like, or itself."""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    if unicodedata.category(char) == "Nd":
        return str(unicodedata.decimal(char))
    if char in UNSEEN:
        return ""
    if char in HYPHENS or char in BLANKS:
        return "-" if char in HYPHENS else " "
    plain = unicodedata.normalize("NFKC", char)
    return plain if len(plain) == 1 and plain.isascii() and not plain.isspace() else char


def _odd(char: str) -> bool:
    return ord(char) > 0xFF or char in UNSEEN or char in BLANKS


def _fold(out: Rewritten) -> None:
    """Letters, digits, hyphens and blanks that look like ASCII ones; characters that are not seen go."""
    odd = {c for c in set(out.text) if _odd(c) and _folded(c) != c}
    if odd:
        out.edit([(i, i + 1, _folded(c)) for i, c in enumerate(out.text) if c in odd])


def _value(word: str) -> str:
    """The digit a word spells; where case is ignored, a dotted or dotless i stands for i."""
    low = word.lower()
    return DIGITS.get(low) or DIGITS[low.replace("i\u0307", "i").replace("\u0131", "i")]


def _meets(text: str) -> bool:
    """Whether a spelled digit stands beside a literal one."""
    if _FOLLOWED.search(text):
        return True
    starts = (m.start() for m in _LED.finditer(text))
    return any(_LEADS.search(text[max(0, s - _LONGEST) : s]) for s in starts)


def _spell(out: Rewritten) -> None:
    """Runs of spelled digits."""
    edits = []
    for m in _SPELLED.finditer(out.text):
        inner = list(_ONE.finditer(out.text, m.start(), m.end()))
        plus = _PLUS.search(out.text, max(0, m.start() - 6), m.start())
        if plus and len(inner) >= 8:
            edits.append((plus.start(), m.start(), "+"))
        for i, one in enumerate(inner):
            # What parts two digits goes with the first.
            end = inner[i + 1].start() if i + 1 < len(inner) else one.end()
            edits.append((one.start(), end, _value(one[0])))
    out.edit(edits)


def _spell_mixed(out: Rewritten) -> None:
    """Runs of spelled and literal digits."""
    edits = []
    for m in _MIXED.finditer(out.text):
        items = list(_ITEM.finditer(out.text, m.start(), m.end()))
        spelled = [not i[0].isdigit() for i in items]
        digits = sum(1 if s else len(i[0]) for i, s in zip(items, spelled))
        if not any(spelled) or all(spelled) or digits < LEAST_DIGITS:
            continue
        for i, one in enumerate(items):
            last = i + 1 == len(items)
            end = one.end() if last else items[i + 1].start()
            if spelled[i]:
                edits.append((one.start(), end, _value(one[0])))
            elif not last and spelled[i + 1]:
                edits.append((one.end(), end, ""))
    out.edit(edits)


def _undisguise(out: Rewritten) -> None:
    """At signs and dots that are words or stand in brackets, within a whole address."""
    edits = []
    for m in _ADDRESS.finditer(out.text):
        at, domain = m["at"], m["domain"]
        worded = _DOTS.search(domain)
        free = at.strip().isalpha() and at.strip().lower() not in SURE_AT_WORDS
        # "me at home dot com" is an address, "met at noon" and "look at example.com" are not.
        if at == "@" and not worded and not _DOTS.search(m["local"]) or free and not worded:
            continue
        # In code, an a in brackets is an argument: the address has to end as addresses do.
        if re.fullmatch(_A_SIGN, at, re.I) and not re.search(r"[A-Za-z]{2,}\Z", domain):
            continue
        dots = [
            (m.start(part) + d.start(), m.start(part) + d.end(), ".")
            for part in ("local", "domain") for d in _DOTS.finditer(m[part])
        ]
        edits += [*dots, (m.start("at"), m.end("at"), "@")]
    taken = sorted(edits)
    for m in _IP_WORDS.finditer(out.text):
        dots = [(m.start() + d.start(), m.start() + d.end(), ".") for d in _DOTS.finditer(m[0])]
        if not any(s < m.end() and m.start() < e for s, e, _ in taken):
            edits += dots
    out.edit(sorted(edits))


def disguised_spans(
    text: str, plain: list[tuple[str, int, int]]
) -> list[tuple[str, int, int]]:
    """Spans of the source that hold an identifier only once rewritten."""
    hints = not text.isascii() and any(_odd(c) for c in set(text))
    meets = _meets(text)
    if not hints and not meets and not _HINT.search(text) and not _SPELLED.search(text):
        return []
    found: list[tuple[str, int, int]] = []
    if hints or meets:
        # Apart from the other rewriting, which a number before an address or a place of it would change.
        mixed = Rewritten(text)
        _fold(mixed)
        _spell_mixed(mixed)
        found += [s for s in _mapped(mixed, text, plain, []) if s[0] in ("card", "phone")]
    out = Rewritten(text)
    _fold(out)
    _spell(out)
    _undisguise(out)
    return found + _mapped(out, text, plain, found)


def _mapped(
    out: Rewritten,
    text: str,
    plain: list[tuple[str, int, int]],
    found: list[tuple[str, int, int]],
) -> list[tuple[str, int, int]]:
    """Identifiers of a rewritten text by their places in the source, without those that touch found ones, or
    touch plain ones and do not extend them."""
    if out.begins is None:
        return []
    spans = [(kind, *out.source(start, end)) for kind, start, end in plain_spans(out.text)]
    plain_by, found_by = _by_kind(plain), _by_kind(found)
    return [
        x
        for x in spans
        if not _touched(x, found_by) and all(_extends(text, x, p) for p in _touched(x, plain_by))
    ]


Span = tuple[str, int, int]


def _by_kind(spans: list[Span]) -> list[tuple[list[Span], list[int]]]:
    """Spans of each kind, which do not overlap, in order of place, and their ends."""
    sides = [sorted(s for s in spans if s[0] == kind) for kind in KINDS]
    return [(side, [s[2] for s in side]) for side in sides if side]


def _touched(span: Span, sides: list[tuple[list[Span], list[int]]]) -> list[Span]:
    touched = []
    for side, ends in sides:
        i = bisect_right(ends, span[1])
        while i < len(side) and side[i][1] < span[2]:
            touched.append(side[i])
            i += 1
    return touched


def _extends(text: str, span: tuple[str, int, int], plain: tuple[str, int, int]) -> bool:
    """Whether a span properly holds a plain one of its kind and adds no free blank or part of a word."""
    (kind, start, end), (plain_kind, low, high) = span, plain
    if kind != plain_kind or start > low or end < high or end - start == high - low:
        return False
    if start < low and text[start - 1 : start].isalnum() and start > 0:
        return False
    if end > high and text[end : end + 1].isalnum():
        return False
    added = (text[start:low], text[high:end])
    return not any(c.isspace() for part in added for c in _BRACKETED.sub("", part))


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The plain spans, and these with the disguised ones, both by kind, then start."""
    plain = plain_spans(text)
    more = disguised_spans(text, plain)
    return plain, sorted([*plain, *more], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [all_spans(text.as_py() or "") for text in batch.column(1)]
        as_rows = [
            [[{"kind": k, "start": s, "end": e} for k, s, e in side] for side in column]
            for column in zip(*pairs)
        ] or [[], []]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, _SPAN_TYPE) for c in as_rows)],
            ["doc_id", "base", "found"],
        )


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Emails, IP addresses, payment cards and phone numbers of each whole text.

    One row per row of `docs`: `doc_id`, `base` (the plain forms) and `found` (these and the disguised ones that
    touch none of them or hold one of their kind and more), arrays of `kind`, `start`, `end` in order of kind, then start. Places are code points,
    ends exclusive. A null text counts as empty and has none; null and repeated ids are kept as they are; other
    columns are ignored; an empty table gives no rows.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(
        _find, f"doc_id long, base {_SPANS}, found {_SPANS}"
    )


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, parted by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
