r"""Personal data, also in disguise, with offsets in the text as it stands.

Two transducers rewrite a text and keep, for each character they put out, the span of source it came from: the first
replaces homoglyphs and foreign digits and drops invisible characters, the second spelled digits and at/dot
disguises. The same detectors then run over the source and over the rewritten text; spans found there map back.

Null and empty texts have no spans; a text's time grows with its length, whatever it holds (a megabyte of one character
too). Only texts with a sign of disguise are rewritten. Each row stands for itself, so ties and repeated rows give equal
rows; a row without a doc_id is no document for find_pii(), mask_pii() masks it all the same. No rows: none.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices, texts, turn_to

KINDS = ("email", "ip", "card", "phone")
# The four detectors, as the contract of the query states them.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")  # matches as [0-9]([\x20-]?[0-9])+ does, without going back
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_SIGNS = frozenset(string.ascii_letters + string.digits + "._%+-")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456\u0458\u0455\u0501\u04bb\u051b\u051d\u04cf": "aeopcyxijsdhqwl",  # Cyrillic, small
    "\u0410\u0412\u0415\u041a\u041c\u041d\u041e\u0420\u0421\u0422\u0423\u0425\u0406\u0408\u0405": "ABEKMHOPCTYXIJS",  # Cyrillic, capital
    "\u03b1\u03bf\u03c1\u03bd\u03b9\u03ba\u03c4\u03c5\u03c7": "aopviktux",  # Greek, small
    "\u0391\u0392\u0395\u0396\u0397\u0399\u039a\u039c\u039d\u039f\u03a1\u03a4\u03a5\u03a7": "ABEZHIKMNOPTYX",  # Greek, capital
    "\u0131\u0261\u0251\u2024\u3002\ufe6b\u2010\u2011\u2012\u2013\u2212\u00a0\u2007\u202f": "iga..@-----   ",  # Latin variants, signs, blanks
}
#: Soft hyphen, zero-width characters and marks of direction: they vanish.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
DIGIT_ZEROS = (0x0660, 0x06F0, 0x0966, 0x09E6, 0xFF10, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)
CHARS = {ord(a): b for row, like in LOOKALIKES.items() for a, b in zip(row, like, strict=True)}
CHARS |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
CHARS |= {z + d: str(d) for z in DIGIT_ZEROS for d in range(10)}
CHARS |= {ord(c): "" for c in INVISIBLE}
CHAR = re.compile("[" + "".join(re.escape(chr(c)) for c in CHARS) + "]")

# Number words and the words for the signs, in the corpus's languages.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: What (?i) takes for s and i, but lower() does not.
FOLDED = {0x17F: "s", 0x130: "i"}
AT = r"at|arroba|arobase|arrobase|klammeraffe"
DOT = r"dot|punkt|punto|point"
TLDS = "com|org|net|edu|gov|info|io|dev|co|uk|de|fr|es|eu|us|ca|ch|at|nl|it"
_digit = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
#: Four or more number words in a row, a plus word before them or not.
SPELLED = rf"(?<!\w)(?:(?P<plus>plus|más|mas)[\s]+)?{_digit}(?:[\s,.-]{{1,3}}{_digit}){{3,}}(?!\w)"
_name = r"[A-Za-z0-9_%+-]+"
_open, _close = r"[\[({<]", r"[\])}>]"
_marked_dot = rf"\s*{_open}\s*(?:{DOT}|\.)\s*{_close}\s*"
_dot = rf"(?:{_marked_dot}|\s+(?:{DOT})\s+|\s*\.\s*)"
_at = rf"(?:\s*{_open}\s*(?:{AT}|@)\s*{_close}\s*|\s+(?:{AT})\s+|\s*@\s*)"
#: A full stop with a blank just behind it ends a sentence too ("at noon. It"): after a bare word for @ it counts as a
#: dot only before those domains that start no sentence.
_after_word = rf"(?:{_marked_dot}|\s+(?:{DOT})\s+|\s+\.\s*|\.)"
_sure = rf"(?:{_after_word}(?:{TLDS})|\s*\.\s*(?:com|org|edu|gov))"
_label = r"[A-Za-z](?:[A-Za-z0-9-]*[A-Za-z0-9])"
_known = rf"(?:{_dot}{_name}){{0,3}}{_dot}(?:{TLDS})(?![\w])"
#: What stands for the sign of a disguised address. Each is looked for by itself, and the address grows from it to both
#: sides, so that no stretch of text is tried from each of its characters.
SIGNS = re.compile(rf"(?i)(?P<marked>{_open}\s*(?:{AT}|@)\s*{_close})|(?P<plain>@)|(?P<word>(?<=\s)(?:{AT})(?=\s))")
#: domain dot ... top-level domain, after the sign. Where the sign and the last dot are bracketed, any top-level domain will do.
DOMAINS = {
    "marked": re.compile(rf"(?i)\s*{_name}(?:{_known}(?:{_marked_dot}{_label}(?!\w))*|(?:(?:{_marked_dot}|\.){_name}){{0,3}}{_marked_dot}{_label}(?!\w))"),
    "plain": re.compile(rf"(?i)\s*{_name}{_known}"),
    "word": re.compile(rf"(?i)\s+{_name}(?:{_after_word}{_name}){{0,3}}{_sure}(?![\w])"),
}


def _backwards(words: str) -> str:
    return "|".join(w[::-1] for w in words.split("|"))


_back_name = r"[A-Za-z0-9_%+-]++"
_back_dot = rf"(?:\s*{_close}\s*(?:{_backwards(DOT)}|\.)\s*{_open}\s*|\s+(?:{_backwards(DOT)})\s+|\s*\.\s*)"
#: The local part before the sign, in the reversed text: up to three more names with dots; no letter, dot or @ before it.
LOCAL = re.compile(rf"(?i)\s*({_back_name}(?:{_back_dot}{_back_name}){{0,3}})(?![\w.@])")
#: What must be there before a text is worth rewriting (for Arrow's linear-time search over a whole batch): a character
#: of the first transducer, or the patterns of the second without what stands around them and after the first dot. \s is
#: ASCII's there, and the dotted capital I no i, as it is in Python.
_BLANK = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_signs = rf"{_name}{_at}{_name}{_dot}[A-Za-z0-9_%+-]|{_digit}(?:[\s,.-]{{1,3}}{_digit}){{3}}"
SIGN = "(?i)[" + "".join(rf"\x{{{c:x}}}" for c in [*CHARS, 0x130]) + "]|" + re.sub(r"(\[?)\\s", lambda m: f"[{_BLANK}" if m[1] else f"[{_BLANK}]", _signs)
NUMBERS, ONE_DIGIT = re.compile(f"(?i){SPELLED}"), re.compile(f"(?i){_digit}")
#: A dot's disguise, found by what it must hold and then widened by the blanks around it.
DOT_CORE = re.compile(rf"(?i){_open}\s*(?:{DOT}|\.)\s*{_close}|(?<=\s)(?:{DOT})(?=\s)|\.")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(int("0246813579"[int(d)]) for d in digits[-2::-2])) % 10 == 0


DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
PARTS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of EMAIL: from each @ to both sides, as a local part has no @."""
    last, at = 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at):
            begin = at
            while begin > last and text[begin - 1] in LOCAL_SIGNS:
                begin -= 1
            if begin < at:
                yield begin, (last := m.end())
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """The matches of IP: of numbers with dots between them always four together; each 255 at most."""
    for m in PARTS.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x) <= 3 or not x[:-3].strip("0") for x in four) and all(int(x[-3:]) <= 255 for x in four):
                yield at, end
            at = end + 1


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index in KINDS) of each identifier, by start and kind. A match that fails its test is passed over.

    The matches are those of the four patterns; each takes time in proportion to the text, whatever it holds.
    """
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [(a, b, 1) for a, b in addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def _widened(text: str, a: int, b: int) -> tuple[int, int]:
    """[a, b) and the blanks around it."""
    while a and text[a - 1].isspace():
        a -= 1
    while b < len(text) and text[b].isspace():
        b += 1
    return a, b


def disguised_mails(text: str) -> Iterator[tuple[int, int, list[tuple[int, int, str]]]]:
    """(start, end, replacements) of each disguised address, from left to right; the sign and the dots alone are replaced."""
    last, back = 0, None
    for sign in SIGNS.finditer(text):
        if sign.start() < last or not (after := DOMAINS[sign.lastgroup].match(text, sign.end())):
            continue
        back = back or text[::-1]
        local = LOCAL.match(back, len(text) - sign.start(), len(text) - last)
        if not local or last and local.end() == len(text) - last and re.match(r"[\w.@]", text[last - 1]):
            continue
        a, b = len(text) - local.end(), after.end()
        at = _widened(text, *sign.span())
        dots = [(*_widened(text, *d.span()), ".") for lo, hi in ((a, at[0]), (at[1], b)) for d in DOT_CORE.finditer(text, lo, hi)]
        yield a, b, sorted([*dots, (*at, "@")])
        last = b


def _pieces(text: str) -> Iterator[tuple[int, int, str]]:
    """What the second transducer puts: (start, end, replacement), from left to right."""
    found = [(m.start(), m.end(), None, m) for m in NUMBERS.finditer(text)]
    if "@" in text or SIGNS.search(text):
        found += [(a, b, pieces, None) for a, b, pieces in disguised_mails(text)]
    found.sort(key=lambda x: x[:2])
    last = 0
    for a, b, pieces, m in found:
        if a < last:
            continue
        last = b
        if pieces:
            yield from pieces
            continue
        first = True
        for d in ONE_DIGIT.finditer(text, a + len(m["plus"] or ""), b):
            yield (a if first else d.start(), d.end(), ("+" if m["plus"] and first else "") + DIGIT_WORDS[d[0].translate(FOLDED).lower()])
            first = False


def rewrite(text: str) -> tuple[str, list[int], list[int]]:
    """The normalised text, and for each of its characters where its source starts and ends; of an unchanged text nothing."""
    if CHAR.search(text):
        kept = [(i, CHARS.get(ord(c), c)) for i, c in enumerate(text)]
        kept = [(i, c) for i, c in kept if c]
        text, begin = "".join(c for _, c in kept), [i for i, _ in kept]
        pieces = list(_pieces(text))
    elif pieces := list(_pieces(text)):
        begin = list(range(len(text)))
    else:
        return text, [], []
    end = [i + 1 for i in begin]
    out, starts, ends, last = [], [], [], 0
    for a, b, new in pieces:
        out.append(text[last:a])
        starts += begin[last:a] + [begin[a]] * len(new)
        ends += end[last:a] + [end[b - 1]] * len(new)
        out.append(new)
        last = b
    out.append(text[last:])
    return "".join(out), starts + begin[last:], ends + end[last:]


def disguised(column: pa.Array) -> list[bool]:
    """Whether each text has a sign of disguise."""
    return pc.fill_null(pc.match_substring_regex(column, SIGN), False).to_pylist()


def spans(text: str, sign: bool) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all: those and the ones found in the normalised text that meet no base span of their kind."""
    base = find(text)
    if not sign:
        return base, base
    new, starts, ends = rewrite(text)
    if not starts:
        return base, base
    taken = [[(a, b) for a, b, k in base if k == kind] for kind in range(len(KINDS))]
    added, last = [], [0] * len(KINDS)
    for a, b, k in find(new):  # both go from left to right, and spans of a kind do not overlap
        s, e = starts[a], ends[b - 1]
        at = bisect_left(taken[k], (s, e))
        if s >= last[k] and (not at or taken[k][at - 1][1] <= s) and (at == len(taken[k]) or e <= taken[k][at][0]):
            last[k] = e
            added.append((s, e, k))
    return base, sorted([*base, *added], key=lambda s: (s[0], s[2]))


def _listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, sign in zip(batch.column("text"), disguised(batch.column("text")), strict=True):
            base, every = spans(text.as_py(), sign)
            counts = [sum(k == kind for _, _, k in base) for kind in range(len(KINDS))]
            rows.append((*counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every), len(every) - len(base)))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=[c.split()[0] for c in SCHEMA.split(", ")])


def find_pii(df: DataFrame) -> DataFrame:
    """Per document: counts of base spans by kind, their digest, all spans, and how many the disguises added."""
    return texts(df).mapInArrow(_search, SCHEMA)


#: What stands in a masked text for a span of each kind.
MASKS = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>")


def mask(text: str | None, sign: bool) -> str | None:
    """The text with every span replaced by its kind's mark; of spans that overlap, the marks of the first stands."""
    if not text:
        return text
    out, last = [], 0
    for a, b, k in spans(text, sign)[1]:
        if a >= last:
            out += [text[last:a], MASKS[k]]
        last = max(last, b)
    return "".join([*out, text[last:]])


def mask_pii(df: DataFrame) -> DataFrame:
    """df with its text masked, all columns and rows kept (a null text stays null); n_chars follows, where there is one."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("pii")
        for batch in slices(batches):
            new = [mask(t.as_py(), sign) for t, sign in zip(batch.column("text"), disguised(batch.column("text")), strict=True)]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": pa.array(new, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return df.mapInArrow(run, df.schema)
