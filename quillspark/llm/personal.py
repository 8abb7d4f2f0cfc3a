"""Personal data in texts, plain or disguised, with its place in the text as it stands.

Four patterns find what stands plainly. For the rest a text goes through three transducers, one after the other: characters that look like others, spelled digits, and disguises of
`@` and `.`. Each gives edits (start, end, new text), so a view of the edited text can say which characters of the text before it any of its own came from. The same patterns are then searched in the last
view, and spans are mapped back through all three; those with something disguised in them are added to the plain ones.

Everything is linear in the text: no pattern can start at many places of a run and read on to its end from each.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from .common import map_arrow, table, texts

Edit = tuple[int, int, str]
Span = tuple[int, int]

#: The kinds in order, and the characters and patterns of each.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")

#: Letters of other scripts by the Latin letter that they look like.
LOOKALIKES = {
    "a": "аαɑ", "b": "Ьʙ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іιı", "j": "јϳ", "k": "κк", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ",
    "q": "ԛզ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "ѵν", "w": "ԝѡ", "x": "хχ", "y": "уү", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    ".": "。｡․", "@": "﹫", "-": "−⁃",
}
#: Digits in words, in English, German, French and Spanish; what multiplies the next one; and signs in words.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
TIMES = {"double": 2, "triple": 3}
SIGNS = {"dot": ".", "punkt": ".", "point": ".", "punto": ".", "plus": "+", "más": "+", "dash": "-", "hyphen": "-"}
#: Last labels that stand for a domain where words, not marks, disguise an address.
TOP = frozenset(
    """com org net edu gov mil int info biz name pro io co ai app dev me tv cc eu uk us ca au nz ie de at ch li fr be nl lu es pt it gr se no fi dk is pl cz sk hu ro bg ru ua tr il in cn jp kr sg hk br mx ar cl za
    example test invalid local""".split()
)

_OPEN, _CLOSE = r"[\[({<]\x20?", r"\x20?[\])}>]"
_AT_WORD, _DOT_WORD = "(?:at|arroba)", "(?:dot|punkt|point|punto)"
_AT_MARK = rf"{_OPEN}(?:{_AT_WORD}|@|ät|chez){_CLOSE}|&(?:\#64|\#x40|commat);|%40|(?<=[A-Za-z0-9])(?:_at_|-at-|\*at\*|/at/)(?=[A-Za-z0-9])"
_DOT_MARK = rf"{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}|&(?:\#46|\#x2e|period);|%2e|(?<=[A-Za-z0-9])(?:_dot_|-dot-|\*dot\*|/dot/)(?=[A-Za-z0-9])"
_AT = re.compile(rf"(?P<mark>{_AT_MARK})|(?P<sign>@)|(?<=\x20)(?P<word>{_AT_WORD})(?=\x20)", re.I)
_LABEL = re.compile(r"\x20{0,2}([A-Za-z0-9-]{1,63})(?![A-Za-z0-9-])")
_DOT = re.compile(rf"\x20{{0,2}}(?P<mark>{_DOT_MARK})|(?P<sign>\.)(?=[A-Za-z0-9])|\x20{{1,2}}(?P<spaced>\.)(?=\x20{{0,2}}[A-Za-z0-9])|\x20{{1,2}}(?P<word>{_DOT_WORD})(?=\x20)", re.I)
_PARTS = re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}(?:\x20{{0,2}}(?:{_DOT_MARK}|(?<=\x20){_DOT_WORD}(?=\x20))\x20{{0,2}}[A-Za-z0-9._%+-]{{1,64}}){{0,4}}\Z", re.I)
_INNER = re.compile(rf"\x20{{0,2}}(?:{_DOT_MARK}|(?<=\x20){_DOT_WORD}(?=\x20))\x20{{0,2}}", re.I)
_HANDLE = re.compile(r"[0-9]|[._+-][A-Za-z]")
_QUAD = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:\.|\x20{{1,2}}\.\x20{{1,2}}|\x20{{0,2}}(?:{_DOT_MARK}|(?<=\x20){_DOT_WORD}(?=\x20))\x20{{0,2}})[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
#: Without one of these there's no address, and no dot in disguise.
_MAYBE_DOT = ("dot", "punkt", "point", "punto", "&#46", "&#x2e", "&period", "%2e", "[.", "(.", "{.", "<.", " .")
_DOT_WITHIN = re.compile(r"\.[A-Za-z0-9]")
_BETWEEN = re.compile(r"[^0-9]+")
_DOTTED = re.compile(rf"{_DOT_MARK}|(?<=[0-9]\x20){_DOT_WORD}(?=\x20)|(?<=[0-9])\x20\.", re.I)


def _any(words: dict) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


_NUMBER = rf"(?:(?:{_any(TIMES)})\x20)?(?:{_any(SPELLED)})(?!\w)"
_ODD = re.compile(r"[^\x00-\x7f]")
_PIECE = rf"(?:{_NUMBER}|(?:{_any(SIGNS)})(?!\w)|[0-9]++(?!\w))"
_SPELLED_RUN = re.compile(rf"(?<!\w){_PIECE}(?:(?:[\x20-]|,\x20){_PIECE})++", re.I)
_TOKEN = re.compile(rf"(?P<times>{_any(TIMES)})\x20(?=\w)|(?P<digit>{_any(SPELLED)})(?!\w)|(?P<sign>{_any(SIGNS)})(?!\w)|(?P<number>[0-9]+)|(?P<gap>,?[\x20-])", re.I)


# what stands plainly


def emails(text: str) -> list[Span]:
    out, done = [], 0
    for m in _DOMAIN.finditer(text):
        before = text[done : m.start()]
        start = done + len(before.rstrip(LOCAL))
        if start < m.start():
            out.append((start, m.end()))
            done = m.end()
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]


FINDERS = (emails, ips, cards, phones)


# transducers: a text's edits, by place, none in another


@cache
def alphabet() -> dict[str, str]:
    """Characters to what they stand for: those that Unicode says to be compatible with one of ASCII, decimal digits of all scripts, dashes, spaces, lookalikes; invisible ones to nothing."""
    out = {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs", "Lo"):
            continue
        plain = unicodedata.normalize("NFKC", c)
        if kind == "Cf":
            out[c] = ""
        elif kind == "Nd":
            out[c] = str(unicodedata.decimal(c))
        elif kind == "Pd":
            out[c] = "-"
        elif kind == "Zs":
            out[c] = " "
        elif len(plain) == 1 and plain.isascii():
            out[c] = plain
    return out | {c: latin for latin, alike in LOOKALIKES.items() for c in alike}


def characters(text: str) -> list[Edit]:
    if text.isascii():
        return []
    plain = alphabet()
    return [(m.start(), m.end(), plain[m[0]]) for m in _ODD.finditer(text) if m[0] in plain]


def spelled_digits(text: str) -> list[Edit]:
    """Runs that have at least three digits in words; numbers and signs in words may stand between them. What separates them goes, unless it stands beside digits as such."""
    # the second of three stands between separators, so it's a word of its own here
    if SPELLED.keys().isdisjoint(text.lower().replace("-", " ").replace(",", " ").split()):
        return []
    out: list[Edit] = []
    for run in _SPELLED_RUN.finditer(text):
        tokens = list(_TOKEN.finditer(text, run.start(), run.end()))
        if sum(t.lastgroup == "digit" for t in tokens) < 3:
            continue
        times, at = 1, run.start()
        for i, t in enumerate(tokens):
            if t.lastgroup == "times":
                times, at = TIMES[t["times"].lower()], t.start()
            elif t.lastgroup == "digit":
                out.append((at if times > 1 else t.start(), t.end(), SPELLED[t["digit"].lower()] * times))
                times = 1
            elif t.lastgroup == "sign":
                out.append((*t.span(), SIGNS[t["sign"].lower()]))
            elif t.lastgroup == "gap" and 0 < i < len(tokens) - 1 and "number" not in (tokens[i - 1].lastgroup, tokens[i + 1].lastgroup):
                out.append((*t.span(), ""))
    return out


def _domain(text: str, at: int) -> tuple[list[Span], list[tuple[Span, str]]]:
    """Labels from a place on and what stands between them, with its kind."""
    labels: list[Span] = []
    dots: list[tuple[Span, str]] = []
    while (label := _LABEL.match(text, at)) and (not labels or label.start(1) > at or dots[-1][1] in ("sign", "mark")):
        labels.append(label.span(1))
        if len(labels) == 8 or not (dot := _DOT.match(text, label.end())):
            break
        dots.append(((label.end(), dot.end()), dot.lastgroup or ""))
        at = dot.end()
    return labels, dots[: max(0, len(labels) - 1)]


def at_and_dot(text: str) -> list[Edit]:
    """Disguises of @ and . within an address, and of . between the four parts of an IP address.

    Words pass for signs only before a known last label; without any dot in disguise the word `at` does only after a name that looks like one of an account (with a digit, or letters after a sign).
    """
    low = text.lower()
    if not any(x in low for x in _MAYBE_DOT) and not _DOT_WITHIN.search(text):
        return []
    out: list[Edit] = []
    done = 0
    for m in _AT.finditer(text):
        how = m.lastgroup
        labels, dots = _domain(text, m.end())
        while dots and dots[-1][1] in ("word", "spaced") and text[slice(*labels[-1])].lower() not in TOP:
            labels, dots = labels[:-1], dots[:-1]
        if not dots or m.start() < done:
            continue
        hidden = any(kind != "sign" for _, kind in dots)
        spaced = text[m.start() - 1 : m.start()] == " " or labels[0][0] > m.end()
        if how == "sign" and not hidden and not spaced:
            continue
        last = text[slice(*labels[-1])].lower()
        if not last.isalpha() or len(last) < 2 or (last not in TOP and (how == "word" or (how == "sign" and spaced))):
            continue
        left = m.start() - len(text[max(0, m.start() - 2) : m.start()]) + len(text[max(0, m.start() - 2) : m.start()].rstrip(" "))
        name = _PARTS.search(text, max(done, left - 400), left)
        if not name or ((how == "word" or (how == "sign" and spaced)) and not (hidden or _HANDLE.search(name[0]))):
            continue
        begin = name.start()
        if how == "word" and _INNER.search(name[0]) is None and name[0].endswith("."):
            continue
        out += [(i.start() + begin, i.end() + begin, ".") for i in _INNER.finditer(name[0])]
        out.append((left, labels[0][0], "@"))
        out += [(d[0], labels[k + 1][0], ".") for k, (d, kind) in enumerate(dots) if kind != "sign" or labels[k + 1][0] - d[0] != 1]
        done = labels[-1][1]
    taken = [e[:2] for e in out]
    for m in _QUAD.finditer(text) if _DOTTED.search(text) else ():
        if all(int(x) <= 255 for x in _BETWEEN.split(m[0])) and not any(a < m.end() and m.start() < b for a, b in taken):
            out += [(m.start() + g.start(), m.start() + g.end(), ".") for g in _BETWEEN.finditer(m[0]) if g[0] != "."]
    return sorted(out)


TRANSDUCERS = (characters, spelled_digits, at_and_dot)


class View:
    """A text after edits, which knows where its characters come from."""

    def __init__(self, text: str, edits: list[Edit]):
        pieces, at, length = [], 0, 0
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.edits = edits
        for start, end, new in edits:
            pieces += [text[at:start], new]
            length += start - at
            self.starts.append(length)
            length += len(new)
            self.ends.append(length)
            at = end
        self.text = "".join([*pieces, text[at:]])

    def _at(self, place: int, last: bool) -> int:
        """Where the character at a place comes from: its start, or its end if it's the last."""
        i = bisect_right(self.starts, place) - 1
        if i >= 0 and place < self.ends[i]:
            return self.edits[i][last]
        return place + last + (self.edits[i][1] - self.ends[i] if i >= 0 else 0)

    def before(self, span: Span) -> Span:
        return self._at(span[0], False), self._at(span[1] - 1, True)


@dataclass(frozen=True)
class Found:
    kind: int
    start: int
    end: int
    value: str
    plain: bool


def search(text: str) -> list[Found]:
    """All personal data of a text, by start and kind: what stands plainly, and what is disguised, unless that cuts into something plain."""
    out = [Found(k, a, b, text[a:b], True) for k, f in enumerate(FINDERS) for a, b in f(text)]
    views: list[View] = []
    plain = text
    for t in TRANSDUCERS:
        if edits := t(plain):
            views.append(View(plain, edits))
            plain = views[-1].text
    if views:
        base = sorted((f.start, f.end) for f in out)
        reach, ends = 0, []  # the furthest end of all spans up to each
        for _, b in base:
            reach = max(reach, b)
            ends.append(reach)
        begins = [a for a, _ in base]
        for k, f in enumerate(FINDERS):
            for a, b in f(plain):
                span = (a, b)
                for v in reversed(views):
                    span = v.before(span)
                if plain[a:b] == text[slice(*span)] or plain[a - 1 : a].isalnum() or plain[b : b + 1].isalnum():
                    continue
                first, last = bisect_right(ends, span[0]), bisect_right(begins, span[1] - 1)
                inside = all(span[0] <= x and y <= span[1] for x, y in base[first:last] if y > span[0])
                if inside and (span[0], span[1]) not in base[first:last]:
                    out.append(Found(k, *span, plain[a:b], False))
    return sorted(out, key=lambda f: (f.start, f.kind, f.end))


def written(found: list[Found]) -> str:
    return ",".join(f"{KINDS[f.kind]}:{f.start}:{f.end}" for f in found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, personal: an array of kind, start, end, value, plain, by start, in code points of the text; value is what the transducers make of the span.

    docs needs doc_id and text; other columns aren't read, whatever their names. Null and empty texts have none; a null doc_id stays null; repeated rows come out alike, and rows that share a doc_id each by itself. Very long
    texts are searched whole, in time linear in them. Of spans that start together the kind decides, then the end. Empty table: no rows.
    """

    def run(batch: pa.RecordBatch) -> dict:
        found = [search((t or b"").decode()) for t in texts(batch)]
        return {"doc_id": batch.column("doc_id"), "personal": [[{"kind": KINDS[f.kind], "start": f.start, "end": f.end, "value": f.value, "plain": f.plain} for f in x] for x in found]}

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, personal array<struct<kind:string,start:long,end:long,value:string,plain:boolean>>", 512)


def hidden(text: str) -> str:
    """The text with [KIND] in place of each span; spans that overlap go as one, under the kind of the first."""
    pieces, at = [], 0
    for f in search(text):
        if f.start >= at:
            pieces += [text[at : f.start], f"[{KINDS[f.kind].upper()}]"]
        at = max(at, f.end)
    return "".join([*pieces, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs whose texts have a mark for each span. Null texts stay null; all other columns stay, whatever their names; repeated rows come out alike. Empty table: no rows."""

    def run(batch: pa.RecordBatch) -> dict:
        return {c: [None if t is None else hidden(t.decode()) for t in texts(batch)] if c == "text" else batch.column(i) for i, c in enumerate(batch.schema.names)}

    schema = StructType([StructField("text", StringType()) if f.name == "text" else f for f in docs.schema])
    return map_arrow(docs, run, schema, 512)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the number of plain spans of each kind, how many disguised ones there are, base_sha256 and spans of each row of documents; a null text is empty."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [search((t or b"").decode()) for t in texts(batch)]
        plain = [[f for f in x if f.plain] for x in found]
        counts = {f"n_{kind}": [sum(f.kind == k for f in x) for x in plain] for k, kind in enumerate(KINDS)}
        rest = {"n_disguised": [len(x) - len(p) for x, p in zip(found, plain, strict=True)], "base_sha256": [hashlib.sha256(written(p).encode()).hexdigest() for p in plain], "spans": [written(x) for x in found]}
        return {"doc_id": batch.column("doc_id")} | counts | rest

    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "text")
    return map_arrow(docs, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_disguised long, base_sha256 string, spans string", 512)
