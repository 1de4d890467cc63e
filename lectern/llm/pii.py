"""Personal data, also where it is disguised: normalise, detect, map back to the source's characters.

Two transducers rewrite a text and remember every rewritten piece. The first folds look-alike characters
(Cyrillic, Greek, full-width, mathematical letters, foreign digits), invisible characters and character
entities. The second turns spelled digits and at/dot disguises into digits, ``@`` and ``.``, where enough of
them stand together. The plain detectors then run over the rewritten text, and each hit that touches a
rewritten piece is mapped back to source characters. Hits of the plain detectors on the source always stay.

Defined results: a null text is an empty text and has no spans; an empty table gives an empty result; repeated rows each
have a result; spans of one kind from the plain detectors never overlap; a mapped-back span that a plain span of its
kind covers is not added. All positions are code points, ends exclusive. A very long text is searched whole, in time that
grows in proportion. Columns other than the two named ones are not read, so they may have any names.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm._common import prepare

KINDS = ("email", "ip", "card", "phone")
_RANK = {k: i for i, k in enumerate(KINDS)}
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A leftmost match starts where a run of digits does; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Each @ is looked at once, so long runs of local characters cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done and (m := _DOMAIN.match(text, at)):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield "email", start, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """What the plain detectors find, by start and then kind."""
    found: list[Span] = []
    if "@" in text:
        found += _emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append(("phone", m.start(), m.end()))
        found.sort(key=lambda s: (s[1], _RANK[s[0]], s[2]))
    return found


class Rewritten:
    """A text with some pieces replaced, and the way back to source positions."""

    def __init__(self, text: str, pieces: list[tuple[int, int, str]]) -> None:
        out, here, size = [], 0, 0
        self.edits: list[tuple[int, int, int, int]] = []
        for start, end, new in pieces:
            out += [text[here:start], new]
            size += start - here
            self.edits.append((size, size + len(new), start, end))
            size, here = size + len(new), end
        self.text = "".join([*out, text[here:]])
        self._starts = [e[0] for e in self.edits]

    def _source(self, at: int) -> tuple[int, int]:
        """Source span of the character at ``at``."""
        i = bisect_right(self._starts, at) - 1
        while i >= 0 and self.edits[i][0] == self.edits[i][1]:  # a deleted piece holds no character
            if i and self.edits[i - 1][1] > at:
                i -= 1
                continue
            break
        if i < 0:
            return at, at + 1
        a, b, s, e = self.edits[i]
        return (s, e) if a <= at < b else (at - b + e, at - b + e + 1)

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self._source(start)[0], self._source(end - 1)[1]

    def touches(self, start: int, end: int) -> bool:
        """Whether a replaced piece lies in the span of the rewritten text."""
        i = bisect_right(self._starts, end - 1) - 1
        return i >= 0 and (self.edits[i][1] > start or (self.edits[i][0] == self.edits[i][1] and self.edits[i][0] > start))


# Letters of other scripts that look like Latin letters, each with its Latin letter.
_LOOKALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухҮԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχ",
        "ABESIJKMHOPCTYXaesijopcyxYdqwhABEZHIKMNOPTYXaiknopux",
        strict=True,
    )
)
# Characters that show nothing, and the kinds of dash and space.
_HIDDEN = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
_DASHES = "\u2010\u2011\u2012\u2013\u2014\u2212"
_SPACES = "\u00a0\u2002\u2003\u2007\u2008\u2009\u202f"
# Character entities of @, . and +.
_ENTITIES = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "&#46;": ".", "&#x2e;": ".", "&period;": ".", "&#43;": "+", "&plus;": "+"}

_FOLD = re.compile(
    f"[{_HIDDEN}{_DASHES}{_SPACES}\u0370-\u052f\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u2024\u2460-\u2473\u2070-\u2089\ufe50-\ufe6b\uff01-\uff5e\U0001d400-\U0001d7ff]"
    "|" + "|".join(map(re.escape, _ENTITIES)),
    re.I,
)
_FOLDED: dict[str, str] = dict.fromkeys(_HIDDEN, "") | dict.fromkeys(_DASHES, "-") | dict.fromkeys(_SPACES, " ") | _LOOKALIKE | _ENTITIES | {"\u2024": "."}


def _folded(c: str) -> str:
    """What a character or entity is rewritten to; itself if it looks like nothing else."""
    new = _FOLDED.get(c.lower() if len(c) > 1 else c)
    if new is None:
        new = unicodedata.normalize("NFKC", c)
        if not new.isascii():
            digit = unicodedata.digit(c, None)
            new = _LOOKALIKE.get(new, c) if digit is None else str(digit)
        _FOLDED[c] = new
    return new


def fold(text: str) -> Rewritten | None:
    """The first transducer; None if it changes nothing."""
    if text.isascii() and "&" not in text:
        return None
    pieces = [(m.start(), m.end(), new) for m in _FOLD.finditer(text) if (new := _folded(m[0])) != m[0]]
    return Rewritten(text, pieces) if pieces else None


# Words for the digits 0 to 9 in English, German, French and Spanish.
_DIGIT_WORDS = [
    "zero oh null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro",
    "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
]
_VALUE = {w: str(i) for i, ws in enumerate(_DIGIT_WORDS) for w in ws.split()}
_W = "|".join(sorted(_VALUE, key=len, reverse=True))
_DOTWORD = "dot|punkt|point|punto"
_ATWORD = "at|arobase|arroba"
_DIGITS_RUN = re.compile(rf"\b(?:plus[\s-]+)?(?:(?:double|triple)\s+)?(?:{_W})(?:(?:[\s,.()-]{{1,3}}|[\s,]+(?:{_DOTWORD})[\s,]+)(?:(?:double|triple)\s+)?(?:{_W}|[0-9]+)\b){{3,}}", re.I)
_DIGITS_ITEM = re.compile(rf"plus|double|triple|{_DOTWORD}|{_W}|[0-9]+", re.I)
_MIXED = re.compile(r"(?<=[0-9])[OolI](?=[OolI]{0,2}[0-9])|(?<=[0-9][OolI])[OolI](?=[0-9])")
# All the spaces before a sign, from the first of them: a long run of spaces is then looked at once.
_SPACE0, _SPACE1 = r"(?:(?<!\x20)[\x20]++)?+", r"(?<!\x20)[\x20]++"
_AT = re.compile(rf"(?P<sure>{_SPACE0}[\[({{<][\x20]*+(?:{_ATWORD}|@)[\x20]*+[\])}}>][\x20]*+)|(?P<word>{_SPACE1}(?:{_ATWORD})[\x20]++)|(?P<bar>(?<![_-])[_-]++at[_-]++)|(?P<wide>{_SPACE1}@[\x20]*+|@[\x20]++)|(?P<plain>@)", re.I)
_DOT_SURE = rf"[\x20]*[\[({{<][\x20]*(?:{_DOTWORD}|\.)[\x20]*[\])}}>][\x20]*|[\x20]+(?:{_DOTWORD})[\x20]+|[_-]+dot[_-]+"
_LABELS = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9]|-(?!dot[-_]))*(?:(?:{_DOT_SURE}|\.|[\x20]\.[\x20])[A-Za-z0-9](?:[A-Za-z0-9]|-(?!dot[-_]))*)+", re.I)
# After a plain @ a dot between spaces ends a sentence: only what is spelled or in brackets is a disguise there.
_LABELS_PLAIN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9]|-(?!dot[-_]))*(?:(?:{_DOT_SURE}|\.)[A-Za-z0-9](?:[A-Za-z0-9]|-(?!dot[-_]))*)+", re.I)
_DOTS = re.compile(rf"{_DOT_SURE}|[\x20]\.[\x20]", re.I)
_BEFORE = re.compile(rf"(?:[A-Za-z0-9%+-]|_(?!at_|dot_)|\.)+(?:(?:{_DOT_SURE})[A-Za-z0-9._%+-]+)*$", re.I)
_TRIGGER = re.compile(rf"[\[({{<]\x20*(?:{_ATWORD}|@)\x20*[\])}}>]|\b(?:{_DOTWORD})\b|_dot_|-dot-|\x20@|@\x20|[\[({{<]\x20*\.\x20*[\])}}>]", re.I)
#: A local part in disguise is looked for in so many characters; the longest that RFC 5321 allows, with room for disguises.
_REACH = 160


# Words that follow "at" in plain prose and begin no domain.
_ARTICLES = frozenset("the a an this that my your our his her its their each every one la le les un une el los las der die das dem den ein eine".split())


def _disguised_mail(text: str) -> list[tuple[int, int, str]]:
    pieces: list[tuple[int, int, str]] = []
    done = 0
    for m in _AT.finditer(text):
        if m.start() < done or not (d := (_LABELS_PLAIN if m["plain"] else _LABELS).match(text, m.end())):
            continue
        dots = [(x.start() + d.start(), x.end() + d.start()) for x in _DOTS.finditer(d[0])]
        # a bare word "at" is taken for @ only if a dot is spelled too
        if (m["word"] or m["bar"]) and (not dots or d[0].split()[0].lower() in _ARTICLES):
            continue
        if m["plain"] and not dots:
            continue
        lo = max(done, m.start() - _REACH)
        if not (b := _BEFORE.search(text[lo : m.start()])) or not b[0].strip(".-_"):
            continue
        pieces += [(x.start() + lo + b.start(), x.end() + lo + b.start(), ".") for x in _DOTS.finditer(b[0])]
        pieces += [(m.start(), m.end(), "@"), *((a, z, ".") for a, z in dots)]
        done = d.end()
    return pieces


def _spelled_digits(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Replaced pieces, and the source spans of runs of 9 to 15 spelled digits without any other sign."""
    pieces, runs = [], []
    for m in _DIGITS_RUN.finditer(text):
        out, times = [], 1
        items = [x[0].lower() for x in _DIGITS_ITEM.finditer(m[0])]
        for x in items:
            if x in ("double", "triple"):
                times = 2 if x == "double" else 3
                continue
            out.append("+" if x == "plus" else "." if x in _DOTWORD.split("|") else _VALUE.get(x, x) * times)
            times = 1
        new = "".join(out)
        pieces.append((m.start(), m.end(), new))
        if new.isdigit() and 9 <= len(new) <= 15:
            runs.append((m.start(), m.end()))
    return pieces, runs


def _unspell(text: str) -> tuple[Rewritten | None, list[tuple[int, int]]]:
    """The second transducer; None if it changes nothing."""
    pieces, runs = _spelled_digits(text)
    if _TRIGGER.search(text):
        pieces += _disguised_mail(text)
    pieces += [(m.start(), m.end(), "0" if m[0] in "Oo" else "1") for m in _MIXED.finditer(text)]
    pieces.sort()
    kept, end = [], 0
    for p in pieces:
        if p[0] >= end:
            kept.append(p)
            end = p[1]
    return (Rewritten(text, kept) if kept else None), runs


def disguised_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only show after normalising, in source characters."""
    first = fold(text)
    here = first.text if first else text
    second, runs = _unspell(here)
    if first is None and second is None:
        return []

    def source(start: int, end: int) -> tuple[int, int]:
        return first.back(start, end) if first else (start, end)

    if first:  # what folding alone brings out, if it holds a folded character
        found = {(k, *first.back(a, b)) for k, a, b in base_spans(here) if first.touches(a, b)}
    else:
        found = set()
    if second:
        for k, a, b in base_spans(second.text):
            if second.touches(a, b):
                found.add((k, *source(*second.back(a, b))))
        cards = {(a, b) for k, a, b in found if k == "card"}
        found |= {("phone", *s) for r in runs if (s := source(*r)) not in cards}
    of_kind = {kind: [(a, b) for k, a, b in base if k == kind] for kind in KINDS}

    def covered(kind: str, start: int, end: int) -> bool:  # plain spans of a kind do not overlap: only the last that starts by then can
        i = bisect_right(of_kind[kind], (start, len(text) + 1)) - 1
        return i >= 0 and end <= of_kind[kind][i][1]

    return sorted((s for s in found if not covered(*s)), key=lambda s: (s[1], _RANK[s[0]], s[2]))


def spans_of(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans of a text: kind, start, end, and whether it was disguised."""
    if not text:
        return []
    base = base_spans(text)
    found = [(*s, False) for s in base] + [(*s, True) for s in disguised_spans(text, base)]
    return sorted(found, key=lambda s: (s[1], _RANK[s[0]], s[2], s[3]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("disguised", T.BooleanType()), T.StructField("value", T.StringType())]))


@F.pandas_udf(SPANS)
def find_spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b, "disguised": d, "value": t[a:b]} for k, a, b, d in spans_of(t)] for t in texts], dtype=object)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and the array ``spans`` of kind, start, end, disguised, value.

    Rows stay where they are: no shuffle, and memory is bounded by one Arrow batch.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), find_spans(F.col(text_col)).alias("spans"))


def redact(text: str | None, mask: str = "<{kind}>") -> str | None:
    """The text with every span replaced; overlapping spans become one mask, of the first's kind."""
    if not text:
        return text
    out, here = [], 0
    for k, a, b, _ in spans_of(text):
        if a >= here:
            out += [text[here:a], mask.format(kind=k)]
        here = max(here, b)
    return "".join([*out, text[here:]])
