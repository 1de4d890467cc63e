"""Secrets in texts: plain patterns, and probabilistic automata that were inferred from labelled credentials.

For each credential format a prefix tree of labelled examples is folded into a probabilistic finite automaton:
states whose outgoing frequencies the Hoeffding bound cannot tell apart are merged (the red-blue order of
ALERGIA), each with the likeliest of those it is compatible with. More automata are inferred from labelled ordinary
strings: words, names, identifiers in groups, numbers and dates, paths of hashes, rules. Every candidate, a run of 16 or
more credential characters, is scored by the logarithm of its likelihood under its best format against that under its
best ordinary kind, per character. What scores above ``THRESHOLD`` and is not much shorter than the format's examples
is added to what the plain patterns find; that always stays. The parts of a run between its ``=``, then ``/``, then
``.`` are candidates too, and are taken instead where together they are likelier: so keys in paths and assignments are
seen, however long the run.

Defined results: a null text is an empty text without spans; an empty table gives an empty result; repeated rows each
have a result; an added span never touches a plain one. All positions are code points, ends exclusive. A very long text
is searched whole. Columns other than those named are not read, so they may have any names.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Sequence
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm._common import prepare, trim

KINDS = ("assign", "access", "hex")
#: Labelled examples of each format that its automaton is inferred from.
EXAMPLES = 240
#: Of a state's likelihoods the share that follows the whole automaton's characters, and what counts for a character never seen.
SHARED, FLOOR = 0.05, 0.01
#: Mean natural logarithm of the likelihood ratio, per character, from which a candidate counts as a secret.
THRESHOLD = 1.0


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile("(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9_+/=.-]{16,}")
#: What a run is taken apart into, step by step; signs at the edges of a part do not belong to it.
_PARTS, _EDGE = [re.compile(p) for p in (r".+", r"[^=]+", r"[^=/]+", r"[^=/.]+")], ".=-/+"
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """What the plain patterns find, by start and then kind."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Automaton:
    """A probabilistic automaton inferred from example strings by merging compatible prefix-tree states."""

    END = ""

    def __init__(self, examples: Sequence[str], alpha: float = 0.05, alphabet: int = 66, alike: str = "") -> None:
        """``alike`` are characters that the automaton does not tell apart: each is as likely as any other of them."""
        self.alike = str.maketrans(dict.fromkeys(alike, alike[:1])) if alike else None
        self._share = math.log(len(alike)) if alike else 0.0
        self._first = alike[:1]
        examples = [s.translate(self.alike) for s in examples] if alike else examples
        self.count: list[Counter] = [Counter()]
        self.next: list[dict[str, int]] = [{}]
        for s in examples:
            q = 0
            for c in s:
                self.count[q][c] += 1
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                q = self.next[q][c]
            self.count[q][self.END] += 1
        lengths = sorted(map(len, examples))
        self.shortest = lengths[0]
        self.alphabet = alphabet
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _total(self, q: int) -> int:
        return sum(self.count[q].values())

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the Hoeffding bound cannot tell the outgoing frequencies apart, of two states and of those they lead to."""
        stack = [(a, b)]
        while stack:
            p, q = stack.pop()
            n, m = self._total(p), self._total(q)
            if not n or not m:
                continue
            limit = self._bound * (n**-0.5 + m**-0.5)
            if any(abs(self.count[p][c] / n - self.count[q][c] / m) > limit for c in self.count[p].keys() | self.count[q].keys()):
                return False
            if m > 4:  # below so few strings no difference can be told
                stack += [(self.next[p][c], self.next[q][c]) for c in self.next[q] if c in self.next[p] and self.next[p][c] != p]
        return True

    def _surprise(self, red: int, blue: int) -> float:
        """Mean negative log likelihood of what follows ``blue`` where ``red`` stands: of few strings it tells more than the bound."""
        t = self._total(red) + 1
        return -sum(n * math.log((self.count[red][c] + 1 / self.alphabet) / t) for c, n in self.count[blue].items()) / self._total(blue)

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree below ``blue`` to the automaton at ``red``."""
        stack = [(red, blue)]
        while stack:
            p, q = stack.pop()
            self.count[p] += self.count[q]
            for c, to in self.next[q].items():
                if c in self.next[p]:
                    stack.append((self.next[p][c], to))
                else:
                    self.next[p][c] = to

    def _merge_all(self) -> None:
        red = [0]
        while True:
            seen = set(red)
            blue = [(q, c, to) for q in red for c, to in self.next[q].items() if to not in seen]
            if not blue:
                break
            q, c, to = max(blue, key=lambda x: (self._total(x[2]), -x[2]))
            fits = [(self._surprise(r, to), r) for r in red if self._compatible(r, to)]
            if fits:
                r = min(fits)[1]
                self.next[q][c] = r
                self._fold(r, to)
            else:
                red.append(to)
        at = {q: i for i, q in enumerate(red)}  # states that were merged away go
        self.next, self.count = [{c: at[to] for c, to in self.next[q].items()} for q in red], [self.count[q] for q in red]
        whole: Counter = sum(self.count, Counter())
        size = sum(whole.values()) + FLOOR * self.alphabet
        rare = {c: SHARED * (n + FLOOR) / size for c, n in whole.items()}  # what any state shares with all others
        self._never = math.log(SHARED * FLOOR / size)
        self._rare = {c: math.log(p) for c, p in rare.items()}
        self._log = [{c: math.log(p + (1 - SHARED) * self.count[q][c] / max(1, self._total(q))) for c, p in rare.items() if self.count[q][c]} for q in range(len(red))]
        self.states = len(red)

    def log_likelihood(self, s: str) -> float:
        """Of the characters of ``s``; its end is judged by length instead."""
        q, total = 0, 0.0
        if self.alike:
            s = s.translate(self.alike)
            total -= self._share * s.count(self._first)
        for c in s:
            total += self._log[q].get(c) or self._rare.get(c, self._never)
            q = self.next[q].get(c, q)
        return total

    def fits(self, n: int) -> bool:
        """Whether ``n`` characters are not too few; likelihood, by character, judges all that are longer."""
        return 0.8 * self.shortest <= n


_LOWER_HEX, _ALNUM = "0123456789abcdef", string.ascii_letters + string.digits
_URL64 = _ALNUM + "-_"


def _drawn(r: random.Random, alphabet: str, low: int, high: int | None = None) -> str:
    return "".join(r.choices(alphabet, k=r.randint(low, high or low)))


# Public formats of credentials, as a prefix (one of several) with its alphabet and length. Bare digests need none: the plain pattern of hexadecimal runs finds them.
FORMATS: dict[str, Callable[[random.Random], str]] = {
    "access_key": lambda r: r.choice(("AKIA", "ASIA")) + _drawn(r, string.ascii_uppercase + "234567", 16),
    "github": lambda r: r.choice(("ghp_", "gho_", "ghs_", "ghu_")) + _drawn(r, _ALNUM, 36),
    "github_pat": lambda r: "github_pat_" + _drawn(r, _ALNUM, 22) + "_" + _drawn(r, _ALNUM, 59),
    "gitlab": lambda r: "glpat-" + _drawn(r, _URL64, 20),
    "slack": lambda r: r.choice(("xoxb-", "xoxp-", "xoxa-")) + _drawn(r, string.digits, 11, 12) + "-" + _drawn(r, string.digits, 11, 12) + "-" + _drawn(r, _ALNUM, 24),
    "payment": lambda r: r.choice(("sk_live_", "sk_test_", "rk_live_", "pk_live_")) + _drawn(r, _ALNUM, 24, 32),
    "cloud_api": lambda r: "AIza" + _drawn(r, _URL64, 35),
    "jwt": lambda r: "eyJhbGciOi" + _drawn(r, _ALNUM, 20, 26) + ".eyJ" + _drawn(r, _URL64, 30, 600) + "." + _drawn(r, _URL64, r.choice((43, 86, 176, 342))),
    "npm": lambda r: "npm_" + _drawn(r, _ALNUM, 36),
    "sendgrid": lambda r: "SG." + _drawn(r, _URL64, 22) + "." + _drawn(r, _URL64, 43),
    "model_api": lambda r: "sk-" + _drawn(r, _ALNUM, 40, 48),
    "base64_key": lambda r: _drawn(r, _ALNUM + "+/", 40),
}


# Sounds that ordinary names are put together from.
_ONSETS = "b c d f g h j k l m n p qu r s t v w x y z bl br ch cl cr dr fl fr gl gr ph pl pr sc sch sh sk sl sp st str th tr tw wh".split()
_VOWELS = "a e i o u a e i o u y ai au ea ee ei eu ie oa oo ou".split()
_CODAS = ["", "", "", *"n r s t l ll ng ck st nd nt ss m p d x".split()]


def _word(r: random.Random) -> str:
    return "".join(r.choice(_ONSETS) + r.choice(_VOWELS) + r.choice(_CODAS) for _ in range(r.randint(1, 4)))


def _grown(r: random.Random, part: Callable[[], str], between: Sequence[str]) -> str:
    s = part()
    while len(s) < 16 or (len(s) < 60 and r.random() < 0.6):
        s += r.choice(between) + part()
    return s


def _name(r: random.Random) -> str:
    """Names with numbers, versions, paths."""
    kinds = (lambda: _word(r), lambda: _word(r), lambda: _word(r), lambda: _word(r).capitalize(), lambda: str(r.randint(0, 10 ** r.randint(1, 5))))
    return _grown(r, lambda: r.choice(kinds)(), ("_", "-", ".", "/", ""))


def _id(r: random.Random) -> str:
    """A random identifier in five groups."""
    return "-".join(_drawn(r, _LOWER_HEX, n) for n in (8, 4, 4, 4, 12))


# Labelled ordinary strings, by kind.
ORDINARY: dict[str, Callable[[random.Random], str]] = {
    "name": _name,
    "word": lambda r: _grown(r, lambda: _word(r), ("", "", "", "-")),
    "camel": lambda r: _grown(r, lambda: _word(r).capitalize(), ("",)),
    "constant": lambda r: _grown(r, lambda: _word(r).upper(), ("_", "-", "")),
    "number": lambda r: _grown(r, lambda: _drawn(r, string.digits, 1, 8), ("-", ".", "", "/", "T", "_", "+")),
    "path_of_hashes": lambda r: _grown(r, lambda: r.choice((_word(r), _drawn(r, _LOWER_HEX, 2, 12))), ("/", "/", ".", "-", "_")),
    "rule": lambda r: (r.choice(_URL64 + "+/=.") * r.randint(16, 60)),
}
#: Ordinary identifiers in groups of digits of which any is as likely as another, with those digits.
IDS: dict[str, tuple[Callable[[random.Random], str], str]] = {"id": (_id, _LOWER_HEX), "upper_id": (lambda r: _id(r).upper(), _LOWER_HEX.upper())}


def _ordinary(r: random.Random) -> str:
    """A labelled ordinary string of any kind."""
    return r.choice([*ORDINARY.values(), *(draw for draw, _ in IDS.values())])(r)


@cache
def models() -> tuple[dict[str, Automaton], dict[str, Automaton]]:
    """The automata of the formats and of ordinary strings: inferred once in each process, always alike."""

    def inferred(title: str, draw: Callable[[random.Random], str], examples: int, alike: str = "") -> Automaton:
        r = random.Random(title)
        return Automaton([draw(r) for _ in range(examples)], alike=alike)

    formats = {name: inferred(f"format {name}", draw, EXAMPLES) for name, draw in FORMATS.items()}
    ordinary = {name: inferred(f"ordinary {name}", draw, 2 * EXAMPLES) for name, draw in ORDINARY.items()}
    made = formats, ordinary | {name: inferred(f"ordinary {name}", draw, EXAMPLES, alike) for name, (draw, alike) in IDS.items()}
    trim()
    return made


#: Candidates of at most so many characters are remembered, so what a worker keeps is bounded.
_KEPT = 256


def score(candidate: str) -> tuple[str, float]:
    """As ``_score``; short candidates come again often and are remembered."""
    return _remembered(candidate) if len(candidate) <= _KEPT else _score(candidate)


def _score(candidate: str) -> tuple[str, float]:
    """The likeliest format that is not too long for it, and the mean log likelihood ratio against the likeliest ordinary kind."""
    formats, ordinary = models()
    plain = max(a.log_likelihood(candidate) for a in ordinary.values())
    best = max(((a.log_likelihood(candidate), name) for name, a in formats.items() if a.fits(len(candidate))), default=None)
    return (best[1], (best[0] - plain) / len(candidate)) if best else ("", -math.inf)


_remembered = lru_cache(maxsize=4096)(_score)


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The stretches that spans, sorted by start, cover."""
    out: list[tuple[int, int]] = []
    for _, a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _inferred(run: str, at: int, taken: list[tuple[int, int]], step: int = 0) -> list[tuple[float, str, int, int]]:
    """(log likelihood ratio, format, start, end) of the secrets of a run that starts at ``at``: whole, or its parts if they are likelier; none in ``taken``."""
    found: list[tuple[float, str, int, int]] = []
    for m in _PARTS[step].finditer(run):
        s = m[0].strip(_EDGE)
        if len(s) < 16:
            continue
        a = at + m.start() + m[0].index(s)
        parts = _inferred(s, a, taken, step + 1) if step + 1 < len(_PARTS) else []
        i = bisect_left(taken, (a + len(s),)) - 1
        name, ratio = score(s) if i < 0 or taken[i][1] <= a else ("", -math.inf)
        if ratio >= THRESHOLD and ratio * len(s) >= sum(p[0] for p in parts):
            found.append((ratio * len(s), name, a, a + len(s)))
        else:
            found += parts
    return found


def spans_of(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans of a text: kind (or format), start, end, and whether an automaton added it."""
    if not text:
        return []
    base = base_spans(text)
    found = [(*s, False) for s in base]
    taken = _merged(base)
    for m in _CANDIDATE.finditer(text):
        found += [(name, a, b, True) for _, name, a, b in _inferred(m[0], m.start(), taken)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]) if s[0] in KINDS else len(KINDS), s[0], s[2]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("inferred", T.BooleanType()), T.StructField("value", T.StringType())]))


@F.pandas_udf(SPANS)
def find_spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b, "inferred": d, "value": t[a:b]} for k, a, b, d in spans_of(t)] for t in texts], dtype=object)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and the array ``spans`` of kind, start, end, inferred, value. No shuffle."""
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), find_spans(F.col(text_col)).alias("spans"))


def redact(text: str | None, mask: str = "<secret>") -> str | None:
    """The text with every span replaced; overlapping spans become one mask."""
    if not text or not (spans := spans_of(text)):
        return text
    out, here = [], 0
    for _, a, b, _ in spans:
        if a >= here:
            out += [text[here:a], mask]
        here = max(here, b)
    return "".join([*out, text[here:]])


@F.pandas_udf(T.StringType())
def redacted(texts: pd.Series) -> pd.Series:
    return texts.map(redact, na_action="ignore")
