"""Benchmark items in documents, with edits: exact hits of pieces, verified by Myers' bit-parallel distance.

Items and texts are compared in lower case with every run of other signs than letters and digits as one space. An
item of n characters may differ by one edit in ``EDIT_SPAN`` characters, k in all, and is split into k + 1 pieces: at
least one of them is in the text unchanged. All pieces are looked for in one pass by an Aho-Corasick automaton. A
hit is verified up a tree of neighbouring pieces: if the item is in the text within k edits, then some chain from
piece to item holds at most m - 1 edits in each node of m pieces, so a false hit costs a short comparison.

The items come to the tasks in blocks of at most ``BLOCK_CHARS`` characters; a larger benchmark takes more passes.

Defined results: null and empty items, and items without letters or digits, are never found; a null text holds
nothing; an empty table gives an empty result; repeated documents each have a result, repeated items count once; a very
long text is searched whole, in one pass; other columns than those named may have any names; of several occurrences of an item in a text the one with the fewest
edits is given, the first among equals. Positions are code points of the source, ends exclusive.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm._common import prepare, worker_state

EDIT_SPAN = 12
BLOCK_CHARS = 4_000_000
_GAP = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")


def normalise(text: str) -> str:
    """Lower case, other signs as one space. A space stands at either end."""
    return f" {_GAP.sub(' ', text.replace('İ', 'I').lower()).strip(' ')} "


def source_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Source positions of a span of the normalised text."""
    lowered = text.replace("İ", "I").lower()
    norm, src, at = [], [], 1
    for m in _WORD.finditer(lowered):
        norm.append(at)
        src.append((m.start(), m.end()))
        at += m.end() - m.start() + 1

    def place(i: int, end: bool) -> int:
        w = max(0, bisect_right(norm, i) - 1)
        a, b = src[w]
        return min(b, a + max(0, i - norm[w])) + end

    return place(start, False), min(len(text), place(max(start, end - 1), True))


class Pattern:
    """A string that is searched for with edits."""

    def __init__(self, s: str) -> None:
        self.s = s

    @cached_property
    def masks(self) -> dict[str, int]:
        out: dict[str, int] = defaultdict(int)
        for i, c in enumerate(self.s):
            out[c] |= 1 << i
        return dict(out)

    def best(self, text: str) -> tuple[int, int]:
        """The fewest edits to any substring of ``text``, and the first end of such."""
        m, masks = len(self.s), self.masks
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score = full, 0, m
        least, at = m, 0
        for i, c in enumerate(text):
            eq = masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < least:
                    least, at = score, i + 1
            ph, mh = (ph << 1) & full, (mh << 1) & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
        return least, at


class Item:
    """One benchmark item: its pieces, and for each piece the chain of nodes to verify."""

    def __init__(self, item_id: object, text: str, edit_span: int) -> None:
        self.id, self.norm = item_id, normalise(text).strip(" ")
        n = len(self.norm)
        if n < edit_span:  # too short for any edit: whole words, exactly
            self.norm, self.k = f" {self.norm} ", 0
            n += 2
        else:
            self.k = n // edit_span
        self.cuts = [i * n // (self.k + 1) for i in range(self.k + 2)]
        self._patterns: dict[tuple[int, int], Pattern] = {}
        self.back = Pattern(self.norm[::-1])

    def pieces(self) -> Iterator[tuple[str, int]]:
        for i in range(self.k + 1):
            yield self.norm[self.cuts[i] : self.cuts[i + 1]], i

    def chain(self, piece: int) -> list[tuple[int, int]]:
        lo, hi, out = 0, self.k + 1, []
        while hi - lo > 1:
            out.append((lo, hi))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if piece < mid else (mid, hi)
        return out[::-1]

    def verify(self, norm: str, piece: int, at: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the item around a hit of ``piece`` that starts at ``at``; None if it takes too many."""
        best, end, lo_text = 0, at + self.cuts[piece + 1] - self.cuts[piece], at
        for lo, hi in self.chain(piece):
            p = self._patterns.setdefault((lo, hi), Pattern(self.norm[self.cuts[lo] : self.cuts[hi]]))
            slack = hi - lo - 1
            lo_text = max(0, at - (self.cuts[piece] - self.cuts[lo]) - slack)
            hi_text = at + self.cuts[hi] - self.cuts[piece] + slack
            best, end = p.best(norm[lo_text:hi_text])
            if best > slack:
                return None
            end += lo_text
        _, back = self.back.best(norm[max(0, end - len(self.norm) - best) : end][::-1])
        start = end - back
        return best, start + (norm[start : start + 1] == " "), end - (norm[end - 1 : end] == " ")


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[object, str]], edit_span: int) -> None:
        import ahocorasick

        self.items = [x for i, t in items if (x := Item(i, t, edit_span)).norm.strip(" ")]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, item in enumerate(self.items):
            for s, piece in item.pieces():
                where[s].append((n, piece))
        self.automaton = ahocorasick.Automaton()
        for s, hits in where.items():
            self.automaton.add_word(s, (len(s), hits))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[object, int, int, int, int]]:
        """(item id, edits, allowed edits, start, end) for each item found, in the order of the items."""
        if not text or not self.items:
            return []
        norm = normalise(text)
        found: dict[int, tuple[int, int, int]] = {}
        for last, (size, hits) in self.automaton.iter(norm):
            at = last - size + 1
            for n, piece in hits:
                item = self.items[n]
                if (old := found.get(n)) and (old[0] == 0 or old[1] <= at < old[2]):
                    continue  # nothing better, or a piece of what was found
                if (new := item.verify(norm, piece, at)) and (not old or new < old):
                    found[n] = new
        return [(self.items[n].id, e, self.items[n].k, *source_span(text, a, b)) for n, (e, a, b) in sorted(found.items())]


def _matcher(key: str, items: list[tuple[object, str]], edit_span: int) -> Matcher:
    """One automaton in each Python worker for the block that is at work."""
    return worker_state(key, lambda: Matcher(items, edit_span))


def _blocks(bench: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    bench = bench.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull()).distinct()
    total = bench.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for b in range(n):
        yield [(r["i"], r["t"]) for r in bench.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()]


def _found_type(bench: DataFrame, item_col: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("item_id", bench.schema[item_col].dataType), *(T.StructField(c, T.LongType()) for c in ("edits", "allowed", "start", "end"))]))


def matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edit_span: int = EDIT_SPAN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits, allowed, start, end: one row for each item in each row of ``docs``. No shuffle."""
    prepare(docs.sparkSession)
    kind, out = _found_type(bench, item_col), None
    for block in _blocks(bench, item_col, item_text_col, block_chars):
        find = _finder(docs, block, edit_span, kind)
        part = docs.select(F.col(id_col).alias("doc_id"), F.explode(find(F.col(text_col))).alias("m")).select("doc_id", "m.*")
        out = part if out is None else out.unionByName(part)
    return out


def _finder(docs: DataFrame, block: list[tuple[object, str]], edit_span: int, kind: T.DataType):  # noqa: ANN202
    sent, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    names = ("item_id", "edits", "allowed", "start", "end")

    @F.pandas_udf(kind)
    def find(texts: pd.Series) -> pd.Series:
        m = _matcher(key, sent.value, edit_span)
        return pd.Series([[dict(zip(names, x, strict=True)) for x in m.find(t)] for t in texts], dtype=object)

    return find


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edit_span: int = EDIT_SPAN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    prepare(docs.sparkSession)
    kind = _found_type(bench, item_col)
    for block in _blocks(bench, item_col, item_text_col, block_chars):
        docs = docs.filter(F.size(_finder(docs, block, edit_span, kind)(F.col(text_col))) == 0)
    return docs
