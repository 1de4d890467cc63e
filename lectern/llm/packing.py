"""Best-two-fit packing of tokenised documents into sequences of fixed length.

Every document becomes its token ids and an end id; only what is longer than a sequence is cut. Lengths are whole
numbers of at most ``capacity``, so all documents of one length are interchangeable, and the plan needs no more
than how many pieces each length has: at most ``capacity`` rows come to the driver, however large the corpus.
``plan`` fills bins greedily with the longest piece that fits, for all bins of one make-up together; then a bin's
smallest piece gives way to two unpacked pieces that fit the widened gap more tightly. Pieces take their places
by their rank within their length. Ranks are taken in salted groups, so that a length that a third of all pieces
share is spread over many tasks.

Defined results: a null text is an empty text and becomes the end id alone; repeated rows are packed each for
itself; an empty table gives an empty result; a very long text is tokenised in parts cut at white space. Columns of the
documents other than the two named ones are not read, so they may have any names.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm._common import by_size, materialise, prepare, worker_state

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
#: Ids of words that a Python worker keeps; beyond it the worker starts anew, so its memory is bounded.
KEPT_IDS = 4_000_000
_SLOTS = 20
#: Characters of texts that are cut and looked up at once; a longer text is taken apart at white space.
AT_ONCE = 250_000
#: Rows of one (length, salt) group that a task ranks.
RANKED_TOGETHER = 1000
#: Texts of code points below this, and without apostrophes or the one capital that two characters make in lower case, are plain.
_PLAIN = 0x180
_ODD = re.compile("['\u0130]|[^\x00-\u017f]")
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_BETWEEN = re.compile(r"[\t\n\r ]+(?=[A-Za-z0-9])")
#: Pieces of so many characters go through the tokenizer each time.
_LONGEST = 96


class WordTokenizer:
    """Ids of whole texts, with the ids of words kept.

    The vocabulary's splitter makes pieces of letters, of single digits and of other signs, and never looks past
    white space. For texts of the first ``_PLAIN`` code points without apostrophes the same cuts are made here for
    many texts at once, and each piece is known by a 64-bit hash of its lower-case letters; the tokenizer itself
    gives the ids of pieces not met lately. Other texts go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # control strings in a text are ordinary text
        self.model.no_padding()
        self.model.no_truncation()
        chars = [chr(i) for i in range(_PLAIN)]
        self.kind = np.array([0 if c in _SPACE else 1 if c.isalpha() else 2 if unicodedata.category(c)[0] == "N" else 3 for c in chars], dtype=np.uint8)
        self.lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in chars)
        r = np.random.default_rng(5)
        self.of_char = r.integers(1, 2**63, _PLAIN, dtype=np.uint64)
        self.of_char = self.of_char[[min(ord(c), _PLAIN - 1) for c in self.lower]]
        self.of_place = r.integers(1, 2**62, _LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(1 << _SLOTS, dtype=np.uint64)
        self.at, self.size = np.zeros(1 << _SLOTS, dtype=np.int64), np.zeros(1 << _SLOTS, dtype=np.int64)
        self.pool, self.used = np.zeros(1 << 20, dtype="<u4"), 0

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def _keep(self, ids: np.ndarray) -> int:
        """Where the pool holds ``ids`` from now on."""
        at = self.used
        while at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the ids of lower-case pieces. Many pieces of letters go in one call, told apart by the splitter's word numbers."""
        at, size = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        letters = [i for i, w in enumerate(words) if w.isalpha()]
        for j in range(0, len(letters), 5000):
            part = letters[j : j + 5000]
            e = self.model.encode(" ".join([words[i] for i in part]), add_special_tokens=False)
            cuts = np.searchsorted(np.array(e.word_ids), np.arange(len(part) + 1))
            at[part] = self._keep(np.array(e.ids, dtype="<u4")) + cuts[:-1]
            size[part] = np.diff(cuts)
        rest = [i for i, w in enumerate(words) if not w.isalpha()]
        for i, raw in zip(rest, self._packed([words[i] for i in rest]), strict=True):
            at[i], size[i] = self._keep(np.frombuffer(raw, dtype="<u4")), len(raw) // 4
        return at, size

    def _plain_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of plain characters, all at once."""
        if self.used > KEPT_IDS:
            self._forget()
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        kind = self.kind[codes]
        inside = kind != 0
        if not inside.any():
            return [b""] * len(texts)
        first = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == 2)] & inside
        start = np.flatnonzero(first)
        piece = np.cumsum(first) - 1
        where = np.flatnonzero(inside)
        owner = piece[where]
        place = where - start[owner]
        sizes = np.bincount(owner, minlength=len(start))
        hashed = self.of_char[codes[where]] * self.of_place[np.minimum(place, _LONGEST - 1)]
        key = np.add.reduceat(hashed, np.r_[0, np.cumsum(sizes)[:-1]])
        key ^= key >> np.uint64(31)
        slot = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)
        at, size = self.at[slot], self.size[slot]
        long = sizes >= _LONGEST
        missed = np.flatnonzero((self.keys[slot] != key) & ~long)
        if len(missed):
            new, one, back = np.unique(key[missed], return_index=True, return_inverse=True)
            words = [joined[a:z].lower() for a, z in zip(start[missed[one]].tolist(), (start + sizes)[missed[one]].tolist(), strict=True)]
            new_at, new_size = self._learn(words)
            at[missed], size[missed] = new_at[back], new_size[back]
            slot = slot[missed[one]]
            self.keys[slot], self.at[slot], self.size[slot] = new, new_at, new_size
        for i in np.flatnonzero(long):
            at[i], size[i] = (x[0] for x in self._learn([joined[start[i] : start[i] + sizes[i]].lower()]))
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(at - (ends - size), size) + np.arange(ends[-1])].tobytes()
        last = np.cumsum([len(t) + 1 for t in texts])
        cut = np.r_[0, np.r_[0, ends][np.searchsorted(start, last)]] * 4
        return [ids[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, of a bounded number of characters at a time."""
        out: list[bytes] = []
        for part in by_size(texts, AT_ONCE):
            some = texts[part]
            out += [b"".join(chain.from_iterable(self._ids([p]) for p in _cut(t))) for t in some] if any(len(t) > 2 * AT_ONCE for t in some) else self._ids(some)
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if _ODD.search(t)]
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        out = self._plain_ids(plain)
        for i, ids in zip(odd, self._packed([texts[i] for i in odd]), strict=True):
            out[i] = ids
        return out


def _cut(text: str) -> Iterator[str]:
    """Parts of a long text: each but the last ends before white space that a letter A-Z or a digit follows, so no piece is cut."""
    a = 0
    while len(text) - a > AT_ONCE and (m := _BETWEEN.search(text, a + AT_ONCE)):
        yield text[a : m.start()]
        a = m.end()
    yield text[a:]


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (if kept) ids, binary little-endian, of each piece of each document."""
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        tok = worker_state(f"words {tokenizer}", lambda: WordTokenizer(public_tokenizers.path(tokenizer)))
        end = struct.pack("<I", END_ID)
        for batch in batches:
            rows = []
            texts = [t if isinstance(t, str) else "" for t in batch["t"]]
            for doc, ids in zip(batch["d"], tok.encode(texts), strict=True):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    rows.append((doc, k, a // 4, len(part) // 4, zlib.crc32(part), part)[: 5 + keep_ids])
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    return docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).mapInPandas(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """How often each make-up of a bin is used: (number of bins, lengths in the bin)."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    done: list[tuple[int, list[int]]] = []

    def take(n: int, k: int) -> None:
        left[n] -= k
        if not left[n]:
            del left[n]
            lengths.pop(bisect_right(lengths, n) - 1)

    def give(n: int, k: int) -> None:
        if n not in left:
            left[n] = 0
            insort(lengths, n)
        left[n] += k

    def tightest_pair(room: int, above: int) -> tuple[int, int] | None:
        """Two unpacked lengths with the largest sum of at most ``room`` and more than ``above``."""
        best, pair, i, j = above, None, 0, bisect_right(lengths, room) - 1
        while i <= j:
            s = lengths[i] + lengths[j]
            if s > room:
                j -= 1
            elif i == j and left[lengths[i]] < 2:
                i += 1
            else:
                if s > best:
                    best, pair = s, (lengths[i], lengths[j])
                i += 1
        return pair

    while lengths:
        n = lengths[-1]
        k = left[n]
        take(n, k)
        bins = [(k, [n], capacity - n)]
        while bins:
            k, held, gap = bins.pop()
            i = bisect_right(lengths, gap) - 1
            if i >= 0:  # greedily the longest that fits
                n = lengths[i]
                used = min(k, left[n])
                if used < k:
                    bins.append((k - used, held, gap))
                take(n, used)
                bins.append((used, [*held, n], gap - n))
                continue
            small = held[-1]
            if gap and len(held) > 1 and (pair := tightest_pair(gap + small, small)):
                a, b = pair
                used = min(k, left[a] // 2 if a == b else min(left[a], left[b]))
                if used < k:
                    bins.append((k - used, held, gap))
                take(a, used)
                take(b, used)
                give(small, used)
                bins.append((used, sorted([*held[:-1], a, b], reverse=True), gap + small - a - b))
                continue
            done.append((k, held))
    return done


def placements(bins: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """For each length its ranks, in runs: from rank ``low`` on, the next sequence and the same offset."""
    rows, seen, sequence = [], {}, 0
    for k, held in bins:
        offset = 0
        for n in held:
            rows.append((n, seen.get(n, 0), sequence, offset))
            seen[n] = seen.get(n, 0) + k
            offset += n
        sequence += k
    table = pd.DataFrame(rows, columns=["length", "low", "sequence", "offset"], dtype="int64")
    return table.sort_values(["length", "low"], ignore_index=True)


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a column ``length``) and their ``sequence_id`` and ``offset``. ``order`` settles ranks.

    The pieces are written once, slim; the plan goes to the tasks as runs of ranks, of which there are no more
    than a few for each length.
    """
    spark = pieces.sparkSession
    pieces = materialise(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = placements(plan(counts, capacity))
    runs = spark.sparkContext.broadcast(table)
    sizes = spark.createDataFrame([(n, -(-c // RANKED_TOGETHER)) for n, c in counts.items()], "length bigint, __salts bigint")  # at most capacity rows
    salted = pieces.join(F.broadcast(sizes), "length").withColumn("__salt", F.pmod(F.xxhash64(*order), F.col("__salts"))).drop("__salts")
    per = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = per.select("length", "__salt", (F.sum("__n").over(W.partitionBy("length").orderBy("__salt")) - F.col("__n")).alias("__before"))
    ranked = salted.withColumn("__rank", F.row_number().over(W.partitionBy("length", "__salt").orderBy(*order)).cast("bigint") - 1)
    ranked = ranked.join(before, ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    columns = [c for c in pieces.columns]

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = runs.value
        wide = np.int64(1) << np.int64(44)
        i = np.searchsorted((t["length"].to_numpy() * wide + t["low"].to_numpy()), length.to_numpy() * wide + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": t["sequence"].to_numpy()[i] + rank.to_numpy() - t["low"].to_numpy()[i], "offset": t["offset"].to_numpy()[i]})

    placed = ranked.withColumn("__p", place("length", "__rank"))
    return placed.select(*columns, F.col("__p.sequence_id").alias("sequence_id"), F.col("__p.offset").alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, keep_ids: bool = False) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return pack(tokenize_pieces(docs, id_col, text_col, capacity, tokenizer, keep_ids), ["doc_id", "piece", "ids_crc32", "start"], capacity)
