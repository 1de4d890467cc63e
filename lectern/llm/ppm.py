"""Language-model scores of texts: prediction by partial matching over bytes, and a word unigram model beside it.

The byte model is a trie of contexts of up to ``ORDER`` bytes, with its counts taken over the whole training part. A
byte is coded in the longest context that the trie holds; if it has not followed there, an escape is coded (method C: as
often as there are distinct followers) and the next shorter context is asked, without the symbols that the longer one
has already ruled out. The end of a text is a symbol too (the byte 255, which UTF-8 never holds), so the
probabilities of all texts add up to at most one. Followers of a context also follow its shorter contexts, so what is
ruled out depends on the next longer context alone, and all denominators can be worked out beforehand.

The trie keeps every node, as a table. What is broadcast is a head of it: the probabilities of the strings of full depth
with the largest counts, at most 2^``NODE_BITS`` of them. All other strings of a text are joined by shuffle, with the same
table or, where training has not seen them, with the counts of their shorter contexts; where the head ends changes no
result. Words whose share is at least 1 in 2^``HEAD_BITS`` are likewise at most 2^``HEAD_BITS`` and are broadcast; all
other words are joined by shuffle, so every count is exact.

Defined results: a null text is an empty text, of its end alone; repeated rows each have a result; with no training
documents every word has the probability 1 and every byte 1 in 256; an empty table gives an empty result; a very long text is
scored whole. Other columns may have any names.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm._common import materialise, prepare, remainder, worker_state

ORDER = 5
NODE_BITS = 21
HEAD_BITS = 18
_START, _END = 0xFE, 0xFF
#: Entries that a worker gathers before it hands on partial counts.
_HELD_WORDS, _HELD_GRAMS = 400_000, 3_000_000
_SLOTS = 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of each text, and its end, with the ``order`` bytes before it, as one number; and where each text starts."""
    pad = bytes([_START]) * order
    joined = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\xff")), dtype=np.uint8)
    keys = joined[order:].astype(np.uint64)
    for j in range(1, order + 1):
        keys |= joined[order - j : len(joined) - j].astype(np.uint64) << np.uint64(8 * j)
    keys = keys[joined[order:] != _START]
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    return keys, np.cumsum(sizes) - sizes


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


class Trie:
    """The model in memory, as the joins of ``score_documents`` must give it: for each depth d the strings of d bytes with their counts, sorted."""

    def __init__(self, depths: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.nodes, self.contexts = depths, []
        for k, (keys, n) in enumerate(depths):
            owner = keys >> np.uint64(8)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(keys) else np.array([], dtype=np.int64)
            if k:  # what its followers count for in the next shorter context
                low, lower = depths[k - 1]
                shared = lower[np.searchsorted(low, keys & np.uint64((1 << (8 * k)) - 1))] if len(keys) else n
            else:
                shared = n
            sums = [np.add.reduceat(x, first) if len(keys) else x for x in (n, np.ones_like(n), shared)]
            self.contexts.append((owner[first], *sums))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each key's last byte after the bytes before it."""
        out = np.zeros(len(keys))
        alive = np.ones(len(keys), dtype=bool)
        ruled = np.zeros(len(keys), dtype=np.int64)
        known = np.zeros(len(keys), dtype=np.int64)
        for k in range(len(self.nodes) - 1, -1, -1):
            owners, totals, kinds, shared = self.contexts[k]
            nodes, counts = self.nodes[k]
            if not len(owners):
                continue
            context = (keys >> np.uint64(8)) & np.uint64((1 << (8 * k)) - 1)
            i = np.minimum(np.searchsorted(owners, context), len(owners) - 1)
            has = (owners[i] == context) & alive
            total, kind = totals[i] - ruled, kinds[i] - known
            node = keys & np.uint64((1 << (8 * (k + 1))) - 1)
            j = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
            hit = has & (nodes[j] == node)
            whole = (total + kind).astype(float)
            out[hit] += np.log10(counts[j[hit]] / whole[hit])
            escape = has & ~hit & (whole > 0)
            out[escape] += np.log10(kind[escape] / whole[escape])
            alive &= ~hit
            ruled, known = np.where(has, shared[i], ruled), np.where(has, kinds[i], known)
        out[alive] -= np.log10(256.0 - known[alive])
        return out


class Scorer:
    """The head of the trie, sorted, with a table of the strings last asked for, of fixed size; what is not in the head is NaN."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray) -> None:
        self.head, self.logs = grams, logs
        self.keys = np.full(1 << _SLOTS, 2**64 - 1, dtype=np.uint64)
        self.values = np.zeros(1 << _SLOTS)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.head):
            return np.full(len(keys), np.nan)
        i = np.minimum(np.searchsorted(self.head, keys), len(self.head) - 1)
        return np.where(self.head[i] == keys, self.logs[i], np.nan)

    def scores(self, texts: list[bytes], order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The sum of each text's strings of the head; and its other strings with how often they occur."""
        keys, starts = grams(texts, order)
        slot = (keys * _MULTIPLIER) >> np.uint64(64 - _SLOTS)
        values = self.values[slot]
        missed = np.flatnonzero(self.keys[slot] != keys)
        if len(missed):
            new, back = np.unique(keys[missed], return_inverse=True)
            value = self.log10(new)
            values[missed] = value[back]
            slot = (new * _MULTIPLIER) >> np.uint64(64 - _SLOTS)
            self.keys[slot], self.values[slot] = new, value
        absent = np.flatnonzero(np.isnan(values))
        values[absent] = 0.0
        rest = np.split(keys[absent], np.searchsorted(absent, starts[1:]))
        return np.add.reduceat(values, starts), [np.unique(r, return_counts=True) for r in rest]


def _raw(texts: pd.Series) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in texts]


def counts(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """word, depth, gram, n over all of ``docs``: words in lower case (A-Z), byte strings by depth; counted before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[bytes] = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def of_words() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode() for w in words], "depth": 0, "gram": 0, "n": list(words.values())})

        def of_grams() -> Iterator[pd.DataFrame]:
            keys, n = _summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            for d in range(order + 1, 0, -1):
                if d <= order:
                    keys, n = _summed(keys & np.uint64((1 << (8 * d)) - 1), n)
                for i in range(0, len(keys), 200_000):
                    yield pd.DataFrame({"word": None, "depth": d, "gram": keys[i : i + 200_000].view(np.int64), "n": n[i : i + 200_000]})

        for batch in batches:
            for i in range(0, len(batch), 250):
                texts = _raw(batch["t"].iloc[i : i + 250])
                for t in texts:
                    words.update(t.lower().split())
                keys, _ = grams(texts, order)
                keys.sort()
                held.append(np.unique(keys, return_counts=True))
                size += len(held[-1][0])
                if len(words) > _HELD_WORDS:
                    yield of_words()
                    words.clear()
                if size > _HELD_GRAMS:
                    held = [_summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))]
                    size = len(held[0][0])
                    if size > _HELD_GRAMS // 2:
                        yield from of_grams()
                        held, size = [], 0
        if words:
            yield of_words()
        if held:
            yield from of_grams()

    parts = docs.select(F.col(text_col).alias("t")).mapInPandas(run, "word string, depth int, gram bigint, n bigint")
    return parts.groupBy("word", "depth", "gram").agg(F.sum("n").alias("n"))


def leaves(nodes: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n, log of each string of full depth: it followed its context, so this is its whole probability."""
    of = W.partitionBy(F.shiftrightunsigned("gram", 8))
    full = nodes.filter(F.col("depth") == order + 1)
    return full.select("gram", "n", F.log10(F.col("n") / (F.sum("n").over(of) + F.count(F.lit(1)).over(of))).alias("log"))


def head_count(leaf: DataFrame, head_bits: int = NODE_BITS) -> int:
    """The least power of two such that at most 2^head_bits strings of full depth have that count or more."""
    sizes = leaf.agg(*(F.count(F.when(F.col("n") >= 1 << i, 1)) for i in range(62))).first()
    return 1 << next(i for i, size in enumerate(sizes) if size <= 1 << head_bits)


def _looked_up(asked: DataFrame, table: DataFrame, by: str, short: int) -> DataFrame:
    """``asked`` with its row of ``table``; up to depth ``short`` there are at most 2^16 keys a depth, all of them hot, and those are broadcast."""
    low = asked.filter(F.col("depth") <= short).join(F.broadcast(table.filter(F.col("depth") <= short)), ["depth", by], "left")
    return low.unionByName(asked.filter(F.col("depth") > short).join(table.filter(F.col("depth") > short), ["depth", by], "left"))


def unseen_logs(unseen: DataFrame, nodes: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, log of distinct strings that no training text holds, by escapes through the counts of all their shorter contexts."""
    gram = F.col("gram")
    mask: Callable[[int], Column] = lambda d: F.lit((1 << (8 * d)) - 1)
    depths = [F.struct(F.lit(d).alias("depth"), gram.bitwiseAND(mask(d)).alias("low"), F.shiftrightunsigned(gram, 8).bitwiseAND(mask(d - 1)).alias("context")) for d in range(1, order + 2)]
    asked = unseen.select("gram", F.explode(F.array(*depths)).alias("a")).select("gram", "a.*")
    below = F.when(F.col("depth") > 1, F.expr("gram & (shiftleft(1L, 8 * (depth - 1)) - 1)"))
    followers = nodes.select("depth", "n", F.shiftrightunsigned("gram", 8).alias("context"), (F.col("depth") - 1).alias("up"), below.alias("suffix"))
    followers = followers.join(asked.select("depth", "context").distinct(), ["depth", "context"], "left_semi")
    shorter = nodes.select(F.col("depth").alias("up"), F.col("gram").alias("suffix"), F.col("n").alias("m"))
    contexts = followers.join(shorter, ["up", "suffix"], "left").groupBy("depth", "context").agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("kinds"),
        F.sum(F.coalesce("m", "n")).alias("shared"),  # what its followers count for in the next shorter context
    )
    asked = _looked_up(asked, nodes.withColumnRenamed("gram", "low"), "low", 2)
    asked = _looked_up(asked, contexts, "context", 3)
    names = ("n", "total", "kinds", "shared")
    wide = asked.groupBy("gram").agg(*(F.max(F.when(F.col("depth") == d, F.col(c))).alias(f"{c}{d}") for d in range(1, order + 2) for c in names))
    state = wide.select("*", F.lit(0.0).alias("log"), F.lit(True).alias("alive"), F.lit(0).cast("bigint").alias("ruled"), F.lit(0).cast("bigint").alias("known"))
    for d in range(order + 1, 0, -1):
        n, total, kinds, shared = (F.col(f"{c}{d}") for c in names)
        has, kind = total.isNotNull(), kinds - F.col("known")
        whole = total - F.col("ruled") + kind
        step = F.when(F.col("alive") & has & n.isNotNull(), F.log10(n / whole)).when(F.col("alive") & has & (whole > 0), F.log10(kind / whole)).otherwise(0.0)
        state = state.select(
            "gram", *(f"{c}{e}" for e in range(1, d) for c in names),
            (F.col("log") + step).alias("log"),
            (F.col("alive") & ~(has & n.isNotNull())).alias("alive"),
            F.when(has, shared).otherwise(F.col("ruled")).alias("ruled"),
            F.when(has, kinds).otherwise(F.col("known")).alias("known"),
        )
    return state.select("gram", (F.col("log") - F.when(F.col("alive"), F.log10(F.lit(256.0) - F.col("known"))).otherwise(0.0)).alias("log"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, fold: int = 7, held_out: int = 2, head_bits: int = NODE_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both models learn from the rows whose crc32 of the id, modulo ``fold``, is not ``held_out``.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), (remainder(id_col, fold) == held_out).alias("held_out"))
    train = docs.filter(~F.col("held_out"))
    counted = materialise(counts(train, "t", order))
    words = counted.filter("depth = 0")
    distinct, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = counted.filter(f"depth = 1 and gram = {_END}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, distinct = total + ends, distinct + (ends > 0)
    whole = math.log10(total + distinct + 1)
    share = total / 2**HEAD_BITS
    head = words.filter(F.col("n") >= share).select("word", "n").toArrow()
    common = {w.encode(): n for w, n in zip(head.column("word").to_pylist(), head.column("n").to_pylist(), strict=True)}
    nodes = counted.filter("depth > 0").select("depth", "gram", "n")
    leaf = materialise(leaves(nodes, order))
    least = head_count(leaf, head_bits)
    known = leaf.filter(F.col("n") >= least).select("gram", "log").toArrow()
    grams_of, logs = known.column("gram").to_numpy().view(np.uint64), known.column("log").to_numpy()
    by = np.argsort(grams_of)
    sent, key = spark.sparkContext.broadcast((grams_of[by], logs[by], common)), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        *head, common = sent.value
        scorer, log = worker_state(key, lambda: (Scorer(*head), {w: math.log10(n + 1) - whole for w, n in common.items()}))
        of_end = math.log10(ends + 1) - whole
        for batch in batches:
            for i in range(0, len(batch), 250):
                part = batch.iloc[i : i + 250]
                texts = _raw(part["t"])
                rows = []
                for t in texts:
                    tokens = t.lower().split()
                    found = [x for w in tokens if (x := log.get(w)) is not None]
                    rare = b" ".join([w for w in tokens if w not in log]) if len(found) < len(tokens) else b""
                    rows.append((len(tokens) + 1, len(found) + (ends > 0), math.fsum(found) + of_end, rare.decode()))
                out = pd.DataFrame(rows, columns=["n_tokens", "n_head", "head_score", "rare"])
                out.insert(0, "doc_id", part["doc_id"].array)
                out.insert(1, "held_out", part["held_out"].array)
                out["score"], rest = scorer.scores(texts, order)
                out["grams"], out["times"] = [g.view(np.int64) for g, _ in rest], [n for _, n in rest]
                yield out

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.mapInPandas(run, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_head bigint, head_score double, rare string, score double, grams array<bigint>, times array<bigint>")
    scored = materialise(scored.withColumn("rid", F.monotonically_increasing_id()))
    rare = scored.filter("rare <> ''").select("rid", F.explode(F.split("rare", " ")).alias("word")).groupBy("rid", "word").agg(F.count(F.lit(1)).alias("k"))
    tail = words.filter(F.col("n") < share).select("word", "n")
    of_rare = rare.join(tail, "word", "left").groupBy("rid").agg(
        F.sum(F.col("k") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - whole)).alias("rare_score"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("n_rare"),
    )
    others: Callable[[DataFrame], DataFrame] = lambda d: d.select("rid", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("rid", F.col("g.grams").alias("gram"), F.col("g.times").alias("k"))
    # the training texts hold no string that the trie does not
    unseen = materialise(others(scored.filter("held_out")).select("gram").distinct().join(leaf.select("gram"), "gram", "left_anti"))
    rest = leaf.filter(F.col("n") < least).select("gram", "log").unionByName(unseen_logs(unseen, nodes, order))
    of_grams = others(scored).join(rest, "gram").groupBy("rid").agg(F.sum(F.col("k") * F.col("log")).alias("gram_score"))
    return scored.drop("rare", "grams", "times").join(of_rare, "rid", "left").join(of_grams, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("gram_score", F.lit(0.0))).alias("score"),
    )
