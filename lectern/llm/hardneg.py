"""Hard negatives for contrastive training, by a full sort of each anchor's scores.

Vectors become whole numbers, so scores are exact. For each anchor all scores are sorted, best first and ties by id; its
positives are the first rows of its own label; for each positive a binary search finds where scores no higher than its
own begin, and the next rows of other labels are read while they are above the lower limit.

Candidates lie in blocks of bounded size, one a task; anchors stream through every block in batches, so neither all
rows nor all anchors are ever in one place. A block's sorted scores give its first positives, and in a second pass its
first negatives for every positive; the first of all blocks together are exact. A candidate is shipped once a pass, an
anchor once for each block: work grows with anchors times rows, what is shipped with anchors times blocks.

Defined results: rows with a null id, label or vector, with a null or non-finite component, or of another length than
most take no part, nor do vectors with a component so large that a score might not fit 64 bits (``largest``).
Repeated rows (same id, label and vector) count once; of an id with several rows each is a row of its own; a row is
never its own positive; an empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm._common import materialise, prepare

K, POSITIVES, EVERY = 5, 5, 100
#: Limits of a negative's score, in hundredths of the positive's.
LOW, HIGH = 80, 100
SCALE = 256
#: Candidates in one block at most, and how many scores are held at once.
BLOCK, AT_ONCE = 131_072, 1 << 22


def largest(dim: int) -> int:
    """The largest component in size with which every score fits 64 bits and every component 32."""
    return min(math.isqrt((2**63 - 1) // max(1, dim)), 2**31 - 1)


def index(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """vec_id, label (as text), raw (32-bit whole numbers) of all rows that take part, and the length of their vectors."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).dropna()
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = common["n"] if common else 0
    rows = rows.filter((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE))).filter(F.forall("v", lambda x: F.abs(x) <= largest(dim)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            x = np.asarray(v.flatten(), dtype="<i4").reshape(len(v), dim)
            yield pa.record_batch([b.column("vec_id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "label", "raw"])

    return materialise(rows.mapInArrow(pack, "vec_id bigint, label string, raw binary").dropDuplicates()), dim


def _matrix(raw: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), dtype="<i4").reshape(len(raw), dim)


class Block:
    """Candidates of one task, by id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        names, self.labels = np.unique(labels[order], return_inverse=True)
        self.number = {n: i for i, n in enumerate(names.tolist())}
        self.of_label = [np.flatnonzero(self.labels == i) for i in range(len(names))]
        self.most = int(np.abs(self.x, dtype=np.int64).max(initial=0)) if self.x.size else 0

    def scores(self, a: np.ndarray) -> Iterator[np.ndarray]:
        """Each anchor's exact scores with all candidates."""
        exact = self.x.shape[1] * self.most * int(np.abs(a, dtype=np.int64).max(initial=0)) < 2**53  # then doubles hold every sum
        kind = np.float64 if exact else np.int64
        step = max(1, AT_ONCE // max(1, len(self.x)))
        for i in range(0, len(a), step):
            out = np.zeros((min(step, len(a) - i), len(self.x)), dtype=np.int64)
            for j in range(0, len(self.x), 16_384):
                out[:, j : j + 16_384] = a[i : i + step].astype(kind) @ self.x[j : j + 16_384].astype(kind).T
            yield from out

    def positives(self, own: int, label: str, vector: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """The first ``k`` candidates of the anchor's label, but itself."""
        if label not in self.number:
            return np.zeros(0, dtype=np.int64)
        same = self.of_label[self.number[label]]
        a, b = np.searchsorted(self.ids[same], [own, own + 1])
        if a < b:
            itself = (self.x[same[a:b]] == vector).all(axis=1)
            same = np.concatenate([same[:a], same[a:b][~itself], same[b:]])
        return same[np.lexsort((self.ids[same], -scores[same]))[:k]]

    def negatives(self, label: str, scores: np.ndarray, limits: list[tuple[int, int]], k: int) -> Iterator[np.ndarray]:
        """For each (lower, upper) limit the first ``k`` candidates of other labels within it."""
        order = np.lexsort((self.ids, -scores))
        other = order[self.labels[order] != self.number.get(label, -1)]
        falling = -scores[other]
        for low, high in limits:
            a, b = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
            yield other[a : min(a + k, b)]


def _streamed(candidates: DataFrame, anchors: DataFrame, blocks: int, dim: int, each, schema: str) -> DataFrame:  # noqa: ANN001
    """``each`` (block, anchor as a dict, its scores) gives rows; every anchor meets every block."""
    left = candidates.select(F.pmod(F.xxhash64("vec_id", "label", "raw"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), "*")
    right = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "*")
    dealt = left.unionByName(right, allowMissingColumns=True).repartitionById(blocks, F.col("block")).sortWithinPartitions("side")
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block = None
        for b in batches:
            cut = int(np.searchsorted(b.column("side").to_numpy(), 1))
            if cut:
                held.append(b.slice(0, cut).select(["vec_id", "label", "raw"]))
            if cut == len(b) or not held:
                continue
            if block is None:
                t = pa.Table.from_batches(held)
                block = Block(t["vec_id"].to_numpy(), np.array(t["label"].to_pylist(), dtype=object), np.concatenate([_matrix(h.column("raw"), dim) for h in held]))
            asked = b.slice(cut)
            a, rows = _matrix(asked.column("raw"), dim), asked.drop_columns(["raw"]).to_pylist()
            out = [r for row, vector, scores in zip(rows, a, block.scores(a), strict=True) for r in each(block, row, vector, scores)]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names)

    return dealt.mapInArrow(run, schema)


def mine(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", k: int = K, positives: int = POSITIVES, every: int = EVERY, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``every``. For each of an anchor's first ``positives`` rows of its label: the first ``k`` of
    other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    """
    rows, dim = index(vectors, id_col, label_col, vector_col)
    n = rows.count()
    blocks = max(1, -(-n // block), min(2 * vectors.sparkSession.sparkContext.defaultParallelism, n // 1024))
    anchors = rows.filter(F.col("vec_id") % every == 0).withColumn("version", F.xxhash64("label", "raw"))
    own = ["vec_id", "version"]

    def first(b: Block, row: dict, vector: np.ndarray, scores: np.ndarray) -> Iterator[tuple]:
        for i in b.positives(row["vec_id"], row["label"], vector, scores, positives):
            yield row["vec_id"], row["version"], int(b.ids[i]), int(scores[i])

    found = _streamed(rows, anchors, blocks, dim, first, "vec_id bigint, version bigint, id bigint, score bigint")
    place = F.row_number().over(W.partitionBy(*own).orderBy(F.desc("score"), "id"))
    best = found.withColumn("place", place).filter(F.col("place") <= positives)
    listed = best.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))  # a few each

    def second(b: Block, row: dict, vector: np.ndarray, scores: np.ndarray) -> Iterator[tuple]:
        limits = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in row["positives"]]
        for p, hits in zip(row["positives"], b.negatives(row["label"], scores, limits, k), strict=True):
            for i in hits:
                yield row["vec_id"], row["version"], p["place"], p["id"], p["score"], int(b.ids[i]), int(scores[i])

    asked = anchors.join(listed, own)
    read = _streamed(rows, asked, blocks, dim, second, "vec_id bigint, version bigint, place int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    rank = F.row_number().over(W.partitionBy(*own, "place").orderBy(F.desc("negative_score"), "negative_id"))
    return read.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
