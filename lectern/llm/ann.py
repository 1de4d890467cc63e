"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector's difference from the mean of all vectors is turned by a random rotation and kept as one sign bit for each
dimension, with two correction scalars: its length, and how well the signs point its way. A query is turned
likewise and rounded to 4 bits a dimension, so that a few bit counts estimate its inner product with a code. How far
an estimate can be off follows from the second scalar. Within a block of candidates the nearest by estimate are
computed exactly; then every candidate whose upper bound reaches the worst of those is computed exactly too. So codes
decide what is read, and all scores are exact inner products in double precision.

Work is dealt as pairs of a block of candidates and a block of queries, both of bounded size and there as packed bytes;
each pair gives at most ``k`` rows a query, and Spark keeps the best ``k`` of all pairs. A candidate is shipped once for
``QUERIES`` queries, a query once for a block of candidates.

Defined results: vectors that are null, all zero, or hold a null or non-finite component, rows with a null id,
and vectors of another length than most take no part; repeated rows (same id, same vector) count once, before any
block is dealt; of an id with several vectors each is a row of its own; a row is never its own neighbour; ties go to the
smaller id; an empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm._common import materialise, prepare

K = 20
SEED = 11
#: How many standard deviations of the estimate its bounds allow for.
CONFIDENCE = 3.0
#: Rows of one block at most. Blocks are smaller where there would be fewer than the tasks that can run.
CANDIDATES, QUERIES = 16_384, 16_384
_QUERY_BITS = 4
_SLICE = 32


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random rotation of ``dim`` dimensions, the same each time."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (64 to a word), lengths, and cosines between a vector and its signs."""
    diff = (x - mean) @ turn
    size = np.linalg.norm(diff, axis=1)
    unit = diff / np.maximum(size, 1e-300)[:, None]
    fit = np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])
    bits = np.packbits(diff > 0, axis=1, bitorder="little")
    wide = np.zeros((len(x), -(-x.shape[1] // 64) * 8), dtype=np.uint8)
    wide[:, : bits.shape[1]] = bits
    return wide.view("<u8"), size, np.where(size > 0, fit, 1.0)


def _planes(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bit planes of queries rounded to a few bits, with the low end and the step of each."""
    low, high = q.min(axis=1), q.max(axis=1)
    step = np.maximum((high - low) / (2**_QUERY_BITS - 1), 1e-300)
    level = np.rint((q - low[:, None]) / step[:, None]).astype(np.uint8)
    out = np.zeros((_QUERY_BITS, len(q), -(-q.shape[1] // 64) * 8), dtype=np.uint8)
    for j in range(_QUERY_BITS):
        bits = np.packbits((level >> j) & 1, axis=1, bitorder="little")
        out[j, :, : bits.shape[1]] = bits
    return out.view("<u8"), low, step


def search_block(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, size: np.ndarray, fit: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, mean: np.ndarray, turn: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query id, id, exact inner product) of each query's ``k`` best in one block."""
    dim = x.shape[1]
    turned = queries @ turn
    spread = np.sqrt(np.maximum(1 - fit * fit, 0)) / fit / np.sqrt(max(1, dim - 1))
    planes, low, step = _planes(turned)
    planes, codes = np.ascontiguousarray(planes.transpose(0, 2, 1)), np.ascontiguousarray(codes.T)
    small = np.uint16 if dim <= 4096 else np.uint32
    ones = np.bitwise_count(codes).sum(axis=0, dtype=np.float32)
    low, step, turned, queries32, size32, fit32, spread = (v.astype(np.float32) for v in (low, step, turned, queries, size, fit, spread))
    total, base = turned.sum(axis=1), queries32 @ mean.astype(np.float32)
    q_size = np.linalg.norm(queries32, axis=1)
    scale = size32 / fit32 / np.float32(np.sqrt(dim))
    out: list[tuple[int, int, float]] = []
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    for a in range(0, len(queries), _SLICE):
        part = slice(a, a + _SLICE)
        hits = np.zeros((min(_SLICE, len(queries) - a), len(x)), dtype=small)
        for j in range(_QUERY_BITS):
            for w in range(len(codes)):
                hits += np.bitwise_count(planes[j, w, part][:, None] & codes[None, w]).astype(small) << small(j)
        signed = 2 * (low[part, None] * ones + step[part, None] * hits.astype(np.float32)) - total[part, None]
        estimate = base[part, None] + signed * scale
        off = CONFIDENCE * size32 * (q_size[part, None] * spread + step[part, None] / 3) + 1e-5 * q_size[part, None]
        for n in range(len(hits)):
            q, own = queries[a + n], query_ids[a + n]
            same = order[np.searchsorted(sorted_ids, own, "left") : np.searchsorted(sorted_ids, own, "right")]
            itself = same[(x[same] == q).all(axis=1)]
            est, slack = estimate[n], off[n]
            est[itself] = -np.inf
            if len(est) - len(itself) > k:
                first = np.argpartition(-est, k)[:k]
                worst = (x[first] * q).sum(axis=1).min()
                rows = np.flatnonzero(est + slack >= worst)
            else:
                rows = np.flatnonzero(est > -np.inf)
            exact = (x[rows] * q).sum(axis=1)
            best = np.lexsort((ids[rows], -exact))[:k]
            out += zip([own] * len(best), ids[rows][best].tolist(), exact[best].tolist(), strict=True)
    return out


def _usable(vector: Column, dim: int) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda v: v != 0)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The coded rows (vec_id, raw, code, size, fit; raw is the vector as doubles), the mean and the rotation. All rows are coded."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("vec_id is not null and vector is not null")
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = max(1, common["n"]) if common else 1
    rows = rows.filter(_usable(F.col("vector"), dim))
    means = {r["pos"]: r["m"] for r in rows.select(F.posexplode("vector")).groupBy("pos").agg(F.avg("col").alias("m")).collect()}
    mean, turn = np.array([means.get(i, 0.0) for i in range(dim)]), rotation(dim)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            x = np.stack(batch["vector"].tolist()) + 0.0 if len(batch) else np.zeros((0, dim))  # no negative zeros
            codes, size, fit = encode(x, mean, turn)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "raw": [v.tobytes() for v in x], "code": [c.tobytes() for c in codes], "size": size, "fit": fit})

    coded = rows.mapInPandas(run, "vec_id bigint, raw binary, code binary, size double, fit double")
    return materialise(coded.dropDuplicates(["vec_id", "raw"])), mean, turn


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = 20, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of every row whose id is divisible by ``every``."""
    index, mean, turn = build_index(vectors, id_col, vector_col)
    dim, at_once = len(mean), vectors.sparkSession.sparkContext.defaultParallelism
    asked = F.col("vec_id") % every == 0
    n, m = index.agg(F.count(F.lit(1)), F.count(F.when(asked, 1))).first()
    n_blocks, m_blocks = max(1, -(-n // candidates), min(2 * at_once, n // 1024)), max(1, -(-m // queries))
    block = lambda salt, of: F.pmod(F.xxhash64("vec_id", "raw", F.lit(salt)), F.lit(of))
    deal = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)).cast("array<bigint>"))
    left = index.withColumn("vb", block(1, n_blocks)).withColumn("qb", deal(m_blocks))
    right = index.filter(asked).select("vec_id", "raw").withColumn("qb", block(2, m_blocks)).withColumn("vb", deal(n_blocks))
    vectors_of = lambda raw: np.frombuffer(b"".join(raw), dtype="<f8").reshape(-1, dim)

    def pair(_key, c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        codes = np.frombuffer(b"".join(c["code"]), dtype="<u8").reshape(len(c), -1)
        found = search_block(c["vec_id"].to_numpy(), vectors_of(c["raw"]), codes, c["size"].to_numpy(), c["fit"].to_numpy(), q["vec_id"].to_numpy(), vectors_of(q["raw"]), mean, turn, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(pair, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
