"""Drawing documents towards a target distribution, by hashed n-grams whose CRCs are composed and never spelled.

A word's CRC-32 is worked out once: every byte's share depends on it and on how many bytes follow, so shares are looked
up and joined by exclusive or. The CRC of words joined by spaces follows from theirs: the former's is multiplied by the
matrix over GF(2) that appends as many zero bytes as the latter is long, and added. No n-gram is ever a string.

Features fall into a fixed number of buckets by CRC. Counts of a bucket in all documents and in the target's texts give
its gain, a log ratio; a document's weight is the sum of its features' gains; Gumbel noise from a hash of its id makes
the highest scores a sample without replacement in proportion to the exponentials of the weights. Only counts by bucket
come to the driver. Documents are read twice, once for the counts and once for the weights.

Places of the drawn come from counts by cells of scores, so no window holds all of them.

Defined results: a null or empty text has no words and weight 0; documents with too few words are never drawn;
a null id is hashed as the empty text and comes last among ties; repeated rows are drawn each for itself (their scores
are equal); an empty table gives an empty result; without target texts all counts there are 0. Other columns may have any names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm._common import materialise, prepare
from lectern.llm._ranks import cell_starts, step

ORDER, BUCKETS, SEED, SHARE, LEAST = 1, 10_000, 2024, 10, 20
_NEAR = 64  # bytes that may follow within a stretch of which shares are looked up
_PIECE = 1 << 20
_CELL_BITS = 12


def _byte_shares(n: int) -> np.ndarray:
    """For 0 to n - 1 bytes that follow: the CRC of each byte's value, begun at zero."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> 1) ^ np.where(c & 1, np.uint32(0xEDB88320), np.uint32(0))
    out = [c]
    for _ in range(n - 1):
        out.append((out[-1] >> 8) ^ c[out[-1] & 255])
    return np.stack(out)


_SHARES = _byte_shares(_NEAR)
_FLAT = _SHARES.ravel()


def _powers(n: int) -> list[np.ndarray]:
    """Matrices that append 1, 2, 4, ... zero bytes, each as a table of four bytes' images."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    image = (bits >> 8) ^ _SHARES[0][bits & 255]
    out = []
    for _ in range(n):
        table = np.zeros((4, 256), dtype=np.uint32)
        for bit in range(8):
            table ^= np.where((np.arange(256) >> bit) & 1, image.reshape(4, 8)[:, bit, None], np.uint32(0))
        out.append(table)
        image = _times(table, image)
    return out


def _times(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


_POWERS = _powers(40)


def appended(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRCs after so many zero bytes each."""
    k = 0
    while (left := zeros >> k).any():
        crc = np.where(left & 1, _times(_POWERS[k], crc), crc)
        k += 1
    return crc


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of the one text and the other after it, from those of both and the length of the other."""
    return appended(first, length) ^ second


_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_WORD[range(0x41, 0x5B)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_ONES = np.uint32(0xFFFFFFFF)


def _of_piece(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRCs of the words low[starts:ends]."""
    length = ends - starts
    last = np.cumsum(length)
    at = np.arange(last[-1]) + np.repeat(starts - (last - length), length)
    after = np.repeat(ends - 1, length) - at
    share = _FLAT[(after % _NEAR) * 256 + low[at]]
    far = np.flatnonzero(after >= _NEAR)  # of long words: the stretches before the last
    if len(far):
        share[far] = appended(share[far], after[far] - after[far] % _NEAR)
    crc = np.bitwise_xor.reduceat(share, last - length)
    return crc ^ appended(np.full(len(crc), _ONES), length) ^ _ONES


def word_crcs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, CRC and length of every word of texts that lie one after another in ``data``, in bounded pieces."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    a, end = int(bounds[0]), int(bounds[-1])
    while a < end:
        b = min(end, a + _PIECE)
        near = bounds[np.searchsorted(bounds, b, "right") - 1]  # the last beginning of a text within
        if b < end and near < b:
            gaps = np.flatnonzero(~_WORD[data[a:b]])
            b = max(int(near), a + int(gaps[-1]) + 1 if len(gaps) else a)
        if b <= a:  # one word fills the piece
            stop, crc, b = int(bounds[np.searchsorted(bounds, a, "right")]), 0, a
            while b < stop:
                gaps = np.flatnonzero(~_WORD[data[b : min(stop, b + _PIECE)]])
                c = b + int(gaps[0]) if len(gaps) else min(stop, b + _PIECE)
                crc, b = zlib.crc32(_LOWER[data[b:c]].tobytes(), crc), c
                if len(gaps):
                    break
            found.append((np.array([np.searchsorted(bounds, a, "right") - 1]), np.array([crc], dtype=np.uint32), np.array([b - a])))
            a = b
            continue
        word = _WORD[data[a:b]]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        inner = bounds[np.searchsorted(bounds, a, "right") : np.searchsorted(bounds, b, "left")] - a
        opens[inner] = word[inner]
        closes[inner - 1] = word[inner - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        if len(starts):
            found.append((np.searchsorted(bounds, starts + a, "right") - 1, _of_piece(_LOWER[data[a:b]], starts, ends), ends - starts))
        a = b
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_SPACE = np.uint32(zlib.crc32(b" "))


def feature_crcs(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text; text number and CRC of every run of 1 to ``order`` words."""
    wide = texts.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    bounds = np.frombuffer(offsets, dtype="<i8")[wide.offset : wide.offset + len(wide) + 1]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    doc, word, length = word_crcs(bytes_, bounds)
    docs, crcs, run, size = [doc], [word], word, length
    for n in range(2, order + 1):
        if len(word) < n:
            break
        run = joined(joined(run[:-1], np.full(len(run) - 1, _SPACE), np.ones(len(run) - 1, dtype=np.int64)), word[n - 1 :], length[n - 1 :])
        whole = doc[: len(run)] == doc[n - 1 :]
        docs.append(doc[: len(run)][whole])
        crcs.append(run[whole])
    return np.bincount(doc, minlength=len(texts)), np.concatenate(docs), np.concatenate(crcs)


def bucket_counts(docs: DataFrame, text: str, order: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            total += np.bincount(feature_crcs(b.column(0), order)[2] % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the log ratio of each bucket's smoothed shares, rounded down."""
    n = len(source)
    s, t = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, doc_id: str, text: str, order: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    buckets, kind = len(gain), docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            words, doc, crc = feature_crcs(b.column("text"), order)
            order_ = np.argsort(doc, kind="stable") if order > 1 else slice(None)  # runs of one length stand in order of texts
            total = np.concatenate([[0], np.cumsum(gain[crc[order_] % buckets])])
            many = np.bincount(doc, minlength=n)
            last = np.cumsum(many)
            yield pa.record_batch([b.column("doc_id"), pa.array(words), pa.array(many), pa.array(total[last] - total[last - many])], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; ranks of those drawn, ``share`` in a hundred of the documents of ``least`` words or more."""
    prepare(docs.sparkSession)
    gain = gains(bucket_counts(docs, text, order, buckets), bucket_counts(target, target_text, order, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = weighed(docs, gain, doc_id, text, order).withColumn("score", F.col("weight") + noise)
    rows = materialise(rows.withColumn("cell", F.when(F.col("n_words") >= least, step(-F.col("score"), _CELL_BITS))).drop("n_words").withColumn("n", F.lit(1).cast("bigint")))
    cells = cell_starts(rows.filter("cell is not null"), [], "cell", "n", (_CELL_BITS // 2, _CELL_BITS // 2))
    drawn = rows.filter("cell is not null").count() * share // 100
    last = cells.filter(F.col("before") < drawn).agg(F.max("cell")).first()[0]
    ahead = F.coalesce(F.col("cell") <= F.lit(last), F.lit(False))
    place = F.row_number().over(W.partitionBy("cell").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    ranked = rows.filter(ahead).withColumn("place", place.cast("bigint")).join(cells, "cell").withColumn("rank", F.col("before") + F.col("place"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionByName(rows.filter(~ahead).withColumn("rank", F.lit(None).cast("bigint")).select(*out))
